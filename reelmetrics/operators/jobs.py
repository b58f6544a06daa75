"""Job and frame bookkeeping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import TARGET_ROWS, Seq, key_join, number_rows


def queue_positions(
    jobs: DataFrame, keys: tuple[str, ...], urgency: str, created: str, job_id: str, rows: int = TARGET_ROWS
) -> DataFrame:
    """Processing order inside a queue (most urgent first, then oldest, then id).

    A queue may hold a large share of all jobs, so it is ranked per urgency in blocks of at most about
    ``rows`` jobs and shifted by the number of more urgent jobs.
    """
    ranked = number_rows(jobs, Seq((*keys, urgency), (created, job_id), rows=rows), "_rank", start=1)
    before = W.partitionBy(*keys).orderBy(urgency).rowsBetween(W.unboundedPreceding, -1)
    ahead = jobs.groupBy(*keys, urgency).agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select(*keys, urgency, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return ranked.transform(key_join, ahead, [*keys, urgency]).select(
        *jobs.columns, (F.col("_rank") + F.col("_ahead")).alias("queue_position")
    )
