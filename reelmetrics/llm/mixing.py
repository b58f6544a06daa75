"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words. Among all document rates between 0 and ``CAP`` that meet the
targets, entropy balancing takes the ones closest to 1 in relative entropy: a document of size x in
source s gets ``min(CAP, exp(lambda_s * x / mean_s))``. The lambdas solve the convex dual; Newton
iterations find them, each one aggregation over the cluster. Documents of one source and size have one
rate, so the iterations run on the counts by (source, size), which hold all documents exactly.

Rates become copies per (source, size): along falling sizes each size gets the whole number of copies
that brings the words taken so far closest to the words asked for so far, so a source misses its
target by half its smallest document at most, unless the cap binds. Inside a size the copies go round
the documents in an order given by a hash of the id; reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Documents of size
0 are never copied. Repeated rows are documents of their own, ids may be null or repeat. Long texts are
counted whole. An empty table gives no rows. Columns
other than id, text and source are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop_table, table
from .registry import query

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
ROUNDS = 60
SLICES = 64


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tag, size): words of the text, and a hash of it that tells apart the rows of an id."""
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), tag, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n).

    The targets fill up like water: all sources get ``c * weight`` up to ``cap`` times their size, and c
    is such that they sum to ``share`` of everything. In order of ``cap * size / weight`` the sources that
    are at their cap come first, so running sums find c. One row a source.
    """
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = own.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    full = F.col("source_size") * cap
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = weighed.withColumn("level", level).withColumn("level", F.when(level * F.col("weight") <= full, level))
    # The first source in this order that its level does not fill sets the level for all after it.
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "source_size", F.least(full.cast("double"), F.coalesce(level * F.col("weight"), full.cast("double"))).alias("target"))


def entropy_balance(sizes: DataFrame, targets: DataFrame, cap: int = CAP, rounds: int = ROUNDS, tolerance: float = 1e-9) -> DataFrame:
    """(source, size, n, rate, source_size, target): tilted rates that meet the targets.

    The dual splits by source into convex problems of one variable. A round is one pass over the
    counts: value and slope of the words taken, at the current lambda of every source; the step is
    Newton's where it stays inside the bracket known so far, else the bracket is halved.
    """
    stats = cut(
        sizes.where("size > 0").join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        .select("source", "size", "n", "source_size", "target"),
        "counts",
    )
    mean = stats.groupBy("source", "target", "source_size").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.max("size").alias("most"))
    state = cut(mean.select("source", "target", "mean", "most", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(False).alias("done")), "duals")
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        words = F.col("n") * F.col("size") * rate
        now = stats.select("source", "size", "n").join(state.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        taken = now.groupBy("source", "target", "mean", "most", "lam", "low", "high").agg(
            F.sum(words).alias("value"), F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope")
        )
        gap = F.col("target") - F.col("value")
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") + gap / F.col("slope")
        halved = (low + high) / 2
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(halved)
        done = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        new = cut(taken.select("source", "target", "mean", "most", F.when(done, F.col("lam")).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")), "duals")
        drop_table(state)
        state = new
        if new.where("NOT done").isEmpty():
            break
    final = stats.join(state.select(F.col("source").alias("own"), "lam", "mean"), F.col("source").eqNullSafe(F.col("own")))
    full = F.col("target") >= F.col("source_size") * cap
    return final.select("source", "size", "n", F.when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))).alias("rate"), "source_size", "target")


def whole_copies(rates: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies): whole copies of all documents of a source and size together. One row
    a distinct size of a source goes to a task."""

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        asked, taken, copies = 0.0, 0, []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
            asked += float(size) * n * rate
            k = min(cap * int(n), max(0, round((asked - taken) / size)))
            taken += k * int(size)
            copies.append(k)
        return rows.assign(copies=copies)[["source", "size", "n", "copies"]]

    # Per source: a null source is carried under a name of its own by the grouping.
    return rates.select("source", "size", "n", "rate").groupBy("source").applyInPandas(fn, "source string, size long, n long, copies long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, source, tag, size, source_size, target, rate, copies) for every row; ``copies`` says how
    often the mix takes the document."""
    sizes = cut(document_sizes(docs).withColumn("slice", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SLICES)).cast("int")), "sizes")
    by_slice = sizes.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    by_slice = cut(by_slice, "slices")
    counts = by_slice.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = cut(source_targets(counts, weights, share, cap), "targets")
    rates = cut(entropy_balance(counts, targets, cap), "rates")
    copies = cut(whole_copies(rates, cap).join(rates.select(F.col("source").alias("s"), F.col("size").alias("z"), "rate"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z"), "copies")
    # Copies go round the documents of a size; documents are numbered slice by slice.
    ahead = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = by_slice.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slice").alias("l"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plan = plan.join(copies.select("source", "size", "n", "copies", "rate"), F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")), "left").drop("source", "size")
    plan = plan.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    inside = Window.partitionBy("source", "size", "slice").orderBy(F.xxhash64("doc_id", "tag", F.lit(7)), "doc_id", "tag")
    numbered = sizes.withColumn("place", F.row_number().over(inside) - 1)
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("l"))
    placed = numbered.join(plan, on, "left")
    extra = (F.col("ahead") + F.col("place") < F.expr("copies % n")).cast("long")
    return placed.select(
        "doc_id", "source", "tag", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce(F.expr("copies DIV n") + extra, F.lit(0)).cast("long").alias("copies")
    )


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate")
