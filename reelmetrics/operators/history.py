"""Benchmark and profile history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import key_join

C = F.col


def iteration_rollup(df: DataFrame, keys: Sequence[str], means: Sequence[str], peaks: Sequence[str], frames: str) -> DataFrame:
    """Mean of most metrics, maximum of peaks, floored mean of frame counts."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.max(c).alias(c) for c in peaks],
        F.floor(F.sum(frames) / F.count(F.lit(1))).alias(frames),
    )


def stage_means(df: DataFrame, keys: Sequence[str], timings: str) -> DataFrame:
    """Mean time per stage over *all* iterations; an absent stage counts as 0."""
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = df.select(*keys, F.explode(timings).alias("stage", "_s")).groupBy(*keys, "stage").agg(F.sum("_s").alias("_s"))
    return per.transform(key_join, runs, keys).select(*keys, "stage", (C("_s") / C("_n")).alias("mean_seconds"))


def against_history(current: DataFrame, history: DataFrame, kind: str, fps: str, success: str, band: float = 0.05) -> DataFrame:
    """Current speed against the mean of successful runs of the same kind."""
    past = history.where(C(success)).groupBy(kind).agg(F.avg(fps).alias("historical_fps"), F.count(F.lit(1)).alias("historical_count"))
    out = current.join(past, kind, "left").fillna(0, ["historical_count"])
    now, old = C(fps), C("historical_fps")
    return out.withColumn(
        "trend",
        F.when(C("historical_count") == 0, "unknown")
        .when(now > old * (1 + band), "improving")
        .when(now < old * (1 - band), "degrading")
        .otherwise("stable"),
    ).withColumn(
        "change_percent",
        F.when(C("trend") == "improving", (now - old) / old * 100).when(C("trend") == "degrading", (old - now) / old * 100).otherwise(0.0),
    )


def stage_comparison(a: DataFrame, b: DataFrame, keys: Sequence[str], stage: str, duration: str) -> DataFrame:
    """Two profiles side by side, stages of either kept."""
    left = a.select(*keys, stage, C(duration).alias("a_seconds"))
    right = b.select(*keys, stage, C(duration).alias("b_seconds"))
    return left.join(right, [*keys, stage], "full")


def improvement(base: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time, speed and memory change of ``cur`` against ``base`` (``seconds, fps, peak_mb``)."""
    j = base.select(*keys, *[C(c).alias(f"b_{c}") for c in ("seconds", "fps", "peak_mb")]).join(
        cur.select(*keys, *[C(c).alias(f"c_{c}") for c in ("seconds", "fps", "peak_mb")]), list(keys)
    )
    return j.select(
        *keys,
        F.when(C("b_seconds") > 0, F.round((C("b_seconds") - C("c_seconds")) / C("b_seconds") * 100, 1)).alias("time_improvement_pct"),
        F.when(C("b_seconds") > 0, F.round(C("b_seconds") / F.greatest(C("c_seconds"), F.lit(0.001)), 2)).alias("speedup"),
        F.when(C("b_fps") > 0, F.round((C("c_fps") - C("b_fps")) / C("b_fps") * 100, 1)).alias("fps_improvement_pct"),
        F.round(C("b_peak_mb") - C("c_peak_mb"), 1).alias("memory_reduction_mb"),
    )


def benchmark_leaders(df: DataFrame, keys: Sequence[str], name: str, pos: str) -> DataFrame:
    """Fastest and most stable configuration, throttled runs and best batch size.

    ``df`` has ``fps, std_dev_ms, throttled, batch_size``; the first row wins ties.
    """
    per_batch = df.groupBy(*keys, "batch_size").agg(F.avg("fps").alias("_f"), F.min(pos).alias("_p"))
    batch = per_batch.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, F.max_by("batch_size", F.struct(C("_f"), -C("_p")))).alias("best_batch_size")
    )
    steady = F.when(C("std_dev_ms") > 0, F.struct(C("std_dev_ms"), C(pos)))
    lead = df.groupBy(*keys).agg(
        F.max_by(name, F.struct(C("fps"), -C(pos))).alias("fastest"),
        F.min_by(name, steady).alias("most_stable"),
        F.count(F.when(C("throttled"), 1)).alias("throttled_runs"),
    )
    return lead.transform(key_join, batch, keys)
