"""Reports and job-table writes (SNK1, SNK2, SNK5, SNK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


C, L = F.col, F.lit


def fixed(col: Column, digits: int) -> Column:
    """Fixed decimals without grouping; empty text for null."""
    return F.when(col.isNull(), "").otherwise(F.format_string(f"%.{digits}f", col))


def quality_csv(points: DataFrame) -> DataFrame:
    """SNK1: quality history as text columns with fixed decimals."""
    return points.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "job_id",
        "job_name",
        fixed(C("psnr"), 4).alias("psnr"),
        fixed(C("ssim"), 6).alias("ssim"),
        fixed(C("vmaf"), 4).alias("vmaf"),
        fixed(C("processing_time_seconds"), 2).alias("processing_time_seconds"),
        C("frames_processed").cast("string").alias("frames_processed"),
    )


def write_quality_csv(points: DataFrame, path: str) -> None:
    quality_csv(points).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def benchmark_flat(results: DataFrame) -> DataFrame:
    """SNK2: nested benchmark results flattened for CSV; resolutions as ``WxH``, stage times as JSON."""
    size = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "x")
    seconds = C("metrics.processing_time_seconds")
    return results.select(
        C("config.name").alias("name"),
        C("config.benchmark_type").alias("benchmark_type"),
        size("config.input_resolution").alias("input_resolution"),
        size("config.output_resolution").alias("output_resolution"),
        C("config.model_name").alias("model_name"),
        "metrics.frames_processed",
        F.when(seconds > 0, C("metrics.frames_processed") / seconds).otherwise(0.0).alias("frames_per_second"),
        "metrics.memory_peak_mb",
        "metrics.gpu_memory_peak_mb",
        F.to_json("metrics.stage_timings").alias("stage_timings"),
        "success",
        "timestamp",
    )


def write_benchmarks(results: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK2: JSON keeps the nesting, CSV is flat."""
    if fmt == "json":
        results.write.mode("overwrite").json(path)
    else:
        benchmark_flat(results).write.mode("overwrite").option("header", True).csv(path)


def kept_frames(mapping: DataFrame, frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """SNK5: manifest of the kept frames of a dedup mapping, with how many frames each stands for."""
    n = mapping.groupBy(*keys, C("unique_frame").alias(frame)).agg(F.count(L(1)).alias("stands_for"))
    return frames.join(n, [*keys, frame])


def current_view(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """SNK6: current rows: per column the latest value that a change set (null means unchanged)."""
    rest = [c for c in changes.columns if c not in (*keys, seq)]
    return changes.groupBy(*keys).agg(*[F.max_by(C(c), F.when(C(c).isNotNull(), C(seq))).alias(c) for c in rest], F.max(seq).alias(seq))
