"""Frame directories, JSON manifests and logs (SRC1, SRC2, SRC4, SRC5, SRC10, SRC11, SRC13, SRC14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import rational
from .cues import read_texts

C, L = F.col, F.lit

JOBS = (
    "id string, name string, state string, input_path string, output_path string, fps double, width int, height int, total_frames bigint, "
    "frames_processed bigint, frames_failed bigint, avg_psnr double, avg_ssim double, created_at timestamp, updated_at timestamp, config_json string"
)
FRAMES = (
    "job_id string, frame_number bigint, state string, input_path string, output_path string, processing_time_ms bigint, retry_count int, "
    "psnr double, ssim double, error string, started_at timestamp, completed_at timestamp"
)
QUALITY_POINT = "timestamp string, job_id string, job_name string, psnr double, ssim double, vmaf double, processing_time_seconds double, frames_processed bigint"
QUALITY_HISTORY = f"data_points array<struct<{QUALITY_POINT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
BENCH_CONFIG = "name:string,benchmark_type:string,input_resolution:array<int>,output_resolution:array<int>,input_fps:double,output_fps:double,frame_count:bigint,scale_factor:int,model_name:string,device:string"
BENCH_METRICS = (
    "processing_time_seconds:double,frames_processed:bigint,fps_input:double,fps_output:double,throughput_mb_per_second:double,memory_peak_mb:double,"
    "memory_average_mb:double,gpu_utilization_percent:double,gpu_memory_peak_mb:double,gpu_memory_average_mb:double,psnr:double,ssim:double,"
    "stage_timings:map<string,double>,cpu_utilization_percent:double,temperature_peak_celsius:double"
)
BENCHMARKS = f"results array<struct<config:struct<{BENCH_CONFIG}>,metrics:struct<{BENCH_METRICS}>,timestamp:string,success:boolean,error_message:string>>, _corrupt_record string"
CHECKPOINT = (
    "stage string, last_completed_frame bigint, total_frames bigint, source_path string, config_hash string, checkpoint_interval int, created_at string, updated_at string, "
    "frames array<struct<frame_number:bigint,input_path:string,output_path:string,checksum:string,processed:boolean,timestamp:string>>"
)
FILE_INFO = "path:string,filename:string,file_size_bytes:bigint,md5_checksum:string,sha256_checksum:string,duration_seconds:double,width:int,height:int,fps:double,codec:string,audio_codec:string"
SIDECAR = f"source_file struct<{FILE_INFO}>, output_file struct<{FILE_INFO}>"
PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,sample_rate:string>>, "
    "format struct<duration:string,bit_rate:string>"
)
SCORE = "vmaf:double,psnr_y:double,psnr_cb:double,psnr_cr:double,ssim:double,ms_ssim:double"
POOL = "mean:double,min:double,max:double,harmonic_mean:double,stddev:double,percentile:map<string,double>"
QUALITY_LOG = f"frames array<struct<frameNum:bigint,metrics:struct<{SCORE}>>>, pooled_metrics struct<vmaf:struct<{POOL}>,psnr_y:struct<{POOL}>,ssim:struct<{POOL}>,ms_ssim:struct<{POOL}>>"
LOG_LINE = "timestamp timestamp, level string, component string, message string, source struct<file:string,line:int,function:string>, exception string"


def frame_number(name: Column) -> Column:
    """SRC1: frame number of a file name; three forms tried in order."""
    # The three forms of a file name.
    forms = (r"(?i)frame[_-]?(\d+)", r"^(\d+)\.", r"_(\d+)\.")
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), L("")).cast("long") for p in forms])


def scan_frames(spark: SparkSession, path: str, glob: str = "frame_*.png", content: bool = False) -> DataFrame:
    """SRC1: frame files with their number; listing order is never relied on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return files.select(*cols, frame_number(name).alias("frame_no"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: job table; parquet, clustered by id when written with :func:`write_clustered`."""
    return spark.read.schema(JOBS).parquet(path)


def read_job_frames(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: frame table."""
    return spark.read.schema(FRAMES).parquet(path)


def write_clustered(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """SRC2 (index): range-cluster by key so that row-group statistics prune point lookups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def quality_points(history: DataFrame) -> DataFrame:
    """SRC4: data points of quality history documents, null metrics kept."""
    return history.select(F.inline("data_points")).withColumn("timestamp", C("timestamp").try_cast("timestamp"))


def read_quality_history(spark: SparkSession, path: str) -> DataFrame:
    return quality_points(spark.read.schema(QUALITY_HISTORY).option("multiLine", True).json(path))


def parse_benchmarks(docs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC5: (results, quarantined documents) of benchmark documents, one document per row."""
    keep = [c for c in docs.columns if c != value]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = docs.select(*keep, value, F.from_json(value, BENCHMARKS, options).alias("d"))
    broken = C("d").isNull() | C("d._corrupt_record").isNotNull()
    good = raw.where(~broken).select(*keep, F.explode("d.results").alias("r")).select(*keep, "r.*")
    return good.withColumn("success", F.coalesce("success", L(True))), raw.where(broken).select(*keep, value)


def read_benchmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC5 for a directory: all ``*.json`` files, broken ones apart."""
    return parse_benchmarks(read_texts(spark, path, "*.json"))


def parse_probe(df: DataFrame, json: str = "json") -> DataFrame:
    """SRC10: media row of a probe document: first video stream, first audio stream, rational rate."""
    keep = [c for c in df.columns if c != json]
    d = df.select(*keep, F.from_json(json, PROBE).alias("d"))
    first = lambda kind: F.get(F.filter("d.streams", lambda s: s["codec_type"] == kind), 0)
    d = d.select(*keep, "d.format", first("video").alias("v"), first("audio").alias("a")).where(C("v").isNotNull())
    return d.select(
        *keep,
        F.coalesce("v.width", L(0)).alias("width"),
        F.coalesce("v.height", L(0)).alias("height"),
        rational(F.coalesce("v.r_frame_rate", L("30/1"))).alias("framerate"),
        F.coalesce("v.codec_name", L("unknown")).alias("codec"),
        F.coalesce(C("format.duration").try_cast("double"), L(0.0)).alias("duration"),
        F.coalesce(C("format.bit_rate").try_cast("long"), L(0)).alias("bit_rate"),
        C("a").isNotNull().alias("has_audio"),
        C("a.codec_name").alias("audio_codec"),
        F.when(C("a").isNotNull(), F.coalesce(C("a.sample_rate").try_cast("int"), L(0))).alias("audio_sample_rate"),
    )


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: checkpoint manifests, one row per manifest."""
    return spark.read.schema(CHECKPOINT).option("multiLine", True).json(path)


def checkpoint_frames(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """SRC11: frames of checkpoint manifests with the resume point."""
    return manifests.select(*keys, (C("last_completed_frame") + 1).alias("resume_frame"), F.inline("frames"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: sidecar manifests as ``path, file_size, md5, sha256``."""
    raw = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    return raw.select(C("output_file.path").alias("path"), C("output_file.file_size_bytes").alias("file_size"), C("output_file.md5_checksum").alias("md5"), C("output_file.sha256_checksum").alias("sha256"))


def quality_log_frames(logs: DataFrame, keys: list[str]) -> DataFrame:
    """SRC13: per-frame scores of quality-tool logs."""
    rows = logs.select(*keys, F.explode("frames").alias("f"))
    return rows.select(*keys, F.coalesce("f.frameNum", L(0)).alias("frame_no"), F.coalesce("f.metrics.vmaf", L(0.0)).alias("vmaf"), *[C(f"f.metrics.{n}").alias(n) for n in ("psnr_y", "ssim", "ms_ssim")])


def quality_log_pooled(logs: DataFrame, keys: list[str]) -> DataFrame:
    """SRC13: pooled scores; missing ones fall back to mean, minimum or maximum."""
    v = lambda n: F.coalesce(C(f"pooled_metrics.vmaf.{n}"), L(0.0))
    pct = lambda p, alt: F.coalesce(F.try_element_at(C("pooled_metrics.vmaf.percentile"), L(p)), v(alt))
    return logs.select(
        *keys,
        v("mean").alias("vmaf_mean"),
        v("min").alias("vmaf_min"),
        v("max").alias("vmaf_max"),
        F.coalesce(C("pooled_metrics.vmaf.harmonic_mean"), v("mean")).alias("vmaf_harmonic_mean"),
        v("stddev").alias("vmaf_std"),
        *[pct(p, alt).alias(f"vmaf_p{p}") for p, alt in (("5", "min"), ("25", "mean"), ("50", "mean"), ("75", "mean"), ("95", "max"))],
        C("pooled_metrics.psnr_y.mean").alias("psnr_mean"),
        C("pooled_metrics.ssim.mean").alias("ssim_mean"),
        F.coalesce(F.size("frames"), L(0)).alias("frame_count"),
    )


def parse_log_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC14: (rows, lines that do not parse) of structured JSON log lines, batch or streaming."""
    keep = [c for c in lines.columns if c != value]
    read = lines.select(*keep, value, F.from_json(C(value), LOG_LINE).alias("_l"))
    good = C("_l.message").isNotNull()
    return read.where(good).select(*keep, "_l.*"), read.where(~good).select(*keep, value)
