"""What the training-data operators share: tables, cut lineage, batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: Rows an Arrow batch carries to Python: long texts stay in bounded memory.
BATCH_ROWS = 1000

#: A word as the contracts define it; ``bytes.split()`` cuts at the same six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Hold batches that go to Python to ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A given table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: later steps do not
    recompute it, and a lost executor does not lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no frame refers to any more; else they stay until the driver happens to
    collect its garbage. Those of the last job may still be in use: call it a step later."""
    spark._jvm.System.gc()


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs: rows (node, component), the component being
    its smallest node. Alternating large and small stars; every round is one table, no node gathers
    its neighbours in one row, and the rounds grow with the logarithm of the longest path."""
    current = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges")
    seen = None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the smallest one
        large = both.join(low, "u").where("v > u").select(F.col("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: of the smaller neighbours, all hang on the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
        nxt = cut(small.select("e.u", "e.v").where("u < v").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(current)
        current = nxt
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def by_task(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function that is built once a task (lookup tables, tokenizers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, target: str, limits: dict[int, int], keep: Column) -> DataFrame:
    """(doc_id, label): for each label value at most ``limits[value]`` rows, those with the smallest
    hashes of the id, so reruns agree. The bound makes the result fit to be broadcast and to be
    collected. Null ids and labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & keep).select("doc_id", F.col(target).cast("int").alias("label"))
    parts = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in limits.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Bytes of text that a sample brings to the driver.
SAMPLE_BYTES = 64 << 20


def sampled_rows(docs: DataFrame, sample: DataFrame, limit: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of a bounded sample (doc_id, label), with one text an id (the smallest, if an
    id repeats; null as empty). In the order of the sample, rows are taken as long as their
    texts come to ``limit`` bytes together; a single longer text is left out."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    small = own.where(F.octet_length("text") <= limit)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = small.select("doc_id", F.sum(F.octet_length("text").cast("long")).over(order).alias("bytes")).where(F.col("bytes") <= limit).select("doc_id")
    return small.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "label")


def sample_texts(docs: DataFrame, sample: DataFrame, limit: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts (UTF-8, null as empty) and labels of a bounded sample, in order of the id: at most as many
    rows as the sample has, and ``limit`` bytes of text."""
    rows = sampled_rows(docs, sample, limit).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return [t.encode() for t in rows.column("text").to_pylist()], rows.column("label").to_pylist()
