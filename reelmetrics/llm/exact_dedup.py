"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. A batch is first reduced to one
row per digest (combined before the shuffle, so a text that fills a third of the batch is no hot
key), then the digests the index does not have are found by a sort-merge anti-join that reads the
index without shuffling it, and appended to it.

Nulls: a null text is the empty text, and empty texts are equal to each other. A row without id is
never preferred to one with an id. Ids are numbers of any size. Long texts are hashed whole. Rows that repeat id and text count once each in ``group_size``
and get the same verdict. Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the unchanged UTF-8 text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


class DigestIndex:
    """Persistent index (digest, keep_id), one row per digest, in a bucketed table of the warehouse.

    Batches that are added later never displace a row of the index: what is there stays.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """One row per digest of the batch (doc_id, digest) that the index lacks."""
        new = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if not self.exists():
            return new
        return new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Append the batch's unseen digests."""
        new = self.unseen(batch).repartition(self.buckets, "digest")
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def id_ranges(marks: DataFrame, batches: int) -> Column:
    """Number of a row's batch: 0 for the largest ids, the last for null ids; the edges are percentiles."""
    edges = marks.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    part = F.lit(0)
    for edge in edges or ():
        part = part + F.when(F.col("doc_id") > F.lit(edge), 0).otherwise(1)
    return part


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Verdict for every row: (doc_id, keep_id, group_size, kept, text_sha256); the largest id stays.

    The documents go into the index in ``batches`` ranges of ids, the largest ids first, so that the
    row that the index has of a digest is the one that stays. The verdict joins the digests of these
    documents with the index by its buckets; the index may be dropped once this has returned.
    """
    marks = cut(digests(docs, id_col, text_col), "digests")
    part = id_ranges(marks, batches)
    for k in range(batches):
        index.add(marks.where(part == k))
    # One row per digest: who stays and how many rows there are; counted before the join, so that a hot
    # digest is one row of it.
    sizes = marks.groupBy("digest").agg(F.count("*").alias("group_size"))
    classes = cut(sizes.join(index.read().select("digest", "keep_id").hint("merge"), "digest"), "classes")
    return marks.join(classes, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op3_exact_dedup", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return exact_duplicates(table(spark, sf_dir), index)
    finally:
        index.drop()
