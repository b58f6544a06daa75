"""Corpus pipeline: documents in, token counts and digests of the mixed corpus out.

Every stage calls one operator, works on all rows that its predecessor kept and returns them with the
columns of ``documents`` (the last one returns the encoding). Between stages the rows are written to
the shared folder and read again. A decision belongs to a row, not to its id: it is joined back by id and
a hash of the text, null ids included, and one of equal rows stays. Nulls, empty texts and empty tables
pass through as the operators' docstrings define; further columns are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from reelmetrics.llm.common import bound_batches, cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def rows_once(docs: DataFrame, picked: DataFrame, tag: Column) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, ``tag``) is in ``picked`` (id, tag, rows, and columns to add); of
    ``rows`` that have id and tag in common one stays, by the hash of the whole row."""
    keys = picked.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("rows").alias("__rows"), *(F.col(c).alias(f"__{c}") for c in picked.columns if c not in ("id", "tag", "rows")))
    more = [c for c in keys.columns if c not in ("__id", "__tag", "__rows")]
    joined = docs.join(keys, docs["doc_id"].eqNullSafe(keys["__id"]) & (tag == keys["__tag"]))
    columns = [*(docs[c] for c in docs.columns), *more]
    if picked.where("rows > 1").isEmpty():
        return joined.select(*columns)
    own = F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)), *more)
    one = joined.where("__rows > 1").groupBy("__id", "__tag").agg(F.min_by(own, F.xxhash64(*docs.columns)).alias("one"))
    back = one.select(*(F.col(f"one.c{k}").alias(c) for k, c in enumerate(docs.columns)), *(f"one.{c}" for c in more))
    return joined.where("__rows = 1").select(*columns).unionByName(back)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one with the largest id."""
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        verdicts = exact_dedup.exact_duplicates(docs, index)
    finally:
        index.drop()
    kept = cut(verdicts.where("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("tag")).agg(F.count("*").alias("rows")), "kept")
    return rows_once(docs, kept, F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, one with the smallest id: five-word shingles, Jaccard 0.8."""
    bound_batches(spark)
    groups = ngram_join.ngram_components(docs, words=5, percent=80)
    kept = cut(groups.where("leads").groupBy(F.col("doc_id").alias("id"), "tag", "set_key").agg(F.count("*").alias("rows")), "kept")
    # Several texts of the leading id can have the leading set: the one with the smallest hash stays.
    several = kept.where("set_key IS NOT NULL").groupBy("id", "set_key").agg(F.min_by(F.struct("tag", "rows"), "tag").alias("first"))
    lead = several.select("id", "first.tag", "first.rows").unionByName(kept.where("set_key IS NULL").select("id", "tag", "rows"))
    return rows_once(docs, cut(lead, "kept"), ngram_join.text_tag(docs["text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    bound_batches(spark)
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), F.xxhash64("tag", "source").alias("tag")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = cut(copies.where("copies > 0"), "copies")
    mixed = rows_once(docs, copies, F.xxhash64(F.xxhash64(F.coalesce(docs["text"], F.lit(""))), docs["source"].cast("string")))
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    bound_batches(spark)
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Scores, links, rates and ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
