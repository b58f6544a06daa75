"""Merkle manifest of a dataset: digests of all rows, folded run by run into one root, and proofs.

Leaves of one part (``lang``) stand in order of their id; eight consecutive nodes become one node of
the next level until one is left, the part's subroot. The subroots, in order of their part, are folded
the same way into the root. Leaves get their places from a range partitioning and counts a partition,
so no part is numbered in one task.

Built levels are stored as node rows linked to their parents: (node, parent, before, after), the last
two being the digests of the siblings on either side. A recursive query climbs from the leaves to the
root along the links, appends the siblings it passes and folds the digest of the row as it is read
now. The eight leaves of a run have all siblings above it in common, so they climb in one row that
holds a digest for each of them; a shared path is appended once.

Nulls: a null field is written as ``-``; null parts are a part of their own, first in order; null ids
stand first. Rows that repeat an id are ordered by their leaf, equal rows are leaves of their own.
Empty texts are values of length 0, long texts are hashed whole. An empty table gives no rows. Columns
that are not among the hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .registry import query

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "*"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbouring fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(digests: Column) -> Column:
    """Digest of an array of digests."""
    return F.sha2(F.array_join(digests, ""), 256)


def part_key(part: Column) -> Column:
    """Name of a part's tree; a null part differs from every text."""
    return F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("-"))


def node_name(key: Column, level: int, place: Column) -> Column:
    return F.concat(key, F.lit(f":{level}:"), place.cast("string"))


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` with ``place`` (from 0, inside ``key``) and ``total`` (rows of the key)."""
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    marked = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_at", 33)
    own = Window.partitionBy("_key")
    counts = marked.groupBy(F.col(key).alias("_key"), task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", "_task", (ahead - F.col("_first")).alias("_ahead"), F.sum("_n").over(own).alias("total"))
    joined = marked.join(counts, (F.col(key) == F.col("_key")) & (task == F.col("_task")))
    return joined.withColumn("place", F.col("_at") + F.col("_ahead")).drop("_at", "_key", "_task", "_ahead")


@dataclass
class Manifest:
    """``runs``: (bundle, lone, members) leaves of a run or a lone leaf, members being (leaf, id, now);
    ``nodes``: (node, parent, before, after, digest, subroot); ``root``: the root's digest."""

    runs: DataFrame
    nodes: DataFrame
    root: str


def _climbed(level: DataFrame, step: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Runs of a level's nodes (key, total, place, node, digest, ...): (runs, next level)."""
    members = F.array_sort(F.collect_list(F.struct("place", "node", "digest", *more)))
    runs = level.groupBy("key", "total", F.expr(f"place div {FAN}").alias("place")).agg(members.alias("members"))
    runs = cut(runs.withColumn("node", node_name(F.col("key"), step + 1, F.col("place"))).withColumn("digest", fold(F.col("members.digest"))), "runs")
    return runs, runs.select("key", "total", "place", "node", "digest")


def _linked(runs: DataFrame) -> DataFrame:
    """Node rows of the members of runs."""
    around = lambda start, length: F.unhex(F.array_join(F.slice("members.digest", start, length), ""))
    m = F.col("m")
    one = runs.select(F.col("node").alias("parent"), "members", F.posexplode("members").alias("k", "m"))
    return one.select(m["node"].alias("node"), "parent", around(F.lit(1), F.col("k")).alias("before"), around(F.col("k") + 2, F.lit(FAN)).alias("after"), m["digest"].alias("digest"))


def _grow(level: DataFrame, levels: int, *more: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels above rows (key, total, place, node, digest): (runs by level, finished nodes by level)."""
    runs, tops, names = [], [], ["key", "total", "place", "node", "digest"]
    for step in range(levels + 1):
        left = F.ceil(F.col("total") / F.lit(FAN**step))
        tops.append(level.where(left == 1).select(*names))
        if step < levels:
            made, level = _climbed(level.where(left > 1), step, *(more if step == 0 else ()))
            runs.append(made)
    return runs, tops


def _height(level: DataFrame) -> int:
    most, levels = level.agg(F.max("total")).first()[0] or 0, 0
    while FAN**levels < most:
        levels += 1
    return levels


def build(leaves: DataFrame) -> Manifest | None:
    """Manifest of rows (id, part, leaf, now): ``leaf`` is the digest to build on, ``now`` the digest of
    the row as a reader finds it. None if there are no rows. Runs jobs: one a level."""
    rows = leaves.select("id", part_key(F.col("part")).alias("key"), F.col("part").cast("string").alias("part"), F.col("leaf").alias("digest"), "now")
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    first = numbered(rows, "key", F.col("id").asc_nulls_first(), F.col("digest"), F.col("copy")).withColumn("node", node_name(F.col("key"), 0, F.col("place")))
    first = cut(first.select("key", "total", "place", "node", "digest", "id", "now", "part"), "leaves")
    if first.isEmpty():
        return None
    runs, tops = _grow(first, _height(first), "id", "now")
    parts = first.groupBy("key").agg(F.first("part").alias("part"))
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = cut(subroots.select("key", "node", "digest").join(parts, "key").drop("key"), "subroots")
    ordered = numbered(subroots.withColumn("key", F.lit(_TOP)), "key", F.col("part").asc_nulls_first())
    ordered = cut(ordered.select("key", "total", "place", "node", "digest"), "subroots")
    upper, above = _grow(ordered, _height(ordered))
    root = next(row for row in (top.first() for top in above) if row)
    kept = ["node", "parent", "before", "after", "digest"]
    nodes = _linked(upper[0]).withColumn("subroot", F.lit(True)) if upper else None
    for made in [*runs[1:], *upper[1:]]:
        more = _linked(made).withColumn("subroot", F.lit(False))
        nodes = more if nodes is None else nodes.unionByName(more)
    if nodes is None:
        nodes = ordered.select("node", F.lit(None).cast("string").alias("parent"), F.lit(b"").alias("before"), F.lit(b"").alias("after"), "digest", F.lit(True).alias("subroot")).where("false")
    member = F.transform("members", lambda m: F.struct(m["digest"].alias("leaf"), m["id"].alias("id"), m["now"].alias("now")))
    bundles = first.where("total = 1").select(F.col("node").alias("bundle"), F.lit(True).alias("lone"), F.array(F.struct(F.col("digest").alias("leaf"), "id", "now")).alias("members"))
    if runs:
        bundles = bundles.unionByName(runs[0].select(F.col("node").alias("bundle"), F.lit(False).alias("lone"), member.alias("members")))
    return Manifest(bundles, cut(nodes.select(*kept, "subroot"), "nodes"), root["digest"])


_CLIMB = """
WITH RECURSIVE climb(bundle, node, folded, path, subroot) AS (
  SELECT bundle, bundle, folded, CAST('' AS BINARY), CAST(NULL AS STRING) FROM {starts}
  UNION ALL
  SELECT c.bundle, n.parent, transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256))),
    concat(c.path, n.before, n.after), coalesce(c.subroot, CASE WHEN n.subroot THEN n.digest END)
  FROM climb c JOIN {nodes} n ON c.node = n.node
)
SELECT c.bundle, c.folded, c.path, c.subroot FROM climb c LEFT ANTI JOIN {nodes} n ON c.node = n.node
"""


def climb(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root) for every leaf; ``proof`` holds the siblings that
    stand beside the way to the root, level by level and left to right, as one text."""
    spark = manifest.nodes.sparkSession
    # Each leaf's run with that leaf as it reads now; a lone leaf has nothing to fold with.
    changed = F.transform("members", lambda m, i: F.unhex(fold(F.transform("members", lambda x, j: F.when(i == j, x["now"]).otherwise(x["leaf"])))))
    starts = manifest.runs.select("bundle", F.when(F.col("lone"), F.transform("members", lambda m: F.unhex(m["now"]))).otherwise(changed).alias("folded"))
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        tops = cut(spark.sql(_CLIMB, starts=starts, nodes=manifest.nodes), "climbed")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    rows = manifest.runs.join(tops, "bundle").select("members", "folded", "path", "subroot", F.posexplode("members").alias("k", "m"))
    beside = F.array_join(F.filter(F.col("members.leaf"), lambda x, j: j != F.col("k")), "")
    return rows.select(
        F.col("m.id").alias("id"), F.col("m.leaf").alias("leaf"), F.coalesce("subroot", F.lit(manifest.root)).alias("subroot"), F.lit(manifest.root).alias("root"),
        F.concat(beside, F.lower(F.hex("path"))).alias("proof"), F.lower(F.hex(F.get("folded", F.col("k")))).alias("folded_root"),
    )


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides crc32 of the id, else as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def manifest_rows(docs: DataFrame) -> DataFrame:
    """(id, part, leaf, now) of documents."""
    fixed = [F.col(c) for c in COLUMNS[:-1]]
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("part"), row_digest(*fixed, F.col("text")).alias("leaf"),
        row_digest(*fixed, tampered_text(F.col("doc_id"), F.col("text"))).alias("now"),
    )


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of documents."""
    manifest = build(manifest_rows(docs))
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}")
    return climb(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = """
WITH RECURSIVE
  crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n)) AS t),
  docs AS (
    SELECT d.*, 4294967295 - list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(crc.t[xor(c % 256, x) + 1], c // 256), 4294967295::BIGINT) AS h
    FROM documents d, crc),
  fields AS (
    SELECT doc_id, lang, h,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, coalesce(strlen(text) || ':' || text, '-') AS plain,
      coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
    FROM docs),
  leaves AS (
    SELECT doc_id, lang, sha256(head || plain) AS leaf, sha256(head || CASE WHEN h % 3 = 0 THEN lowered ELSE plain END) AS now,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || plain)) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
    FROM fields),
  tree AS (
    SELECT lang, 0 AS lvl, idx, leaf AS h, n FROM leaves
    UNION ALL
    SELECT lang, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8),
  subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
  upper AS (
    SELECT 0 AS lvl, idx, h, n FROM subroots
    UNION ALL
    SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY lvl, idx // 8),
  runs AS (SELECT lang, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
  upper_runs AS (SELECT lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM upper WHERE n > 1 GROUP BY ALL),
  climb AS (
    SELECT doc_id, lang, leaf, 0 AS lvl, idx, now AS f, '' AS path, n FROM leaves
    UNION ALL
    SELECT c.doc_id, c.lang, c.leaf, c.lvl + 1, c.idx // 8,
      sha256(array_to_string(hs[:c.idx % 8], '') || c.f || array_to_string(hs[c.idx % 8 + 2:], '')),
      c.path || array_to_string(hs[:c.idx % 8], '') || array_to_string(hs[c.idx % 8 + 2:], ''), (c.n + 7) // 8
    FROM climb c JOIN runs r ON c.lang IS NOT DISTINCT FROM r.lang AND c.lvl = r.lvl AND c.idx // 8 = r.run WHERE c.n > 1),
  ascent AS (
    SELECT c.doc_id, c.leaf, s.h AS subroot, 0 AS lvl, s.idx, c.f, c.path, s.n FROM climb c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.n = 1
    UNION ALL
    SELECT a.doc_id, a.leaf, a.subroot, a.lvl + 1, a.idx // 8,
      sha256(array_to_string(hs[:a.idx % 8], '') || a.f || array_to_string(hs[a.idx % 8 + 2:], '')),
      a.path || array_to_string(hs[:a.idx % 8], '') || array_to_string(hs[a.idx % 8 + 2:], ''), (a.n + 7) // 8
    FROM ascent a JOIN upper_runs r ON a.lvl = r.lvl AND a.idx // 8 = r.run WHERE a.n > 1)
SELECT a.doc_id, a.leaf, a.subroot, u.h AS root, sha256(a.path) AS proof_sha256, a.f AS folded_root, a.f = u.h AS verified
FROM ascent a, (SELECT h FROM upper WHERE n = 1) u WHERE a.n = 1
"""


@query("op13_merkle_manifest", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
