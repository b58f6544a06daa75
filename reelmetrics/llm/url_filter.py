"""URL rules by a sort-merge range join over reversed-host keys, in DataFrame functions only.

A rule (host, path, action) becomes a key: its host's labels reversed, each followed by a dot, then
its path. A url becomes one key per suffix of its host. A rule fits when its key is a prefix of the
url's key, that is when the url's key lies in the interval that the rule's key opens. Rules and urls
are sorted together by key; the last rule at or before a url carries the stack of rules nested around
it, and the deepest of the stack that holds the url's key is the longest rule that fits.

The sorted rows are cut into ranges (Spark samples the bounds; equal keys are cut by id, so a host
with a third of all urls spreads over many ranges). Inside a range a window sweeps; between ranges
only one row per range travels, the stack at its end. A stack is as deep as rules are nested.

Nulls: a null url, or one without "://", has empty host and path and fits no rule. Rules without a
host, path or action are ignored; of equal rules, the one with the smallest action counts. The
verdict where no rule fits is ``default``. Repeated rows are judged each; an empty table or an empty
rule table works. Other columns of the urls are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(labels: Column) -> Column:
    """Reversed labels, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def nested_rules(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule, the rules whose key is a prefix of its own, itself included, deepest last."""
    own = (
        rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND action IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .select(
            F.concat(host_key(F.split(F.translate("host", UPPER, LOWER), r"\.")), "path").alias("key"),
            F.concat("host", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))).alias("rule"),
            "action",
        )
    )
    outer = own.select(F.col("key").alias("prefix"), F.struct(F.length("key").alias("n"), "key", "rule", "action").alias("entry"))
    prefixes = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.left("key", n))).alias("prefix"))
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``urls``; ``rules`` has host, path, action."""
    read = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # Repeated ids are told apart by a row mark that does not depend on the partitioning.
    read = read.groupBy("id", "host", "path").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    level = F.explode_outer(F.when(F.col("host") != "", F.sequence(F.lit(1), F.size(labels))))
    keyed = read.select("id", "host", "path", "copies", level.alias("level")).select(
        "id", "host", "path", "copies", F.concat(host_key(F.slice(labels, -F.col("level"), F.col("level"))), "path").alias("key")
    )
    stacks = nested_rules(rules)
    none = {c: F.lit(None).cast(t) for c, t in (("id", "long"), ("host", "string"), ("path", "string"), ("copies", "long"))}
    events = keyed.withColumns({"stack": F.lit(None).cast(stacks.schema["stack"].dataType), "kind": F.lit(1), "id": F.col("id").cast("long")}).unionByName(
        stacks.withColumns(none | {"kind": F.lit(0)})
    )
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "id"]
    ranges = cut(events.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "urls")
    ends = ranges.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    open_at = ranges.select("range").distinct().join(ends, "range", "left").select(
        "range", F.last("stack", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("open")
    )
    sweep = Window.partitionBy("range").orderBy(*order)
    swept = ranges.withColumn("own", F.last("stack", ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1").join(open_at, "range", "left")
    fits = F.filter(F.coalesce("own", "open"), lambda e: F.col("key").startswith(e["key"]))
    best = swept.withColumn("hit", F.when(F.size(fits) > 0, F.element_at(fits, -1)))
    one = best.groupBy("id", "host", "path").agg(F.max("hit").alias("hit"), F.max("copies").alias("copies"))
    return one.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SQL = """
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS h,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
  r(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
  m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
    FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""


@query("op7_url_filter", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
