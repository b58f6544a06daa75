"""Tables with one row a key that are kept up to date by merging changes (SNK6, ST7).

The table is bucketed and sorted by its key and partitioned by a hash of it.  A merge brings the
changes to the buckets by a sort-merge join that reads the table without shuffling it, and rewrites
only the partitions in which a key changed.  Merging the same changes again changes nothing, so a
batch that is repeated after a failure does no harm.  Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable_checkpoint

KEY, PART = "_k", "_part"
#: Rows of the first changes that one bucket takes; the merge of a bucket is one task.
BUCKET_ROWS = 100_000
#: (value in the table, value of the change) -> new value; either is null if its side has no row.
Combine = Callable[[Column, Column], Column]


class KeyedTable:
    """A bucketed table ``name`` with one row per ``keys``.

    It has at least ``buckets`` buckets; the first merge makes more where it brings more than
    ``BUCKET_ROWS`` rows a bucket, so that the share of a task does not grow with the table.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], parts: int = 16, buckets: int = 8):
        self.spark, self.name, self.keys, self.parts, self.buckets = spark, name, list(keys), parts, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _table(self) -> DataFrame:
        # Merges may have run in another session, as those of a stream do.
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._table().drop(KEY, PART)

    def _placed(self, changes: DataFrame) -> DataFrame:
        return changes.withColumn(KEY, F.to_json(F.struct(*self.keys))).withColumn(PART, F.pmod(F.xxhash64(KEY), F.lit(self.parts)).cast("int"))

    def merged(self, changes: DataFrame, combine: Mapping[str, Combine], parts: list[int]) -> DataFrame:
        """The rows of ``parts`` after the merge; ``changes`` has one row a key and its place."""
        old = self._table().where(F.col(PART).isin(parts))
        new = changes.select(F.col(KEY).alias("_nk"), F.struct(*[c for c in changes.columns if c != KEY]).alias("_new"))
        both = old.hint("merge").join(new, old[KEY] == new["_nk"], "full_outer")
        values = {c: f(F.col(c), F.col(f"_new.{c}")).alias(c) for c, f in combine.items()}
        kept = [c for c in old.columns if c not in (KEY, PART)]
        return both.select(
            *(values[c] if c in values else F.coalesce(F.col(c), F.col(f"_new.{c}")).alias(c) for c in kept),
            F.coalesce(KEY, "_nk").alias(KEY), F.coalesce(PART, F.col(f"_new.{PART}")).alias(PART),
        )

    def merge(self, changes: DataFrame, combine: Mapping[str, Combine]) -> None:
        """Bring ``changes`` (one row a key) into the table; a column without a rule keeps its old value
        unless that is null.  Runs at once."""
        placed = durable_checkpoint(self._placed(changes))
        if not self.exists():
            columns = [c for c in placed.columns if c not in (KEY, PART)]
            buckets = max(self.buckets, -(-placed.count() // BUCKET_ROWS))
            first = placed.select(*columns, KEY, PART).repartition(buckets, KEY)
            first.write.partitionBy(PART).bucketBy(buckets, KEY).sortBy(KEY).format("parquet").saveAsTable(self.name)
            return
        touched = [r[0] for r in placed.select(PART).distinct().collect()]  # at most ``parts`` numbers
        if not touched:
            return
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            self.merged(placed, combine, touched).write.mode("overwrite").insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)


# --- SNK6: current jobs ------------------------------------------------------------------------
def current_changes(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: per column the last value that is set and its ``seq`` (a comparable column)."""
    rest = [c for c in changes.columns if c not in (*keys, seq)]

    def last(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), F.col(seq))
        return F.struct(F.max(known).alias("seq"), F.max_by(F.col(c), known).alias("v")).alias(c)

    return changes.groupBy(*keys).agg(*map(last, rest), F.max(seq).alias(seq))


def later(old: Column, new: Column) -> Column:
    """Of two (seq, v) the one with the greater ``seq``; a null ``seq`` is none."""
    newer = new["seq"].isNotNull() & (old["seq"].isNull() | (new["seq"] >= old["seq"]))
    return F.when(newer, new).when(old["seq"].isNotNull(), old).otherwise(F.coalesce(old, new))


def merge_current(table: KeyedTable, changes: DataFrame, seq: str) -> None:
    """SNK6: merge change rows (null means unchanged) into the snapshot, in any order."""
    rest = [c for c in changes.columns if c not in (*table.keys, seq)]
    table.merge(current_changes(changes, table.keys, seq), {**{c: later for c in rest}, seq: lambda a, b: F.greatest(a, b)})


def current_rows(table: KeyedTable, seq: str) -> DataFrame:
    """The current row of every key."""
    rows = table.read()
    return rows.select(*table.keys, *(F.col(f"{c}.v").alias(c) for c in rows.columns if c not in (*table.keys, seq)), seq)


# --- ST7: bounded history ----------------------------------------------------------------------
def merge_history(table: KeyedTable, rows: DataFrame, order: list[str], history: int) -> None:
    """Keep the current row of each key and at most ``history`` older ones, newest first by ``order``
    (which tells the rows of a key apart)."""
    newest = W.partitionBy(*table.keys).orderBy(*(F.col(c).desc() for c in order))
    rest = [c for c in rows.columns if c not in (*table.keys, *order)]
    top = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= history + 1)
    own = F.struct(*order, *rest)
    changes = top.groupBy(*table.keys).agg(F.sort_array(F.collect_list(own), asc=False).alias("rows"))

    def joined(old: Column, new: Column) -> Column:
        none = F.array().cast(changes.schema["rows"].dataType)
        return F.slice(F.sort_array(F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none))), asc=False), 1, history + 1)

    table.merge(changes, {"rows": joined})


def history_rows(table: KeyedTable) -> DataFrame:
    """All kept rows; ``is_current`` marks the newest of each key."""
    flat = table.read().select(*table.keys, F.posexplode("rows").alias("_at", "_row"))
    return flat.select(*table.keys, "_row.*", (F.col("_at") == 0).alias("is_current"))
