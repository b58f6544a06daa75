"""Ordered-sequence toolkit: exact window results without one task per video.

A video (or job) may hold a third of all rows, so nothing here puts a whole key into one
window partition.  A sequence is cut into *blocks* of bounded width along its order column
and every window runs over ``(keys, block)``.  What a row needs from outside its block comes

* from a **carry**: one aggregate row per block, scanned over the blocks of a key and joined
  back on ``(keys, block)`` - used for running values and for the previous / next row; or
* from a **halo**: copies of the few rows next to a block edge - used for row frames, where the
  order column is a gap-free position (frame number), so that the edge is plain arithmetic.

Blocks of ``Seq(rows=n)`` are bounded in rows instead: the rows are sorted across the cluster by
sampled splitters, so a key that holds most rows of one hour is cut like any other.  Such a frame is
counted first and, unless it fits one block, kept in a reliable checkpoint.

``Seq(width=None)`` declares that keys are known to be small and uses plain windows; results
are the same, which the tests check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable_checkpoint

BLOCK = "_blk"
PART = "_part"
DEFAULT_WIDTH = 65536
#: Rows that one task may sort and scan where blocks are bounded in rows.
TARGET_ROWS = 1 << 20


@dataclass(frozen=True)
class Seq:
    """Rows of ``keys`` ordered by ``order`` (unique inside a key).

    ``width`` is the block width in units of the first order column (seconds for
    timestamps); pick it so that one block of one key fits comfortably in a task.  With ``rows`` blocks
    have at most about that many rows whatever the order column holds, and ``width`` is ignored.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float | None = DEFAULT_WIDTH
    rows: int | None = None

    @property
    def first(self) -> str:
        return self.order[0]

    def window(self, reverse: bool = False):
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return W.partitionBy(PART).orderBy(*cols)


def key_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null meets null: keys are compared as one struct, which is never null.

    The columns of ``left`` come first; ``how`` is inner, left, left_semi or left_anti.
    """
    packed = F.struct(*keys).alias("_on")
    rest = [c for c in right.columns if c not in keys]
    return left.select("*", packed).join(right.select(packed, *rest), "_on", how).drop("_on")


def in_block(df: DataFrame, keys) -> DataFrame:
    """Add the (keys, block) of a row as one struct; windows and joins use it, so that null keys and
    rows without a place (a block of their own, first in order) are treated as any others."""
    return df.withColumn(PART, F.struct(*keys, BLOCK))


def _position(df: DataFrame, seq: Seq) -> Column:
    if isinstance(df.schema[seq.first].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(seq.first).cast("timestamp")) / F.lit(1e6)
    return F.col(seq.first)


def settle(df: DataFrame, seq: Seq) -> tuple[DataFrame, Seq]:
    """Cut a frame whose blocks are bounded in rows: (frame with its blocks, sequence to go on with).

    Runs at once: a count and, for more rows than one block takes, a sort by sampled splitters of twice
    as many blocks as needed, which leaves room for the error of the sample.
    """
    if seq.rows is None or BLOCK in df.columns:
        return df, seq
    total = df.count()
    if total <= seq.rows:
        return df, replace(seq, rows=None, width=None)
    blocks = -(-2 * total // seq.rows)
    ranged = df.repartitionByRange(blocks, *seq.keys, *seq.order).withColumn(BLOCK, F.spark_partition_id().cast("long"))
    return durable_checkpoint(ranged), replace(seq, width=DEFAULT_WIDTH)


def with_block(df: DataFrame, seq: Seq) -> DataFrame:
    if seq.rows is not None:
        return in_block(df, seq.keys)
    if seq.width is None:
        return in_block(df.withColumn(BLOCK, F.lit(0).cast("long")), seq.keys)
    return in_block(df.withColumn(BLOCK, F.floor(_position(df, seq) / F.lit(seq.width)).cast("long")), seq.keys)


def _order_struct(seq: Seq) -> Column:
    return F.struct(*[F.col(c) for c in seq.order])


_COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "product": F.sum,
}


def _block_summary(seq: Seq, how: str, col: Column, reverse: bool) -> Column:
    if how == "count":
        return F.count(col)
    if how in ("sum", "max", "min"):
        return _COMBINE[how](col)
    if how == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(col, F.when(col.isNotNull(), _order_struct(seq)))
    raise ValueError(how)


def carry(df: DataFrame, seq: Seq, spec: Mapping[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """Per (keys, block): the aggregate over all rows in earlier (``reverse``: later) blocks.

    ``df`` carries the block column.  The scan over blocks sees one row per block.
    """
    blocks = df.groupBy(*seq.keys, BLOCK).agg(
        *[_block_summary(seq, how, col, reverse).alias(name) for name, (how, col) in spec.items()]
    )
    block_order = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    before = W.partitionBy(*seq.keys).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(
        *seq.keys, BLOCK, *[_COMBINE[how](F.col(name)).over(before).alias(name) for name, (how, _) in spec.items()]
    )


def running(
    df: DataFrame,
    seq: Seq,
    spec: Mapping[str, tuple[str, Column]],
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates ``{name: (sum|count|max|min|last, column)}`` along the sequence.

    ``last`` is the last non-null value so far (``reverse``: the next one); with
    ``inclusive=False`` the current row is left out.
    """
    df, seq = settle(df, seq)
    blocked = with_block(df, seq)
    frame = seq.window(reverse).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)

    def local_agg(how: str, col: Column) -> Column:
        return (F.count(col) if how == "count" else _COMBINE[how](col)).over(frame)

    local = blocked.select("*", *[local_agg(how, col).alias(f"_l_{n}") for n, (how, col) in spec.items()])
    if seq.width is None:
        out = {n: F.col(f"_l_{n}") for n in spec}
    else:
        before = carry(blocked, seq, {f"_c_{n}": v for n, v in spec.items()}, reverse)
        local = local.join(in_block(before, seq.keys).drop(*seq.keys, BLOCK), PART, "left")
        out = {}
        for n, (how, _) in spec.items():
            here, there = F.col(f"_l_{n}"), F.col(f"_c_{n}")
            if how == "count":
                out[n] = here + F.coalesce(there, F.lit(0))
            elif how == "sum":
                out[n] = F.when(here.isNull(), there).otherwise(here + F.coalesce(there, F.lit(0)))
            elif how == "max":
                out[n] = F.greatest(here, there)
            elif how == "min":
                out[n] = F.least(here, there)
            else:
                out[n] = F.coalesce(here, there)
    keep = [c for c in df.columns if c not in spec and c != BLOCK]
    return local.select(*keep, *[c.alias(n) for n, c in out.items()])


def number_rows(df: DataFrame, seq: Seq, name: str = "frame_no", start: int = 0) -> DataFrame:
    """Dense position inside the key, without sorting a whole key in one task."""
    return running(df, seq, {name: ("count", F.lit(1))}).withColumn(name, F.col(name) + F.lit(start - 1))


def neighbours(
    df: DataFrame,
    seq: Seq,
    prev: Mapping[str, Column | str] | None = None,
    nxt: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Values of the previous and of the next row; null at the ends of the key.

    Works on sparse order columns: values travel in a struct so that null values stay null.
    """

    def pack(cols):
        return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])

    sides = [(side, pack(cols), cols) for side, cols in (("p", prev), ("n", nxt)) if cols]
    df, seq = settle(df, seq)
    blocked = with_block(df, seq)
    order = seq.window()
    local = {s: (F.lag if s == "p" else F.lead)(packed, 1).over(order).alias(f"_{s}") for s, packed, _ in sides}
    out = blocked.select("*", *local.values())
    if seq.width is not None:
        edges = blocked.groupBy(*seq.keys, BLOCK).agg(
            *[(F.max_by if s == "p" else F.min_by)(packed, _order_struct(seq)).alias(f"_e{s}") for s, packed, _ in sides]
        )
        by_block = W.partitionBy(*seq.keys).orderBy(BLOCK)
        edges = edges.select(
            *seq.keys, BLOCK, *[(F.lag if s == "p" else F.lead)(f"_e{s}", 1).over(by_block).alias(f"_c{s}") for s, _, _ in sides]
        )
        out = out.join(in_block(edges, seq.keys).drop(*seq.keys, BLOCK), PART, "left")
        out = out.withColumns({f"_{s}": F.coalesce(f"_{s}", f"_c{s}") for s, _, _ in sides})
    new = {n: F.col(f"_{s}.{n}") for s, _, cols in sides for n in cols}
    return out.select(*[c for c in df.columns if c not in new and c != BLOCK], *[c.alias(n) for n, c in new.items()])


def surrounding(df: DataFrame, seq: Seq, value: Column, prev_name: str, next_name: str) -> DataFrame:
    """Last non-null value up to and including the row, and the next one after it."""
    df, seq = settle(df, seq)
    blocked = with_block(df.withColumn("_v", value), seq)
    order = seq.window()
    out = blocked.select(
        "*",
        F.last("_v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_p"),
        F.first("_v", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_n"),
    )
    if seq.width is not None:
        known = F.when(F.col("_v").isNotNull(), _order_struct(seq))
        edges = blocked.groupBy(*seq.keys, BLOCK).agg(
            F.max_by("_v", known).alias("_ep"), F.min_by("_v", known).alias("_en")
        )
        by_block = W.partitionBy(*seq.keys).orderBy(BLOCK)
        edges = edges.select(
            *seq.keys,
            BLOCK,
            F.last("_ep", ignorenulls=True).over(by_block.rowsBetween(W.unboundedPreceding, -1)).alias("_cp"),
            F.first("_en", ignorenulls=True).over(by_block.rowsBetween(1, W.unboundedFollowing)).alias("_cn"),
        )
        out = out.join(in_block(edges, seq.keys).drop(*seq.keys, BLOCK), PART, "left").withColumns(
            {"_p": F.coalesce("_p", "_cp"), "_n": F.coalesce("_n", "_cn")}
        )
    return out.select(*[c for c in df.columns if c != BLOCK], F.col("_p").alias(prev_name), F.col("_n").alias(next_name))


def adjacent(df: DataFrame, seq: Seq, cols: Mapping[str, Column | str], direction: int = -1) -> DataFrame:
    """One-sided :func:`neighbours`: previous (``-1``) or next (``+1``) row."""
    return neighbours(df, seq, cols, None) if direction < 0 else neighbours(df, seq, None, cols)


def halo(df: DataFrame, seq: Seq, before: int, after: int) -> DataFrame:
    """Rows plus the edge copies that neighbouring blocks need; ``_core`` marks the originals.

    The first order column must be a gap-free integer position and ``before`` and ``after``
    must not exceed the block width, so that only direct neighbours are involved.
    """
    if seq.width is None:
        return in_block(df.withColumn(BLOCK, F.lit(0).cast("long")), seq.keys).withColumn("_core", F.lit(True))
    width = int(seq.width)
    if max(before, after) > width:
        raise ValueError("frame reaches further than one block")
    pos = F.col(seq.first).cast("long")
    home = F.floor(pos / F.lit(width)).cast("long")
    offset = pos - home * width
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= width - before, home + 1) if before else F.lit(None).cast("long"),
            F.when(offset < after, home - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = df.select("*", F.explode(F.when(F.size(targets) > 0, targets).otherwise(F.array(F.lit(None).cast("long")))).alias(BLOCK), home.alias("_home"))
    return in_block(spread.select(*df.columns, BLOCK, F.col(BLOCK).eqNullSafe(F.col("_home")).alias("_core")), seq.keys)


def framed(
    df: DataFrame,
    seq: Seq,
    lo: int,
    hi: int,
    exprs: Callable[[W, W], Mapping[str, Column]],
) -> DataFrame:
    """Add columns computed over the row frame ``[lo, hi]`` of a dense sequence.

    ``exprs(frame, order)`` receives the frame window and the ordered window (for ``lag`` and
    ``lead`` no further than the frame) and returns ``{name: column}``.  One shuffle; the halo adds ``hi - lo`` rows
    per block.
    """
    spread = halo(df, seq, max(0, -lo), max(0, hi))
    order = seq.window()
    new = exprs(order.rowsBetween(lo, hi), order)
    keep = [c for c in df.columns if c not in new]
    return spread.select(*keep, "_core", *[c.alias(n) for n, c in new.items()]).where("_core").drop("_core")


_MERGE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.sum,
    "min": F.min,
    "max": F.max,
    "any": F.bool_or,
    "all": F.bool_and,
}


def segments(
    df: DataFrame,
    seq: Seq,
    starts: Column,
    aggs: Mapping[str, tuple[str, Column]],
    start_name: str = "seg_start",
) -> DataFrame:
    """Gaps and islands: aggregate each run that begins where ``starts`` is true.

    ``aggs`` is ``{name: (sum|count|min|max|any|all|first|last, column)}``.  Each block is first
    reduced to one row per local run; only those rows are kept (a reliable checkpoint) and stitched
    across block edges, so a long run or a hot key costs one partial row per block and the input is
    read once.
    """
    df, seq = settle(df, seq)
    blocked = with_block(df, seq).withColumn("_start", F.when(F.coalesce(starts, F.lit(False)), F.col(seq.first)))
    order = seq.window()
    local = blocked.withColumn(
        "_seg", F.last("_start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    )

    def partial(how: str, col: Column) -> Column:
        if how == "count":
            return F.count(col)
        if how in ("first", "last"):
            pick, by = (F.min_by, F.min) if how == "first" else (F.max_by, F.max)
            return F.struct(by(_order_struct(seq)).alias("o"), pick(F.struct(col.alias("v")), _order_struct(seq)).alias("v"))
        return _MERGE[how](col)

    pieces = local.groupBy(*seq.keys, BLOCK, "_seg").agg(
        F.min(_order_struct(seq)).alias("_o"), *[partial(h, c).alias(n) for n, (h, c) in aggs.items()]
    )
    if seq.width is None:
        stitched = pieces.withColumn(start_name, F.coalesce("_seg", F.col(f"_o.{seq.first}")))
    else:
        # The pieces are read twice below and by every later step; keep the long scan to one.
        pieces = durable_checkpoint(pieces)
        by_block = W.partitionBy(*seq.keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
        heads = pieces.groupBy(*seq.keys, BLOCK).agg(
            F.max("_seg").alias("_s"), F.min(F.col(f"_o.{seq.first}")).alias("_f")
        )
        heads = heads.select(
            *seq.keys, BLOCK, F.last("_s", ignorenulls=True).over(by_block).alias("_prev"), F.min("_f").over(by_block).alias("_first")
        )
        stitched = pieces.transform(key_join, heads, [*seq.keys, BLOCK], "left").withColumn(
            start_name, F.coalesce("_seg", "_prev", "_first", F.col(f"_o.{seq.first}"))
        )

    def final(how: str, name: str) -> Column:
        if how == "first":
            return F.min_by(F.col(f"{name}.v.v"), F.col(f"{name}.o"))
        if how == "last":
            return F.max_by(F.col(f"{name}.v.v"), F.col(f"{name}.o"))
        return _MERGE[how](F.col(name))

    return stitched.groupBy(*seq.keys, start_name).agg(*[final(h, n).alias(n) for n, (h, _) in aggs.items()])
