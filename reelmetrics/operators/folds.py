"""Order-dependent folds, split by block.

Some rules depend on earlier *decisions* (the last kept frame, the open scene, the last merged
box).  A block of a sequence is a function from the state it is entered with to the state it is
left with.  :func:`ordered_fold` finds the entry state of every block and then runs all blocks
once, each from its own entry:

* With ``tails`` the rule can start anew at some rows (a frame is kept, a scene opens).  Following
  the jumps from such a row to the next one gives the states in which a block can be left at all,
  usually one or two.  They are tried on the block that follows, and those that pass it unchanged
  on four times as many blocks each time, so that 64 blocks take at most seven passes.  One walk over
  the summaries of a key then tells every block its entry.
* Without ``tails`` each block first assumes that the sequence begins with it; exits are handed on,
  and blocks whose entry changed run again until nothing changes: as many rounds as the number of
  blocks that one decision reaches across.

Blocks are sorted into partitions and run one after another inside a task, so that a block of a few
rows costs a few microseconds.  A key of several blocks is found by a job that runs while the plan
is built; its rows are kept in a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import durable_checkpoint
from .sequence import BLOCK, PART, Seq, adjacent, key_join, number_rows, running, with_block

#: (columns of a block in order, entry state) -> (new columns, exit state)
Step = Callable[[list[list], Any], tuple[list[list], Any]]
#: Columns of a block -> the exit states of all starts inside it.
Tails = Callable[[list[list]], list]

HEAD = "_head"
OUT_ROWS = 8192


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows at which a new group of equal values begins, the first row included."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def by_group(df: DataFrame, names: list[str], order: list[str], fn: Callable[[dict[str, list]], list[list]], schema: str) -> DataFrame:
    """``fn(columns of a group, in order) -> output columns`` for every group of equal ``names``.

    Groups are hashed to partitions and sorted there; a task goes through them one by one and holds
    one group at a time.  Null values of ``names`` make a group like any other.
    """
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, names).tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if held and lo == 0:
                    if [part.column(n)[0].as_py() for n in names] == key:
                        held.append(part)
                        continue
                if held:
                    yield pa.Table.from_batches(held)
                held = [part]
            key = [held[0].column(n)[0].as_py() for n in names]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow.names]
        for group in groups(batches):
            for column, new in zip(out, fn({n: group.column(n).to_pylist() for n in group.column_names})):
                column.extend(new)
            if len(out[0]) >= OUT_ROWS:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)
                out = [[] for _ in arrow.names]
        if out[0]:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, fields)


def ordered_fold(
    df: DataFrame, seq: Seq, inputs: list[str], step: Step, outputs: str, state_type: str, keep: list[str] | None = None, tails: Tails | None = None
) -> DataFrame:
    """Run ``step`` along every key; returns the keys, the ``keep`` columns (the order columns if not
    given) and ``outputs`` (a DDL list).

    ``state_type`` is the DDL type of the state; a null state is that of the start of a key.  With
    ``tails`` a state that a block does not touch must leave it unchanged.
    """
    keys, order = list(seq.keys), list(seq.order)
    keep = order if keep is None else keep
    kind = lambda c: df.schema[c].dataType.simpleString()
    key_fields = "".join(f"`{k}` {kind(k)}, " for k in keys)
    out_schema = f"{key_fields}{''.join(f'`{c}` {kind(c)}, ' for c in keep)}{outputs}"
    needed = list(dict.fromkeys([*keys, *order, *keep, *inputs]))
    blocked = with_block(df.select(*needed), seq).drop(PART)
    group = [*keys, BLOCK]

    def pass_over(rows: DataFrame, heads: DataFrame | None, fn, schema: str, state: str = state_type) -> DataFrame:
        """``fn(columns, head state) -> columns``; ``heads`` has (keys, block, ``_head``) rows."""
        rows = rows.withColumn(HEAD, F.lit(None).cast(state)).withColumn("_row", F.lit(1))
        if heads is not None:
            rows = rows.unionByName(heads.select(*group, HEAD, F.lit(0).alias("_row")), allowMissingColumns=True)

        def run(cols: dict[str, list]) -> list[list]:
            head = None
            if cols["_row"][0] == 0:
                head = cols[HEAD][0]
                cols = {n: c[1:] for n, c in cols.items()}
            return fn(cols, head) if cols["_row"] else [[] for _ in fields]

        fields = T._parse_datatype_string(schema).names
        return by_group(rows, group, ["_row", *order], run, schema)

    def emit(cols, entry):
        return [*(cols[k] for k in keys), *(cols[c] for c in keep), *step([cols[c] for c in inputs], entry)[0]]

    if seq.width is None:
        return pass_over(blocked, None, emit, out_schema)
    several = blocked.groupBy(*group).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("_one").alias("_n")).where("_n > 1").drop("_n")
    if several.isEmpty():
        return pass_over(blocked, None, emit, out_schema)

    # Every pass reads the rows: keep them, so that what made them runs once.
    blocked = durable_checkpoint(blocked)
    long = blocked.transform(key_join, several, keys, "left_semi")
    find = _entries_by_tails if tails is not None else _entries_by_rounds
    return pass_over(blocked, find(long, keys, inputs, step, tails, state_type, key_fields, pass_over), emit, out_schema)


def _entries_by_rounds(long, keys, inputs, step, _tails, state_type, key_fields, pass_over) -> DataFrame:
    """(keys, block, _head): hand exits on until no entry changes."""
    group = [*keys, BLOCK]

    def leave(cols, entry):
        return [*([cols[k][0]] for k in group), [step([cols[c] for c in inputs], entry)[1]]]

    exit_schema = f"{key_fields}{BLOCK} bigint, _exit {state_type}"
    by_block = W.partitionBy(*keys).orderBy(F.col(BLOCK).asc_nulls_first())
    none = F.lit(None).cast(T._parse_datatype_string(state_type))
    table = durable_checkpoint(pass_over(long, None, leave, exit_schema).withColumn("_entry", none))
    while True:
        moved = table.withColumn("_new", F.lag("_exit", 1).over(by_block))
        changed = ~F.col("_new").eqNullSafe(F.col("_entry"))
        stale = moved.where(changed).select(*group, F.col("_new").alias(HEAD))
        if stale.isEmpty():
            return table.select(*group, F.col("_entry").alias(HEAD))
        again = long.transform(key_join, stale.select(*group), group, "left_semi")
        fresh = pass_over(again, stale, leave, exit_schema).withColumnRenamed("_exit", "_x")
        table = durable_checkpoint(
            moved.transform(key_join, fresh, group, "left").select(*group, F.when(changed, F.col("_x")).otherwise(F.col("_exit")).alias("_exit"), F.col("_new").alias("_entry"))
        )


def _entries_by_tails(long, keys, inputs, step, tails, state_type, key_fields, pass_over) -> DataFrame:
    """(keys, block, _head): jumps inside blocks, states tried on 1, 4, 16, ... blocks, one walk a key."""
    group, place = [*keys, BLOCK], [*keys, "_rank"]
    schema = f"{key_fields}{BLOCK} bigint, _fresh boolean, _entry {state_type}, _exit {state_type}"

    def candidates(cols, _head):
        args = [cols[c] for c in inputs]
        first = step(args, None)[1]
        more = [s for s in tails(args) if s is not None and s != first]
        n = 1 + len(more)
        return [*([cols[k][0]] * n for k in group), [True] + [False] * len(more), [None] * n, [first, *more]]

    def tried(cols, head):
        args, states = [cols[c] for c in inputs], [h["s"] for h in head]
        n = len(states)
        return [*([cols[k][0]] * n for k in group), [False] * n, states, [step(args, s)[1] for s in states]]

    made = durable_checkpoint(pass_over(long, None, candidates, schema))
    of_key = W.partitionBy(*keys)
    ranked = made.where("_fresh").select(*group, F.row_number().over(of_key.orderBy(F.col(BLOCK).asc_nulls_first())).alias("_rank"), F.count("*").over(of_key).alias("_blocks"))
    made = made.transform(key_join, ranked, group)
    known = made.where("_fresh").select(*place, BLOCK, "_entry", "_exit")
    left = made.where("_exit IS NOT NULL").select(*place, "_blocks", F.col("_exit").alias("_s")).distinct()
    front, ahead = left, 1
    while True:
        reach = F.least(F.col("_rank") + ahead, F.col("_blocks")).cast("int")
        asked = front.where("_rank < _blocks").select(*keys, "_s", "_blocks", F.col("_rank").alias("_from"), F.explode(F.sequence(F.col("_rank") + 1, reach)).alias("_rank"))
        asked = asked.transform(key_join, ranked.select(*place, BLOCK), place)
        heads = asked.groupBy(*group).agg(F.collect_set(F.struct(F.col("_s").alias("s"))).alias(HEAD))
        if heads.isEmpty():
            break
        rows = long.transform(key_join, heads.select(*group), group, "left_semi")
        new = pass_over(rows, heads, tried, schema, f"array<struct<s:{state_type}>>")
        new = durable_checkpoint(new.transform(key_join, ranked.select(*place, BLOCK), group).select(*place, BLOCK, "_entry", "_exit"))
        known = known.unionByName(new)
        # A state that passed every block it was tried on goes on from the last of them, unless that
        # block can be left with it anyway: then it has been tried from there.
        passed = asked.transform(key_join, new.select(*place, F.col("_entry").alias("_s"), "_exit"), [*place, "_s"])
        whole = passed.groupBy(*keys, "_s", "_blocks", "_from").agg(F.bool_and(F.col("_exit").eqNullSafe(F.col("_s"))).alias("_ok"), F.max("_rank").alias("_rank"))
        front = whole.where("_ok").select(*place, "_blocks", "_s").transform(key_join, left.select(*place, "_s"), [*place, "_s"], "left_anti")
        ahead *= 4

    def walk(cols: dict[str, list]) -> list[list]:
        steps: dict[int, dict] = {}
        block_of: dict[int, Any] = {}
        for rank, block, entry, left in zip(cols["_rank"], cols[BLOCK], cols["_entry"], cols["_exit"]):
            steps.setdefault(rank, {})[_frozen(entry)] = left
            block_of[rank] = block
        entries, state = [], None
        for rank in sorted(steps):
            entries.append(state)
            state = steps[rank][_frozen(state)]
        n = len(entries)
        return [*([cols[k][0]] * n for k in keys), [block_of[r] for r in sorted(steps)], entries]

    return by_group(known, keys, ["_rank"], walk, f"{key_fields}{BLOCK} bigint, {HEAD} {state_type}")


def _frozen(state: Any) -> Any:
    return tuple(state) if isinstance(state, list) else state


def _alike(words: list | None, other: list | None, threshold: float) -> bool:
    """Whether two hashes are equal or have at least ``threshold`` of their bits in common."""
    if words == other or words is None or other is None or not words:
        return words == other
    apart = sum(((a ^ b) & _MASK).bit_count() for a, b in zip(words, other))
    return 1.0 - apart / (64 * len(other)) >= threshold


_MASK = (1 << 64) - 1


def _next_kept(hashes: list[list | None], threshold: float) -> list[int]:
    """For each frame the first later one that is not like it (the number of frames if there is none)."""
    n = len(hashes)
    sizes = {None if h is None else len(h) for h in hashes}
    if len(sizes) > 1 or None in sizes or 0 in sizes:
        return [next((j for j in range(i + 1, n) if not _alike(hashes[i], hashes[j], threshold)), n) for i in range(n)]
    words = np.array(hashes, dtype=np.int64).view(np.uint64)
    out, open_, gap, bits = np.full(n, n), np.arange(n - 1), 1, 64 * words.shape[1]
    while len(open_):
        apart = np.bitwise_count(words[open_] ^ words[open_ + gap]).sum(axis=1, dtype=np.int64)
        far = (apart > 0) & ~(1.0 - apart / bits >= threshold)
        out[open_[far]] = open_[far] + gap
        gap += 1
        open_ = open_[~far]
        open_ = open_[open_ + gap < n]
    return out.tolist()


def anchored_dedup(df: DataFrame, seq: Seq, words: str, threshold: float = 0.98) -> DataFrame:
    """Compare each frame with the last *kept* frame; similar enough means duplicate.

    ``words`` is an ARRAY<BIGINT> perceptual hash; a null hash is like another null hash only.  Adds
    ``unique_frame`` (the kept frame this one maps to; itself when kept) and ``is_duplicate``.
    """
    pos = seq.first

    def step(cols, anchor):
        kept, begun = [], anchor is not None
        for cur in cols[0]:
            new = not begun or not _alike(anchor, cur, threshold)
            if new:
                anchor, begun = cur, True
            kept.append(new)
        return [kept], anchor

    def tails(cols):
        # From a kept frame the next one is known; the last one of the block is what it is left with.
        nxt = _next_kept(cols[0], threshold)
        last = list(range(len(nxt)))
        for i in reversed(last):
            if nxt[i] < len(nxt):
                last[i] = last[nxt[i]]
        return [cols[0][i] for i in sorted(set(last))]

    marked = ordered_fold(df, seq, [words], step, "_kept boolean", "array<bigint>", [pos], tails)
    out = running(marked, seq, {"unique_frame": ("last", F.when(F.col("_kept"), F.col(pos)))}).drop("_kept")
    return out.withColumn("is_duplicate", F.col("unique_frame") != F.col(pos))


def exact_dedup(df: DataFrame, seq: Seq, content: str) -> DataFrame:
    """W1 with exact hashes: a frame is kept when it differs from the one before it."""
    marked = adjacent(df, seq, {"_p": content}, -1)
    kept = F.when(F.col("_p").isNull() | (F.col("_p") != F.col(content)), F.col(seq.first))
    out = running(marked, seq, {"unique_frame": ("last", kept)}).drop("_p")
    return out.withColumn("is_duplicate", F.col("unique_frame") != F.col(seq.first))


def merge_short_scenes(scenes: DataFrame, keys: tuple[str, ...], min_length: int = 15, width: float | None = 65536) -> DataFrame:
    """Grow a scene over the following ones while it is too short; a short tail joins its predecessor."""
    seq = Seq(keys, ("start_frame",), width)
    names = list(keys)

    def step(cols, open_start):
        heads = []
        for start, end in zip(*cols):
            if open_start is None:
                open_start = start
            heads.append(open_start)
            if end - open_start + 1 >= min_length:
                open_start = None
        return [heads], open_start

    def tails(cols):
        # A scene that opens at i is long enough at the first end that is far enough; the next one opens then.
        starts, ends = cols
        n, reach = len(starts), np.maximum.accumulate(np.array(ends, dtype=np.int64))
        closes = np.maximum(np.searchsorted(reach, np.array(starts, dtype=np.int64) + min_length - 1), np.arange(n)).tolist()
        left: list = [None] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = closes[i]
            while j < n and ends[j] - starts[i] + 1 < min_length:
                j += 1
            left[i] = starts[i] if j >= n else left[j + 1]
        return sorted({s for s in left if s is not None})

    labelled = ordered_fold(scenes, seq, ["start_frame", "end_frame"], step, "_head bigint", "bigint", tails=tails)
    merged = (
        scenes.join(labelled, [*names, "start_frame"])
        .groupBy(*names, F.col("_head"))
        .agg(
            F.max("end_frame").alias("end_frame"),
            F.min_by("transition_in", "start_frame").alias("transition_in"),
            F.max_by("transition_out", "start_frame").alias("transition_out"),
        )
        .withColumnRenamed("_head", "start_frame")
    )
    # Only the last scene of a key can still be short.
    merged = adjacent(merged, seq, {"_prev": "start_frame"}, -1)
    short = F.col("end_frame") - F.col("start_frame") + 1 < min_length
    owner = F.when(short & F.col("_prev").isNotNull(), F.col("_prev")).otherwise(F.col("start_frame"))
    return (
        merged.withColumn("_owner", owner)
        .groupBy(*names, "_owner")
        .agg(
            F.max("end_frame").alias("end_frame"),
            F.min_by("transition_in", "start_frame").alias("transition_in"),
            F.max_by("transition_out", "start_frame").alias("transition_out"),
        )
        .select(
            *names,
            F.col("_owner").alias("start_frame"),
            "end_frame",
            (F.col("end_frame") - F.col("_owner") + 1).alias("duration_frames"),
            "transition_in",
            "transition_out",
        )
    )


#: Rows of a stretch, and stretches that are combined into one, in :func:`moving_ema`.
STRETCH = 256


def moving_ema(df: DataFrame, seq: Seq, value: str, alpha: float = 0.1, name: str = "ema", stretch: int = STRETCH) -> DataFrame:
    """Exponential moving average that starts over while the average is exactly zero.

    A stretch of rows acts on the average ``a`` it is entered with as an affine map with a reset mark:
    ``keep * a + add``, but ``anew`` if ``a`` is zero.  Two such maps in a row are one, so the entries of
    all stretches come from a prefix scan over one row a stretch, level by level, without a fold along
    the key and without Python.  Inside a stretch the rows are taken in order.

    Where a key has several stretches and an average in a later row is zero but for rounding (values
    that cancel out), the last bit decides about the restart; such keys are folded in order.  A null
    counts as not a number, as does every average after it.
    """
    keys, order = list(seq.keys), list(seq.order)
    base = df.select(*keys, *order, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("_x"))
    rows = number_rows(base, seq, "_n").withColumn("_p", F.expr(f"_n div {stretch}"))
    row = F.struct("_n", *order, "_x")
    pieces = rows.groupBy(*keys, "_p").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    long = rows.groupBy(*keys).agg(F.max("_p").alias("_p")).where("_p > 0")
    several = not long.isEmpty()
    zero = F.lit(0.0)

    def after(avg: Column, x: Column) -> Column:
        return F.when(avg == 0, x).otherwise(alpha * x + (1 - alpha) * avg)

    entry = zero
    if several:
        pieces = durable_checkpoint(pieces)
        maps = pieces.select(
            *keys,
            "_p",
            F.pow(F.lit(1 - alpha), F.size("_rows")).alias("_keep"),
            F.aggregate("_rows", zero, lambda a, r: alpha * r["_x"] + (1 - alpha) * a).alias("_add"),
            F.aggregate("_rows", zero, lambda a, r: after(a, r["_x"])).alias("_anew"),
        )
        pieces = pieces.transform(key_join, _entries_of_maps(maps, keys, stretch), [*keys, "_p"])
        entry = F.col("_a")
    start = F.struct(entry.alias("a"), F.array().cast("array<double>").alias("out"))

    def grow(acc: Column, r: Column) -> Column:
        new = after(acc["a"], r["_x"])
        return F.struct(new.alias("a"), F.concat(acc["out"], F.array(new)).alias("out"))

    run = pieces.withColumn("_out", F.aggregate("_rows", start, grow, lambda acc: acc["out"]))

    def told(rows: DataFrame) -> DataFrame:
        flat = rows.select(*keys, F.explode(F.arrays_zip("_rows", "_out")).alias("_z"))
        return flat.select(*keys, *(F.col(f"_z._rows.{c}").alias(c) for c in order), F.col("_z._out").alias(name))

    if not several:
        return told(run)
    run = durable_checkpoint(run)
    begun = F.transform(F.filter("_rows", lambda r: r["_x"] != 0), lambda r: r["_n"])
    first = run.groupBy(*keys).agg(F.min(F.array_min(begun)).alias("_first"), F.max(F.array_max(F.transform("_rows", lambda r: F.abs(r["_x"])))).alias("_most"))
    marked = run.transform(key_join, first.transform(key_join, long.select(*keys), keys, "left_semi"), keys)
    tiny = F.exists(F.arrays_zip("_rows", "_out"), lambda z: (z["_rows"]["_n"] >= F.col("_first")) & (F.abs(z["_out"]) <= F.col("_most") * 1e-12) & (z["_rows"]["_x"] != 0))
    doubtful = durable_checkpoint(marked.where(tiny).select(*keys).distinct())
    if doubtful.isEmpty():
        return told(run)

    def step(cols, avg):
        avg, out = avg or 0.0, []
        for x in cols[0]:
            avg = x if avg == 0 else alpha * x + (1 - alpha) * avg
            out.append(avg)
        return [out], avg

    folded = ordered_fold(base.transform(key_join, doubtful, keys, "left_semi"), seq, ["_x"], step, f"`{name}` double", "double")
    return told(run.transform(key_join, doubtful, keys, "left_anti")).unionByName(folded)


def _entries_of_maps(maps: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """(keys, _p, _a): what the maps (keep, add, anew) before ``_p`` make of zero, by a prefix scan:
    up to ``stretch`` maps of a key are taken in order, more are first combined group by group."""
    group = F.expr(f"_p div {stretch}")
    groups = maps.withColumn("_g", group).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("_p", "_keep", "_add", "_anew"))).alias("_maps"))
    groups = durable_checkpoint(groups)

    def apply(a: Column, m: Column) -> Column:
        return F.when(a == 0, m["_anew"]).otherwise(m["_keep"] * a + m["_add"])

    entry = F.lit(0.0)
    if not groups.where("_g > 0").isEmpty():
        whole = groups.select(
            *keys,
            F.col("_g").alias("_p"),
            F.aggregate("_maps", F.lit(1.0), lambda a, m: a * m["_keep"]).alias("_keep"),
            F.aggregate("_maps", F.lit(0.0), lambda a, m: m["_keep"] * a + m["_add"]).alias("_add"),
            F.aggregate("_maps", F.lit(0.0), apply).alias("_anew"),
        )
        above = _entries_of_maps(whole, keys, stretch).withColumnRenamed("_p", "_g")
        groups = groups.transform(key_join, above, [*keys, "_g"])
        entry = F.col("_a")
    start = F.struct(entry.alias("a"), F.array().cast("array<double>").alias("out"))
    ahead = F.aggregate("_maps", start, lambda acc, m: F.struct(apply(acc["a"], m).alias("a"), F.concat(acc["out"], F.array(acc["a"])).alias("out")), lambda acc: acc["out"])
    flat = groups.select(*keys, "_maps", ahead.alias("_in")).select(*keys, F.explode(F.arrays_zip("_maps", "_in")).alias("_z"))
    return flat.select(*keys, F.col("_z._maps._p").alias("_p"), F.col("_z._in").alias("_a"))


def merge_boxes(df: DataFrame, seq: Seq, overlap: float = 0.3) -> DataFrame:
    """W9 (2-D): merge a box into the last merged one when they overlap by more than ``overlap``.

    Boxes ``x, y, w, h`` come in ``seq`` order (top to bottom).  Output: one row per merged box.  A box
    grows with every box it takes in, so entries are found in rounds: two, unless a merged box reaches
    across several blocks.
    """
    keys = list(seq.keys)

    def step(cols, state):
        last = state
        out: list[list] = [[], [], [], []]
        fresh = []
        for cur in zip(*map(lambda c: map(float, c), cols)):
            x, y, w, h = cur
            joins = False
            if last is not None:
                dx = max(0.0, min(last[0] + last[2], x + w) - max(last[0], x))
                dy = max(0.0, min(last[1] + last[3], y + h) - max(last[1], y))
                smaller = min(last[2] * last[3], w * h)
                if smaller > 0 and dx * dy / smaller > overlap:
                    left, top = min(last[0], x), min(last[1], y)
                    cur = (left, top, max(last[0] + last[2], x + w) - left, max(last[1] + last[3], y + h) - top)
                    joins = True
            last = cur
            for column, value in zip(out, cur):
                column.append(value)
            fresh.append(not joins)
        return [*out, fresh], list(last)

    grown = ordered_fold(df, seq, ["x", "y", "w", "h"], step, "bx double, by double, bw double, bh double, _fresh boolean", "array<double>")
    grown = running(grown, seq, {"_no": ("sum", F.col("_fresh").cast("long"))}).withColumn("box_no", F.col("_no") - 1)
    # A merged box only grows, so its final extent is the extreme of its steps.
    right, bottom = F.max(F.col("bx") + F.col("bw")), F.max(F.col("by") + F.col("bh"))
    return grown.groupBy(*keys, "box_no").agg(
        F.min("bx").alias("x"), F.min("by").alias("y"), (right - F.min("bx")).alias("w"), (bottom - F.min("by")).alias("h"),
        F.count(F.lit(1)).alias("n_boxes"),
    )
