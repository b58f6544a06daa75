"""Structured Streaming operators (family ST).

Windowed and filter operators take any DataFrame, batch or streaming.  Decisions that depend on
earlier decisions (rate limits, running averages, failure counts) are written once as a step
``(rows in order, state) -> (rows, state)`` and used both by :func:`stateful` on streams and by
``ordered_fold`` on tables.  With a ``delay`` rows wait in the state for the watermark, so that the two
agree on input that arrives in any order, over any number of micro-batches.

Event time and late data: the default watermark is ten minutes; later rows are dropped by the
windowed aggregates and by the steps that wait.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_fold
from ..operators.joins import route_events
from ..operators.sequence import Seq, adjacent, framed, key_join, running, segments
from ..session import shared_folder
from ..sources.keyed import KeyedTable, merge_history

C, L = F.col, F.lit
WATERMARK = "10 minutes"


# --- running a stream to completion ------------------------------------------------------------
def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything available into a parquet sink and return the written table."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    with rocksdb_state(spark):
        query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# --- stateful steps ----------------------------------------------------------------------------
#: (input columns of rows in order, state or None) -> (output columns, state or None to forget the key)
Step = Callable[[list[list], Any], tuple[list[list], Any]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


#: Keys are dealt by hash over so many groups of the state store; calls to the state go by group and slot.
KEY_GROUPS = 256


class OrderedSteps(StatefulProcessor):
    """Runs a step over the rows of each key of a group of keys, in their order.

    State of a group: ``waiting`` rows by (slot, part), ``parts`` of each slot, and by key (``g``) the step's own
    ``state`` with the time until which it is kept.  A slot is a stretch of ``slot`` seconds.  Rows arrive piece by
    piece and are filed under their slots, so a batch is never held whole, but one slot of a group is.  With ``held``
    a slot runs when a timer says that the watermark has passed its end: rows may come in any order and in any
    micro-batch before that.  Otherwise all slots run at the end of the micro-batch.  The state of a key ends when
    the step returns none, or ``idle`` seconds after its last row.
    """

    def __init__(self, names, told, keys, order, inputs, keep, outputs, step, held, slot, idle):
        self.names, self.told = names, told
        self.keys, self.order, self.inputs, self.keep, self.outputs, self.step = keys, order, inputs, keep, outputs, step
        self.held, self.slot, self.idle = held, slot, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, part int", "data binary")
        self.parts = handle.getMapState("parts", "slot bigint", "n int")
        self.state = handle.getMapState("state", "g string", "s array<double>, until bigint")

    def _run(self, rows: pd.DataFrame, last_ms: int | None) -> pd.DataFrame:
        rows = rows.sort_values(["_ms", *self.order], kind="stable", ignore_index=True)
        codes, found = pd.factorize(rows["_g"])
        rows = rows.iloc[np.argsort(codes, kind="stable")].reset_index(drop=True)
        ends = np.cumsum(np.bincount(codes)).tolist()
        inputs, ms = [rows[c].tolist() for c in self.inputs], rows["_ms"].tolist()
        until = 0 if self.idle is None else last_ms + int(self.idle * 1000)
        if self.idle is not None and self.held:
            # Ends of state lie one millisecond off the ends of slots.
            until = -(-until // self._slot_ms()) * self._slot_ms() + 1
        told, kept = [[] for _ in self.outputs], False
        for g, first, end in zip(found, [0, *ends], ends):
            old = before = self.state.getValue((g,))
            if self.held and self.idle is not None and old is not None and old[1] <= ms[first]:
                old = None
            new, after = self.step([c[first:end] for c in inputs], None if old is None else list(old[0]))
            for out, values in zip(told, new):
                out.extend(values)
            if after is not None:
                last = until if old is None else max(until, old[1])
                self.state.updateValue((g,), ([float(x) for x in after], last))
                kept = True
            elif before is not None:
                self.state.removeKey((g,))
        if self.idle is not None and kept:
            self.handle.registerTimer(until)
        return pd.concat([rows[[*self.keys, *self.keep]].set_axis(self.told, axis=1), pd.DataFrame(dict(zip(self.outputs, told)))], axis=1)

    def _forget(self, now: int) -> None:
        """End the states that are kept no longer."""
        for g in [g for (g,), (_, until) in self.state.iterator() if until <= now]:
            self.state.removeKey((g,))

    def _slot_ms(self) -> int:
        return max(2, int(self.slot * 1000))

    def _file(self, rows: pd.DataFrame) -> set[int]:
        slots = (rows["_ms"] // self._slot_ms()).to_numpy()
        found = np.unique(slots)
        for slot in found.tolist():
            parts = self.parts.getValue((slot,))
            n = 0 if parts is None else parts[0]
            self.waiting.updateValue((slot, n), (_packed(rows[slots == slot]),))
            self.parts.updateValue((slot,), (n + 1,))
            if self.held:
                self.handle.registerTimer((slot + 1) * self._slot_ms())
        return set(found.tolist())

    def _take(self, slot: int) -> pd.DataFrame | None:
        if not self.parts.containsKey((slot,)):
            return None
        rows = []
        for part in range(self.parts.getValue((slot,))[0]):
            rows.append(_unpacked(self.waiting.getValue((slot, part))[0]))
            self.waiting.removeKey((slot, part))
        self.parts.removeKey((slot,))
        return pd.concat(rows, ignore_index=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, slots = None, set()
        for piece in rows:
            piece = piece.set_axis(self.names, axis=1)
            if first is None and not slots and not self.held:
                first = piece  # a group with one piece needs no filing
                continue
            if first is not None:
                slots |= self._file(first)
                first = None
            slots |= self._file(piece)
        if self.held:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle is not None else None
        if first is not None:
            yield self._run(first, now)
        for slot in sorted(slots):
            yield self._run(self._take(slot), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.held and at % self._slot_ms() == 0:
            rows = self._take(at // self._slot_ms() - 1)
            if rows is not None:
                yield self._run(rows, at)
            # A timer that is set now runs in the next batch, which may be long in coming.
            now = timerValues.getCurrentWatermarkInMs()
            if self.idle is not None and not any((slot + 1) * self._slot_ms() <= now for (slot,) in self.parts.keys()):
                self._forget(now)
        else:
            self._forget(at)

    def close(self) -> None:
        pass


def stateful(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    inputs: list[str],
    step: Step,
    outputs: str,
    keep: list[str],
    delay: str | None = None,
    event_time: str | None = None,
    slot_s: float = 60.0,
    idle_s: float | None = None,
) -> DataFrame:
    """Apply a step per key, in the order of ``order``; returns keys, ``keep`` and ``outputs`` (DDL).

    With ``delay``, the watermark on ``event_time`` (the first order column if it is a timestamp), rows
    wait until the watermark has passed the slot of ``slot_s`` seconds they fall in; then the order
    holds across micro-batches and files, and rows later than the watermark are dropped.  Rows without
    a value in an order column only move the watermark.  Rows of the newest ``delay`` stay in the state
    until later rows come.  Without ``delay`` rows are ordered inside a micro-batch and leave with it.

    ``order`` must not contradict the time.  ``idle_s`` ends a key's state that many seconds after its last row: of event time with ``delay``
    (rounded up to a slot), else of processing time.  A key that comes back starts anew.

    The state store groups keys by hash (``KEY_GROUPS``), so that its calls and Python's grow with groups and slots;
    a checkpoint of another number of groups cannot be gone on from.
    """
    time_col = event_time or order[0]
    kind = lambda c: stream.schema[c].dataType.simpleString()
    outs = [f.name for f in T._parse_datatype_string(outputs)]
    needed = list(dict.fromkeys([*([time_col] if delay else []), *order, *keep, *inputs]))
    timed = isinstance(stream.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType))
    ms = F.unix_millis(C(time_col).cast("timestamp")) if timed else F.floor(C(time_col) * 1000).cast("long")
    # Columns travel under plain names: pandas renames those that begin with an underscore.  Keys travel as
    # text and are told apart as one value, so that nulls among them make a key like others.
    plain = {c: f"c{k}" for k, c in enumerate(needed)}
    texts = [C(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)]
    key = F.to_json(F.struct(*texts))
    rows = stream.select(F.pmod(F.xxhash64(key), L(KEY_GROUPS)).alias("b"), key.alias("g"), *texts, *(C(c).alias(n) for c, n in plain.items()), ms.alias("ms"))
    if delay:
        known = L(True)
        for c in order:
            known = known & C(plain[c]).isNotNull()
        # The condition names the time, else it would be moved below the watermark.
        time = plain[time_col]
        rows = rows.withWatermark(time, delay).where(C(time).isNotNull() & (known | C(time).isNull()))
    packed = [f"k{n}" for n in range(len(keys))]
    told = [*packed, *(f"c{n}" for n in range(len(keep)))]
    processor = OrderedSteps(["_b", "_g", *packed, *needed, "_ms"], told, packed, order, inputs, keep, outs, step, delay is not None, slot_s, idle_s)
    mode = "EventTime" if delay else "None" if idle_s is None else "ProcessingTime"
    schema = ", ".join([*(f"{k} string" for k in packed), *(f"c{n} {kind(c)}" for n, c in enumerate(keep)), outputs])
    done = rows.groupBy("b").transformWithStateInPandas(processor, T._parse_datatype_string(schema), "Append", mode)
    return done.select(*(C(n).cast(stream.schema[k].dataType).alias(k) for n, k in zip(packed, keys)), *(C(f"c{n}").alias(c) for n, c in enumerate(keep)), *outs)


def limiter_step(per_window: int = 60, window_s: float = 60.0, gap_s: float = 10.0) -> Step:
    """ST4 + ST5: send unless the endpoint already got ``per_window`` sends in the last ``window_s``
    seconds, and progress events at most every ``gap_s`` seconds.

    Times are seconds.  State: last progress time, then the send times still inside the window.
    """

    def step(cols, state):
        last_progress = state[0] if state is not None else float("-inf")
        sent = deque(state[1:] if state is not None else ())
        verdicts = []
        for now, is_progress in zip(*cols):
            now = float(now)
            while sent and sent[0] <= now - window_s:
                sent.popleft()
            if len(sent) >= per_window:
                verdicts.append("rate_limited")
            elif is_progress and now - last_progress < gap_s:
                verdicts.append("throttled")
            else:
                verdicts.append("sent")
                sent.append(now)
                if is_progress:
                    last_progress = now
        return [verdicts], [last_progress, *sent]

    return step


def limit_stream(
    stream: DataFrame, keys: list[str], event_id: str, second: str, progress: str, delay: str | None = None, event_time: str | None = None, slot_s: float = 60.0,
    idle_s: float | None = None, **limits,
) -> DataFrame:
    """ST4 / ST5 on a stream.  An ``idle_s`` of at least the window and the gap changes no verdict."""
    return stateful(stream, keys, [second, event_id], [second, progress], limiter_step(**limits), "verdict string", [event_id], delay, event_time, slot_s, idle_s)


def limit_table(df: DataFrame, keys: list[str], event_id: str, second: str, progress: str, width: float | None = 86400, **limits) -> DataFrame:
    """Batch twin of :func:`limit_stream`."""
    return ordered_fold(df, Seq(tuple(keys), (second, event_id), width), [second, progress], limiter_step(**limits), "verdict string", "array<double>", [event_id])


def ema_step(alpha: float) -> Step:
    """ST9: moving average that starts over while it is exactly zero."""

    def step(cols, state):
        avg, out = (state[0] if state is not None else 0.0), []
        for x in cols[0]:
            x = float("nan") if x is None else float(x)
            avg = x if avg == 0 else alpha * x + (1 - alpha) * avg
            out.append(avg)
        return [out], [avg]

    return step


def ema_stream(
    stream: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.1, delay: str | None = None, event_time: str | None = None, slot_s: float = 60.0,
    idle_s: float | None = None,
) -> DataFrame:
    """ST9 on a stream; the batch twin is ``folds.moving_ema``."""
    return stateful(stream, keys, order, [value], ema_step(alpha), "ema double", order, delay, event_time, slot_s, idle_s)


def failure_step(limit: int) -> Step:
    """ST11: consecutive failures per job; more than ``limit`` in a row abort, a success resets (and ends
    the state)."""

    def step(cols, state):
        count, counts = (int(state[0]) if state is not None else 0), []
        for bad in cols[0]:
            count = count + 1 if bad else 0
            counts.append(count)
        return [counts, [c > limit for c in counts]], [count] if count else None

    return step


def failure_stream(
    stream: DataFrame, keys: list[str], order: list[str], event_id: str, failed: str, limit: int = 5, delay: str | None = None, event_time: str | None = None,
    slot_s: float = 60.0, idle_s: float | None = None,
) -> DataFrame:
    """ST11 on a stream."""
    return stateful(stream, keys, order, [failed], failure_step(limit), "consecutive_failures int, aborted boolean", [event_id], delay, event_time, slot_s, idle_s)


PROGRESS_FIELDS = (
    "frames_completed bigint, frames_failed bigint, frames_pending bigint, avg_time_ms double, eta_seconds double, avg_psnr double, avg_ssim double"
)


def progress_step(window: int = 100, any_time: bool = False) -> Step:
    """ST6: progress after every frame result (``state, time_ms, psnr, ssim, total_frames``).

    The mean time covers the last ``window`` positive times (with ``any_time`` all that are not null, where
    0 is a measured time); quality means skip nulls in the last ``window`` results that have any.  State: completed, failed, number of times, times, quality pairs.
    """
    nan = float("nan")

    def known(v):
        return nan if v is None or v != v else float(v)

    def mean(xs):
        xs = [x for x in xs if x == x]
        return sum(xs) / len(xs) if xs else None

    def step(cols, state):
        s = state if state is not None else [0.0, 0.0, 0.0]
        done, failed, n = int(s[0]), int(s[1]), int(s[2])
        times, pairs = deque(s[3 : 3 + n], window), deque(zip(s[3 + n :: 2], s[4 + n :: 2]), window)
        out = []
        for status, ms, p, q, total in zip(*cols):
            ms, p, q = known(ms), known(p), known(q)
            if ms > 0 or (any_time and ms == ms):
                times.append(ms)
            if p == p or q == q:
                pairs.append((p, q))
            done += status == "completed"
            failed += status == "failed"
            avg, left = mean(times), int(total) - done
            eta = left * avg / 1000 if avg is not None and left > 0 else None
            out.append((done, failed, left - failed, avg, eta, mean(p for p, _ in pairs), mean(q for _, q in pairs)))
        return [list(c) for c in zip(*out)], [float(done), float(failed), float(len(times)), *times, *(x for pair in pairs for x in pair)]

    return step


def progress_stream(
    stream: DataFrame, keys: list[str], order: list[str], window: int = 100, idle_ms: int | None = None, delay: str | None = None, event_time: str | None = None,
    slot_s: float = 60.0, any_time: bool = False,
) -> DataFrame:
    """ST6 on a stream."""
    idle_s = None if idle_ms is None else idle_ms / 1000
    inputs = ["state", "time_ms", "psnr", "ssim", "total_frames"]
    return stateful(stream, keys, order, inputs, progress_step(window, any_time), PROGRESS_FIELDS, ["frame_no"], delay, event_time, slot_s, idle_s)


def progress_table(df: DataFrame, keys: list[str], order: list[str], window: int = 100, width: float | None = 65536, any_time: bool = False) -> DataFrame:
    """Batch twin of :func:`progress_stream`, as running counts and row frames instead of a fold.

    Times and quality pairs have their own numbering, because results without them do not enter
    the last ``window``; the means are joined back on that number.
    """
    timed = C("time_ms").isNotNull() & ~F.isnan("time_ms") if any_time else C("time_ms") > 0
    rated = C("psnr").isNotNull() | C("ssim").isNotNull()
    base = running(
        df.select(*keys, *dict.fromkeys([*order, "frame_no", "state", "time_ms", "psnr", "ssim", "total_frames"])),
        Seq(tuple(keys), tuple(order), width),
        {
            "frames_completed": ("count", F.when(C("state") == "completed", 1)),
            "frames_failed": ("count", F.when(C("state") == "failed", 1)),
            "_nt": ("count", F.when(timed, 1)),
            "_nq": ("count", F.when(rated, 1)),
        },
    )

    def last_means(cond: Column, number: str, cols: dict[str, str]) -> DataFrame:
        rows = base.where(cond).select(*keys, number, *cols.values())
        out = framed(rows, Seq(tuple(keys), (number,)), -(window - 1), 0, lambda frame, _o: {n: F.avg(c).over(frame) for n, c in cols.items()})
        return out.select(*keys, number, *cols)

    out = key_join(base, last_means(timed, "_nt", {"avg_time_ms": "time_ms"}), [*keys, "_nt"], "left")
    out = key_join(out, last_means(rated, "_nq", {"avg_psnr": "psnr", "avg_ssim": "ssim"}), [*keys, "_nq"], "left")
    left = C("total_frames") - C("frames_completed")
    return out.select(
        *keys,
        "frame_no",
        "frames_completed",
        "frames_failed",
        (left - C("frames_failed")).alias("frames_pending"),
        "avg_time_ms",
        F.when(left > 0, left * C("avg_time_ms") / 1000).alias("eta_seconds"),
        "avg_psnr",
        "avg_ssim",
    )


def start_snapshots(progress: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds"):
    """ST7: write progress rows every few seconds, or all there is now (``every=None``); keep a bounded
    history with ``newest_n`` on the sink, or use :func:`snapshot_stream`."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = progress.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with rocksdb_state(progress.sparkSession):
        return writer.outputMode("append").trigger(**trigger).start()


def with_table(stream: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of a stateful stream with the columns of a table. They are merged whatever Spark takes their size to be:
    a micro-batch without new rows counts as empty, and what its timers let out would be broadcast."""
    return stream.hint("merge").join(table, on)


def snapshot_stream(progress: DataFrame, table: KeyedTable, order: list[str], history: int, checkpoint: str, every: str | None = "5 seconds", mode: str = "append"):
    """ST7: every few seconds, or for all there is now (``every=None``), merge the new progress rows into
    ``table``: the current row of each key is replaced, at most ``history`` older ones are kept.  A batch
    that runs again leaves the table as it is.  ``mode`` is ``update`` for aggregates that change."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def merge(rows: DataFrame, _batch: int) -> None:
        # A stream runs in a session of its own.
        own = KeyedTable(rows.sparkSession, table.name, table.keys, table.parts, table.buckets)
        merge_history(own, rows, order, history)

    with rocksdb_state(progress.sparkSession):
        return progress.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**trigger).start()


def fan_out(stream: DataFrame, targets: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, every: str | None = None):
    """ST2: one reading of the stream, several sinks: every micro-batch is written once to
    ``path/<target>/batch=<id>`` of each target.  The folder is named by the batch, so a batch that runs
    again replaces what it wrote and no sink has rows twice.  Read a sink with :func:`read_target`."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            for name, choose in targets.items():
                choose(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        finally:
            rows.unpersist()

    with rocksdb_state(stream.sparkSession):
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_target(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one target of :func:`fan_out`."""
    return spark.read.parquet(f"{path}/{name}").drop("batch")


# --- windows, filters, folders -----------------------------------------------------------------
def watch_folder(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """ST1 (discovery): every file of a folder and of the folders in it once, as the file source keeps
    track of seen paths.

    Append the stream to a table; :func:`ready_files` then gives the work list.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", C("modificationTime").alias("modified_at"), "length")


def folder_entry(path: Column, folder: str) -> Column:
    """ST1: the entry of a watched folder that a path leads through: a file, or the folder of its parts."""
    plain = re.sub("^file:/+", "/", folder).rstrip("/")
    ways = "|".join(re.escape(way) for way in dict.fromkeys([plain, quote(plain, safe="/:")]))
    return F.regexp_extract(path, f"^(?:[a-z0-9]+:(?://)?)?(?:{ways})/+([^/]+)", 1)


def ready_files(found: DataFrame, processed: DataFrame, now: Column, min_age_s: float = 5.0) -> DataFrame:
    """ST1 (work list): found files that are old enough, not empty and not processed yet.

    A file that is too young is simply picked up by a later call.
    """
    old = F.unix_micros("modified_at") / 1e6 + min_age_s <= F.unix_micros(now) / 1e6
    return found.where(old & (C("length") > 0)).join(processed.select("path"), "path", "left_anti")


def read_ready(spark: SparkSession, ready: DataFrame, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """ST1 (contents): the rows of all files of a work list in one scan, with the ``path`` they stand in
    and the ``file`` name.  The list of paths goes through the driver, as any scan's file list does."""
    paths = [r[0] for r in ready.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], f"{schema}, path string, file string")
    rows = spark.read.schema(schema).options(**options).format(fmt).load(paths)
    return rows.select(*rows.columns, C("_metadata.file_path").alias("path"), C("_metadata.file_name").alias("file"))


def mark_processed(ready: DataFrame, path: str) -> None:
    """ST1: append a work list that has been read to the table of processed files at ``path``."""
    ready.select("path", F.current_timestamp().alias("processed_at")).write.mode("append").parquet(path)


def route_stream(stream: DataFrame, endpoints: DataFrame, condition: Column) -> DataFrame:
    """ST2: filter events and route them to the static endpoint table."""
    return route_events(stream.where(condition), endpoints)


def event_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """ST3: event counts per tumbling window."""
    out = events.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(L(1)).alias("n"))
    return out.select(C("w.start").alias("window_start"), *by, "n")


def completed_chunks(frames: DataFrame, ts: str, by: list[str], seconds: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """ST10: one row per finished output chunk of ``seconds``; emitted once the watermark passes its end."""
    out = frames.withWatermark(ts, watermark).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by)
    agg = out.agg(F.count(L(1)).alias("frames"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return agg.select(C("w.start").alias("chunk_start"), *by, "frames", "first_at", "last_at")


def last_watermark(spark: SparkSession, folder: str) -> int:
    """Milliseconds of the watermark by which the stream that :func:`run_available` ran in ``folder`` has
    last written windows (0: none yet), from the stream's own log."""
    marks = spark.read.text(f"{folder}/state/offsets").select(F.get_json_object("value", "$.batchWatermarkMs").cast("long").alias("ms"))
    return marks.agg(F.max("ms")).first()[0] or 0


def with_open_windows(written: DataFrame, every: DataFrame, keys: list[str], end: Column | None = None, watermark_ms: int | None = None) -> DataFrame:
    """ST3, ST10, ST13: the table a windowed stream has written, and the windows that are still open.

    A stream in append mode writes a window when the watermark has passed its end, so its table lacks
    the newest windows. ``every`` has all windows of a table of the events, by the same operator or its
    batch twin. Of these, the windows are added whose ``end`` lies after the watermark; a closed window
    that the stream did not write stays missing. Without ``end`` and ``watermark_ms`` (see
    :func:`last_watermark`) all windows that are not written by ``keys`` (window start, groups) count as open.
    """
    if (end is None) != (watermark_ms is None):
        raise ValueError("end and watermark_ms go together")
    if end is not None:
        every = every.where(F.unix_micros(end) > L(watermark_ms * 1000))
    return written.unionByName(key_join(every.select(*written.columns), written.select(*keys), keys, "left_anti"))


def unique_events(events: DataFrame, ts: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """ST12: each event id or path once within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def job_sessions(events: DataFrame, ts: str, by: list[str], idle: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """ST13: runs of a job split by idle gaps."""
    out = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, idle).alias("w"), *by).agg(F.count(L(1)).alias("n"))
    return out.select(*by, C("w.start").alias("session_start"), C("w.end").alias("session_end"), "n")


def job_sessions_table(events: DataFrame, ts: str, by: list[str], idle_s: float, width: float) -> DataFrame:
    """Batch twin of :func:`job_sessions`: runs split where the next event is ``idle_s`` or more away."""
    seq = Seq(tuple(by), (ts,), width)
    seconds = lambda c: F.unix_micros(c) / 1e6
    counted = events.groupBy(*by, ts).agg(F.count(L(1)).alias("_c"))
    marked = adjacent(counted, seq, {"_before": ts}, -1)
    starts = C("_before").isNull() | (seconds(C(ts)) - seconds(C("_before")) >= idle_s)
    out = segments(marked, seq, starts, {"session_start": ("min", C(ts)), "_last": ("max", C(ts)), "n": ("sum", C("_c"))})
    return out.select(*by, "session_start", F.timestamp_micros(F.unix_micros("_last") + L(int(idle_s * 1e6))).alias("session_end"), "n")


def write_history(stream: DataFrame, path: str, checkpoint: str):
    """ST8: append events to a history table; read its bounded tail with ``timeline.newest_n``."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
