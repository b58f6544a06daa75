"""Runs of periodic word sequences, found with minimizers at several scales.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 2 q)`` words
that no neighbouring word extends. Words are ``[^\\x20\\x09-\\x0D]+``.

* Periods below ``SHORT``: the words are compared with the words q further on, one scan a lag.
* Periods from P up to 2 P, for P = ``SHORT``, 2 ``SHORT``, ...: of every stretch of P words the smallest
  (leftmost) hash of its k-grams (k = P / 4) is its minimizer. A run holds two such stretches one period
  apart, so their minimizers are equal k-grams one period apart. Each pair of equal minimizers P to 2 P
  words apart is a seed that is extended to both sides as far as the words agree at that distance.
* k-grams that are periodic themselves (the next equal one at most k / 2 further on) stand in rows. Rows
  are completed to the right, and of two rows only the pairs that hold the last one of a row are seeds:
  moving a pair to the right within the rows stays on the same stretch. So a stretch of equal words costs
  time in proportion to its length, and no seed is left out.
* A stretch found with several periods keeps the smallest: the others are its multiples.

Extension compares prefix hashes; what is found is then compared word by word, and by a plain scan of
the lag if the hashes were wrong. The rows of a batch are searched together, in pieces of bounded size,
with a word of its own between texts.

Nulls and texts without words have no runs, and an empty collapsed text. Long texts are searched whole.
Repeated rows get the same answer. An empty table gives no rows. Columns other than id and text are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

LEAST = 12
SHORT = 16
#: Bytes of text that are searched together (a longer text is searched alone).
PIECE = 4 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _stretches(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of maximal stretches of period ``lag`` with at least ``least`` words."""
    if len(ids) <= lag:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    differs = np.flatnonzero(ids[lag:] != ids[:-lag])
    before, after = np.append(-1, differs), np.append(differs, len(ids) - lag)
    start, end = before + 1, after + lag
    long = (after - before - 1 > 0) & (end - start >= least)
    return start[long], end[long]


class _Agreement:
    """How far the words at two places agree, by prefix hashes, for many pairs of places at once."""

    def __init__(self, hashed: np.ndarray):
        self.n = len(hashed)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.n, _MULTIPLY, dtype=np.uint64)))
        self.prefix = np.append(np.uint64(0), np.cumsum(hashed * self.power[:-1], dtype=np.uint64))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        left, right = self.prefix[a + length] - self.prefix[a], self.prefix[b + length] - self.prefix[b]
        return left * self.power[b - a] == right

    def _reach(self, limit: np.ndarray, agrees) -> np.ndarray:
        got, step = np.zeros(len(limit), dtype=np.int64), 1 << int(limit.max(initial=0)).bit_length()
        while step:
            more = np.flatnonzero(got + step <= limit)
            more = more[agrees(more, got[more], step)] if len(more) else more
            got[more] += step
            step >>= 1
        return got

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(self.n - b, lambda k, got, step: self.same(a[k] + got, b[k] + got, step))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(a, lambda k, got, step: self.same(a[k] - got - step, b[k] - got - step, step))


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest (leftmost) gram of every ``width`` consecutive ones."""
    low = np.uint64((1 << max(1, len(grams).bit_length())) - 1)
    least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & low).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value in [low, high) of each row."""
    size = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(row))


def _seeds(grams: np.ndarray, text: np.ndarray, period: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal minimizers of one text, ``period`` to ``2 period`` words apart."""
    none = (np.zeros(0, dtype=np.int64),) * 2
    width = period - k + 1
    if len(grams) < width:
        return none
    chosen = _minimizers(grams, width)
    own = grams + text[: len(grams)].astype(np.uint64) * _MULTIPLY
    values, times = np.unique(own[chosen], return_counts=True)
    values = values[times > 1]
    if not len(values):
        return none
    slot = np.searchsorted(values, own)
    slot[slot == len(values)] = 0
    place = np.flatnonzero(values[slot] == own)
    group = slot[place]
    order = np.lexsort((place, group))
    place, group = place[order], group[order]
    # Rows of a periodic gram, completed to the right of their first minimizer.
    opens = np.append(True, (group[1:] != group[:-1]) | (place[1:] - place[:-1] > k // 2))
    row = np.cumsum(opens) - 1
    picked = np.zeros(len(grams), dtype=bool)
    picked[chosen] = True
    seen = np.cumsum(picked[place])
    before = (seen - picked[place])[opens]
    held = seen > before[row]
    last = np.append(opens[1:], True)[held]
    place, group, row = place[held], group[held], row[held]
    key = group * (len(grams) + 2 * period + 1) + place
    ends = np.flatnonzero(last)
    one, other = _spread(np.searchsorted(key, key[ends] + period), np.searchsorted(key, key[ends] + 2 * period))
    first, second = ends[one], other
    one, other = _spread(np.searchsorted(key, key[ends] - 2 * period, "right"), np.searchsorted(key, key[ends] - period, "right"))
    inner = ~last[other]
    first, second = np.append(first, other[inner]), np.append(second, ends[one[inner]])
    # Inside a row the lag is a multiple of the gram's own short period, whose run has been found.
    apart = row[first] != row[second]
    first, second = first[apart], second[apart]
    return place[first], place[second] - place[first]


def find_runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. ``ids`` are words as numbers, with a number
    of its own between two texts; ``text`` numbers the texts, from 0 and without gaps."""
    found = [(*_stretches(ids, q, max(least, 2 * q)), q) for q in range(1, short)]
    start = np.concatenate([s for s, _, _ in found])
    end = np.concatenate([e for _, e, _ in found])
    period = np.repeat(np.arange(1, short), [len(s) for s, _, _ in found])
    starts, ends, periods = [start], [end], [period]
    size = np.bincount(text) if len(text) else np.zeros(0, dtype=np.int64)
    now, origin, grams, k, at = ids, np.arange(len(ids)), _mix(ids.astype(np.uint64) + np.uint64(1)), 1, short
    while size.max(initial=0) >= 2 * at:
        keep = size[text] >= 2 * at
        if not keep.all():
            # Grams that reach beyond a text hold the number at its end, so they equal no other.
            grams = grams[keep[: len(grams)]]
            now, origin, text = now[keep], origin[keep], text[keep]
        while k < max(1, at // 4) and len(grams) > k:
            grams, k = _mix(grams[:-k] * _MULTIPLY + grams[k:]), 2 * k
        place, lag = _seeds(grams, text, at, k) if k == max(1, at // 4) else (origin[:0], origin[:0])
        if len(place):
            agreement = _Agreement(_mix(now.astype(np.uint64) + np.uint64(1)))
            left, right = agreement.backward(place, place + lag), agreement.forward(place, place + lag)
            runs = np.unique(np.stack([place - left, place + lag + right, lag])[:, left + right >= np.maximum(lag, least - lag)], axis=1)
            checked = [_checked(now, s, e, q, least) for s, e, q in runs.T.tolist()]
            runs = np.array([r for rs in checked for r in rs], dtype=np.int64).reshape(-1, 3).T
            starts.append(origin[runs[0]])
            ends.append(origin[runs[0]] + runs[1] - runs[0])
            periods.append(runs[2])
        at *= 2
    start, end, period = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, dtype=bool)
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _checked(ids: np.ndarray, start: int, end: int, lag: int, least: int) -> list[tuple[int, int, int]]:
    """The run if its words bear it out, else what a scan of its surroundings finds at its lag."""
    whole = (ids[start : end - lag] == ids[start + lag : end]).all()
    longer = (start > 0 and ids[start - 1] == ids[start - 1 + lag]) or (end < len(ids) and ids[end] == ids[end - lag])
    if whole and not longer:
        return [(start, end, lag)]
    return [(int(s), int(e), lag) for s, e in zip(*_stretches(ids, lag, max(least, 2 * lag)))]


def search_texts(texts: list[str | None], least: int = LEAST, short: int = SHORT) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs as (start, length, period), collapsed text) of each text."""
    number = defaultdict(count().__next__)
    words = [(t or "").encode().split() for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(np.append(0, size + 1))
    ids = np.full(first[-1], -1, dtype=np.int64)
    for at, own in zip(first.tolist(), words):
        ids[at : at + len(own)] = list(map(number.__getitem__, own))
    between = ids < 0
    ids[between] = len(number) + np.arange(int(between.sum()))
    text = np.repeat(np.arange(len(texts)), size + 1)
    start, end, period = find_runs(ids, text, least, short)
    of, out = text[start] if len(start) else start, []
    # A word goes if a run has it beyond its first period.
    covered = np.cumsum(np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(end, minlength=len(ids) + 1)) > 0
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for n, own in enumerate(words):
        at, lo, hi = int(first[n]), cuts[n], cuts[n + 1]
        runs = list(zip((start[lo:hi] - at).tolist(), (end[lo:hi] - start[lo:hi]).tolist(), period[lo:hi].tolist()))
        if runs:
            gone = covered[at : at + len(own)].tolist()
            own = [w for w, g in zip(own, gone) if not g]
        out.append((int(size[n]), runs, b" ".join(own).decode()))
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, short: int = SHORT, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the runs by start and period, and the text
    without the words that repeat a run's first period."""

    def fn(batches):
        def done(ids, texts):
            n, runs, collapsed = zip(*search_texts(texts, least, short))
            listed = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in own] for own in runs], pa.list_(_RUN))
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()), listed, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= piece:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield done(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(fn, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from some word on where 10 divides crc32 of the id: with n words and
    g = crc32 div 10, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shaped = F.transform(
        F.array(F.struct(words.alias("w"), F.size(words).cast("long").alias("n"))),
        lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), (g % s["n"]).alias("a"), (F.floor((s["n"] - g % s["n"]) / (3 + g % 8)) + 1).alias("p")),
    )
    picked = F.transform(
        shaped, lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " ")
    )
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.get(picked, F.lit(0))).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed", "n_words").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
