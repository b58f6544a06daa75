"""Quality rules: document statistics, two fixed rules and gradient-boosted trees.

Every document is reduced to a row of statistics in one pass over its whole text. The trees are
grown by numpy on a bounded sample of labelled rows (``MAX_ROWS`` a class) over those statistics,
with monotonic constraints on chosen ones (more symbols, repeated lines or repeated words never
raise the score), then flattened into node arrays that score a batch of rows level by level.

A null text has no words; a document without words fails the base rules. Repeated rows are judged
each. Without labels of both classes the trees keep everything. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, cut, labelled_sample, table
from .registry import query

MAX_ROWS = 6000
KEEP_FROM = 0.3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' features; -1: a larger value never raises the score, 1: never lowers it, 0: free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "punctuation_share": 0, "distinct_share": 1, "same_next_share": -1, "line_words": 0, "stop_share": 0,
}
_SPACE = np.frombuffer(b" \t\n\r\x0b\f", dtype=np.uint8)
_SYMBOL = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-./:;?[]_{}", dtype=np.uint8)
_SENTENCE_END = (b".", b"!", b"?")


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more, the first one included."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    marked = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        marked[shift : len(ids) - 2 + shift] |= again
    return int(marked.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the trees' features of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\f")]
    base = [n, len(text) - int(byte[_SPACE].sum()), int(byte[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(ids)]
    chars = max(1, base[1])
    ends = sum(w.endswith(_SENTENCE_END) for w in words)
    some = max(1, n)
    return base, [
        float(np.log1p(n)), base[1] / some, base[2] / some, base[3] / max(1, len(lines)), base[4] / some, byte[65:91].sum() / chars,
        byte[48:58].sum() / chars, byte[_PUNCTUATION].sum() / chars, len(number) / some, float((ids[1:] == ids[:-1]).sum()) / some, n / max(1, len(lines)), ends / some,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``base_failed`` and the features, for every row."""

    def fn(batch):
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        base = np.array([r[0] for r in rows], dtype=np.int64)
        wide = np.array([r[1] for r in rows], dtype=np.float64)
        return pa.record_batch([batch.column(0), *map(pa.array, base.T), *map(pa.array, wide.T)], ["doc_id", *COUNTS, *FEATURES])

    schema = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return by_batch(docs.select("doc_id", "text"), fn, ", ".join(schema)).withColumn("base_failed", failed)


@dataclass
class Trees:
    """Boosted trees as node arrays: a row at node k goes to ``left[k]`` if its feature is at most
    ``cut[k]``, else to ``right[k]``; leaves point to themselves. ``roots`` has each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        for _ in range(self.depth):
            own = np.take_along_axis(rows, self.feature[at], axis=1)
            at = np.where(own <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -500, 500)))


def grow(rows: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss over binned features.

    A split on a constrained feature is taken only if its two values stand in the right order, and
    the halfway value then bounds everything below it, so that no path can break the order.
    """
    if not len(y) or y.min() == y.max():
        one = np.zeros(1, dtype=np.int64)
        return Trees(one, np.zeros(1), one, one, np.zeros(1), np.zeros(0, dtype=np.int64), 500.0, 0)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    total = np.zeros(len(y))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def leaf(grad, hess, low, high):
        return float(np.clip(-grad / (hess + ridge), low, high))

    def build(own, level, low, high):
        k = len(nodes)
        g, h = gap[own].sum(), curve[own].sum()
        nodes.append([0, 0.0, k, k, rate * leaf(g, h, low, high)])
        best, found = 1e-6, None
        if level < depth and len(own) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[own, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (gap[own], curve[own], np.ones(len(own))))
                vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(ns < least) | (len(own) - ns < least) | (signs[j] * (vr - vl) < 0)] = 0
                at = int(gain.argmax())
                if gain[at] > best:
                    best, found = gain[at], (j, at, (vl[at] + vr[at]) / 2)
        if found is None:
            step[own] = nodes[k][4]
            return k
        j, at, middle = found
        goes = binned[own, j] <= at
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[j], ((low, high), (low, high)))
        left = build(own[goes], level + 1, *bounds[0])
        right = build(own[~goes], level + 1, *bounds[1])
        nodes[k][:4] = [j, float(edges[j][at]), left, right]
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gap, curve = (p - y) * weight, p * (1 - p) * weight
        step = np.zeros(len(y))
        roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
        total += step
    feature, cuts, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(feature.astype(np.int64), cuts, left.astype(np.int64), right.astype(np.int64), value, np.array(roots), 0.0, depth)


def train(stats: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_rows: int = MAX_ROWS) -> Trees:
    """Grow trees on labelled statistics outside the held-out fold."""
    from .common import held_out

    sample = labelled_sample(labels, "quality", {0: max_rows, 1: max_rows}, ~held_out(F.col("doc_id"), folds, fold))
    # One row an id, whatever the table repeats: the sample stays as small as its bound.
    picked = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*FEATURES)).alias("own"))
    got = picked.select("doc_id", "own.*", "label").toArrow().sort_by("doc_id")
    rows = np.stack([got.column(c).to_numpy() for c in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return grow(rows, got.column("label").to_numpy(), list(FEATURES.values()))


def judge_quality(stats: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The statistics with the trees' ``score`` and ``kept`` (false where the base rules fail)."""

    def fn(batch):
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
        scores = trees.score(rows)
        kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool) & (scores >= keep_from)
        return pa.record_batch([*batch.columns, pa.array(scores), pa.array(kept)], [*batch.schema.names, "score", "kept"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return by_batch(stats, fn, f"{schema}, score double, kept boolean")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(document_statistics(table(spark, sf_dir)), "statistics")
    judged = judge_quality(stats, train(stats, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")
