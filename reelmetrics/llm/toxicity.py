"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed byte n-grams (3 to 5) of the lower-cased text with white space collapsed,
each counted once a document. Their log-count ratios between the classes scale them, the most
telling ones (by chi square) enter a logistic regression that numpy trains. Fitting reads a bounded
sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN``), whose texts stay in the tasks; scoring reads every whole text, in pieces
of bounded size, so one very long text takes bounded memory.

A null or empty text scores as a text without features. Rows that repeat are scored each. Without
labels of both classes every score is 0. Columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_task, cut, drop_table, held_out, labelled_sample, sampled_rows, table
from .registry import query

MAX_TOXIC, MAX_CLEAN = 4000, 8000
THRESHOLD = 0.7
SIZES = (3, 4, 5)
BITS = 20
KEPT = 4096
PIECE = 1 << 20
#: Tasks that hash the texts of the sample, and features that a step of the fit takes at once.
FIT_TASKS, CHUNK = 12, 1 << 18
_STEP = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


def buckets(text: bytes) -> list[np.ndarray]:
    """Hashed n-grams of the text, with repeats, one array a size and piece."""
    data = np.frombuffer(b" " + b" ".join(text.split()) + b" ", dtype=np.uint8)
    out = []
    for start in range(0, max(1, len(data) - SIZES[0] + 1), PIECE):
        piece = data[start : start + PIECE + SIZES[-1] - 1].astype(np.uint32)
        hashed = np.zeros(0, dtype=np.uint32)
        for n in range(1, SIZES[-1] + 1):
            if len(piece) < n:
                break
            now = piece[n - 1 :] * _STEP[n - 1]
            hashed = now if n == 1 else hashed[:-1] + now
            if n in SIZES:
                out.append(((hashed[:PIECE] ^ np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BITS))
    return out


@dataclass
class ToxicityModel:
    features: np.ndarray  # bucket numbers, ascending
    weights: np.ndarray  # log-count ratio times learned weight
    bias: float

    def scorer(self):
        place = _places(self.features)

        def score(text: str | None) -> float:
            found = [at[at >= 0] for at in (place[b] for b in buckets((text or "").lower().encode()))]
            own = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)
            return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[own].sum(), -500, 500))))

        return score


def _own(text: bytes | str) -> np.ndarray:
    """The distinct hashed n-grams of a text, lower-cased."""
    text = text.decode() if isinstance(text, bytes) else text
    return np.unique(np.concatenate(buckets(text.lower().encode()) or [np.zeros(0, dtype=np.uint32)]))


def _places(picked: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[picked] = np.arange(len(picked), dtype=np.int32)
    return place


def _found(own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of the picked features of a text (at most ``KEPT``: two bytes each)."""
    at = place[own]
    return np.sort(at[at >= 0]).astype(np.uint16)


def _learn(picked: np.ndarray, counts: np.ndarray, found: list[np.ndarray], y: np.ndarray, epochs: int = 200, rate: float = 0.05, decay: float = 1e-3) -> ToxicityModel:
    """Logistic regression on the features ``picked``, which ``counts`` (class by feature) documents hold."""
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    scale = np.log(((counts[1] + 0.5) / (n1 + 1)) / ((counts[0] + 0.5) / (n0 + 1)))
    # Documents go in chunks of bounded size, so that no step makes an array of all their features.
    chunks, ends = [], np.cumsum([len(f) for f in found])
    for at in np.split(np.arange(len(found)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
        chunks.append((at[0], at[-1] + 1, np.concatenate([found[k] for k in at]), [len(found[k]) for k in at]))
    weight, bias = np.zeros(len(picked)), 0.0
    importance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    m1, m2 = np.zeros(len(picked) + 1), np.zeros(len(picked) + 1)
    for step in range(1, epochs + 1):  # full batches, Adam steps
        scaled, total, rest = scale * weight, np.zeros(len(picked)), 0.0
        for first, end, flat, sizes in chunks:
            row = np.repeat(np.arange(end - first), sizes)
            z = np.bincount(row, weights=scaled[flat], minlength=end - first) + bias
            gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[first:end]) * importance[first:end]
            total += np.bincount(flat, weights=gap[row], minlength=len(picked))
            rest += gap.sum()
        grad = np.append(total * scale + decay * weight, rest)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return ToxicityModel(picked, scale * weight, float(bias))


def _without_features() -> ToxicityModel:
    return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), -500.0)


def fit(texts: list[bytes], labels: list[int], epochs: int = 200, rate: float = 0.05, decay: float = 1e-3) -> ToxicityModel:
    """Twin of :func:`train` for a list of texts."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return _without_features()
    counts = np.zeros((2, 1 << BITS))
    for text, label in zip(texts, labels):
        counts[label, _own(text)] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    both = counts.sum(0)
    expected = both * n1 / (n0 + n1)
    chi = np.where(both >= 3, (counts[1] - expected) ** 2 / np.maximum(expected * n0 / (n0 + n1), 1e-9), 0)
    picked = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
    picked = picked[chi[picked] > 0]
    place = _places(picked)
    return _learn(picked, counts[:, picked], [_found(_own(t), place) for t in texts], y, epochs, rate, decay)


def feature_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n0, n1): the documents of each class that hold an n-gram, from (doc_id, text, label).  A
    task counts its documents first."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, _own(text)] += 1
        held = np.flatnonzero(counts.any(axis=0))
        for at in (held[k : k + PIECE // 16] for k in range(0, len(held), PIECE // 16)):
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "n0", "n1"])

    parts = rows.select("text", "label").mapInArrow(run, "bucket int, n0 int, n1 int")
    return parts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold, at most so many of each class.  Tasks hash the texts;
    the driver gets the counts of the picked features and, for each text, which of them it holds."""
    sample = labelled_sample(labels, "toxic", {1: max_toxic, 0: max_clean}, ~held_out(F.col("doc_id"), folds, fold))
    rows = cut(sampled_rows(docs, sample).repartition(FIT_TASKS, "doc_id"), "sample")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return _without_features()
    both = (F.col("n0") + F.col("n1")).cast("double")
    expected = both * n1 / (n0 + n1)
    off = F.col("n1") - expected
    chi = off * off / F.greatest(expected * n0 / (n0 + n1), F.lit(1e-9))
    told = feature_counts(rows).where(both >= 3).withColumn("chi", chi).where("chi > 0").orderBy(F.desc("chi"), "bucket").limit(KEPT).select("bucket", "n0", "n1").toArrow().sort_by("bucket")
    picked, *counts = (told.column(c).to_numpy().astype(np.int64) for c in told.column_names)

    def make():
        place = _places(picked)

        def fn(batch):
            found = [_found(_own(t), place).tobytes() for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

        return fn

    held = by_task(rows.select("doc_id", "text", "label"), make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, found binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    found = [np.frombuffer(f.as_buffer(), dtype=np.uint16) for f in held.column("found")]
    model = _learn(picked, np.array(counts, dtype=np.float64), found, held.column("label").to_numpy().astype(np.float64))
    drop_table(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def make():
        score = model.scorer()

        def fn(batch):
            scores = np.array([score(t) for t in batch.column(1).to_pylist()])
            return pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return fn

    return by_task(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold; nothing is shuffled."""
    place = docs.columns.index("text")

    def make():
        score = model.scorer()

        def fn(batch):
            return batch.filter(pa.array([score(t) < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

        return fn

    return by_task(docs, make, docs.schema)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
