"""Quality classifier: supervised subword embeddings in numpy.

A document is the average of learned vectors of its hashed words and of the hashed character n-grams
(3 to 5 bytes, across single blanks as well, so that order, case and punctuation at word ends show);
a softmax layer reads the average. Stochastic gradient descent trains vectors and layer on a bounded sample of labelled rows (``MAX_ROWS`` a
class). To score, the layer is folded into the vectors, so a document's score is an average of
looked-up numbers; every whole text is read, in pieces of bounded size.

A null or empty text has the average zero and scores as the layer's bias says. Repeated rows are
scored each. Without labels of both classes every score is 0. Columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_task, held_out, labelled_sample, sample_texts, table
from .registry import query

MAX_ROWS = 4000
THRESHOLD = 0.3
BITS = 18
DIM = 16
SIZES = (3, 4, 5)
PIECE = 1 << 20
_STEP = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)
_PLACE = (np.uint32(2654435761) ** np.arange(1, 65, dtype=np.uint32)).astype(np.uint32)


def features(text: bytes):
    """Hashed words and n-grams of the text, with repeats, in arrays a piece."""
    words = text.split()
    at = 0
    while at < len(words):
        size, end = 0, at
        while end < len(words) and (end == at or size < PIECE):
            size, end = size + len(words[end]) + 1, end + 1
        yield from _of_words(words[at:end])
        at = end


def _of_words(words: list[bytes]):
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    wide = data.astype(np.uint32)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.cumsum(np.append(0, length[:-1] + 1))
    letters = wide[1:]
    inside = np.arange(len(letters)) - np.repeat(first, length + 1)
    whole = np.add.reduceat(letters * _PLACE[inside & 63], first, dtype=np.uint32)
    yield ((whole ^ np.uint32(7)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    hashed = wide * _STEP[0]
    for n in range(2, SIZES[-1] + 1):
        if len(data) < n:
            return
        hashed = hashed[:-1] + wide[n - 1 :] * _STEP[n - 1]
        if n in SIZES:
            yield ((hashed ^ np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)


@dataclass
class QualityModel:
    value: np.ndarray  # by bucket: vector times the difference of the layer's two rows
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for ids in features((text or "").encode()):
            total, n = total + float(self.value[ids].sum(dtype=np.float64)), n + len(ids)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[bytes], labels: list[int], epochs: int = 5, rate: float = 0.5, seed: int = 1) -> QualityModel:
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(1 << BITS, dtype=np.float32), -500.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    bags = []
    for text in texts:
        found = list(features(text))
        ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint32), np.zeros(0))
        bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    importance = len(y) / (2 * np.bincount(y, minlength=2))
    steps = epochs * len(y)
    for step in range(steps):
        if step % len(y) == 0:
            order = rng.permutation(len(y))
        k = order[step % len(y)]
        ids, share = bags[k]
        mean = share @ vectors[ids]
        z = layer @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[k]] -= 1
        p *= np.float32(rate * (1 - step / steps) * importance[y[k]])
        back = layer.T @ p
        layer -= np.outer(p, mean)
        bias -= p * np.float32(0.1)
        vectors[ids] -= np.outer(share / max(share.max(initial=0), 1e-6) * 0.05, back)
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on labelled rows outside the held-out fold, at most ``max_rows`` of each class."""
    sample = labelled_sample(labels, "quality", {0: max_rows, 1: max_rows}, ~held_out(F.col("doc_id"), folds, fold))
    return fit(*sample_texts(docs, sample))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def make():
        def fn(batch):
            scores = np.array([model.score(t) for t in batch.column(1).to_pylist()])
            return pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return fn

    return by_task(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
