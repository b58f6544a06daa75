"""User functions over frames (family UD).

Frames are rows with ``pixels BINARY, height INT, width INT, channels INT`` (8-bit).  Python runs
in Arrow batches on the executors; what a user supplies is one function per frame or per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from ..session import dealt
from .generate import frame_chunks
from .sequence import Seq
from .timeline import lagged

C, L = F.col, F.lit

#: Rows that a task of a user aggregate gathers before it forms states.
AGGREGATE_ROWS = 200_000


def to_array(pixels: bytes, height: int, width: int, channels: int = 1) -> np.ndarray:
    flat = np.frombuffer(pixels, dtype=np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


# --- UD1-UD4 -----------------------------------------------------------------------------------
def process_frames(df: DataFrame, frame_no: str, process_frame=None, process_batch=None, context: Mapping[str, Any] | None = None) -> DataFrame:
    """UD1: apply a frame processor; ``process_batch(frames, numbers, context)`` sees one Arrow batch.

    ``process_frame(frame, number, context)`` is used when there is no batch function.  The output
    keeps all columns and takes its size from the returned arrays.
    """
    ctx = dict(context or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = [to_array(*r) for r in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["channels"])]
            numbers = pdf[frame_no].tolist()
            if process_batch is not None:
                done = process_batch(frames, numbers, ctx)
            else:
                done = [process_frame(f, n, ctx) for f, n in zip(frames, numbers)]
            done = [np.ascontiguousarray(f, dtype=np.uint8) for f in done]
            yield pdf.assign(
                pixels=[f.tobytes() for f in done],
                height=[f.shape[0] for f in done],
                width=[f.shape[1] for f in done],
                channels=[1 if f.ndim == 2 else f.shape[2] for f in done],
            )

    return df.mapInPandas(run, df.schema)


def analyzer(analyze_frame: Callable[[np.ndarray], Mapping[str, float]], metrics: Sequence[str]):
    """UD2: a frame analyzer as a vectorised column function returning a struct of doubles."""
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in metrics])

    @F.pandas_udf(schema)
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = [analyze_frame(to_array(*r)) for r in zip(pixels, height, width, channels)]
        return pd.DataFrame([[float(r[m]) for m in metrics] for r in rows], columns=list(metrics))

    return lambda: run("pixels", "height", "width", "channels")


def frame_filter(apply: Callable[[np.ndarray, float], np.ndarray], strength: float = 1.0):
    """UD3: a simple per-frame filter (same size) as a vectorised column function."""

    @F.pandas_udf(T.BinaryType())
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.ascontiguousarray(apply(to_array(*r), strength), dtype=np.uint8).tobytes() for r in zip(pixels, height, width, channels)])

    return lambda: run("pixels", "height", "width", "channels")


def register_function(spark: SparkSession, name: str, function: Any) -> None:
    """UD4: make a user function (scalar, pandas or table function) callable from SQL."""
    (spark.udtf if isinstance(function, UserDefinedTableFunction) else spark.udf).register(name, function)


# --- UD7 ---------------------------------------------------------------------------------------
def custom_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], Sequence[float]],
    merge: Callable[[np.ndarray], Sequence[float]],
    finish: Callable[[np.ndarray], Sequence[float]],
    names: Sequence[str],
    salts: int = 16,
) -> DataFrame:
    """UD7: a user aggregate whose state is a vector of numbers.

    ``partial`` reduces rows of one key, of ``AGGREGATE_ROWS`` rows that a task takes at once, to a state, ``merge``
    reduces a matrix of states (one a row) to one, ``finish`` turns the last state into the columns ``names``. States
    are formed before the shuffle and merged by salt first, so no task sees the rows of a whole key; merges run over
    batches of keys.
    """
    keys = list(keys)
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def reduced(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(*(k if isinstance(k, tuple) else (k,)), [float(x) for x in partial(own)]) for k, own in rows.groupby(keys, dropna=False, sort=False)]
        return pd.DataFrame(found, columns=[*keys, "_state"])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for rows in batches:
            waiting.append(rows)
            n += len(rows)
            if n >= AGGREGATE_ROWS:
                yield reduced(pd.concat(waiting, ignore_index=True))
                waiting, n = [], 0
        if n:
            yield reduced(pd.concat(waiting, ignore_index=True))

    def merged(found) -> list[float]:
        return [float(x) for x in merge(np.stack(list(found)))]

    @F.pandas_udf("array<double>")
    def some(found: pd.Series) -> pd.Series:
        return found.map(merged)

    @F.pandas_udf(", ".join(f"c{n} double" for n in range(len(names))))
    def final(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[float(v) for v in finish(np.array(merged(f)))] for f in found], columns=[f"c{n}" for n in range(len(names))])

    parts = df.mapInPandas(states, f"{key_fields}, _state array<double>").withColumn("_salt", F.pmod(F.hash("_state"), L(salts)))
    parts = parts.groupBy(*keys, "_salt").agg(F.collect_list("_state").alias("_states")).select(*keys, some("_states").alias("_state"))
    done = parts.groupBy(*keys).agg(F.collect_list("_state").alias("_states")).select(*keys, final("_states").alias("_done"))
    return done.select(*keys, *(C(f"_done.c{n}").alias(name) for n, name in enumerate(names)))


# --- UD5, UD6 ----------------------------------------------------------------------------------
def run_variants(frames: DataFrame, frame_no: str, variants: Mapping[str, Any], factory: Callable[[Any], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """UD5: every frame through the processor of every variant, with PSNR and SSIM against the input.

    The variants are an exploded literal; pixels do not leave the executors.
    """
    order = list(variants)
    keep = [c for c in frames.columns if c not in ("pixels", "height", "width", "channels")]
    spread = frames.select("*", F.posexplode(F.array(*[L(v) for v in order])).alias("variant_pos", "variant"))
    fields = [frames.schema[c] for c in keep] + [
        T.StructField("variant_pos", T.IntegerType()), T.StructField("variant", T.StringType()), T.StructField("psnr", T.DoubleType()), T.StructField("ssim", T.DoubleType())
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {name: factory(variants[name]) for name in order}
        for pdf in batches:
            scores = [pair_scores(f := to_array(*r[:4]), made[r[4]](f)) for r in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["channels"], pdf["variant"])]
            yield pdf[[*keep, "variant_pos", "variant"]].assign(psnr=[s[1] for s in scores], ssim=[s[2] for s in scores])

    return spread.mapInPandas(run, T.StructType(fields))


def process_chunks(frames: DataFrame, keys: tuple[str, ...], frame_no: str, totals: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, size: int = 100, overlap: int = 16) -> DataFrame:
    """UD6: apply ``fn`` to overlapping chunks of a video and keep the core rows of each chunk.

    A chunk holds ``size`` frames at most; ``fn`` gets them in order and must keep ``frame_no``.  The
    core of a chunk is its first ``size - overlap`` frames; the overlap only gives context.  A task gets its
    chunks in order, many in a batch; whole numbers are floats where a batch holds nulls among them.
    """
    stride = size - overlap
    spread = frames.join(totals, list(keys)).select(*frames.columns, F.explode(frame_chunks(C(frame_no), C("total_frames"), size, overlap)).alias("_chunk"))

    def done(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        own = rows.drop(columns="_chunk")
        outs = [fn(own.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts, ends)]
        first = np.repeat(rows["_chunk"].to_numpy()[starts] * stride, [len(o) for o in outs])
        out = pd.concat(outs, ignore_index=True)
        return out[(out[frame_no] >= first) & (out[frame_no] < first + stride)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last chunk may go on in the next batch
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            new = np.zeros(len(rows), dtype=bool)
            for c in (*keys, "_chunk"):
                now, before = rows[c], rows[c].shift()
                new |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(dtype=bool)
            starts = np.flatnonzero(new[1:]) + 1
            if len(starts):
                yield done(rows.iloc[: starts[-1]], np.append(0, starts[:-1]), starts)
            rest = rows.iloc[starts[-1] if len(starts) else 0 :]
        if rest is not None and len(rest):
            yield done(rest, np.array([0]), np.array([len(rest)]))

    return dealt(spread, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", frame_no).mapInPandas(run, schema)


# --- UD9, UD10 ---------------------------------------------------------------------------------
def grey(frame: np.ndarray) -> np.ndarray:
    """Luma of a BGR frame (weights .114, .587, .299) or the frame itself."""
    return frame.astype(float) if frame.ndim == 2 else frame[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def _reflect(img: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(img, pad, mode="reflect")


def laplacian(img: np.ndarray) -> np.ndarray:
    p = _reflect(img, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img


def blur5(img: np.ndarray) -> np.ndarray:
    k = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16.0
    p = _reflect(img, 2)
    h, w = img.shape
    rows = sum(k[i] * p[i : i + h, :] for i in range(5))
    return sum(k[i] * rows[:, i : i + w] for i in range(5))


def block_means(img: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a rows x cols grid of (nearly) equal blocks."""
    ys = np.linspace(0, img.shape[0], rows + 1).astype(int)
    xs = np.linspace(0, img.shape[1], cols + 1).astype(int)
    return np.array([[img[y0:y1, x0:x1].mean() for x0, x1 in zip(xs, xs[1:])] for y0, y1 in zip(ys, ys[1:])])


def pack_bits(bits: np.ndarray) -> list[int]:
    """Bits (row-major, most significant first) as signed 64-bit words."""
    raw = np.packbits(np.resize(bits.ravel(), -(-bits.size // 64) * 64) if bits.size % 64 else bits.ravel())
    return [int(x) for x in np.frombuffer(raw.tobytes(), dtype=">i8")]


FEATURES = (
    "brightness double, contrast double, sharpness double, noise double, edge_density double, dark_share double, bright_share double, "
    "average_hash array<bigint>, difference_hash array<bigint>, thumb array<double>, histogram array<bigint>"
)


def frame_features(df: DataFrame, keep: Sequence[str], decode: Callable[..., np.ndarray] = to_array, hash_size: int = 8, thumb: int = 8, edge_limit: float = 30.0) -> DataFrame:
    """UD9: the measurements every other operator reads, from raw pixels.

    ``decode(pixels, height, width, channels)`` is pluggable, e.g. for encoded images.
    """
    keep = list(keep)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", " + FEATURES

    def one(img: np.ndarray) -> tuple:
        g = grey(img)
        residue = g - blur5(g)
        gy, gx = np.abs(np.diff(g, axis=0)), np.abs(np.diff(g, axis=1))
        edges = (gy[:, :-1] > edge_limit) | (gx[:-1, :] > edge_limit)
        small = block_means(g, min(hash_size, g.shape[0]), min(hash_size, g.shape[1]))
        wide = block_means(g, min(hash_size, g.shape[0]), min(hash_size + 1, g.shape[1]))
        th = block_means(g, min(thumb, g.shape[0]), min(thumb, g.shape[1]))
        return (
            g.mean(), g.std(), laplacian(g).var(), 1.4826 * float(np.median(np.abs(residue - np.median(residue)))), edges.mean() if edges.size else 0.0,
            float((g < 5).mean()), float((g >= 251).mean()), pack_bits(small > small.mean()), pack_bits(wide[:, :-1] > wide[:, 1:]), th.ravel().tolist(),
            np.bincount(g.round().astype(int).ravel(), minlength=256).tolist(),
        )

    names = [f.split(" ")[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(decode(*r)) for r in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["channels"])]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return df.select(*keep, *[c for c in ("pixels", "height", "width", "channels") if c not in keep]).mapInPandas(run, schema)


def pair_scores(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Mean absolute difference, PSNR (100 when equal) and global SSIM of two frames."""
    x, y = grey(a), grey(b)
    mse = float(((a.astype(float) - b.astype(float)) ** 2).mean())
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(), y.mean()
    cov = ((x - mx) * (y - my)).mean()
    ssim = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (x.var() + y.var() + c2))
    return float(np.abs(x - y).mean()), 10 * np.log10(255.0**2 / mse) if mse > 0 else 100.0, float(ssim)


PAIR = T.StructType([T.StructField(n, T.DoubleType()) for n in ("abs_diff", "psnr", "ssim")])


@F.pandas_udf(PAIR)
def _pair_udf(a: pd.Series, b: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, h, w, c in zip(a, b, height, width, channels):
        if x is None or y is None or len(x) != len(y):
            out.append((None, None, None))
        else:
            out.append(pair_scores(to_array(x, h, w, c), to_array(y, h, w, c)))
    return pd.DataFrame(out, columns=["abs_diff", "psnr", "ssim"], dtype="float64")


def consecutive_scores(df: DataFrame, seq: Seq) -> DataFrame:
    """UD10: difference, PSNR and SSIM of every frame to the one before it (null for the first)."""
    out = lagged(df, seq, {"_before": "pixels"})
    scored = out.withColumn("_s", _pair_udf("_before", "pixels", "height", "width", "channels"))
    return scored.select(*[c for c in df.columns if c != "pixels"], "_s.*")


def frame_index_function():
    """UD8: a packed frame index (variable-length deltas, seven bits a byte, high bit: more follows) as
    rows ``entry_no, frame_no``: a stateful byte format that column functions cannot unpack."""

    class Index:
        def eval(self, packed: bytes):
            frame, value, shift, entry = 0, 0, 0, 0
            for byte in packed or b"":
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    frame, entry = frame + value, entry + 1
                    yield entry, frame
                    value = shift = 0

    return F.udtf(Index, returnType="entry_no int, frame_no bigint")
