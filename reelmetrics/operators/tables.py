"""Listing, top-k, sampling (family T) and set operators (family U)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import TARGET_ROWS, Seq, key_join, running

C, L = F.col, F.lit


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing (top-k per task, never a full sort, while offset + limit is small)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def worst_frames(df: DataFrame, score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` lowest scores."""
    return df.orderBy(score, *ties).limit(n)


def next_frame(df: DataFrame, job: str, frame: str, pending: Column) -> DataFrame:
    """First pending frame of every job."""
    return df.where(pending).groupBy(job).agg(F.min(frame).alias("next_frame"))


def eviction_list(index: DataFrame, order: Sequence[str], size: str, bytes_needed: int, rows: int = TARGET_ROWS) -> DataFrame:
    """T5: least recently used entries until enough bytes are freed.

    The running size is computed in blocks of at most about ``rows`` entries, so the index is never sorted
    in one task.
    """
    out = running(index, Seq((), tuple(order), rows=rows), {"freed": ("sum", C(size))})
    return out.where(C("freed") - C(size) < bytes_needed)


def stale_entries(index: DataFrame, ts: Column, now: Column, days: int) -> DataFrame:
    """Entries older than ``days``."""
    return index.where(ts < now - F.make_interval(days=L(days)))


def every_nth(df: DataFrame, frame: Column, n: int, start: int = 0) -> DataFrame:
    """Every n-th frame from ``start``."""
    return df.where((frame >= start) & ((frame - start) % n == 0))


def uniform_sample(df: DataFrame, totals: DataFrame, keys: Sequence[str], frame: str, count: int) -> DataFrame:
    """Positions step, 2 step, ... count step with step = total // (count + 1); short videos give frame 0."""
    step = F.floor(C("total_frames") / (count + 1))
    hit = F.when(step == 0, C(frame) == 0).otherwise((C(frame) % F.greatest(step, L(1)) == 0) & C(frame).between(step, step * count))
    return df.transform(key_join, totals, keys).where(hit).drop("total_frames")


def random_sample(df: DataFrame, k: int, seed: int, order: Column | None = None) -> DataFrame:
    """``k`` random rows; pass a hash of the key as ``order`` for a repeatable choice."""
    return df.orderBy(F.rand(seed) if order is None else order).limit(k)


def anchor_frames(df: DataFrame, totals: DataFrame, keys: Sequence[str], frame: str, count: int) -> DataFrame:
    """Evenly spaced anchors with the first and last frame forced in; all frames of a short video."""
    n, step = C("total_frames"), F.floor(C("total_frames") / count)
    spaced = (C(frame) % F.greatest(step, L(1)) == 0) & (C(frame) < step * count)
    hit = (n <= count) | spaced | (C(frame) == 0) | (C(frame) == n - 1)
    return df.transform(key_join, totals, keys).where(hit).drop("total_frames")


def matching_nodes(nodes: DataFrame, min_memory: float, min_ram: float, k: int, ties: Sequence[str]) -> DataFrame:
    """Nodes that meet the minimums, strongest first."""
    return nodes.where((C("gpu_memory_gb") >= min_memory) & (C("ram_gb") >= min_ram)).orderBy(
        C("gpu_memory_gb").desc(), C("cpu_cores").desc(), C("fps").desc(), *ties
    ).limit(k)


def cheapest_per_key(offers: DataFrame, keys: Sequence[str], price: str, offer: str) -> DataFrame:
    """First (cheapest) offer per key."""
    rest = [c for c in offers.columns if c not in keys]
    return offers.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(price, offer)).alias("_r")).select(*keys, "_r.*")


def keyword_search(df: DataFrame, query: str, fields: Sequence[str], tags: str) -> DataFrame:
    """Case-insensitive substring in any field or tag."""
    q = query.lower()
    hit = F.exists(tags, lambda x: F.lower(x).contains(q))
    for f in fields:
        hit = hit | F.lower(C(f)).contains(q)
    return df.where(F.coalesce(hit, L(False)))


def catalogue(builtin: DataFrame, user: DataFrame, category: str | None = None, era: str | None = None) -> DataFrame:
    """Built-in and user presets, filtered by category and by era (or "any")."""
    out = builtin.withColumn("is_builtin", L(True)).unionByName(user.withColumn("is_builtin", L(False)))
    if category is not None:
        out = out.where(C("category") == category)
    if era is not None:
        out = out.where(C("era").isin(era, "any"))
    return out


def best_format(formats: DataFrame, item: str, score: Column, ties: Sequence[Column]) -> DataFrame:
    """Best available format per item; formats without a video codec do not count."""
    rest = [c for c in formats.columns if c != item]
    ok = formats.where(C("codec").isNotNull() & (C("codec") != "none"))
    return ok.groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(score, *ties)).alias("_r")).select(item, "_r.*")


def union_types(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct union of two lists."""
    return a.unionByName(b).distinct()


def union_keys(df: DataFrame, maps: str) -> DataFrame:
    """All keys that occur in a map column."""
    return df.select(F.explode(F.map_keys(maps)).alias("key")).distinct()


def orphans(checkpoints: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """U4: checkpoints of jobs that are not active."""
    return checkpoints.join(active.select(key), key, "left_anti")


def common_frames(*sides: DataFrame) -> DataFrame:
    """Keys present on every side."""
    out = sides[0]
    for s in sides[1:]:
        out = out.intersect(s)
    return out
