"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes when a string of ``THRESHOLD`` bytes that covers it also starts anywhere else. Positions
are ranked by longer and longer prefixes, and a position leaves as soon as its rank is unique or the
threshold is passed. Ranking every byte position would sort many times the input, so the positions
are sampled by content: each string of ``THRESHOLD`` bytes is represented by its smallest ``GRAM``-byte
gram, and all strings that have one gram in common as theirs form its zone. Equal strings have equal
grams at the same place, so no repeat is lost.

Round 1 sorts the zones by gram: a gram that occurs once ends its zone. Round 2 sorts what is left by
(gram, whole zone), which reaches past the threshold: all strings of a zone that occurs twice repeat.
Round 3 ranks, for zones that share their gram but not their whole, each single string; zones with a
gram of few variants (``MANY``) meet in one row and those of more (up to ``CROWD``, a few megabytes) in
one group; beyond that they are ranked string by string, with counts combined before the shuffle. Grams that many documents share are counted apart in the
same way, so no common passage gathers in one task. Ranks are 64-bit hashes (round 3: 128 bits).

Matches never cross documents. A null or short text loses nothing. Repeated rows repeat each other.
Rows are told apart by a hash of id and text, so an id may repeat with other texts and may be null.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, cut, drop_table, table
from .registry import query

THRESHOLD = 200
GRAM = 40
MANY = 64
CROWD = 16384
HOT = 100_000
PIECE = 1 << 19
_LOW = np.uint64(0xFFFFF)
_MULTIPLY = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from every position, built by doubling the width."""
    part, factor, width = data.astype(np.uint64) + np.uint64(1), _MULTIPLY, 1
    out, done = None, 0
    count = len(data) - gram + 1
    while True:
        if gram & width:
            own = part[done : done + count]
            out = own.copy() if out is None else out * np.uint64(factor) + own
            done += width
        if width * 2 > gram:
            break
        part = part[:-width] * np.uint64(factor) + part[width:]
        factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, width * 2
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def zones(data: bytes, threshold: int = THRESHOLD, gram: int = GRAM):
    """(gram hash, zone hash, first string, last string) of every zone, as arrays."""
    grams_in = threshold - gram + 1
    parts = []
    for start in range(0, max(0, len(data) - threshold + 1), PIECE):
        piece = data[start : start + PIECE + threshold - 1]
        hashed = gram_hashes(np.frombuffer(piece, dtype=np.uint8), gram)
        least, width = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64), 1
        while width * 2 <= grams_in:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        strings = len(piece) - threshold + 1
        least = np.minimum(least[:strings], least[grams_in - width : grams_in - width + strings])
        at = (least & _LOW).astype(np.int64)
        first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        last = np.append(first[1:], strings) - 1
        anchor = at[first]
        whole = [xxhash.xxh3_64_intdigest(piece[s : e + threshold], x) for s, e, x in zip(first.tolist(), last.tolist(), (anchor - first).tolist())]
        parts.append((hashed[anchor], np.array(whole, dtype=np.uint64), first + start, last + start))
    if not parts:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts))


def merge_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; runs that touch are one."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > reach[:-1])
    return first[new], np.append(reach[:-1][new[1:]], reach[-1])


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def row_key() -> Column:
    """Key of a row in all rounds; rows with equal keys are copies of one another."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def document_zones(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """A row a document: its distinct zones (gram, whole, packed place, whether it has them twice) and
    the runs that zones it has twice cover. A place is packed as first string times 512 plus length - 1."""

    def fn(batch):
        grams, wholes, places, twice, start, end = [], [], [], [], [], []
        for text in batch.column(1).to_pylist():
            g, w, first, last = zones((text or "").encode(), threshold, gram)
            order = np.lexsort((w, g))
            g, w, first, last = g[order], w[order], first[order], last[order]
            new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])) if len(g) else np.zeros(0, dtype=bool)
            group = np.cumsum(new) - 1
            often = np.bincount(group, minlength=int(new.sum())) > 1 if len(g) else np.zeros(0, dtype=bool)
            local = often[group] if len(g) else often
            runs = merge_spans(first[local], last[local] + threshold)
            start.append(runs[0])
            end.append(runs[1])
            grams.append(g[new].view(np.int64))
            wholes.append(w[new].view(np.int64))
            places.append(first[new] * 512 + (last - first)[new])
            twice.append(often)
        return pa.record_batch(
            [batch.column(0), _lists(grams, pa.int64()), _lists(wholes, pa.int64()), _lists(places, pa.int64()), _lists(twice, pa.bool_()), _lists(start, pa.int64()), _lists(end, pa.int64())],
            ["doc", "gram", "whole", "place", "twice", "first", "end"],
        )

    return by_batch(
        docs.select(row_key().alias("doc"), "text"), fn, "doc long, gram array<long>, whole array<long>, place array<long>, twice array<boolean>, first array<long>, end array<long>"
    )


def common_grams(found: DataFrame, local: int = 16, limit: int = HOT) -> DataFrame:
    """Grams that many documents of one batch have, the most frequent ``limit``: a bounded hint."""

    def fn(batch):
        grams, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        often = n >= local
        return pa.record_batch([pa.array(grams[often]), pa.array(n[often])], ["gram", "n"])

    counts = by_batch(found.select("gram"), fn, "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(limit).select("gram")


def ranked_zones(found: DataFrame) -> DataFrame:
    """Zones that rounds 1 and 2 leave: (doc, place, gram, done, open, many). ``done``: the whole zone
    repeats; ``open``: this is the first zone of its kind and others share its gram, with other wholes."""
    rows = found.select("doc", F.explode(F.arrays_zip("gram", "whole", "place", "twice")).alias("z")).select(
        "doc", "z.gram", "z.whole", "z.place", (F.lit(1) + F.col("z.twice").cast("int")).cast("long").alias("times")
    )
    hot = cut(common_grams(found), "grams")
    kind, own = Window.partitionBy("gram", "whole"), Window.partitionBy("gram")
    plain = (
        rows.join(F.broadcast(hot), "gram", "left_anti")
        .withColumn("leads", F.row_number().over(kind.orderBy("doc", "place")) == 1)
        .withColumn("same", F.sum("times").over(kind))
        .withColumn("variants", F.sum(F.col("leads").cast("long")).over(own))
    )
    busy = rows.join(F.broadcast(hot), "gram")
    kinds = cut(busy.groupBy("gram", "whole").agg(F.sum("times").alias("same"), F.min(F.struct("doc", "place")).alias("lead")), "kinds")
    variants = cut(kinds.groupBy("gram").agg(F.count("*").alias("variants")), "variants")
    kinds = cut(kinds.join(variants, "gram"), "kinds")
    busy = busy.join(kinds, ["gram", "whole"]).withColumn("leads", F.struct("doc", "place") == F.col("lead"))
    names = ["doc", "place", "gram", "leads", "same", "variants"]
    both = plain.select(*names).unionByName(busy.select(*names))
    done, shared = F.col("same") > 1, F.col("variants") > 1
    kept = both.where(done | shared)
    asks = F.col("leads") & shared
    return kept.where(done | asks).select("doc", "place", done.alias("done"), asks.alias("open"), F.when(asks, F.col("gram")).alias("gram"), F.when(F.col("variants") <= MANY, 0).when(F.col("variants") <= CROWD, 1).otherwise(2).alias("many"))


def settle(docs: DataFrame, found: DataFrame, ranked: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: the runs known so far, and for round 3 its open zones; the text only where
    round 3 can add a run."""
    zone = F.struct("place", "done", "open", "gram", "many")
    lists = ranked.groupBy("doc").agg(F.collect_list(zone).alias("zones"))
    local = found.where(F.size("first") > 0).groupBy(F.col("doc").alias("d")).agg(F.first("first").alias("first"), F.first("end").alias("end"))
    lists = lists.join(local, F.col("doc") == F.col("d"), "full").select(F.coalesce("doc", "d").alias("doc"), "zones", "first", "end")
    rows = docs.select("doc_id", row_key().alias("row"), "text")
    joined = rows.join(lists, F.col("row") == F.col("doc"), "left").select("doc_id", "row", "text", "zones", "first", "end")

    def fn(batch):
        out = []
        cols = [batch.column(k).to_pylist() for k in range(1, 6)]
        for row, text, own, first, end in zip(*cols):
            data, own = (text or "").encode(), own or []
            begin = [*(first or []), *(z["place"] >> 9 for z in own if z["done"])]
            stop = [*(end or []), *((z["place"] >> 9) + (z["place"] & 511) + threshold for z in own if z["done"])]
            s, e = merge_spans(np.array(begin, dtype=np.int64), np.array(stop, dtype=np.int64))
            asks = [
                {"gram": z["gram"], "many": z["many"], "needs": not z["done"], "start": z["place"] >> 9, "part": data[z["place"] >> 9 : (z["place"] >> 9) + (z["place"] & 511) + threshold]}
                for z in own
                if z["open"]
            ]
            waits = any(a["needs"] for a in asks)
            out.append((row, len(data), s.tolist(), e.tolist(), asks, data if waits else None, None if waits else digest(data, s, e)))
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), ASKS, pa.binary(), pa.string()]
        names = ["doc_id", "doc", "n_bytes", "first", "end", "asks", "data", "kept_sha256"]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc long, n_bytes long, first array<long>, end array<long>, asks array<struct<gram:long,many:int,needs:boolean,start:long,part:binary>>, data binary, kept_sha256 string"
    return by_batch(joined, fn, schema)


ASKS = pa.list_(pa.struct([("gram", pa.int64()), ("many", pa.int32()), ("needs", pa.bool_()), ("start", pa.int64()), ("part", pa.binary())]))


def digest(data: bytes, first, end) -> str:
    """SHA-256 of what the runs leave."""
    left, at = hashlib.sha256(), 0
    for s, e in zip(first, end):
        left.update(data[at:s])
        at = e
    left.update(data[at:])
    return left.hexdigest()


def strings(part: bytes, threshold: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(part[k : k + threshold]) for k in range(len(part) - threshold + 1)]


def repeats_among(parts, threshold: int) -> list[tuple[int, int, int]]:
    """(doc, first, end) runs of strings that stand in two of the ``parts`` (doc, start, needs, part)
    at least, for the parts that need them."""
    flat = np.frombuffer(b"".join(b"".join(strings(part, threshold)) for *_, part in parts), dtype="<u8").reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    alike = (flat[order][1:] == flat[order][:-1]).all(axis=1)
    again = np.zeros(len(flat), dtype=bool)
    again[order] = np.append(alike, False) | np.append(False, alike)
    out, at = [], 0
    for doc, start, needs, part in parts:
        own = again[at : at + len(part) - threshold + 1]
        at += len(own)
        if needs:
            hit = np.flatnonzero(own) + start
            out += [(doc, int(s), int(e)) for s, e in zip(*merge_spans(hit, hit + threshold))]
    return out


def repeated_strings(state: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Round 3: (doc, first, end) runs of repeated strings in zones whose whole does not repeat."""
    asks = state.select("doc", F.explode("asks").alias("z")).select("doc", "z.*")
    groups = asks.where("many = 0").groupBy("gram").agg(F.collect_list(F.struct("doc", "start", "needs", "part")).alias("parts"))
    names = ["doc", "first", "end"]

    def columns(runs) -> list[pa.Array]:
        return [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]

    def few(batch):
        found = (repeats_among([tuple(p.values()) for p in parts], threshold) for parts in batch.column(0).to_pylist())
        return pa.record_batch(columns([run for runs in found for run in runs]), names)

    def crowd(rows: pa.Table) -> pa.Table:
        return pa.table(columns(repeats_among(list(zip(*(rows.column(c).to_pylist() for c in ("doc", "start", "needs", "part")))), threshold)), names)

    def single(batch):
        doc, at, key = [], [], []
        for d, start, needs, part in zip(*(batch.column(k).to_pylist() for k in range(4))):
            own = strings(part, threshold)
            doc += [d if needs else None] * len(own)
            at += range(start, start + len(own))
            key += own
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(key, pa.binary())], ["doc", "at", "key"])

    ranks = by_batch(asks.where("many = 2").select("doc", "start", "needs", "part"), single, "doc long, at long, key binary")
    again = ranks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    many = ranks.where("doc IS NOT NULL").join(again, "key").select("doc", F.col("at").alias("first"), (F.col("at") + threshold).alias("end"))
    middle = asks.where("many = 1").groupBy("gram").applyInArrow(crowd, "doc long, first long, end long")
    return by_batch(groups.select("parts"), few, "doc long, first long, end long").unionByName(middle).unionByName(many)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, first, end) for every row; the last two are
    the removed runs."""
    found = cut(document_zones(docs, threshold, gram), "zones")
    state = cut(settle(docs, found, ranked_zones(found), threshold), "runs")
    drop_table(found)
    more = repeated_strings(state, threshold).groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("more"))
    waiting = state.where("data IS NOT NULL").select("doc_id", "n_bytes", "first", "end", "data", "doc").join(more, "doc", "left").drop("doc")

    def fn(batch):
        firsts, ends, kept = [], [], []
        for first, end, data, added in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            s, e = merge_spans(np.array([*first, *(m["first"] for m in added or [])], dtype=np.int64), np.array([*end, *(m["end"] for m in added or [])], dtype=np.int64))
            firsts.append(s)
            ends.append(e)
            kept.append(digest(data, s, e))
        return pa.record_batch([batch.column(0), batch.column(1), _lists(firsts, pa.int64()), _lists(ends, pa.int64()), pa.array(kept)], ["doc_id", "n_bytes", "first", "end", "kept_sha256"])

    last = by_batch(waiting, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, first array<long>, end array<long>, kept_sha256 string")
    every = state.where("data IS NULL").select(*last.columns).unionByName(last)
    return every.select(
        "doc_id", "n_bytes", F.aggregate(F.zip_with("first", "end", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("first").cast("long").alias("n_spans"), "kept_sha256", "first", "end",
    )


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir)).drop("first", "end")
