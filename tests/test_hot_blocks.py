"""Blocks bounded in rows where one key and one hour hold most rows; folds over many blocks."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmetrics.operators import folds, jobs, joins, sequence, stats, tables, timeline
from reelmetrics.operators.sequence import BLOCK, Seq

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows, nine tenths of them of one key in one hour, some without a key."""
    rng = random.Random(1)
    rows = []
    for i in range(20_000):
        key, at = (1, rng.random() * 3600) if i % 10 else (rng.choice([None, 2, 3]), rng.random() * 30 * 86400)
        rows.append((key, T0 + datetime.timedelta(seconds=at), i, float(rng.choice([0, 1, 5, 5.5, 1e6])), rng.randrange(1, 100)))
    return spark.createDataFrame(rows, "k int, ts timestamp, id int, v double, size long").repartition(6).cache()


def test_no_block_exceeds_the_target(hot):
    target = 1000
    settled, seq = sequence.settle(hot, Seq(("k",), ("ts", "id"), rows=target))
    sizes = [r["count"] for r in settled.groupBy(BLOCK).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= target and seq.width is not None


def by_key(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(((r["ts"], r["id"]), r[value]))
    return {k: [v for _, v in sorted(rows)] for k, rows in out.items()}


def test_numbers_running_values_and_neighbours(hot):
    seq = Seq(("k",), ("ts", "id"), rows=700)
    numbered = by_key(sequence.number_rows(hot, seq, "n"), "n")
    assert all(v == list(range(len(v))) for v in numbered.values()) and len(numbered) == 4
    sizes = by_key(hot, "size")
    total = by_key(sequence.running(hot, seq, {"sum": ("sum", F.col("size"))}), "sum")
    before = by_key(sequence.adjacent(hot, seq, {"p": "id"}, -1), "p")
    ids = by_key(hot, "id")
    for k, own in sizes.items():
        run, want = 0, []
        for s in own:
            run += s
            want.append(run)
        assert total[k] == want and before[k] == [None, *ids[k][:-1]]


def test_percentiles_queue_and_eviction(hot, rows):
    wide = hot.withColumn("x", F.col("id") * 1.0)
    ps = {"a": 0.05, "m": 0.5, "z": 0.99}
    small = stats.exact_percentiles(wide, ("k",), "x", ps, rows=500)
    assert rows(small) == rows(stats.exact_percentiles(wide, ("k",), "x", ps, rows=None, width=None))
    queue = hot.select(F.lit("q").alias("q"), (F.col("id") % 3).alias("urgency"), "ts", "id")
    places = {r["id"]: r["queue_position"] for r in jobs.queue_positions(queue, ("q",), "urgency", "ts", "id", rows=900).collect()}
    order = sorted(queue.collect(), key=lambda r: (r["urgency"], r["ts"], r["id"]))
    assert places == {r["id"]: k + 1 for k, r in enumerate(order)}
    listed = {r["id"] for r in tables.eviction_list(hot, ["ts", "id"], "size", 50_000, rows=900).collect()}
    freed, want = 0, set()
    for r in sorted(hot.collect(), key=lambda r: (r["ts"], r["id"])):
        if freed >= 50_000:
            break
        want.add(r["id"])
        freed += r["size"]
    assert listed == want


# --- folds -------------------------------------------------------------------------------------
def passes_of(monkeypatch):
    seen = []
    real = folds.by_group
    monkeypatch.setattr(folds, "by_group", lambda *a, **k: seen.append(1) or real(*a, **k))
    return seen


def test_scenes_that_never_agree_take_few_passes(spark, monkeypatch):
    """Scenes of equal length merge three by three, so every block is entered in another phase."""
    passes = passes_of(monkeypatch)
    scenes = spark.range(64 * 4).select(F.lit(1).alias("v"), (F.col("id") * 10).alias("start_frame"), (F.col("id") * 10 + 9).alias("end_frame"), F.lit("a").alias("transition_in"), F.lit("b").alias("transition_out"))
    out = folds.merge_short_scenes(scenes, ("v",), 25, 40)
    got = sorted((r["start_frame"], r["end_frame"]) for r in out.collect())
    assert got[:-1] == [(k * 30, k * 30 + 29) for k in range(84)] and got[-1] == (2520, 2559)
    assert len(passes) <= 8


def test_anchor_that_passes_many_blocks(spark, monkeypatch):
    """Frames that all differ, but hardly: the first one stays the anchor across 64 blocks."""
    passes = passes_of(monkeypatch)
    hashes = [(1 << (i % 40)) | (1 << 50) for i in range(64 * 4)]
    hashes[0], hashes[200] = 1 << 50, (1 << 62) - 1
    df = spark.createDataFrame([(1, i, [h]) for i, h in enumerate(hashes)], "v int, frame_no long, hash array<long>")
    got = {r["frame_no"]: r["unique_frame"] for r in folds.anchored_dedup(df, Seq(("v",), ("frame_no",), 4), "hash", 0.95).collect()}
    want, anchor = {}, None
    for i, h in enumerate(hashes):
        if anchor is None or 1 - (hashes[anchor] ^ h).bit_count() / 64 < 0.95:
            anchor = i
        want[i] = anchor
    assert got == want and len(set(want.values())) == 3
    assert len(passes) <= 8


def test_groups_that_span_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        df = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(100)], "k int, n long")
        got = folds.by_group(df, ["k"], ["n"], lambda c: [[c["k"][0]], [sum(c["n"])], [len(c["n"])]], "k int, s long, c int").collect()
    finally:
        spark.conf.set(name, before)
    want = {}
    for k in range(100):
        want.setdefault(k % 3 if k % 5 else None, []).append(k)
    assert {r["k"]: (r["s"], r["c"]) for r in got} == {k: (sum(v), len(v)) for k, v in want.items()} and len(got) == 4


def plain_ema(xs, alpha):
    avg, out = 0.0, []
    for x in xs:
        avg = x if avg == 0 else alpha * x + (1 - alpha) * avg
        out.append(avg)
    return out


@pytest.mark.parametrize("alpha, stretch", [(0.1, 4), (0.5, 3), (0.1, 256), (1.0, 5)])
def test_averages_over_many_stretches(spark, alpha, stretch):
    """Zeros in front, zeros between, values that cancel out to exactly zero, a hundred stretches."""
    rng = random.Random(4)
    series = {
        1: [0.0] * 9 + [rng.random() * 9 for _ in range(300)],
        2: [1.0, -1.0, 3.0, 4.0, -3.5, 5.0, *[rng.random() for _ in range(20)]],
        3: [0.0] * 30,
        4: [5.0] + [0.0] * 60 + [2.0, 0.0],
        None: [rng.random() - 0.5 for _ in range(50)],
    }
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "v int, n long, x double")
    got = {}
    for r in folds.moving_ema(df, Seq(("v",), ("n",), 16), "x", alpha, stretch=stretch).collect():
        got.setdefault(r["v"], {})[r["n"]] = r["ema"]
    assert set(got) == set(series)
    for k, xs in series.items():
        assert [got[k][i] for i in range(len(xs))] == pytest.approx(plain_ema(xs, alpha), rel=1e-9, abs=1e-300)


# --- sums of products at all lags --------------------------------------------------------------
@pytest.mark.parametrize("whole", [1 << 16, 8])
def test_lag_sums_equal_direct_ones(spark, whole):
    rng = np.random.default_rng(3)
    series = {1: rng.normal(size=300).tolist(), 2: [1.0], 3: np.sin(np.arange(500) / 7).tolist(), None: rng.normal(size=40).tolist()}
    series[4] = [None if k % 3 == 0 or k > 50 else float(k) for k in range(90)]
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "v int, n long, x double").repartition(4)
    got = {}
    for r in timeline.lag_sums(df, Seq(("v",), ("n",), 64), "x", whole, 4).collect():
        got.setdefault(r["v"], {})[r["_lag"]] = r["_s"]
    for k, xs in series.items():
        assert sorted(got[k]) == list(range(len(xs)))
        for lag in range(len(xs)):
            pairs = [a * b for a, b in zip(xs, xs[lag:]) if a is not None and b is not None]
            assert (got[k][lag] is None) == (not pairs)
            assert not pairs or got[k][lag] == pytest.approx(sum(pairs), abs=1e-8)


def test_a_million_frames_of_one_key(spark):
    df = spark.range(1 << 20).select(F.lit(1).alias("v"), F.col("id").alias("n"), F.sin(F.col("id") * 2 * F.pi() / 45).alias("x"))
    sums = timeline.lag_sums(df, Seq(("v",), ("n",), 1 << 17), "x")
    assert sums.count() == 1 << 20
    some = {r["_lag"]: r["_s"] for r in sums.where("_lag < 100").collect()}
    x = np.sin(np.arange(1 << 20) * 2 * np.pi / 45)
    for lag in (0, 1, 22, 45, 99):
        assert some[lag] == pytest.approx(float(x[: len(x) - lag] @ x[lag:]), rel=1e-9)
    assert timeline.periodic_motion(df, Seq(("v",), ("n",), 1 << 17), "x").first()["periodic"]


# --- offers ------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [3, 64])
def test_cheapest_offers_equal_brute_force(spark, block):
    """Needs that few blocks meet, that blocks seem to meet and do not, and that nothing meets."""
    rng = random.Random(block)
    offers = [(k, rng.choice(["A", "A", "A", "B", None]), float(rng.randrange(30)), float(rng.choice([1, 2, 4, 900])), float(rng.choice([5, 6, 70]))) for k in range(400)]
    wanted = [(m, float(a), float(b)) for m in ("A", "B", "C", None) for a in (0, 2, 3, 900, 901) for b in (0, 6, 70)]
    odf = spark.createDataFrame(offers, "offer_id int, model string, price double, gb double, disk_gb double")
    wdf = spark.createDataFrame(wanted * 2, "model string, _gb double, _disk_gb double")
    for keys in (["model"], []):
        rows = joins.cheapest_offers(wdf.select(*keys, "_gb", "_disk_gb"), odf, keys, ["gb", "disk_gb"], 4, block).collect()
        got = {}
        for r in rows:
            got.setdefault((*(r[c] for c in keys), r["_gb"], r["_disk_gb"]), []).append((r["offer_rank"], r["offer_id"], r["price"]))
        want = {}
        for m, a, b in wanted:
            fit = sorted((p, i) for i, om, p, g, d in offers if g >= a and d >= b and (not keys or (om is not None and om == m)))[:4]
            if fit:
                want[(m, a, b) if keys else (a, b)] = [(n + 1, i, p) for n, (p, i) in enumerate(fit)]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_rows_met_grow_with_sets_times_k(spark, monkeypatch):
    """Ten thousand offers that fit: a set reads the first block only."""
    read = []
    kept = joins.durable_checkpoint
    monkeypatch.setattr(joins, "durable_checkpoint", lambda df: read.append(kept(df)) or read[-1])
    offers = spark.range(10_000).select(F.col("id").alias("offer_id"), F.lit("A").alias("model"), F.col("id") * 1.0, F.lit(8.0).alias("gb")).toDF("offer_id", "model", "price", "gb")
    wanted = spark.range(100).select(F.lit("A").alias("model"), (F.col("id") % 8 * 1.0).alias("_gb"))
    out = joins.cheapest_offers(wanted, offers, ["model"], ["gb"], 5)
    assert out.count() == 8 * 5
    plans = [df for df in read if "_read" in df.columns]
    assert len(plans) == 1 and plans[0].select(F.sum(F.size("_read"))).first()[0] == 8
