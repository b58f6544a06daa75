"""Literal cases for window operators, with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from reelmetrics.operators import timeline as tl
from reelmetrics.operators.rollups import shake_severity
from reelmetrics.operators.sequence import Seq

SEQ = Seq(("v",), ("frame_no",), 8)


def frames(spark, cols, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_scene_build(spark, rows):
    data = [(1, i, i in (50, 100), "fade" if i == 100 else "hard_cut") for i in range(150)]
    df = spark.createDataFrame(data, "v int, frame_no long, cut boolean, kind string")
    out = tl.scene_segments(df, SEQ, F.col("cut"), F.col("kind"))
    assert rows(out, "start_frame", "end_frame", "transition_in", "transition_out") == [
        (0, 49, "hard_cut", "hard_cut"), (100, 149, "fade", "hard_cut"), (50, 99, "hard_cut", "fade"),
    ]


def test_cut_on_last_frame_gives_a_scene(spark, rows):
    df = spark.createDataFrame([(1, i, i == 9) for i in range(10)], "v int, frame_no long, cut boolean")
    assert rows(tl.scene_segments(df, SEQ, F.col("cut")), "start_frame", "end_frame") == [(0, 8), (9, 9)]


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 6])
def test_moving_average_alignment(spark, window):
    xs = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0, 7.0, 6.0, 0.0, 2.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "v int, frame_no long, x double")
    out = tl.moving_average(df, SEQ, {"m": "x"}, window).orderBy("frame_no").collect()
    pad = window // 2
    padded = [xs[0]] * pad + xs + [xs[-1]] * pad
    want = [sum(padded[i : i + window]) / window for i in range(len(xs))]
    assert [r["m"] for r in out] == pytest.approx(want)


def test_motion_still_and_shaky(spark):
    still = [(1, i, 0.0, 0.0, 0.0) for i in range(10)]
    shaky = [(2, i, 50 * math.sin(0.5 * i), 50 * math.cos(0.5 * i), 0.1 * math.sin(0.3 * i)) for i in range(20)]
    df = spark.createDataFrame(still + shaky, "v int, frame_no long, dx double, dy double, rotation double")
    sev = {r["v"]: r["severity"] for r in shake_severity(df, SEQ).collect()}
    assert sev[1] == 0.0 and 0 < sev[2] <= 1
    segs = tl.shaky_segments(df, SEQ, "dx", "dy", "rotation").collect()
    assert [(r["v"], r["start_frame"], r["end_frame"]) for r in segs] == [(2, 0, 19)]


def test_sequence_gaps(spark, rows):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 5, 6, 8, 9, 10)] + [(2, n) for n in range(1, 11)], "v int, frame_no long")
    seq = Seq(("v",), ("frame_no",), 4)
    report = {r["v"]: r for r in tl.sequence_report(df, ("v",), "frame_no").collect()}
    assert report[1]["missing_count"] == 2 and not report[1]["is_complete"] and report[2]["is_complete"]
    assert rows(tl.missing_numbers(df, seq)) == [(1, 4), (1, 7)]
    expected = spark.createDataFrame([(1, 14), (2, 11)], "v int, expected_count int")
    gaps = tl.frame_gaps(df, seq, 10, expected)
    assert rows(gaps, "v", "start_frame", "gap_size", "is_tail") == [(1, 10, 3, True), (1, 3, 1, False), (1, 6, 1, False)]


def test_text_cues(spark, rows):
    data = [(1, 0, "Hi", 0.9), (1, 1, "Hi", 0.9), (1, 2, "noise", 0.1), (1, 3, "Hi", 0.9), (1, 4, "Bye", 0.9), (1, 5, "", 0.9)]
    df = spark.createDataFrame(data, "v int, frame_no long, text string, conf double")
    totals = spark.createDataFrame([(1, 10)], "v int, total_frames int")
    out = tl.text_cues(df, SEQ, "text", "conf", totals, 2.0)
    assert rows(out, "cue_index", "text", "start_s", "end_s") == [(1, "Hi", 0.0, 2.0), (2, "Bye", 2.0, 5.0)]


def test_silence_pairs(spark, rows):
    lines = ["silence_start: 1.5", "frame", "silence_end: 4.5 | silence_duration: 3.0", "silence_end: 9", "silence_start: 10", "silence_start: 20", "silence_end: 32"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "v int, frame_no long, line string")
    out = tl.silence_intervals(df, SEQ, "line")
    assert rows(out, "start_s", "end_s", "severity") == [(1.5, 4.5, "low"), (20.0, 32.0, "high")]


def test_transition_types(spark):
    """A monotone stretch that trips the similarity arm is a fade; a jump is a hard cut."""
    base = [(1, 0, None, None)] + [(1, i, 0.01, 1.0) for i in range(1, 40)]
    diffs = {15: (0.9, 0.2)}
    data = [(v, i, *(diffs.get(i, (d, s)))) for v, i, d, s in base]
    rise = [(2, 0, None, None)] + [(2, i, 0.1 + 0.01 * i, 0.6 if i == 12 else 0.9) for i in range(1, 22)]
    df = spark.createDataFrame(data + rise, "v int, frame_no long, hist_diff double, ssim double")
    out = tl.transition_types(df, Seq(("v",), ("frame_no",), 16), tl.is_cut())
    got = {(r["v"], r["frame_no"]): r["transition"] for r in out.where("transition is not null").collect()}
    assert got[(1, 15)] == "hard_cut" and got[(2, 12)] == "fade"


def test_film_cadence(spark):
    level, values = 0.0, [0.0]
    for i in range(30):
        level += 0.1 if i % 5 in (1, 3) else 10.0
        values.append(level)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "v int, frame_no long, x double")
    row = tl.film_cadence(df, SEQ, "x", 30.0).first()
    assert row["duplicate_ratio"] == pytest.approx(0.4) and row["pattern"] == "3:2"


def test_periodic_motion_takes_all_lags(spark):
    def series(key, n):
        if key is None:
            return [3.0] * n
        if key < 0:
            return [float((f * f * 7919) % 23 - 11) if f % 9 or n > 90 else None for f in range(n)]
        return [9 * math.sin(2 * math.pi * f / key) for f in range(n)]

    def brute(x):
        sums = []
        for lag in range(len(x)):
            both = [a * b for a, b in zip(x, x[lag:]) if a is not None and b is not None]
            sums.append(sum(both) if both else None)
        tops = [(sums[k], k) for k in range(1, len(x) - 1) if None not in sums[k - 1 : k + 2] and sums[k] > max(sums[k - 1], sums[k + 1]) + 1e-9]
        kept = []
        for _, k in sorted(tops, reverse=True):
            if all(abs(k - other) >= 5 for other in kept):
                kept.append(k)
        return len(kept) > 3

    sizes = {16: 400, 20: 400, 30: 400, 60: 400, 150: 400, 9: 200, 8: 30, 12: 1, -1: 60, -2: 100, None: 300}
    values = {key: series(key, n) for key, n in sizes.items()}
    df = spark.createDataFrame([(key, f, v) for key, x in values.items() for f, v in enumerate(x)], "video_id int, frame_no int, dy double")
    want = {key: brute(x) for key, x in values.items()}
    assert all(want[period] for period in (16, 20, 30, 60)) and not want[None] and not want[150]
    for options in ({}, {"block": 7}, {"block": 64}):
        got = {r["video_id"]: r["periodic"] for r in tl.periodic_motion(df, Seq(("video_id",), ("frame_no",), 100), "dy", **options).collect()}
        assert got == want


@pytest.mark.parametrize("width", [4, 50, None])
def test_merge_intervals_over_blocks_and_odd_rows(spark, rows, width):
    seq = Seq(("v",), ("s", "tie"), width)
    ddl = "v int, s long, e long, tie string"
    long = [(1, 0, 30, "a"), (1, 5, 6, "b"), (1, 14, 15, "c"), (1, 30, 31, "d"), (1, 32, 33, "e"), (None, 3, 3, "f")]
    out = tl.merge_intervals(spark.createDataFrame(long, ddl), seq, "s", "e")
    assert rows(out, "v", "s", "e", "n") == [(1, 0, 31, 4), (1, 32, 33, 1), (None, 3, 3, 1)]
    # An interval that ends before its start opens a group of its own unless an earlier row reaches it; a row
    # without a start comes last.
    odd = [(1, 10, 5, "a"), (1, 10, 12, "b"), (1, 10, 7, "c"), (1, 20, None, "d"), (1, None, None, "e")]
    out = tl.merge_intervals(spark.createDataFrame(odd, ddl), seq, "s", "e")
    assert rows(out, "v", "s", "e", "n") == [(1, 10, 12, 2), (1, 10, 5, 1), (1, 20, None, 2)]


def test_merge_intervals_shuffles_no_tie_columns(spark):
    tie = F.md5(F.col("id").cast("string"))
    df = spark.range(40_000).select((F.col("id") % 7).alias("v"), "id", (F.col("id") + 3).alias("e"), tie.alias("tie"))

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert tl.merge_intervals(df, Seq(("v",), ("id", "tie"), 10_000), "id", "e").count() == 40_000
    assert shuffled() - before < 40_000 * 32


def test_missing_numbers_of_long_gaps_come_in_pieces(spark):
    ends = [(1, 0), (1, 5000), (1, 5002), (2, 7), (2, 9), (2, 9), (None, 1), (None, 3)]
    out = tl.missing_numbers(spark.createDataFrame(ends, "v int, frame_no long"), Seq(("v",), ("frame_no",), 64))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([(1, n) for n in range(1, 5000)] + [(1, 5001), (2, 8), (None, 2)], key=repr)


def test_missing_numbers_lie_close_together_in_a_task(spark):
    rows = spark.range(200).select((F.col("id") / 2).cast("long").alias("v"), ((F.col("id") % 2) * 300 + F.col("id") * 50).alias("n"))
    out = tl.missing_numbers(rows, Seq(("v",), ("n",))).withColumn("task", F.spark_partition_id())
    spans = out.groupBy("task").agg((F.max("missing_frame") - F.min("missing_frame")).alias("w")).collect()
    assert len(spans) > 1 and max(r["w"] for r in spans) < 6000


def test_missing_numbers_of_odd_rows(spark):
    block, top = tl.MISSING_BLOCK, 2**31 - 1
    data = [(1, n) for n in (-block - 3, -block, -1, 0, 0, 0, 2, block - 1, block, block + 2, 5 * block)] + [(1, None), (2, top), (2, top - 2), (2, top), (3, 4), (4, None), (None, 255), (None, 257), (None, 3 * block - 1)]
    own = {}
    for v, n in data:
        if n is not None:
            own.setdefault(v, set()).add(n)
    want = sorted(((v, n) for v, ns in own.items() for n in range(min(ns), max(ns)) if n not in ns), key=repr)
    out = tl.missing_numbers(spark.createDataFrame(data, "v int, n int").repartition(3), Seq(("v",), ("n",)))
    assert out.dtypes == [("v", "int"), ("missing_frame", "int")]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_missing_numbers_take_little_room_in_files(spark, tmp_path):
    rows = spark.range(120_000).select((F.col("id") % 200).alias("v"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("n"))
    out = tl.missing_numbers(rows, Seq(("v",), ("n",)))
    out.write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.8 * spark.read.parquet(str(tmp_path / "out")).count()


def test_gaps_of_any_length_are_found(spark):
    df = spark.createDataFrame([(1, 0), (1, 2**33)], "v int, frame_no long")
    gaps = tl.frame_gaps(df, Seq(("v",), ("frame_no",)), None).collect()
    assert [r["gap_size"] for r in gaps] == [2**33 - 1]
