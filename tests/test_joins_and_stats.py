"""Joins, statistics and rules on small literal tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmetrics.functions import rules as R
from reelmetrics.functions import timecode as tc
from reelmetrics.operators import ab, joins, rollups
from reelmetrics.operators.sequence import Seq
from reelmetrics.operators.stats import exact_percentiles, paired_test


def offsets_brute(audio, video, max_ms, step, tol):
    best = (0, 0)
    for o in range(-max_ms, max_ms, step):
        n = sum(any(abs(a + o * 1000 - v) < tol * 1000 for v in video) for a in audio)
        if n > best[1]:
            best = (o, n)
    return float(best[0]), best[1] / len(audio)


def test_best_offset_matches_brute_force(spark):
    rng = random.Random(2)
    base = sorted(rng.sample(range(0, 30_000_000), 25))
    cases = {1: (base, [t + 45_000 for t in base]), 2: ([1_000_000], [9_000_000]), 3: (base, [t + rng.randint(-90_000, 200_000) for t in base]), 4: (base, [base[0]] * 40 + [base[0] + 30_000])}
    audio = spark.createDataFrame([(k, t) for k, (a, _) in cases.items() for t in a], "v int, t long")
    video = spark.createDataFrame([(k, t) for k, (_, b) in cases.items() for t in b], "v int, t long")
    out = {r["v"]: (r["offset_ms"], r["score"]) for r in joins.best_offset(audio, video, ("v",), "t", width_us=5_000_000).collect()}
    for k, (a, b) in cases.items():
        assert out[k] == pytest.approx(offsets_brute(a, b, 500, 1, 50)), k
    assert out[2] == (0.0, 0.0)


def test_nearest_and_interpolated_anchors(spark):
    frames = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 3)], "v int, frame_no long")
    anchors = spark.createDataFrame([(1, 2, [0.0, 10.0]), (1, 6, [8.0, 2.0])], "v int, frame_no long, vec array<double>")
    for width in (3, None):
        seq = Seq(("v",), ("frame_no",), width)
        near = {(r["v"], r["frame_no"]): r["anchor_pos"] for r in joins.nearest_anchor(frames, anchors, seq, []).collect()}
        assert [near[(1, i)] for i in (0, 2, 4, 5, 11)] == [2, 2, 2, 6, 6] and near[(2, 3)] is None
        mid = {(r["v"], r["frame_no"]): r["vec"] for r in joins.interpolate_anchors(frames, anchors, seq, "vec").collect()}
        assert mid[(1, 0)] == [0.0, 10.0] and mid[(1, 3)] == [2.0, 8.0] and mid[(1, 9)] == [8.0, 2.0]


def test_box_pairs_once_across_cells(spark):
    a = spark.createDataFrame([(1, 1, 10, 10, 200, 200)], "f int, box_id int, x int, y int, w int, h int")
    b = spark.createDataFrame([(1, 7, 60, 60, 200, 200), (1, 8, 500, 500, 5, 5)], "f int, box_id int, x int, y int, w int, h int")
    out = joins.box_pairs(a, b, ["f"], 32).collect()
    assert len(out) == 1 and out[0]["iou"] == pytest.approx(150 * 150 / (2 * 200 * 200 - 150 * 150))


def test_rate_lookup_order_and_miss(spark, rows):
    rates = spark.createDataFrame([("p", "RTX_4090", 2.0, 0), ("p", "RTX_4080", 1.0, 1), ("p", "A100_80GB", 3.0, 2)], "provider string, gpu_name string, usd_hour double, pos int")
    df = spark.createDataFrame([("p", "RTX_4080"), ("p", "RTX_40"), ("p", "A100"), ("p", "T4"), ("q", "T4")], "pr string, gpu string")
    assert rows(joins.rate_lookup(df, rates, "pr", "gpu"), "pr", "gpu", "usd_hour") == [
        ("p", "A100", 3.0), ("p", "RTX_40", 2.0), ("p", "RTX_4080", 1.0), ("p", "T4", None), ("q", "T4", None),
    ]


def test_offers_fall_back_to_any_model(spark, rows):
    jobs = spark.createDataFrame([(1, "A", 8, 9.0), (2, "Z", 8, 9.0), (3, "A", 64, 9.0)], "job_id int, model string, min_gb int, max_price double")
    offers = spark.createDataFrame([(1, "A", 16, 2.0), (2, "B", 24, 1.0), (3, "A", 4, 0.5)], "offer_id int, model string, gb int, price double")
    assert rows(joins.suitable_offers(jobs, offers), "job_id", "offer_id", "any_model") == [(1, 1, False), (2, 1, True), (2, 2, True)]


def test_exact_percentiles_on_one_hot_key(spark):
    rng = np.random.default_rng(1)
    hot, small = rng.normal(50, 20, 3000).round(2), [3.0, 1.0]
    df = spark.createDataFrame([(1, float(x)) for x in hot] + [(2, x) for x in small] + [(2, None)], "k int, x double")
    out = {r["k"]: r for r in exact_percentiles(df, ("k",), "x", {"a": 0.05, "m": 0.5, "z": 0.99}, 5.0).collect()}
    assert [out[1][n] for n in "amz"] == pytest.approx(list(np.percentile(hot, [5, 50, 99])))
    assert out[2]["m"] == 2.0


def test_paired_t_known_values(spark):
    # Differences 1, 0, 1, 0, 2: mean .8, s = .83666, t = .8 / (s / sqrt 5) = 2.13809; four degrees of freedom.
    df = spark.createDataFrame([(1, a, b) for a, b in zip([1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 4.0, 4.0, 7.0])] + [(2, 1.0, 1.5), (2, 2.0, 2.5)], "k int, a double, b double")
    out = {r["k"]: r for r in paired_test(df, ("k",), "a", "b").collect()}
    assert out[1]["t_stat"] == pytest.approx(2.1380899)
    assert out[1]["p_value"] == pytest.approx(0.0993, abs=2e-4) and not out[1]["significant"]
    assert out[2]["p_value"] is None and out[2]["significant"]


def test_paired_t_of_equal_differences(spark):
    data = [(1, 1.0, 1.5), (2, 1.0, 3.0), (2, 2.0, 4.0), (3, 3.0, 1.0), (3, 2.0, 0.0), (4, 1.0, 1.0), (4, 2.0, 2.0), (5, 0.1, 0.3), (5, 0.3, 0.1 + 0.4)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    out = {r["k"]: r for r in paired_test(df, ("k",), "a", "b", fallback=False).collect()}
    assert (out[1]["t_stat"], out[1]["p_value"], out[1]["significant"]) == (None, None, None)
    assert (out[2]["t_stat"], out[2]["p_value"], out[2]["significant"]) == (float("inf"), 0.0, True)
    assert (out[3]["t_stat"], out[3]["p_value"], out[3]["significant"]) == (float("-inf"), 0.0, True)
    assert (out[5]["t_stat"], out[5]["p_value"], out[5]["significant"]) == (float("inf"), 0.0, True)
    assert np.isnan(out[4]["t_stat"]) and np.isnan(out[4]["p_value"]) and out[4]["significant"] is False


def test_gates_skip_missing_inputs(spark, rows):
    ddl = "v int, avg_psnr double, avg_ssim double, total_frames long, failed long, black long, blurry long, bitrate long, size_mb double"
    data = [(1, 35.0, 0.95, 100, 0, 0, 0, 5_000_000, 10.0), (2, 30.0, None, None, None, None, None, None, None), (3, 20.0, 0.99, 100, 2, 6, 0, 900_000, 10.0)]
    df = spark.createDataFrame(data, ddl)
    gates = rollups.quality_gates(df, ["v"], rollups.GATE_LIMITS)
    assert rows(rollups.gate_decision(gates, ["v"]), "v", "decision") == [(1, "pass"), (2, "warn"), (3, "fail")]
    assert {r["gate"] for r in gates.where("v = 3").collect()} == {"psnr", "ssim", "failed_frames", "black_frames", "bitrate"}


def test_trend_labels(spark):
    xs = {"up": [1.0, 2.0, 3.0, 4.0], "flat": [5.0] * 4, "down": [4.0, 3.0, None, 1.0], "one": [1.0]}
    df = spark.createDataFrame([(k, i, x) for k, v in xs.items() for i, x in enumerate(v)], "k string, i int, x double")
    out = {r["k"]: r["trend"] for r in rollups.metric_trends(df, ["k"], ["i"], ["x"], 2).collect()}
    assert out == {"up": "improving", "flat": "stable", "down": "declining", "one": "stable"}


def test_winner_ties_keep_first(spark):
    df = spark.createDataFrame([(1, "b", 0, 30.0, 0.9, 80.0, 0), (1, "a", 1, 30.0, 0.9, 80.0, 0)], "t int, name string, pos int, avg_psnr double, avg_ssim double, avg_vmaf double, votes int")
    row = ab.winners(df, ["t"], "name", "pos").first()
    assert row["winner_by_psnr"] == "b" and row["overall_winner"] == "b" and row["winner_by_votes"] is None


def test_scene_rules(spark):
    data = [(0.9, 0.05, 0.0, False, "static"), (0.9, 0.7, 0.0, False, "action"), (0.9, 0.3, 0.8, True, "dialog"), (0.2, 0.7, 0.8, True, "low_quality"), (0.9, 0.3, 0.0, False, "unknown")]
    df = spark.createDataFrame(data, "quality double, motion double, face double, has boolean, want string")
    out = df.select(R.scene_type(F.col("quality"), F.col("motion"), F.col("face"), F.col("has")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in out)


def test_timecode_round_trip(spark):
    df = spark.range(0, 300_000, 37)
    plain = df.select("id", tc.timecode_to_frames(tc.frames_to_timecode(F.col("id"), 24.0), 24.0).alias("back"))
    assert plain.where("id <> back").count() == 0
    row = spark.range(1).select(tc.timecode_to_frames(F.lit("00:01:00;02"), 29.97).alias("a"), tc.timecode_to_frames(F.lit("00:10:00;00"), 29.97).alias("b")).first()
    assert row["a"] == 60 * 29 + 2 - 2 and row["b"] == 600 * 29 - 18


def test_bottleneck_of_equal_sums_is_the_first_stage(spark):
    data = [(1, 1, "a", 0.3), (1, 2, "b", 0.1 + 0.2), (2, 1, "a", 0.3), (2, 2, "b", 0.31)]
    df = spark.createDataFrame(data, "run int, stage_pos int, stage string, duration_s double").selectExpr("*", "1L AS frames", "1D AS peak_memory_mb", "1D AS gpu_util")
    got = {r["run"]: r["bottleneck_stage"] for r in rollups.profile_summary(df, ["run"]).collect()}
    assert got == {1: "a", 2: "b"}


def test_mean_at_its_limit_is_not_throttled(spark, tmp_path):
    from reelmetrics.plans import QUERIES

    # The mean is 0.04; summed in this order it comes out as 0.04000000000000001, in the SQL too.
    taxes = [0.04, 0.06, 0.05, 0.04, 0.02, 0.01, 0.07, 0.02, 0.07, 0.02]
    data = [(sk, tax if sk == 1 else tax + 0.01, 0.1) for sk in (1, 2) for tax in taxes]
    df = spark.createDataFrame(data, "l_suppkey long, l_tax double, l_discount double").coalesce(1).selectExpr(
        "l_suppkey AS l_orderkey", "1 AS l_linenumber", "1L AS l_partkey", "*", "5D AS l_quantity", "9D AS l_extendedprice",
        "'N' AS l_returnflag", "'O' AS l_linestatus", "TIMESTAMP '2020-01-01' AS l_shipdate")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["A32_benchmark_leaders"](spark, str(tmp_path)).collect()
    assert {r["sk"]: r["throttled_runs"] for r in out} == {1: 0, 2: 1}
