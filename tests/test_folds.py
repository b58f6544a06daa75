"""Order-dependent folds: block-wise rounds must equal one pass over each key."""

import random

import pytest
from pyspark.sql import functions as F

from reelmetrics.operators import folds
from reelmetrics.operators.sequence import Seq
from reelmetrics.streaming.live import limit_table


def fade(n):
    """A slow fade (one more bit per frame) after a still stretch."""
    return [0] * (n // 2) + [(1 << i) - 1 for i in range(1, n - n // 2 + 1)]


def brute_dedup(hashes, threshold):
    out, anchor = [], None
    for i, h in enumerate(hashes):
        if anchor is None or 1 - (hashes[anchor] ^ h).bit_count() / 64 < threshold:
            anchor = i
        out.append(anchor)
    return out


@pytest.mark.parametrize("width", [4, 16, None])
def test_anchored_dedup_compares_with_last_kept(spark, width):
    rng = random.Random(3)
    videos = {1: fade(60), 2: [rng.choice([0, 1, 3, 7, 255, 2**40 - 1]) for _ in range(50)], 3: [5]}
    df = spark.createDataFrame([(v, i, [h]) for v, hs in videos.items() for i, h in enumerate(hs)], "v int, frame_no long, hash array<long>")
    out = folds.anchored_dedup(df, Seq(("v",), ("frame_no",), width), "hash", 0.95)
    got = {}
    for r in out.orderBy("v", "frame_no").collect():
        got.setdefault(r["v"], []).append(r["unique_frame"])
        assert r["is_duplicate"] == (r["unique_frame"] != r["frame_no"])
    for v, hs in videos.items():
        assert got[v] == brute_dedup(hs, 0.95)
    # Neighbours in the fade differ by one bit only, yet the anchored rule keeps several frames.
    assert len(set(got[1])) > 3


def merge_brute(scenes, least):
    out, cur = [], list(scenes[0])
    for s in scenes[1:]:
        if cur[1] - cur[0] + 1 < least:
            cur[1] = s[1]
        else:
            out.append(tuple(cur))
            cur = list(s)
    if cur[1] - cur[0] + 1 >= least or not out:
        out.append(tuple(cur))
    else:
        out[-1] = (out[-1][0], cur[1])
    return out


@pytest.mark.parametrize("width", [32, None])
def test_merge_short_scenes(spark, width):
    rng = random.Random(5)
    cases = {1: [(0, 9), (10, 29), (30, 34), (35, 99)], 2: [(0, 3)], 3: []}
    at = 0
    for _ in range(70):
        n = rng.choice([1, 2, 3, 18, 40])
        cases[3].append((at, at + n - 1))
        at += n
    data = [(v, a, b, "hard_cut", "fade") for v, xs in cases.items() for a, b in xs]
    df = spark.createDataFrame(data, "v int, start_frame long, end_frame long, transition_in string, transition_out string")
    out = folds.merge_short_scenes(df, ("v",), 20, width)
    got = {}
    for r in out.orderBy("v", "start_frame").collect():
        got.setdefault(r["v"], []).append((r["start_frame"], r["end_frame"]))
    for v, xs in cases.items():
        assert got[v] == merge_brute(xs, 20)
    assert got[1] == [(0, 29), (30, 99)]


@pytest.mark.parametrize("width", [5, None])
def test_ema_restarts_at_zero(spark, width):
    xs = [0.0, 0.0, 4.0, 2.0] + [0.0] * 30 + [9.0, 1.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "v int, frame_no long, x double")
    out = folds.moving_ema(df, Seq(("v",), ("frame_no",), width), "x", 0.1)
    got = [r["ema"] for r in out.orderBy("frame_no").collect()]
    avg, want = 0.0, []
    for x in xs:
        avg = x if avg == 0 else 0.1 * x + 0.9 * avg
        want.append(avg)
    assert got == want


def test_merge_boxes_block_edges(spark):
    boxes = [(1, i, 0.0, float(i * 4), 10.0, 12.0) for i in range(12)] + [(1, 12, 500.0, 100.0, 5.0, 5.0)]
    df = spark.createDataFrame(boxes, "v int, frame_no long, x double, y double, w double, h double")
    for width in (3, None):
        out = folds.merge_boxes(df, Seq(("v",), ("frame_no",), width)).orderBy("box_no").collect()
        assert [(r["y"], r["h"], r["n_boxes"]) for r in out] == [(0.0, 56.0, 12), (100.0, 5.0, 1)]


@pytest.mark.parametrize("width", [20.0, None])
def test_rate_limit_and_progress_gap(spark, width):
    sends = [("a", i, i * 0.9, False) for i in range(80)] + [("b", 100 + i, i * 4.0, True) for i in range(10)]
    df = spark.createDataFrame(sends, "endpoint string, event_id int, second double, progress boolean")
    out = limit_table(df, ["endpoint"], "event_id", "second", "progress", width=width)
    got = {(r["endpoint"], r["event_id"]): r["verdict"] for r in out.collect()}
    # 60 sends fit in the first minute (0 .. 53.1 s); the 61st has to wait until the first one is 60 s old.
    verdicts = [got[("a", i)] for i in range(80)]
    assert verdicts[:60] == ["sent"] * 60 and verdicts[60] == "rate_limited" and verdicts[67] == "sent"
    # progress every 4 s: sent at 0, then the first one at least 10 s later (12, 24, 36).
    assert [i for i in range(10) if got[("b", 100 + i)] == "sent"] == [0, 3, 6, 9]
