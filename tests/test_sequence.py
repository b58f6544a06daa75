"""Blocked results must equal plain windows, also for a key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from reelmetrics.operators.sequence import Seq, framed, neighbours, number_rows, running, segments, surrounding


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    data = []
    for video, n in ((1, 120), (2, 9), (3, 1), (4, 40)):
        at = 0
        for i in range(n):
            at += rng.choice([1, 1, 1, 7, 30])
            data.append((video, at, i, rng.choice([None, float(rng.randint(-9, 9))]), rng.random() < 0.2))
    df = spark.createDataFrame(data, "v int, at long, pos long, x double, cut boolean")
    return df.cache()


PLAIN, BLOCKED = Seq(("v",), ("at",), None), Seq(("v",), ("at",), 16)
DENSE, DENSE_BLOCKED = Seq(("v",), ("pos",), None), Seq(("v",), ("pos",), 8)


def test_number_rows(table, rows):
    out = number_rows(table, BLOCKED, "n")
    assert rows(out, "v", "at", "n") == rows(table, "v", "at", "pos")


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(table, rows, reverse, inclusive):
    spec = {f"r_{h}": (h, F.col("x")) for h in ("sum", "count", "min", "max", "last")}
    cols = ["v", "at", *spec]
    a = running(table, PLAIN, spec, reverse, inclusive)
    b = running(table, BLOCKED, spec, reverse, inclusive)
    assert rows(a, *cols) == rows(b, *cols)


def test_neighbours_keep_nulls(table, rows):
    a = neighbours(table, PLAIN, {"p": "x", "has_p": F.lit(1)}, {"n": "x", "has_n": F.lit(1)})
    b = neighbours(table, BLOCKED, {"p": "x", "has_p": F.lit(1)}, {"n": "x", "has_n": F.lit(1)})
    cols = ("v", "at", "p", "has_p", "n", "has_n")
    assert rows(a, *cols) == rows(b, *cols)


def test_surrounding(table, rows):
    a = surrounding(table, PLAIN, F.col("x"), "p", "n")
    b = surrounding(table, BLOCKED, F.col("x"), "p", "n")
    assert rows(a, "v", "at", "p", "n") == rows(b, "v", "at", "p", "n")


def test_framed_halo(table, rows):
    def exprs(frame, order):
        return {"s": F.sum("x").over(frame), "c": F.count("pos").over(frame), "l": F.lag("pos", 2).over(order)}

    a = framed(table, DENSE, -3, 2, exprs)
    b = framed(table, DENSE_BLOCKED, -3, 2, exprs)
    assert rows(a, "v", "pos", "s", "c", "l") == rows(b, "v", "pos", "s", "c", "l")
    with pytest.raises(ValueError):
        framed(table, DENSE_BLOCKED, -9, 0, exprs)


def test_segments_tile_the_sequence(table, rows):
    aggs = {"n": ("count", F.lit(1)), "last": ("max", F.col("at")), "head": ("first", F.col("x")), "tail": ("last", F.col("x")), "any": ("any", F.col("cut"))}
    a, b = segments(table, PLAIN, F.col("cut"), aggs), segments(table, BLOCKED, F.col("cut"), aggs)
    cols = ("v", "seg_start", *aggs)
    assert rows(a, *cols) == rows(b, *cols)
    assert b.agg(F.sum("n")).first()[0] == table.count()


def test_no_keys(table, rows):
    whole = Seq((), ("g",), 50)
    df = table.withColumn("g", F.col("v") * 1000 + F.col("at"))
    out = running(df, whole, {"c": ("count", F.lit(1))})
    assert [r[0] for r in out.orderBy("g").select("c").collect()] == list(range(1, table.count() + 1))
