"""Inputs on which rows or parts of texts used to get lost, and the number of rounds of folds."""

from pyspark.sql import functions as F

from reelmetrics.functions.timecode import frames_to_timecode
from reelmetrics.operators import folds, joins, plugins, rollups
from reelmetrics.operators.sequence import Seq, neighbours, number_rows
from reelmetrics.operators.stats import exact_percentiles
from reelmetrics.sources import cues, edl, records
from reelmetrics.streaming import live


def test_offers_have_no_upper_limit(spark, rows):
    jobs = spark.createDataFrame([(1, "A", 300.0, 9.0), (2, "A", 40.5, 9.0), (3, "Z", None, 1.5), (4, "A", 5000.0, 9.0)], "job_id int, model string, min_gb double, max_price double")
    offers = spark.createDataFrame([(10, "A", 640, 5.0, True), (11, "A", 40, 1.0, True), (12, "A", 41, 2.0, True), (13, "A", 900, 1.0, False)], "offer_id int, model string, gb int, price double, verified boolean")
    got = rows(joins.suitable_offers(jobs, offers, 2), "job_id", "offer_id", "offer_rank", "any_model")
    assert got == sorted([(1, 10, 1, False), (2, 12, 1, False), (2, 10, 2, False), (3, 11, 1, True)], key=repr)


def test_brackets_in_dialogue(spark, rows):
    text = cues.HEADERS["ass"] + "\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,two [noise]\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,three\n[Fonts]\nDialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,no\n"
    out = cues.parse_ass(spark.createDataFrame([(text,)], "value string"))
    assert rows(out, "start_s", "text") == [(1.0, "two [noise]"), (3.0, "three")]


def test_edit_list_fields_are_never_cut(spark, rows):
    ev = spark.createDataFrame(
        [("l", "T", 1234, "LONGREELNAME", "V", "D", 1500, 0, 24, 0, 24, "c", "f.mov", '{"a": 1}', ["note"], 50.0)],
        "list string, title string, event_no int, reel string, track string, transition string, transition_frames int, source_in long, source_out long, record_in long, record_out long, "
        "clip_name string, source_file string, restoration_json string, comments array<string>, speed_pct double",
    )
    text = "\n".join(r["value"] for r in edl.cmx3600_lines(ev, ["list"]).orderBy("line_no").collect())
    again = edl.parse_cmx3600(spark.createDataFrame([("l", text)], "list string, value string"))
    cols = [c for c in ev.columns if c != "comments"]
    assert rows(again, *cols) == rows(ev, *cols)
    assert spark.range(1).select(frames_to_timecode(F.lit(119), 120.0)).first()[0] == "00:00:00:119"


def test_long_edit_list(spark):
    line = "{:03d}  R1       V     C        00:00:00:00 00:00:02:00 00:00:00:00 00:00:02:00\n* FROM CLIP NAME: c{}\n"
    text = "TITLE: Long\n" + "".join(line.format(k, k) for k in range(1, 10001))
    out = edl.parse_cmx3600(spark.createDataFrame([(text,)], "value string")).agg(F.count("*"), F.max("event_no"), F.count_distinct("clip_name")).first()
    assert tuple(out) == (10000, 10000, 10000)


def test_null_keys_are_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 50), (None, 120), (7, 3), (7, None)], "video int, at int")
    for ask in (lambda s: number_rows(df, s, "n"), lambda s: neighbours(df, s, {"before": "at"}, {"after": "at"})):
        assert rows(ask(Seq(("video",), ("at",), None))) == rows(ask(Seq(("video",), ("at",), 100)))
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert rows(exact_percentiles(values, ("k",), "v", {"mid": 0.5})) == sorted([(None, 2.0), ("a", 5.0)], key=repr)
    assert rollups.errors_with_totals(values, "k").count() == 3


def test_broken_log_lines_are_kept(spark):
    good, bad = records.parse_log_lines(spark.createDataFrame([("{\"message\": \"m\"}",), ("no json",)], "value string"))
    assert good.count() == 1 and [r["value"] for r in bad.collect()] == ["no json"]


def test_open_windows_are_added(spark, rows):
    written = spark.createDataFrame([(1, "a", 5)], "w int, k string, n int")
    every = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (1, "b", 1)], "w int, k string, n int")
    assert rows(live.with_open_windows(written, every, ["w", "k"])) == rows(every)


def test_folds_settle_in_few_rounds(spark, monkeypatch):
    rounds = []
    kept = folds.durable_checkpoint
    monkeypatch.setattr(folds, "durable_checkpoint", lambda df: rounds.append(1) or kept(df))
    still = spark.range(64 * 4).select(F.lit(1).alias("video"), F.col("id").alias("frame_no"), F.array(F.lit(255).cast("long")).alias("hash"))
    out = folds.anchored_dedup(still, Seq(("video",), ("frame_no",), 4), "hash")
    assert out.select("unique_frame").distinct().count() == 1 and len(rounds) <= 4
    rounds.clear()
    boxes = spark.range(64 * 2).select(F.lit(1).alias("video"), (F.col("id") * 50.0).alias("y"), F.lit(0.0).alias("x"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    merged = folds.merge_boxes(boxes, Seq(("video",), ("y",), 100))
    assert merged.count() == 128 and merged.select("box_no").distinct().count() == 128 and len(rounds) <= 4


def test_large_boxes_and_long_intervals_stand_in_few_cells(spark):
    full = spark.createDataFrame([(1, 1, 0.0, 0.0, 3840.0, 2160.0)], "v int, box_id int, x double, y double, w double, h double")
    cells = joins._sided(full, "a").select(F.explode(joins._corners("a", F.lit(64.0 * 64)))).count()
    assert cells <= 4
    points = spark.createDataFrame([(1, float(k)) for k in range(100)], "v int, t double")
    spans = spark.createDataFrame([(1, 0.0, 36000.0), (1, 10.0, 11.0), (1, 5.0, 5.0)], "v int, s double, e double")
    assert joins.points_in_intervals(points, spans, ["v"], "t", "s", "e", 10.0).count() == 101


def test_custom_aggregate_merges_states(spark, rows):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, float(k)) for k in range(1, 200)], "g int, v double").repartition(5)
    got = plugins.custom_aggregate(df, ["g"], lambda p: [len(p), p["v"].sum()], lambda s: s.sum(axis=0), lambda s: [s[1] / s[0]], ["mean"])
    want = df.groupBy("g").agg(F.avg("v").alias("mean"))
    assert {r["g"]: round(r["mean"], 9) for r in got.collect()} == {r["g"]: round(r["mean"], 9) for r in want.collect()}


def small_batches(spark, batch_rows, build):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch_rows))
    try:
        return build().collect()
    finally:
        spark.conf.set(name, before)


def test_custom_aggregate_forms_few_states(spark):
    """The state counts the calls for a key: one a task, though a batch holds few rows of it."""
    df = spark.range(2000).selectExpr("IF(id % 5 = 0, NULL, id % 5) AS g", "CAST(id AS DOUBLE) AS v").repartition(2)
    build = lambda: plugins.custom_aggregate(df, ["g"], lambda p: [1, p["v"].sum()], lambda s: s.sum(axis=0), lambda s: s, ["calls", "total"])
    got = {r["g"]: (r["calls"], r["total"]) for r in small_batches(spark, 10, build)}
    assert {g: t for g, (_, t) in got.items()} == {g or None: float(sum(range(g, 2000, 5))) for g in range(5)}
    assert max(n for n, _ in got.values()) <= 2


def test_chunks_share_batches_and_go_on_over_them(spark):
    frames = spark.range(330).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS video", "id DIV 3 AS frame_no").where("video IS NOT NULL OR frame_no < 0")
    totals = frames.groupBy("video").count().withColumnRenamed("count", "total_frames")
    ahead = lambda p: p.assign(ahead=[int(p["frame_no"][k : k + 3].sum()) for k in range(len(p))])
    out = plugins.process_chunks(frames, ("video",), "frame_no", totals, ahead, "video long, frame_no long, ahead long", 20, 4)
    got = {(r["video"], r["frame_no"]): r["ahead"] for r in small_batches(spark, 7, lambda: out)}
    assert got == {(v, k): sum(range(k, min(k + 3, 110))) for v in (1, 2) for k in range(110)}
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
