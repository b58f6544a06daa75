"""Readers and writers on files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from reelmetrics.plans import QUERIES
from reelmetrics.sources import cues, edl, keyed, records, sinks

SRT = "1\n00:00:00,000 --> 00:00:02,000\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:05,500\nWorld"


def test_srt_vtt_ass_files(spark, tmp_path, rows):
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nnote\n\n00:00:01.500 --> 00:00:02.000 align:start\nHi\n")
    (tmp_path / "c.ass").write_text("[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start\nDialogue: 1,0:00:01.00,0:00:02.50,Top,,0,0,0,,One\\Ntwo, three\nDialogue: bad\n")
    srt = cues.parse_srt(cues.read_texts(spark, str(tmp_path), "*.srt"))
    assert rows(srt, "cue_index", "start_s", "end_s", "text") == [(1, 0.0, 2.0, "Hello\nthere"), (2, 3.0, 5.5, "World")]
    vtt = cues.parse_vtt(cues.read_texts(spark, str(tmp_path), "*.vtt"))
    assert rows(vtt, "cue_index", "start_s", "end_s", "text") == [(1, 1.5, 2.0, "Hi")]
    ass = cues.parse_ass(cues.read_texts(spark, str(tmp_path), "*.ass"))
    assert rows(ass, "cue_index", "layer", "start_s", "end_s", "style", "text") == [(1, 1, 1.0, 2.5, "Top", "One\ntwo, three")]


def test_cue_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("t1", 0.0, 2.0, "Hello"), ("t1", 3.0, 5.25, "World"), ("t2", 1.0, 1.5, "x")], "track string, start_s double, end_s double, text string")
    lines = cues.cue_lines(df, ("track",), "srt", 2.0)
    cues.write_lines(lines, "track", str(tmp_path / "out"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out" / "track=t1").glob("*.txt")))
    back = cues.parse_srt(spark.createDataFrame([("t1", text)], "track string, value string"))
    assert rows(back, "cue_index", "start_s", "end_s", "text") == [(1, 0.0, 2.0, "Hello"), (2, 3.0, 5.25, "World")]


def test_cmx3600(spark, rows):
    text = (
        "TITLE: Cut\nFCM: NON-DROP FRAME\n\n* orphan comment\n001  REEL1    V     C        01:00:00:00 01:00:02:12 00:00:00:00 00:00:02:12\n* FROM CLIP NAME: shot a\n* hello\n"
        'M2   REEL1       050.0\n002  BL       A2    D030     00:00:00:00 00:00:01:00 00:00:02:12 00:00:03:12\n* RESTORATION: {"x": 1}\n'
    )
    ev = edl.parse_cmx3600(spark.createDataFrame([("l", text)], "list string, value string")).cache()
    assert rows(ev, "event_no", "reel", "transition", "transition_frames", "record_out", "clip_name", "speed_pct") == [
        (1, "REEL1", "C", 0, 60, "shot a", 50.0), (2, "BL", "D", 30, 84, None, None),
    ]
    assert ev.where("event_no = 2").first()["restoration_json"] == '{"x": 1}'
    assert [r[0] for r in edl.clip_list(ev).collect()] == ["REEL1"]
    lines = edl.cmx3600_lines(ev, ["list"]).orderBy("line_no")
    again = edl.parse_cmx3600(spark.createDataFrame([("l", "\n".join(r["value"] for r in lines.collect()))], "list string, value string"))
    cols = ("event_no", "reel", "track", "transition", "record_in", "record_out", "comments", "speed_pct")
    assert rows(again, *cols) == rows(ev, *cols)


def test_fcpxml_write_and_read(spark, tmp_path, rows):
    ev = spark.createDataFrame([("l", 1, "R1", "a", 24, 48, 0, 24), ("l", 2, "R2", "", 0, 24, 24, 48)], "list string, event_no int, reel string, clip_name string, source_in long, source_out long, record_in long, record_out long")
    ev = ev.withColumns({"title": F.lit('A & "B"'), "source_file": F.lit("f<1>.mov")})
    lines = [r["value"] for r in edl.fcpxml_lines(ev, ["list"], 24.0).orderBy("line_no").collect()]
    assert len(lines) == 7 and lines[0].startswith("<fcpxml")
    out = edl.parse_fcpxml(spark.createDataFrame([("\n".join(lines),)], "value string"))
    assert {r["title"] for r in spark.createDataFrame([("\n".join(lines),)], "value string").selectExpr("from_xml(value, 'library struct<event:struct<_name:string>>').library.event._name as title").collect()} == {'A & "B"'}
    assert rows(out, "event_no", "reel", "clip_name", "record_in", "record_out") == [(1, "R1", "a", 0, 24), (2, "R2", "R2", 24, 48)]


def test_probe(spark):
    doc = {"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "r_frame_rate": "30000/1001"}], "format": {"duration": "120.5", "bit_rate": "5000000"}}
    row = records.parse_probe(spark.createDataFrame([(json.dumps(doc),), ("{}",)], "json string")).collect()
    assert len(row) == 1 and row[0]["framerate"] == pytest.approx(29.97002997) and row[0]["has_audio"] and row[0]["audio_sample_rate"] == 48000


def test_frame_scan_and_benchmark_quarantine(spark, tmp_path, rows):
    frames = tmp_path / "f"
    frames.mkdir()
    for n in (1, 2, 10):
        (frames / f"frame_{n:08d}.png").write_bytes(b"x" * n)
    (frames / "other.txt").write_text("no")
    assert rows(records.scan_frames(spark, str(frames)), "frame_no", "length") == [(1, 1), (10, 10), (2, 2)]
    bench = tmp_path / "b"
    bench.mkdir()
    (bench / "good.json").write_text(json.dumps({"results": [{"config": {"name": "n", "benchmark_type": "e2e"}, "metrics": {"frames_processed": 50, "processing_time_seconds": 5.0, "stage_timings": {"decode": 1.0}}}]}))
    (bench / "bad.json").write_text("{broken")
    good, bad = records.read_benchmarks(spark, str(bench))
    flat = sinks.benchmark_flat(good).first()
    assert flat["frames_per_second"] == 10.0 and flat["success"] is True and bad.count() == 1


def test_manifests_and_history(spark, tmp_path, rows):
    (tmp_path / "cp.json").write_text(json.dumps({"stage": "enhance", "last_completed_frame": 50, "total_frames": 100, "frames": [{"frame_number": 50, "processed": True}]}))
    (tmp_path / "h.json").write_text(json.dumps({"data_points": [{"timestamp": "2024-01-02T03:04:05", "job_id": "j", "psnr": 30.5, "frames_processed": 9}]}))
    cp = records.checkpoint_frames(records.read_checkpoints(spark, str(tmp_path / "cp.json")), ["stage"])
    assert rows(cp, "stage", "resume_frame", "frame_number") == [("enhance", 51, 50)]
    pts = records.read_quality_history(spark, str(tmp_path / "h.json"))
    assert rows(pts, "job_id", "psnr", "ssim", "frames_processed") == [("j", 30.5, None, 9)]
    sinks.write_quality_csv(pts.withColumn("job_name", F.lit("a,b")).withColumn("processing_time_seconds", F.lit(1.5)), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '2024-01-02T03:04:05,j,"a,b",30.5000,,,1.50,9' in text


def test_job_upserts(spark, rows):
    df = spark.createDataFrame([("j1", 1, "pending", None), ("j1", 2, None, 0.5), ("j1", 3, "done", None), ("j2", 1, "pending", None)], "id string, seq int, state string, progress double")
    assert rows(sinks.current_view(df, ["id"], "seq"), "id", "state", "progress", "seq") == [("j1", "done", 0.5, 3), ("j2", "pending", None, 1)]


def test_keyed_table_has_more_buckets_for_more_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 50)
    table = keyed.KeyedTable(spark, f"grown_{uuid.uuid4().hex}", ["k"], 2, 2)
    change = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id AS k", f"{v} AS v", f"{v} AS at")
    try:
        keyed.merge_current(table, change(0, 300, 1), "at")
        keyed.merge_current(table, change(200, 400, 2), "at")
        described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table.name}").collect()}
        assert described["Num Buckets"] == "6"
        assert rows(keyed.current_rows(table, "at")) == sorted(((k, 2 if k >= 200 else 1, 2 if k >= 200 else 1) for k in range(400)), key=repr)
    finally:
        table.drop()


@pytest.mark.parametrize("key", ["X11_request_tags", "F62_request_plan", "SRC8_cmx3600"])
def test_costly_rows_of_one_file_are_many_tasks(spark, key):
    assert QUERIES[key](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
