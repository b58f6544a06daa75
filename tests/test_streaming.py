"""Streams run to the end over files must agree with their batch twins."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from reelmetrics.operators import folds
from reelmetrics.operators.sequence import Seq
from reelmetrics.plans import QUERIES
from reelmetrics.streaming import live

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    data = [
        (i % 3, i, T0 + datetime.timedelta(seconds=i * 4), "failed" if i % 4 == 1 or i > 80 else "completed", float(i % 7), None if i % 5 == 0 else 30.0 + i % 3, None, 60)
        for i in range(100)
    ]
    ddl = "job int, frame_no long, ts timestamp, state string, time_ms double, psnr double, ssim double, total_frames int"
    df = spark.createDataFrame(data, ddl)
    for part in range(4):  # four files in time order
        df.where((F.col("frame_no") >= part * 25) & (F.col("frame_no") < part * 25 + 25)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    return str(folder), df.cache(), ddl


def stream(spark, events):
    folder, _, ddl = events
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


def test_progress_twins(spark, events, rows):
    got = live.run_available(live.progress_stream(stream(spark, events), ["job"], ["ts", "frame_no"], window=5))
    want = live.progress_table(events[1], ["job"], ["ts", "frame_no"], window=5, width=60)
    cols = ("job", "frame_no", "frames_completed", "frames_failed", "frames_pending")
    assert rows(got, *cols) == rows(want, *cols)
    near = lambda df: [tuple(None if x is None else round(x, 9) for x in r) for r in rows(df, "job", "frame_no", "avg_time_ms", "eta_seconds", "avg_psnr")]
    assert near(got) == near(want)


def test_ema_twins(spark, events, rows):
    got = live.run_available(live.ema_stream(stream(spark, events), ["job"], ["frame_no"], "time_ms", 0.1))
    want = folds.moving_ema(events[1], Seq(("job",), ("frame_no",), 10), "time_ms", 0.1)
    assert rows(got, "job", "frame_no", "ema") == rows(want, "job", "frame_no", "ema")


def test_limiter_twins(spark, events, rows):
    prep = lambda df: df.select("job", "frame_no", (F.unix_micros("ts") / 1e6).alias("s"), (F.col("state") == "failed").alias("p"))
    limits = {"per_window": 3, "window_s": 60.0, "gap_s": 30.0}
    got = live.run_available(live.limit_stream(prep(stream(spark, events)), ["job"], "frame_no", "s", "p", **limits))
    want = live.limit_table(prep(events[1]), ["job"], "frame_no", "s", "p", width=50, **limits)
    assert rows(got, "job", "frame_no", "verdict") == rows(want, "job", "frame_no", "verdict")


def test_failure_streak(spark, events):
    s = stream(spark, events).withColumn("bad", F.col("state") == "failed")
    out = live.run_available(live.failure_stream(s, ["job"], ["ts", "frame_no"], "frame_no", "bad", 3)).collect()
    by_job = {}
    for r in sorted(out, key=lambda r: r["frame_no"]):
        by_job.setdefault(r["job"], []).append(r)
    for rows_ in by_job.values():
        assert rows_[-1]["consecutive_failures"] >= 6 and rows_[-1]["aborted"]
        assert not rows_[0]["aborted"]


def test_windows_close_with_the_watermark(spark, events):
    out = live.run_available(live.event_counts(stream(spark, events), "ts", ["state"], "1 minute", "30 seconds"))
    closed = {r["window_start"] for r in out.collect()}
    assert max(closed).minute == 5 and sum(r["n"] for r in out.collect()) == 90  # windows up to 06:00 hold frames 0..89


def test_watch_folder_once_and_by_age(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, age in (("a.mp4", 100), ("b.mp4", 100), ("young.mp4", -1000), ("skip.txt", 100)):
        p = folder / name
        p.write_bytes(b"abc")
        os.utime(p, (time.time() - age,) * 2)
    (folder / "empty.mp4").write_bytes(b"")
    work = str(tmp_path / "work")
    found = live.run_available(live.watch_folder(spark, str(folder), "*.mp4"), work)
    assert found.where("length > 0").count() == 3
    assert live.run_available(live.watch_folder(spark, str(folder), "*.mp4"), work).where("length > 0").count() == 3
    done = found.where(F.col("path").endswith("a.mp4"))
    ready = live.ready_files(found, done, F.current_timestamp(), 5.0)
    assert [r["path"].rsplit("/", 1)[1] for r in ready.collect()] == ["b.mp4"]


def test_watched_tables_in_one_file_or_many(spark, rows, tmp_path):
    folder = f"{tmp_path}/in put"
    for name, n, files in (("whole", 7, 1), ("parts", 9, 3), ("none", 0, 1), ("region", 5, 2)):
        spark.range(n).repartition(files).write.parquet(f"{folder}/{name}.parquet")
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(f"{folder}/flat.parquet")
    for p in (tmp_path / "in put").rglob("*.parquet"):
        os.utime(p, (time.time() - 100,) * 2)
    got = QUERIES["ST1_watch_folder"](spark, folder)
    assert rows(got, "file", "n_rows") == [("flat.parquet", 4), ("none.parquet", 0), ("parts.parquet", 9), ("whole.parquet", 7)]


def test_only_open_windows_are_added(spark, events, rows, tmp_path):
    """States of every fourth row are null; closed windows come from the stream alone."""
    null_state = lambda df: df.withColumn("state", F.when(F.col("frame_no") % 4 != 2, F.col("state")))
    build = lambda df: live.event_counts(null_state(df), "ts", ["state"], "1 minute", "30 seconds")
    written = live.run_available(build(stream(spark, events)), str(tmp_path))
    mark = live.last_watermark(spark, str(tmp_path))
    assert mark == int(T0.timestamp() * 1000) + 366_000  # the newest row, 30 seconds back
    every, keys, end = build(events[1]), ["window_start", "state"], F.col("window_start") + F.expr("INTERVAL 1 MINUTE")
    assert every.where("state IS NULL").count() == 7
    assert rows(live.with_open_windows(written, every, keys, end, mark)) == rows(every)
    assert rows(live.with_open_windows(written, every, keys)) == rows(every)  # null keys stand once
    lost = live.with_open_windows(written.limit(0), every, keys, end, mark)
    assert {r["window_start"].minute for r in lost.collect()} == {6}
