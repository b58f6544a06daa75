"""Queries for listings and samples (T), set operators (U), sources and sinks (SRC, SNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import folds
from ..operators import generate as gen
from ..operators import joins as jn
from ..operators import tables as tb
from ..operators import timeline as tl
from ..operators.sequence import Seq
from ..session import dealt, durable_checkpoint
from ..sources import cues, edl, keyed, records, sinks
from .bindings import TIMELINE
from .function_queries import pad2
from .registry import query
from .rollup_queries import rounded
from .rule_queries import CODEC, FSC, fscore
from .windows import totals

C, L = F.col, F.lit
V = ("video_id",)


@query("T1_list_jobs", "SELECT job_id, state, created_at FROM jobs WHERE state = 'O' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 20")
def _(t):
    return tb.page(t.jobs.where("state = 'O'"), [C("created_at").desc(), C("job_id")], 50, 20).select("job_id", "state", "created_at")


@query("T2_worst_frames", "SELECT ok, ln, pk, round(psnr, 6) AS psnr FROM met ORDER BY psnr + ssim, ok, ln, pk, vmaf LIMIT 25")
def _(t):
    df = t.met.withColumn("s", C("psnr") + C("ssim"))
    return tb.worst_frames(df, "s", ["ok", "ln", "pk", "vmaf"], 25).select("ok", "ln", "pk", F.round("psnr", 6).alias("psnr"))


@query("T3_next_frame", "SELECT job_id, min(frame_no) AS next_frame FROM job_frames WHERE state = 'N' GROUP BY 1")
def _(t):
    return tb.next_frame(t.job_frames, "job_id", "frame_no", C("state") == "N")


@query("T5_eviction_list", """WITH e AS (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS sz FROM orders), r AS (SELECT *, sum(sz) OVER (ORDER BY o_orderdate, o_orderkey) AS freed FROM e) SELECT o_orderkey, sz, CAST(freed AS BIGINT) AS freed FROM r WHERE freed - sz < 90000000""")
def _(t):
    df = t.orders.select("o_orderkey", C("o_orderdate").cast("timestamp").alias("o_orderdate"), F.floor("o_totalprice").alias("sz"))
    return tb.eviction_list(df, ["o_orderdate", "o_orderkey"], "sz", 90_000_000).select("o_orderkey", "sz", "freed")


@query("T6_stale_entries", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 2000 DAY")
def _(t):
    df = t.orders.select("o_orderkey", C("o_orderdate").cast("timestamp").alias("ts"))
    return tb.stale_entries(df, C("ts"), F.to_timestamp(L("2001-08-01")), 2000).select("o_orderkey")


@query("T7_every_nth", "SELECT video_id, frame_no FROM frames WHERE frame_no >= 2 AND (frame_no - 2) % 5 = 0")
def _(t):
    return tb.every_nth(t.frames, C("frame_no"), 5, 2).select("video_id", "frame_no")


@query("T8_uniform_sample", "WITH x AS (SELECT video_id, frame_no, count(*) OVER (PARTITION BY video_id) AS n FROM frames) SELECT video_id, frame_no FROM x WHERE CASE WHEN n // 7 = 0 THEN frame_no = 0 ELSE frame_no % (n // 7) = 0 AND frame_no BETWEEN n // 7 AND n // 7 * 6 END")
def _(t):
    return tb.uniform_sample(t.frames.select("video_id", "frame_no"), totals(t), V, "frame_no", 6)


@query("T8_random_sample", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-7'), l_orderkey LIMIT 40")
def _(t):
    key = F.md5(F.concat_ws("-", *[C(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], L("7")))
    return tb.random_sample(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), 40, 7, key)


@query("T9_anchor_frames", "WITH x AS (SELECT video_id, frame_no, count(*) OVER (PARTITION BY video_id) AS n FROM frames) SELECT video_id, frame_no FROM x WHERE n <= 10 OR (frame_no % greatest(n // 10, 1) = 0 AND frame_no < n // 10 * 10) OR frame_no = 0 OR frame_no = n - 1")
def _(t):
    return tb.anchor_frames(t.frames.select("video_id", "frame_no"), totals(t), V, "frame_no", 10)


@query("T10_versions_by_modified", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def _(t):
    return tb.page(t.orders.select("o_orderkey", "o_orderdate"), [C("o_orderdate").desc(), C("o_orderkey").desc()], 100)


@query("T11_matching_nodes", "SELECT s_suppkey FROM supplier WHERE s_nationkey >= 5 AND s_acctbal >= 1000 ORDER BY s_nationkey DESC, s_suppkey % 4 DESC, s_acctbal DESC, s_suppkey LIMIT 12")
def _(t):
    n = t.supplier.select("s_suppkey", C("s_nationkey").alias("gpu_memory_gb"), C("s_acctbal").alias("ram_gb"), (C("s_suppkey") % 4).alias("cpu_cores"), C("s_acctbal").alias("fps"))
    return tb.matching_nodes(n, 5, 1000, 12, ["s_suppkey"]).select("s_suppkey")


@query("T12_cheapest_per_key", "SELECT p_type, p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS p_retailprice FROM part GROUP BY 1, 2")
def _(t):
    return tb.cheapest_per_key(t.part.select("p_type", "p_brand", "p_partkey", "p_retailprice"), ["p_type", "p_brand"], "p_retailprice", "p_partkey")


@query("T13_keyword_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') OR contains(lower(p_brand), 'bolt') OR p_size = 7")
def _(t):
    df = t.part.withColumn("tags", F.array(C("p_brand"), F.when(C("p_size") == 7, "Bolted").otherwise("plain")))
    return tb.keyword_search(df, "BOLT", ["p_name", "p_type"], "tags").select("p_partkey")


@query("T14_catalogue", "SELECT p_partkey, p_size < 25 AS is_builtin FROM part WHERE p_type = 'PROMO' AND p_partkey % 3 IN (0, 2)")
def _(t):
    era = F.when(C("p_partkey") % 3 == 0, "silent").when(C("p_partkey") % 3 == 1, "modern").otherwise("any")
    df = t.part.select("p_partkey", "p_size", C("p_type").alias("category"), era.alias("era"))
    return tb.catalogue(df.where("p_size < 25"), df.where("p_size >= 25"), "PROMO", "silent").select("p_partkey", "is_builtin")


@query("T15_best_format", f"WITH x AS (SELECT ok, ln, pk, sk, {CODEC} AS codec, {FSC} AS score FROM rws) SELECT ok, arg_max(pk, (score, pk, sk)) AS pk, max(score) AS score FROM x WHERE codec IS NOT NULL GROUP BY 1")
def _(t):
    codec = R.ladder((C("ln") == 1, "AV01"), (C("ln") == 2, "vp09.00"), (C("ln") == 3, "avc1"), (C("ln") == 4, L(None).cast("string")), default="mpeg2")
    df = t.rows.select("ok", "pk", "sk", codec.alias("codec"), fscore().alias("score"))
    return tb.best_format(df, "ok", C("score"), [C("pk"), C("sk")]).select("ok", "pk", "score")


# --- U -----------------------------------------------------------------------------------------
@query("U1_missing_frames", """WITH f AS (SELECT DISTINCT l_suppkey AS video_id, l_partkey AS fn FROM lineitem), b AS (SELECT video_id, min(fn) AS a, max(fn) AS z FROM f GROUP BY 1), e AS (SELECT video_id, unnest(range(a, z + 1)) AS fn FROM b) SELECT video_id, fn AS missing_frame FROM e EXCEPT SELECT video_id, fn FROM f""")
def _(t):
    f = t.lineitem.select(C("l_suppkey").alias("video_id"), C("l_partkey").alias("fn"))
    return tl.missing_numbers(f, Seq(("video_id",), ("fn",)))


@query("U2_union_types", "SELECT user_id, event_type FROM events WHERE value > 60 UNION SELECT user_id, event_type FROM events WHERE event_type = 'error'")
def _(t):
    e = t.events
    return tb.union_types(e.where("value > 60").select("user_id", "event_type"), e.where("event_type = 'error'").select("user_id", "event_type"))


@query("U3_union_keys", "SELECT DISTINCT 'stage' || ln AS key FROM rws UNION SELECT DISTINCT rf FROM rws")
def _(t):
    m = F.create_map(F.concat(L("stage"), C("ln").cast("string")), C("q"), C("rf"), C("d"))
    return tb.union_keys(t.rows.select(m.alias("m")), "m")


@query("U4_orphans", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    return tb.orphans(t.orders.select("o_custkey").distinct(), t.orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("U5_common_frames", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def _(t):
    side = lambda f: t.lineitem.where(C("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return tb.common_frames(side("R"), side("A"), side("N"))


@query("U6_subscribers", "SELECT event_id, n_name AS subscriber FROM events JOIN nation ON n_nationkey % 5 = CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 9 END UNION SELECT event_id, 'wildcard' FROM events")
def _(t):
    code = F.when(C("event_type") == "view", 0).when(C("event_type") == "click", 1).when(C("event_type") == "error", 2).otherwise(9)
    typed = t.events.select("event_id", code.alias("c")).join(t.nation.select(C("n_name").alias("subscriber"), (C("n_nationkey") % 5).alias("c")), "c").drop("c")
    return tb.union_types(typed, t.events.select("event_id", L("wildcard").alias("subscriber")))


# --- SRC ---------------------------------------------------------------------------------------
@query("SRC1_frame_numbers", "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_partkey * 3 END AS frame_no FROM part")
def _(t):
    n = (C("p_partkey") * 3).cast("string")
    k = C("p_partkey") % 5
    name = F.when(k == 0, F.concat(L("frame_000"), n, L(".png"))).when(k == 1, F.concat(n, L(".jpg"))).when(k == 2, F.concat(L("shot_"), n, L(".png"))).when(k == 3, F.concat(L("Frame-"), n)).otherwise("cover.png")
    return t.part.select("p_partkey", records.frame_number(name).alias("frame_no"))


@query("SRC2_job_tables", "SELECT j.o_orderstatus AS state, count(DISTINCT o_orderkey) AS jobs, count(l_orderkey) AS frames FROM orders j LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    frames = t.lineitem.groupBy(C("l_orderkey").alias("job_id")).agg(F.count(L(1)).alias("n"))
    return t.jobs.join(frames, "job_id", "left").groupBy("state").agg(F.count(L(1)).alias("jobs"), F.sum(F.coalesce("n", L(0))).alias("frames"))


@query("SRC3_pending_frames", "WITH w AS (SELECT o_orderkey AS job_id, unnest(range(o_custkey % 9)) AS frame_no FROM orders) SELECT job_id, CAST(frame_no AS INTEGER) AS frame_no, 'pending' AS state FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_linenumber = frame_no)")
def _(t):
    jobs = t.orders.select(C("o_orderkey").alias("job_id"), (C("o_custkey") % 9).alias("total"))
    have = t.lineitem.select(C("l_orderkey").alias("job_id"), C("l_linenumber").alias("frame_no")).distinct()
    return gen.pending_frames(jobs, have, "job_id", "total")


@query("SRC4_quality_history", "SELECT 'job' || event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS psnr, event_id AS frames_processed, ts FROM events")
def _(t):
    point = F.struct(
        F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.concat(L("job"), C("event_id").cast("string")).alias("job_id"),
        F.when(C("event_id") % 3 != 0, C("value")).alias("psnr"), C("event_id").alias("frames_processed"))
    docs = t.events.select(F.from_json(F.to_json(F.struct(F.array(point).alias("data_points"))), records.QUALITY_HISTORY).alias("d")).select("d.*")
    return records.quality_points(docs).select("job_id", "psnr", "frames_processed", C("timestamp").alias("ts"))


@query("SRC5_benchmark_history", """SELECT l_orderkey, l_linenumber, l_partkey, 'run' || l_suppkey AS name, l_quantity AS seconds, l_partkey AS frames, l_tax AS decode, l_returnflag <> 'R' AS success, false AS quarantined FROM lineitem WHERE l_partkey % 10 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, NULL, NULL, NULL, NULL, true FROM lineitem WHERE l_partkey % 10 = 0""")
def _(t):
    config = F.struct(F.concat(L("run"), C("l_suppkey").cast("string")).alias("name"), L("e2e").alias("benchmark_type"))
    metrics = F.struct(C("l_quantity").alias("processing_time_seconds"), C("l_partkey").alias("frames_processed"), F.create_map(L("decode"), C("l_tax")).alias("stage_timings"))
    result = F.struct(config.alias("config"), metrics.alias("metrics"), F.when(C("l_returnflag") == "R", False).alias("success"))
    doc = F.to_json(F.struct(F.array(result).alias("results")))
    docs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(C("l_partkey") % 10 == 0, F.concat(L("{broken "), doc)).otherwise(doc).alias("value"))
    good, bad = records.parse_benchmarks(docs)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = good.select(*keys, C("config.name").alias("name"), C("metrics.processing_time_seconds").alias("seconds"), C("metrics.frames_processed").alias("frames"), F.element_at("metrics.stage_timings", "decode").alias("decode"), "success", L(False).alias("quarantined"))
    return rows.unionByName(bad.select(*keys, L(True).alias("quarantined")), allowMissingColumns=True)


def cue_texts(t):
    """SRT text of a document: one cue per non-empty line."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    block = lambda x, i: cues.cue_block("srt", i + 1, i * 2 + 0.5, i * 2 + 1.25, F.trim(x))
    return t.documents.select("doc_id", F.array_join(F.transform(lines, block), "\n").alias("value"))


CUES = "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents), c AS (SELECT doc_id, trim(unnest(ls)) AS text, generate_subscripts(ls, 1) AS i FROM l)"


@query("SRC6_srt_cues", CUES + " SELECT doc_id, CAST(i AS INTEGER) AS cue_index, (i - 1) * 2 + 0.5e0 AS start_s, (i - 1) * 2 + 1.25e0 AS end_s, text FROM c")
def _(t):
    return cues.parse_srt(cue_texts(t))


@query("SRC6_vtt_cues", CUES + " SELECT doc_id, CAST(i AS INTEGER) AS cue_index, (i - 1) * 2 + 0.5e0 AS start_s, (i - 1) * 2 + 1.25e0 AS end_s, text FROM c")
def _(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    block = lambda x, i: cues.cue_block("vtt", i, i * 2 + 0.5, i * 2 + 1.25, F.trim(x))
    docs = t.documents.select("doc_id", F.concat(L("WEBVTT\n\n"), F.array_join(F.transform(lines, block), "\n")).alias("value"))
    return cues.parse_vtt(docs)


@query("SRC7_ass_cues", CUES + " SELECT doc_id, CAST(i AS INTEGER) AS cue_index, (i - 1) * 2 + 0.5e0 AS start_s, (i - 1) * 2 + 1.25e0 AS end_s, text || chr(10) || 'x' AS text, 'Default' AS style, 0 AS layer FROM c")
def _(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    block = lambda x, i: cues.cue_block("ass", i, i * 2 + 0.5, i * 2 + 1.25, F.concat(F.trim(x), L("\nx")))
    body = F.array_join(F.transform(lines, block), "\n")
    docs = t.documents.select("doc_id", F.concat(L(cues.HEADERS["ass"] + "\n"), body).alias("value"))
    return cues.parse_ass(docs)


def cut_list(t):
    """CMX3600 text of an order: three events with a comment, a source file and a speed line."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tc = lambda h, m, s, f: F.concat_ws(":", two(h), two(m), two(s), two(f))
    k = C("o_custkey")

    def event(i):
        a, b = tc(L(0), k % 60, L(i * 10), k % 24), tc(L(0), k % 60, L(i * 10 + 5), k % 24)
        return F.concat(L(f"00{i}  R"), k.cast("string"), L("   V     C    "), a, L(" "), b, L(" "), a, L(" "), b)

    parts = [L("TITLE: Reel "), k.cast("string"), L("\nFCM: NON-DROP FRAME\n\n"), event(1), L("\n* FROM CLIP NAME: clip "), C("o_orderpriority"), L("\n* a note\n"), event(2), L("\nM2   R1       050.0\n"), event(3), L("\n* SOURCE FILE: f.mov\n* second note\n")]
    orders = dealt(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    return orders.select("o_orderkey", F.concat(*parts).alias("value"))


@query("SRC8_cmx3600", """WITH x AS (SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p, unnest([1, 2, 3]) AS i FROM orders)
SELECT o_orderkey, 'Reel ' || k AS title, CAST(i AS INTEGER) AS event_no, 'R' || k AS reel, ((k % 60) * 60 + i * 10) * 24 + k % 24 AS record_in, ((k % 60) * 60 + i * 10 + 5) * 24 + k % 24 AS record_out, CASE i WHEN 1 THEN 'clip ' || p END AS clip_name, CASE i WHEN 3 THEN 'f.mov' END AS source_file, CASE i WHEN 1 THEN 'a note' WHEN 3 THEN 'second note' ELSE '' END AS comments, CASE i WHEN 2 THEN 50e0 END AS speed_pct FROM x""")
def _(t):
    out = edl.parse_cmx3600(cut_list(t))
    return out.select("o_orderkey", "title", "event_no", "reel", "record_in", "record_out", "clip_name", "source_file", F.array_join("comments", ",").alias("comments"), "speed_pct")


@query("SRC9_fcpxml", """WITH x AS (SELECT p_partkey, p_name, p_size, unnest([0, 1]) AS i FROM part) SELECT p_partkey, 'T' || p_size AS title, CAST(i + 1 AS INTEGER) AS event_no, CASE i WHEN 0 THEN 'R' || p_size ELSE 'AX' END AS reel, CASE i WHEN 0 THEN p_name ELSE '' END AS clip_name, CASE i WHEN 0 THEN CAST(p_size AS BIGINT) * 12 ELSE 0 END AS record_in, CASE i WHEN 0 THEN CAST(p_size AS BIGINT) * 12 + 24 ELSE 60 END AS record_out FROM x""")
def _(t):
    s = C("p_size").cast("string")
    xml = F.concat(
        L('<fcpxml version="1.10"><resources><format frameDuration="1/24s"/></resources><library><event><project><sequence name="T'), s, L('"><spine><asset-clip ref="R'), s, L('" name="'), C("p_name"),
        L('" offset="'), s, L('/2s" duration="1s" start="0s"/><asset-clip offset="0s" duration="2.5s" start="1s"/></spine></sequence></project></event></library></fcpxml>'))
    return edl.parse_fcpxml(t.part.select("p_partkey", xml.alias("value"))).select("p_partkey", "title", "event_no", "reel", "clip_name", "record_in", "record_out")


@query("SRC10_probe", """SELECT p_partkey, p_size * 20 AS width, CASE WHEN p_size % 3 = 0 THEN 30e0 WHEN p_size % 3 = 1 THEN 30000 / 1001.0e0 ELSE 25e0 END AS framerate, p_brand AS codec, p_retailprice AS duration, p_partkey * 10 AS bit_rate, p_partkey % 2 = 0 AS has_audio, CASE WHEN p_partkey % 2 = 0 THEN 48000 END AS audio_sample_rate FROM part WHERE p_partkey % 7 <> 0""")
def _(t):
    rate = F.when(C("p_size") % 3 == 0, "30/0").when(C("p_size") % 3 == 1, "30000/1001").otherwise("25")
    video = F.struct(L("video").alias("codec_type"), C("p_brand").alias("codec_name"), (C("p_size") * 20).alias("width"), rate.alias("r_frame_rate"))
    blank = lambda kind: F.struct(L(kind).alias("codec_type"), L("aac").alias("codec_name"), L(None).cast("int").alias("width"), L(None).cast("string").alias("r_frame_rate"))
    streams = F.filter(F.array(F.when(C("p_partkey") % 7 != 0, video), F.when(C("p_partkey") % 2 == 0, blank("audio"))), lambda x: x.isNotNull())
    doc = F.to_json(F.struct(streams.alias("streams"), F.struct(C("p_retailprice").cast("string").alias("duration"), (C("p_partkey") * 10).cast("string").alias("bit_rate")).alias("format")))
    doc = F.replace(doc, L('"codec_name":"aac"'), L('"codec_name":"aac","sample_rate":"48000"'))
    return records.parse_probe(t.part.select("p_partkey", doc.alias("json"))).select("p_partkey", "width", "framerate", "codec", "duration", "bit_rate", "has_audio", "audio_sample_rate")


@query("SRC11_checkpoint_manifest", "SELECT l_orderkey, CAST(l_quantity AS BIGINT) + 1 AS resume_frame, CAST(l_linenumber AS BIGINT) AS frame_number, l_returnflag = 'R' AS processed, CASE WHEN l_returnflag = 'R' THEN md5(l_partkey::VARCHAR) END AS checksum FROM lineitem")
def _(t):
    frame = F.struct(C("l_linenumber").cast("long").alias("frame_number"), F.when(C("l_returnflag") == "R", F.md5(C("l_partkey").cast("string"))).alias("checksum"), (C("l_returnflag") == "R").alias("processed"))
    doc = F.to_json(F.struct(C("l_quantity").cast("long").alias("last_completed_frame"), F.array(frame).alias("frames")))
    docs = t.lineitem.select("l_orderkey", F.from_json(doc, records.CHECKPOINT).alias("d")).select("l_orderkey", "d.*")
    return records.checkpoint_frames(docs, ["l_orderkey"]).select("l_orderkey", "resume_frame", "frame_number", "processed", "checksum")


def score_logs(t):
    score = lambda v: F.struct(v.alias("vmaf"), (v / 2).alias("psnr_y"))
    frames = F.array(F.struct(L(0).alias("frameNum"), score(C("value")).alias("metrics")), F.struct(L(1).alias("frameNum"), score(C("value") / 4).alias("metrics")))
    pct = F.when(C("event_id") % 2 == 0, F.create_map(L("5"), C("value") / 8)).otherwise(F.create_map().cast("map<string,double>"))
    pooled = F.struct(F.struct(C("value").alias("mean"), (C("value") / 4).alias("min"), (C("value") * 2).alias("max"), pct.alias("percentile")).alias("vmaf"))
    doc = F.to_json(F.struct(frames.alias("frames"), pooled.alias("pooled_metrics")))
    return t.events.select("event_id", F.from_json(doc, records.QUALITY_LOG).alias("d")).select("event_id", "d.*")


@query("SRC13_quality_log_frames", "SELECT event_id, CAST(f AS BIGINT) AS frame_no, CASE f WHEN 0 THEN value ELSE value / 4 END AS vmaf, CASE f WHEN 0 THEN value ELSE value / 4 END / 2 AS psnr_y FROM events, range(2) r(f)")
def _(t):
    return records.quality_log_frames(score_logs(t), ["event_id"]).select("event_id", "frame_no", "vmaf", "psnr_y")


@query("SRC13_quality_log_pooled", "SELECT event_id, value AS vmaf_mean, value AS vmaf_harmonic_mean, CASE WHEN event_id % 2 = 0 THEN value / 8 ELSE value / 4 END AS vmaf_p5, value AS vmaf_p50, value * 2 AS vmaf_p95, 2 AS frame_count FROM events")
def _(t):
    return records.quality_log_pooled(score_logs(t), ["event_id"]).select("event_id", "vmaf_mean", "vmaf_harmonic_mean", "vmaf_p5", "vmaf_p50", "vmaf_p95", "frame_count")


def log_lines(t):
    doc = F.to_json(F.struct(F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.upper("event_type").alias("level"), C("props").alias("message"), F.struct(C("user_id").alias("line")).alias("source")))
    return t.events.select("event_id", F.when(C("event_id") % 10 == 0, L("not json")).otherwise(doc).alias("value"))


@query("SRC14_broken_log_lines", "SELECT event_id, 'not json' AS value FROM events WHERE event_id % 10 = 0")
def _(t):
    return records.parse_log_lines(log_lines(t))[1]


@query("SRC14_log_lines", "SELECT event_id, ts AS timestamp, upper(event_type) AS level, props AS message, CAST(user_id AS INTEGER) AS line FROM events WHERE event_id % 10 <> 0")
def _(t):
    return records.parse_log_lines(log_lines(t))[0].select("event_id", "timestamp", "level", "message", C("source.line").alias("line"))


# --- SNK ---------------------------------------------------------------------------------------
@query("SNK1_quality_csv", "SELECT 'job' || event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE format('{:.4f}', value / 3) END AS psnr, format('{:.6f}', value / 300) AS ssim, '' AS vmaf, format('{:.2f}', value / 3) AS processing_time_seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events")
def _(t):
    pts = t.events.select(
        C("ts").cast("timestamp").alias("timestamp"), F.concat(L("job"), C("event_id").cast("string")).alias("job_id"), L("n").alias("job_name"), F.when(C("event_id") % 3 != 0, C("value") / 3).alias("psnr"),
        (C("value") / 300).alias("ssim"), L(None).cast("double").alias("vmaf"), (C("value") / 3).alias("processing_time_seconds"), L(1).alias("frames_processed"))
    return sinks.quality_csv(pts).select("job_id", "psnr", "ssim", "vmaf", "processing_time_seconds", "timestamp")


@query("SNK2_benchmark_report", """SELECT 'run' || ok AS name, pk || 'x' || sk AS input_resolution, ln AS frames_processed, round(CASE WHEN d > 0 THEN ln / d ELSE 0 END, 6) AS frames_per_second, '{"decode":' || CAST(q AS VARCHAR) || '}' AS stage_timings, rf <> 'R' AS success FROM rws""")
def _(t):
    df = t.rows.select(
        F.struct(F.concat(L("run"), C("ok").cast("string")).alias("name"), L("e2e").alias("benchmark_type"), F.array("pk", "sk").alias("input_resolution"), F.array("pk", "sk").alias("output_resolution"), L("m").alias("model_name")).alias("config"),
        F.struct(C("ln").alias("frames_processed"), C("d").alias("processing_time_seconds"), C("ext").alias("memory_peak_mb"), C("ext").alias("gpu_memory_peak_mb"), F.create_map(L("decode"), C("q")).alias("stage_timings")).alias("metrics"),
        (C("rf") != "R").alias("success"), L("").alias("timestamp"))
    return rounded(sinks.benchmark_flat(df).select("name", "input_resolution", "frames_processed", "frames_per_second", "stage_timings", "success"), "frames_per_second")


@query("SNK3_cue_export", """WITH c AS (SELECT conv_id, turn * 3 AS s, turn * 3 + 2 AS e, replace(text, chr(10), ' ') AS text FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, text) AS line_no FROM c)
SELECT conv_id, line_no, line_no || chr(10) || '00:00:' || lpad(s::VARCHAR, 2, '0') || ',000 --> 00:00:' || lpad(e::VARCHAR, 2, '0') || ',000' || chr(10) || text || chr(10) AS value FROM n""")
def _(t):
    df = t.conversations.select("conv_id", (C("turn") * 3.0).alias("start_s"), (C("turn") * 3.0 + 2).alias("end_s"), F.replace("text", L("\n"), L(" ")).alias("text"))
    return cues.cue_lines(df, ("conv_id",), "srt")


def turns(t):
    return t.conversations.select("conv_id", (C("turn") * 3.0).alias("start_s"), (C("turn") * 3.0 + 2).alias("end_s"), F.replace("text", L("\n"), L(" ")).alias("text"))


TURNS = """WITH c AS (SELECT conv_id, turn * 3 AS s, turn * 3 + 2 AS e, replace(text, chr(10), ' ') AS text FROM conversations),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, text) AS line_no FROM c)"""


@query(
    "SNK3_vtt_export",
    TURNS
    + """ SELECT conv_id, line_no, '00:00:' || lpad(s::VARCHAR, 2, '0') || '.000 --> 00:00:' || lpad(e::VARCHAR, 2, '0') || '.000' || chr(10) || text || chr(10) AS value FROM n
UNION ALL SELECT DISTINCT conv_id, 0, 'WEBVTT' || chr(10) FROM c""",
)
def _(t):
    return cues.cue_lines(turns(t), ("conv_id",), "vtt")


ASS_HEAD = cues.HEADERS["ass"].replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    "SNK3_ass_export",
    TURNS
    + f""" SELECT conv_id, line_no, 'Dialogue: 0,0:00:' || lpad(s::VARCHAR, 2, '0') || '.00,0:00:' || lpad(e::VARCHAR, 2, '0') || '.00,Default,,0,0,0,,' || text AS value FROM n
UNION ALL SELECT DISTINCT conv_id, 0, '{ASS_HEAD}' FROM c""",
)
def _(t):
    return cues.cue_lines(turns(t), ("conv_id",), "ass")


@query("SNK4_cmx3600_export", f"""WITH x AS (SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p, unnest([1, 2, 3]) AS i FROM orders), e AS (SELECT *, '00:' || {pad2('k % 60')} || ':' || {pad2('i * 10')} || ':' || {pad2('k % 24')} AS a, '00:' || {pad2('k % 60')} || ':' || {pad2('i * 10 + 5')} || ':' || {pad2('k % 24')} AS b FROM x)
SELECT o_orderkey, '00' || i || '  ' || rpad('R' || k, 8, ' ') || ' V      C     ' || a || ' ' || b || ' ' || a || ' ' || b AS value FROM e UNION ALL SELECT o_orderkey, 'TITLE: Reel ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'FCM: NON-DROP FRAME' FROM orders
UNION ALL SELECT o_orderkey, '* FROM CLIP NAME: clip ' || p FROM x WHERE i = 1 UNION ALL SELECT o_orderkey, '* a note' FROM orders UNION ALL SELECT o_orderkey, '* SOURCE FILE: f.mov' FROM orders UNION ALL SELECT o_orderkey, '* second note' FROM orders UNION ALL SELECT o_orderkey, 'M2   R' || o_custkey || '       50.0' FROM orders UNION ALL SELECT o_orderkey, '' FROM orders, range(4)""")
def _(t):
    return edl.cmx3600_lines(edl.parse_cmx3600(cut_list(t)), ["o_orderkey"]).select("o_orderkey", "value")


FCP_HEAD = '<fcpxml version="1.10"><resources><format id="r1" frameDuration="1/24s" width="1920" height="1080" />'
FCP_TAIL = "</spine></sequence></project></event></library></fcpxml>"
FCP_NAME = "CASE i WHEN 1 THEN 'clip ' || p ELSE 'R' || k END"


@query(
    "SNK4_fcpxml_export",
    f"""WITH o AS (SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p FROM orders),
 x AS (SELECT *, unnest([1, 2, 3]) AS i FROM o), e AS (SELECT *, printf('%.6f', ((k % 60 * 60 + i * 10) * 24 + k % 24) / 24.0e0) AS off_s FROM x)
SELECT o_orderkey, '{FCP_HEAD}' AS value FROM o
UNION ALL SELECT o_orderkey, '<asset id="R' || k || '" name="clip ' || p || '" src="" />' FROM o
UNION ALL SELECT o_orderkey, '</resources><library><event name="Reel ' || k || '"><project name="Reel ' || k || '"><sequence format="r1"><spine>' FROM o
UNION ALL SELECT o_orderkey, '<asset-clip ref="R' || k || '" name="' || {FCP_NAME} || '" offset="' || off_s || 's" duration="5.000000s" start="' || off_s || 's" />' FROM e
UNION ALL SELECT o_orderkey, '{FCP_TAIL}' FROM o""",
)
def _(t):
    return edl.fcpxml_lines(edl.parse_cmx3600(cut_list(t)), ["o_orderkey"]).select("o_orderkey", "value")


@query("SNK5_kept_frames", """WITH m AS (SELECT video_id, frame_no, event_id, event_type, lag(event_type) OVER (PARTITION BY video_id ORDER BY frame_no) AS p FROM frames), u AS (SELECT *, max(CASE WHEN p IS NULL OR p <> event_type THEN frame_no END) OVER (PARTITION BY video_id ORDER BY frame_no) AS u FROM m),
 c AS (SELECT video_id, u AS frame_no, count(*) AS stands_for FROM u GROUP BY 1, 2) SELECT c.video_id, c.frame_no, stands_for, event_id FROM c JOIN frames f ON f.video_id = c.video_id AND f.frame_no = c.frame_no""")
def _(t):
    m = folds.exact_dedup(t.frames, TIMELINE, "event_type")
    return sinks.kept_frames(m, t.frames.select("video_id", "frame_no", "event_id"), ["video_id"], "frame_no")


@query("SNK6_current_jobs", """SELECT l_orderkey AS job_id, max(l_shipdate) AS updated_at, arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity)) AS state, max(l_quantity) FILTER (WHERE false) AS note,
 arg_max(l_tax, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity)) FILTER (WHERE l_linenumber > 2) AS progress FROM lineitem GROUP BY 1""")
def _(t):
    order = F.struct(C("l_shipdate").cast("timestamp").alias("at"), C("l_partkey").alias("a"), C("l_suppkey").alias("b"), C("l_linenumber").alias("c"), C("l_quantity").alias("d"))
    changes = t.lineitem.select(
        C("l_orderkey").alias("job_id"), order.alias("seq"), C("l_returnflag").alias("state"), L(None).cast("double").alias("note"), F.when(C("l_linenumber") > 2, C("l_tax")).alias("progress"))
    # The log arrives in three parts, in no order of time; each is merged into the snapshot.
    table = keyed.KeyedTable(t.spark, f"jobs_{uuid.uuid4().hex}", ["job_id"])
    for part in range(3):
        keyed.merge_current(table, changes.where(F.pmod(F.xxhash64("job_id", "seq"), L(3)) == part), "seq")
    out = durable_checkpoint(keyed.current_rows(table, "seq"))
    table.drop()
    return out.select("job_id", C("seq.at").alias("updated_at"), "state", "note", "progress")
