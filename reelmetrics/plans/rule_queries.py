"""Queries for the filter and rule family (F), bound to columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import rules as R
from ..operators import rollups as ru
from ..operators import timeline as tl
from ..operators.sequence import Seq
from .bindings import TIMELINE
from .registry import query
from .rollup_queries import AVERAGES, LUMA, MIX, motion, rounded

C, L = F.col, F.lit
r6 = lambda c: F.round(c, 6)


def names(arr, field=None):
    """Comma-joined texts of an array column (of a struct field when given)."""
    return F.array_join(F.transform(arr, lambda x: x[field]) if field else arr, ",")


def over_rows(key, sql, cols):
    """Row-wise rule on the measurement rows: SQL select list and the same columns in Spark."""
    query(key, f"SELECT ok, ln, pk, {sql} FROM rws")(lambda t: t.rows.select("ok", "ln", "pk", *cols()))


def case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def join_words(*pairs):
    """SQL: comma-joined codes whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + ")"


EVENTS_F1 = """SELECT event_id FROM (SELECT event_id, event_type, 'u' || CAST(user_id % 3 AS VARCHAR) AS source, user_id % 4 AS priority, json_extract_string(props, '$.k') AS k FROM events)
WHERE (event_type IN ('view', 'click') AND priority >= 2 AND NOT source = 'u1') OR k = '69'"""


@query("F1_event_filter", EVENTS_F1)
def _(t):
    df = t.events.select("event_id", "event_type", F.concat(L("u"), (C("user_id") % 3).cast("string")).alias("source"), (C("user_id") % 4).alias("priority"), F.from_json("props", "map<string,string>").alias("data"))
    cond = (R.event_filter(types=["view", "click"], min_priority=2) & ~R.event_filter(source="u1")) | R.event_filter(data_key="k", data_value="69")
    return df.where(cond).select("event_id")


@query("F2_job_filter", """SELECT job_id, state FROM jobs WHERE state IN ('O', 'P') AND priority IN ('1-URGENT', '2-HIGH') AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-01-01'
 AND owner % 2 = 0 AND job_id % 3 = 0 AND position('7' IN CAST(job_id AS VARCHAR)) > 0""")
def _(t):
    df = t.jobs.withColumn("tags", R.present(F.when(C("owner") % 2 == 0, "even"), F.when(C("job_id") % 3 == 0, "third"), L("any"))).withColumn("input", C("job_id").cast("string"))
    cond = R.job_filter(["O", "P"], ["1-URGENT", "2-HIGH"], ["even", "third"], F.to_timestamp(L("1996-01-01")), F.to_timestamp(L("2000-01-01")), "7")
    return df.where(cond).select("job_id", "state")


@query("F3_resumable_jobs", "SELECT job_id, state, created_at FROM jobs WHERE state IN ('O', 'P')")
def _(t):
    return t.jobs.where(R.resumable(C("state"), ["O", "P"])).select("job_id", "state", "created_at")


@query("F4_retryable_frames", "SELECT job_id, line, pk, sk FROM job_frames WHERE state = 'R' AND line < 4")
def _(t):
    df = t.lineitem.select(C("l_orderkey").alias("job_id"), C("l_linenumber").alias("line"), C("l_partkey").alias("pk"), C("l_suppkey").alias("sk"), C("l_returnflag").alias("state"))
    return df.where(R.retryable(C("state"), C("line"), 4, "R")).select("job_id", "line", "pk", "sk")


@query("F5_point_lookup", "SELECT job_id, state, size_mb FROM jobs WHERE job_id = 4711")
def _(t):
    return t.jobs.where(C("job_id") == 4711).select("job_id", "state", "size_mb")


over_rows("F6_meets_threshold", "(ln = 1 OR 20 + q / 3.3e0 >= 25) AND (ln = 2 OR 0.8e0 + d >= 0.85e0) AND (ln = 3 OR tx * 1190 >= 70) AS ok_quality",
          lambda: [R.meets_threshold(F.when(C("ln") != 1, L(20.0) + C("q") / 3.3), F.when(C("ln") != 2, L(0.8) + C("d")), F.when(C("ln") != 3, C("tx") * 1190)).alias("ok_quality")])


@query("F7_frames_with_issue", "SELECT ok, ln, pk, i_blur AS has_blur, score < 60 OR i_blur OR i_noise OR i_blocking OR i_interlacing OR i_banding OR i_duplicate OR i_black_frame AS is_problem FROM met")
def _(t):
    return t.met.select("ok", "ln", "pk", F.array_contains("issues", "blur").alias("has_blur"), R.is_problem(C("score"), C("issues")).alias("is_problem"))


EXPO = "CASE WHEN q * 5.1e0 - 4 < 5 THEN 0 ELSE greatest(0, CASE WHEN d > 0.05e0 OR tx > 0.05e0 THEN (1 - abs(q * 5.1e0 - 4 - 128) / 128) * 100 * 0.8e0 ELSE (1 - abs(q * 5.1e0 - 4 - 128) / 128) * 100 END) END"
over_rows("F8_frame_score", f"""round(d / 0.00101e0 * 0.3e0 + tx / 0.00083e0 * 0.25e0 + ({EXPO}) * 0.25e0 + (q + ln * 10 + tx / 0.0103e0) / 3 * 0.2e0, 6) AS score,
 {join_words(("d * 1500 < 100", "'blur'"), ("tx * 300 > 15", "'noise'"), ("q * 5.1e0 - 4 > 250", "'overexposed'"), ("q * 5.1e0 - 4 < 20", "'underexposed'"), ("q * 5.1e0 - 4 < 5", "'black_frame'"), ("ln = 1", "'blocking'"), ("ln = 2", "'banding'"), ("rf = 'R'", "'interlacing'"), ("ls = 'F'", "'duplicate'"))} AS issues""",
          lambda: [r6(R.frame_score(C("d") / 0.00101, C("tx") / 0.00083, R.exposure_score(C("q") * 5.1 - 4, C("d"), C("tx")), C("q"), C("ln") * 10.0, C("tx") / 0.0103)).alias("score"),
                   names(R.frame_issues(C("d") * 1500, C("tx") * 300, C("q") * 5.1 - 4, C("ln") == 1, C("ln") == 2, C("rf") == "R", C("ls") == "F")).alias("issues")])
over_rows("F9_exposure_score", f"round({EXPO}, 6) AS exposure", lambda: [r6(R.exposure_score(C("q") * 5.1 - 4, C("d"), C("tx"))).alias("exposure")])

OVERALL = "(0.8e0 + d * 2) * 0.25e0 + least(1, greatest(0, (20 + q / 1.3e0 - 30) / 20)) * 0.15e0 + tx * 1190 / 100 * 0.2e0 + least(1, q / 40) * 0.1e0 + (1 - least(1, d * 11)) * 0.1e0 + ln / 7.0e0 * 0.1e0 + tx * 12 * 0.1e0"


def overall():
    return R.overall_quality(L(0.8) + C("d") * 2, L(20.0) + C("q") / 1.3, C("tx") * 1190, C("q") / 40, C("d") * 11, C("ln") / 7.0, C("tx") * 12)


over_rows("F10_overall_quality", f"round({OVERALL}, 6) AS score", lambda: [r6(overall()).alias("score")])
WEIGHTS = {"sharpness": 0.2, "noise": 0.2, "contrast": 0.2, "color": 0.15, "temporal": 0.1, "face_quality": 0.15}
WSUM = "(q * 2 * 0.2e0 + (100 - tx * 1190) * 0.2e0 + ext / 1050 * 0.2e0 + d * 990 * 0.15e0 + ln * 13 * 0.1e0)"
over_rows("F11_weighted_quality", f"round(least(100, greatest(0, CASE WHEN rf <> 'R' THEN {WSUM} + q * 1.9e0 * 0.15e0 ELSE {WSUM} * (1 + 0.15e0 / 0.85e0) END)), 6) AS score",
          lambda: [r6(R.weighted_quality({"sharpness": C("q") * 2, "noise": L(100.0) - C("tx") * 1190, "contrast": C("ext") / 1050, "color": C("d") * 990, "temporal": C("ln") * 13.0}, WEIGHTS, F.when(C("rf") != "R", C("q") * 1.9))).alias("score")])
over_rows("F12_letter_grade", case([(f"({OVERALL}) >= {low}e0", f"'{g}'") for g, low in dims.LETTER_GRADES], "'F'") + " AS grade", lambda: [R.letter_grade(overall()).alias("grade")])

QSC = "(" + case([("q >= 40", 100), ("q >= 35", 90), ("q >= 30", 70), ("q >= 25", 50)], 30) + " + " + case([("0.89e0 + d >= 0.98e0", 100), ("0.89e0 + d >= 0.95e0", 90), ("0.89e0 + d >= 0.9e0", 75), ("0.89e0 + d >= 0.85e0", 60)], 40) + " + " + case([("ln < 2", 100), ("ln < 4", 80), ("ln < 6", 60)], 40) + " + (1 - tx * 11) * 100) / 4"
over_rows("F13_qa_grade", f"round({QSC}, 6) AS score, " + case([(f"{QSC} >= 95", "'excellent'"), (f"{QSC} >= 85", "'very_good'"), (f"{QSC} >= 75", "'good'"), (f"{QSC} >= 60", "'acceptable'"), (f"{QSC} >= 40", "'needs_improvement'")], "'poor'") + " AS grade",
          lambda: [r6(R.qa_score(C("q"), C("d") + 0.89, C("ln"), C("tx") * 11)).alias("score"), R.qa_grade(R.qa_score(C("q"), C("d") + 0.89, C("ln"), C("tx") * 11)).alias("grade")])
STYPE = case([("d * 10 < 0.3e0", "'low_quality'"), ("rf = 'A' AND tx * 12 > 0.6e0", "'dialog'"), ("q / 50 > 0.5e0", "'action'"), ("q / 50 < 0.15e0", "'static'")], "'unknown'")


def stype():
    return R.scene_type(C("d") * 10, C("q") / 50, C("tx") * 12, C("rf") == "A")


over_rows("F14_scene_type", f"{STYPE} AS scene_type", lambda: [stype().alias("scene_type")])
SP = {k: [("NULL" if x is None else f"{x}e0") for x in v] for k, v in dims.SCENE_PARAMETERS.items()}
over_rows("F15_scene_parameters", ", ".join("CASE " + STYPE + " " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in SP.items()) + f" END AS {n}" for i, n in enumerate(("denoise", "sharpness", "deblur", "face_restore"))) + """,
 round(CASE WHEN q * 5.1e0 < 60 THEN least(40, 80 - q * 5.1e0) WHEN q * 5.1e0 > 220 THEN greatest(-40, 200 - q * 5.1e0) ELSE 0 END, 6) AS brightness_adjust, d * 10 > 0.8e0 AS skip_processing, d * 10 < 0.4e0 AS use_best_model, CASE WHEN tx * 12 > 0.7e0 THEN 256 END AS tile_size""",
          lambda: _scene_params())


def _scene_params():
    p = R.scene_parameters(stype(), C("q") * 5.1, C("d") * 10, C("tx") * 12)
    return [p[n].alias(n) for n in ("denoise", "sharpness", "deblur", "face_restore")] + [r6(p["brightness_adjust"]).alias("brightness_adjust")] + [p[n].alias(n) for n in ("skip_processing", "use_best_model", "tile_size")]


MLEV = case([("q < 2", "'static'"), ("q < 8", "'minimal'"), ("q < 20", "'moderate'"), ("q < 40", "'high'")], "'extreme'")
LIGHT = case([("q * 5.1e0 > 180", "'bright'"), ("q * 5.1e0 < 60", "'low_light'"), ("d * 10 > 0.3e0 AND tx * 12 > 0.2e0", "'high_contrast'"), ("tx * 12 > 0.4e0 AND d * 10 > 0.2e0", "'backlit'")], "'normal'")


def light():
    return R.lighting(C("q") * 5.1, C("d") * 10, C("tx") * 12)


over_rows("F16_motion_and_lighting", f"{MLEV} AS motion_level, {LIGHT} AS lighting", lambda: [R.motion_level(C("q")).alias("motion_level"), light().alias("lighting")])
CCLS = case([("ln = 1 AND q * ln / 100 > 0.25e0", "'face_closeup'"), ("ln = 1 AND q / 100 > 0.1e0", "'face_medium'"), ("ln > 2 AND ln < 6", "'group_shot'"), ("ls = 'F' AND d * 300 > 100 * 0.15e0", "'text_title'"), (f"{MLEV} = 'extreme'", "'action'"), (f"{MLEV} = 'static'", "'static'"), (f"{LIGHT} IN ('bright', 'normal') AND q / 50 > 0.6e0", "'landscape'")], "'documentary'")


def ccls():
    box = lambda a: F.struct(a.alias("w"), L(1.0).alias("h"))
    faces = F.when(C("ln") < 6, F.array_repeat(box(C("q")), C("ln"))).otherwise(F.array().cast("array<struct<w:double,h:double>>"))
    texts = F.when(C("ls") == "F", F.array(box(C("d") * 300))).otherwise(F.array().cast("array<struct<w:double,h:double>>"))
    return R.content_class(faces, texts, L(100.0), R.motion_level(C("q")), light(), C("q") / 50)


over_rows("F17_content_class", f"{CCLS} AS content", lambda: [ccls().alias("content")])
over_rows("F18_adaptive_settings", f"""round(CASE {CCLS} WHEN 'face_closeup' THEN 0.25e0 WHEN 'text_title' THEN 0.4e0 WHEN 'landscape' THEN 0.36e0 WHEN 'action' THEN 0.35e0 ELSE 0.3e0 END * CASE WHEN {LIGHT} = 'low_light' THEN 0.8e0 ELSE 1 END * CASE WHEN d > 0.05e0 THEN 1.2e0 ELSE 1 END, 6) AS sharpening,
 round(CASE {CCLS} WHEN 'text_title' THEN 0.2e0 ELSE 0.3e0 END * CASE WHEN {MLEV} = 'static' THEN 1.2e0 ELSE 1 END * CASE WHEN {LIGHT} = 'low_light' THEN 1.3e0 ELSE 1 END * CASE WHEN tx > 0.05e0 THEN 1.2e0 ELSE 1 END, 6) AS noise_reduction,
 CASE WHEN {MLEV} = 'static' THEN 0.8e0 WHEN {MLEV} = 'extreme' THEN 0.2e0 WHEN {CCLS} = 'action' THEN 0.3e0 END AS temporal_smoothing""", lambda: _adaptive())


def _adaptive():
    s = R.adaptive_settings(ccls(), R.motion_level(C("q")), light(), C("d") * 10, C("tx") * 10)
    return [r6(s["sharpening"]).alias("sharpening"), r6(s["noise_reduction"]).alias("noise_reduction"), s["temporal_smoothing"].alias("temporal_smoothing")]


NOISE = {"luma": ("q", lambda: C("q")), "chroma": ("d * 700", lambda: C("d") * 700), "grain_intensity": ("ln * 4", lambda: C("ln") * 4), "grain_uniformity": ("tx * 1190", lambda: C("tx") * 1190), "flat": ("ext / 2000", lambda: C("ext") / 2000), "edge": ("q / 2", lambda: C("q") / 2), "low": ("tx * 900", lambda: C("tx") * 900), "mid": ("d * 500", lambda: C("d") * 500), "high": ("tx * 800", lambda: C("tx") * 800), "temporal": ("ext / 3000", lambda: C("ext") / 3000)}
N = {k: f"({v[0]})" for k, v in NOISE.items()}
over_rows("F19_noise_type", case([(f"{N['luma']} * 0.6e0 + {N['chroma']} * 0.4e0 < 5", "'minimal'"), (f"{N['grain_intensity']} > 20 AND {N['grain_uniformity']} > 60", "'film_grain'"), (f"{N['flat']} > {N['edge']} * 1.5e0 AND {N['low']} > 40", "'compression'"), (f"{N['high']} > {N['mid']} * 1.5e0", "'salt_pepper'"), (f"{N['chroma']} > {N['luma']} * 1.5e0", "'chroma'"), (f"{N['temporal']} > {N['luma']}", "'temporal'"), (f"{N['mid']} > 30", "'gaussian'")], "'mixed'") + " AS noise_type",
          lambda: [R.noise_type({k: v[1]() for k, v in NOISE.items()}).alias("noise_type")])

BYJOB = AVERAGES.replace("SELECT video_id,", "SELECT ok AS video_id,").replace("GROUP BY video_id", "GROUP BY ok")
PRIM = case([("face_frame_ratio > 0.5e0 AND avg_face_count > 2", "'face_group'"), ("face_frame_ratio > 0.5e0", "'face_portrait'"), ("avg_brightness < 60", "'low_light'"), ("avg_contrast > 180", "'high_contrast'"), ("avg_edge_density > 0.6e0", "'architecture'"), ("avg_edge_density < 0.15e0", "'animation'")], "'landscape'")
HEAVY = case([("avg_noise > 0.6e0", "'heavy_noise'"), ("avg_noise > 0.4e0", "'film_grain'"), ("avg_noise > 0.2e0", "'light_noise'")], "NULL")
NDEG = "(CASE WHEN avg_noise > 0.2e0 THEN 1 ELSE 0 END + CASE WHEN avg_sharpness < 30 THEN 1 ELSE 0 END + CASE WHEN w < 720 AND avg_noise < 0.3e0 THEN 1 ELSE 0 END)"
SEV = case([(f"avg_noise > 0.6e0 OR {NDEG} >= 3", "'heavy'"), (f"(avg_noise > 0.4e0 AND avg_noise <= 0.6e0) OR {NDEG} >= 2", "'moderate'"), (f"{NDEG} > 0", "'light'")], "'minimal'")
SIZED = BYJOB + ", sz AS (SELECT *, 320 + video_id % 5 * 160 AS w, 20 + video_id % 40 AS fps FROM av)"


def sized(t):
    return ru.video_averages(t.met.withColumn("video_id", C("ok")), ("video_id",)).withColumn("w", C("video_id") % 5 * 160 + 320).withColumn("fps", C("video_id") % 40 + 20)


def graded(t):
    df = sized(t).withColumn("found", R.degradations(C("avg_noise"), C("avg_sharpness"), C("w")))
    return df.withColumn("severity", R.degradation_severity(C("found"))).withColumn("content", R.primary_content())


@query("F20_primary_content", SIZED + f" SELECT video_id, {PRIM} AS content, round(low_light_ratio, 6) AS low_light, round(high_detail_ratio, 6) AS high_detail FROM sz")
def _(t):
    return sized(t).select("video_id", R.primary_content().alias("content"), r6("low_light_ratio").alias("low_light"), r6("high_detail_ratio").alias("high_detail"))


@query("F21_degradations", SIZED + f" SELECT video_id, concat_ws(',', {HEAVY}, CASE WHEN avg_sharpness < 30 THEN 'blur' END, CASE WHEN w < 720 AND avg_noise < 0.3e0 THEN 'compression_artifacts' END) AS found, {SEV} AS severity FROM sz")
def _(t):
    return graded(t).select("video_id", names(C("found")).alias("found"), "severity")


@query("F22_restoration_plan", SIZED + f""", g AS (SELECT *, {PRIM} AS content, {SEV} AS sev FROM sz) SELECT video_id, CASE WHEN w < 720 OR sev IN ('heavy', 'moderate') THEN 4 ELSE 2 END AS scale, CASE WHEN content = 'animation' THEN 'realesrgan-x4plus-anime' ELSE 'realesrgan-x4plus' END AS model,
 CASE {HEAVY} WHEN 'heavy_noise' THEN 0.8e0 WHEN 'film_grain' THEN 0.5e0 WHEN 'light_noise' THEN 0.3e0 ELSE 0e0 END AS denoise, CASE WHEN fps <= 24 THEN 48e0 WHEN fps <= 30 THEN 60e0 END AS target_fps, content IN ('face_portrait', 'face_group') OR face_frame_ratio > 0.3e0 AS face_restoration, sev = 'heavy' AS scratch_removal FROM g""")
def _(t):
    p = R.restoration_plan(C("w"), C("content"), C("found"), C("severity"), C("face_frame_ratio"), C("fps"))
    return graded(t).select("video_id", p.alias("p")).select("video_id", "p.*")


@query("F23_content_mix_class", MIX.replace("GROUP BY 1)", "GROUP BY 1)", 1) + " SELECT ok, ln, pk, k FROM k")
def _(t):
    return t.met.select("ok", "ln", "pk", R.content_mix_class().alias("k"))


@query("F24_model_segment", MIX.replace("video_id", "ok").replace("SELECT *, CASE", "SELECT *, CASE") + """, s AS (SELECT *, greatest(anime_pct, live_action_pct, cgi_pct) AS top FROM mix), z AS (SELECT *, CASE WHEN anime_pct > 80 THEN 'anime' WHEN live_action_pct > 80 THEN 'live_action' WHEN cgi_pct > 80 THEN 'cgi' WHEN anime_pct = top THEN 'anime' WHEN live_action_pct = top THEN 'live_action' ELSE 'cgi' END AS content_type FROM s)
SELECT ok, content_type, CASE content_type WHEN 'anime' THEN 'realesrgan-x4plus-anime' ELSE 'realesrgan-x4plus' END AS model, round(CASE content_type WHEN 'anime' THEN anime_pct WHEN 'live_action' THEN live_action_pct ELSE cgi_pct END / 100, 6) AS confidence FROM z""")
def _(t):
    m = ru.content_mix(t.met, ("ok",), R.content_mix_class())
    s = R.model_segment(C("anime_pct"), C("live_action_pct"), C("cgi_pct"))
    return rounded(m.select("ok", s.alias("s")).select("ok", "s.*"), "confidence")


@query("F25_source_warnings", """WITH m AS (SELECT ok, ln, pk, CAST(q * 9 AS BIGINT) AS h, CAST(q * 16 AS BIGINT) AS w, CAST(floor(ext / 100) AS BIGINT) AS br, rf <> 'R' AS au, ls = 'F' AS il, ln = 7 AS vfr, pk % 15 AS bad FROM rws)
SELECT ok, ln, pk, 'very_low_resolution' AS type, 'warning' AS severity FROM m WHERE h > 0 AND h < 240 UNION ALL SELECT ok, ln, pk, 'low_resolution', 'info' FROM m WHERE h >= 240 AND h < 360
UNION ALL SELECT ok, ln, pk, 'heavy_compression', 'warning' FROM m WHERE br > 0 AND br * 1000 / (w * h * 24) < 0.05e0 UNION ALL SELECT ok, ln, pk, 'interlaced', 'warning' FROM m WHERE il
UNION ALL SELECT ok, ln, pk, 'variable_framerate', 'warning' FROM m WHERE vfr UNION ALL SELECT ok, ln, pk, 'no_audio', 'info' FROM m WHERE NOT au UNION ALL SELECT ok, ln, pk, 'corrupt_frames', CASE WHEN bad > 10 THEN 'error' ELSE 'warning' END FROM m WHERE bad > 0""")
def _(t):
    w, h = (C("q") * 16).cast("long"), (C("q") * 9).cast("long")
    found = R.source_warnings(w, h, F.floor(C("ext") / 100), C("rf") != "R", C("ls") == "F", C("ln") == 7, C("pk") % 15)
    return t.rows.select("ok", "ln", "pk", F.inline(found))


@query("F26_hardware_plan", """WITH m AS (SELECT ok, ln, pk, CAST(q * 32 AS BIGINT) AS w, CAST(q * 18 AS BIGINT) AS h, pk AS fr, CASE WHEN ln % 2 = 0 THEN 4 ELSE 2 END AS sc0, CASE WHEN ls = 'F' THEN 'realesrgan-x2plus' ELSE 'custom' END AS mo, rf <> 'R' AS gpu, sk * 160 AS vt, sk * 100 AS vf FROM rws),
 s AS (SELECT *, CASE WHEN NOT gpu AND sc0 = 4 THEN 2 ELSE sc0 END AS sc FROM m), t AS (SELECT *, CASE WHEN NOT gpu THEN 0 WHEN vf < 2000 THEN 256 WHEN vf < 4000 THEN 384 WHEN vf < 8000 AND w * sc * h * sc / 1e6 > 2 THEN 512 ELSE 0 END AS tile FROM s)
SELECT ok, ln, pk, sc AS scale, tile AS tile_size, CASE WHEN NOT gpu THEN 1 WHEN vt >= 12000 THEN 4 WHEN vt >= 8000 THEN 2 ELSE 1 END AS batch_size, CAST(floor(CASE WHEN tile > 0 THEN tile * sc * tile * sc ELSE w * sc * h * sc END * 400 / 1048576.0e0) AS BIGINT) AS vram_mb,
 round(greatest(0.5e0, w * h / 2073600.0e0) * CASE WHEN sc = 2 THEN 1 ELSE 2.5e0 END * CASE WHEN mo = 'custom' THEN 1 ELSE 0.8e0 END * CASE WHEN NOT gpu THEN 10 WHEN vt >= 12000 THEN 0.5e0 WHEN vt >= 8000 THEN 0.75e0 WHEN vt >= 4000 THEN 1 ELSE 2 END * 50 * (fr / 0.997e0) / 1000 * 1.1e0, 6) AS seconds FROM t""")
def _(t):
    p = R.hardware_plan((C("q") * 32).cast("long"), (C("q") * 18).cast("long"), C("pk") / 0.997, F.when(C("ln") % 2 == 0, 4).otherwise(2), F.when(C("ls") == "F", "realesrgan-x2plus").otherwise("custom"), C("rf") != "R", C("sk") * 160, C("sk") * 100)
    return rounded(t.rows.select("ok", "ln", "pk", p.alias("p")).select("ok", "ln", "pk", "p.*"), "seconds")


IL = "CASE WHEN pk % 20 = 0 THEN 'telecine' WHEN ln < 7 THEN CASE WHEN q / 60 > 0.8e0 THEN 'progressive' WHEN d * 60 / 60 * 9 > 0.4e0 THEN 'interlaced_tff' WHEN tx * 10 > 0.4e0 THEN 'interlaced_bff' ELSE 'mixed' END WHEN q * 2 > 20 THEN 'unknown' ELSE 'progressive' END"
over_rows("F27_interlace_verdict", f"{IL} AS interlace_type, {IL} <> 'progressive' AS is_interlaced, round(CASE WHEN ln < 7 THEN CASE WHEN q / 60 > 0.8e0 THEN q / 60 WHEN d * 9 > 0.4e0 THEN d * 9 WHEN tx * 10 > 0.4e0 THEN tx * 10 ELSE 1 - q / 60 END WHEN pk % 20 <> 0 AND q * 2 > 20 THEN least(q * 2 / 100, 0.9e0) ELSE 0 END, 6) AS confidence, CASE WHEN {IL} = 'progressive' THEN NULL WHEN {IL} = 'telecine' THEN 'yadif' WHEN q * 2 > 50 THEN 'bwdif' ELSE 'yadif' END AS method".replace("d * 60 / 60 * 9", "d * 9"),
          lambda: _interlace())


def _interlace():
    v = R.interlace_verdict(F.when(C("ln") < 7, 60.0), C("d") * 9 * 60, C("tx") * 10 * 60, C("q"), F.when(C("pk") % 20 == 0, "3:2"), C("q") * 2)
    return [v["interlace_type"].alias("interlace_type"), v["is_interlaced"].alias("is_interlaced"), r6(v["confidence"]).alias("confidence"), v["method"].alias("method")]


FPS = "(20 + q * 0.83e0)"
PAT = case([(f"{FPS} BETWEEN 29 AND 30", "'3:2'"), (f"{FPS} BETWEEN 23.5e0 AND 24.5e0", "'unknown'"), (f"{FPS} > 24.5e0 AND {FPS} <= 26", "'2:2'"), (f"{FPS} BETWEEN 59 AND 60", "'3:2'")], "'unknown'")
over_rows("F28_pulldown", f"{PAT} AS pattern, {case([(f'{FPS} BETWEEN 29 AND 30', '0.8e0'), (f'{FPS} BETWEEN 23.5e0 AND 24.5e0', '0.5e0'), (f'{FPS} > 24.5e0 AND {FPS} <= 26', '0.7e0'), (f'{FPS} BETWEEN 59 AND 60', '0.7e0')], '0.4e0')} AS confidence, round({case([(f'{PAT} = ' + chr(39) + '3:2' + chr(39), f'{FPS} * 0.8e0'), (f'{PAT} = ' + chr(39) + '2:2' + chr(39), '24e0'), (f'{FPS} BETWEEN 24.5e0 AND 26', '24e0')], FPS)}, 6) AS source_fps",
          lambda: [R.pulldown(C("q") * 0.83 + 20)["pattern"].alias("pattern"), R.pulldown(C("q") * 0.83 + 20)["confidence"].alias("confidence"), r6(R.source_fps(C("q") * 0.83 + 20, R.pulldown(C("q") * 0.83 + 20)["pattern"])).alias("source_fps")])

E_, RG, BL, CO = "(q * 2)", "(d * 600)", "(tx * 500)", "(0.1e0 + ln / 8.0e0)"
PTS = f"(CASE WHEN {E_} < 30 THEN 2 ELSE 0 END + CASE WHEN {E_} > 80 AND {RG} < 20 THEN 1 ELSE 0 END + CASE WHEN {RG} > 40 THEN 1 ELSE 0 END + CASE WHEN {BL} > 30 THEN 2 ELSE 0 END + CASE WHEN {CO} < 0.7e0 THEN 2 ELSE 0 END)"
VOT = f"list_filter([CASE WHEN {E_} < 30 THEN 0.7e0 END, CASE WHEN {E_} > 80 AND {RG} < 20 THEN 0.5e0 END, CASE WHEN {RG} > 40 THEN 0.6e0 END, CASE WHEN {BL} > 30 THEN 0.8e0 END, CASE WHEN {CO} < 0.7e0 THEN 0.9e0 - {CO} END], lambda x: x IS NOT NULL)"
over_rows("F29_upscale_verdict", f"{PTS} >= 2 AS is_upscaled, round(CASE WHEN {PTS} >= 2 THEN least(1, list_avg({VOT})) ELSE 0.8e0 END, 6) AS confidence, round(CASE WHEN {PTS} >= 2 AND {CO} < 0.7e0 AND least(8, 1 / {CO}) > 1.1e0 THEN least(8, 1 / {CO}) ELSE 1 END, 6) AS factor, CASE WHEN {PTS} < 2 THEN 'none' WHEN {BL} > 30 THEN 'nearest' WHEN {E_} < 30 THEN 'bilinear' WHEN {E_} > 80 AND {RG} < 20 THEN 'ai_upscale' WHEN {RG} > 40 THEN 'lanczos' ELSE 'none' END AS method",
          lambda: _upscale())


def _upscale():
    v = R.upscale_verdict(C("q") * 2, C("d") * 600, C("tx") * 500, C("ln") / 8.0 + 0.1)
    return [v["is_upscaled"].alias("is_upscaled"), r6(v["confidence"]).alias("confidence"), r6(v["factor"]).alias("factor"), v["method"].alias("method")]


RES = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(dims.COMMON_RESOLUTIONS))


@query("F30_snap_resolution", f"""WITH x AS (SELECT row_number() OVER () AS rid, ok, ln, pk, CAST(q * 40 AS BIGINT) AS w, CAST(q * 23 AS BIGINT) AS h, CASE WHEN rf = 'R' THEN 1440 ELSE 1920 END AS bw, 1080 AS bh FROM rws),
 c AS (SELECT x.*, r.w AS rw, r.h AS rh, r.i, abs(r.w * r.h - x.w * x.h) AS dist FROM x LEFT JOIN (VALUES {RES}) r(i, w, h) ON r.w * r.h < bw * bh AND abs(r.w / r.h - bw / bh) <= 0.1e0)
SELECT min(ok) AS ok, min(ln) AS ln, min(pk) AS pk, coalesce(arg_min(rw, (dist, i)) FILTER (WHERE rw IS NOT NULL), min(w)) AS width, coalesce(arg_min(rh, (dist, i)) FILTER (WHERE rw IS NOT NULL), min(h)) AS height FROM c GROUP BY rid""")
def _(t):
    s = R.snap_resolution((C("q") * 40).cast("long"), (C("q") * 23).cast("long"), F.when(C("rf") == "R", 1440).otherwise(1920), L(1080))
    return t.rows.select("ok", "ln", "pk", s["width"].alias("width"), s["height"].alias("height"))


SN = "(CASE WHEN ln > 1 THEN 1 ELSE 0 END + CASE WHEN ln > 3 THEN 1 ELSE 0 END + CASE WHEN ln > 5 THEN 1 ELSE 0 END)"
SS = "(CASE WHEN ln > 1 THEN d * 9 ELSE 0 END + CASE WHEN ln > 3 THEN tx * 12 ELSE 0 END + CASE WHEN ln > 5 THEN q / 50 ELSE 0 END)"
CPX = f"least(1, CASE WHEN pk * 1500 > 2073600 THEN 0.2e0 WHEN pk * 1500 > 921600 THEN 0.1e0 ELSE 0 END + least(0.3e0, {SN} * 0.05e0) + CASE WHEN {SN} > 0 THEN {SS} / {SN} * 0.2e0 ELSE 0 END + CASE WHEN rf = 'A' THEN least(0.1e0, sk % 9 * 0.02e0) + 0.1e0 ELSE 0 END + CASE WHEN q > 25 THEN 0.1e0 ELSE 0 END + CASE WHEN ls = 'O' THEN 0.1e0 ELSE 0 END)"


def cpx():
    none = F.create_map().cast("map<string,double>")
    m = F.map_concat(F.when(C("ln") > 1, F.create_map(L("a"), C("d") * 9)).otherwise(none), F.when(C("ln") > 3, F.create_map(L("b"), C("tx") * 12)).otherwise(none), F.when(C("ln") > 5, F.create_map(L("c"), C("q") / 50)).otherwise(none))
    return R.complexity(C("pk"), L(1500), m, C("rf") == "A", C("sk") % 9, C("q") * 2, C("ls") == "O")


over_rows("F31_complexity", f"round({CPX}, 6) AS complexity", lambda: [r6(cpx()).alias("complexity")])
WANT = "CASE WHEN ln % 2 = 0 THEN 'best' ELSE 'balanced' END"
BASE = case([("rf = 'N' OR q < 4", "'fast'"), (f"{WANT} = 'best' AND q < 6", "'balanced'"), (f"{WANT} = 'best' AND {CPX} > 0.8e0 AND q < 12", "'balanced'")], WANT)
SRC = "CASE sk % 6 WHEN 0 THEN 'vhs' WHEN 1 THEN 'hi8' WHEN 2 THEN 'film_16mm' WHEN 3 THEN 'broadcast' ELSE 'unknown' END"
ERA2 = "CASE pk % 4 WHEN 0 THEN 'silent_film' WHEN 1 THEN 'modern' WHEN 2 THEN 'home_video' ELSE 'golden_age' END"
STY = f"CASE WHEN pk % 30 = 0 OR {SRC} IN ('vhs', 'hi8') THEN 'home_video' WHEN {SRC} = 'film_16mm' OR (ls = 'O' AND d * 10 > 0.4e0) THEN 'film' WHEN {ERA2} IN ('silent_film', 'golden_age') THEN 'archive' WHEN {SRC} = 'broadcast' OR (ln = 5 AND ok % 2 = 0) THEN 'broadcast' WHEN ln > 3 AND tx * 12 > 0.5e0 THEN 'web_video' END"


def src():
    return R.ladder((C("sk") % 6 == 0, "vhs"), (C("sk") % 6 == 1, "hi8"), (C("sk") % 6 == 2, "film_16mm"), (C("sk") % 6 == 3, "broadcast"), default="unknown")


def era2():
    return R.ladder((C("pk") % 4 == 0, "silent_film"), (C("pk") % 4 == 1, "modern"), (C("pk") % 4 == 2, "home_video"), default="golden_age")


def style():
    return R.preset_style(src(), C("pk") % 30 == 0, F.when(C("ls") == "O", C("d") * 10), era2(), C("ln") == 5, F.when(C("ok") % 2 == 0, 720).otherwise(640), F.when(C("ln") > 3, C("tx") * 12))


def wanted():
    return F.when(C("ln") % 2 == 0, "best").otherwise("balanced")


over_rows("F32_preset_choice", f"{BASE} AS preset, {STY} AS style, concat_ws(',', CASE WHEN {WANT} <> {BASE} THEN 'downgraded:' || {WANT} || '->' || {BASE} ELSE 'kept:' || {WANT} END, CASE WHEN ext > 72000 AND {BASE} = 'best' THEN 'long_video' END, 'style:' || coalesce({STY}, 'none')) AS decisions",
          lambda: [R.base_preset(wanted(), C("q"), C("rf") == "N", cpx()).alias("preset"), style().alias("style"), names(R.preset_decisions(wanted(), R.base_preset(wanted(), C("q"), C("rf") == "N", cpx()), style(), C("ext") / 10)).alias("decisions")])

CAPD = f"CASE {ERA2} WHEN 'silent_film' THEN 0.5e0 WHEN 'golden_age' THEN 0.7e0 ELSE 99 END"
over_rows("F33_adjust_settings", f"""round(least({CAPD}, CASE WHEN ln > 4 THEN d * 10 WHEN q > 0 THEN least(1, q * 2 / 100 * 1.2e0) END), 6) AS denoise_strength, least(CASE {ERA2} WHEN 'silent_film' THEN 2 ELSE 99 END, 4e0) AS scale_factor, CASE WHEN ls = 'F' THEN 1e0 END AS enable_deinterlace,
 CASE WHEN tx > 0.025e0 THEN 1e0 END AS enable_face_restore, CASE WHEN q < 20 AND sk >= 8 THEN 24e0 END AS target_fps, round(CASE WHEN rf = 'R' THEN least(1, d * 12 * 1.2e0) END, 6) AS qp_strength""", lambda: _adjusted())


def _adjusted():
    base = F.when(C("ln") > 4, F.create_map(L("scale_factor"), L(4.0), L("denoise_strength"), C("d") * 10)).otherwise(F.create_map(L("scale_factor"), L(4.0)))
    s = R.adjust_settings(base, C("q") * 2, C("ls") == "F", C("tx") * 20, C("q"), C("sk"), F.when(C("rf") == "R", C("d") * 12), era2())
    pick = lambda k: F.try_element_at(s, L(k))
    return [r6(pick("denoise_strength")).alias("denoise_strength"), pick("scale_factor").alias("scale_factor"), pick("enable_deinterlace").alias("enable_deinterlace"), pick("enable_face_restore").alias("enable_face_restore"), pick("target_fps").alias("target_fps"), r6(pick("qp_strength")).alias("qp_strength")]


over_rows("F34_preset_minutes", "round((50 + CASE WHEN ln > 5 THEN 50 ELSE 0 END + CASE WHEN ln > 1 THEN CASE WHEN rf = 'R' THEN 2 ELSE 4 END * 100 * CASE ls WHEN 'F' THEN 50 ELSE 2 END ELSE 0 END + CASE WHEN d > 0.05e0 THEN greatest(1, tx * 30) * 100 ELSE 0 END + CASE WHEN ln = 3 THEN 150 ELSE 0 END + CASE WHEN ln = 4 THEN 30 ELSE 0 END) * CASE WHEN q >= 24 THEN 0.5e0 WHEN q >= 16 THEN 0.7e0 WHEN q >= 8 THEN 1 WHEN q >= 4 THEN 2 ELSE 10 END * pk / 60000, 6) AS minutes",
          lambda: [r6(R.preset_minutes(C("ln") > 5, C("ln") > 1, F.when(C("ls") == "F", "diffusion").otherwise("basicvsr"), F.when(C("rf") == "R", 2.0).otherwise(4.0), C("d") > 0.05, C("tx") * 30, C("ln") == 3, C("ln") == 4, C("q"), C("pk"))).alias("minutes")])

ERA3 = "CASE pk % 3 WHEN 0 THEN 'silent_film' WHEN 1 THEN 'video_era' ELSE 'modern' END"
PHI = "CASE ln % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.0e0 WHEN 2 THEN 1.5e0 ELSE 1.3e0 END"


def era_limit(i):
    v = {e: dims.ERA_LIMITS[e][i] for e in ("silent_film", "video_era", "modern")}
    return f"CASE {ERA3} " + " ".join(f"WHEN '{e}' THEN {float(x)}e0" for e, x in v.items()) + " END"


over_rows("F35_authenticity_limits", f"round(least(d * 10, {era_limit(1)} * {PHI}), 6) AS sharpening, round(least(tx * 12, {era_limit(2)} * {PHI}) * CASE WHEN {ERA3} = 'silent_film' THEN 0.7e0 ELSE 1 END, 6) AS denoise, round(least(d * 11, {era_limit(3)} * {PHI}), 6) AS color, least(ln * 1e0, 4) AS scale, round(CASE WHEN 60 / q > {era_limit(5)} * {PHI} THEN q * ({era_limit(5)} * {PHI}) ELSE 60 END, 6) AS target_fps, round(least(q / 50, {era_limit(6)} * {PHI}), 6) AS face, {ERA3} = 'silent_film' AS preserve_grain, CASE WHEN {ERA3} = 'silent_film' THEN 0.5e0 END AS target_grain",
          lambda: _limits())


def _limits():
    era = R.ladder((C("pk") % 3 == 0, "silent_film"), (C("pk") % 3 == 1, "video_era"), default="modern")
    phi = R.ladder((C("ln") % 4 == 0, "archival"), (C("ln") % 4 == 1, "accessible"), (C("ln") % 4 == 2, "enhanced"), default="presentation")
    s = R.authenticity_limits(era, phi, C("d") * 10, C("tx") * 12, C("d") * 11, C("ln").cast("double"), C("q"), L(60.0), C("q") / 50)
    return [r6(s[n]).alias(n) for n in ("sharpening", "denoise", "color", "scale", "target_fps", "face")] + [s["preserve_grain"].alias("preserve_grain"), s["target_grain"].alias("target_grain")]


@query("F36_era_and_medium", """WITH x AS (SELECT ok, ln, pk, CASE WHEN ln <> 7 THEN 1900 + pk % 120 END AS yr, rf <> 'R' AS co, CASE ln WHEN 1 THEN 1.33e0 WHEN 2 THEN 1.395e0 WHEN 3 THEN 1.85e0 ELSE 1.78e0 END AS asp, q AS fps, ls = 'F' AS il, d * 200 AS gr, tx * 4000 AS sh, 300 + sk * 4 AS w, CASE ok % 5 WHEN 0 THEN 'VHS tape' WHEN 1 THEN 'some Film' WHEN 2 THEN 'betamax' END AS hint FROM rws),
 p AS (SELECT *, yr IS NOT NULL AS hy, abs(asp - 1.33e0) < 0.05e0 AS tv, abs(asp - 1.33e0) >= 0.05e0 AND abs(asp - 1.37e0) < 0.05e0 AS ac, abs(asp - 1.85e0) < 0.05e0 AS wi, fps < 20 AS sl, fps >= 20 AND abs(fps - 24) < 1 AS fi FROM x),
 s AS (SELECT *, [CASE WHEN yr < 1930 THEN 5 ELSE 0 END + CASE WHEN NOT co THEN 2 ELSE 0 END + CASE WHEN tv THEN 1 ELSE 0 END + CASE WHEN sl THEN 2 ELSE 0 END + CASE WHEN gr > 15 THEN 1 ELSE 0 END + CASE WHEN sh < 50 THEN 1.0e0 ELSE 0 END,
  CASE WHEN yr >= 1930 AND yr < 1940 THEN 5 ELSE 0 END + CASE WHEN NOT co THEN 1.5e0 ELSE 0 END + CASE WHEN tv THEN 1 ELSE 0 END + CASE WHEN gr > 15 THEN 0.5e0 ELSE 0 END,
  CASE WHEN yr >= 1940 AND yr < 1960 THEN 5 ELSE 0 END + CASE WHEN ac THEN 1 ELSE 0 END + CASE WHEN fi THEN 0.5e0 ELSE 0 END + CASE WHEN gr > 10 AND gr <= 15 THEN 0.5e0 ELSE 0 END,
  CASE WHEN yr >= 1960 AND yr < 1980 THEN 5 ELSE 0 END + CASE WHEN wi THEN 1 ELSE 0 END + CASE WHEN fi THEN 0.5e0 ELSE 0 END,
  CASE WHEN yr >= 1980 AND yr < 2000 THEN 5 ELSE 0 END + CASE WHEN tv THEN 0.5e0 ELSE 0 END + CASE WHEN il THEN 2 ELSE 0 END,
  CASE WHEN yr >= 2000 AND yr < 2010 THEN 5 ELSE 0 END + CASE WHEN il THEN 1.0e0 ELSE 0 END, CASE WHEN yr >= 2010 THEN 5 ELSE 0 END + CASE WHEN wi THEN 0.5e0 ELSE 0 END + CASE WHEN sh > 200 THEN 1.0e0 ELSE 0 END] AS sc FROM p),
 e AS (SELECT *, ['silent_film', 'early_talkies', 'golden_age', 'new_hollywood', 'video_era', 'digital_transition', 'modern'][list_position(sc, list_max(sc))] AS era, CASE WHEN list_sum(sc) > 0 THEN list_max(sc) / list_sum(sc) ELSE 0.5e0 END AS cf FROM s)
SELECT ok, ln, pk, era, round(cf, 6) AS era_confidence, CASE WHEN hint = 'VHS tape' THEN 'vhs' WHEN hint = 'betamax' THEN 'betamax' WHEN hint = 'some Film' THEN CASE WHEN era IN ('silent_film', 'early_talkies') THEN 'nitrate_film' ELSE 'acetate_film' END
 WHEN il AND era = 'video_era' THEN CASE WHEN w < 500 THEN 'vhs' ELSE 'betacam' END WHEN era IN ('silent_film', 'early_talkies') THEN 'nitrate_film' WHEN era IN ('golden_age', 'new_hollywood') THEN 'acetate_film' WHEN era = 'video_era' THEN 'vhs' WHEN era = 'digital_transition' THEN 'digital_tape' ELSE 'digital_file' END AS medium FROM e""")
def _(t):
    asp = R.ladder((C("ln") == 1, 1.33), (C("ln") == 2, 1.395), (C("ln") == 3, 1.85), default=1.78)
    sc = R.era_scores(F.when(C("ln") != 7, C("pk") % 120 + 1900), C("rf") != "R", asp, C("q"), C("ls") == "F", C("d") * 200, C("tx") * 4000)
    df = t.rows.select("*", R.classify_era(sc).alias("e"))
    hint = R.ladder((C("ok") % 5 == 0, "VHS tape"), (C("ok") % 5 == 1, "some Film"), (C("ok") % 5 == 2, "betamax"))
    m = R.classify_medium(C("e.era"), C("ls") == "F", C("sk") * 4 + 300, hint)
    return df.select("ok", "ln", "pk", "e.era", r6("e.confidence").alias("era_confidence"), m["medium"].alias("medium"))


over_rows("F36_source_and_era_by_picture", """CASE WHEN pk % 9 = 0 THEN 'vhs' WHEN w = 720 AND ok % 2 = 0 THEN CASE WHEN q * 2 > 70 THEN 'dvd' END WHEN rf = 'R' AND w < 1000 THEN 'film_16mm' WHEN rf = 'R' THEN 'film_35mm' WHEN w >= 1920 AND q * 2 > 80 THEN 'digital' WHEN ls = 'F' AND w IN (720, 1920) THEN 'broadcast' END AS source,
 CASE WHEN ln < 3 AND q < 20 THEN 'silent_film' WHEN ln < 3 AND q BETWEEN 20 AND 25 THEN 'early_sound' WHEN pk % 9 = 0 THEN 'home_video' WHEN w >= 1920 AND q * 2 > 90 THEN 'modern' WHEN w >= 1920 THEN 'digital_early' WHEN w < 480 THEN 'golden_age' WHEN w < 720 THEN 'new_hollywood' ELSE 'digital_early' END AS era""".replace("w ", "(CASE sk % 5 WHEN 0 THEN 320 WHEN 1 THEN 640 WHEN 2 THEN 720 WHEN 3 THEN 1440 ELSE 1920 END) "), lambda: _picture())


def _picture():
    w = R.ladder((C("sk") % 5 == 0, 320), (C("sk") % 5 == 1, 640), (C("sk") % 5 == 2, 720), (C("sk") % 5 == 3, 1440), default=1920)
    s = R.source_kind(C("pk") % 9 == 0, w, F.when(C("ok") % 2 == 0, 480).otherwise(500), C("q") * 2, C("rf") == "R", C("ls") == "F")
    return [s.alias("source"), R.era_by_picture(C("ln") < 3, C("q"), s, w, L(8), C("q") * 2).alias("era")]


over_rows("F37_vhs_score", "round(least(1, CASE WHEN ln > 1 THEN d * 9 * 0.15e0 ELSE 0 END + CASE WHEN ln > 2 THEN tx * 12 * 0.25e0 ELSE 0 END + CASE WHEN ln > 3 THEN q / 50 * 0.15e0 ELSE 0 END + CASE WHEN ln > 4 THEN d * 8 * 0.1e0 ELSE 0 END + least(1, pk % 70 / 50.0e0) * 0.2e0 + CASE WHEN rf = 'R' THEN 0.08e0 ELSE 0 END + CASE WHEN ls = 'F' THEN 0.07e0 ELSE 0 END), 6) AS score",
          lambda: [r6(R.vhs_score({"head_switching": C("ln") > 1, "tracking": C("ln") > 2, "chroma_bleed": C("ln") > 3, "jitter": C("ln") > 4}, {"head_switching": C("d") * 9, "tracking": C("tx") * 12, "chroma_bleed": C("q") / 50, "jitter": C("d") * 8}, C("pk") % 70, C("rf") == "R", C("ls") == "F")).alias("score")])

MSGS = ("CUDA error", "file broken", "Timeout hit", "strange", "invalid data in GPU file", "connection lost", "No space left on device", "SSL handshake", "CRC error", "command not found")


def message():
    return F.element_at(F.array(*[L(m) for m in MSGS]), (C("pk") % 10 + 1).cast("int"))


MSG = "[" + ", ".join(f"'{m}'" for m in MSGS) + "][pk % 10 + 1]"


def like_any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


over_rows("F38_recovery_strategy", case([(like_any(f"lower({MSG})", w), f"'{s}'") for s, w in dims.RECOVERY], "'retry'") + " AS strategy", lambda: [R.recovery_strategy(message()).alias("strategy")])
over_rows("F39_thermal", "CASE WHEN ln = 7 THEN 'unknown' WHEN 40 + q < 60 THEN 'cool' WHEN 40 + q < 75 THEN 'warm' WHEN 40 + q <= 85 THEN 'hot' ELSE 'critical' END AS state, coalesce(CASE WHEN ln <> 7 THEN 40 + q END > 83 OR CASE WHEN ln <> 7 THEN 40 + q END - (50 + ln) > 15, false) AS throttled",
          lambda: [R.thermal_state(F.when(C("ln") != 7, C("q") + 40)).alias("state"), R.throttled(C("ln") + 50, F.when(C("ln") != 7, C("q") + 40)).alias("throttled")])
MUL = "CASE WHEN 240 / q <= 2 THEN 2 WHEN 240 / q <= 4 THEN 4 WHEN 240 / q <= 8 THEN 8 ELSE 16 END"
over_rows("F40_interpolation_plan", f"{MUL} AS multiplier, q * ({MUL}) AS intermediate_fps, abs(q * ({MUL}) - 240) > 0.5e0 AS needs_decimation, CASE WHEN abs(q * ({MUL}) - 240) > 0.5e0 THEN 240e0 ELSE q * ({MUL}) END AS final_fps", lambda: [R.interpolation_plan(C("q"), L(240.0))[n].alias(n) for n in ("multiplier", "intermediate_fps", "needs_decimation", "final_fps")])


@query("F41_item_errors", r"""WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '_' END) END AS id, CASE WHEN p_size > 40 THEN '' ELSE p_name END AS ti, CASE p_partkey % 5 WHEN 0 THEN '1999' WHEN 1 THEN '1999-02' WHEN 2 THEN '1999-2-1' WHEN 3 THEN NULL ELSE 'May' END AS dt FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN id = '' THEN 'identifier_missing' WHEN NOT regexp_full_match(id, '[a-zA-Z0-9][a-zA-Z0-9_.-]*') THEN 'identifier_invalid' END, CASE WHEN ti = '' THEN 'title_missing' END, CASE WHEN dt IS NOT NULL AND NOT regexp_full_match(dt, '\d{4}(-\d{2}(-\d{2})?)?') THEN 'date_invalid' END) AS errors FROM i""")
def _(t):
    ident = F.when(C("p_partkey") % 7 == 0, "").when(C("p_partkey") % 3 == 0, C("p_name")).otherwise(F.replace("p_name", L(" "), L("_")))
    date = R.ladder((C("p_partkey") % 5 == 0, "1999"), (C("p_partkey") % 5 == 1, "1999-02"), (C("p_partkey") % 5 == 2, "1999-2-1"), (C("p_partkey") % 5 == 3, L(None).cast("string")), default="May")
    return t.part.select("p_partkey", names(R.item_errors(ident, F.when(C("p_size") > 40, "").otherwise(C("p_name")), date)).alias("errors"))


@query("F42_skip_frames", "SELECT ok, ln, pk FROM rws WHERE d * 10 >= 0.85e0")
def _(t):
    return t.rows.where(R.skip_frame(C("d") * 10)).select("ok", "ln", "pk")


@query(
    "F43_camera_motion",
    """WITH mo AS (SELECT video_id, frame_no, (value - 20) / (video_id % 40 + 1) AS dx,
  CASE WHEN video_id % 3 = 0 THEN 9 * sin(frame_no * 2 * pi() / (20 + video_id % 41)) ELSE (video_id % 30) / 3.0e0 END AS dy FROM frames),
 l AS (SELECT *, dx - lag(dx) OVER w AS hx, dy - lag(dy) OVER w AS hy FROM mo WINDOW w AS (PARTITION BY video_id ORDER BY frame_no)),
 g AS (SELECT video_id, count(*) AS n, avg(sqrt(dx * dx + dy * dy)) AS m, avg(dx) AS mx, avg(dy) AS my, stddev_pop(dx) AS sx, stddev_pop(dy) AS sy, stddev_pop(hx) + stddev_pop(hy) AS hf FROM l GROUP BY 1),
 ac AS (SELECT a.video_id, b.frame_no - a.frame_no AS lag_no, sum(a.dy * b.dy) AS v FROM mo a JOIN mo b ON b.video_id = a.video_id AND b.frame_no >= a.frame_no GROUP BY 1, 2),
 pk AS (SELECT video_id, count(*) AS peaks FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ac WINDOW w AS (PARTITION BY video_id ORDER BY lag_no)) WHERE v > p + 1e-9 AND v > q + 1e-9 GROUP BY 1)
SELECT g.video_id, CASE WHEN m < 0.5e0 THEN 'static' WHEN abs(mx) / (sx + 1) + abs(my) / (sy + 1) > 2 THEN 'panning' WHEN hf > 5 AND m < 20 THEN 'handheld'
  WHEN n > 20 AND coalesce(peaks, 0) > 3 THEN 'walking' ELSE 'handheld' END AS motion, round(m, 6) AS magnitude, round(hf, 6) AS jitter FROM g LEFT JOIN pk ON pk.video_id = g.video_id""",
)
def _(t):
    dy = F.when(C("video_id") % 3 == 0, F.sin(C("frame_no") * 2 * F.pi() / (C("video_id") % 41 + 20)) * 9).otherwise((C("video_id") % 30) / 3.0)
    df = t.frames.select("video_id", "frame_no", ((C("value") - 20) / (C("video_id") % 40 + 1)).alias("dx"), dy.alias("dy"))
    g = tl.lagged(df, TIMELINE, {"px": "dx", "py": "dy"}).groupBy("video_id").agg(
        F.count(L(1)).alias("n"), F.avg(F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))).alias("m"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.stddev_pop("dx").alias("sx"), F.stddev_pop("dy").alias("sy"),
        (F.stddev_pop(C("dx") - C("px")) + F.stddev_pop(C("dy") - C("py"))).alias("hf"))
    g = g.join(tl.periodic_motion(df, TIMELINE, "dy"), "video_id", "left")
    motion = R.camera_motion(C("n"), C("m"), C("mx"), C("my"), C("sx"), C("sy"), C("hf"), F.coalesce("periodic", L(False)))
    return g.select("video_id", motion.alias("motion"), r6("m").alias("magnitude"), r6("hf").alias("jitter"))


AIS = "(CASE WHEN ln > 4 AND d * 30 > 1 THEN 2 ELSE 0 END + CASE WHEN rf = 'R' THEN 1 ELSE 0 END + CASE WHEN ls = 'F' AND q - 90 > -50 THEN 1 ELSE 0 END + CASE WHEN pk % 30 > 20 THEN 1 ELSE 0 END + CASE WHEN tx * 500 < 20 THEN 1 ELSE 0 END + CASE WHEN q - 75 > -40 THEN 2 ELSE 0 END)"
over_rows("F44_audio_quality", case([(f"{AIS} >= 5", "'damaged'"), (f"{AIS} >= 3", "'poor'"), (f"{AIS} >= 2", "'fair'"), (f"{AIS} >= 1", "'good'")], "'excellent'") + " AS quality",
          lambda: [R.audio_quality(F.when(C("ln") > 4, C("d") * 30), C("rf") == "R", F.when(C("ls") == "F", C("q") - 90), C("pk") % 30, C("tx") * 500, C("q") - 75).alias("quality")])


@query("F45_audio_issues", """WITH x AS (SELECT ok, ln, pk, d * 60 - 4 AS mx, q - 70 AS mean, pk % 200 AS cc, CASE WHEN ln > 3 THEN tx * 200 ELSE 0 END AS si FROM rws)
SELECT ok, ln, pk, concat_ws(',', CASE WHEN si > 0 THEN 'silence:' || CASE WHEN si > 10 THEN 'high' WHEN si > 5 THEN 'medium' ELSE 'low' END END, CASE WHEN mx >= 0 THEN 'clipping:' || CASE WHEN cc > 100 THEN 'high' ELSE 'medium' END END, CASE WHEN mean < -40 THEN 'low_volume:low' END) AS issues, NOT (si > 10 OR (mx >= 0 AND cc > 100)) AS acceptable FROM x""")
def _(t):
    found = R.audio_issues(C("d") * 60 - 4, C("q") - 70, C("pk") % 200, F.when(C("ln") > 3, C("tx") * 200).otherwise(0.0))
    df = t.rows.select("ok", "ln", "pk", found.alias("f"))
    return df.select("ok", "ln", "pk", F.array_join(F.transform("f", lambda x: F.concat(x["type"], L(":"), x["severity"])), ",").alias("issues"), (~F.exists("f", lambda x: x["severity"] == "high")).alias("acceptable"))


ASP = ", ".join(f"({i}, '{n}', {a / b!r}e0)" for i, (n, a, b) in enumerate(dims.ASPECT_RATIOS))


@query("F46_aspect_match", f"""WITH x AS (SELECT row_number() OVER () AS rid, ok, ln, pk, 0.9e0 + q / 19 AS r, CASE WHEN rf = 'R' THEN 720 ELSE 640 END AS w, CASE WHEN ls = 'F' THEN 576 ELSE 480 END AS h, 1 + d / 3 AS par FROM rws),
 c AS (SELECT x.*, a.i, a.n, abs(a.r - x.r) AS dist FROM x LEFT JOIN (VALUES {ASP}) a(i, n, r) ON abs(a.r - x.r) / x.r < 0.05e0),
 b AS (SELECT rid, min(ok) AS ok, min(ln) AS ln, min(pk) AS pk, min(r) AS r, min(w) AS w, min(h) AS h, min(par) AS par, arg_min(n, (dist, i)) FILTER (WHERE n IS NOT NULL) AS aspect FROM c GROUP BY rid), s AS (SELECT *, r / (w / h) AS s FROM b)
SELECT ok, ln, pk, aspect, w = 720 AND abs(par - 1) > 0.01e0 AS pal_squeeze, s > 1.3e0 AS is_anamorphic, round(CASE WHEN s > 1.9e0 AND s < 2.1e0 THEN 2 WHEN s > 1.4e0 AND s < 1.6e0 THEN 1.5e0 WHEN s > 1.2e0 AND s < 1.4e0 THEN 1.33e0 ELSE s END, 6) AS squeeze FROM s""")
def _(t):
    r, w, h = C("q") / 19 + 0.9, F.when(C("rf") == "R", 720).otherwise(640), F.when(C("ls") == "F", 576).otherwise(480)
    a = R.anamorphic(w / h, r)
    return t.rows.select("ok", "ln", "pk", R.closest_aspect(r).alias("aspect"), R.pal_squeeze(w, h, C("d") / 3 + 1).alias("pal_squeeze"), a["is_anamorphic"].alias("is_anamorphic"), r6(a["squeeze"]).alias("squeeze"))


over_rows("F47_film", "CASE WHEN pk * sk * 50 / 1e6 < 2 THEN 'super_8' WHEN pk * sk * 50 / 1e6 < 4 THEN '16mm' WHEN pk * sk * 50 / 1e6 < 15 THEN '35mm' WHEN pk * sk * 50 / 1e6 < 30 THEN '70mm' ELSE 'imax' END AS format, CASE WHEN rf = 'R' AND d * 10 > 0.7e0 THEN 'silent' WHEN rf = 'R' THEN 'early_sound' WHEN tx * 12 > 0.5e0 THEN 'golden_age' WHEN d * 10 > 0.4e0 THEN 'new_hollywood' WHEN d * 10 > 0.2e0 THEN 'modern' ELSE 'digital_era' END AS era, round(least(1, 0.5e0 + CASE WHEN ln > 1 THEN 0.2e0 ELSE 0 END + CASE WHEN ls = 'F' THEN 0.1e0 ELSE 0 END + CASE WHEN d * 10 > 0.1e0 THEN 0.1e0 ELSE 0 END + CASE WHEN rf = 'R' OR tx * 12 > 0.2e0 THEN 0.1e0 ELSE 0 END), 6) AS confidence",
          lambda: [R.film_format(C("pk") * C("sk"), L(50)).alias("format"), R.film_era(C("rf") != "R", C("d") * 10, C("tx") * 12).alias("era"), r6(R.film_confidence(C("ln") > 1, C("ls") == "F", C("d") * 10, C("rf") != "R", C("tx") * 12)).alias("confidence")])
INTEN = "CASE " + CCLS + " " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in dims.CONTENT_INTENSITY.items()) + " END"
over_rows("F48_processing_intensity", f"round(least(1, greatest(0, {INTEN} * ((CASE {MLEV} WHEN 'static' THEN 1.2e0 WHEN 'moderate' THEN 0.9e0 ELSE 1.0e0 END - 1) * 0.5e0 + 1) - least(0.3e0, ln * 0.1e0) - least(0.3e0, pk % 3 * 0.15e0))), 6) AS intensity",
          lambda: [r6(R.processing_intensity(ccls(), R.motion_level(C("q")), C("ln"), C("pk") % 3)).alias("intensity")])

ERA4 = "CASE ok % 4 WHEN 0 THEN 'silent_era' WHEN 1 THEN 'classic' ELSE 'digital' END"
SEV4 = "CASE pk % 5 WHEN 0 THEN 'minimal' WHEN 1 THEN 'light' WHEN 2 THEN 'moderate' WHEN 3 THEN 'heavy' ELSE 'odd' END"


@query("F49_recommendations", f"""WITH x AS (SELECT *, {ERA4} AS era, {SEV4} AS sev, CASE ln % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'quality' ELSE 'ultimate' END AS p0, CASE WHEN q < 10 THEN 480 ELSE 1080 END AS w FROM rws),
 a AS (SELECT *, CASE WHEN era IN ('silent_era', 'classic') AND p0 IN ('fast', 'balanced') THEN 'quality' ELSE p0 END AS p1 FROM x), b AS (SELECT *, CASE WHEN sev = 'heavy' AND p1 <> 'ultimate' THEN 'quality' ELSE p1 END AS p2 FROM a), p AS (SELECT *, CASE WHEN p2 = 'ultimate' THEN 'quality' ELSE p2 END AS preset FROM b)
SELECT ok, ln, pk, preset, {join_words(("d * 10 > 0.3e0", "'qp_artifact_removal=on'"), ("tx * 12 > 0.3e0", "'tap_denoise=on'"), ("era = 'silent_era'", "'deduplication=on'"), ("true", "'scale_factor=' || CASE WHEN w < 720 THEN '4' ELSE '2' END"), ("ls = 'F'", "'model_name=realesr-animevideov3'"), ("true", "'auto_face_restore=' || CASE WHEN q > 10 THEN 'on' ELSE 'off' END"), ("q > 10 AND preset = 'quality'", "'face_model=aesrgan'"), ("d > 0.03e0", "'frame_generation=on'"), ("q < 24", "'target_fps=' || CASE WHEN q < 15 THEN '30' WHEN q < 20 THEN '25' ELSE '24' END"), ("tx * 10 > 0.3e0", "'temporal_method=' || CASE WHEN preset = 'quality' THEN 'hybrid' ELSE 'optical_flow' END"), ("rf = 'R'", "'colorization_available=on'"))} AS settings,
 CASE preset WHEN 'fast' THEN 2e0 WHEN 'balanced' THEN 4e0 ELSE 8e0 END + CASE WHEN tx * 12 > 0.3e0 THEN 2 ELSE 0 END + CASE WHEN d > 0.03e0 THEN 4 ELSE 0 END AS vram_gb, round(CASE preset WHEN 'fast' THEN 0.6e0 WHEN 'balanced' THEN 0.75e0 ELSE 0.85e0 END - CASE sev WHEN 'minimal' THEN 0 WHEN 'light' THEN 0.05e0 WHEN 'heavy' THEN 0.15e0 ELSE 0.1e0 END + 0.05e0, 6) AS quality FROM p""")
def _(t):
    era = R.ladder((C("ok") % 4 == 0, "silent_era"), (C("ok") % 4 == 1, "classic"), default="digital")
    sev = R.ladder(*[(C("pk") % 5 == i, s) for i, s in enumerate(("minimal", "light", "moderate", "heavy"))], default="odd")
    pri = R.ladder(*[(C("ln") % 4 == i, s) for i, s in enumerate(("speed", "balanced", "quality"))], default="maximum")
    rec = R.recommend(era, sev, C("tx") * 12, C("d") * 10, C("tx") * 10, C("d") / 3, F.when(C("q") < 10, 480).otherwise(1080), C("q"), F.when(C("ls") == "F", "animation").otherwise("film"), C("q"), C("rf") == "R", pri, 12.0)
    df = t.rows.select("ok", "ln", "pk", rec.alias("r"))
    return df.select("ok", "ln", "pk", "r.preset", names(C("r.settings")).alias("settings"), "r.vram_gb", r6("r.quality").alias("quality"))


@query("F50_preset_by_text", """SELECT p_partkey, CASE WHEN f LIKE '%vhs%' THEN 'vhs_home_movie' WHEN f LIKE '%8mm%' THEN 'film_8mm' WHEN f LIKE '%16mm%' THEN 'film_16mm' WHEN c LIKE '%animation%' THEN 'animation_cel' WHEN c LIKE '%documentary%' THEN 'documentary_archive' WHEN c LIKE '%gam%' THEN 'gaming_retro' ELSE 'quick_cleanup' END AS preset
 FROM (SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN 'Old VHS' WHEN 1 THEN '16MM print' WHEN 2 THEN 'Super 8mm' ELSE p_name END) AS f, lower(CASE p_partkey % 4 WHEN 0 THEN 'Animation' WHEN 1 THEN 'A Documentary' WHEN 2 THEN 'Gaming' ELSE p_type END) AS c FROM part)""")
def _(t):
    f = R.ladder((C("p_size") % 4 == 0, L("Old VHS")), (C("p_size") % 4 == 1, L("16MM print")), (C("p_size") % 4 == 2, L("Super 8mm")), default=C("p_name"))
    c = R.ladder((C("p_partkey") % 4 == 0, L("Animation")), (C("p_partkey") % 4 == 1, L("A Documentary")), (C("p_partkey") % 4 == 2, L("Gaming")), default=C("p_type"))
    return t.part.select("p_partkey", R.preset_by_text(f, c).alias("preset"))


over_rows("F51_hdr_candidate", "q / 6 > 8 OR d * 6 > 0.5e0 OR (ext / 1050 > 80 AND tx * 100 < 5) AS candidate", lambda: [R.hdr_candidate(C("q") / 6, C("d") * 6, C("ext") / 1050, C("tx") * 100).alias("candidate")])
over_rows("F52_frame_validation", "CASE WHEN ln = 7 THEN 'NULL_FRAME' ELSE " + join_words(("q * 5.3e0 < 6 AND ln = 6", "'CORRUPT_VALUES'"), ("q * 5.3e0 - 3 < 5 AND ln <> 6", "'BLACK_FRAME'"), ("q * 5.3e0 - 3 > 250", "'WHITE_FRAME'"), ("ext / 500 < 100", "'BLURRY_FRAME'"), ("d * 5 > 0.3e0", "'POTENTIAL_ARTIFACT'"), ("tx * 300 < 10", "'HIGH_DIFF_ORIGINAL'")) + " END AS issues",
          lambda: [names(R.frame_validation(F.when((C("ln") == 6) & (C("q") * 5.3 < 6), L(float("nan"))).when(C("ln") != 7, C("q") * 5.3 - 3), C("ext") / 500, C("d") * 5, C("tx") * 300), "code").alias("issues")])
over_rows("F53_error_class", case([(like_any(f"lower({MSG} || ' ' || coalesce(CASE WHEN ln = 1 THEN 'Out of memory' WHEN ln = 2 THEN 'file truncated' END, ''))", w), f"'{s}'") for s, w in dims.ERROR_CLASSES], "'base'") + " AS error_class",
          lambda: [R.error_class(message(), R.ladder((C("ln") == 1, "Out of memory"), (C("ln") == 2, "file truncated"))).alias("error_class")])
over_rows("F54_vmaf_grade", case([(f"q * 2 >= {v}", f"'{g}'") for g, v in dims.VMAF_GRADES], "'Bad'") + " AS grade", lambda: [R.vmaf_grade(C("q") * 2).alias("grade")])
TRIG = "(CASE WHEN ext / 1000 >= 100 OR coalesce(CASE WHEN ln > 1 THEN q * 4 END < 60, false) THEN 'manual' WHEN pk % 130 >= 100 THEN 'queue_depth' WHEN tx * 1000 >= 60 THEN 'processing_time' WHEN d * 10 >= 0.95e0 THEN 'vram_pressure' ELSE 'manual' END)"
over_rows("F55_scale_out", f"{TRIG} <> 'manual' AS burst, {TRIG} AS trigger",
          lambda: [R.scale_out(C("ext") / 1000, F.when(C("ln") > 1, C("q") * 4), C("pk") % 130, C("tx") * 1000 * 1000, C("d") * 10)[n].alias(n) for n in ("burst", "trigger")])
over_rows("F56_deadline_plan", "pk * 100 / q > ext / 10.7e0 AS burst, CASE WHEN pk * 100 / q > ext / 10.7e0 THEN CAST(least(greatest(1, floor((pk * 100 / (ext / 10.7e0) - q) / 10)), 4) AS BIGINT) ELSE 0 END AS instances, round(CASE WHEN pk * 100 / q > ext / 10.7e0 THEN least(greatest(1, floor((pk * 100 / (ext / 10.7e0) - q) / 10)), 4) ELSE 0 END * 2 * (ext / 10.7e0) / 3600, 6) AS cost, round(CASE WHEN pk * 100 / q > ext / 10.7e0 THEN ext / 10.7e0 ELSE pk * 100 / q END / 3600, 6) AS hours",
          lambda: _deadline())


def _deadline():
    p = R.deadline_plan(C("pk") * 100, C("q"), C("ext") / 10.7)
    return [p["burst"].alias("burst"), p["instances"].alias("instances"), r6(p["cost"]).alias("cost"), r6(p["hours"]).alias("hours")]


CODEC = "CASE ln WHEN 1 THEN 'AV01' WHEN 2 THEN 'vp09.00' WHEN 3 THEN 'avc1' WHEN 4 THEN NULL ELSE 'mpeg2' END"
FSC = "round(pk * 10.0e0 + CASE ln WHEN 1 THEN 3000 WHEN 2 THEN 2000 WHEN 3 THEN 1000 ELSE 0 END + CASE WHEN q * 1.5e0 >= 60 THEN 500 WHEN q * 1.5e0 >= 30 THEN 250 ELSE 0 END + ext / 100, 6)"


def fscore():
    codec = R.ladder((C("ln") == 1, "AV01"), (C("ln") == 2, "vp09.00"), (C("ln") == 3, "avc1"), (C("ln") == 4, L(None).cast("string")), default="mpeg2")
    return r6(R.format_score(C("pk"), codec, C("q") * 1.5, C("ext")))


over_rows("F57_format_score", f"{FSC} AS score", lambda: [fscore().alias("score")])
over_rows("F58_missing_share", "round(CASE WHEN pk < floor(q * ln * 10) * 0.95e0 THEN 1 - pk / floor(q * ln * 10) END, 6) AS missing", lambda: [r6(R.missing_share(C("pk"), C("q"), C("ln") * 10)).alias("missing")])
over_rows("F59_picture_rules", "CASE WHEN d * 10 > 0.7e0 AND q - 20 <= 0 THEN 'animation' WHEN q - 20 > 50 - 30 AND rf = 'R' THEN 'film' WHEN q - 20 > 20 THEN 'home_video' WHEN sk * 20 < 720 AND rf = 'R' THEN 'film' WHEN d * 10 > 0.6e0 THEN 'sports' ELSE 'unknown' END AS content, CASE WHEN rf = 'R' AND sk * 20 < 400 THEN 'silent_era' WHEN rf = 'R' AND sk * 20 < 640 THEN 'early_sound' WHEN rf = 'R' THEN 'classic' WHEN sk * 20 < 720 THEN 'modern_film' WHEN sk * 20 >= 1280 THEN 'digital' ELSE 'unknown' END AS era",
          lambda: [R.picture_content(C("d") * 10, F.when(C("q") <= 20, 0.0).otherwise(C("q") + 10), C("rf") == "R", C("sk") * 20).alias("content"), R.picture_era(C("rf") == "R", C("sk") * 20).alias("era")])


@query("F60_hdr_hints", LUMA + """, l AS (SELECT sk, CAST(floor(max(mx) * 6000) AS BIGINT) AS cll, CAST(floor(max(av) * 1400) AS BIGINT) AS fall, log2(greatest(max(mx), 0.001e0) / greatest(min(mn), 0.0001e0)) * (sk % 3) AS st FROM fl GROUP BY 1)
SELECT sk, CASE WHEN st > 8 THEN least(cll, 4000) ELSE 1000 END AS max_cll, CASE WHEN st > 8 THEN least(fall, 1000) ELSE 400 END AS max_fall, CASE WHEN st > 8 THEN 'aces' ELSE 'reinhard' END AS tone_mapping, least(greatest(cll, 1000), 4000) AS target_nits FROM l""")
def _(t):
    per = t.rows.groupBy("sk", "ok").agg(F.max(C("q") / 51).alias("mx"), F.avg(C("q") / 51).alias("av"), F.min(C("q") / 51).alias("mn")).groupBy("sk").agg(F.max("mx").alias("mx"), F.max("av").alias("av"), F.min("mn").alias("mn"))
    st = F.log2(F.greatest(C("mx"), L(0.001)) / F.greatest(C("mn"), L(0.0001))) * (C("sk") % 3)
    h = R.hdr_hints(st, F.floor(C("mx") * 6000), F.floor(C("av") * 1400))
    return per.select("sk", h.alias("h")).select("sk", "h.*")


over_rows("F61_disk_estimate", "pk * 3145728 AS extract, pk * 50331648 AS enhanced, CAST(floor(pk / q / 60 * 10 * 1024 * 1024) AS BIGINT) AS audio, ok * 1000 * 3 AS output, CAST(floor((pk * 3145728 + pk * 50331648 + CAST(floor(pk / q / 60 * 10 * 1024 * 1024) AS BIGINT) + ok * 3000) * 0.1e0) AS BIGINT) AS temporary, pk * 3145728 + pk * 50331648 + CAST(floor(pk / q / 60 * 10 * 1024 * 1024) AS BIGINT) + ok * 3000 + CAST(floor((pk * 3145728 + pk * 50331648 + CAST(floor(pk / q / 60 * 10 * 1024 * 1024) AS BIGINT) + ok * 3000) * 0.1e0) AS BIGINT) AS total",
          lambda: [R.disk_estimate(C("ok") * 1000, C("pk"), C("q"))[n].alias(n) for n in ("extract", "enhanced", "audio", "output", "temporary", "total")])
