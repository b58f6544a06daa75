"""Queries for scalar functions (X) and row generators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import estimates as est
from ..functions import settings as st
from ..functions import text as tx
from ..functions import timecode as tc
from ..operators import generate as gen
from ..operators import joins as jn
from ..operators.rollups import psnr_from_mse
from ..sources import edl
from ..session import dealt
from .registry import query
from .rollup_queries import rounded
from .rule_queries import case, names, over_rows

C, L = F.col, F.lit
r6 = lambda c: F.round(c, 6)


def pad2(x):
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


TCS = f"{pad2('pk % 24')} || CASE WHEN ls = 'F' THEN ';' ELSE ':' END || {pad2('ok % 60')} || CASE WHEN ls = 'F' THEN ';' ELSE ':' END || {pad2('sk % 60')} || CASE WHEN ls = 'F' THEN ';' ELSE ':' END || {pad2('ln')}"


def tcs():
    sep = F.when(C("ls") == "F", ";").otherwise(":")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(C("pk") % 24), sep, two(C("ok") % 60), sep, two(C("sk") % 60), sep, two(C("ln")))


MIN = "(pk % 24 * 60 + ok % 60)"
over_rows("X1_timecode_to_frames", f"{TCS} AS tc, ln + (sk % 60 + {MIN} * 60) * 24 AS frames_24, ln + (sk % 60 + {MIN} * 60) * 29 - CASE WHEN ls = 'F' THEN 2 * ({MIN} - {MIN} // 10) ELSE 0 END AS frames_2997",
          lambda: [tcs().alias("tc"), tc.timecode_to_frames(tcs(), 24.0).alias("frames_24"), tc.timecode_to_frames(tcs(), 29.97).alias("frames_2997")])
FR = "(ok * 37 + pk)"
over_rows("X2_frames_to_timecode", f"CASE WHEN {FR} // 24 // 3600 > 99 THEN CAST({FR} // 24 // 3600 AS VARCHAR) ELSE {pad2(f'{FR} // 24 // 3600')} END || ':' || {pad2(f'{FR} // 24 // 60 % 60')} || ':' || {pad2(f'{FR} // 24 % 60')} || ':' || {pad2(f'{FR} % 24')} AS tc, greatest(0, pk - ok) AS difference, CAST(floor(q / 3 * 25) AS BIGINT) AS from_seconds",
          lambda: [tc.frames_to_timecode(C("ok") * 37 + C("pk"), 24.0).alias("tc"), tc.subtract_frames(C("pk"), C("ok")).alias("difference"), tc.seconds_to_frames(C("q") / 3, 25.0).alias("from_seconds")])


@query("X2_drop_frame_timecode", f"""WITH f AS (SELECT ok, ln, pk, ok * 37 + pk AS f FROM rws), c AS (SELECT *, f // 17964 AS ch, f % 17964 AS r FROM f), n AS (SELECT *, ch * 17982 + r + CASE WHEN r > 2 THEN 2 * ((r - 2) // 1796) ELSE 0 END AS n FROM c), s AS (SELECT *, CAST(floor(n / 29.97e0) AS BIGINT) AS s FROM n)
SELECT ok, ln, pk, {pad2('s // 3600')} || ';' || {pad2('s // 60 % 60')} || ';' || {pad2('s % 60')} || ';' || {pad2('CAST(floor(n - s * 29.97e0) AS BIGINT)')} AS tc FROM s""")
def _(t):
    return t.rows.select("ok", "ln", "pk", tc.frames_to_timecode(C("ok") * 37 + C("pk"), 29.97, True).alias("tc"))


@query("X3_clip_list_duration", "SELECT ok, max(pk + CAST(q AS BIGINT)) AS frames, round(max(pk + CAST(q AS BIGINT)) / 24.0e0, 6) AS seconds FROM rws GROUP BY 1")
def _(t):
    return rounded(edl.list_duration(t.rows.select("ok", (C("pk") + C("q").cast("long")).alias("record_out")), ["ok"], 24.0), "seconds")


over_rows("X4_cue_seconds", "round(pk % 24 * 3600 + ok % 60 * 60 + sk % 60 + ln * 100 / 1000.0e0, 6) AS srt, round(ok % 60 * 60 + sk % 60 + CAST(q AS BIGINT) / 100.0e0, 6) AS ass, 0e0 AS bad",
          lambda: [r6(tc.cue_seconds(F.format_string("%02d:%02d:%02d,%03d", C("pk") % 24, C("ok") % 60, C("sk") % 60, C("ln") * 100))).alias("srt"), r6(tc.cue_seconds(F.format_string("0:%02d:%02d.%02d", C("ok") % 60, C("sk") % 60, C("q").cast("long")))).alias("ass"), tc.cue_seconds(L("1:2")).alias("bad")])
SEC = "(pk * 8 + ln / 8.0e0)"
HMS = f"{pad2('pk * 8 // 3600')} || ':' || {pad2('pk * 8 // 60 % 60')} || ':' || {pad2('pk * 8 % 60')}"
over_rows("X5_cue_time_text", f"{HMS} || ',' || lpad(CAST(ln * 125 AS VARCHAR), 3, '0') AS srt, {HMS} || '.' || lpad(CAST(ln * 125 AS VARCHAR), 3, '0') AS vtt, CAST(pk * 8 // 3600 AS VARCHAR) || ':' || {pad2('pk * 8 // 60 % 60')} || ':' || {pad2('pk * 8 % 60')} || '.' || {pad2('ln * 125 // 10')} AS ass",
          lambda: [f(C("pk") * 8 + C("ln") / 8.0).alias(n) for n, f in (("srt", tc.srt_time), ("vtt", tc.vtt_time), ("ass", tc.ass_time))])
over_rows("X6_retiming", """round(CASE WHEN abs(ext / 50000 - 1) < 0.001e0 THEN q ELSE q * (ext / 50000) END, 6) AS duration_start, round((q + ln) / (0.5e0 + d * 10), 6) AS speed_end, round(CASE WHEN q = 1 THEN 0 ELSE q END - CASE WHEN q = 1 THEN 0 ELSE q END * (tx / 60), 6) AS drift_start,
 round(CASE WHEN q = 1 THEN ln ELSE q + ln - q * (tx / 60) * ((q + ln) / q) END, 6) AS drift_end, q + CASE WHEN d < 0.001e0 THEN 0 ELSE d END AS offset_start""", lambda: _retimed())


def _retimed():
    start = F.when(C("q") == 1, 0.0).otherwise(C("q"))
    end = F.when(C("q") == 1, C("ln").cast("double")).otherwise(C("q") + C("ln"))
    ds, de = tc.correct_drift(start, end, C("tx"))
    return [r6(tc.retime_duration(C("q"), C("q") + C("ln"), L(50000.0), C("ext"))[0]).alias("duration_start"), r6(tc.retime_speed(C("q"), C("q") + C("ln"), C("d") * 10 + 0.5)[1]).alias("speed_end"), r6(ds).alias("drift_start"), r6(de).alias("drift_end"), tc.retime(C("q"), C("q") + C("ln"), L(1.0), C("d"))[0].alias("offset_start")]


over_rows("X7_box_scale", "CAST(floor(pk * (1 + d)) AS BIGINT) AS x, CAST(floor(ln * (1 + d)) AS BIGINT) AS h", lambda: [tc.scale_box(F.struct(C("pk").alias("x"), C("ok").alias("y"), C("sk").alias("w"), C("ln").alias("h")), C("d") + 1)[n].alias(n) for n in ("x", "h")])

OCR = r"""trim(regexp_replace(text, '[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{3000}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}]+', ' ', 'g'))"""


@query("X8_clean_ocr", rf"""WITH a AS (SELECT doc_id, {OCR} AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '\s+([.,!?;:])', '\1', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.,!?;:])([A-Za-z])', '\1 \2', 'g'), '([.,!?;:])([A-Za-z])', '\1 \2', 'g') AS t FROM b),
 d AS (SELECT doc_id, replace(replace(t, ',,', '"'), '''''', '"') AS t FROM c) SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(t, ' +', ' ', 'g')), ' '), lambda w: length(w) > 1 OR lower(w) IN ('a', 'i', 'o')), ' ') AS cleaned FROM d""")
def _(t):
    return t.documents.select("doc_id", tx.clean_ocr(C("text")).alias("cleaned"))


@query("X9_clean_ocr_upper", rf"""WITH a AS (SELECT doc_id, replace(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN upper(replace(text, 'ß', 's')) || ' 10|' ELSE text || ' 10|' END, '[\s\x{{00A0}}\x{{0085}}\x{{2000}}-\x{{200A}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{1680}}]+', ' ', 'g')), '|', 'I') AS t FROM documents)
SELECT doc_id, CASE WHEN t = upper(t) AND t <> lower(t) THEN replace(t, '0', 'O') ELSE t END AS cleaned FROM a""")
def _(t):
    return t.documents.select("doc_id", tx.clean_ocr_upper(F.concat(F.when(C("doc_id") % 2 == 0, F.upper(F.replace("text", L("ß"), L("s")))).otherwise(C("text")), L(" 10|"))).alias("cleaned"))


@query("X10_standardize", r"""WITH a AS (SELECT conv_id, turn, '-' || lower(text) AS t FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, lower(text) || '...... end..' FROM conversations WHERE turn % 2 = 1)
SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN regexp_matches(t, '^\pL') THEN upper(t[1]) || t[2:] ELSE t END, '(?m)^-\s*', '- ', 'g'), '\.{2,}', '...', 'g') AS text FROM a""")
def _(t):
    low = F.lower("text")
    return t.conversations.select("conv_id", "turn", tx.standardize(F.when(C("turn") % 2 == 0, F.concat(L("-"), low)).otherwise(F.concat(low, L("...... end..")))).alias("text"))


PHRASES = (
    "please restore this vhs tape", "upscale 4x to 4K", "remove noise from the grainy 1950s film", "colorize the silent movie", "make it better at 60 fps", "fix shaky footage and dust",
    "nothing to say", "clean up the 16mm clip, keep the grain", "interpolate to 48 fps", "what's wrong with the home video", "slow motion 2 times, super8", "stabilize, remove scratches, flickering", "the video",
)
EXTRAS = ("", " authentic look", " modern and polished", " with damage and artifacts", " 1080p full hd", " in 1920s style", " dropout tracking", " preserve the color")


def request():
    pick = lambda arr, i: F.element_at(F.array(*[L(x) for x in arr]), (i + 1).cast("int"))
    text = F.concat(pick(PHRASES, C("p_partkey") % len(PHRASES)), pick(EXTRAS, C("p_size") % len(EXTRAS)), L(" "), C("p_name"))
    return F.when(C("p_partkey") % 4 == 0, F.upper(text)).otherwise(text)


def sqlist(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


REQ = f"req AS (SELECT p_partkey, p_size, lower({sqlist(PHRASES)}[p_partkey % {len(PHRASES)} + 1] || {sqlist(EXTRAS)}[p_size % {len(EXTRAS)} + 1] || ' ' || p_name) AS t FROM part)"


def m(p, flags=", 'i'"):
    return "regexp_matches(t, '" + p.replace("'", "''") + f"'{flags})"


INTENT_ROWS = ", ".join(f"({i}, '{n}', '{p.replace(chr(39), chr(39) * 2)}', {w}e0)" for i, (n, tab) in enumerate(dims.INTENTS.items()) for p, w in tab)
TAGS = f"""{REQ}, hit AS (SELECT p_partkey, n, i, w FROM req JOIN (VALUES {INTENT_ROWS}) r(i, n, p, w) ON regexp_matches(t, '(?i)' || p)), bi AS (SELECT p_partkey, arg_max(n, (w, -i)) AS n, max(w) AS w FROM hit GROUP BY 1),
 tags AS (SELECT req.p_partkey, p_size, CASE WHEN bi.n IS NULL AND {m(dims.VIDEO_WORDS, '')} THEN 'restore' ELSE coalesce(bi.n, 'unknown') END AS intent, CASE WHEN bi.n IS NULL AND {m(dims.VIDEO_WORDS, '')} THEN 0.5e0 ELSE coalesce(w, 0e0) END AS confidence,
  coalesce(CAST(nullif(regexp_extract(t, '\\b(\\d+)\\s*[xX]\\b', 1), '') AS DOUBLE), CAST(nullif(regexp_extract(t, '\\b(\\d+)\\s+times\\b', 1), '') AS DOUBLE), {case([(m(p), f'{v}e0') for p, v in dims.SCALE_WORDS], 'NULL')}) AS scale,
  {case([(m(p), f"'{v}'") for p, v in dims.RESOLUTION_WORDS], 'NULL')} AS resolution, CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*fps\\b', 1, 'i'), '') AS DOUBLE) AS fps,
  CASE WHEN regexp_extract(t, '\\b(19\\d0)s?\\b', 1) <> '' THEN regexp_extract(t, '\\b(19\\d0)s?\\b', 1) || 's' ELSE {case([(m(p), f"'{v}'") for p, v in dims.ERA_WORDS], 'NULL')} END AS era, {case([(m(p), f"'{v}'") for p, v in dims.FORMAT_WORDS], 'NULL')} AS format,
  list_filter([{", ".join(f"CASE WHEN {m(p)} THEN '{v}' END" for p, v in dims.ISSUE_WORDS)}], lambda x: x IS NOT NULL) AS issues, list_filter([{", ".join(f"CASE WHEN {m(p)} THEN '{v}' END" for p, v in dims.PRESERVE_WORDS[:4])}], lambda x: x IS NOT NULL) AS preserve, NOT {m(dims.MODERN_WORDS)} AS keep_authentic FROM req LEFT JOIN bi USING (p_partkey))"""


@query("X11_request_tags", f"WITH {TAGS} SELECT p_partkey, intent, confidence, scale, resolution, fps, era, format, array_to_string(issues, ',') AS issues, array_to_string(preserve, ',') AS preserve, keep_authentic FROM tags")
def _(t):
    df = dealt(t.part.select("p_partkey", request().alias("r")), "p_partkey").select("p_partkey", tx.request_tags(C("r")).alias("t")).select("p_partkey", "t.*")
    return df.withColumn("issues", names(C("issues"))).withColumn("preserve", names(C("preserve")))


PRESETS = ("draft", "fast", "balanced", "quality", "ultimate", "odd")


def preset_case(i, default):
    v = {k: x[i] for k, x in dims.REQUEST_PRESETS.items() if x[i] is not None}
    return "CASE preset " + " ".join(f"WHEN '{k}' THEN {x}e0" for k, x in v.items()) + f" ELSE {default} END"


def has(x):
    return f"list_contains(issues, '{x}')"


@query("F62_request_plan", f"""WITH {TAGS}, p AS (SELECT *, {sqlist(PRESETS)}[p_size % 6 + 1] AS preset FROM tags), s AS (SELECT *, {preset_case(2, '0.5e0')} AS dn, {preset_case(3, 'NULL')} AS sh FROM p)
SELECT p_partkey, preset, coalesce(scale, {preset_case(0, '2e0')}) AS scale, fps AS target_fps, CASE WHEN era IN ('silent', '1920s') THEN 'silent_film' WHEN era = '1930s' THEN 'early_talkies' WHEN era IN ('1940s', '1950s') THEN 'golden_age' WHEN era IN ('1960s', '1970s') THEN 'new_hollywood' WHEN era IN ('1980s', '1990s', 'home_video') THEN 'video_era' END AS source_era,
 CASE WHEN format IN ('vhs', 'betamax', 'hi8', 'super8', '16mm', '35mm', 'nitrate') THEN format END AS source_format, CASE WHEN era IN ('silent', '1920s', '1930s', '1940s', '1950s', '1960s', '1970s') THEN 0.7e0 ELSE 0.5e0 END AS authenticity,
 CASE WHEN keep_authentic OR NOT list_contains(preserve, 'grain') THEN least(dn, 0.4e0) ELSE dn END AS denoise_strength, CASE WHEN keep_authentic THEN 0.6e0 ELSE 1e0 END AS face_strength, CASE WHEN keep_authentic THEN CASE WHEN sh IS NULL THEN 0.3e0 ELSE least(sh, 0.3e0) END ELSE sh END AS sharpen_strength,
 concat_ws(',', 'analysis', CASE WHEN format IN ('vhs', 'betamax', 'hi8') THEN 'vhs_restoration' END, CASE WHEN intent = 'stabilize' OR {has('shake')} OR {has('jitter')} THEN 'stabilization' END, CASE WHEN intent = 'denoise' OR {has('noise')} OR {has('grain')} OR preset IN ('quality', 'ultimate') THEN 'denoise' END,
  CASE WHEN {has('artifacts')} OR {has('scratches')} OR {has('damage')} THEN 'artifact_removal' END, CASE WHEN intent = 'upscale' OR coalesce(scale > 1, false) OR resolution IS NOT NULL THEN 'upscale' END, CASE WHEN preset IN ('balanced', 'quality', 'ultimate') THEN 'face_enhance' END, CASE WHEN intent = 'interpolate' OR fps IS NOT NULL THEN 'interpolation' END,
  CASE WHEN intent = 'colorize' THEN 'colorize' END, CASE WHEN preset IN ('quality', 'ultimate') THEN 'temporal' END, 'color_correction', CASE WHEN preset <> 'odd' THEN 'sharpen' END) AS stages FROM s""")
def _(t):
    preset = F.element_at(F.array(*[L(p) for p in PRESETS]), (C("p_size") % 6 + 1).cast("int"))
    df = dealt(t.part.select("p_partkey", preset.alias("preset"), request().alias("r")), "p_partkey").select("p_partkey", "preset", tx.request_tags(C("r")).alias("t"))
    out = df.select("p_partkey", "preset", tx.request_plan(C("t"), C("preset")).alias("p")).select("p_partkey", "preset", "p.*")
    return out.withColumn("stages", names(C("stages")))


@query("X12_slug", r"""WITH a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || ' (' || p_brand || ')' WHEN 1 THEN '--' WHEN 2 THEN p_name || ' - ' || repeat(p_type || '_', 12) WHEN 3 THEN 'Q!' WHEN 4 THEN '.' || p_brand || '.' ELSE p_type || ' ' || p_name END AS t FROM part),
 b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[\s\-]+', '_', 'g'), '[^a-z0-9_.\-]', '', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS s FROM a), c AS (SELECT p_partkey, CASE WHEN s = '' THEN 'item' WHEN length(s) < 3 THEN 'item_' || s ELSE s END AS s FROM b)
SELECT p_partkey, CASE WHEN length(s) > 80 THEN regexp_replace(left(s, 80), '[_.]+$', '') ELSE s END AS slug FROM c""")
def _(t):
    n, b, ty, k = C("p_name"), C("p_brand"), C("p_type"), C("p_partkey") % 6
    title = F.when(k == 0, F.concat(L("  "), n, L(" ("), b, L(")"))).when(k == 1, "--").when(k == 2, F.concat(n, L(" - "), F.repeat(F.concat(ty, L("_")), 12))).when(k == 3, "Q!").when(k == 4, F.concat(L("."), b, L("."))).otherwise(F.concat(ty, L(" "), n))
    return t.part.select("p_partkey", tx.slug(title).alias("slug"))


SECONDS13 = lambda: C("ok") % 97 * 360 + 7
S13 = "CAST(ok % 97 * 360 + 7 AS BIGINT)"
over_rows("X13_duration_text", f"""CASE WHEN {S13} <= 0 THEN 'Complete' WHEN {S13} >= 3600 THEN ({S13} // 3600) || 'h ' || ({S13} // 60 % 60) || 'm ' || ({S13} % 60) || 's' WHEN {S13} >= 60 THEN ({S13} // 60) || 'm ' || ({S13} % 60) || 's' ELSE {S13} || 's' END AS fine,
 CASE WHEN ln = 7 THEN 'Unknown' WHEN {S13} >= 86400 THEN ({S13} // 86400) || 'd ' || ({S13} // 3600 % 24) || 'h' WHEN {S13} >= 3600 THEN ({S13} // 3600) || 'h ' || ({S13} // 60 % 60) || 'm' WHEN {S13} >= 60 THEN ({S13} // 60) || 'm ' || ({S13} % 60) || 's' ELSE {S13} || 's' END AS coarse,
 CASE WHEN {S13} < 60 THEN format('{{:.1f}} seconds', {S13}::DOUBLE) WHEN {S13} < 3600 THEN format('{{}} min {{}} sec ({{:.0f}}s total)', {S13} // 60, {S13} % 60, {S13}::DOUBLE) ELSE format('{{}}h {{}}m ({{:.1f}} hours)', {S13} // 3600, {S13} // 60 % 60, {S13} / 3600.0e0) END AS long_text""",
          lambda: [tc.eta_text(SECONDS13()).alias("fine"), tc.eta_coarse(F.when(C("ln") != 7, SECONDS13())).alias("coarse"), tc.duration_long(SECONDS13().cast("double")).alias("long_text")])
over_rows("X14_config_hash", """left(sha256('{"alpha":' || pk || ',"beta":' || sk || ',"zeta":' || ln || '}'), 16) AS config_hash""",
          lambda: [st.config_hash(F.create_map(L("zeta"), C("ln").cast("long"), L("alpha"), C("pk"), L("beta"), C("sk"))).alias("config_hash")])
over_rows("X15_merge_settings", "least(q, d) AS low, greatest(q, tx) AS high, CASE WHEN ln > 3 THEN d ELSE q END AS plain, q AS forced_key, CASE WHEN ln > 3 THEN 9e0 END AS added", lambda: _merged())


def _merged():
    base = F.create_map(L("low"), C("q"), L("high"), C("q"), L("plain"), C("q"), L("forced_key"), C("q"))
    both = F.create_map(L("low"), C("d"), L("high"), C("tx"), L("forced_key"), C("tx"), L("hidden"), C("tx"))
    over = F.when(C("ln") > 3, F.map_concat(both, F.create_map(L("plain"), C("d"), L("added"), L(9.0)))).otherwise(both)
    s = st.merge_settings(base, over, forced=["forced_key", "hidden"], min_merge=["low"], max_merge=["high"])
    return [F.try_element_at(s, L(n)).alias(n) for n in ("low", "high", "plain", "forced_key", "added")]


over_rows("X16_modifiers", "round(q * 1.5e0, 6) AS a, least(d, 0.04e0) AS b, tx AS c, least(q * 2, 30) AS e", lambda: _modified())


def _modified():
    s = F.create_map(L("a"), C("q"), L("b"), C("d"), L("e"), C("q"))
    mods = F.create_map(L("a_multiplier"), L(1.5), L("b_cap"), L(0.04), L("c"), C("tx"), L("e_multiplier"), L(2.0), L("e_cap"), L(30.0), L("missing_cap"), L(1.0))
    out = st.apply_modifiers(s, mods)
    return [r6(F.element_at(out, "a")).alias("a"), *[F.element_at(out, n).alias(n) for n in "bce"]]


GPUS = ("RTX_4090", "RTX_4070", "A100", "H100_SXM", "T4", "GTX_1050", "RTX_40")
PROVIDERS = ("runpod", "vastai", "lambda_labs", "paperspace", "none")
PST = ("fast", "quality", "ultimate", "anime", "unlisted")
HEIGHTS = (480, 576, 720, 1080, 2160, 4320)
RATES = ", ".join(f"('{p}', '{g}', {usd}e0, {i})" for p, tab in dims.CLOUD_USD_HOUR.items() for i, (g, usd) in enumerate(tab.items()))
WATTS = ", ".join(f"('{g}', {w})" for g, w in dims.GPU_WATTS.items())


@query("X17_cost_estimate", f"""WITH x AS (SELECT ok, ln, pk, ok * 20 AS n, {sqlist(PST)}[ln % 5 + 1] AS ps, {sqlist(GPUS)}[pk % 7 + 1] AS gpu, {sqlist(PROVIDERS)}[sk % 5 + 1] AS pr, {list(HEIGHTS)}[sk % 6 + 1] AS h FROM rws),
 rt AS (SELECT DISTINCT gpu, pr FROM x), rr AS (SELECT gpu, pr, arg_min(usd, (CASE WHEN g = gpu THEN 0 ELSE 1 END, i)) FILTER (WHERE usd IS NOT NULL) AS usd FROM rt LEFT JOIN (VALUES {RATES}) r(p, g, usd, i) ON r.p = pr AND (g = gpu OR contains(g, gpu) OR contains(gpu, g)) GROUP BY 1, 2),
 w AS (SELECT * FROM (VALUES {WATTS}) w(g, wt)), s AS (SELECT x.*, usd, coalesce(wt, 250) AS wt, wt IS NOT NULL AS known, n * 0.15e0 * CASE ps WHEN 'fast' THEN 1 WHEN 'ultimate' THEN 6 WHEN 'anime' THEN 2 ELSE 2.5e0 END * pow(h * 16.0e0 / 9.1e0 * h / 2073600, 0.7e0) AS sec FROM x JOIN rr USING (gpu, pr) LEFT JOIN w ON w.g = x.gpu)
SELECT ok, ln, pk, round(sec, 3) AS seconds, round(n * CASE WHEN h <= 480 THEN 0.5e0 WHEN h <= 720 THEN 1 WHEN h <= 1080 THEN 2.5e0 WHEN h <= 1440 THEN 4 WHEN h <= 2160 THEN 8 ELSE 32 END * 3 * 1.1e0 / 1024, 5) AS disk_gb, round(wt * 1.3e0 / 0.85e0 / 1000 * (sec / 3600), 6) AS kwh, round(sec / 3600 * 1.1e0 * usd, 6) AS cloud_usd FROM s""")
def _(t):
    return cost(t).select("ok", "ln", "pk", F.round("c.seconds", 3).alias("seconds"), F.round("c.disk_gb", 5).alias("disk_gb"), r6("c.kwh").alias("kwh"), r6("c.cloud_usd").alias("cloud_usd"))


def cost(t):
    pick = lambda arr, i: F.element_at(F.array(*[L(x) for x in arr]), (i + 1).cast("int"))
    h = pick(HEIGHTS, C("sk") % 6)
    c = est.cost_estimate(C("ok") * 20, h * 16.0 / 9.1, h, pick(PST, C("ln") % 5), pick(GPUS, C("pk") % 7), pick(PROVIDERS, C("sk") % 5))
    return t.rows.select("ok", "ln", "pk", c.alias("c"))


@query("X18_cost_confidence", f"""WITH x AS (SELECT ok, ln, pk, ok * 20 AS n, {sqlist(PST)}[ln % 5 + 1] AS ps, {sqlist(GPUS)}[pk % 7 + 1] AS gpu, {list(HEIGHTS)}[sk % 6 + 1] AS h FROM rws), k AS (SELECT *, gpu IN ('RTX_4090', 'RTX_4070', 'H100_SXM', 'T4') AS kn, h <> 576 AS sd FROM x)
SELECT ok, ln, pk, CASE WHEN kn AND sd AND n < 500000 THEN 'high' WHEN kn OR sd THEN 'medium' ELSE 'low' END AS confidence, concat_ws('; ', CASE ps WHEN 'ultimate' THEN 'Ultimate preset uses maximum quality settings' WHEN 'fast' THEN 'Fast preset prioritizes speed over quality' END, CASE WHEN h >= 2160 THEN '4K+ resolution significantly increases processing time' END, CASE WHEN NOT kn THEN 'GPU ''' || gpu || ''' not in database, using estimates' END) AS notes FROM k""")
def _(t):
    return cost(t).select("ok", "ln", "pk", "c.confidence", "c.notes")


@query("X19_dry_run", """WITH x AS (SELECT ok, ln, pk, pk * 30 AS n, pk * 60 AS o, CAST(q * 40 AS BIGINT) AS w, CAST(q * 20 AS BIGINT) AS h, CASE WHEN ln % 2 = 0 THEN 4 ELSE 2 END AS sc, 14 + ln AS crf, rf <> 'R' AS au, ls = 'F' AS itp, CASE WHEN sk % 4 = 0 THEN NULL ELSE sk * 200 END AS vm FROM rws),
 y AS (SELECT *, CASE WHEN vm IS NULL OR vm <= 0 THEN 'cpu' WHEN vm >= 16000 THEN 'high_end_gpu' WHEN vm >= 8000 THEN 'mid_gpu' ELSE 'low_gpu' END AS tier, pk * 1.0e0 AS sec FROM x),
 z AS (SELECT *, n / 100.0e0 + n / (CASE tier WHEN 'cpu' THEN 0.05e0 WHEN 'high_end_gpu' THEN 2.5e0 WHEN 'mid_gpu' THEN 1 ELSE 0.3e0 END / (w * h / 2073600.0e0 * (sc / 4.0e0))) + CASE WHEN itp THEN o / CASE tier WHEN 'cpu' THEN 0.5e0 WHEN 'high_end_gpu' THEN 30 WHEN 'mid_gpu' THEN 15 ELSE 5 END ELSE 0 END + o / 30.0e0 AS tot,
  n * CAST(floor(w * h * 1.5e0) AS BIGINT) + n * CAST(floor(w * sc * h * sc * 1.5e0) AS BIGINT) + CASE WHEN itp THEN o * CAST(floor(w * sc * h * sc * 1.5e0) AS BIGINT) ELSE 0 END + CASE WHEN au THEN CAST(floor(sec / 60 * 10 * 1024 * 1024) AS BIGINT) ELSE 0 END AS tmp,
  CAST(floor(sec * floor(w * sc * (h * sc) / 2073600.0e0 * 8000000 * pow(2.0e0, (18 - crf) / 6.0e0)) / 8) AS BIGINT) AS outb FROM y)
SELECT ok, ln, pk, tier, round(tot / 3, 5) AS seconds_third, tmp AS temp_bytes, outb AS output_bytes, CAST(floor((tmp + outb) * 1.2e0) AS BIGINT) AS total_bytes, CAST(floor(w * sc * h * sc / 1e6 * 450) AS BIGINT) + 500 AS vram_mb,
 CASE WHEN hi >= 120 THEN (lo + 3) // 6 // 10 || '.' || (lo + 3) // 6 % 10 || '-' || (hi + 3) // 6 // 10 || '.' || (hi + 3) // 6 % 10 || ' hours' ELSE lo || '-' || hi || ' minutes' END AS time_range
 FROM (SELECT *, CAST(floor(tot * 0.8e0 / 60) AS BIGINT) AS lo, CAST(floor(tot * 1.5e0 / 60) AS BIGINT) AS hi FROM z)""")
def _(t):
    d = est.dry_run(C("pk") * 30, C("pk") * 60, (C("q") * 40).cast("long"), (C("q") * 20).cast("long"), F.when(C("ln") % 2 == 0, 4).otherwise(2), C("pk").cast("double"), C("ln") + 14, C("rf") != "R", C("ls") == "F", F.when(C("sk") % 4 != 0, C("sk") * 200), L("realesrgan-x4plus"))
    df = t.rows.select("ok", "ln", "pk", d.alias("d"))
    return df.select("ok", "ln", "pk", "d.tier", F.round(C("d.seconds") / 3, 5).alias("seconds_third"), "d.temp_bytes", "d.output_bytes", "d.total_bytes", "d.vram_mb", "d.time_range")


over_rows("X20_psnr_from_mse", "round(CASE WHEN d > 0 THEN 10 * log10(65025 / (d * 100)) ELSE 100 END, 6) AS psnr, CASE WHEN d > 0 THEN NULL ELSE CAST('inf' AS DOUBLE) END AS lossless",
          lambda: [r6(psnr_from_mse(C("d") * 100)).alias("psnr"), F.when(C("d") <= 0, psnr_from_mse(C("d") * 100, float("inf"))).alias("lossless")])
over_rows("X21_hash_similarity", "1 - (bit_count(xor(pk * 977, ok * 31)) + bit_count(xor(sk, ln::BIGINT))) / 128.0e0 AS similarity", lambda: [hash_similarity().alias("similarity")])


def hash_similarity():
    a, b = F.array(C("pk") * 977, C("sk")), F.array(C("ok") * 31, C("ln").cast("long"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), L(0), lambda s, v: s + v)
    return L(1.0) - apart / (F.size(a) * 64)


over_rows("X22_vectors", "round(CASE WHEN sqrt(q * q + d * d) * sqrt(tx * tx + ln * ln) = 0 THEN 0 ELSE (q * tx + d * ln) / (sqrt(q * q + d * d) * sqrt(tx * tx + ln * ln)) END, 6) AS cosine, round(sqrt(pow(q - tx, 2) + pow(d - ln, 2)), 6) AS l2, round(q * (1 - d) + tx * d, 6) AS lerp0", lambda: _vectors())


def _vectors():
    a, b = F.array(C("q"), C("d")), F.array(C("tx"), C("ln").cast("double"))
    return [r6(jn.cosine(a, b)).alias("cosine"), r6(jn.l2_distance(a, b)).alias("l2"), r6(F.get(jn.lerp(a, b, C("d")), 0)).alias("lerp0")]


@query("X23_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(t):
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), (F.get_json_object("props", "$.k").cast("int") > 50).alias("high"), F.get_json_object("props", "$.nothing").alias("missing"))


@query("X24_checksums", "SELECT page_id, md5(html) AS md5, sha256(html) AS sha256 FROM pages")
def _(t):
    body = F.encode("html", "UTF-8")
    return t.pages.select("page_id", F.md5(body).alias("md5"), F.sha2(body, 256).alias("sha256"))


over_rows("X25_resolution_and_aspect", "CASE ln WHEN 1 THEN 7680 WHEN 2 THEN 3840 WHEN 3 THEN 2560 WHEN 4 THEN 1920 WHEN 5 THEN 1280 WHEN 6 THEN 854 END AS width, " + case([(f"abs((1 + q / 19) - {r}e0) < {tol}e0", f"'{lab}'") for r, tol, lab in ((1.33, 0.05, "4:3"), (1.37, 0.05, "Academy"), (1.66, 0.05, "5:3"), (1.78, 0.05, "16:9"), (1.85, 0.05, "1.85:1"), (2.35, 0.1, "Cinemascope"), (2.76, 0.1, "Ultra Panavision"))], "format('{:.2f}:1', 1 + q / 19)") + " AS aspect",
          lambda: [est.resolution_size(F.element_at(F.array(*[L(x) for x in (*dims.RESOLUTION_NAMES, "none")]), C("ln")))["width"].alias("width"), est.aspect_label(C("q") / 19 + 1, L(1.0)).alias("aspect")])


@query("X26_changelog", """SELECT o_orderkey, 'CHANGELOG: ' || o_orderkey || chr(10) || 'VERSION HISTORY:' || chr(10) || '  v2 (' || o_orderpriority || ')' || chr(10) || '    No description' || chr(10) || '  v1 (1999)' || chr(10) || '    first ' || o_custkey || chr(10) || 'PROCESSING STAGES:' || chr(10) || '  [' || CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'PENDING' END || '] enhance' AS changelog FROM orders""")
def _(t):
    version = lambda n, at, text: F.struct(L(n).alias("version"), at.alias("created_at"), text.alias("description"))
    versions = F.array(version(1, L("1999"), F.concat(L("first "), C("o_custkey").cast("string"))), version(2, C("o_orderpriority"), L("")))
    stages = F.array(F.struct(L("enhance").alias("name"), F.when(C("o_orderstatus") == "F", "completed").otherwise("pending").alias("status")))
    return t.orders.select("o_orderkey", tx.changelog(C("o_orderkey").cast("string"), versions, stages).alias("changelog"))


# --- G -----------------------------------------------------------------------------------------
@query("G1_split_range", """WITH x AS (SELECT o_orderkey AS job, o_custkey AS s, o_custkey + o_orderkey % 400 AS e, 1 + o_orderkey % 3 AS st, 1 + o_orderkey % 8 AS n FROM orders), y AS (SELECT *, (e - s) // st + 1 AS tot, least(n, (e - s) // st + 1) AS k FROM x),
 z AS (SELECT *, unnest(range(k)) AS i FROM y) SELECT job, CAST(i AS INTEGER) AS chunk_no, s + (i * (tot // k) + least(i, tot % k)) * st AS chunk_start, least(e, s + (i * (tot // k) + least(i, tot % k) + tot // k + CASE WHEN i < tot % k THEN 1 ELSE 0 END - 1) * st) AS chunk_end FROM z""")
def _(t):
    df = t.orders.select(C("o_orderkey").alias("job"), C("o_custkey").alias("s"), (C("o_custkey") + C("o_orderkey") % 400).alias("e"), (C("o_orderkey") % 3 + 1).alias("st"), (C("o_orderkey") % 8 + 1).alias("n"))
    return gen.split_range(df, "s", "e", "st", "n").select("job", "chunk_no", "chunk_start", "chunk_end")


@query("G2_overlapping_chunks", """WITH x AS (SELECT o_orderkey AS job, o_custkey AS n FROM orders), y AS (SELECT *, unnest(range((n + 89) // 90)) AS i FROM x WHERE n > 0) SELECT job, CAST(i AS INTEGER) AS chunk_no, i * 90 AS chunk_start, least(i * 90 + 100, n) AS chunk_end FROM y""")
def _(t):
    df = t.orders.select(C("o_orderkey").alias("job"), C("o_custkey").alias("n"))
    return gen.overlapping_chunks(df, "n", 100, 10).select("job", "chunk_no", "chunk_start", "chunk_end")


@query("G3_duration_chunks", """WITH x AS (SELECT o_orderkey AS job, o_custkey * 10 AS n, least(greatest(CAST(floor((o_custkey % 40) * 30.0e0) AS BIGINT), 100), 10000) AS sz FROM orders), y AS (SELECT *, unnest(range(0, n, sz)) AS s FROM x WHERE n > 0) SELECT job, s AS chunk_start, least(s + sz, n) AS chunk_end FROM y""")
def _(t):
    df = t.orders.select(C("o_orderkey").alias("job"), (C("o_custkey") * 10).alias("n"), (C("o_custkey") % 40).alias("fps"))
    return gen.duration_chunks(df, "n", C("fps"), 30.0).select("job", "chunk_start", "chunk_end")


@query("G4_processing_steps", """WITH x AS (SELECT o_orderkey AS job, list_filter(['extract_frames', 'upscale', CASE WHEN o_orderstatus <> 'F' AND o_custkey % 5 > 0 THEN 'face_restoration' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'interpolate' END, 'encode'], lambda s: s IS NOT NULL) AS st FROM orders) SELECT job, unnest(st) AS step, CAST(generate_subscripts(st, 1) AS INTEGER) AS step_no FROM x""")
def _(t):
    df = t.orders.select(C("o_orderkey").alias("job"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return gen.processing_steps(df, C("o_custkey") % 5, C("o_orderstatus") != "F", C("o_orderpriority") == "1-URGENT").select("job", "step", "step_no")


STAGE_SQL = " UNION ALL ".join(f"SELECT '{p}' AS preset, {i} AS stage_no, '{s}' AS stage, '{'pending' if s in act else 'skipped'}' AS status" for p, act in (*dims.PRESET_STAGES.items(), ("odd", dims.PRESET_STAGES["balanced"])) for i, s in enumerate(dims.ALL_STAGES))


@query("G5_stage_list", f"WITH d AS ({STAGE_SQL}), x AS (SELECT o_orderkey AS job, ['fast', 'balanced', 'quality', 'ultimate', 'odd'][o_custkey % 5 + 1] AS preset FROM orders) SELECT job, preset, stage_no, stage, status FROM x JOIN d USING (preset)")
def _(t):
    preset = F.element_at(F.array(*[L(x) for x in ("fast", "balanced", "quality", "ultimate", "odd")]), (C("o_custkey") % 5 + 1).cast("int"))
    return gen.stage_list(t.orders.select(C("o_orderkey").alias("job"), preset.alias("preset")), "preset")
