"""Queries for the window family (W) on the event timeline and the job frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..operators import timeline as tl
from ..operators.sequence import Seq, adjacent, number_rows
from .bindings import TIMELINE, EVENT_ORDER
from .registry import query

R6 = lambda c: F.round(c, 6)
JOBSEQ = Seq(("job_id",), ("frame_no",))


def diffs(t):
    base = t.frames.withColumn("luma", F.col("k") / F.lit(250.0))
    return tl.frame_differences(base, TIMELINE, "luma", "value", 1000.0)


def scenes(t, aggs=None, transitions=False):
    df = diffs(t)
    kind = None
    if transitions:
        df = tl.transition_types(df, TIMELINE, tl.is_cut())
        kind = F.col("transition")
    return tl.scene_segments(df, TIMELINE, tl.is_cut(), kind, aggs)


def totals(t):
    return t.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames"))


DIFFS = """
WITH luma AS (SELECT *, k / 250.0e0 AS luma FROM frames),
diffs AS (SELECT *, abs(luma - lag(luma) OVER w) AS hist_diff,
    1.0e0 - abs(value - lag(value) OVER w) / 1000.0e0 AS ssim
  FROM luma WINDOW w AS (PARTITION BY video_id ORDER BY frame_no)),
cuts AS (SELECT *, coalesce(hist_diff > 0.3e0 OR ssim < 0.7e0, false) AS cut FROM diffs)"""

SCENES = DIFFS + """,
win AS (SELECT *, list(hist_diff) OVER w AS ds, avg(hist_diff) OVER w AS av, max(hist_diff) OVER w AS mx FROM cuts
  WINDOW w AS (PARTITION BY video_id ORDER BY frame_no ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)),
kinds AS (SELECT *, CASE WHEN NOT cut THEN NULL WHEN frame_no < 10 THEN 'hard_cut'
    WHEN hist_diff > 0.6e0 AND hist_diff / greatest(av, 0.01e0) > 3.0e0 THEN 'hard_cut'
    WHEN av > 0.1e0 AND mx < 0.4e0 AND (ds = list_sort(ds) OR ds = list_reverse_sort(ds)) THEN 'fade'
    WHEN av > 0.2e0 AND av < 0.5e0 AND ssim > 0.4e0 THEN 'dissolve'
    WHEN av > 0.15e0 AND mx > 0.3e0 THEN 'unknown' ELSE 'hard_cut' END AS kind FROM win),
seg AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_no) AS sid FROM kinds),
sc AS (SELECT video_id, sid, min(frame_no) AS start_frame, max(frame_no) AS end_frame, min(kind) AS kind,
    avg(value) AS avg_value, avg(luma) AS avg_luma, sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS faces FROM seg GROUP BY video_id, sid),
scenes AS (SELECT video_id, start_frame, end_frame, end_frame - start_frame + 1 AS duration_frames,
    CASE WHEN sid = 0 THEN 'hard_cut' ELSE kind END AS transition_in,
    coalesce(lead(kind) OVER (PARTITION BY video_id ORDER BY sid), 'hard_cut') AS transition_out,
    avg_value, avg_luma, faces FROM sc)"""


@query("W1_exact_dedup", """
WITH m AS (SELECT video_id, frame_no, event_type, lag(event_type) OVER (PARTITION BY video_id ORDER BY frame_no) AS p FROM frames)
SELECT video_id, frame_no, u AS unique_frame, u <> frame_no AS is_duplicate FROM (
 SELECT video_id, frame_no, max(CASE WHEN p IS NULL OR p <> event_type THEN frame_no END) OVER (PARTITION BY video_id ORDER BY frame_no) AS u FROM m)""")
def _(t):
    return folds.exact_dedup(t.frames, TIMELINE, "event_type").select("video_id", "frame_no", "unique_frame", "is_duplicate")


@query("W1_anchored_dedup", """
WITH RECURSIVE walk AS (
 SELECT video_id, frame_no, frame_no AS unique_frame, k AS anchor FROM frames WHERE frame_no = 0
 UNION ALL
 SELECT f.video_id, f.frame_no,
  CASE WHEN 1.0e0 - bit_count(xor(f.k, w.anchor)) / 64.0e0 >= 0.96e0 THEN w.unique_frame ELSE f.frame_no END,
  CASE WHEN 1.0e0 - bit_count(xor(f.k, w.anchor)) / 64.0e0 >= 0.96e0 THEN w.anchor ELSE f.k END
 FROM walk w JOIN frames f ON f.video_id = w.video_id AND f.frame_no = w.frame_no + 1)
SELECT video_id, frame_no, unique_frame, unique_frame <> frame_no AS is_duplicate FROM walk""")
def _(t):
    return folds.anchored_dedup(t.frames.withColumn("hash", F.array("k")), TIMELINE, "hash", 0.96)


@query("W2_scene_boundaries", DIFFS + " SELECT video_id, frame_no, round(hist_diff, 6) AS hist_diff, round(ssim, 6) AS ssim FROM cuts WHERE cut")
def _(t):
    return diffs(t).where(tl.is_cut()).select("video_id", "frame_no", R6("hist_diff").alias("hist_diff"), R6("ssim").alias("ssim"))


@query("W3_intelligence_boundaries", """
WITH m AS (SELECT video_id, frame_no, k / 100.0e0 AS b, event_type AS c,
   CASE WHEN value < 2 THEN 'static' WHEN value < 8 THEN 'minimal' WHEN value < 20 THEN 'moderate' WHEN value < 40 THEN 'high' ELSE 'extreme' END AS mo FROM frames),
s AS (SELECT *, lag(b) OVER w AS pb, lag(c) OVER w AS pc, lag(mo) OVER w AS pm, count(*) OVER (PARTITION BY video_id) AS n FROM m WINDOW w AS (PARTITION BY video_id ORDER BY frame_no)),
f AS (SELECT video_id, frame_no, n, CASE WHEN frame_no = 0 THEN false ELSE abs(b - pb) > 0.3e0 OR c <> pc OR (pm = 'static' AND mo IN ('high', 'extreme')) END AS ch FROM s)
SELECT video_id, frame_no, ch OR (frame_no = 0 AND n > 1) AS scene_start,
 coalesce(lead(ch) OVER (PARTITION BY video_id ORDER BY frame_no), false) AS scene_end FROM f""")
def _(t):
    from ..functions.rules import motion_level

    df = t.frames.select(
        "video_id", "frame_no", (F.col("k") / 100.0).alias("b"), "event_type", motion_level(F.col("value")).alias("mo")
    )
    out = tl.intelligence_boundaries(df, TIMELINE, "b", "event_type", "mo")
    return out.select("video_id", "frame_no", "scene_start", "scene_end")


@query("W4_segments", SCENES + " SELECT video_id, start_frame, end_frame, duration_frames, transition_in, transition_out FROM scenes")
def _(t):
    return scenes(t, transitions=True)


@query("W5_merge_short_scenes", SCENES.replace("\nWITH ", "\nWITH RECURSIVE ", 1) + """,
 num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS i FROM scenes),
 walk AS (SELECT video_id, i, start_frame AS head, end_frame FROM num WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, CASE WHEN w.end_frame - w.head + 1 < 5 THEN w.head ELSE n.start_frame END, n.end_frame
  FROM walk w JOIN num n ON n.video_id = w.video_id AND n.i = w.i + 1),
 g AS (SELECT w.video_id, w.head, max(w.end_frame) AS e, min(n.transition_in) FILTER (WHERE n.start_frame = w.head) AS ti,
   arg_max(n.transition_out, n.start_frame) AS tou FROM walk w JOIN num n ON n.video_id = w.video_id AND n.i = w.i GROUP BY w.video_id, w.head),
 o AS (SELECT *, CASE WHEN e - head + 1 < 5 AND lag(head) OVER w IS NOT NULL THEN lag(head) OVER w ELSE head END AS owner FROM g WINDOW w AS (PARTITION BY video_id ORDER BY head))
SELECT video_id, owner AS start_frame, max(e) AS end_frame, max(e) - owner + 1 AS duration_frames,
 arg_min(ti, head) AS transition_in, arg_max(tou, head) AS transition_out FROM o GROUP BY video_id, owner""")
def _(t):
    return folds.merge_short_scenes(scenes(t, transitions=True), ("video_id",), 5)


@query("W6_transition_types", SCENES + " SELECT video_id, frame_no, kind AS transition FROM kinds WHERE cut")
def _(t):
    out = tl.transition_types(diffs(t), TIMELINE, tl.is_cut())
    return out.where(tl.is_cut()).select("video_id", "frame_no", "transition")


def credit_batches(t):
    marked = t.frames.select(
        "video_id",
        "frame_no",
        (F.col("value") / 1000.0).alias("text_density"),
        (F.col("k") < 20).alias("is_black"),
        (F.col("k") / 100.0).alias("contrast_score"),
        (F.col("k") % 10 < 8).alias("is_static"),
        (F.col("event_id") % 5 < 3).alias("is_scrolling"),
    )
    return tl.credits_batches(marked, TIMELINE, totals(t), fps=2.0, interval=1.25)


CREDITS = """
WITH tot AS (SELECT video_id, count(*) AS total_frames FROM frames GROUP BY video_id),
smp AS (SELECT video_id, frame_no // 2 AS s, value / 1000.0e0 AS td, k < 20 AS bl, k / 100.0e0 AS cs, k % 10 < 8 AS st, event_id % 5 < 3 AS sc FROM frames WHERE frame_no % 2 = 0),
bt AS (SELECT video_id, s // 4 AS batch, count(*) AS n, avg(td) AS td, avg(cs) AS cs, avg(CASE WHEN bl THEN 1.0e0 ELSE 0.0e0 END) AS br,
  sum(CASE WHEN st AND s % 4 <> 0 THEN 1.0e0 ELSE 0.0e0 END) / greatest(count(*) - 1, 1) AS sr,
  sum(CASE WHEN sc AND s % 4 <> 0 THEN 1.0e0 ELSE 0.0e0 END) / greatest(count(*) - 1, 1) AS cr FROM smp GROUP BY 1, 2),
bb AS (SELECT bt.*, total_frames, n = 4 AS is_full, CASE WHEN batch = 0 THEN 0 ELSE (batch * 4 - 1) * 2 END AS start_frame,
  CASE WHEN n = 4 THEN (batch * 4 + 3) * 2 ELSE total_frames END AS end_frame, n * 1.25e0 AS dur,
  (CASE WHEN batch = 0 THEN 0 ELSE (batch * 4 - 1) * 2 END) / CAST(total_frames AS DOUBLE) AS pos FROM bt JOIN tot USING (video_id)),
cl AS (SELECT *, CASE WHEN br > 0.8e0 THEN 'black'
  WHEN cr > 0.5e0 AND td > 0.02e0 AND pos > 0.7e0 THEN 'credits_closing' WHEN cr > 0.5e0 AND td > 0.02e0 AND pos < 0.3e0 THEN 'credits_opening'
  WHEN cs > 0.5e0 AND sr > 0.7e0 AND dur < 10 THEN 'title_card' WHEN cs > 0.5e0 AND sr > 0.7e0 AND pos < 0.2e0 THEN 'intro'
  WHEN cs > 0.5e0 AND sr > 0.7e0 AND pos > 0.8e0 THEN 'credits_closing'
  WHEN sr > 0.9e0 AND dur < 5 AND cs > 0.3e0 THEN 'static_logo'
  WHEN td > 0.04e0 AND pos > 0.8e0 AND dur > 15 THEN 'credits_closing' WHEN td > 0.04e0 AND pos < 0.2e0 THEN 'intro' ELSE 'content' END AS segment_type FROM bb),
cf AS (SELECT *, CASE WHEN br > 0.8e0 THEN 0.9e0
  WHEN cr > 0.5e0 AND td > 0.02e0 AND pos > 0.7e0 THEN 0.7e0 + cr * 0.2e0 WHEN cr > 0.5e0 AND td > 0.02e0 AND pos < 0.3e0 THEN least(0.7e0 + cr * 0.2e0, 0.7e0)
  WHEN cs > 0.5e0 AND sr > 0.7e0 AND (dur < 10 OR pos < 0.2e0 OR pos > 0.8e0) THEN 0.5e0 + cs * 0.3e0
  WHEN sr > 0.9e0 AND dur < 5 AND cs > 0.3e0 THEN 0.6e0
  WHEN td > 0.04e0 AND pos > 0.8e0 AND dur > 15 THEN 0.4e0 + least(td * 10, 0.3e0)
  WHEN td > 0.04e0 AND pos < 0.2e0 THEN greatest(0.4e0 + least(td * 10, 0.3e0) - 0.2e0, 0.3e0) ELSE 0.0e0 END AS confidence FROM cl),
kp AS (SELECT *, lag(segment_type) OVER w AS pt, lag(end_frame) OVER w AS pe FROM cf WHERE segment_type <> 'content' AND confidence > 0.4e0 WINDOW w AS (PARTITION BY video_id ORDER BY start_frame)),
isl AS (SELECT *, sum(CASE WHEN is_full AND pt = segment_type AND pe = start_frame THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start_frame) AS g FROM kp),
segs AS (SELECT video_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, min(segment_type) AS segment_type, max(confidence) AS confidence, max(total_frames) AS total_frames FROM isl GROUP BY video_id, g)"""


@query("W7_credits_segments", CREDITS + " SELECT video_id, start_frame, end_frame, segment_type, round(confidence, 6) AS confidence FROM segs")
def _(t):
    out = tl.credits_segments(credit_batches(t), TIMELINE)
    return out.select("video_id", "start_frame", "end_frame", "segment_type", R6("confidence").alias("confidence"))


@query("W8_main_content", CREDITS + """ SELECT video_id,
 coalesce(max(CASE WHEN segment_type IN ('intro', 'credits_opening') AND start_frame < total_frames * 0.3e0 THEN end_frame END), 0) AS main_start,
 coalesce(min(CASE WHEN segment_type = 'credits_closing' AND start_frame > total_frames * 0.7e0 THEN start_frame END), max(total_frames)) AS main_end
 FROM segs GROUP BY video_id""")
def _(t):
    return tl.main_content_bounds(tl.credits_segments(credit_batches(t), TIMELINE), ("video_id",))


@query("W9_merge_intervals", """
WITH iv AS (SELECT l_suppkey AS video_id, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem),
r AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rn) AS grp FROM r)
SELECT video_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY video_id, grp""")
def _(t):
    iv = t.lineitem.select(
        F.col("l_suppkey").alias("video_id"),
        F.col("l_partkey").alias("s"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"),
        *[c for c in t.lineitem.columns if c not in ("l_suppkey", "l_partkey")],
    )
    order = ("s", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
             "l_returnflag", "l_linestatus")
    return tl.merge_intervals(iv, Seq(("video_id",), order), "s", "e")


@query("W9_merge_boxes", """
WITH RECURSIVE b AS (SELECT video_id, frame_no, CAST(k AS DOUBLE) AS x, CAST(frame_no * 4 AS DOUBLE) AS y, value + 20 AS w, 12.0e0 AS h FROM frames),
walk AS (SELECT video_id, frame_no, x, y, w, h, 0 AS g FROM b WHERE frame_no = 0
 UNION ALL
 SELECT video_id, frame_no, CASE WHEN hit THEN least(px, x) ELSE x END, CASE WHEN hit THEN least(py, y) ELSE y END,
  CASE WHEN hit THEN greatest(px + pw, x + w) - least(px, x) ELSE w END, CASE WHEN hit THEN greatest(py + ph, y + h) - least(py, y) ELSE h END,
  CASE WHEN hit THEN g ELSE g + 1 END FROM (
   SELECT b.video_id, b.frame_no, b.x, b.y, b.w, b.h, k.x AS px, k.y AS py, k.w AS pw, k.h AS ph, k.g,
    greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) / least(k.w * k.h, b.w * b.h) > 0.3e0 AS hit
   FROM walk k JOIN b ON b.video_id = k.video_id AND b.frame_no = k.frame_no + 1))
SELECT video_id, g AS box_no, round(arg_max(x, frame_no), 6) AS x, round(arg_max(y, frame_no), 6) AS y, round(arg_max(w, frame_no), 6) AS w, round(arg_max(h, frame_no), 6) AS h, count(*) AS n_boxes
FROM walk GROUP BY video_id, g""")
def _(t):
    boxes = t.frames.select(
        "video_id", "frame_no", F.col("k").cast("double").alias("x"), (F.col("frame_no") * 4).cast("double").alias("y"),
        (F.col("value") + 20).alias("w"), F.lit(12.0).alias("h"),
    )
    out = folds.merge_boxes(boxes, TIMELINE)
    return out.select("video_id", "box_no", *[R6(c).alias(c) for c in "xywh"], "n_boxes")


@query("W10_text_cues", """
WITH tot AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
ok AS (SELECT video_id, frame_no, event_type AS txt, lag(event_type) OVER (PARTITION BY video_id ORDER BY frame_no) AS p FROM frames WHERE k / 100.0e0 >= 0.3e0),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> txt THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_no) AS cue_index FROM ok),
r AS (SELECT video_id, cue_index, min(txt) AS text, count(*) AS n_frames, min(frame_no) AS s FROM g GROUP BY 1, 2)
SELECT video_id, CAST(cue_index AS BIGINT) AS cue_index, text, n_frames, round(s / 24.0e0, 6) AS start_s,
 round(coalesce(lead(s) OVER (PARTITION BY video_id ORDER BY cue_index), n) / 24.0e0, 6) AS end_s FROM r JOIN tot USING (video_id)""")
def _(t):
    df = t.frames.withColumn("conf", F.col("k") / 100.0)
    out = tl.text_cues(df, TIMELINE, "event_type", "conf", totals(t), 24.0, 0.3)
    return out.withColumn("start_s", R6("start_s")).withColumn("end_s", R6("end_s"))


def motion(t):
    return t.frames.select(
        "video_id", "frame_no", (F.col("value") / 9.7 - 3).alias("dx"), ((F.col("k") - 50) / 9.7).alias("dy"),
        ((F.col("k") - 50) / 1999).alias("rotation"), (F.lit(1.0) + (F.col("k") - 50) / 9973).alias("scale"),
    )


MOTION = """WITH mo AS (SELECT video_id, frame_no, value / 9.7e0 - 3 AS dx, (k - 50) / 9.7e0 AS dy, (k - 50) / 1999.0e0 AS rotation,
 1.0e0 + (k - 50) / 9973.0e0 AS scale FROM frames)"""


@query("W11_shaky_segments", MOTION + """,
m AS (SELECT *, sqrt(dx * dx + dy * dy) + degrees(abs(rotation)) * 5 > 0.2e0 * 50 AS sh FROM mo),
p AS (SELECT *, lag(sh) OVER (PARTITION BY video_id ORDER BY frame_no) AS was FROM m),
g AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> sh THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_no) AS grp FROM p),
r AS (SELECT video_id, grp, min(frame_no) AS s, max(frame_no) AS l, bool_or(sh) AS sh FROM g GROUP BY 1, 2),
e AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY video_id ORDER BY grp), l) AS e FROM r)
SELECT video_id, s AS start_frame, e AS end_frame FROM e WHERE sh AND e - s >= 3""")
def _(t):
    return tl.shaky_segments(motion(t), TIMELINE, "dx", "dy", "rotation", 0.2, 3)


PATHS = MOTION + """,
n AS (SELECT video_id, count(*) AS n FROM mo GROUP BY 1),
cum AS (SELECT video_id, frame_no, sum(dx) OVER w AS px, sum(dy) OVER w AS py, sum(rotation) OVER w AS pr, exp(sum(ln(scale)) OVER w) AS ps FROM mo
 WINDOW w AS (PARTITION BY video_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING))"""


@query("W12_trajectory", PATHS + """,
off AS (SELECT CAST(range AS BIGINT) AS o FROM range(-12, 12)),
sm AS (SELECT c.video_id, c.frame_no, avg(x.px) AS sx, avg(x.py) AS sy, avg(x.pr) AS sr, avg(x.ps) AS ss FROM cum c JOIN n USING (video_id) CROSS JOIN off
 JOIN cum x ON x.video_id = c.video_id AND x.frame_no = least(greatest(c.frame_no + off.o, 0), n.n - 1) GROUP BY 1, 2)
SELECT video_id, frame_no, round(px, 6) AS path_dx, round(ps, 6) AS path_scale,
 round(greatest(least(sx - px, 100), -100), 6) AS corr_dx, round(greatest(least(sy - py, 100), -100), 6) AS corr_dy,
 round(greatest(least(sr - pr, radians(15)), -radians(15)), 6) AS corr_rot, round(ss / ps, 6) AS corr_scale FROM cum JOIN sm USING (video_id, frame_no)""")
def _(t):
    out = tl.trajectory(motion(t), TIMELINE, preserve_scale=False)
    return out.select("video_id", "frame_no", *[R6(c).alias(c) for c in ("path_dx", "path_scale", "corr_dx", "corr_dy", "corr_rot", "corr_scale")])


@query("W12_trajectory_gauss", PATHS + """,
off AS (SELECT CAST(range AS BIGINT) AS o, exp(-0.5e0 * pow(range / (13 / 6.0e0), 2)) AS wt FROM range(-9, 10)),
sm AS (SELECT c.video_id, c.frame_no, sum(x.px * wt) / sum(wt) AS sx FROM cum c JOIN n USING (video_id) CROSS JOIN off
 JOIN cum x ON x.video_id = c.video_id AND x.frame_no = least(greatest(c.frame_no + off.o, 0), n.n - 1) GROUP BY 1, 2)
SELECT video_id, frame_no, round(greatest(least(sx - px, 100), -100), 6) AS corr_dx FROM cum JOIN sm USING (video_id, frame_no)""")
def _(t):
    out = tl.trajectory(motion(t), TIMELINE, strength=0.2, mode="gauss")
    return out.select("video_id", "frame_no", R6("corr_dx").alias("corr_dx"))


@query("W13_moving_average", """
WITH n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1), off AS (SELECT CAST(range AS BIGINT) AS o FROM range(-3, 3))
SELECT c.video_id, c.frame_no, round(avg(x.value), 6) AS smoothed FROM frames c JOIN n USING (video_id) CROSS JOIN off
 JOIN frames x ON x.video_id = c.video_id AND x.frame_no = least(greatest(c.frame_no + off.o, 0), n.n - 1) GROUP BY 1, 2""")
def _(t):
    out = tl.moving_average(t.frames.select("video_id", "frame_no", "value"), TIMELINE, {"smoothed": "value"}, 6)
    return out.select("video_id", "frame_no", R6("smoothed").alias("smoothed"))


@query("W14_priority_order", """
SELECT state, job_id, row_number() OVER (PARTITION BY state ORDER BY priority, created_at, job_id) AS queue_position FROM jobs""")
def _(t):
    from ..operators.jobs import queue_positions

    return queue_positions(t.jobs, ("state",), "priority", "created_at", "job_id").select("state", "job_id", "queue_position")


@query("W15_rolling_progress", """
WITH x AS (SELECT job_id, frame_no, time_ms, CASE WHEN tx > 0.01e0 THEN 30 + d * 100 END AS psnr, count(*) OVER (PARTITION BY job_id) AS n FROM job_frames),
r AS (SELECT *, avg(time_ms) OVER w AS av, avg(psnr) OVER w AS ap FROM x WINDOW w AS (PARTITION BY job_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT job_id, frame_no, round(av, 6) AS avg_time_ms, round(ap, 6) AS avg_psnr,
 round(CASE WHEN n - frame_no - 1 > 0 THEN (n - frame_no - 1) * av / 1000 ELSE 0 END, 6) AS eta_seconds, round((frame_no + 1) / CAST(n AS DOUBLE) * 100, 6) AS percent FROM r""")
def _(t):
    df = t.job_frames.select("job_id", "frame_no", "time_ms", F.when(F.col("tx") > 0.01, 30 + F.col("d") * 100).alias("psnr"))
    total = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("total_frames"))
    out = tl.rolling_progress(df, JOBSEQ, "time_ms", total, 3, ("psnr",))
    return out.select("job_id", "frame_no", *[R6(c).alias(c) for c in ("avg_time_ms", "avg_psnr", "eta_seconds", "percent")])


@query("W16_ema", """
WITH RECURSIVE walk AS (SELECT video_id, frame_no, value AS ema FROM frames WHERE frame_no = 0
 UNION ALL SELECT f.video_id, f.frame_no, CASE WHEN w.ema = 0 THEN f.value ELSE 0.1e0 * f.value + 0.9e0 * w.ema END
 FROM walk w JOIN frames f ON f.video_id = w.video_id AND f.frame_no = w.frame_no + 1)
SELECT video_id, frame_no, round(ema, 6) AS ema FROM walk""")
def _(t):
    return folds.moving_ema(t.frames, TIMELINE, "value").select("video_id", "frame_no", R6("ema").alias("ema"))


@query("W17_film_cadence", """
WITH h AS (SELECT video_id, frame_no, value, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame_no)) AS d FROM frames WHERE frame_no < 31),
nn AS (SELECT video_id, count(*) AS n_head, avg(d) AS m FROM h GROUP BY 1),
fl AS (SELECT h.video_id, h.frame_no - 1 AS i, h.d < nn.m * 0.3e0 AS dup FROM h JOIN nn USING (video_id) WHERE h.d IS NOT NULL),
ra AS (SELECT nn.video_id, n_head, coalesce(avg(CASE WHEN dup THEN 1.0e0 WHEN NOT dup THEN 0.0e0 END), 0) AS r FROM nn LEFT JOIN fl USING (video_id) GROUP BY 1, 2),
ph AS (SELECT fl.video_id, o.range AS o, sum(CASE WHEN dup THEN 1 ELSE 0 END) > count(*) * 0.7e0 AS hit FROM fl JOIN range(5) o ON i % 5 = o.range OR i % 5 = (o.range + 2) % 5 GROUP BY 1, 2),
pb AS (SELECT video_id, bool_or(hit) AS hit FROM ph GROUP BY 1)
SELECT video_id, CAST(n_head AS INTEGER) AS n_head, round(r, 6) AS duplicate_ratio, CASE WHEN n_head < 10 THEN NULL WHEN r > 0.35e0 AND r < 0.45e0 AND hit THEN '3:2' WHEN r > 0.45e0 AND r < 0.55e0 THEN '2:2' END AS pattern
FROM ra LEFT JOIN pb USING (video_id)""")
def _(t):
    return tl.film_cadence(t.frames, TIMELINE, "value", 60.0).withColumn("duplicate_ratio", R6("duplicate_ratio"))


@query("W18_winners", """
WITH v AS (SELECT l_linenumber AS test_id, l_returnflag AS variant, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos,
  round(avg(l_quantity), 6) AS p, round(avg(1 - l_discount), 6) AS s, round(avg(100 - l_tax * 500), 6) AS v, sum(CASE WHEN l_quantity = 50 AND l_linestatus = 'O' AND l_discount = 0.03e0 THEN 1 ELSE 0 END) AS votes FROM lineitem GROUP BY 1, 2),
sc AS (SELECT *, p / 50 * 0.2e0 + s * 0.3e0 + v / 100 * 0.3e0 + votes / 10.0e0 * 0.2e0 AS score FROM v)
SELECT test_id, arg_max(variant, (p, -pos)) AS winner_by_psnr, arg_max(variant, (s, -pos)) AS winner_by_ssim, arg_max(variant, (v, -pos)) AS winner_by_vmaf,
 CASE WHEN max(votes) > 0 THEN arg_max(variant, (votes, -pos)) END AS winner_by_votes, arg_max(variant, (score, -pos)) AS overall_winner FROM sc GROUP BY 1""")
def _(t):
    from ..operators.ab import winners

    pos = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    vote = (F.col("l_quantity") == 50) & (F.col("l_linestatus") == "O") & (F.col("l_discount") == 0.03)
    v = t.lineitem.groupBy(F.col("l_linenumber").alias("test_id"), F.col("l_returnflag").alias("variant"), pos.alias("pos")).agg(
        R6(F.avg("l_quantity")).alias("avg_psnr"), R6(F.avg(1 - F.col("l_discount"))).alias("avg_ssim"),
        R6(F.avg(100 - F.col("l_tax") * 500)).alias("avg_vmaf"), F.sum(vote.cast("long")).alias("votes"),
    )
    return winners(v, ("test_id",), "variant", "pos")


@query("W19_first_by_priority", """
SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber, l_orderkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    df = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice")
    order = [F.col(c) for c in ("l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice")]
    return tl.first_by_priority(df, ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")


@query("W20_latest_per_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def _(t):
    df = t.events.select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return tl.latest_per_key(df, ["user_id", "event_type"], ["ts", "event_id"])


@query("W21_keep_last_n", "SELECT user_id, event_id, rn AS recency_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def _(t):
    return tl.newest_n(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 5).drop("ts")


@query("W22_frame_gaps", """
WITH f AS (SELECT DISTINCT l_suppkey AS video_id, l_partkey AS fn FROM lineitem),
n AS (SELECT *, lead(fn) OVER (PARTITION BY video_id ORDER BY fn) AS nx FROM f),
x AS (SELECT (max(p_partkey) + 1) AS cnt FROM part)
SELECT video_id, fn AS start_frame, nx AS end_frame, nx - fn - 1 AS gap_size, false AS is_tail FROM n WHERE nx - fn > 1 AND nx - fn - 1 <= 10
UNION ALL SELECT video_id, max(fn), max(cnt) - 1, max(cnt) - 1 - max(fn), true FROM f CROSS JOIN x GROUP BY video_id HAVING max(cnt) - 1 > max(fn) AND max(cnt) - 1 - max(fn) <= 10""")
def _(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.col("l_partkey").alias("fn")).distinct()
    bound = t.part.agg((F.max("p_partkey") + 1).alias("expected_count"))
    expected = t.supplier.select(F.col("s_suppkey").alias("video_id"), bound.scalar().alias("expected_count"))
    return tl.frame_gaps(f, Seq(("video_id",), ("fn",)), 10, expected)


@query("W23_sequence_report", """
WITH c AS (SELECT l_suppkey AS video_id, l_partkey AS fn, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT video_id, CAST(sum(c) AS BIGINT) AS total_frames, max(fn) - min(fn) + 1 AS expected_frames, max(fn) - min(fn) + 1 - count(*) AS missing_count, CAST(sum(c - 1) AS BIGINT) AS duplicate_count,
 max(fn) - min(fn) + 1 = count(*) AND sum(c - 1) = 0 AS is_complete FROM c GROUP BY 1""")
def _(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.col("l_partkey").alias("fn"))
    return tl.sequence_report(f, ("video_id",), "fn")


@query("W24_ten_segment_profile", """
WITH x AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames),
s AS (SELECT *, CAST(least(frame_no // (n // 10), 9) AS INTEGER) AS segment FROM x WHERE n >= 10)
SELECT video_id, segment, min(frame_no) AS start_frame, max(frame_no) AS end_frame, round(avg(value), 6) AS avg_psnr, round(avg(k / 100.0e0), 6) AS avg_ssim,
 arg_min(frame_no, (value, frame_no)) AS min_quality_frame, arg_max(frame_no, (value, -frame_no)) AS max_quality_frame FROM s GROUP BY 1, 2""")
def _(t):
    df = t.frames.select("video_id", "frame_no", F.col("value").alias("psnr"), (F.col("k") / 100.0).alias("ssim"))
    out = tl.ten_segment_profile(df, TIMELINE, totals(t), "psnr", "ssim")
    return out.withColumn("avg_psnr", R6("avg_psnr")).withColumn("avg_ssim", R6("avg_ssim"))


@query("W25_recent_tail", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn <= 3")
def _(t):
    df = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "value", "ts")
    return tl.newest_n(df, ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "value")


@query("W26_drift_history", """
SELECT video_id, frame_no, round(avg(dr) OVER (PARTITION BY video_id ORDER BY frame_no ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS recent_drift, dr > 0.5e0 AS needs_correction
FROM (SELECT *, abs(k - 50) / 97.0e0 + value / 997 AS dr FROM frames)""")
def _(t):
    df = t.frames.select("video_id", "frame_no", (F.abs(F.col("k") - 50) / 97.0 + F.col("value") / 997).alias("dr"))
    return tl.drift_history(df, TIMELINE, "dr", 0.5).select("video_id", "frame_no", R6("recent_drift").alias("recent_drift"), "needs_correction")


@query("W27_correlated_duplicates", """
WITH e AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
x AS (SELECT label, vec_id, unnest(v) AS a, unnest(p) AS b FROM e WHERE p IS NOT NULL),
c AS (SELECT label, vec_id, corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS c FROM x GROUP BY 1, 2)
SELECT e.label, e.vec_id, round(c, 6) AS correlation, coalesce(c > 0.3e0, false) AS is_duplicate FROM e LEFT JOIN c USING (label, vec_id)""")
def _(t):
    df = number_rows(t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v")), Seq(("label",), ("vec_id",)))
    out = tl.correlated_duplicates(df, Seq(("label",), ("frame_no",), 4096), "v", 0.3)
    return out.select("label", "vec_id", R6("correlation").alias("correlation"), "is_duplicate")


@query("W28_cadence_breaks", """
WITH a AS (SELECT user_id AS video_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1)
SELECT video_id, n, round(m, 6) AS avg_comb, round(v, 6) AS variance, CAST(CASE WHEN n > 10 AND v > m * 0.5e0 THEN floor(v / m) ELSE 0 END AS BIGINT) AS cadence_breaks FROM a""")
def _(t):
    out = tl.cadence_breaks(t.events.withColumnRenamed("user_id", "video_id"), ("video_id",), "value")
    return out.withColumn("avg_comb", R6("avg_comb")).withColumn("variance", R6("variance"))


@query("W29_field_cadence", """
WITH h AS (SELECT video_id, frame_no AS i, value AS d, avg(value) OVER (PARTITION BY video_id) AS m, count(*) OVER (PARTITION BY video_id) AS n FROM frames WHERE frame_no < 100),
fl AS (SELECT video_id, i, n, d < m * 0.3e0 AS dup FROM h),
nx AS (SELECT *, lead(dup, 2) OVER (PARTITION BY video_id ORDER BY i) AS dup2 FROM fl),
ra AS (SELECT video_id, max(n) AS n, avg(CASE WHEN dup THEN 1.0e0 ELSE 0.0e0 END) AS r FROM fl GROUP BY 1),
ph AS (SELECT video_id, i % 5 AS o, avg(CASE WHEN dup OR dup2 THEN 1.0e0 ELSE 0.0e0 END) > 0.6e0 AS hit FROM nx WHERE i < n - 5 GROUP BY 1, 2),
pb AS (SELECT video_id, bool_or(hit) AS hit FROM ph GROUP BY 1)
SELECT video_id, CAST(n AS INTEGER) AS n_diffs, round(r, 6) AS duplicate_ratio, CASE WHEN n < 10 THEN 'none' WHEN r > 0.35e0 AND r < 0.45e0 AND hit THEN '3:2' WHEN r > 0.45e0 AND r < 0.55e0 THEN '2:2' ELSE 'none' END AS pattern
FROM ra LEFT JOIN pb USING (video_id)""")
def _(t):
    return tl.field_cadence(t.frames, TIMELINE, "value").withColumn("duplicate_ratio", R6("duplicate_ratio"))


@query("W30_silence_intervals", """
WITH l AS (SELECT video_id, frame_no, CASE WHEN event_type IN ('view', 'click') THEN CAST(frame_no AS DOUBLE) END AS s, CASE WHEN event_type = 'error' THEN frame_no + value / 10 END AS e FROM frames),
k AS (SELECT *, CASE WHEN s IS NOT NULL THEN 1 ELSE 2 END AS kind FROM l WHERE s IS NOT NULL OR e IS NOT NULL),
p AS (SELECT *, lag(s) OVER (PARTITION BY video_id ORDER BY frame_no) AS ps FROM k)
SELECT video_id, round(ps, 3) AS start_s, round(e, 3) AS end_s, round(e - ps, 3) AS duration_s, CASE WHEN round(e, 3) - ps > 10 THEN 'high' WHEN round(e, 3) - ps > 5 THEN 'medium' ELSE 'low' END AS severity
FROM p WHERE e IS NOT NULL AND ps IS NOT NULL""")
def _(t):
    line = F.when(F.col("event_type").isin("view", "click"), F.format_string("[sd] silence_start: %.3f", F.col("frame_no").cast("double"))).when(
        F.col("event_type") == "error", F.format_string("[sd] silence_end: %.3f | x", F.col("frame_no") + F.col("value") / 10)
    ).otherwise("frame=1")
    out = tl.silence_intervals(t.frames.select("video_id", "frame_no", line.alias("line")), TIMELINE, "line")
    return out.select("video_id", *[F.round(c, 3).alias(c) for c in ("start_s", "end_s", "duration_s")], "severity")


@query("W31_neighbour_outliers", """
WITH x AS (SELECT video_id, frame_no, k * 2.55e0 AS x, lag(k * 2.55e0) OVER w AS p, lead(k * 2.55e0) OVER w AS n FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_no))
SELECT video_id, frame_no, round(coalesce(greatest((abs(x - p) + abs(x - n)) / 510 - abs(p - n) / 255 - 0.1e0, 0), 0), 6) AS outlier,
 round(greatest(0, coalesce(abs(x - p) / 255, 0), coalesce(abs(x - n) / 255, 0)), 6) AS damage FROM x""")
def _(t):
    out = tl.neighbour_outliers(t.frames.select("video_id", "frame_no", (F.col("k") * 2.55).alias("level")), TIMELINE, "level")
    return out.select("video_id", "frame_no", R6("outlier").alias("outlier"), R6("damage").alias("damage"))
