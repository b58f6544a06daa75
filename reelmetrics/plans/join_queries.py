"""Queries for the join family (J) and for progressive drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, history
from ..operators import joins as jn
from ..operators import rollups as ru
from ..operators.sequence import Seq
from .bindings import TIMELINE
from .registry import query
from .rollup_queries import STOCK, rounded, stock_samples

C, L = F.col, F.lit
V = ("video_id",)


@query("J2_remaining_frames", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_linestatus = 'F' AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return jn.remaining_frames(df, t.lineitem.where("l_linestatus = 'F'"), ["l_orderkey", "l_linenumber"])


@query("J3_checkpoint_validity", """WITH m AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS frame_no, CASE WHEN l_linenumber <> 3 THEN md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) END AS checksum FROM lineitem WHERE l_returnflag <> 'R'),
 f AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS frame_no, md5(CAST(l_orderkey AS VARCHAR) || CASE WHEN l_orderkey % 50 = 0 THEN '+' ELSE '-' END || CAST(l_linenumber AS VARCHAR)) AS h FROM lineitem WHERE l_linestatus = 'F')
SELECT job_id, count(CASE WHEN h IS NULL THEN 1 END) AS missing, count(CASE WHEN h IS NOT NULL AND checksum <> h THEN 1 END) AS mismatched, bool_and(h IS NOT NULL AND (checksum IS NULL OR checksum = h)) AS is_valid FROM m LEFT JOIN f USING (job_id, frame_no) GROUP BY 1""")
def _(t):
    job, no = C("l_orderkey").cast("string"), C("l_linenumber").cast("string")
    m = t.lineitem.where("l_returnflag <> 'R'").select(C("l_orderkey").alias("job_id"), C("l_linenumber").alias("frame_no"), F.when(C("l_linenumber") != 3, F.md5(F.concat(job, L("-"), no))).alias("checksum"), L(True).alias("processed")).distinct()
    f = t.lineitem.where("l_linestatus = 'F'").select(C("l_orderkey").alias("job_id"), C("l_linenumber").alias("frame_no"), F.md5(F.concat(job, F.when(C("l_orderkey") % 50 == 0, "+").otherwise("-"), no)).alias("md5")).distinct()
    return jn.checkpoint_validity(m, f, ["job_id"], "frame_no")


@query("J4_verify_sidecars", """WITH f AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0), m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN strlen(text) + 1 ELSE strlen(text) END AS sz, CASE WHEN doc_id % 5 = 0 THEN md5('x') WHEN doc_id % 3 = 0 THEN NULL ELSE md5(text) END AS m5, CASE WHEN doc_id % 6 = 0 THEN sha256('x') ELSE sha256(text) END AS sh FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(f.doc_id, m.doc_id) AS doc_id, concat_ws(',', CASE WHEN f.doc_id IS NULL THEN 'file_missing' END, CASE WHEN m.doc_id IS NULL THEN 'sidecar_missing' END, CASE WHEN sz <> strlen(text) THEN 'size_mismatch' END, CASE WHEN m5 <> md5(text) THEN 'md5_mismatch' END, CASE WHEN sh <> sha256(text) THEN 'sha256_mismatch' END) AS issues,
 f.doc_id IS NOT NULL AND m.doc_id IS NOT NULL AND sz = strlen(text) AND coalesce(m5 = md5(text), true) AND sh = sha256(text) AS valid FROM f FULL JOIN m ON f.doc_id = m.doc_id""")
def _(t):
    body = F.encode("text", "UTF-8")
    files = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.octet_length("text").cast("long").alias("length"), body.alias("content"))
    side = t.documents.where("doc_id % 13 <> 0").select(
        "doc_id", (F.octet_length("text") + F.when(C("doc_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("file_size"),
        F.when(C("doc_id") % 5 == 0, F.md5(L("x"))).when(C("doc_id") % 3 == 0, L(None)).otherwise(F.md5(body)).alias("md5"),
        F.when(C("doc_id") % 6 == 0, F.sha2(L("x"), 256)).otherwise(F.sha2(body, 256)).alias("sha256"))
    return jn.verify_sidecars(side, files, "doc_id").withColumn("issues", F.array_join("issues", ","))


@query("J5_cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey)")
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return jn.cascade_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@query("J6_nearest_anchor", """WITH a AS (SELECT video_id, frame_no AS ap, value AS av FROM frames WHERE event_type = 'purchase')
SELECT f.video_id, f.frame_no, arg_min(ap, (abs(ap - f.frame_no), ap)) FILTER (WHERE ap IS NOT NULL) AS anchor_pos, arg_min(av, (abs(ap - f.frame_no), ap)) FILTER (WHERE ap IS NOT NULL) AS anchor_value FROM frames f LEFT JOIN a ON a.video_id = f.video_id GROUP BY 1, 2""")
def _(t):
    a = t.frames.where("event_type = 'purchase'").select("video_id", "frame_no", C("value").alias("anchor_value"))
    return jn.nearest_anchor(t.frames.select("video_id", "frame_no"), a, TIMELINE, ["anchor_value"])


@query("J7_interpolated_anchor", """WITH a AS (SELECT video_id, frame_no AS ap, value AS av, k AS ak FROM frames WHERE event_type = 'purchase'),
 b AS (SELECT f.video_id, f.frame_no, max(ap) FILTER (WHERE ap <= f.frame_no) AS p, arg_max(av, ap) FILTER (WHERE ap <= f.frame_no) AS pv, arg_max(ak, ap) FILTER (WHERE ap <= f.frame_no) AS pk, min(ap) FILTER (WHERE ap > f.frame_no) AS n, arg_min(av, ap) FILTER (WHERE ap > f.frame_no) AS nv, arg_min(ak, ap) FILTER (WHERE ap > f.frame_no) AS nk FROM frames f LEFT JOIN a ON a.video_id = f.video_id GROUP BY 1, 2),
 t AS (SELECT *, (frame_no - p) / CAST(n - p AS DOUBLE) AS t FROM b)
SELECT video_id, frame_no, round(CASE WHEN p IS NULL THEN nv WHEN n IS NULL OR p = frame_no THEN pv ELSE pv * (1 - t) + nv * t END, 6) AS v0, round(CASE WHEN p IS NULL THEN nk WHEN n IS NULL OR p = frame_no THEN pk ELSE pk * (1 - t) + nk * t END, 6) AS v1 FROM t""")
def _(t):
    a = t.frames.where("event_type = 'purchase'").select("video_id", "frame_no", F.array(C("value"), C("k").cast("double")).alias("vec"))
    out = jn.interpolate_anchors(t.frames.select("video_id", "frame_no"), a, TIMELINE, "vec")
    return out.select("video_id", "frame_no", F.round(F.get("vec", 0), 6).alias("v0"), F.round(F.get("vec", 1), 6).alias("v1"))


def kind_times(t, kind):
    us = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 100000) - 17040000000
    return t.events.where(C("event_type") == kind).select(C("user_id").alias("video_id"), us.alias("t"))


AV = """WITH a AS (SELECT user_id AS video_id, epoch_us(ts) // 100000 - 17040000000 AS t FROM events WHERE event_type = 'click'), v AS (SELECT user_id AS video_id, epoch_us(ts) // 100000 - 17040000000 AS t FROM events WHERE event_type = 'view')"""


def offset_sql(name, a, v, keys, lo, hi, step):
    on = " AND ".join(f"a.{k} = v.{k}" for k in keys)
    ks = ", ".join(f"a.{k}" for k in keys)
    pk = ", ".join(keys)
    return f"""{name}_h AS (SELECT {ks}, a.rid, o.o FROM (SELECT *, row_number() OVER () AS rid FROM {a}) a JOIN {v} v ON {on} AND abs(a.t - v.t) < 600000 JOIN (SELECT range AS o FROM range({lo}, {hi}, {step})) o ON abs(a.t + o.o * 1000 - v.t) < 50000 GROUP BY {ks}, a.rid, o.o),
 {name}_s AS (SELECT {pk}, o, count(*) AS n FROM {name}_h GROUP BY {pk}, o), {name}_b AS (SELECT {pk}, arg_max(o, (n, -o)) AS o, max(n) AS n FROM {name}_s GROUP BY {pk}), {name}_n AS (SELECT {pk}, count(*) AS c FROM {a} GROUP BY {pk}),
 {name} AS (SELECT {", ".join(f"x.{k}" for k in keys)}, CAST(coalesce(b.o, 0) AS DOUBLE) AS offset_ms, coalesce(b.n / CAST(c AS DOUBLE), 0) AS score FROM {name}_n x LEFT JOIN {name}_b b ON {" AND ".join(f"x.{k} = b.{k}" for k in keys)})"""


@query("J8_best_offset", AV + ", " + offset_sql("r", "a", "v", ["video_id"], -500, 500, 1) + " SELECT video_id, offset_ms, round(score, 6) AS score FROM r")
def _(t):
    return rounded(jn.best_offset(kind_times(t, "click"), kind_times(t, "view"), V, "t"), "score")


@query("J9_best_offset_coarse", AV + ", " + offset_sql("r", "a", "v", ["video_id"], -500, 501, 5) + " SELECT video_id, offset_ms, round(score, 6) AS score FROM r")
def _(t):
    return rounded(jn.best_offset(kind_times(t, "click"), kind_times(t, "view"), V, "t", step_ms=5, include_end=True), "score")


@query("A47_progressive_drift", AV + """, du AS (SELECT video_id, greatest(max(CASE WHEN s = 'a' THEN t END), max(CASE WHEN s = 'v' THEN t END)) AS d FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'v' FROM v) GROUP BY 1),
 ah AS (SELECT a.video_id, CASE WHEN t * 2 >= d THEN 1 ELSE 0 END AS half, t FROM a JOIN du USING (video_id)), vh AS (SELECT v.video_id, CASE WHEN t * 2 >= d THEN 1 ELSE 0 END AS half, t FROM v JOIN du USING (video_id)), """ + offset_sql("r", "ah", "vh", ["video_id", "half"], -500, 500, 1) + """,
 z AS (SELECT du.video_id, coalesce((SELECT count(*) FROM a WHERE a.video_id = du.video_id), 0) AS na, coalesce((SELECT count(*) FROM v WHERE v.video_id = du.video_id), 0) AS nv, coalesce((SELECT offset_ms FROM r WHERE r.video_id = du.video_id AND half = 0), 0) AS f, coalesce((SELECT offset_ms FROM r WHERE r.video_id = du.video_id AND half = 1), 0) AS s FROM du)
SELECT video_id, CASE WHEN na >= 10 AND nv >= 10 THEN abs(s - f) ELSE 0e0 END AS drift_change_ms, na >= 10 AND nv >= 10 AND abs(s - f) > 20 AS is_progressive FROM z""")
def _(t):
    a, v = kind_times(t, "click"), kind_times(t, "view")
    dur = a.unionByName(v).groupBy("video_id").agg(F.max("t").alias("duration_us"))
    return jn.progressive_drift(a, v, V, "t", dur)


@query("J10_points_in_intervals", """WITH iv AS (SELECT l_suppkey AS v, l_orderkey AS clip, l_linenumber AS ln, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
 p AS (SELECT l_suppkey AS v, l_orderkey AS frame, l_partkey AS t FROM lineitem WHERE l_returnflag = 'A') SELECT p.v, frame, t, clip, ln FROM p JOIN iv ON p.v = iv.v AND t >= s AND t < e""")
def _(t):
    iv = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(C("l_suppkey").alias("v"), C("l_orderkey").alias("clip"), C("l_linenumber").alias("ln"), C("l_partkey").alias("s"), (C("l_partkey") + C("l_quantity").cast("long")).alias("e"))
    p = t.lineitem.where("l_returnflag = 'A'").select(C("l_suppkey").alias("v"), C("l_orderkey").alias("frame"), C("l_partkey").alias("t"))
    return jn.points_in_intervals(p, iv, ["v"], "t", "s", "e", 32).select("v", "frame", "t", "clip", "ln")


STOCKROWS = ", ".join(f"({i}, '{n}', {r}e0, {g}e0, {b}e0, {s}e0, {gr}e0)" for i, (n, (r, g, b, s, gr)) in enumerate(jn.dims.FILM_STOCKS.items()))
MATCH = STOCK + f""", c AS (SELECT video_id, st.i, st.n, (1 - least(1, (abs(r_shift - st.r) + abs(g_shift - st.g) + abs(b_shift - st.b)) / 0.6e0)) * 2 AS co, 1 - least(1, abs(saturation - st.s * 0.5e0) / 0.3e0) AS sa, CASE WHEN grain_intensity > 0.02e0 THEN 1 - least(1, abs(grain_intensity - st.gr * 0.1e0) / 0.05e0) END AS gm FROM p CROSS JOIN (VALUES {STOCKROWS}) st(i, n, r, g, b, s, gr)),
 m AS (SELECT *, CASE WHEN gm IS NULL THEN (co + sa) / 3 ELSE (co + sa + gm) / 4 END AS cf FROM c), rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cf DESC, i) AS rn FROM m)"""


@query("J11_stock_match_scores", MATCH + " SELECT video_id, n AS stock, round(cf, 6) AS confidence FROM m")
def _(t):
    m = jn.stock_matches(ru.film_colour_profile(stock_samples(t), V))
    return rounded(m.select("video_id", F.inline("matches")), "confidence")


@query("T4_best_and_alternatives", MATCH + " SELECT video_id, CAST(rn - 1 AS INTEGER) AS rank, n AS stock, round(cf, 6) AS confidence FROM rk WHERE rn <= 4")
def _(t):
    m = jn.stock_matches(ru.film_colour_profile(stock_samples(t), V))
    return rounded(m.select("video_id", F.posexplode(F.slice("matches", 1, 4)).alias("rank", "m")).select("video_id", "rank", "m.*"), "confidence")


@query("J12_rate_lookup", """WITH r AS (SELECT n_regionkey AS p, CASE WHEN n_nationkey % 3 = 0 THEN 'gear' WHEN n_nationkey % 3 = 1 THEN 'small bolt' ELSE 'red' END AS g, n_nationkey / 9.0e0 AS usd, n_nationkey AS pos FROM nation),
 w AS (SELECT p_partkey, p_partkey % 6 AS pr, p_name FROM part), x AS (SELECT w.*, arg_min(usd, (CASE WHEN g = p_name THEN 0 ELSE 1 END, pos)) FILTER (WHERE g IS NOT NULL) AS usd FROM w LEFT JOIN r ON p = pr AND (g = p_name OR contains(g, p_name) OR contains(p_name, g)) GROUP BY 1, 2, 3)
SELECT p_partkey, round(usd, 6) AS usd_hour FROM x""")
def _(t):
    g = F.when(C("n_nationkey") % 3 == 0, "gear").when(C("n_nationkey") % 3 == 1, "small bolt").otherwise("red")
    rates = t.nation.select(C("n_regionkey").cast("long").alias("provider"), g.alias("gpu_name"), (C("n_nationkey") / 9.0).alias("usd_hour"), C("n_nationkey").alias("pos"))
    df = t.part.select("p_partkey", (C("p_partkey") % 6).alias("pr"), "p_name")
    return rounded(jn.rate_lookup(df, rates, "pr", "p_name").select("p_partkey", "usd_hour"), "usd_hour")


@query("J13_value_lookup", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_acctbal, 250) AS s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = l_suppkey")
def _(t):
    dim = t.supplier.where("s_suppkey % 3 = 0").withColumnRenamed("s_suppkey", "l_suppkey")
    return jn.value_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), dim, "l_suppkey", "s_acctbal", 250.0).select("l_orderkey", "l_linenumber", "l_suppkey", "s_acctbal")


@query("J14_cache_split", "SELECT l_orderkey, l_partkey, l_suppkey, EXISTS (SELECT 1 FROM lineitem c WHERE c.l_returnflag = 'N' AND c.l_partkey = l.l_partkey AND c.l_suppkey = l.l_suppkey) AS hit FROM lineitem l WHERE l_returnflag = 'R'")
def _(t):
    cols = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    hits, misses = jn.cache_split(cols.where("l_returnflag = 'R'"), cols.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])
    return hits.withColumn("hit", L(True)).unionByName(misses.withColumn("hit", L(False))).drop("l_returnflag")


def endpoints(t):
    return t.nation.select(C("n_name").alias("endpoint"), (C("n_nationkey") % 4 != 0).alias("enabled"), F.array(F.when(C("n_nationkey") % 2 == 0, "view").otherwise("click"), F.when(C("n_nationkey") % 3 == 0, "error").otherwise("signup")).alias("events"))


@query("J15_route_events", """WITH e AS (SELECT n_name AS endpoint, unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'view' ELSE 'click' END, CASE WHEN n_nationkey % 3 = 0 THEN 'error' ELSE 'signup' END]) AS ev FROM nation WHERE n_nationkey % 4 <> 0) SELECT event_id, event_type, endpoint FROM events JOIN e ON ev = event_type""")
def _(t):
    return jn.route_events(t.events.select("event_id", "event_type"), endpoints(t)).select("event_id", "event_type", "endpoint")


@query("J16_media_comparison", """WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS du, o_orderkey AS fr, 10 + o_custkey % 100 AS w, 100 AS h, CAST(o_totalprice / 1900 AS DOUBLE) AS fps, o_orderstatus <> 'F' AS au FROM orders), s AS (SELECT o_orderkey AS id, o_totalprice / 1000 + o_custkey % 3 - 1 + 0.001e0 AS du, o_orderkey + o_custkey % 9 AS fr, o_orderpriority <> '5-LOW' AS au FROM orders WHERE o_custkey % 10 <> 0),
 j AS (SELECT o.*, s.du AS sdu, s.fr AS sfr, s.au AS sau, s.id IS NOT NULL AS hs FROM o LEFT JOIN s ON o.id = s.id)
SELECT id, 'duration_mismatch' AS code, 'warning' AS severity FROM j WHERE abs(du - sdu) > 1 UNION ALL SELECT id, 'frame_count_mismatch', 'warning' FROM j WHERE abs(fr - sfr) > 5 UNION ALL SELECT id, 'resolution_mismatch', 'error' FROM j WHERE w < 16 OR h < 16
UNION ALL SELECT id, 'fps_mismatch', 'error' FROM j WHERE hs AND (fps < 1 OR fps > 240) UNION ALL SELECT id, 'audio_missing', 'warning' FROM j WHERE sau AND NOT au""")
def _(t):
    o = t.orders
    out = o.select(C("o_orderkey").alias("id"), (C("o_totalprice") / 1000).alias("duration"), C("o_orderkey").alias("frames"), (C("o_custkey") % 100 + 10).alias("width"), L(100).alias("height"), (C("o_totalprice") / 1900).alias("fps"), (C("o_orderstatus") != "F").alias("audio"))
    src = o.where("o_custkey % 10 <> 0").select(C("o_orderkey").alias("id"), (C("o_totalprice") / 1000 + C("o_custkey") % 3 - 1 + 0.001).alias("duration"), (C("o_orderkey") + C("o_custkey") % 9).alias("frames"), (C("o_orderpriority") != "5-LOW").alias("audio"))
    return jn.media_comparison(out, src, "id")


@query("J17_palette_distance", """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 255) AS v FROM embeddings), r AS (SELECT label, arg_min(v, vec_id) AS rv FROM e GROUP BY 1),
 d AS (SELECT vec_id, list_transform([1, 4, 7, 10], lambda i: list_min(list_transform([1, 4, 7, 10], lambda j: sqrt(pow(v[i] - rv[j], 2) + pow(v[i + 1] - rv[j + 1], 2) + pow(v[i + 2] - rv[j + 2], 2))))) AS nd, sqrt(pow(v[20] - rv[20], 2) + pow(v[21] - rv[21], 2) + pow(v[22] - rv[22], 2)) AS w, sqrt(pow(v[30] - rv[30], 2) + pow(v[31] - rv[31], 2) + pow(v[32] - rv[32], 2)) AS b, abs(v[40] - rv[40]) / 255 AS s, abs(v[50] - rv[50]) * 40 AS t FROM e JOIN r USING (label))
SELECT vec_id, round(0.4e0 * list_avg(nd) / 255 + 0.2e0 * w / (255 * sqrt(3)) + 0.1e0 * b / (255 * sqrt(3)) + 0.2e0 * s + 0.1e0 * t / 10000, 6) AS distance FROM d""")
def _(t):
    e = t.embeddings.select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double") * 255).alias("v"))
    r = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("rv"))

    def palette(v):
        return {"colors": F.array(*[F.slice(v, i, 3) for i in (1, 4, 7, 10)]), "white": F.slice(v, 20, 3), "black": F.slice(v, 30, 3), "saturation": F.element_at(v, 40) / 255, "temperature": F.element_at(v, 50) * 40}

    return e.join(r, "label").select("vec_id", F.round(jn.palette_distance(palette(C("v")), palette(C("rv"))), 6).alias("distance"))


CENTRE = """WITH x AS (SELECT label, vec_id, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(a AS DOUBLE)) AS a FROM x WHERE vec_id % 2 = 0 GROUP BY 1, 2),
 s AS (SELECT x.vec_id, c.label, sum(CAST(x.a AS DOUBLE) * c.a) / (sqrt(sum(CAST(x.a AS DOUBLE) * CAST(x.a AS DOUBLE))) * sqrt(sum(c.a * c.a))) AS sim FROM x JOIN c ON x.i = c.i GROUP BY 1, 2)"""


@query("J18_identity_match", CENTRE + " SELECT vec_id, round(max(sim), 6) AS similarity, CASE WHEN max(sim) >= 0.5e0 THEN arg_max(label, sim) END AS identity FROM s GROUP BY 1")
def _(t):
    x = t.embeddings.select("label", "vec_id", F.posexplode("embedding").alias("i", "a"))
    centre = x.where("vec_id % 2 = 0").groupBy("label", "i").agg(F.avg(C("a").cast("double")).alias("a"))
    ids = centre.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("reference"))
    faces = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return rounded(jn.identity_match(faces, "vec_id", ids, "vec", 0.5), "similarity")


@query("J19_grain_similarity", """WITH g AS (SELECT sk, ok, avg(q / 1.03e0) AS m0, avg(d / 0.0033e0) AS m1, stddev_pop(q) AS s0, avg(tx / 0.0107e0) AS s1, avg(ln / 1.07e0) AS sz, avg(tx / 0.113e0) AS ra FROM rws GROUP BY 1, 2), r AS (SELECT sk, min(ok) AS ok FROM g GROUP BY 1)
SELECT g.sk, g.ok, round(greatest(0, least(1, (1 - (abs(g.m0 - b.m0) + abs(g.m1 - b.m1)) / 2 / 50) * 0.3e0 + (1 - (abs(g.s0 - b.s0) + abs(g.s1 - b.s1)) / 2 / 30) * 0.3e0 + (1 - abs(g.sz - b.sz) / 5) * 0.2e0 + (1 - abs(g.ra - b.ra)) * 0.2e0)), 5) AS similarity FROM g JOIN r ON g.sk = r.sk JOIN g b ON b.sk = r.sk AND b.ok = r.ok""")
def _(t):
    g = t.rows.groupBy("sk", "ok").agg(F.struct(F.array(F.avg(C("q") / 1.03), F.avg(C("d") / 0.0033)).alias("mean"), F.array(F.stddev_pop("q"), F.avg(C("tx") / 0.0107)).alias("std"), F.avg(C("ln") / 1.07).alias("size"), F.avg(C("tx") / 0.113).alias("ratio")).alias("g"))
    r = g.groupBy("sk").agg(F.min_by("g", "ok").alias("r"))
    parts = lambda c: {n: C(f"{c}.{n}") for n in ("mean", "std", "size", "ratio")}
    return g.join(r, "sk").select("sk", "ok", F.round(jn.grain_similarity(parts("g"), parts("r")), 5).alias("similarity"))


RULEROWS = ", ".join(f"('{d}', '{p}', {pr}, {'NULL' if ms is None else ms}, {'NULL' if f is None else f})" for d, p, pr, ms, f in jn.PROCESSOR_RULES)
TYPES = ("interlacing", "scratches", "dust", "noise", "film_grain", "flicker", "vhs_artifacts", "tracking_errors", "blocking", "mosquito_noise", "odd")


@query("J20_processor_recommendations", f"""WITH f AS (SELECT ok, {list(TYPES)}[pk % 11 + 1] AS type, tx * 11 AS severity, row_number() OVER (PARTITION BY ok ORDER BY pk, sk, ln, q, ext) AS pos FROM rws), h AS (SELECT ok, r.p AS processor, r.pr AS priority, severity * r.f AS strength, type AS reason, pos FROM f JOIN (VALUES {RULEROWS}) r(d, p, pr, ms, f) ON r.d = type AND (r.ms IS NULL OR severity > r.ms)),
 z AS (SELECT *, row_number() OVER (PARTITION BY ok, processor ORDER BY priority, pos) AS rn FROM h) SELECT ok, processor, priority, round(strength, 6) AS strength, reason FROM z WHERE rn = 1""")
def _(t):
    kind = F.element_at(F.array(*[L(x) for x in TYPES]), (C("pk") % 11 + 1).cast("int"))
    df = t.rows.select("ok", kind.alias("type"), (C("tx") * 11).alias("severity"), F.struct("pk", "sk", "ln", "q", "ext").alias("pos"))
    return rounded(jn.processor_recommendations(df, ["ok"], "pos"), "strength")


def boxes(t, flag):
    return t.rows.where(C("rf") == flag).select("sk", F.struct("ok", "ln", "pk", "q", "ext").alias("box_id"), (C("pk") % 800).alias("x"), (C("ok") % 450).alias("y"), (C("q") * 2).cast("long").alias("w"), (C("ln") * 9).alias("h"))


BOXES = "WITH b AS (SELECT sk, ok, ln, rf, pk % 800 AS x, ok % 450 AS y, CAST(q * 2 AS BIGINT) AS w, ln * 9 AS h, pk FROM rws), a AS (SELECT * FROM b WHERE rf = 'A'), n AS (SELECT * FROM b WHERE rf = 'N')"


@query("J21_box_containment", BOXES + " SELECT a.sk, a.ok AS a_ok, a.ln AS a_ln, n.ok AS b_ok, n.ln AS b_ln FROM a JOIN n ON a.sk = n.sk AND a.x <= n.x AND a.y <= n.y AND a.x + a.w >= n.x + n.w AND a.y + a.h >= n.y + n.h")
def _(t):
    out = jn.box_containment(boxes(t, "A"), boxes(t, "N"), ["sk"])
    return out.select("sk", C("a_box_id.ok").alias("a_ok"), C("a_box_id.ln").alias("a_ln"), C("b_box_id.ok").alias("b_ok"), C("b_box_id.ln").alias("b_ln"))


@query("J22_reconstruct_sequence", """WITH m AS (SELECT video_id, frame_no, event_type, lag(event_type) OVER (PARTITION BY video_id ORDER BY frame_no) AS p FROM frames), u AS (SELECT video_id, frame_no, max(CASE WHEN p IS NULL OR p <> event_type THEN frame_no END) OVER (PARTITION BY video_id ORDER BY frame_no) AS unique_frame FROM m),
 e AS (SELECT video_id, frame_no AS ef FROM frames WHERE k % 3 = 0) SELECT u.video_id, u.frame_no, arg_min(ef, (abs(ef - unique_frame), ef)) FILTER (WHERE ef IS NOT NULL) AS source_frame FROM u LEFT JOIN e ON e.video_id = u.video_id GROUP BY 1, 2""")
def _(t):
    m = folds.exact_dedup(t.frames, TIMELINE, "event_type").select("video_id", "frame_no", "unique_frame")
    out = jn.reconstruct_sequence(m, t.frames.where("k % 3 = 0"), TIMELINE)
    return out.select("video_id", "frame_no", "source_frame")


@query("J23_stage_comparison", """WITH a AS (SELECT sk, ln, round(avg(q), 6) AS s FROM rws WHERE ls = 'O' AND ln + sk % 7 <> 5 GROUP BY 1, 2), b AS (SELECT sk, ln, round(avg(q), 6) AS s FROM rws WHERE ls = 'F' AND ln <> 2 GROUP BY 1, 2)
SELECT coalesce(a.sk, b.sk) AS sk, coalesce(a.ln, b.ln) AS ln, a.s AS a_seconds, b.s AS b_seconds FROM a FULL JOIN b ON a.sk = b.sk AND a.ln = b.ln""")
def _(t):
    side = lambda cond: t.rows.where(cond).groupBy("sk", "ln").agg(F.round(F.avg("q"), 6).alias("s"))
    return history.stage_comparison(side("ls = 'O' AND ln + sk % 7 <> 5"), side("ls = 'F' AND ln <> 2"), ["sk"], "ln", "s")


@query("J24_box_iou", BOXES + """, j AS (SELECT a.sk, a.ok AS a_ok, a.ln AS a_ln, n.ok AS b_ok, n.ln AS b_ln, (least(a.x + a.w, n.x + n.w) - greatest(a.x, n.x)) * (least(a.y + a.h, n.y + n.h) - greatest(a.y, n.y)) AS i, a.w * a.h + n.w * n.h AS s, greatest(a.x + a.w, n.x + n.w) - least(a.x, n.x) AS hull_w FROM a JOIN n ON a.sk = n.sk AND least(a.x + a.w, n.x + n.w) > greatest(a.x, n.x) AND least(a.y + a.h, n.y + n.h) > greatest(a.y, n.y))
SELECT sk, a_ok, a_ln, b_ok, b_ln, i AS intersection_area, round(i / CAST(s - i AS DOUBLE), 6) AS iou, hull_w FROM j""")
def _(t):
    out = jn.box_pairs(boxes(t, "A"), boxes(t, "N"), ["sk"])
    return out.select("sk", C("a_box_id.ok").alias("a_ok"), C("a_box_id.ln").alias("a_ln"), C("b_box_id.ok").alias("b_ok"), C("b_box_id.ln").alias("b_ln"), "intersection_area", F.round("iou", 6).alias("iou"), C("hull.w").alias("hull_w"))


FITS = "gb >= mg AND price <= mp AND disk >= 40 AND up >= 20 AND down >= 10"


@query(
    "J25_suitable_offers",
    f"""WITH jb AS (SELECT o_orderkey AS job_id, CASE o_custkey % 5 WHEN 0 THEN 'GIANT' WHEN 1 THEN 'LARGE' ELSE 'PROMO' END AS model,
  o_custkey % 50 * 8 + CASE WHEN o_custkey % 3 = 0 THEN 4.5e0 ELSE 0 END AS mg, 895 + o_custkey % 110 AS mp FROM orders),
 f AS (SELECT p_partkey AS offer_id, p_type AS model, p_size * 8 AS gb, p_retailprice AS price, p_partkey % 200 AS disk, p_partkey % 150 AS up, p_partkey % 90 AS down
  FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0),
 ow AS (SELECT job_id, offer_id, price, row_number() OVER (PARTITION BY job_id ORDER BY price, offer_id) AS rn FROM jb JOIN f ON jb.model = f.model AND {FITS}),
 un AS (SELECT * FROM jb WHERE job_id NOT IN (SELECT job_id FROM ow)),
 ot AS (SELECT job_id, offer_id, price, row_number() OVER (PARTITION BY job_id ORDER BY price, offer_id) AS rn FROM un JOIN f ON {FITS})
SELECT job_id, offer_id, price, CAST(rn AS INTEGER) AS offer_rank, false AS any_model FROM ow WHERE rn <= 3
UNION ALL SELECT job_id, offer_id, price, CAST(rn AS INTEGER), true FROM ot WHERE rn <= 3""",
)
def _(t):
    key, part = C("o_custkey"), C("p_partkey")
    model = F.when(key % 5 == 0, "GIANT").when(key % 5 == 1, "LARGE").otherwise("PROMO")
    jobs = t.orders.select(
        C("o_orderkey").alias("job_id"), model.alias("model"), (key % 50 * 8 + F.when(key % 3 == 0, 4.5).otherwise(0.0)).alias("min_gb"), (key % 110 + 895).alias("max_price"),
        L(40).alias("min_disk_gb"), L(20).alias("min_up_mbps"), L(10).alias("min_down_mbps"),
    )
    offers = t.part.select(
        part.alias("offer_id"), C("p_type").alias("model"), (C("p_size") * 8).alias("gb"), C("p_retailprice").alias("price"), (part % 200).alias("disk_gb"), (part % 150).alias("up_mbps"),
        (part % 90).alias("down_mbps"), (part % 11 != 0).alias("verified"), (part % 13 != 0).alias("rentable"), (part % 17 == 0).alias("external"),
    )
    return jn.suitable_offers(jobs, offers, 3)
