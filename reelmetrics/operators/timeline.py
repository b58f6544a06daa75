"""Window operators over frame timelines (family W).

Every function takes a DataFrame, a :class:`Seq` naming its keys and order, and column names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import by_group
from .sequence import (
    BLOCK, PART, Seq, adjacent, framed, key_join, neighbours, number_rows, running, segments, settle, with_block,
)

#: Missing numbers that one row lists before they are expanded.
PIECE = 1024


def lagged(df: DataFrame, seq: Seq, cols: dict[str, Column | str], step: int = 1) -> DataFrame:
    """Values ``step`` rows back (negative: ahead) on a gap-free position column."""

    def exprs(_frame, order):
        named = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}
        return {n: F.lag(c, step).over(order) for n, c in named.items()}

    return framed(df, seq, min(0, -step), max(0, -step), exprs)


def frame_differences(df: DataFrame, seq: Seq, luma: str, level: str, level_range: float) -> DataFrame:
    """``hist_diff`` and ``ssim``-like similarity to the previous frame from two scalar channels."""
    out = lagged(df, seq, {"_pl": luma, "_pv": level})
    return out.select(
        *df.columns,
        F.abs(F.col(luma) - F.col("_pl")).alias("hist_diff"),
        (F.lit(1.0) - F.abs(F.col(level) - F.col("_pv")) / F.lit(level_range)).alias("ssim"),
    )


def is_cut(hist_diff: str = "hist_diff", ssim: str = "ssim", hist_limit: float = 0.3, ssim_limit: float = 0.7) -> Column:
    """A frame starts a scene when it differs enough from the one before."""
    return F.coalesce((F.col(hist_diff) > hist_limit) | (F.col(ssim) < ssim_limit), F.lit(False))


def intelligence_boundaries(df: DataFrame, seq: Seq, brightness: str, content: str, motion: str) -> DataFrame:
    """``scene_start`` / ``scene_end`` flags from brightness, content and motion jumps.

    Brightness is on a 0-1 scale.  A video of one frame has no start.
    """

    def exprs(_frame, order):
        def changed(b, c, m, pb, pc, pm):
            spike = (pm == "static") & m.isin("high", "extreme")
            return (F.abs(b - pb) > 0.3) | (c != pc) | spike

        here = [F.col(c) for c in (brightness, content, motion)]
        before = [F.lag(c, 1).over(order) for c in here]
        after = [F.lead(c, 1).over(order) for c in here]
        has_next = F.lead(F.col(seq.first), 1).over(order).isNotNull()
        has_prev = F.lag(F.col(seq.first), 1).over(order).isNotNull()
        return {
            "scene_start": F.coalesce(changed(*here, *before), F.lit(False)) | (~has_prev & has_next),
            "scene_end": F.coalesce(changed(*after, *here), F.lit(False)),
        }

    return framed(df, seq, -1, 1, exprs)


def scene_segments(df: DataFrame, seq: Seq, cut: Column, transition: Column | None = None, aggs: dict | None = None) -> DataFrame:
    """Closed scenes ``[start_frame, end_frame]`` between cuts, transitions attached.

    A cut on the last frame yields a one-frame scene (the reference drops it; here the scenes
    always tile the timeline).
    """
    kind = F.lit("hard_cut") if transition is None else F.coalesce(transition, F.lit("hard_cut"))
    spec = {
        "end_frame": ("max", F.col(seq.first)),
        "_kind": ("first", kind),
        **(aggs or {}),
    }
    out = segments(df, seq, cut, spec, "start_frame")
    scene_seq = Seq(seq.keys, ("start_frame",), seq.width)
    out = neighbours(out, scene_seq, {"_has_prev": F.lit(True)}, {"_next": "_kind"})
    return out.select(
        *seq.keys,
        "start_frame",
        "end_frame",
        (F.col("end_frame") - F.col("start_frame") + 1).alias("duration_frames"),
        F.when(F.col("_has_prev"), F.col("_kind")).otherwise("hard_cut").alias("transition_in"),
        F.coalesce("_next", F.lit("hard_cut")).alias("transition_out"),
        *(aggs or {}),
    )


def transition_types(df: DataFrame, seq: Seq, cut: Column, window: int = 10) -> DataFrame:
    """``transition`` of every cut from the differences within ``window`` frames around it."""

    def exprs(frame, _order):
        # A missing difference counts as one in the run of differences and belongs at its end, up or down.
        diffs = F.collect_list(F.coalesce(F.col("hist_diff"), F.lit(-1.0))).over(frame)
        rising = F.transform(diffs, lambda x: F.when(x < 0, float("inf")).otherwise(x))
        avg, top = F.avg("hist_diff").over(frame), F.max("hist_diff").over(frame)
        d, s = F.col("hist_diff"), F.col("ssim")
        monotone = (F.sort_array(rising) == rising) | (F.sort_array(diffs, asc=False) == diffs)
        kind = (
            F.when(F.col(seq.first) < window, "hard_cut")
            .when((d > 0.6) & (d / F.greatest(avg, F.lit(0.01)) > 3.0), "hard_cut")
            .when((avg > 0.1) & (top < 0.4) & monotone, "fade")
            .when((avg > 0.2) & (avg < 0.5) & (s > 0.4), "dissolve")
            .when((avg > 0.15) & (top > 0.3), "unknown")
            .otherwise("hard_cut")
        )
        return {"transition": F.when(cut, kind)}

    return framed(df, seq, -(window - 1), window - 1, exprs)


def credits_batches(samples: DataFrame, seq: Seq, totals: DataFrame, fps: float, interval: float = 0.5) -> DataFrame:
    """W7 (features): fixed-size batches of samples, one row each, with class and confidence.

    ``samples`` has every frame with ``text_density, is_black, contrast_score, is_static,
    is_scrolling`` (the last two against the previous sample).  ``totals`` has ``total_frames``
    per key.
    """
    stride = max(1, int(fps * interval))
    size = int(5 / interval)
    pos = F.col(seq.first)
    ranked = samples.where(pos % stride == 0).withColumn("_s", F.floor(pos / stride))
    ranked = ranked.withColumn("batch", F.floor(F.col("_s") / size))
    inner = F.col("_s") % size != 0
    batches = ranked.groupBy(*seq.keys, "batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("text_density").alias("text_density"),
        F.avg("contrast_score").alias("contrast_score"),
        F.avg(F.col("is_black").cast("double")).alias("black_ratio"),
        F.sum((F.col("is_static") & inner).cast("long")).alias("_st"),
        F.sum((F.col("is_scrolling") & inner).cast("long")).alias("_sc"),
    )
    pairs = F.greatest(F.col("n") - 1, F.lit(1))
    first = F.col("batch") * size
    full = F.col("n") == size
    out = batches.transform(key_join, totals, seq.keys).select(
        *seq.keys,
        "batch",
        "total_frames",
        full.alias("is_full"),
        F.when(F.col("batch") == 0, F.lit(0)).otherwise((first - 1) * stride).cast("long").alias("start_frame"),
        F.when(full, (first + size - 1) * stride).otherwise(F.col("total_frames")).cast("long").alias("end_frame"),
        (F.col("n") * interval).alias("duration"),
        "text_density",
        "contrast_score",
        "black_ratio",
        (F.col("_st") / pairs).alias("static_ratio"),
        (F.col("_sc") / pairs).alias("scroll_ratio"),
    )
    verdict = credits_class(F.col("start_frame") / F.col("total_frames"))
    return out.withColumn("_v", verdict).select("*", "_v.segment_type", "_v.confidence").drop("_v")


def credits_class(place: Column, text_limit: float = 0.02, min_credits: float = 15.0) -> Column:
    """W7 (rules): segment type and confidence of one batch, first match wins."""
    text, black, static = F.col("text_density"), F.col("black_ratio"), F.col("static_ratio")
    scroll, contrast, dur = F.col("scroll_ratio"), F.col("contrast_score"), F.col("duration")

    def verdict(kind: str, conf: Column | float) -> Column:
        conf = conf if isinstance(conf, Column) else F.lit(conf)
        return F.struct(F.lit(kind).alias("segment_type"), conf.cast("double").alias("confidence"))

    by_scroll = F.lit(0.7) + scroll * 0.2
    by_card = F.lit(0.5) + contrast * 0.3
    by_text = F.lit(0.4) + F.least(text * 10, F.lit(0.3))
    scrolling = (scroll > 0.5) & (text > text_limit)
    card = (contrast > 0.5) & (static > 0.7)
    wordy = text > text_limit * 2
    rest = F.when(wordy, by_text).when(card, by_card).when(scrolling, by_scroll).otherwise(0.0)
    return (
        F.when(black > 0.8, verdict("black", 0.9))
        .when(scrolling & (place > 0.7), verdict("credits_closing", by_scroll))
        .when(scrolling & (place < 0.3), verdict("credits_opening", F.least(by_scroll, F.lit(0.7))))
        .when(card & (dur < 10), verdict("title_card", by_card))
        .when(card & (place < 0.2), verdict("intro", by_card))
        .when(card & (place > 0.8), verdict("credits_closing", by_card))
        .when((static > 0.9) & (dur < 5) & (contrast > 0.3), verdict("static_logo", 0.6))
        .when(wordy & (place > 0.8) & (dur > min_credits), verdict("credits_closing", by_text))
        .when(wordy & (place < 0.2), verdict("intro", F.greatest(by_text - 0.2, F.lit(0.3))))
        .otherwise(verdict("content", rest))
    )


def credits_segments(batches: DataFrame, seq: Seq) -> DataFrame:
    """W7 (segments): merge touching full batches of equal class; a partial tail stays alone."""
    kept = batches.where((F.col("segment_type") != "content") & (F.col("confidence") > 0.4))
    order = Seq(seq.keys, ("start_frame",), seq.width)
    kept = adjacent(kept, order, {"_pt": "segment_type", "_pe": "end_frame"}, -1)
    joined = F.col("is_full") & (F.col("_pt") == F.col("segment_type")) & (F.col("_pe") == F.col("start_frame"))
    return segments(
        kept,
        order,
        ~F.coalesce(joined, F.lit(False)),
        {
            "segment_type": ("first", F.col("segment_type")),
            "end_frame": ("max", F.col("end_frame")),
            "confidence": ("max", F.col("confidence")),
            "total_frames": ("max", F.col("total_frames")),
        },
        "start_frame",
    )


def main_content_bounds(segs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Main content between the last intro (first 30%) and the first credits (last 30%)."""
    start, total = F.col("start_frame"), F.col("total_frames")
    intro = F.col("segment_type").isin("intro", "credits_opening") & (start < total * 0.3)
    closing = (F.col("segment_type") == "credits_closing") & (start > total * 0.7)
    out = segs.groupBy(*keys).agg(
        F.max(F.when(intro, F.col("end_frame"))).alias("_in"),
        F.min(F.when(closing, start)).alias("_out"),
        F.max(total).alias("total_frames"),
    )
    return out.select(
        *keys,
        F.coalesce("_in", F.lit(0)).alias("main_start"),
        F.coalesce("_out", "total_frames").alias("main_end"),
    )


def merge_intervals(df: DataFrame, seq: Seq, start: str, end: str) -> DataFrame:
    """W9 (1-D): union of overlapping or touching intervals; ``seq`` orders by start, nulls last.

    Only block, start and end of a row are shuffled, once: where every interval ends at or after its
    start, the order of equal starts does not matter (a look at the rows, while the plan is built, tells).
    A block is merged by itself; what the blocks before it reach closes its first groups into theirs, so
    that at most two rows a block travel on.
    """
    df, seq = settle(df, seq)
    sound = F.coalesce(F.col(end) >= F.col(start), F.lit(False))
    order = [start] if df.where(~sound).isEmpty() else list(seq.order)
    rows = with_block(df, seq).select(PART, *order, end)
    by_order = W.partitionBy(PART).orderBy(*[F.col(c).asc_nulls_last() for c in order])

    def fresh(reach: str) -> Column:
        return F.coalesce(F.col(reach).isNull() | (F.col(start) > F.col(reach)), F.lit(False))

    reach = F.max(end).over(by_order.rowsBetween(W.unboundedPreceding, -1))
    local = rows.withColumn("_reach", reach).withColumn(
        "_g", F.sum(fresh("_reach").cast("long")).over(by_order.rowsBetween(W.unboundedPreceding, 0))
    )
    total = [F.min(start).alias(start), F.max(end).alias(end)]
    groups = local.groupBy(PART, "_g").agg(*total, F.count(F.lit(1)).alias("n"))
    key = [F.col(f"{PART}.{k}").alias(k) for k in seq.keys]
    if seq.width is None:
        return groups.select(*key, start, end, "n")

    by_block = W.partitionBy(*[F.col(f"{PART}.{k}") for k in seq.keys]).orderBy(F.col(f"{PART}.{BLOCK}").asc_nulls_last())
    edges = groups.groupBy(PART).agg(F.max(end).alias("_e"), F.max("_g").alias("_last"))
    edges = edges.select(PART, "_last", F.max("_e").over(by_block.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    groups = groups.join(edges, PART).withColumn("_fresh", fresh("_before"))
    closed = F.col("_fresh") & (F.col("_g") < F.col("_last"))
    pieces = groups.where(~closed).groupBy(PART, "_fresh").agg(*total, F.sum("n").alias("n"))
    in_turn = by_block.orderBy(F.col(f"{PART}.{BLOCK}").asc_nulls_last(), "_fresh").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.select(*key, start, end, "n", F.sum(F.col("_fresh").cast("long")).over(in_turn).alias("_g"))
    stitched = pieces.groupBy(*seq.keys, "_g").agg(*total, F.sum("n").alias("n")).drop("_g")
    return groups.where(closed).select(*key, start, end, "n").unionByName(stitched)


def text_cues(df: DataFrame, seq: Seq, text: str, confidence: str, totals: DataFrame, fps: float, min_confidence: float = 0.6) -> DataFrame:
    """One cue per run of equal text among confident rows; it lasts until the next run.

    ``totals`` has ``total_frames`` per key; the last cue ends there.
    """
    seen = df.where((F.col(confidence) >= min_confidence) & (F.col(text) != ""))
    seen = adjacent(seen, seq, {"_pt": text}, -1)
    runs = segments(
        seen,
        seq,
        F.col("_pt").isNull() | (F.col("_pt") != F.col(text)),
        {"text": ("first", F.col(text)), "n_frames": ("count", F.lit(1))},
        "start_frame",
    )
    cue_seq = Seq(seq.keys, ("start_frame",), seq.width)
    runs = adjacent(runs, cue_seq, {"_end": "start_frame"}, +1)
    runs = number_rows(runs, cue_seq, "cue_index", start=1).transform(key_join, totals, seq.keys)
    return runs.select(
        *seq.keys,
        "cue_index",
        "text",
        "n_frames",
        (F.col("start_frame") / fps).alias("start_s"),
        (F.coalesce("_end", "total_frames") / fps).alias("end_s"),
    )


def shaky_segments(df: DataFrame, seq: Seq, dx: str, dy: str, rotation: str, threshold: float = 0.3, min_length: int = 5) -> DataFrame:
    """Runs of strong motion; a run ends on the first calm frame, or on the last frame."""
    size = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy)) + F.degrees(F.abs(F.col(rotation))) * 5
    marked = df.withColumn("_shaky", size > threshold * 50)
    marked = lagged(marked, seq, {"_was": "_shaky"})
    runs = segments(
        marked,
        seq,
        F.col("_was").isNull() | (F.col("_was") != F.col("_shaky")),
        {"_shaky": ("first", F.col("_shaky")), "_last": ("max", F.col(seq.first))},
        "start_frame",
    )
    runs = adjacent(runs, Seq(seq.keys, ("start_frame",), seq.width), {"_calm": "start_frame"}, +1)
    end = F.coalesce("_calm", "_last")
    return runs.where(F.col("_shaky") & (end - F.col("start_frame") >= min_length)).select(
        *seq.keys, "start_frame", end.alias("end_frame")
    )


def _edge_padded_mean(value: str, seq: Seq, window: int, order) -> Column:
    """Mean of ``window`` values around a row, edge values repeated (W13's window alignment)."""
    back, ahead = window // 2, window - 1 - window // 2
    frame = order.rowsBetween(-back, ahead)
    pos = F.col(seq.first)
    n_before = F.count(pos).over(order.rowsBetween(-back, 0)) - 1
    n_after = F.count(pos).over(order.rowsBetween(0, ahead)) - 1
    head = (F.lit(back) - n_before) * F.first(value).over(frame)
    tail = (F.lit(ahead) - n_after) * F.last(value).over(frame)
    return (F.sum(value).over(frame) + head + tail) / F.lit(float(window))


def moving_average(df: DataFrame, seq: Seq, cols: dict[str, str], window: int) -> DataFrame:
    """Centred moving average with edge-value padding; even windows look one row further back."""
    if window <= 1:
        return df.select("*", *[F.col(c).alias(n) for n, c in cols.items()])
    back, ahead = window // 2, window - 1 - window // 2
    return framed(
        df, seq, -back, ahead, lambda _f, order: {n: _edge_padded_mean(c, seq, window, order) for n, c in cols.items()}
    )


def gaussian_smooth(df: DataFrame, seq: Seq, cols: dict[str, str], sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian-weighted centred mean, edge values repeated; the radius bounds the row frame."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*[F.lit(w / total) for w in weights])

    def smooth(value: str, order) -> Column:
        around = F.collect_list(value).over(order.rowsBetween(-radius, radius))
        pos = F.col(seq.first)
        n_before = F.count(pos).over(order.rowsBetween(-radius, 0)) - 1
        n_after = F.count(pos).over(order.rowsBetween(0, radius)) - 1
        first, last = F.element_at(around, 1), F.element_at(around, -1)
        padded = F.concat(
            F.array_repeat(first, (F.lit(radius) - n_before).cast("int")),
            around,
            F.array_repeat(last, (F.lit(radius) - n_after).cast("int")),
        )
        products = F.zip_with(padded, kernel, lambda v, w: v * w)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    return framed(df, seq, -radius, radius, lambda _f, order: {n: smooth(c, order) for n, c in cols.items()})


def trajectory(
    df: DataFrame,
    seq: Seq,
    strength: float = 0.8,
    mode: str = "average",
    max_shift: float = 100.0,
    max_angle: float = 15.0,
    preserve_scale: bool = True,
) -> DataFrame:
    """Cumulative motion path, its smoothed version and the clamped correction.

    ``df`` has ``dx, dy, rotation, scale`` (scale > 0; its cumulative product is exp of a sum).
    """
    paths = {"path_dx": "dx", "path_dy": "dy", "path_rot": "rotation"}
    spec = {n: ("sum", F.col(c)) for n, c in paths.items()}
    spec["_ln"] = ("sum", F.ln("scale"))
    out = running(df, seq, spec).withColumn("path_scale", F.exp("_ln")).drop("_ln")
    smooth = {f"s_{n}": n for n in [*paths, "path_scale"]}
    if mode == "average" and int(30 * strength) > 1:
        out = moving_average(out, seq, smooth, int(30 * strength))
    elif mode == "gauss" and int(30 * strength) > 0:
        out = gaussian_smooth(out, seq, smooth, (int(30 * strength) * 2 + 1) / 6.0)
    else:
        out = out.select("*", *[F.col(c).alias(n) for n, c in smooth.items()])

    def clamp(col: Column, limit: float) -> Column:
        return F.greatest(F.least(col, F.lit(limit)), F.lit(-limit))

    scale = F.lit(1.0) if preserve_scale else F.col("s_path_scale") / F.col("path_scale")
    return out.select(
        *df.columns,
        *paths,
        "path_scale",
        clamp(F.col("s_path_dx") - F.col("path_dx"), max_shift).alias("corr_dx"),
        clamp(F.col("s_path_dy") - F.col("path_dy"), max_shift).alias("corr_dy"),
        clamp(F.col("s_path_rot") - F.col("path_rot"), math.radians(max_angle)).alias("corr_rot"),
        scale.alias("corr_scale"),
    )


def rolling_progress(df: DataFrame, seq: Seq, time_ms: str, totals: DataFrame, window: int = 100, quality: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last ``window`` times, percent done and ETA after every processed frame.

    ``df`` holds processed frames (time > 0) numbered from 0; ``totals`` has ``total_frames``
    per key.  Quality means skip nulls.
    """

    def exprs(frame, _order):
        out = {"avg_time_ms": F.avg(time_ms).over(frame)}
        out.update({f"avg_{q}": F.avg(q).over(frame) for q in quality})
        return out

    out = framed(df, seq, -(window - 1), 0, exprs).transform(key_join, totals, seq.keys)
    done = F.col(seq.first) + 1
    left = F.col("total_frames") - done
    return out.select(
        *df.columns,
        "avg_time_ms",
        *[f"avg_{q}" for q in quality],
        F.when(left > 0, left * F.col("avg_time_ms") / 1000).otherwise(0.0).alias("eta_seconds"),
        F.when(F.col("total_frames") > 0, done / F.col("total_frames") * 100).otherwise(0.0).alias("percent"),
    )


def _leading_values(df: DataFrame, seq: Seq, value: str, n: int, name: str) -> DataFrame:
    """The first ``n`` values of every key as an array; the filter bounds each group."""
    head = df.where(F.col(seq.first) < n)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(seq.first), F.col(value).alias("v"))))
    return head.groupBy(*seq.keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def _duplicate_flags(diffs: Column) -> Column:
    mean = F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(diffs), F.lit(0))
    limit = mean * 0.3
    return F.transform(diffs, lambda x: x < limit)


def _share(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x)) / F.nullif(F.size(flags), F.lit(0))


def film_cadence(df: DataFrame, seq: Seq, value: str, fps: float) -> DataFrame:
    """Pulldown pattern from the first 30 frame differences of every video."""
    heads = _leading_values(df, seq, value, 31, "_head")
    v, diffs, flags = F.col("_head"), F.col("diffs"), F.col("flags")
    n = F.size(flags)
    out = heads.select(
        *seq.keys,
        F.size(v).alias("n_head"),
        F.zip_with(
            F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
            F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
            lambda a, b: F.abs(b - a),
        ).alias("diffs"),
    )
    out = out.withColumn("flags", _duplicate_flags(diffs)).withColumn(
        "duplicate_ratio", F.when(n > 0, _share(flags)).otherwise(0.0)
    )
    indexed = F.transform(flags, lambda x, i: F.struct(x.alias("d"), i.alias("i")))

    def hits(offset: Column) -> Column:
        spots = F.filter(indexed, lambda e: (e["i"] % 5 == offset) | (e["i"] % 5 == (offset + 2) % 5))
        return F.size(F.filter(spots, lambda e: e["d"])) > F.size(spots) * 0.7

    in_phase = F.exists(F.sequence(F.lit(0), F.lit(4)), hits)
    ratio = F.col("duplicate_ratio")
    ntsc = abs(fps - 29.97) < 0.1
    fallback = F.lit("3:2" if ntsc else None).cast("string")
    pattern = (
        F.when(F.lit(abs(fps - 25.0) < 0.1 or abs(fps - 23.976) < 0.1), F.lit(None).cast("string"))
        .when(F.col("n_head") < 10, fallback)
        .when((ratio > 0.35) & (ratio < 0.45) & in_phase, "3:2")
        .when((ratio > 0.45) & (ratio < 0.55), "2:2")
        .otherwise(fallback)
    )
    return out.select(*seq.keys, "n_head", "duplicate_ratio", pattern.alias("pattern"))


def field_cadence(df: DataFrame, seq: Seq, diff: str, max_samples: int = 100) -> DataFrame:
    """Pulldown pattern of sampled differences; one of positions i, i+2 repeats per group of five."""
    heads = _leading_values(df, seq, diff, max_samples, "diffs")
    flags = F.col("flags")
    out = heads.withColumn("flags", _duplicate_flags(F.col("diffs"))).withColumn("duplicate_ratio", _share(flags))
    n = F.size(flags)
    indexed = F.transform(flags, lambda x, i: F.struct((x | F.get(flags, i + 2)).alias("d"), i.alias("i")))

    def regular(offset: Column) -> Column:
        spots = F.filter(indexed, lambda e: (e["i"] % 5 == offset) & (e["i"] < n - 5))
        return (F.size(spots) > 0) & (F.size(F.filter(spots, lambda e: e["d"])) > F.size(spots) * 0.6)

    ratio = F.col("duplicate_ratio")
    pattern = (
        F.when(n < 10, "none")
        .when((ratio > 0.35) & (ratio < 0.45) & F.exists(F.sequence(F.lit(0), F.lit(4)), regular), "3:2")
        .when((ratio > 0.45) & (ratio < 0.55), "2:2")
        .otherwise("none")
    )
    return out.select(*seq.keys, n.alias("n_diffs"), "duplicate_ratio", pattern.alias("pattern"))


def first_by_priority(df: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """The row with the lowest priority per key, as a map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*rest)
    return df.groupBy(*keys).agg(F.min_by(packed, F.struct(*priority)).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """Current row per key (resume point, latest checkpoint, current job state)."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in recency])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*")


def newest_n(df: DataFrame, keys: list[str], recency: list[str], n: int, rank: str = "recency_rank") -> DataFrame:
    """Newest ``n`` rows per key; Spark limits each group before the shuffle."""
    order = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in recency])
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def frame_gaps(df: DataFrame, seq: Seq, max_gap: int | None, expected: DataFrame | None = None) -> DataFrame:
    """Holes in the frame numbers (``expected``: ``expected_count`` per key adds the tail); no ``max_gap``: all."""
    pos = F.col(seq.first)
    nxt = adjacent(df, seq, {"_next": pos}, +1)
    inner = nxt.where(F.col("_next") - pos > 1).select(
        *seq.keys,
        pos.alias("start_frame"),
        F.col("_next").alias("end_frame"),
        (F.col("_next") - pos - 1).alias("gap_size"),
        F.lit(False).alias("is_tail"),
    )
    if expected is not None:
        last = df.groupBy(*seq.keys).agg(F.max(pos).alias("_last")).transform(key_join, expected, seq.keys)
        missing = F.col("expected_count") - 1 - F.col("_last")
        tail = last.where(missing > 0).select(
            *seq.keys,
            F.col("_last").alias("start_frame"),
            (F.col("expected_count") - 1).alias("end_frame"),
            missing.alias("gap_size"),
            F.lit(True).alias("is_tail"),
        )
        inner = inner.unionByName(tail)
    return inner if max_gap is None else inner.where(F.col("gap_size") <= max_gap)


def sequence_report(df: DataFrame, keys: tuple[str, ...], number: str) -> DataFrame:
    """Counts of missing and repeated numbers and the complete flag, without listing them."""
    per_number = df.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("_c"))
    out = per_number.groupBy(*keys).agg(
        F.sum("_c").alias("total_frames"),
        F.count(F.lit(1)).alias("_distinct"),
        (F.max(number) - F.min(number) + 1).alias("expected_frames"),
        F.sum(F.col("_c") - 1).alias("duplicate_count"),
    )
    missing = F.col("expected_frames") - F.col("_distinct")
    return out.select(
        *keys,
        "total_frames",
        "expected_frames",
        missing.alias("missing_count"),
        "duplicate_count",
        ((missing == 0) & (F.col("duplicate_count") == 0)).alias("is_complete"),
    )


#: Numbers of a block of :func:`missing_numbers`, and of the stretches of it that are listed key by key.
MISSING_BLOCK, STRETCH = 2048, 256


def missing_numbers(df: DataFrame, seq: Seq) -> DataFrame:
    """Every missing number, expanded from the gaps (rows only where something is missing).

    Keys and numbers are shuffled once, by block of numbers and key. Gaps inside a block are found and expanded where
    they are, stretch by stretch, so that the keys of a task list about the same numbers one after another, which files
    keep short. Gaps over a block's end come from one row a key and block; they are cut into pieces of at most
    ``PIECE`` numbers and sorted by them before they are expanded. No row holds a long gap as one array.
    """
    kind, pos = df.schema[seq.first].dataType, F.col(seq.first)
    n = lambda k: F.lit(k).cast(kind)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64(*seq.keys)
    rows = df.where(pos.isNotNull()).select(*seq.keys, pos, (pos - F.pmod(pos, n(MISSING_BLOCK))).alias("_block")).repartitionByRange(parts, "_block", place)
    here = [*seq.keys, "_block", place]

    def between(pairs: DataFrame) -> DataFrame:
        return pairs.where("_z > _a").select(*seq.keys, (F.col("_a") + 1).alias("_from"), (F.col("_z") - 1).alias("_to")).where("_from <= _to")

    after = F.lead(pos).over(W.partitionBy(*here).orderBy(pos))
    gaps = between(rows.select(*seq.keys, pos.alias("_a"), after.alias("_z")))
    starts = F.sequence(F.col("_from") - F.pmod("_from", n(STRETCH)), F.col("_to"), n(STRETCH))
    listed = gaps.select("*", F.explode(starts).alias("_start")).sortWithinPartitions("_start", *seq.keys, "_from")
    span = F.sequence(F.greatest("_from", "_start"), F.col("_start") + F.least(n(STRETCH - 1), F.col("_to") - F.col("_start")))
    inside = listed.select(*seq.keys, F.explode(span).alias("missing_frame"))

    ends = rows.groupBy(*here).agg(F.min(pos).alias("_first"), F.max(pos).alias("_a"))
    after = F.lead("_first").over(W.partitionBy(*seq.keys).orderBy("_block"))
    gaps = between(ends.select(*seq.keys, "_a", after.alias("_z")))
    pieces = gaps.select(*seq.keys, F.explode(F.sequence("_from", "_to", n(PIECE))).alias("_from"), "_to")
    pieces = pieces.repartitionByRange(parts, "_from").sortWithinPartitions(*seq.keys, "_from")
    span = F.sequence(F.col("_from"), F.col("_from") + F.least(n(PIECE - 1), F.col("_to") - F.col("_from")))
    return inside.unionByName(pieces.select(*seq.keys, F.explode(span).alias("missing_frame")))


def ten_segment_profile(df: DataFrame, seq: Seq, totals: DataFrame, psnr: str, ssim: str) -> DataFrame:
    """Ten equal parts of floor(n / 10) rows, the last one takes the remainder; n >= 10."""
    pos = F.col(seq.first)
    part = F.least(F.floor(pos / F.floor(F.col("total_frames") / 10)), F.lit(9)).cast("int")
    sized = df.transform(key_join, totals.where("total_frames >= 10"), seq.keys).withColumn("segment", part)
    return sized.groupBy(*seq.keys, "segment").agg(
        F.min(pos).alias("start_frame"),
        F.max(pos).alias("end_frame"),
        F.avg(psnr).alias("avg_psnr"),
        F.avg(ssim).alias("avg_ssim"),
        F.min_by(pos, F.struct(F.col(psnr), pos)).alias("min_quality_frame"),
        F.max_by(pos, F.struct(F.col(psnr), -pos)).alias("max_quality_frame"),
    )


def drift_history(df: DataFrame, seq: Seq, drift: str, limit: float, window: int = 100) -> DataFrame:
    """Colour drift against the reference with its recent mean and a correction flag."""
    return framed(
        df,
        seq,
        -(window - 1),
        0,
        lambda frame, _o: {
            "recent_drift": F.avg(drift).over(frame),
            "needs_correction": F.col(drift) > limit,
        },
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays; null for constant input."""
    n = F.size(a)

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)

    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va = total(F.transform(a, lambda x: (x - ma) * (x - ma)))
    vb = total(F.transform(b, lambda x: (x - mb) * (x - mb)))
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def correlated_duplicates(df: DataFrame, seq: Seq, thumb: str, threshold: float = 0.99) -> DataFrame:
    """Frames whose thumbnail correlates with that of the frame before."""
    out = lagged(df, seq, {"_prev": thumb})
    corr = pearson(F.col(thumb), F.col("_prev"))
    return out.withColumn("correlation", corr).drop("_prev").withColumn(
        "is_duplicate", F.coalesce(F.col("correlation") > threshold, F.lit(False))
    )


def cadence_breaks(df: DataFrame, keys: tuple[str, ...], comb: str) -> DataFrame:
    """Estimate of cadence breaks when comb values vary by more than half their mean (n > 10)."""
    out = df.groupBy(*keys).agg(
        F.count(comb).alias("n"), F.avg(comb).alias("avg_comb"), F.var_pop(comb).alias("variance")
    )
    irregular = (F.col("n") > 10) & (F.col("variance") > F.col("avg_comb") * 0.5)
    return out.withColumn(
        "cadence_breaks", F.when(irregular, F.floor(F.col("variance") / F.col("avg_comb"))).otherwise(0).cast("long")
    )


def silence_intervals(lines: DataFrame, seq: Seq, text: str) -> DataFrame:
    """Pair every silence end line with the latest start line not yet used."""
    t = F.col(text)

    def number(pattern: str) -> Column:
        found = F.regexp_extract(t, pattern, 1)
        return F.when(found != "", found.try_cast("double"))

    start = F.when(t.contains("silence_start:"), number(r"silence_start:\s*([\d.]+)"))
    end = F.when(start.isNull() & t.contains("silence_end:"), number(r"silence_end:\s*([\d.]+)"))
    marks = lines.select(
        *seq.keys,
        *seq.order,
        start.alias("_start"),
        end.alias("_end"),
        number(r"silence_duration:\s*([\d.]+)").alias("_dur"),
    ).where(F.col("_start").isNotNull() | F.col("_end").isNotNull())
    marks = adjacent(marks, seq, {"_ps": "_start"}, -1)
    duration = F.coalesce("_dur", F.col("_end") - F.col("_ps"))
    return marks.where(F.col("_end").isNotNull() & F.col("_ps").isNotNull()).select(
        *seq.keys,
        F.col("_ps").alias("start_s"),
        F.col("_end").alias("end_s"),
        duration.alias("duration_s"),
        F.when(duration > 10.0, "high").when(duration > 5.0, "medium").otherwise("low").alias("severity"),
    )


def neighbour_outliers(df: DataFrame, seq: Seq, level: str, full_scale: float = 255.0) -> DataFrame:
    """Damage of a frame from how far it stands out between its two neighbours."""

    def exprs(_frame, order):
        x = F.col(level)
        p, n = F.lag(x, 1).over(order), F.lead(x, 1).over(order)
        dp, dn = F.abs(x - p), F.abs(x - n)
        both = (dp + dn) / (2 * full_scale) - F.abs(p - n) / full_scale - 0.1
        worst = F.greatest(
            F.lit(0.0),
            F.coalesce(dp / full_scale, F.lit(0.0)),
            F.coalesce(dn / full_scale, F.lit(0.0)),
        )
        return {"outlier": F.coalesce(F.greatest(both, F.lit(0.0)), F.lit(0.0)), "damage": worst}

    return framed(df, seq, -1, 1, exprs)


#: Rows of a key whose transform is one call, and the side of the tiles in which longer ones travel.
WHOLE, TILE = 1 << 16, 32


def lag_sums(df: DataFrame, seq: Seq, value: str, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """(keys, ``_lag``, ``_s``): sums of products of ``value`` with itself at every lag of a key, null where
    no product has both values.  By Fourier transform: the power of the transform, transformed back.

    A key of more than ``whole`` rows is laid out as a matrix of about as many rows as columns and is
    transformed along the columns, turned by the phase of each cell, and transformed along the rows; the
    way back begins on the same rows.  Matrices travel in tiles and a task holds a band of columns or
    rows, so a key of n rows takes three shuffles and n log n steps, and no task more than a band.
    """
    keys = [*seq.keys]
    numbered = number_rows(df.select(*keys, *seq.order, F.col(value).cast("double").alias("_x")), seq, "_at", 0).select(*keys, "_at", "_x")
    size = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("_x").alias("_known"))
    rows = numbered.transform(key_join, size, keys)
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def correlate(x: np.ndarray) -> np.ndarray:
        n = 1 << (2 * len(x) - 1).bit_length()
        return np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[: len(x)]

    def at_once(cols: dict[str, list]) -> list[list]:
        x = np.array([0.0 if v is None else v for v in cols["_x"]])
        sums = correlate(x).tolist()
        if cols["_known"][0] < len(x):
            both = correlate(np.array([v is not None for v in cols["_x"]], dtype=float))
            sums = [s if c >= 0.5 else None for s, c in zip(sums, both.tolist())]
        return [*([cols[k][0]] * len(x) for k in keys), list(range(len(x))), sums]

    short = by_group(rows.where(F.col("_n") <= whole), keys, ["_at"], at_once, f"{kinds}_lag bigint, _s double")
    if size.where(F.col("_n") > whole).isEmpty():
        return short

    # Value i of a key stands in row i div C and column i mod C of R rows and C columns; R C >= 2 n.
    bits = F.ceil(F.log2(2 * F.col("_n")) - 1e-9).cast("int")
    down = F.shiftright(bits, 1)
    cells = rows.where(F.col("_n") > whole).withColumns({"_bits": bits, "_down": down})
    plain = cells.withColumns({"_kind": F.lit(0), "_v": F.coalesce("_x", F.lit(0.0))})
    gaps = cells.where("_known < _n").withColumns({"_kind": F.lit(1), "_v": F.col("_x").isNotNull().cast("double")})
    across = F.expr("shiftleft(1L, _bits - _down)")
    laid = plain.unionByName(gaps).withColumns({"_row": F.floor(F.col("_at") / across).cast("long"), "_col": F.pmod(F.col("_at"), across)})
    laid = laid.withColumn("_band", F.floor(F.col("_col") / tile).cast("long"))
    group = [*keys, "_kind", "_band"]
    shape = f"{kinds}_kind int, _n bigint, _bits int, _down int"
    tiles = f"{shape}, _band bigint, _from bigint, _cell binary"

    def sides(cols):
        down = 1 << cols["_down"][0]
        return down, (1 << cols["_bits"][0]) // down, cols["_band"][0] * tile

    def turned(spectrum: np.ndarray, own: int, width: int, total: int) -> np.ndarray:
        """Cells of (frequency, column from ``own`` on) by the phase of their product."""
        phase = np.outer(np.arange(len(spectrum)), own + np.arange(width)) % total
        return spectrum * np.exp(-2j * np.pi * phase / total)

    def told(cols, matrix: np.ndarray) -> list[list]:
        """Tiles of a band's matrix (other side, band), by the band of the other side they belong to."""
        cuts = [matrix[k : k + tile] for k in range(0, len(matrix), tile)]
        head = [[cols[c][0]] * len(cuts) for c in (*keys, "_kind", "_n", "_bits", "_down")]
        return [*head, list(range(len(cuts))), [cols["_band"][0]] * len(cuts), [np.ascontiguousarray(c).tobytes() for c in cuts]]

    def assembled(cols, height: int) -> np.ndarray:
        """The tiles of a band, side by side in the order of their origin."""
        parts = [np.frombuffer(c, dtype=np.complex128).reshape(height, -1) for c in cols["_cell"]]
        return np.concatenate(parts, axis=1)

    def columns(cols):
        r, c, first = sides(cols)
        width = min(tile, c - first)
        x = np.zeros((r, width))
        x[np.array(cols["_row"]), np.array(cols["_col"]) - first] = cols["_v"]
        return told(cols, turned(np.fft.fft(x, axis=0), first, width, r * c))

    def power(cols):
        r, c, first = sides(cols)
        height = min(tile, r - first)
        freq = np.abs(np.fft.fft(assembled(cols, height), axis=1)) ** 2
        return told(cols, turned(np.fft.fft(freq, axis=1).T, first, height, r * c))

    def back(cols):
        r, c, first = sides(cols)
        width, n = min(tile, c - first), cols["_n"][0]
        sums = np.fft.fft(assembled(cols, width), axis=1).real / (r * c)
        lag = first + np.arange(width)[:, None] + c * np.arange(r)[None, :]
        kept = lag < n
        lag, sums = lag[kept], sums[kept]
        return [*([cols[k][0]] * len(lag) for k in (*keys, "_kind")), lag.tolist(), sums.tolist()]

    first = by_group(laid.select(*group, "_n", "_bits", "_down", "_row", "_col", "_v"), group, [], columns, tiles)
    second = by_group(first, group, ["_from"], power, tiles)
    third = by_group(second, group, ["_from"], back, f"{kinds}_kind int, _lag bigint, _s double")
    both = third.groupBy(*keys, "_lag").agg(F.max(F.when(F.col("_kind") == 0, F.col("_s"))).alias("_s"), F.max(F.when(F.col("_kind") == 1, F.col("_s"))).alias("_c"))
    return short.unionByName(both.select(*keys, "_lag", F.when(F.coalesce("_c", F.lit(1.0)) >= 0.5, F.col("_s")).alias("_s")))


def periodic_motion(df: DataFrame, seq: Seq, value: str, peaks: int = 3, distance: int = 5, block: int = 16384, whole: int = WHOLE) -> DataFrame:
    """per key, whether the autocorrelation of ``value`` over all lags has more than ``peaks`` peaks.

    The sums come from :func:`lag_sums`. A peak is a lag whose sum exceeds both neighbours' by more than
    rounding; of peaks closer than ``distance`` the higher one counts. Each one that counts can hide only
    the few peaks near it, so the highest ones of a key are enough to find ``peaks + 1`` that count.
    """
    keys = [*seq.keys]
    sums = lag_sums(df, seq, value, whole)
    least = sums.groupBy(*keys).agg(F.max(F.when(F.col("_lag") == 0, F.col("_s"))).alias("_energy"), F.max("_lag").alias("_last"))
    last, sums = least, sums.transform(key_join, least, keys)
    over = lambda side: F.col("_s") > F.col(side) + F.greatest(F.lit(1e-9), F.col("_energy") * 1e-13)
    tops = neighbours(sums, Seq(seq.keys, ("_lag",), block), {"_p": "_s"}, {"_n": "_s"}).where(over("_p") & over("_n"))
    highest = newest_n(tops, keys, ["_s", "_lag"], peaks * (1 + 2 * ((distance - 1) // 2)) + 1)
    ranked = highest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_s").alias("v"), F.col("_lag").alias("k"))), asc=False).alias("_top"))
    apart = lambda kept, top: F.when(F.exists(kept, lambda k: F.abs(k - top["k"]) < distance), kept).otherwise(F.concat(kept, F.array(top["k"])))
    found = ranked.select(*keys, (F.size(F.aggregate("_top", F.array().cast("array<bigint>"), apart)) > peaks).alias("_found"))
    return last.transform(key_join, found, keys, "left").select(*keys, F.coalesce("_found", F.lit(False)).alias("periodic"))
