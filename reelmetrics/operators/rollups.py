"""Aggregations (family A).  All are map-side combinable; nothing collects an unbounded group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from .sequence import Seq, key_join, number_rows
from .stats import exact_percentiles
from .timeline import lagged

C, L = F.col, F.lit


def share(cond: Column) -> Column:
    """Fraction of rows for which the condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def state_counts(df: DataFrame, keys: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """Rows per key and state, zero where a state is absent."""
    wide = df.groupBy(*keys).agg(*[count_if(C(state) == s).alias(f"_{i}") for i, s in enumerate(states)])
    pairs = F.array(*[F.struct(F.lit(s).alias("state"), C(f"_{i}").alias("n")) for i, s in enumerate(states)])
    return wide.select(*keys, F.inline(pairs))


def processing_metrics(df: DataFrame, keys: Sequence[str], time_ms: str, ok: Column, vram: str, elapsed_s: Column) -> DataFrame:
    """A2: counts, fastest and slowest successful frame, success percent and frame rate."""
    n = F.count(F.lit(1))
    good = F.when(ok, C(time_ms))
    return df.groupBy(*keys).agg(
        n.alias("processed"),
        count_if(~ok).alias("failed"),
        F.coalesce(F.min(good), F.lit(0.0)).alias("min_time_ms"),
        F.coalesce(F.max(good), F.lit(0.0)).alias("max_time_ms"),
        (F.sum(time_ms) / 1000).alias("total_seconds"),
        F.max(vram).alias("peak_vram"),
        (share(ok) * 100).alias("success_pct"),
        F.when(elapsed_s > 0, n / elapsed_s).otherwise(0.0).alias("fps"),
    )


def trend_label(slope: Column, spread: Column, n: Column, limit: float = 0.02) -> Column:
    """A4: direction of a least-squares slope relative to the value range."""
    rel = slope / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return F.when(n < 2, "stable").when(rel > limit, "improving").when(rel < -limit, "declining").otherwise("stable")


def metric_trends(df: DataFrame, keys: Sequence[str], order: Sequence[str], metrics: Sequence[str], width: float | None) -> DataFrame:
    """A3 + A4: per metric mean, sample deviation and trend over the index of its non-null values."""
    long = df.select(
        *keys, *order, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), C(m).cast("double").alias("v")) for m in metrics]))
    ).where(C("v").isNotNull())
    seq = Seq((*keys, "metric"), tuple(order), width)
    indexed = number_rows(long, seq, "_i")
    out = indexed.groupBy(*keys, "metric").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std_dev"),
        F.regr_slope(C("v"), C("_i")).alias("slope"),
        (F.max("v") - F.min("v")).alias("_r"),
    )
    return out.withColumn("trend", trend_label(C("slope"), C("_r"), C("n"))).drop("_r")


def quality_totals(df: DataFrame, keys: Sequence[str], seconds: str, frames: str) -> DataFrame:
    """A3: job and frame totals and the mean processing time of a quality history."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_jobs"), F.sum(frames).alias("total_frames"), F.avg(seconds).alias("avg_seconds")
    )


def video_averages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: frame metrics to video averages, plus the shares that content rules read."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("brightness", "contrast", "sharpness", "noise", "edge_density", "face_count")],
        share(C("face_count") > 0).alias("face_frame_ratio"),
        share(C("brightness") < 60).alias("low_light_ratio"),
        share(C("edge_density") > 0.5).alias("high_detail_ratio"),
    )


def content_mix(df: DataFrame, keys: Sequence[str], content_class: Column) -> DataFrame:
    """Content percentages; the unassigned rest goes to live action when something was assigned."""
    kinds = ("anime", "live_action", "cgi")
    out = df.withColumn("_k", content_class).groupBy(*keys).agg(
        *[(share(C("_k") == k) * 100).alias(f"{k}_pct") for k in kinds],
        (share(C("edge_density") > 0.7) * 100).alias("text_overlay_pct"),
    )
    total = sum((C(f"{k}_pct") for k in kinds[1:]), C("anime_pct"))
    rest = F.when((total > 0) & (total < 100), 100 - total).otherwise(0.0)
    return out.withColumn("live_action_pct", C("live_action_pct") + rest)


def positive_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, min, max and population deviation over values above zero."""
    aggs = []
    for m in metrics:
        v = F.when(C(m) > 0, C(m))
        aggs += [f(v).alias(f"{n}_{m}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    return df.groupBy(*keys).agg(*aggs)


def metric_profile(df: DataFrame, keys: Sequence[str], means: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Means of many metrics (nulls skipped) and min / max / population deviation of some."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in means],
        *[f(c).alias(f"{n}_{c}") for c in spread for n, f in (("min", F.min), ("max", F.max), ("std", F.stddev_pop))],
    )


# Score bands, lower bound inclusive.
SCORE_BANDS = (("excellent", 90.0), ("good", 70.0), ("fair", 50.0), ("poor", 30.0), ("bad", float("-inf")))


def score_bands(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Zero-filled counts over the five score bands (raw scores, no rounding)."""
    s, upper, aggs = C(score), None, []
    for name, low in SCORE_BANDS:
        cond = (s >= low) if upper is None else (s >= low) & (s < upper)
        aggs.append(count_if(cond).alias(name))
        upper = low
    return df.groupBy(*keys).agg(*aggs)


def issue_counts(df: DataFrame, keys: Sequence[str], issues: str, kinds: Sequence[str]) -> DataFrame:
    """A10: frames per issue, zero-filled over the known issues, without exploding rows."""
    wide = df.groupBy(*keys).agg(*[count_if(F.array_contains(issues, k)).alias(k) for k in kinds])
    pairs = F.array(*[F.struct(F.lit(k).alias("issue"), C(k).alias("n")) for k in kinds])
    return wide.select(*keys, F.inline(pairs))


def issue_recommendations(df: DataFrame, keys: Sequence[str], issues: str, score: str, kinds: Sequence[str]) -> DataFrame:
    """Recommendation codes from the mean score and the share of each issue."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("avg_score"),
        *[count_if(F.array_contains(issues, k)).alias(k) for k in kinds],
    )
    total = sum((C(k) for k in kinds[1:]), C(kinds[0]))
    level = F.when(C("avg_score") >= 80, "light").when(C("avg_score") >= 50, "standard").otherwise("aggressive")
    codes = F.array_compact(
        F.array(
            level,
            F.when(C("blur") > total * 0.1, "sharpen"),
            F.when(C("noise") > total * 0.1, "denoise"),
            F.when(C("blocking") > total * 0.1, "deblock"),
            F.when(C("interlacing") > total * 0.05, "deinterlace"),
            F.when(C("banding") > total * 0.1, "deband"),
            F.when(C("duplicate") > C("n") * 0.1, "check_frame_rate"),
            F.when(C("black_frame") > 0, "review_black_frames"),
        )
    )
    return out.select(*keys, "avg_score", F.array_join(codes, ",").alias("recommendations"))


def bar_geometry(df: DataFrame, keys: tuple[str, ...], width: int, height: int, min_bar: int, variant: str = "letterbox") -> DataFrame:
    """Median bars, variability, content size and confidence.

    ``variant="aspect"`` uses the second confidence rule, 1 - (spread / 20).
    """
    sides = ("top", "bottom", "left", "right")
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), C(s).cast("double").alias("v")) for s in sides])))
    med = exact_percentiles(long, (*keys, "side"), "v", {"m": 0.5})
    med = med.groupBy(*keys).agg(*[F.max(F.when(C("side") == s, C("m"))).cast("int").alias(f"{s}_bar") for s in sides])
    spread = df.groupBy(*keys).agg(F.stddev_pop("top").alias("_st"), F.stddev_pop("bottom").alias("_sb"))
    out = med.transform(key_join, spread, keys)
    out = out.withColumns({f"{s}_bar": F.when(C(f"{s}_bar") < min_bar, 0).otherwise(C(f"{s}_bar")) for s in sides})
    letter, pillar = (C("top_bar") > 0) | (C("bottom_bar") > 0), (C("left_bar") > 0) | (C("right_bar") > 0)
    both = C("_st") + C("_sb")
    if variant == "aspect":
        confidence = F.lit(1.0) - F.least(F.lit(1.0), both / 20)
    else:
        confidence = F.when(
            letter | pillar, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - both / (height / 2)))
        ).otherwise(1.0)
    w, h = F.lit(width) - C("left_bar") - C("right_bar"), F.lit(height) - C("top_bar") - C("bottom_bar")
    return out.select(
        *keys,
        *[f"{s}_bar" for s in sides],
        ((C("_st") > 5) | (C("_sb") > 5)).alias("is_variable"),
        letter.alias("has_letterbox"),
        pillar.alias("has_pillarbox"),
        w.alias("content_width"),
        h.alias("content_height"),
        F.when((w > 0) & (h > 0), w / h).alias("content_ratio"),
        confidence.alias("confidence"),
    )


def noise_profile(df: DataFrame, keys: Sequence[str], channels: Sequence[str], luma: str) -> DataFrame:
    """Mean of the noise channels; confidence falls with the relative spread of luma noise."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in channels], F.stddev_pop(luma).alias("_s"))
    conf = F.when(C(luma) > 0, F.greatest(F.lit(0.0), F.lit(1.0) - C("_s") / C(luma))).otherwise(0.5)
    return out.withColumn("confidence", conf).drop("_s")


def film_colour_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Colour cast, hue class, grain and fading of film samples."""
    out = df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("r_shift", "g_shift", "b_shift", "saturation", "contrast", "grain_intensity", "grain_uniformity")]
    )
    r, g, b, s = (C(c) for c in ("r_shift", "g_shift", "b_shift", "saturation"))
    cast_fade = (r > 0.1) & (g > 0)
    return out.withColumns(
        {
            "dominant_hue": F.when((r > 0.02) & (b < -0.02), "warm").when((b > 0.02) & (r < -0.02), "cool").otherwise("neutral"),
            "grain_detected": C("grain_intensity") > 0.02,
            "fading_pattern": F.when(cast_fade, "cyan-magenta").when(s < 0.3, "overall"),
            "fading_severity": F.when(cast_fade, F.least(F.lit(1.0), (r + g) / 0.4)).when(s < 0.3, 1 - s / 0.5).otherwise(0.0),
        }
    )


def degradation_rollup(hits: DataFrame, frames_per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A15 (per type): mean severity and confidence weighted by occurrence; rare mild types drop out."""
    out = hits.groupBy(*keys, "type").agg(
        F.avg("severity").alias("severity"), F.avg("confidence").alias("_c"), F.count(F.lit(1)).alias("instances")
    )
    out = out.transform(key_join, frames_per_key, keys).withColumn(
        "occurrence_rate", C("instances") / F.greatest(C("analyzed_frames"), F.lit(1))
    )
    return out.where((C("occurrence_rate") > 0.1) | (C("severity") > 0.5)).select(
        *keys, "type", "severity", (C("_c") * C("occurrence_rate")).alias("confidence"), "occurrence_rate", "instances"
    )


def degradation_verdict(types: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A15 (per video): up to five primary issues by severity and the overall verdict.

    A group has at most one row per degradation type.
    """
    primary = F.when((C("severity") > 0.3) & (C("confidence") > 0.5), F.struct((-C("severity")).alias("s"), C("type")))
    worst = F.max("severity")
    return types.groupBy(*keys).agg(
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(primary)), 1, 5), lambda x: x["type"]), ",").alias("primary_issues"),
        worst.alias("max_severity"),
        F.when(worst < 0.3, "good").when(worst < 0.6, "moderate").otherwise("poor").alias("overall_quality"),
    )


def tape_artifact_rollup(df: DataFrame, keys: Sequence[str], flags: Sequence[str], any_flags: Sequence[str]) -> DataFrame:
    """Frequency of each tape artefact, degradation mean and maximum, totals."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        *[share(C(f)).alias(f"{f}_frequency") for f in flags],
        F.avg("degradation").alias("avg_degradation"),
        F.max("degradation").alias("max_degradation"),
        F.sum("dropouts").alias("dropout_total"),
        *[F.bool_or(f).alias(f"{f}_detected") for f in any_flags],
    )


def scene_summary(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scene counts, dominant type (first seen wins ties), cuts, transitions, mean length."""
    per_type = scenes.groupBy(*keys, "scene_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start_frame").alias("first"),
        F.sum("duration_frames").alias("dur"),
        F.max("end_frame").alias("last"),
        count_if(C("transition_in") == "hard_cut").alias("hard"),
        count_if(~C("transition_in").isin("hard_cut", "unknown")).alias("soft"),
    )
    return per_type.groupBy(*keys).agg(
        F.sum("n").alias("total_scenes"),
        F.max_by("scene_type", F.struct(C("n"), -C("first"))).alias("dominant_scene_type"),
        F.sum("hard").alias("hard_cut_count"),
        F.sum("soft").alias("transition_count"),
        (F.sum("dur") / F.sum("n")).alias("avg_scene_length"),
        (F.max("last") + 1).alias("total_frames"),
    )


def intelligence_summary(df: DataFrame, keys: Sequence[str], contents: Sequence[str], motions: Sequence[str]) -> DataFrame:
    """Content and motion distributions, totals, static and action verdicts."""
    n = F.count(F.lit(1))

    def distribution(col: str, values: Sequence[str]) -> list[Column]:
        return [count_if(C(col) == v).alias(f"{col}_{v}") for v in values]

    return df.groupBy(*keys).agg(
        n.alias("frames_analyzed"),
        count_if(C("scene_start")).alias("scene_count"),
        *distribution("content", contents),
        *distribution("motion", motions),
        F.sum("faces").alias("total_faces"),
        F.sum("texts").alias("total_text_regions"),
        F.avg("brightness").alias("average_brightness"),
        (F.sum("faces") > 0).alias("has_faces"),
        (F.sum("texts") > 0).alias("has_text"),
        (count_if(C("motion") == "static") > n * 0.5).alias("is_static_content"),
        (count_if(C("motion").isin("high", "extreme")) > n * 0.3).alias("is_action_content"),
    )


def qa_metrics(df: DataFrame, keys: Sequence[str], psnr: str, ssim: str) -> DataFrame:
    """Overall PSNR / SSIM statistics, sample deviation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(psnr).alias("avg_psnr"),
        F.avg(ssim).alias("avg_ssim"),
        F.min(psnr).alias("min_psnr"),
        F.max(psnr).alias("max_psnr"),
        F.coalesce(F.stddev_samp(psnr), F.lit(0.0)).alias("psnr_std_dev"),
    )


def problem_frames(df: DataFrame, overall: DataFrame, keys: Sequence[str], psnr: str, ssim: str) -> DataFrame:
    """Frames far below their video's mean (``overall`` from :func:`qa_metrics`)."""
    means = overall.select(*keys, "avg_psnr", "avg_ssim")
    bad = (C(psnr) < C("avg_psnr") - 5) | (C(ssim) < C("avg_ssim") - 0.1)
    return df.transform(key_join, means, keys).where(bad).drop("avg_psnr", "avg_ssim")


def qa_issues(overall: DataFrame, problems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A20 (texts): issue codes of a video from its overall metrics and problem count."""
    n_bad = problems.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_problems"))
    out = overall.transform(key_join, n_bad, keys, "left").fillna(0, ["n_problems"])
    codes = F.array_compact(
        F.array(
            F.when(C("avg_psnr") < 30, "low_psnr"),
            F.when(C("psnr_std_dev") > 5, "unstable_psnr"),
            F.when(C("n_problems") > C("n_frames") * 0.1, "many_problem_frames"),
        )
    )
    return out.withColumn("issues", F.array_join(codes, ","))


def quality_gates(df: DataFrame, keys: Sequence[str], limits: Mapping[str, float]) -> DataFrame:
    """One row per gate that has input, with its decision.

    ``df`` holds per key ``avg_psnr, avg_ssim, total_frames, failed, black, blurry, bitrate,
    size_mb``; a null input skips its gate.
    """

    def gate(name: str, decision: Column, value: Column) -> Column:
        return F.when(
            decision.isNotNull(),
            F.struct(F.lit(name).alias("gate"), decision.alias("decision"), value.cast("double").alias("value")),
        )

    def banded(v: Column, low: float, warn: float) -> Column:
        return F.when(v < low, "fail").when(v < warn, "warn").when(v.isNotNull(), "pass")

    def pct(c: str) -> Column:
        return C(c) / C("total_frames") * 100

    def over(v: Column, limit: float, verdict: str) -> Column:
        return F.when(v > limit, verdict)

    failed = over(pct("failed"), limits["failed_pct"], "fail")
    black = over(pct("black"), limits["black_pct"], "warn")
    blurry = over(pct("blurry"), limits["blurry_pct"], "warn")
    clean = failed.isNull() & black.isNull() & blurry.isNull() & C("total_frames").isNotNull()
    kbps = F.floor(C("bitrate") / 1000)
    gb = C("size_mb") / 1024
    gates = F.array_compact(
        F.array(
            gate("psnr", banded(C("avg_psnr"), limits["psnr_min"], limits["psnr_warn"]), C("avg_psnr")),
            gate("ssim", banded(C("avg_ssim"), limits["ssim_min"], limits["ssim_warn"]), C("avg_ssim")),
            gate("failed_frames", failed, pct("failed")),
            gate("black_frames", black, pct("black")),
            gate("blurry_frames", blurry, pct("blurry")),
            gate("frame_quality", F.when(clean, "pass"), F.lit(None)),
            gate("bitrate", F.when((kbps > 0) & (kbps < limits["bitrate_kbps"]), "warn"), kbps),
            gate("file_size", F.when(gb > limits["size_gb"], "warn"), gb),
        )
    )
    return df.select(*keys, F.inline(gates))


# Default gate limits.
GATE_LIMITS = {
    "psnr_min": 28.0,
    "psnr_warn": 32.0,
    "ssim_min": 0.85,
    "ssim_warn": 0.92,
    "failed_pct": 1.0,
    "black_pct": 5.0,
    "blurry_pct": 10.0,
    "bitrate_kbps": 1000.0,
    "size_gb": 50.0,
}


def gate_decision(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst gate decides."""
    rank = F.when(C("decision") == "fail", 2).when(C("decision") == "warn", 1).otherwise(0)
    worst = F.max(rank)
    return gates.groupBy(*keys).agg(
        F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("decision"), F.count(F.lit(1)).alias("gates_run")
    )


def validation_pass(issues: DataFrame, keys: Sequence[str], severity: str = "severity") -> DataFrame:
    """A result passes unless it has an error or critical issue."""
    return issues.groupBy(*keys).agg(
        (~F.coalesce(F.bool_or(C(severity).isin("error", "critical")), F.lit(False))).alias("passed"),
        F.coalesce(F.bool_or(C(severity) == "warning"), F.lit(False)).alias("has_warnings"),
    )


def profile_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration-weighted utilisation, peaks and the bottleneck stage (first wins ties)."""
    total = F.sum("duration_s")
    # Sums of doubles that are equal differ in their last digits by the order of their rows.
    longest = F.max_by("stage", F.struct(F.round("duration_s", 9), -C("stage_pos")))
    return df.groupBy(*keys).agg(
        total.alias("total_seconds"),
        F.sum("frames").alias("total_frames"),
        F.max("peak_memory_mb").alias("peak_memory_mb"),
        F.when(total > 0, F.sum(C("gpu_util") * C("duration_s")) / total).otherwise(0.0).alias("avg_gpu"),
        longest.alias("bottleneck_stage"),
        F.when(total > 0, F.max("duration_s") / total * 100).otherwise(0.0).alias("bottleneck_pct"),
        F.when(total > 0, F.sum("frames") / total).otherwise(0.0).alias("overall_fps"),
    )


def stage_imbalance(df: DataFrame, keys: Sequence[str], duration: str = "duration_s") -> DataFrame:
    """Slowest over fastest stage with time above zero, when there are several stages."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(duration).alias("_a"), F.min(F.when(C(duration) > 0, C(duration))).alias("_b"))
        .select(*keys, F.when((C("_n") > 1) & (C("_a") > 0), C("_a") / C("_b")).alias("imbalance"))
        .withColumn("is_imbalanced", F.coalesce(C("imbalance") > 10, F.lit(False)))
    )


def batch_plan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total time and disk of a batch; ``df`` has per video the estimates (null when analysis failed)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("videos"),
        count_if(C("seconds").isNull()).alias("failures"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.sum("disk_mb"), F.lit(0)).alias("total_disk_mb"),
    )


def counts_with_total(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per value and their total in one pass (the total has null keys)."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def stage_progress(df: DataFrame, stages: str) -> DataFrame:
    """Completed over not-skipped stages of a project row."""
    done = F.size(F.filter(stages, lambda s: s == "completed"))
    total = F.size(F.filter(stages, lambda s: s != "skipped"))
    return df.withColumns(
        {
            "stages_completed": done,
            "stages_total": total,
            "progress_pct": F.when(total > 0, done / total * 100).otherwise(0.0),
        }
    )


def chunk_progress(df: DataFrame, keys: Sequence[str], fps: Column) -> DataFrame:
    """Frames done over all chunks (running ones by their floored share) and time left."""
    n, p = C("frames"), C("progress")
    done = F.sum(F.when(C("status") == "completed", n).when(C("status") == "processing", F.floor(n * p)).otherwise(0))
    left = F.sum(F.when(C("status").isin("pending", "queued", "processing"), n * (1 - p)).otherwise(0.0))
    return df.groupBy(*keys).agg(
        F.when(F.sum(n) > 0, done / F.sum(n)).otherwise(0.0).alias("progress"),
        F.when(F.max(fps) > 0, left / F.max(fps)).alias("eta_seconds"),
    )


def drift_statistics(df: DataFrame, keys: Sequence[str], frame: str, drift: str) -> DataFrame:
    """Mean, maximum and latest drift."""
    return df.groupBy(*keys).agg(
        F.avg(drift).alias("mean_drift"), F.max(drift).alias("max_drift"), F.max_by(drift, frame).alias("recent_drift"), F.count(drift).alias("samples")
    )


def chunk_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll-up of processed chunks."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("frames").alias("frames"),
        F.avg("seconds").alias("avg_time_per_chunk"),
        F.sum("seconds").alias("total_time"),
        F.avg("drift").alias("avg_drift"),
        F.max("drift").alias("max_drift"),
        count_if(C("corrected")).alias("chunks_with_correction"),
    )


def median_array(df: DataFrame, keys: tuple[str, ...], arr: str) -> DataFrame:
    """Element-wise median of arrays, cut to the shortest one."""
    shortest = df.groupBy(*keys).agg(F.min(F.size(arr)).alias("_len"))
    long = df.select(*keys, F.posexplode(arr).alias("_pos", "_v")).withColumn("_v", C("_v").cast("double"))
    med = exact_percentiles(long, (*keys, "_pos"), "_v", {"_m": 0.5})
    med = med.transform(key_join, shortest, keys).where(C("_pos") < C("_len"))
    return med.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias(f"median_{arr}")
    )


def shake_severity(df: DataFrame, seq: Seq, scale: tuple[float, float, float] = (50.0, 10.0, 20.0), rotation_weight: float = 10.0, mean_axes: bool = True) -> DataFrame:
    """A41 (and A60 with scale (100, 5, 30), weight 1, ``mean_axes=False``): shake severity 0-1."""
    cols = {"_px": "dx", "_py": "dy"}
    d = lagged(df, seq, cols).groupBy(*seq.keys).agg(
        F.stddev_pop("dx").alias("sx"),
        F.stddev_pop("dy").alias("sy"),
        F.stddev_pop("rotation").alias("sr"),
        F.coalesce(F.stddev_pop(C("dx") - C("_px")), F.lit(0.0)).alias("hx"),
        F.coalesce(F.stddev_pop(C("dy") - C("_py")), F.lit(0.0)).alias("hy"),
    )
    one = F.lit(1.0)
    move = (C("sx") + C("sy")) / (2 if mean_axes else 1)
    score = (
        F.least(one, move / scale[0]) * 0.4
        + F.least(one, F.degrees("sr") * rotation_weight / scale[1]) * 0.3
        + F.least(one, (C("hx") + C("hy")) / 2 / scale[2]) * 0.3
    )
    return d.select(*seq.keys, F.least(one, F.greatest(F.lit(0.0), score)).alias("severity"))


def sampled_flicker(df: DataFrame, seq: Seq, brightness: str, rate: int = 10, jump: float = 15.0) -> DataFrame:
    """Brightness variance and jumps over every ``rate``-th frame, with a severity."""
    pos = C(seq.first)
    totals = df.groupBy(*seq.keys).agg(F.count(F.lit(1)).alias("total_frames"))
    sampled = df.where(pos % rate == 0).withColumn(seq.first, F.floor(pos / rate))
    d = lagged(sampled, seq, {"_p": brightness}).groupBy(*seq.keys).agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.var_pop(brightness).alias("brightness_variance"),
        count_if(F.abs(C(brightness) - C("_p")) > jump).alias("flicker_count"),
    )
    d = d.transform(key_join, totals, seq.keys).where("total_frames >= 3")
    found = C("flicker_count") > C("total_frames") * 0.01
    part = C("flicker_count") / C("frames_analyzed")
    return d.select(
        *seq.keys,
        "frames_analyzed",
        "brightness_variance",
        "flicker_count",
        found.alias("flickering_detected"),
        F.when(~found, "none").when(part > 0.1, "high").when(part > 0.05, "medium").otherwise("low").alias("severity"),
    )


@F.pandas_udf(T.StructType().add("dominant_index", T.IntegerType()).add("dominant_power", T.DoubleType()))
def _dominant_frequency(series: pd.Series) -> pd.DataFrame:
    rows = []
    for values in series:
        x = np.asarray(values, dtype=float)
        power = np.abs(np.fft.fft(x - x.mean())[: len(x) // 2]) ** 2
        if len(power) > 1:
            top = int(np.argmax(power[1:])) + 1
            rows.append((top, float(power[top] / (power.sum() + 1e-6))))
        else:
            rows.append((0, 0.0))
    return pd.DataFrame(rows, columns=["dominant_index", "dominant_power"])


def spectral_flicker(df: DataFrame, seq: Seq, brightness: str, rate: int = 1, max_samples: int = 200) -> DataFrame:
    """Flicker severity including the dominant spectral power of at most ``max_samples`` samples."""
    pos = C(seq.first)
    head = df.where((pos % rate == 0) & (pos < rate * max_samples))
    series = F.transform(F.sort_array(F.collect_list(F.struct(pos, C(brightness).alias("v")))), lambda x: x["v"])
    out = head.groupBy(*seq.keys).agg(
        series.alias("_v"), F.avg(brightness).alias("_m"), F.stddev_pop(brightness).alias("_s"), F.count(F.lit(1)).alias("samples")
    ).where("samples >= 3")
    steps = F.zip_with(F.slice(C("_v"), 1, F.size("_v") - 1), F.slice(C("_v"), 2, F.size("_v") - 1), lambda a, b: F.abs(b - a))
    mean_diff = F.aggregate(C("_d"), F.lit(0.0), lambda s, x: s + x) / F.size("_d")
    out = out.withColumn("_d", steps).withColumn("_f", _dominant_frequency("_v")).withColumn("mean_diff", mean_diff)
    variance = C("_s") / (C("_m") + 1e-6)
    severity = F.least(F.lit(1.0), variance * 2 + C("mean_diff") / 255 * 3 + C("_f.dominant_power") * 0.5)
    return out.select(
        *seq.keys,
        "samples",
        variance.alias("temporal_variance"),
        C("_f.dominant_index").alias("frequency"),
        "mean_diff",
        F.array_max("_d").alias("max_diff"),
        severity.alias("severity"),
        F.when(severity < 0.1, "light").when(severity < 0.3, "medium").otherwise("aggressive").alias("mode"),
    )


def film_flicker(df: DataFrame, seq: Seq, luma: str) -> DataFrame:
    """Flicker flag and intensity from jumps between neighbouring frames (at least three frames)."""
    jump = F.abs(C(luma) - C("_p"))
    d = lagged(df, seq, {"_p": luma}).groupBy(*seq.keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(jump).alias("_mx"), F.avg(jump).alias("_av")
    )
    enough = C("_n") >= 3
    return d.select(
        *seq.keys,
        (enough & ((C("_mx") > 15) | (C("_av") > 5))).alias("has_flicker"),
        F.when(enough, F.least(F.lit(1.0), C("_av") / 20)).otherwise(0.0).alias("intensity"),
    )


def dedup_summary(mapping: DataFrame, keys: Sequence[str], target_fps: float, min_unique: float = 0.3) -> DataFrame:
    """Unique share and estimated source rate of a dedup mapping (``is_duplicate``)."""
    n, u = F.count(F.lit(1)), count_if(~C("is_duplicate"))
    return mapping.groupBy(*keys).agg(
        n.alias("total_frames"),
        u.alias("unique_frames"),
        (n - u).alias("duplicate_frames"),
        ((n - u) / n).alias("duplication_ratio"),
        F.when(u == 0, F.lit(target_fps)).otherwise(F.lit(target_fps) * u / n).alias("estimated_fps"),
        (u / n < min_unique).alias("low_unique_warning"),
    )


def cache_statistics(df: DataFrame, size: str, ts: Column, now: Column, hits: Column | None = None, misses: Column | None = None) -> DataFrame:
    """Entries, megabytes and the age of the oldest entry of a cache index; with ``hits`` and
    ``misses`` per entry also their totals and the hit ratio (0 without requests)."""
    h, m = (F.coalesce(F.sum(c), F.lit(0)) if c is not None else F.lit(0) for c in (hits, misses))
    return df.agg(
        h.cast("long").alias("hits"),
        m.cast("long").alias("misses"),
        F.when(h + m > 0, h / (h + m)).otherwise(0.0).alias("hit_ratio"),
        F.count(F.lit(1)).alias("entry_count"),
        (F.sum(size) / (1024 * 1024)).alias("total_size_mb"),
        ((F.unix_micros(now) - F.min(F.unix_micros(ts))) / 86400e6).alias("oldest_age_days"),
    )


def _similarity(ref: str, dist: str) -> Column:
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mr, md = F.avg(ref), F.avg(dist)
    num = (2 * mr * md + c1) * (2 * F.covar_pop(ref, dist) + c2)
    den = (mr * mr + md * md + c1) * (F.var_pop(ref) + F.var_pop(dist) + c2)
    return F.when(den != 0, num / den).otherwise(0.0)


def psnr_from_mse(mse: Column, lossless: float = 100.0) -> Column:
    """PSNR in dB; identical input gives ``lossless`` (100, or infinity by choice)."""
    return F.when(mse > 0, 10 * F.log10(F.lit(255.0**2) / mse)).otherwise(F.lit(float(lossless)))


def block_quality(pixels: DataFrame, keys: Sequence[str], ref: str, dist: str, width: int, height: int, block: int = 16) -> DataFrame:
    """SSIM and PSNR per full block of the pixel grid ``x, y``."""
    inside = (C("x") < width - width % block) & (C("y") < height - height % block)
    bx, by = (F.floor(C(c) / block) * block for c in ("x", "y"))
    mse = F.avg((C(ref) - C(dist)) * (C(ref) - C(dist)))
    psnr = psnr_from_mse(mse)
    return pixels.where(inside).groupBy(*keys, bx.alias("block_x"), by.alias("block_y")).agg(
        _similarity(ref, dist).alias("ssim"), psnr.alias("psnr"), F.least(F.lit(1.0), psnr / 50).alias("psnr_normalized")
    )


def frame_quality(pixels: DataFrame, keys: Sequence[str], ref: str, dist: str, lossless: float = 100.0) -> DataFrame:
    """MSE, PSNR and global SSIM per frame from pixel rows."""
    mse = F.avg((C(ref) - C(dist)) * (C(ref) - C(dist)))
    return pixels.groupBy(*keys).agg(mse.alias("mse"), psnr_from_mse(mse, lossless).alias("psnr"), _similarity(ref, dist).alias("ssim"))


def cluster_stats(nodes: DataFrame, keys: Sequence[str], available: Column) -> DataFrame:
    """Node, GPU, memory and speed sums over all and over available nodes."""
    return nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        count_if(available).alias("available_nodes"),
        count_if(~available).alias("busy_nodes"),
        F.sum("gpus").alias("total_gpus"),
        F.coalesce(F.sum(F.when(available, C("gpus"))), F.lit(0)).alias("available_gpus"),
        F.sum("gpu_memory_gb").alias("total_gpu_memory_gb"),
        F.coalesce(F.sum(F.when(available, C("fps"))), F.lit(0.0)).alias("estimated_fps"),
    )


def interlace_rollup(df: DataFrame, keys: Sequence[str], threshold: float = 0.15) -> DataFrame:
    """Combing mean, field order shares, verdict and confidence over samples."""
    out = df.groupBy(*keys).agg(
        (F.avg("combing") * 100).alias("combing_pct"),
        *[(share(C("field") == f) * 100).alias(f"{f}_pct") for f in ("tff", "bff", "progressive")],
    )
    fields = C("tff_pct") + C("bff_pct")
    return out.withColumns(
        {
            "is_interlaced": (fields > 30) | (C("combing_pct") > threshold * 100),
            "field_order": F.when(C("tff_pct") > C("bff_pct") + 10, "tff").when(C("bff_pct") > C("tff_pct") + 10, "bff").otherwise("unknown"),
            "confidence": F.least(F.lit(1.0), F.abs(fields - 50) / 50),
        }
    )


def sampled_share(df: DataFrame, keys: Sequence[str], frame: str, totals: DataFrame, samples: int, hit: Column) -> DataFrame:
    """Share and number of hits among every (total // samples)-th frame."""
    step = F.greatest(F.lit(1), F.floor(C("total_frames") / samples))
    chosen = df.transform(key_join, totals, keys).where(C(frame) % step == 0)
    return chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("sampled"), count_if(hit).alias("hits"), share(hit).alias("hit_ratio"))


def caption_presence(df: DataFrame, keys: Sequence[str], frame: str, totals: DataFrame, hit: Column, samples: int = 50, threshold: float = 0.3) -> DataFrame:
    """Captions are present when enough of the first ``samples`` sampled frames show boxes."""
    step = F.greatest(F.lit(1), F.floor(C("total_frames") / samples))
    chosen = df.transform(key_join, totals, keys).where((C(frame) % step == 0) & (C(frame) / step < samples))
    return chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("sampled"), share(hit).alias("detection_ratio")).withColumn(
        "has_captions", C("detection_ratio") >= threshold
    )


def sampled_comparison(df: DataFrame, keys: Sequence[str], frame: str, totals: DataFrame, k: int, metrics: Sequence[str], original: Column, enhanced: Column) -> DataFrame:
    """Metric means over ``k`` evenly spaced positions and the size change in percent."""
    step = F.floor(C("total_frames") / k)
    chosen = df.transform(key_join, totals, keys).where(
        F.when(step == 0, C(frame) == 0).otherwise((C(frame) % F.greatest(step, F.lit(1)) == 0) & (C(frame) / step < k))
    )
    o, e = F.max(original), F.max(enhanced)
    return chosen.groupBy(*keys).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in metrics], F.when(o > 0, (e - o) / o * 100).otherwise(0.0).alias("size_change_pct")
    )


def luminance_statistics(pixels: DataFrame, keys: tuple[str, ...], luma: str) -> DataFrame:
    """Luminance of a frame in nits, dynamic range in stops, clipped shares (8-bit input, 0-1)."""
    nits = F.pow(F.greatest(F.lit(0.001), F.least(F.lit(1.0), C(luma))), F.lit(2.2)) * 100.0
    lit = pixels.select(*keys, C(luma).alias("_l"), nits.alias("_nits"))
    peak = exact_percentiles(lit, keys, "_nits", {"peak_nits": 0.99})
    out = lit.groupBy(*keys).agg(
        F.min("_nits").alias("min_nits"),
        F.max("_nits").alias("max_nits"),
        F.avg("_nits").alias("avg_nits"),
        (share(C("_l") > 250 / 255.0) * 100).alias("clipped_highlights_pct"),
        (share(C("_l") < 5 / 255.0) * 100).alias("clipped_shadows_pct"),
    )
    stops = F.log2(C("max_nits") / F.when(C("min_nits") > 0.001, C("min_nits")).otherwise(0.001))
    return out.transform(key_join, peak, keys).withColumn("stops", stops)


def grain_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grain means over sampled frames with defaults for missing values, a confidence, whether grain
    depends on contrast, and the film stock whose grain is nearest."""
    # Defaults of a missing measurement.
    defaults = {"grain_size": 0.5, "grain_intensity": 0.3, "luminance_grain": 0.3, "chroma_grain": 0.15, "grain_uniformity": 0.8}
    n, filled = F.count(F.lit(1)), F.coalesce(C("grain_intensity"), F.lit(0.3))
    spread = F.stddev_pop(filled) / F.avg(filled)
    dependent = F.avg(F.coalesce(C("contrast_dependent"), F.lit(0.5))) > 0.4 if "contrast_dependent" in df.columns else F.lit(True)
    out = df.groupBy(*keys).agg(
        *[F.avg(F.coalesce(C(c), F.lit(d))).alias(c) for c, d in defaults.items()],
        F.coalesce(F.avg("temporal_var"), F.lit(0.15)).alias("temporal_var"),
        F.when((n < 3) | (F.avg(filled) <= 0), 0.5).otherwise(1.0 / (1.0 + spread * 2)).alias("confidence"),
        dependent.alias("contrast_dependent"),
    )
    return out.withColumn("film_stock", grain_stock())


def grain_stock() -> Column:
    """Best of the known stocks by weighted closeness; the first one wins ties, none scoring above 0 is unknown."""
    near = lambda name, value: 1.0 - F.abs(C(name) - value)
    luma = C("luminance_grain") / (C("luminance_grain") + C("chroma_grain") + 1e-6)
    rows = []
    for i, (stock, (size, intensity, ratio, uniformity, temporal)) in enumerate(dims.GRAIN_STOCKS.items()):
        score = near("grain_size", size) * 0.3 + near("grain_intensity", intensity) * 0.25 + near("grain_uniformity", uniformity) * 0.2 + near("temporal_var", temporal) * 0.15
        score = score + F.when(C("luminance_grain") > 0, (1.0 - F.abs(luma - ratio)) * 0.1).otherwise(0.0)
        rows.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(stock).alias("stock")))
    return dims.let(F.array_max(F.array(*rows)), lambda best: F.when(best["score"] > 0, best["stock"]).otherwise("unknown"))


def audio_levels(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Noise floor, dynamic range with its fallback, and silence totals."""
    floor = F.least(F.min("rms_db"), F.lit(0.0))
    peak = F.max("max_db")
    given = F.coalesce(F.max("range_db"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        floor.alias("noise_floor_db"),
        peak.alias("max_volume_db"),
        F.when(given == 0.0, peak - floor).otherwise(given).alias("dynamic_range_db"),
        count_if(C("silence_s") > 0).alias("silence_segments"),
    )


def operation_report(df: DataFrame, keys: Sequence[str], planned: Column, ok: Column) -> DataFrame:
    """Successes and failures, success share of the planned operations."""
    good, total = count_if(ok), F.max(planned)
    return df.groupBy(*keys).agg(
        total.alias("total_operations"),
        good.alias("successful"),
        count_if(~ok).alias("failed"),
        F.when(total > 0, good / total).otherwise(0.0).alias("success_rate"),
    )


def metric_log(df: DataFrame, keys: Sequence[str], metric: str, value: str) -> DataFrame:
    """Average, minimum and maximum per named metric."""
    return df.groupBy(*keys, metric).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def error_summary(df: DataFrame, error_type: str) -> DataFrame:
    """Number of errors by type."""
    return df.groupBy(error_type).agg(F.count(F.lit(1)).alias("n"))


def recovery_counters(df: DataFrame, keys: Sequence[str], action: str) -> DataFrame:
    """Errors and how they ended (succeeded, skipped, aborted) per run."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_errors"),
        *[count_if(C(action) == a).alias(n) for a, n in (("succeeded", "recovered"), ("skipped", "skipped"), ("aborted", "aborted"))],
    )


def combed_percentage(df: DataFrame, keys: Sequence[str], combed: Column) -> DataFrame:
    """Share of combed frames among sampled frames, in percent."""
    return df.groupBy(*keys).agg((share(combed) * 100).alias("combed_pct"))


def errors_with_totals(df: DataFrame, error_type: str) -> DataFrame:
    """The error rows kept, each with the total of its type."""
    return df.transform(key_join, df.groupBy(error_type).agg(F.count(F.lit(1)).alias("type_total")), [error_type])


def stage_eta(df: DataFrame, keys: Sequence[str], planned: Column) -> DataFrame:
    """Stage totals and the overall time left from the mean speed of finished stages."""
    frames, secs, n = F.sum("frames"), F.sum("seconds"), F.count(F.lit(1))
    left = F.max(planned) - n
    return df.groupBy(*keys).agg(
        n.alias("completed_stages"),
        frames.alias("total_frames"),
        secs.alias("total_seconds"),
        (frames / F.greatest(F.lit(1.0), secs)).alias("average_fps"),
        F.when(secs == 0, F.lit(None).cast("double"))
        .when(left <= 0, 0.0)
        .when(frames > 0, frames / n * left / (frames / secs))
        .alias("eta_seconds"),
    )


def light_levels(frames: DataFrame, keys: Sequence[str], is_hdr: Column) -> DataFrame:
    """Content and frame-average light levels from per-frame luminance (0-1)."""
    peak, fall = F.max("max_luma"), F.max("avg_luma")
    return frames.groupBy(*keys).agg(
        peak.alias("peak_luminance"),
        F.avg("avg_luma").alias("avg_luminance"),
        F.floor(peak * F.when(F.bool_or(is_hdr), 10000).otherwise(1000)).alias("max_cll"),
        F.floor(fall * F.when(F.bool_or(is_hdr), 10000).otherwise(400)).alias("max_fall"),
        F.log2(F.greatest(peak, F.lit(0.001)) / F.greatest(F.min("min_luma"), F.lit(0.0001))).alias("stops"),
    )


def pooled_scores(df: DataFrame, keys: tuple[str, ...], score: str) -> DataFrame:
    """Mean, min, max, deviation, harmonic mean and percentiles of frame scores."""
    ps = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    out = df.groupBy(*keys).agg(
        F.avg(score).alias("mean"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.stddev_pop(score).alias("std"),
        F.when(F.min(score) == 0, 0.0).otherwise(F.count(score) / F.sum(1 / F.nullif(C(score), L(0.0)))).alias("harmonic_mean"),
    )
    return out.transform(key_join, exact_percentiles(df, keys, score, ps), keys)
