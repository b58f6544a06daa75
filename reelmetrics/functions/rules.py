"""Classification rules and scores (family F) as pure ``Column`` functions.

In every ladder the first match wins.  Everything stays inside whole-stage code generation and
is applied with one ``select``; there is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

C, L = F.col, F.lit
ZERO, ONE = 0.0, 1.0


def ladder(*cases: tuple[Column, object], default=None) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(L(float(low)), F.least(L(float(high)), col))


def below(value: Column, *limits: tuple[float, str], default: str) -> Column:
    """Label of the first upper limit (exclusive) above the value."""
    return ladder(*[(value < lim, name) for lim, name in limits], default=default)


def present(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


# --- filters ----------------------------------------------------------------------------------
def event_filter(types=None, source=None, min_priority=None, data_key=None, data_value=None) -> Column:
    """conjunction of the given event conditions; combine further with ``& | ~``."""
    cond = L(True)
    if types is not None:
        cond = cond & C("event_type").isin(*types)
    if source is not None:
        cond = cond & (C("source") == source)
    if min_priority is not None:
        cond = cond & (C("priority") >= min_priority)
    if data_key is not None:
        held = F.element_at("data", data_key)
        cond = cond & (F.map_contains_key("data", data_key) if data_value is None else F.coalesce(held == data_value, L(False)))
    return cond


def job_filter(statuses=None, priorities=None, tags=None, created_after=None, created_before=None, input_contains=None) -> Column:
    """job listing filter; every given tag must be present, date bounds are inclusive."""
    cond = L(True)
    if statuses:
        cond = cond & C("state").isin(*statuses)
    if priorities:
        cond = cond & C("priority").isin(*priorities)
    if tags:
        cond = cond & (F.size(F.array_except(F.array(*[L(x) for x in tags]), C("tags"))) == 0)
    if created_after is not None:
        cond = cond & (C("created_at") >= created_after)
    if created_before is not None:
        cond = cond & (C("created_at") <= created_before)
    if input_contains:
        cond = cond & C("input").contains(input_contains)
    return cond


def resumable(state: Column, states: Sequence[str]) -> Column:
    """jobs that can be resumed."""
    return state.isin(*states)


def retryable(state: Column, retries: Column, max_retries: int, failed: str = "failed") -> Column:
    """failed frames with retries left."""
    return (state == failed) & (retries < max_retries)


def meets_threshold(psnr: Column, ssim: Column, vmaf: Column, min_psnr=25.0, min_ssim=0.85, min_vmaf=70.0) -> Column:
    """no known metric is below its minimum; missing metrics do not count."""
    ok = lambda v, low: F.coalesce(v >= low, L(True))
    return ok(psnr, min_psnr) & ok(ssim, min_ssim) & ok(vmaf, min_vmaf)


def is_problem(score: Column, issues: Column, limit: float = 60.0) -> Column:
    """low score or any issue."""
    return (score < limit) | (F.size(issues) > 0)


def skip_frame(quality: Column, limit: float = 0.85) -> Column:
    """the frame is good enough to be left alone."""
    return quality >= limit


# --- frame and video quality -------------------------------------------------------------------
def exposure_score(brightness: Column, clipped_dark: Column, clipped_bright: Column) -> Column:
    """exposure score 0-100."""
    base = (L(1.0) - F.abs(brightness - 128) / 128) * 100
    dulled = F.when((clipped_dark > 0.05) | (clipped_bright > 0.05), base * 0.8).otherwise(base)
    return F.when(brightness < 5, ZERO).otherwise(F.greatest(L(ZERO), dulled))


def frame_score(sharp: Column, noise: Column, exposure: Column, blocking: Column, banding: Column, interlace: Column) -> Column:
    """F8: weighted frame score 0-100."""
    artefact = (blocking + banding + interlace) / 3
    return sharp * 0.3 + noise * 0.25 + exposure * 0.25 + artefact * 0.2


def frame_issues(blur_var: Column, noise: Column, brightness: Column, blocking: Column, banding: Column, interlacing: Column, duplicate: Column) -> Column:
    """F8: issue list from thresholds and detector flags, in fixed order."""
    black = brightness < 5
    return present(
        F.when(blur_var < 100, "blur"),
        F.when(noise > 15, "noise"),
        F.when(~black & (brightness > 250), "overexposed"),
        F.when(black | (brightness < 20), "underexposed"),
        F.when(black, "black_frame"),
        F.when(blocking, "blocking"),
        F.when(banding, "banding"),
        F.when(interlacing, "interlacing"),
        F.when(duplicate, "duplicate"),
    )


def overall_quality(ssim, psnr, vmaf, sharpness, blocking, temporal, color) -> Column:
    """weighted score 0-1; PSNR counts between 30 and 50 dB."""
    return (
        ssim * 0.25
        + clamp((psnr - 30) / 20, 0, 1) * 0.15
        + vmaf / 100 * 0.20
        + F.least(L(1.0), sharpness) * 0.10
        + (L(1.0) - F.least(L(1.0), blocking)) * 0.10
        + temporal * 0.10
        + color * 0.10
    )


def weighted_quality(values: dict[str, Column], weights: dict[str, float], face: Column) -> Column:
    """weighted score 0-100; without faces the face weight goes to the other metrics."""
    base = sum((values[k] * w for k, w in weights.items() if k != "face_quality"), L(0.0))
    wf = weights.get("face_quality", 0.0)
    rest = sum(w for k, w in weights.items() if k != "face_quality")
    scaled = base * (1 + wf / rest) if rest > 0 else base
    return clamp(F.when(face.isNotNull(), base + face * wf).otherwise(scaled), 0, 100)


def letter_grade(score: Column) -> Column:
    """eleven letter grades."""
    return dims.bands_from(score, dims.LETTER_GRADES, "F")


def qa_score(psnr: Column, ssim: Column, psnr_std: Column, problem_ratio: Column) -> Column:
    """mean of the PSNR, SSIM, stability and problem sub-scores."""
    steady = ladder((psnr_std < 2, 100), (psnr_std < 4, 80), (psnr_std < 6, 60), default=40)
    parts = [dims.bands_from(psnr, dims.QA_PSNR, 30), dims.bands_from(ssim, dims.QA_SSIM, 40), steady, (L(1.0) - problem_ratio) * 100]
    return sum((p.cast("double") for p in parts), L(0.0)) / 4


def qa_grade(score: Column) -> Column:
    """six grades."""
    return dims.bands_from(score, dims.QA_GRADES, "poor")


def vmaf_grade(vmaf: Column) -> Column:
    """six VMAF grades."""
    return dims.bands_from(vmaf, dims.VMAF_GRADES, "Bad")


# --- scenes and content ------------------------------------------------------------------------
def scene_type(quality: Column, motion: Column, face_ratio: Column, has_faces: Column) -> Column:
    """scene class from quality, faces and motion."""
    return ladder(
        (quality < 0.3, "low_quality"),
        (has_faces & (face_ratio > 0.6), "dialog"),
        (motion > 0.5, "action"),
        (motion < 0.15, "static"),
        default="unknown",
    )


def scene_parameters(kind: Column, brightness: Column, quality: Column, complexity: Column) -> Column:
    """enhancement parameters of a scene as a struct."""
    names = ("denoise", "sharpness", "deblur", "face_restore")
    table = [dims.lookup(kind, {k: v[i] for k, v in dims.SCENE_PARAMETERS.items() if v[i] is not None}) for i in range(4)]
    shift = ladder((brightness < 60, F.least(L(40.0), L(80.0) - brightness)), (brightness > 220, F.greatest(L(-40.0), L(200.0) - brightness)), default=ZERO)
    return F.struct(
        *[c.alias(n) for c, n in zip(table, names)],
        shift.alias("brightness_adjust"),
        (quality > 0.8).alias("skip_processing"),
        (quality < 0.4).alias("use_best_model"),
        F.when(complexity > 0.7, 256).alias("tile_size"),
    )


def motion_level(diff: Column) -> Column:
    """F16: motion level from the mean absolute frame difference."""
    return below(diff, (2, "static"), (8, "minimal"), (20, "moderate"), (40, "high"), default="extreme")


def lighting(brightness: Column, dark: Column, bright: Column) -> Column:
    """F16: lighting class from mean brightness and the dark / bright pixel shares."""
    return ladder(
        (brightness > 180, "bright"),
        (brightness < 60, "low_light"),
        ((dark > 0.3) & (bright > 0.2), "high_contrast"),
        ((bright > 0.4) & (dark > 0.2), "backlit"),
        default="normal",
    )


def _area(boxes: Column) -> Column:
    return F.aggregate(boxes, L(0.0), lambda s, b: s + b["w"] * b["h"])


def content_class(faces: Column, texts: Column, frame_area: Column, motion: Column, light: Column, brightness: Column) -> Column:
    """content class from face and text boxes (arrays of structs w, h), motion and light."""
    face_share = F.when(frame_area > 0, _area(faces) / frame_area).otherwise(0.0)
    lone = (F.size(faces) == 1) & (face_share > 0.1)
    return ladder(
        (lone & (face_share > 0.25), "face_closeup"),
        (lone, "face_medium"),
        (F.size(faces) > 2, "group_shot"),
        ((F.size(texts) > 0) & (_area(texts) > frame_area * 0.15), "text_title"),
        (motion == "extreme", "action"),
        (motion == "static", "static"),
        (light.isin("bright", "normal") & (brightness > 0.6), "landscape"),
        default="documentary",
    )


def adaptive_settings(content: Column, motion: Column, light: Column, blur: Column, noise: Column, sharpening=0.3, noise_reduction=0.3) -> Column:
    """sharpening, noise reduction and temporal smoothing per content class."""
    sharp = ladder(
        (content == "face_closeup", min(sharpening, 0.25)),
        (content == "text_title", 0.4),
        (content == "landscape", min(sharpening * 1.2, 0.5)),
        (content == "action", 0.35),
        default=sharpening,
    )
    nr = ladder((content == "face_closeup", min(noise_reduction, 0.4)), (content == "text_title", 0.2), default=noise_reduction)
    dim = light == "low_light"
    sharp = sharp * F.when(dim, 0.8).otherwise(1.0) * F.when(blur > 0.5, 1.2).otherwise(1.0)
    nr = nr * F.when(motion == "static", 1.2).otherwise(1.0) * F.when(dim, 1.3).otherwise(1.0) * F.when(noise > 0.5, 1.2).otherwise(1.0)
    smoothing = ladder((motion == "static", 0.8), (motion == "extreme", 0.2), (content == "action", 0.3))
    return F.struct(sharp.alias("sharpening"), nr.alias("noise_reduction"), smoothing.alias("temporal_smoothing"))


def noise_type(c: dict[str, Column]) -> Column:
    """dominant noise type from the averaged channels (eight ordered rules)."""
    return ladder(
        (c["luma"] * 0.6 + c["chroma"] * 0.4 < 5, "minimal"),
        ((c["grain_intensity"] > 20) & (c["grain_uniformity"] > 60), "film_grain"),
        ((c["flat"] > c["edge"] * 1.5) & (c["low"] > 40), "compression"),
        (c["high"] > c["mid"] * 1.5, "salt_pepper"),
        (c["chroma"] > c["luma"] * 1.5, "chroma"),
        (c["temporal"] > c["luma"], "temporal"),
        (c["mid"] > 30, "gaussian"),
        default="mixed",
    )


def primary_content() -> Column:
    """content class of a video from :func:`rollups.video_averages`."""
    faces = C("face_frame_ratio") > 0.5
    return ladder(
        (faces & (C("avg_face_count") > 2), "face_group"),
        (faces, "face_portrait"),
        (C("avg_brightness") < 60, "low_light"),
        (C("avg_contrast") > 180, "high_contrast"),
        (C("avg_edge_density") > 0.6, "architecture"),
        (C("avg_edge_density") < 0.15, "animation"),
        default="landscape",
    )


def degradations(noise: Column, sharpness: Column, width: Column) -> Column:
    """degradation list of a video."""
    return present(
        ladder((noise > 0.6, "heavy_noise"), (noise > 0.4, "film_grain"), (noise > 0.2, "light_noise")),
        F.when(sharpness < 30, "blur"),
        F.when((width > 0) & (width < 720) & (noise < 0.3), "compression_artifacts"),
    )


def degradation_severity(found: Column) -> Column:
    """four severities from the degradation list."""
    n = F.size(found)
    return ladder(
        (F.array_contains(found, "heavy_noise") | (n >= 3), "heavy"),
        (F.array_contains(found, "film_grain") | (n >= 2), "moderate"),
        (n > 0, "light"),
        default="minimal",
    )


def restoration_plan(width: Column, content: Column, found: Column, severity: Column, face_ratio: Column, fps: Column) -> Column:
    """scale, model, denoise, target rate and face / scratch flags."""
    has = lambda d: F.array_contains(found, d)
    portrait = content.isin("face_portrait", "face_group")
    return F.struct(
        F.when((width < 720) | severity.isin("heavy", "moderate"), 4).otherwise(2).alias("scale"),
        F.when(content == "animation", "realesrgan-x4plus-anime").otherwise("realesrgan-x4plus").alias("model"),
        ladder((has("heavy_noise"), 0.8), (has("film_grain"), 0.5), (has("light_noise"), 0.3), default=0.0).alias("denoise"),
        F.when(fps > 0, ladder((fps <= 24, 48.0), (fps <= 30, 60.0))).alias("target_fps"),
        (portrait | (face_ratio > 0.3)).alias("face_restoration"),
        (severity == "heavy").alias("scratch_removal"),
    )


def content_mix_class() -> Column:
    """anime / live action / CGI class of a frame, null when no rule fits."""
    edge, bright = C("edge_density"), C("brightness")
    return ladder(
        ((edge < 0.2) & (C("contrast") > 150), "anime"),
        ((edge > 0.25) & (bright > 80) & (bright < 200), "live_action"),
        ((edge < 0.15) & (C("sharpness") > 60), "cgi"),
    )


def model_segment(anime: Column, live: Column, cgi: Column) -> Column:
    """one model for the whole video, by the 80% rule or the dominant content (first wins ties)."""
    top = F.greatest(anime, live, cgi)
    clear = ladder((anime > 80, "anime"), (live > 80, "live_action"), (cgi > 80, "cgi"))
    leading = ladder((anime == top, "anime"), (live == top, "live_action"), default="cgi")
    kind = F.coalesce(clear, leading)
    share = ladder((kind == "anime", anime), (kind == "live_action", live), default=cgi)
    return F.struct(
        kind.alias("content_type"),
        F.when(kind == "anime", "realesrgan-x4plus-anime").otherwise("realesrgan-x4plus").alias("model"),
        (F.when(clear.isNotNull(), share).otherwise(top) / 100).alias("confidence"),
    )


def source_warnings(width, height, bitrate_kbps, has_audio, interlaced, vfr, corrupt) -> Column:
    """warnings of a source as an array of (type, severity)."""
    pixels = F.when((width > 0) & (height > 0), width * height).otherwise(1920 * 1080)
    bpp = bitrate_kbps * 1000 / (pixels * 24)

    def warn(cond: Column, kind: str, severity) -> Column:
        sev = severity if isinstance(severity, Column) else L(severity)
        return F.when(cond, F.struct(L(kind).alias("type"), sev.alias("severity")))

    return present(
        warn((height > 0) & (height < 240), "very_low_resolution", "warning"),
        warn((height >= 240) & (height < 360), "low_resolution", "info"),
        warn((bitrate_kbps > 0) & (bpp < 0.05), "heavy_compression", "warning"),
        warn(interlaced, "interlaced", "warning"),
        warn(vfr, "variable_framerate", "warning"),
        warn(~has_audio, "no_audio", "info"),
        warn(corrupt > 0, "corrupt_frames", F.when(corrupt > 10, "error").otherwise("warning")),
    )


def hardware_plan(width, height, frames, scale, model, has_gpu, vram_total, vram_free) -> Column:
    """tile size, batch size, memory and time for a video on given hardware (MB)."""
    scale = F.when(~has_gpu & (scale == 4), 2).otherwise(scale)
    out_px = width * scale * height * scale
    tile = ladder(
        (~has_gpu, 0), (vram_free < 2000, 256), (vram_free < 4000, 384), ((vram_free < 8000) & (out_px / 1e6 > 2.0), 512), default=0
    )
    tile_px = tile * scale * tile * scale
    model_factor = dims.lookup(model, {"realesrgan-x2plus": 0.8, "realesrgan-x4plus": 1.0, "realesrgan-x4plus-anime": 0.9, "realesr-animevideov3": 0.85}, 1.0)
    gpu_factor = ladder((~has_gpu, 10.0), (vram_total >= 12000, 0.5), (vram_total >= 8000, 0.75), (vram_total >= 4000, 1.0), default=2.0)
    per_frame = F.greatest(L(0.5), width * height / (1920 * 1080)) * F.when(scale == 2, 1.0).otherwise(2.5) * model_factor * gpu_factor * 50.0
    return F.struct(
        scale.alias("scale"),
        tile.alias("tile_size"),
        ladder((~has_gpu, 1), (vram_total >= 12000, 4), (vram_total >= 8000, 2), default=1).alias("batch_size"),
        F.floor(F.when(tile > 0, tile_px).otherwise(out_px) * 400 / (1024 * 1024)).alias("vram_mb"),
        (per_frame * frames / 1000.0 * 1.1).alias("seconds"),
    )


# --- formats -----------------------------------------------------------------------------------
def interlace_verdict(total, tff, bff, prog, telecine: Column, combing_pct: Column) -> Column:
    """interlace type from field counts (null ``total``: no field data), telecine and combing."""
    t, b, p = (c / F.nullif(total, L(0)) for c in (tff, bff, prog))
    by_fields = F.when(total > 0, ladder((p > 0.8, "progressive"), (t > 0.4, "interlaced_tff"), (b > 0.4, "interlaced_bff"), default="mixed"))
    kind = ladder((telecine.isNotNull(), "telecine"), (by_fields.isNotNull(), by_fields), (combing_pct > 20, "unknown"), default="progressive")
    conf = ladder(
        (by_fields == "progressive", p), (by_fields == "interlaced_tff", t), (by_fields == "interlaced_bff", b), (by_fields == "mixed", L(1.0) - p),
        (telecine.isNull() & (combing_pct > 20), F.least(combing_pct / 100, L(0.9))), default=ZERO,
    )
    on = kind != "progressive"
    method = F.when(on, ladder((kind == "telecine", "yadif"), (combing_pct > 50, "bwdif"), default="yadif"))
    return F.struct(kind.alias("interlace_type"), on.alias("is_interlaced"), conf.alias("confidence"), method.alias("method"))


def pulldown(fps: Column) -> Column:
    """pulldown pattern and confidence by frame rate."""
    verdict = lambda p, c: F.struct(L(p).alias("pattern"), L(c).alias("confidence"))
    return ladder(
        (fps.between(29.0, 30.0), verdict("3:2", 0.8)),
        (fps.between(23.5, 24.5), verdict("unknown", 0.5)),
        ((fps > 24.5) & (fps <= 26.0), verdict("2:2", 0.7)),
        (fps.between(59.0, 60.0), verdict("3:2", 0.7)),
        default=verdict("unknown", 0.4),
    )


def source_fps(fps: Column, pattern: Column) -> Column:
    """rate before pulldown."""
    return ladder(
        (pattern.isin("3:2", "2:3"), fps * 0.8),
        ((pattern == "2:2") & (fps > 40), fps / 2),
        (pattern == "2:2", 24.0),
        (pattern == "mixed", 23.976),
        (fps.between(29.0, 30.0), 23.976),
        (fps.between(24.5, 26.0), 24.0),
        default=fps,
    )


def upscale_verdict(edge: Column, ringing: Column, blocking: Column, cutoff: Column) -> Column:
    """was the video upscaled: indicator sum, mean confidence, factor and method."""
    soft, ai, ring, block, band = edge < 30, (edge > 80) & (ringing < 20), ringing > 40, blocking > 30, cutoff < 0.7
    points = sum((F.when(c, n).otherwise(0) for c, n in ((soft, 2), (ai, 1), (ring, 1), (block, 2), (band, 2))), L(0))
    votes = present(F.when(soft, 0.7), F.when(ai, 0.5), F.when(ring, 0.6), F.when(block, 0.8), F.when(band, L(0.9) - cutoff))
    mean = F.aggregate(votes, L(0.0), lambda a, x: a + x) / F.size(votes)
    is_up = points >= 2
    factor = F.when(band, F.least(L(8.0), F.when(cutoff > 0, L(1.0) / cutoff).otherwise(2.0))).otherwise(1.0)
    method = ladder((block, "nearest"), (soft, "bilinear"), (ai, "ai_upscale"), (ring, "lanczos"), default="none")
    return F.struct(
        is_up.alias("is_upscaled"),
        F.when(is_up, F.least(L(1.0), mean)).otherwise(0.8).alias("confidence"),
        F.when(is_up & (factor > 1.1), factor).otherwise(1.0).alias("factor"),
        F.when(is_up, method).otherwise("none").alias("method"),
    )


def snap_resolution(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """nearest common resolution smaller than the container with a similar shape; else unchanged."""
    table = F.array(*[F.struct(L(w).alias("w"), L(h).alias("h")) for w, h in dims.COMMON_RESOLUTIONS])
    fits = F.filter(table, lambda r: (r["w"] * r["h"] < box_width * box_height) & (F.abs(r["w"] / r["h"] - box_width / box_height) <= 0.1))
    ranked = F.transform(fits, lambda r, i: F.struct(F.abs(r["w"] * r["h"] - width * height).alias("d"), i.alias("i"), r["w"].alias("w"), r["h"].alias("h")))
    best = F.array_min(ranked)
    return F.struct(F.coalesce(best["w"], width).alias("width"), F.coalesce(best["h"], height).alias("height"))


def closest_aspect(ratio: Column, tolerance: float = 0.05) -> Column:
    """closest standard aspect name within the relative tolerance, else null (first wins ties)."""
    table = F.array(*[F.struct(L(n).alias("n"), L(a / b).alias("r"), L(i).alias("i")) for i, (n, a, b) in enumerate(dims.ASPECT_RATIOS)])
    near = F.filter(table, lambda a: F.abs(a["r"] - ratio) / ratio < tolerance)
    return F.array_min(F.transform(near, lambda a: F.struct(F.abs(a["r"] - ratio).alias("d"), a["i"].alias("i"), a["n"].alias("n"))))["n"]


def pal_squeeze(width: Column, height: Column, pixel_aspect: Column) -> Column:
    """stored at a broadcast size with non-square pixels."""
    return width.isin(720, 704) & height.isin(576, 480) & (F.abs(pixel_aspect - 1.0) > 0.01)


def anamorphic(storage: Column, display: Column) -> Column:
    """anamorphic flag and squeeze factor snapped to 2, 1.5 or 1.33."""
    s = F.when(storage > 0, display / storage).otherwise(1.0)
    snapped = ladder(((s > 1.9) & (s < 2.1), 2.0), ((s > 1.4) & (s < 1.6), 1.5), ((s > 1.2) & (s < 1.4), 1.33), default=s)
    return F.struct((s > 1.3).alias("is_anamorphic"), snapped.alias("squeeze"))


def film_format(width: Column, height: Column) -> Column:
    """film gauge by megapixels of the scan."""
    return below(width * height / 1e6, (2, "super_8"), (4, "16mm"), (15, "35mm"), (30, "70mm"), default="imax")


def film_era(is_color: Column, grain: Column, fade: Column) -> Column:
    """era by colour, fading and grain."""
    return ladder(
        (~is_color & (grain > 0.7), "silent"), (~is_color, "early_sound"), (fade > 0.5, "golden_age"),
        (grain > 0.4, "new_hollywood"), (grain > 0.2, "modern"), default="digital_era",
    )


def film_confidence(known: Column, unsteady: Column, grain: Column, is_color: Column, fade: Column) -> Column:
    """confidence from how many signs were found."""
    bonus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return F.least(L(1.0), L(0.5) + bonus(known, 0.2) + bonus(unsteady, 0.1) + bonus(grain > 0.1, 0.1) + bonus(~is_color | (fade > 0.2), 0.1))


def processing_intensity(content: Column, motion: Column, faces: Column, texts: Column, sensitivity: float = 0.5, scale: float = 1.0) -> Column:
    """processing intensity 0-1."""
    base = dims.lookup(content, dims.CONTENT_INTENSITY, 0.6)
    mod = (dims.lookup(motion, dims.MOTION_MODIFIER, 1.0) - 1.0) * sensitivity + 1.0
    return clamp((base * mod - F.least(L(0.3), faces * 0.1) - F.least(L(0.3), texts * 0.15)) * scale, 0, 1)


# --- presets and plans -------------------------------------------------------------------------
def complexity(width, height, severities: Column, has_faces, faces_avg, noise, has_grain) -> Column:
    """complexity 0-1; ``severities`` is MAP<defect, severity>."""
    px = width * height
    vals = F.map_values(severities)
    n = F.size(vals)
    score = (
        ladder((px > 1920 * 1080, 0.2), (px > 1280 * 720, 0.1), default=0.0)
        + F.least(L(0.3), n * 0.05)
        + F.when(n > 0, F.aggregate(vals, L(0.0), lambda a, x: a + x) / n * 0.2).otherwise(0.0)
        + F.when(has_faces, F.least(L(0.1), faces_avg * 0.02) + 0.1).otherwise(0.0)
        + F.when(noise > 50, 0.1).otherwise(0.0)
        + F.when(has_grain, 0.1).otherwise(0.0)
    )
    return F.least(L(1.0), score)


def base_preset(wanted: Column, vram_gb: Column, cpu_only: Column, score: Column) -> Column:
    """F32: preset the hardware can carry."""
    best = wanted == "best"
    return ladder(
        (cpu_only | (vram_gb < 4), L("fast")), (best & (vram_gb < 6), L("balanced")), (best & (score > 0.8) & (vram_gb < 12), L("balanced")), default=wanted
    )


def preset_style(source: Column, vhs: Column, grain: Column, era: Column, interlaced: Column, width: Column, compression: Column) -> Column:
    """F32: style overlay by source, grain, era and compression (``compression`` null: not detected)."""
    return ladder(
        (vhs | source.isin("vhs", "betamax", "hi8"), "home_video"),
        (source.isin("film_35mm", "film_16mm", "film_8mm") | (grain > 0.4), "film"),
        (era.isin("silent_film", "early_sound", "golden_age"), "archive"),
        ((source == "broadcast") | (interlaced & width.isin(720, 1920)), "broadcast"),
        (compression > 0.5, "web_video"),
    )


def preset_decisions(wanted: Column, chosen: Column, style: Column, duration: Column) -> Column:
    """F32: decision codes that explain the choice."""
    return present(
        F.when(wanted != chosen, F.concat(L("downgraded:"), wanted, L("->"), chosen)).otherwise(F.concat(L("kept:"), wanted)),
        F.when((duration > 7200) & (chosen == "best"), L("long_video")),
        F.concat(L("style:"), F.coalesce(style, L("none"))),
    )


def adjust_settings(settings: Column, noise, interlaced, faces_avg, fps, vram_gb, compression, era) -> Column:
    """numeric settings map adjusted to a video, then capped for its era.

    ``settings`` is MAP<STRING, DOUBLE> (flags as 0 / 1); existing keys are kept.
    """
    unset = lambda k: ~F.map_contains_key(settings, k) | (F.element_at(settings, k) == 0)
    none = F.create_map().cast("map<string,double>")

    def add(cond: Column, *pairs) -> Column:
        flat = [x for k, v in pairs for x in (L(k), v.cast("double") if isinstance(v, Column) else L(float(v)))]
        return F.when(cond, F.create_map(*flat)).otherwise(none)

    extra = F.map_concat(
        add((noise > 0) & ~F.map_contains_key(settings, "denoise_strength"), ("denoise_strength", F.least(L(1.0), noise / 100 * 1.2))),
        add(interlaced & unset("enable_deinterlace"), ("enable_deinterlace", 1)),
        add((faces_avg > 0.5) & unset("enable_face_restore"), ("enable_face_restore", 1)),
        add((fps > 0) & (fps < 20) & (vram_gb >= 8) & unset("enable_interpolation"), ("enable_interpolation", 1), ("target_fps", 24)),
        add(compression.isNotNull() & unset("enable_qp_artifact_removal"), ("enable_qp_artifact_removal", 1), ("qp_strength", F.least(L(1.0), compression * 1.2))),
    )
    merged = F.map_zip_with(settings, extra, lambda k, a, b: F.coalesce(b, a))
    caps = none
    for name, table in dims.ERA_CAPS.items():
        caps = F.when(era == name, F.create_map(*[L(x) for kv in table.items() for x in kv])).otherwise(caps)
    return F.transform_values(merged, lambda k, v: F.least(v, F.coalesce(F.element_at(caps, k), v)))


def preset_minutes(tap, upscale, model, scale, face, faces_avg, interpolation, qp, vram_gb, frames) -> Column:
    """processing minutes of a preset."""
    on = lambda cond, v: F.when(cond, v).otherwise(0.0)
    ms = (
        L(50.0)
        + on(tap, 50.0)
        + on(upscale, scale * 100.0 * dims.lookup(model, {"diffusion": 50.0, "realesrgan": 1.0, "basicvsr": 2.0}, 1.0))
        + on(face, F.greatest(L(1.0), faces_avg) * 100.0)
        + on(interpolation, 150.0)
        + on(qp, 30.0)
    )
    factor = ladder((vram_gb >= 24, 0.5), (vram_gb >= 16, 0.7), (vram_gb >= 8, 1.0), (vram_gb >= 4, 2.0), default=10.0)
    return ms * factor * frames / 60000


def authenticity_limits(era: Column, philosophy: Column, sharpening, denoise, color, scale, source_rate, target_rate, face) -> Column:
    """requested settings limited to what the era tolerates."""
    lim = lambda i: dims.lookup(era, {k: float(v[i]) for k, v in dims.ERA_LIMITS.items()})
    mult = dims.lookup(philosophy, dims.PHILOSOPHY)
    grain = lim(0) > 0
    capped = F.least(denoise, lim(2) * mult)
    factor = F.when(source_rate > 0, target_rate / source_rate).otherwise(1.0)
    most = lim(5) * mult
    return F.struct(
        F.least(sharpening, lim(1) * mult).alias("sharpening"),
        F.when(grain, capped * 0.7).otherwise(capped).alias("denoise"),
        F.least(color, lim(3) * mult).alias("color"),
        F.least(scale, lim(4)).alias("scale"),
        F.when(factor > most, source_rate * most).otherwise(target_rate).alias("target_fps"),
        F.least(face, lim(6) * mult).alias("face"),
        grain.alias("preserve_grain"),
        F.when(grain, lim(7)).alias("target_grain"),
    )


def era_scores(year, is_color, aspect, fps, interlaced, grain, sharpness) -> Column:
    """points per era as an array in era order (null inputs give no points)."""
    by_year = F.when(
        year.isNotNull(),
        ladder(*[(year < y, e) for y, e in zip((1930, 1940, 1960, 1980, 2000, 2010), dims.ERAS)], default="modern"),
    )
    shape = F.coalesce(aspect, L(1.33))
    tv = F.abs(shape - 1.33) < 0.05
    academy = ~tv & (F.abs(shape - 1.37) < 0.05)
    wide = ~tv & ~academy & ((F.abs(shape - 1.85) < 0.05) | (F.abs(shape - 2.35) < 0.1))
    rate = F.coalesce(fps, L(24.0))
    slow, film = (rate > 0) & (rate < 20), (rate >= 20) & (F.abs(rate - 24) < 1)
    mono = F.coalesce(~is_color, L(False))
    edge = F.coalesce(sharpness, L(100.0))
    strong, some = F.coalesce(grain > 15, L(False)), F.coalesce((grain > 10) & (grain <= 15), L(False))
    points = {
        "silent_film": ((mono, 2.0), (tv, 1.0), (slow, 2.0), (strong, 1.0), (edge < 50, 1.0)),
        "early_talkies": ((mono, 1.5), (tv, 1.0), (strong, 0.5)),
        "golden_age": ((academy, 1.0), (film, 0.5), (some, 0.5)),
        "new_hollywood": ((wide, 1.0), (film, 0.5)),
        "video_era": ((tv, 0.5), (interlaced, 2.0)),
        "digital_transition": ((interlaced, 1.0),),
        "modern": ((wide, 0.5), (edge > 200, 1.0)),
    }
    return F.array(
        *[
            sum((F.when(c, p).otherwise(0.0) for c, p in points[e]), F.when(by_year == e, 5.0).otherwise(0.0))
            for e in dims.ERAS
        ]
    )


def classify_era(scores: Column) -> Column:
    """era with the most points (first wins ties) and its share of all points."""
    names = F.array(*[L(e) for e in dims.ERAS])

    def verdict(points: Column) -> Column:
        top, total = F.array_max(points), F.aggregate(points, L(0.0), lambda a, x: a + x)
        return F.struct(
            F.element_at(names, F.array_position(points, top).cast("int")).alias("era"),
            F.when(total > 0, top / total).otherwise(0.5).alias("confidence"),
        )

    return dims.let(scores, verdict)


def classify_medium(era: Column, interlaced: Column, width: Column, hint: Column) -> Column:
    """source medium by era, overridden by interlaced video and by a format hint."""
    h = F.lower(F.coalesce(hint, L("")))
    verdict = lambda m, c: F.struct((m if isinstance(m, Column) else L(m)).alias("medium"), L(c).alias("confidence"))
    return ladder(
        (h.contains("vhs"), verdict("vhs", 0.95)),
        (h.contains("betamax"), verdict("betamax", 0.95)),
        (h.contains("film"), verdict(F.when(era.isin("silent_film", "early_talkies"), "nitrate_film").otherwise("acetate_film"), 0.9)),
        (interlaced & (era == "video_era"), verdict(F.when(width < 500, "vhs").otherwise("betacam"), 0.8)),
        default=verdict(dims.lookup(era, dims.ERA_MEDIUM, "digital_file"), 0.7),
    )


def source_kind(vhs, width, height, compression, has_grain, interlaced) -> Column:
    """F36 (second rule set): source by artefacts, size, grain and compression; null when unknown."""
    dvd_size = (width == 720) & height.isin(480, 576)
    return ladder(
        (vhs, L("vhs")), (dvd_size & (compression > 70), L("dvd")), (dvd_size, L(None).cast("string")),
        (has_grain & (width < 1000), L("film_16mm")), (has_grain, L("film_35mm")),
        ((width >= 1920) & (compression > 80), L("digital")), (interlaced & width.isin(720, 1920), L("broadcast")),
    )


def era_by_picture(grey, fps, source, width, bit_depth, compression) -> Column:
    """F36 (second rule set): era by grey, rate, source and width."""
    hd = (width >= 1920) & (bit_depth >= 8)
    return ladder(
        (grey & (fps < 20), "silent_film"), (grey & fps.between(20, 25), "early_sound"), (F.coalesce(source == "vhs", L(False)), "home_video"),
        (hd & (compression > 90), "modern"), (hd, "digital_early"), (width < 480, "golden_age"), (width < 720, "new_hollywood"), default="digital_early",
    )


def vhs_score(flags: dict[str, Column], severities: dict[str, Column], dropouts: Column, rainbow: Column, dot_crawl: Column) -> Column:
    """tape degradation 0-1 from weighted artefacts; dropouts saturate at 50."""
    parts = [F.when(flags[k], severities[k] * w).otherwise(0.0) for k, w in dims.VHS_WEIGHTS.items()]
    parts += [F.least(L(1.0), dropouts / 50.0) * 0.20, F.when(rainbow, 0.08).otherwise(0.0), F.when(dot_crawl, 0.07).otherwise(0.0)]
    return F.least(L(1.0), sum(parts[1:], parts[0]))


def recovery_strategy(message: Column) -> Column:
    """recovery strategy from the message text."""
    return dims.first_keyword_class(F.lower(message), dims.RECOVERY, "retry")


def error_class(message: Column, stderr: Column) -> Column:
    """error class from message and process output, five ordered keyword groups."""
    text = F.lower(F.concat_ws(" ", F.coalesce(message, L("")), F.coalesce(stderr, L(""))))
    return dims.first_keyword_class(text, dims.ERROR_CLASSES, "base")


def thermal_state(celsius: Column) -> Column:
    """thermal band; null readings are unknown."""
    return ladder((celsius.isNull(), "unknown"), (celsius < 60, "cool"), (celsius < 75, "warm"), (celsius <= 85, "hot"), default="critical")


def throttled(start: Column, end: Column) -> Column:
    """hot at the end or heated up a lot."""
    return F.coalesce((start != 0) & (end != 0) & ((end > 83) | (end - start > 15)), L(False))


def interpolation_plan(source: Column, target: Column) -> Column:
    """frame multiplier (2 to 16), intermediate rate and whether frames must be dropped again."""
    f = target / source
    m = ladder((f <= 2, 2), (f <= 4, 4), (f <= 8, 8), default=16)
    drop = F.abs(source * m - target) > 0.5
    return F.struct(m.alias("multiplier"), (source * m).alias("intermediate_fps"), drop.alias("needs_decimation"), F.when(drop, target).otherwise(source * m).alias("final_fps"))


def item_errors(identifier: Column, title: Column, date: Column) -> Column:
    """validity errors of an archive item."""
    ident, name, day = (F.coalesce(c, L("")) for c in (identifier, title, date))
    return present(
        ladder((ident == "", "identifier_missing"), (~ident.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_.-]*$"), "identifier_invalid")),
        F.when(name == "", "title_missing"),
        F.when((day != "") & ~day.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), "date_invalid"),
    )


def camera_motion(n, magnitude, mean_dx, mean_dy, std_dx, std_dy, jitter, periodic: Column) -> Column:
    """static, panning, walking (periodic vertical motion) or handheld."""
    steady = F.abs(mean_dx) / (std_dx + 1) + F.abs(mean_dy) / (std_dy + 1)
    shaky = (jitter > 5) & (magnitude < 20)
    return ladder((magnitude < 0.5, "static"), (steady > 2, "panning"), (~shaky & (n > 20) & periodic, "walking"), default="handheld")


def audio_quality(clip_pct, hum, hiss_db, clicks, range_db, floor_db) -> Column:
    """five grades from the weighted issue count (null measurement: not detected)."""
    point = lambda cond, p: F.when(F.coalesce(cond, L(False)), p).otherwise(0)
    n = point(clip_pct > 1, 2) + point(hum, 1) + point(hiss_db > -50, 1) + point(clicks > 20, 1) + point(range_db < 20, 1) + point(floor_db > -40, 2)
    return ladder((n >= 5, "damaged"), (n >= 3, "poor"), (n >= 2, "fair"), (n >= 1, "good"), default="excellent")


def silence_severity(seconds: Column) -> Column:
    """severity of a silent interval."""
    return ladder((seconds > 10, "high"), (seconds > 5, "medium"), default="low")


def audio_issues(max_db: Column, mean_db: Column, clip_count: Column, longest_silence: Column) -> Column:
    """audio issues as (type, severity); acceptable means none is high."""
    issue = lambda cond, kind, sev: F.when(cond, F.struct(L(kind).alias("type"), sev.alias("severity")))
    return present(
        issue(longest_silence > 0, "silence", silence_severity(longest_silence)),
        issue(max_db >= 0, "clipping", F.when(clip_count > 100, "high").otherwise("medium")),
        issue(mean_db < -40, "low_volume", L("low")),
    )


def recommend(era, severity, noise, compression, flicker, damage, width, fps, content, faces_pct, grey, priority: Column, vram_gb: float) -> Column:
    """preset, settings list, estimated VRAM and quality for a video and a user priority."""
    wanted = dims.lookup(priority, dims.PRIORITY_PRESET, "balanced")
    old = era.isin("silent_era", "early_sound", "classic")
    bad = severity.isin("severe", "heavy")
    p1 = F.when(old & wanted.isin("fast", "balanced"), "quality").otherwise(wanted)
    p2 = F.when(bad & (p1 != "ultimate"), "ultimate" if vram_gb >= 16 else "quality").otherwise(p1)
    carried = next((p for p in ("quality", "balanced", "fast") if dims.PRESET_VRAM[p] <= vram_gb), None)
    too_big = dims.lookup(p2, dims.PRESET_VRAM) > vram_gb
    preset = F.when(too_big, carried).otherwise(p2) if carried else p2
    high = preset.isin("quality", "ultimate")
    item = lambda cond, k, v: F.when(cond, F.concat(L(k + "="), v.cast("string") if isinstance(v, Column) else L(v)))
    diffusion = (preset == "ultimate") & L(vram_gb >= 12)
    faces = faces_pct > 10
    settings = present(
        item(compression > 0.3, "qp_artifact_removal", "on"),
        item(noise > 0.3, "tap_denoise", "on"),
        item(era.isin("silent_era", "early_sound"), "deduplication", "on"),
        item(L(True), "scale_factor", F.when(width < 720, 4).otherwise(2)),
        item(diffusion, "sr_model", "diffusion"),
        item(~diffusion & (content == "animation"), "model_name", "realesr-animevideov3"),
        item(L(True), "auto_face_restore", F.when(faces, "on").otherwise("off")),
        item(faces & high, "face_model", "aesrgan"),
        item(damage > 0.01, "frame_generation", "on"),
        item(fps < 24, "target_fps", ladder((fps < 15, 30), (fps < 20, 25), default=24)),
        item(flicker > 0.3, "temporal_method", F.when(high, "hybrid").otherwise("optical_flow")),
        item(grey, "colorization_available", "on"),
    )
    vram = dims.lookup(preset, dims.PRESET_VRAM) + F.when(noise > 0.3, 2.0).otherwise(0.0) + F.when(diffusion, 8.0).otherwise(0.0) + F.when(damage > 0.01, 4.0).otherwise(0.0)
    quality = F.least(L(1.0), dims.lookup(preset, dims.PRESET_QUALITY) - dims.lookup(severity, dims.DEGRADATION_PENALTY, 0.1) + 0.05)
    return F.struct(preset.alias("preset"), settings.alias("settings"), vram.alias("vram_gb"), quality.alias("quality"), (vram > vram_gb).alias("vram_warning"))


def preset_by_text(source_format: Column, content: Column) -> Column:
    """preset from free-text format, else content, else the quick one."""
    by_format = dims.first_keyword_class(F.lower(F.coalesce(source_format, L(""))), dims.PRESET_BY_FORMAT, L(None).cast("string"))
    by_content = dims.first_keyword_class(F.lower(F.coalesce(content, L(""))), dims.PRESET_BY_CONTENT, "quick_cleanup")
    return F.coalesce(by_format, by_content)


def hdr_candidate(stops: Column, clipped_pct: Column, max_nits: Column, min_nits: Column) -> Column:
    """wide dynamic range worth expanding."""
    return (stops > 8) | (clipped_pct > 0.5) | ((max_nits > 80) & (min_nits < 5))


def frame_validation(brightness: Column, sharpness: Column, uniform_ratio: Column, psnr: Column) -> Column:
    """validator issues of a frame as (code, severity); null brightness is a null frame."""
    issue = lambda cond, code, sev="warning": F.when(cond, F.struct(L(code).alias("code"), L(sev).alias("severity")))
    return F.when(brightness.isNull(), F.array(F.struct(L("NULL_FRAME").alias("code"), L("critical").alias("severity")))).otherwise(
        present(
            issue(F.isnan(brightness), "CORRUPT_VALUES", "critical"),
            issue(brightness < 5, "BLACK_FRAME"),
            issue((brightness > 250) & ~F.isnan(brightness), "WHITE_FRAME"),
            issue(sharpness < 100, "BLURRY_FRAME"),
            issue(uniform_ratio > 0.3, "POTENTIAL_ARTIFACT"),
            issue(psnr < 10, "HIGH_DIFF_ORIGINAL"),
        )
    )


def scale_out(spent, since_last, queue, frame_ms, vram, max_cost=100.0, cooldown=60.0, max_queue=100, max_seconds=60.0, max_vram=0.95) -> Column:
    """burst decision and trigger; cost cap and cooldown veto everything."""
    veto = F.coalesce(spent >= max_cost, L(False)) | F.coalesce(since_last < cooldown, L(False))
    trigger = ladder((veto, "manual"), (queue >= max_queue, "queue_depth"), (frame_ms / 1000 >= max_seconds, "processing_time"), (vram >= max_vram, "vram_pressure"), default="manual")
    return F.struct((trigger != "manual").alias("burst"), trigger.alias("trigger"))


def deadline_plan(frames, local_fps, deadline_s, cloud_fps=10.0, max_instances=4, usd_hour=2.0) -> Column:
    """instances, cost and time to meet a deadline."""
    deadline_s = F.nullif(deadline_s, L(0.0))
    local = F.when(local_fps > 0, frames / local_fps).otherwise(L(float("inf")))
    burst = F.coalesce(local > deadline_s, L(False))
    lacking = F.floor((frames / deadline_s - local_fps) / cloud_fps)
    n = F.when(burst, F.least(F.greatest(L(1), lacking), L(max_instances))).otherwise(0)
    return F.struct(burst.alias("burst"), n.cast("long").alias("instances"), (n * usd_hour * F.coalesce(deadline_s, L(0.0)) / 3600).alias("cost"), (F.when(burst, deadline_s).otherwise(local) / 3600).alias("hours"))


def format_score(height: Column, codec: Column, fps: Column, bitrate: Column) -> Column:
    """download format score."""
    c = F.lower(F.coalesce(codec, L("")))
    by_codec = ladder((c.contains("av01") | c.contains("av1"), 3000), (c.contains("vp9") | c.contains("vp09"), 2000), (c.contains("avc") | c.contains("h264"), 1000), default=0)
    by_rate = ladder((fps >= 60, 500), (fps >= 30, 250), default=0)
    return F.coalesce(height, L(0)) * 10.0 + by_codec + by_rate + F.coalesce(bitrate, L(0.0)) / 100


def missing_share(frames: Column, fps: Column, seconds: Column) -> Column:
    """share of missing frames, null unless more than 5% are missing."""
    expected = F.floor(fps * seconds)
    return F.when((fps > 0) & (seconds > 0) & (frames < expected * 0.95), L(1.0) - frames / expected)


def picture_content(motion, faces_pct, grey, width) -> Column:
    """third content rule set."""
    return ladder(
        ((motion > 0.7) & (faces_pct <= 0), "animation"), ((faces_pct > 50) & grey, "film"), (faces_pct > 50, "home_video"),
        ((width < 720) & grey, "film"), (motion > 0.6, "sports"), default="unknown",
    )


def picture_era(grey, width) -> Column:
    """third era rule set."""
    return ladder((grey & (width < 400), "silent_era"), (grey & (width < 640), "early_sound"), (grey, "classic"), (width < 720, "modern_film"), (width >= 1280, "digital"), default="unknown")


def hdr_hints(stops: Column, max_cll: Column, max_fall: Column) -> Column:
    """HDR export values for SDR content."""
    high = stops > 8
    return F.struct(
        F.when(high, F.least(max_cll, L(4000))).otherwise(1000).alias("max_cll"),
        F.when(high, F.least(max_fall, L(1000))).otherwise(400).alias("max_fall"),
        F.when(high, "aces").otherwise("reinhard").alias("tone_mapping"),
        F.least(F.greatest(max_cll, L(1000)), L(4000)).alias("target_nits"),
    )


def disk_estimate(file_bytes: Column, frames: Column, fps: Column, scale: int = 4) -> Column:
    """bytes for extraction, enhancement, audio, output and temporary files."""
    extract, enhanced = frames * (3 * 1024 * 1024), frames * (3 * 1024 * 1024 * scale * scale)
    audio = F.floor(frames / fps / 60 * 10 * 1024 * 1024)
    sub = extract + enhanced + audio + file_bytes * 3
    spare = F.floor(sub * 0.1)
    return F.struct(extract.alias("extract"), enhanced.alias("enhanced"), audio.alias("audio"), (file_bytes * 3).alias("output"), spare.alias("temporary"), (sub + spare).alias("total"))
