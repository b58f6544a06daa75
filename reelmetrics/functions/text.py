"""Text functions: OCR clean-up, formatting, slugs, request tagging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

C, L = F.col, F.lit


def squeeze(text: Column) -> Column:
    """All white space (Unicode too) to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_ocr(text: Column) -> Column:
    """Spacing around punctuation, doubled quotes, stray single letters (except a, i, o)."""
    t = squeeze(text)
    t = F.regexp_replace(t, r"(?U)\s+([.,!?;:])", "$1")
    t = F.regexp_replace(t, r"([.,!?;:])(?=[A-Za-z])", "$1 ")
    t = F.replace(F.replace(t, L(",,"), L('"')), L("''"), L('"'))
    words = F.split(squeeze(t), " ")
    return F.array_join(F.filter(words, lambda w: (F.char_length(w) > 1) | F.lower(w).isin("a", "i", "o")), " ")


def clean_ocr_upper(text: Column) -> Column:
    """``|`` to I, and 0 to O in texts written in capitals."""
    t = F.replace(squeeze(text), L("|"), L("I"))
    capitals = (t == F.upper(t)) & (t != F.lower(t))
    return F.trim(F.when(capitals, F.replace(t, L("0"), L("O"))).otherwise(t))


def standardize(text: Column) -> Column:
    """Capital first letter, ``- `` dialogue dashes, three-dot ellipses."""
    head = F.substring(text, 1, 1)
    t = F.when(head.rlike(r"^\p{L}"), F.concat(F.upper(head), F.substring(text, 2, 2**31 - 1))).otherwise(text)
    t = F.regexp_replace(t, r"(?m)^-(?U:\s*)", "- ")
    return F.regexp_replace(t, r"\.{2,}", "...")


def slug(title: Column) -> Column:
    """Archive identifier of a title."""
    t = F.regexp_replace(F.lower(squeeze(title)), r"[\s\-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_.\-]", ""), "_+", "_")
    t = F.regexp_replace(t, r"^[_.]+|[_.]+$", "")
    t = F.when((t != "") & ~F.substring(t, 1, 1).rlike("[a-z0-9]"), F.concat(L("item_"), t)).otherwise(t)
    t = F.when(t == "", "item").when(F.length(t) < 3, F.concat(L("item_"), t)).otherwise(t)
    return F.when(F.length(t) > 80, F.regexp_replace(F.substring(t, 1, 80), r"[_.]+$", "")).otherwise(t)


def _hit(text: Column, pattern: str) -> Column:
    """A pattern of a lower-cased text."""
    return text.rlike(pattern)


def _any(text: Column, table) -> Column:
    """Whether any pattern of the table hits, in one pass; the single patterns are tried only then."""
    return text.rlike("|".join(f"(?:{p})" for p, _ in table))


def _first(text: Column, table) -> Column:
    out = None
    for pattern, value in table:
        out = F.when(_hit(text, pattern), value) if out is None else out.when(_hit(text, pattern), value)
    return F.when(_any(text, table), out)


def _all(text: Column, table) -> Column:
    found = F.array_distinct(F.array_compact(F.array(*[F.when(_hit(text, p), v) for p, v in table])))
    return F.when(_any(text, table), found).otherwise(F.array().cast("array<string>"))


def request_intent(text: Column) -> Column:
    """X11: best intent of a lower-cased text and its weight; a bare mention of a video means restore at 0.5."""
    scored = []
    for i, (name, table) in enumerate(dims.INTENTS.items()):
        by_weight = sorted(table, key=lambda pw: -pw[1])
        score = None
        for p, w in by_weight:
            score = F.when(_hit(text, p), w) if score is None else score.when(_hit(text, p), w)
        score = F.when(_any(text, by_weight), score)
        scored.append(F.struct(F.coalesce(score, L(0.0)).alias("score"), L(-i).alias("order"), L(name).alias("intent")))
    mention = text.rlike(dims.VIDEO_WORDS)

    def verdict(best: Column) -> Column:
        none = best["score"] == 0
        return F.struct(
            F.when(none & mention, "restore").when(none, "unknown").otherwise(best["intent"]).alias("intent"),
            F.when(none & mention, 0.5).otherwise(best["score"]).alias("confidence"),
        )

    return dims.let(F.array_max(F.array(*scored)), verdict)


def request_tags(text: Column) -> Column:
    """X11: scale, resolution, rate, era, format, issues and what to preserve, from a request text in any case."""
    return dims.let(F.lower(text), _request_tags)


def _request_tags(text: Column) -> Column:
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), L(""))
    scale = F.coalesce(number(r"\b(\d+)\s*[xX]\b").cast("double"), number(r"\b(\d+)\s+times\b").cast("double"), _first(text, dims.SCALE_WORDS))
    fps = F.coalesce(
        number(r"(\d+(?:\.\d+)?)\s*fps\b").cast("double"),
        F.when(_hit(text, r"\b60\s*(?:frames|hertz|hz)\b"), 60.0).when(_hit(text, r"\b120\s*(?:frames|hertz|hz)\b"), 120.0),
    )
    decade = F.coalesce(number(r"\b(19\d0)s?\b"), number(r"\b(20[012]\d)s?\b"))
    rest = lambda intent: F.struct(
        intent["intent"].alias("intent"),
        intent["confidence"].alias("confidence"),
        scale.alias("scale"),
        _first(text, dims.RESOLUTION_WORDS).alias("resolution"),
        fps.alias("fps"),
        F.coalesce(F.concat(decade, L("s")), _first(text, dims.ERA_WORDS)).alias("era"),
        _first(text, dims.FORMAT_WORDS).alias("format"),
        _all(text, dims.ISSUE_WORDS).alias("issues"),
        _all(text, dims.PRESERVE_WORDS).alias("preserve"),
        (~_hit(text, dims.MODERN_WORDS)).alias("keep_authentic"),
    )
    return dims.let(request_intent(text), rest)


def request_plan(tags: Column, preset: Column) -> Column:
    """plan of a tagged request - preset, era and format overlaid, authenticity limits applied."""
    at = lambda i: {k: v[i] for k, v in dims.REQUEST_PRESETS.items() if v[i] is not None}
    known = preset.isin(*dims.REQUEST_PRESETS)
    authentic, intent = tags["keep_authentic"], tags["intent"]
    has = lambda x: F.array_contains(tags["issues"], x)
    era = dims.lookup(tags["era"], {k: v[0] for k, v in dims.REQUEST_ERAS.items()})
    grainy = F.coalesce(dims.lookup(tags["era"], {k: int(v[1]) for k, v in dims.REQUEST_ERAS.items()}) == 1, L(False))
    keep_grain = F.array_contains(tags["preserve"], "grain")
    high = preset.isin("quality", "ultimate")
    denoise = dims.lookup(preset, at(2), 0.5)
    denoise = F.when(keep_grain, denoise).otherwise(F.least(denoise, L(0.4)))
    cap = lambda c, limit: F.when(authentic, F.least(c, L(limit))).otherwise(c)
    sharpen = dims.lookup(preset, at(3))
    stage = lambda cond, name: F.when(cond, name)
    stages = F.array_compact(
        F.array(
            L("analysis"),
            stage(tags["format"].isin(*dims.TAPE_FORMATS), "vhs_restoration"),
            stage((intent == "stabilize") | has("shake") | has("jitter"), "stabilization"),
            stage((intent == "denoise") | has("noise") | has("grain") | high, "denoise"),
            stage(has("artifacts") | has("scratches") | has("damage"), "artifact_removal"),
            stage((intent == "upscale") | (tags["scale"] > 1) | tags["resolution"].isNotNull(), "upscale"),
            stage(preset.isin("balanced", "quality", "ultimate"), "face_enhance"),
            stage((intent == "interpolate") | tags["fps"].isNotNull(), "interpolation"),
            stage(intent == "colorize", "colorize"),
            stage(high, "temporal"),
            L("color_correction"),
            stage(known, "sharpen"),
        )
    )
    return F.struct(
        F.coalesce(tags["scale"], dims.lookup(preset, at(0), 2.0)).alias("scale"),
        tags["fps"].alias("target_fps"),
        era.alias("source_era"),
        F.when(tags["format"].isin(*dims.REQUEST_FORMATS), tags["format"]).alias("source_format"),
        F.when(grainy, 0.7).otherwise(0.5).alias("authenticity"),
        cap(denoise, 0.4).alias("denoise_strength"),
        cap(F.when(authentic, 0.7).otherwise(1.0), 0.6).alias("face_strength"),
        cap(sharpen, 0.3).alias("sharpen_strength"),
        stages.alias("stages"),
    )


def changelog(name: Column, versions: Column, stages: Column) -> Column:
    """Changelog text; ``versions`` array of (version, created_at, description), ``stages`` of (name, status)."""
    history = F.transform(
        F.reverse(versions),
        lambda v: F.concat(L("  v"), v["version"].cast("string"), L(" ("), v["created_at"], L(")\n    "), F.coalesce(F.nullif(v["description"], L("")), L("No description"))),
    )
    done = F.transform(stages, lambda s: F.concat(L("  ["), F.upper(s["status"]), L("] "), s["name"]))
    head = F.array(F.concat(L("CHANGELOG: "), name), L("VERSION HISTORY:"))
    return F.array_join(F.concat(head, history, F.array(L("PROCESSING STAGES:")), done), "\n")
