"""Timecodes, cue times and duration texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C, L = F.col, F.lit
DROP_RATES = (29.97, 59.94)


def timecode_to_frames(tc: Column, fps: float = 24.0, drop_frame: Column | bool | None = None) -> Column:
    """Frame count of ``HH:MM:SS:FF``; ``;`` separators (or ``drop_frame``) mean drop-frame counting."""
    p = F.split(tc, "[:;]")
    part = lambda i: F.element_at(p, i).cast("long")
    whole = int(fps)
    base = part(4) + (part(3) + part(2) * 60 + part(1) * 3600) * whole
    if fps not in DROP_RATES:
        return base
    is_drop = tc.contains(";") if drop_frame is None else (L(drop_frame) if isinstance(drop_frame, bool) else drop_frame)
    minutes = part(1) * 60 + part(2)
    return base - F.when(is_drop, (minutes - F.floor(minutes / 10)) * 2).otherwise(0)


def frames_to_timecode(frames: Column, fps: float = 24.0, drop_frame: bool = False) -> Column:
    """Timecode text of a frame count."""
    n = frames.cast("long")
    if drop_frame and fps in DROP_RATES:
        per_minute, per_ten = int(fps * 60), int(fps * 600)
        chunk = F.floor(n / (per_ten - 18))
        rest = n - chunk * (per_ten - 18)
        n = chunk * per_ten + rest + F.when(rest > 2, F.floor((rest - 2) / (per_minute - 2)) * 2).otherwise(0)
    secs = F.floor(n / fps)
    ff = F.floor(n - secs * fps)
    sep = ";" if drop_frame else ":"
    two = lambda c: F.format_string("%02d", c.cast("long"))  # noqa: E731  pads, never cuts
    hours = F.floor(secs / 3600)
    return F.concat_ws(sep, two(hours), two(F.floor(secs / 60) % 60), two(secs % 60), two(ff))


def seconds_to_frames(seconds: Column, fps: float = 24.0) -> Column:
    """Whole frames in a number of seconds (truncated)."""
    return F.floor(seconds * fps)


def subtract_frames(a: Column, b: Column) -> Column:
    """Difference floored at 0."""
    return F.greatest(L(0), a - b)


def cue_seconds(text: Column) -> Column:
    """Seconds of an SRT (ms), VTT (ms) or ASS (centisecond) time; 0 when it does not parse."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)[,.](\d+)", i)
    frac = part(4)
    value = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long") + frac.try_cast("double") / F.pow(L(10.0), F.length(frac))
    return F.coalesce(value, L(0.0))


def _clock(seconds: Column, scale: int) -> tuple[Column, Column, Column, Column]:
    whole = F.floor(seconds)
    return F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((seconds - whole) * scale)


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(seconds, 1000))


def vtt_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    return F.format_string("%02d:%02d:%02d.%03d", *_clock(seconds, 1000))


def ass_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``."""
    return F.format_string("%d:%02d:%02d.%02d", *_clock(seconds, 100))


def retime(start: Column, end: Column, factor: Column, offset: Column | None = None) -> tuple[Column, Column]:
    """Scale and shift a cue; factors and offsets within .001 of neutral change nothing."""
    shift = L(0.0) if offset is None else F.when(F.abs(offset) < 0.001, 0.0).otherwise(offset)
    ratio = F.when(F.abs(factor - 1.0) < 0.001, 1.0).otherwise(factor)
    return start * ratio + shift, end * ratio + shift


def retime_duration(start: Column, end: Column, source_s: Column, target_s: Column) -> tuple[Column, Column]:
    """Fit a track to a new duration."""
    return retime(start, end, target_s / source_s)


def retime_speed(start: Column, end: Column, speed: Column) -> tuple[Column, Column]:
    """Play at another speed."""
    return start / speed, end / speed


def correct_drift(start: Column, end: Column, per_minute: Column) -> tuple[Column, Column]:
    """Remove a drift; each time shifts in proportion, but the end of a cue at 0 stays."""
    rate = F.when(F.abs(per_minute) < 0.001, 0.0).otherwise(per_minute / 60.0)
    drift = start * rate
    return start - drift, F.when(start > 0, end - drift * (end / start)).otherwise(end - drift)


def scale_box(box: Column, factor: Column) -> Column:
    """Box struct (x, y, w, h) scaled, truncated to whole pixels."""
    return F.struct(*[(box[n] * factor).cast("long").alias(n) for n in "xywh"])


def eta_text(seconds: Column) -> Column:
    """``1h 2m 3s``, or Complete when nothing is left."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    return (
        F.when(seconds <= 0, "Complete")
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def eta_coarse(seconds: Column) -> Column:
    """Two largest units, Unknown for null or negative."""
    whole = F.floor(seconds)
    d, h, m, s = F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60
    return (
        F.when(seconds.isNull() | (seconds < 0), "Unknown")
        .when(d > 0, F.format_string("%dd %dh", d, h))
        .when(whole >= 3600, F.format_string("%dh %dm", h, m))
        .when(whole >= 60, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def duration_long(seconds: Column) -> Column:
    """Report text, e.g. ``2h 5m (2.1 hours)``."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    return (
        F.when(seconds < 60, F.format_string("%.1f seconds", seconds))
        .when(seconds < 3600, F.format_string("%d min %d sec (%.0fs total)", m, s, seconds))
        .otherwise(F.format_string("%dh %dm (%.1f hours)", h, m, seconds / 3600))
    )


def rational(text: Column, default: float = 30.0) -> Column:
    """Rational rate such as ``30000/1001``; a zero denominator gives ``default``."""
    p = F.split(text, "/")
    den = F.get(p, 1).try_cast("double")
    return F.when(den.isNull(), F.get(p, 0).try_cast("double")).when(den == 0, default).otherwise(F.get(p, 0).try_cast("double") / den)
