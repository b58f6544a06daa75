"""Cost, time, disk and memory estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

L = F.lit


def cloud_rate(provider: Column, gpu: Column) -> Column:
    """Hourly rate from the fixed table: exact name, else first name that contains or is contained."""
    out = None
    for name, rates in dims.CLOUD_USD_HOUR.items():
        exact = dims.lookup(gpu, rates)
        close = None
        for g, usd in rates.items():
            hit = L(g).contains(gpu) | gpu.contains(L(g))
            close = F.when(hit, usd) if close is None else close.when(hit, usd)
        rate = F.coalesce(exact, close)
        out = F.when(provider == name, rate) if out is None else out.when(provider == name, rate)
    return out


def cost_estimate(frames: Column, width: Column, height: Column, preset: Column, gpu: Column, provider: Column, usd_kwh: float = 0.12) -> Column:
    """Time, disk, electricity, cloud cost, confidence and notes."""
    seconds = frames * dims.BASE_FRAME_SECONDS * dims.lookup(preset, dims.PRESET_TIME, 2.5) * F.pow(width * height / (1920 * 1080), L(0.7))
    per_frame = None
    for limit, mb in dims.DISK_MB_PER_FRAME:
        per_frame = F.when(height <= limit, mb) if per_frame is None else per_frame.when(height <= limit, mb)
    disk = frames * per_frame.otherwise(dims.DISK_MB_PER_FRAME_TOP) * 3.0 * 1.1 / 1024
    watts = dims.lookup(gpu, dims.GPU_WATTS, dims.GPU_WATTS["unknown"])
    kwh = watts * 1.3 / 0.85 / 1000 * (seconds / 3600)
    known = gpu.isin(*dims.GPU_WATTS)
    standard = height.isin(480, 720, 1080, 1440, 2160, 4320)
    notes = F.concat_ws(
        "; ",
        F.when(preset == "ultimate", "Ultimate preset uses maximum quality settings").when(preset == "fast", "Fast preset prioritizes speed over quality"),
        F.when(height >= 2160, "4K+ resolution significantly increases processing time"),
        F.when(~known, F.concat(L("GPU '"), gpu, L("' not in database, using estimates"))),
    )
    return F.struct(
        seconds.alias("seconds"),
        disk.alias("disk_gb"),
        kwh.alias("kwh"),
        (kwh * usd_kwh).alias("power_usd"),
        (seconds / 3600 * 1.1 * cloud_rate(provider, gpu)).alias("cloud_usd"),
        F.when(known & standard & (frames < 500000), "high").when(known | standard, "medium").otherwise("low").alias("confidence"),
        notes.alias("notes"),
    )


def gpu_tier(vram_mb: Column) -> Column:
    return F.when(vram_mb.isNull() | (vram_mb <= 0), "cpu").when(vram_mb >= 16000, "high_end_gpu").when(vram_mb >= 8000, "mid_gpu").otherwise("low_gpu")


def bitrate_estimate(width: Column, height: Column, crf: Column) -> Column:
    """Output bits per second; halves every six CRF steps."""
    return F.floor(width * height / (1920 * 1080) * 8_000_000 * F.pow(L(2.0), (L(18) - crf) / 6))


def vram_estimate(width: Column, height: Column, scale: Column, model: Column) -> Column:
    """Memory in MB for one frame at the output size."""
    per = dims.lookup(model, dims.VRAM_MB_PER_MEGAPIXEL, 450)
    return F.floor(width * scale * height * scale / 1e6 * per) + 500


def dry_run(frames: Column, out_frames: Column, width: Column, height: Column, scale: Column, seconds: Column, crf: Column, has_audio: Column, interpolate: Column, vram_mb: Column, model: Column) -> Column:
    """Stage times, time range text, disk bytes and memory of a planned run."""
    tier = gpu_tier(vram_mb)
    load = width * height / (1920 * 1080) * (scale / 4.0)
    extract = frames / dims.EXTRACT_FPS
    enhance = frames / (dims.lookup(tier, dims.ENHANCE_FPS) / load)
    between = F.when(interpolate, out_frames / dims.lookup(tier, dims.INTERPOLATE_FPS)).otherwise(0.0)
    total = extract + enhance + between + out_frames / dims.ENCODE_FPS
    low, high = F.floor(total * 0.8 / 60), F.floor(total * 1.5 / 60)
    text = F.when(high >= 120, F.format_string("%.1f-%.1f hours", low / 60, high / 60)).otherwise(F.format_string("%d-%d minutes", low, high))
    ow, oh = width * scale, height * scale
    small, large = F.floor(width * height * 3 * 0.5), F.floor(ow * oh * 3 * 0.5)
    temp = frames * small + frames * large + F.when(interpolate, out_frames * large).otherwise(0) + F.when(has_audio, F.floor(seconds / 60 * 10 * 1024 * 1024)).otherwise(0)
    output = F.floor(seconds * bitrate_estimate(ow, oh, crf) / 8)
    return F.struct(
        tier.alias("tier"),
        total.alias("seconds"),
        text.alias("time_range"),
        temp.alias("temp_bytes"),
        output.alias("output_bytes"),
        F.floor((temp + output) * 1.2).alias("total_bytes"),
        vram_estimate(width, height, scale, model).alias("vram_mb"),
    )


def resolution_size(name: Column) -> Column:
    """Width and height of a resolution name, null when unknown."""
    table = {k: F.struct(L(w).alias("width"), L(h).alias("height")) for k, (w, h) in dims.RESOLUTION_NAMES.items()}
    out = None
    for k, v in table.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out


def aspect_label(width: Column, height: Column) -> Column:
    """Film aspect label of a size; other shapes as ``n.nn:1``."""
    r = F.when(height > 0, width / height).otherwise(1.33)
    out = None
    # Fixed values: (ratio, tolerance, label) in match order.
    for ratio, tol, label in (
        (1.33, 0.05, "4:3"), (1.37, 0.05, "Academy"), (1.66, 0.05, "5:3"), (1.78, 0.05, "16:9"), (1.85, 0.05, "1.85:1"),
        (2.35, 0.1, "Cinemascope"), (2.76, 0.1, "Ultra Panavision"),
    ):
        hit = F.abs(r - ratio) < tol
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.format_string("%.2f:1", r))
