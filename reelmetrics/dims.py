"""Rule constants and small lookup tables, stated as they must be for equal results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- scenes -----------------------------------------------------------------------------------
# type: (denoise, sharpness, deblur, face restore)
SCENE_PARAMETERS = {
    "static": (0.2, 0.7, 0.0, None),
    "action": (0.3, 0.5, 0.5, None),
    "dialog": (0.25, 0.6, None, 1.0),
    "transition": (0.15, 0.4, None, None),
    "low_quality": (0.7, 0.8, 0.3, None),
    "unknown": (0.3, 0.5, None, None),
}
CONTENT_INTENSITY = {
    "face_closeup": 0.4, "face_medium": 0.5, "group_shot": 0.6, "landscape": 0.8, "architecture": 0.7,
    "text_title": 0.3, "action": 1.0, "static": 0.9, "documentary": 0.6, "animation": 0.5, "unknown": 0.6,
}
MOTION_MODIFIER = {"static": 1.2, "minimal": 1.0, "moderate": 0.9, "high": 1.0, "extreme": 1.0}

# --- quality ----------------------------------------------------------------------------------
LETTER_GRADES = (
    ("A+", 0.95), ("A", 0.90), ("A-", 0.85), ("B+", 0.80), ("B", 0.75), ("B-", 0.70),
    ("C+", 0.65), ("C", 0.60), ("C-", 0.55), ("D", 0.50),
)
QA_GRADES = (("excellent", 95), ("very_good", 85), ("good", 75), ("acceptable", 60), ("needs_improvement", 40))
QA_PSNR = ((100, 40), (90, 35), (70, 30), (50, 25))
QA_SSIM = ((100, 0.98), (90, 0.95), (75, 0.90), (60, 0.85))
VMAF_GRADES = (("Excellent", 95), ("Great", 90), ("Good", 80), ("Fair", 70), ("Poor", 60))
VHS_WEIGHTS = {"head_switching": 0.15, "tracking": 0.25, "chroma_bleed": 0.15, "jitter": 0.10}

# --- resolutions and aspect ratios ------------------------------------------------------------
COMMON_RESOLUTIONS = (
    (320, 240), (352, 288), (480, 360), (640, 480), (720, 480), (720, 576), (854, 480), (960, 540),
    (1024, 576), (1280, 720), (1440, 1080), (1920, 1080), (2560, 1440), (3840, 2160),
)
ASPECT_RATIOS = (
    ("4:3", 4, 3), ("16:9", 16, 9), ("1:1", 1, 1), ("21:9", 21, 9), ("1.85:1", 185, 100),
    ("2.35:1", 235, 100), ("2.39:1", 239, 100), ("Anamorphic 2x", 32, 9),
)
RESOLUTION_NAMES = {
    "8K": (7680, 4320), "4K": (3840, 2160), "2K": (2560, 1440), "1080p": (1920, 1080), "720p": (1280, 720), "480p": (854, 480),
}

# --- eras -------------------------------------------------------------------------------------
ERAS = ("silent_film", "early_talkies", "golden_age", "new_hollywood", "video_era", "digital_transition", "modern")
# era: (preserve grain, sharpening, noise reduction, colour, scale, interpolation, face, target grain)
ERA_LIMITS = {
    "silent_film": (True, 0.2, 0.3, 0.2, 4, 1.3, 0.3, 0.5),
    "early_talkies": (True, 0.25, 0.35, 0.3, 4, 1.3, 0.35, 0.45),
    "golden_age": (True, 0.3, 0.4, 0.35, 4, 1.4, 0.4, 0.35),
    "new_hollywood": (True, 0.35, 0.45, 0.4, 4, 1.5, 0.45, 0.3),
    "video_era": (False, 0.4, 0.6, 0.5, 4, 2.0, 0.5, 0.1),
    "digital_transition": (False, 0.5, 0.7, 0.6, 4, 2.0, 0.6, 0.05),
    "modern": (False, 0.7, 0.8, 0.8, 4, 2.5, 0.7, 0.0),
}
PHILOSOPHY = {"archival": 0.5, "accessible": 1.0, "enhanced": 1.5, "presentation": 1.3}
ERA_MEDIUM = {
    "silent_film": "nitrate_film", "early_talkies": "nitrate_film", "golden_age": "acetate_film", "new_hollywood": "acetate_film",
    "video_era": "vhs", "digital_transition": "digital_tape", "modern": "digital_file",
}
# smart selection caps per era
ERA_CAPS = {
    "silent_film": {"scale_factor": 2.0, "face_restore_strength": 0.3, "denoise_strength": 0.5},
    "early_sound": {"scale_factor": 2.0, "face_restore_strength": 0.4, "denoise_strength": 0.6},
    "golden_age": {"scale_factor": 4.0, "face_restore_strength": 0.5, "denoise_strength": 0.7},
    "home_video": {"face_restore_strength": 0.8},
}

# --- presets ----------------------------------------------------------------------------------
PRESET_QUALITY = {"fast": 0.6, "balanced": 0.75, "quality": 0.85, "ultimate": 0.95}
PRESET_VRAM = {"fast": 2.0, "balanced": 4.0, "quality": 8.0, "ultimate": 16.0}
PRIORITY_PRESET = {"speed": "fast", "balanced": "balanced", "quality": "quality", "maximum": "ultimate"}
DEGRADATION_PENALTY = {"minimal": 0.0, "light": 0.05, "moderate": 0.1, "heavy": 0.15, "severe": 0.2}
# request presets: (scale, crf, denoise, sharpen, model, face model, temporal method)
REQUEST_PRESETS = {
    "draft": (1.0, 23, 0.3, 0.3, None, None, None),
    "fast": (2.0, 20, 0.4, 0.4, "realesrgan", None, None),
    "balanced": (2.0, 18, 0.5, 0.5, "realesrgan", "gfpgan", None),
    "quality": (4.0, 16, 0.6, 0.6, "realesrgan", "gfpgan", "optical_flow"),
    "ultimate": (4.0, 14, 0.7, 0.7, "diffusion", "aesrgan", "hybrid"),
}
# request eras: (era, keep grain)
REQUEST_ERAS = {
    "silent": ("silent_film", True), "1920s": ("silent_film", True), "1930s": ("early_talkies", True), "1940s": ("golden_age", True),
    "1950s": ("golden_age", True), "1960s": ("new_hollywood", True), "1970s": ("new_hollywood", True), "1980s": ("video_era", False),
    "1990s": ("video_era", False), "home_video": ("video_era", False),
}
REQUEST_FORMATS = ("vhs", "betamax", "hi8", "super8", "16mm", "35mm", "nitrate")
TAPE_FORMATS = ("vhs", "betamax", "hi8")

# --- error texts ------------------------------------------------------------------------------
ERROR_CLASSES = (
    ("vram", ("cuda out of memory", "out of memory", "vram", "gpu memory", "memory allocation failed", "insufficient memory", "vulkan memory")),
    ("disk_space", ("no space left on device", "disk quota exceeded", "not enough space", "disk full", "write error")),
    ("network", ("connection refused", "connection reset", "network unreachable", "timeout", "timed out", "host not found", "dns", "ssl", "certificate")),
    ("corruption", ("corrupt", "invalid data", "checksum", "crc error", "truncated", "malformed")),
    ("dependency", ("not found", "command not found", "no such file or directory", "cannot find", "missing", "not installed")),
)
RECOVERY = (("reduce_batch", ("cuda", "gpu", "memory")), ("skip", ("file", "path")), ("retry", ("timeout", "connection")))
PRESET_BY_FORMAT = (("vhs_home_movie", ("vhs",)), ("film_8mm", ("8mm",)), ("film_16mm", ("16mm",)), ("film_35mm_archive", ("35mm",)))
PRESET_BY_CONTENT = (
    ("animation_cel", ("animation", "cartoon")),
    ("documentary_archive", ("documentary",)),
    ("gaming_retro", ("game", "gaming")),
)

# --- film stocks ------------------------------------------------------------------------------
# stock: (red shift, green shift, blue shift, saturation factor, grain intensity), in match order
FILM_STOCKS = {
    "kodachrome": (0.1, -0.05, -0.1, 1.2, 0.3),
    "ektachrome": (-0.05, 0.0, 0.1, 1.0, 0.4),
    "technicolor_3": (0.15, 0.05, -0.05, 1.4, 0.2),
    "eastmancolor": (0.2, -0.1, -0.15, 0.8, 0.5),
    "agfacolor": (0.05, 0.1, -0.05, 1.1, 0.4),
    "fujifilm": (-0.05, 0.1, 0.0, 1.05, 0.35),
}

# Grain of known stocks, in match order:
# (size, intensity, luma share, uniformity, temporal variation)
GRAIN_STOCKS = {
    "kodak_5219": (0.45, 0.35, 0.7, 0.85, 0.15),
    "kodak_5213": (0.3, 0.2, 0.8, 0.9, 0.1),
    "kodak_5222": (0.55, 0.45, 1.0, 0.75, 0.2),
    "fuji_eterna": (0.35, 0.25, 0.75, 0.88, 0.12),
    "kodachrome": (0.25, 0.15, 0.85, 0.92, 0.08),
    "ektachrome": (0.4, 0.3, 0.7, 0.82, 0.18),
    "agfa": (0.6, 0.5, 0.65, 0.7, 0.25),
    "fine": (0.25, 0.15, 0.8, 0.9, 0.1),
    "medium": (0.45, 0.35, 0.7, 0.8, 0.15),
    "coarse": (0.7, 0.55, 0.6, 0.65, 0.25),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup(key: Column, table: dict[str, float], default=None) -> Column:
    """Value of a small fixed table as an expression; no join."""
    flat = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*flat), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def bands_from(value: Column, table, default) -> Column:
    """First label whose lower limit (inclusive) the value reaches."""
    out = None
    for label, low in table:
        out = F.when(value >= low, label) if out is None else out.when(value >= low, label)
    return out.otherwise(default)


def contains_any(text: Column, words) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def first_keyword_class(text: Column, table, default) -> Column:
    out = None
    for label, words in table:
        hit = contains_any(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)

# --- cost model -------------------------------------------------------------------------------
GPU_WATTS = {
    "RTX_4090": 450, "RTX_4080": 320, "RTX_4070_Ti": 285, "RTX_4070": 200, "RTX_4060_Ti": 165, "RTX_4060": 115,
    "RTX_3090": 350, "RTX_3090_Ti": 450, "RTX_3080": 320, "RTX_3080_Ti": 350, "RTX_3070": 220, "RTX_3070_Ti": 290,
    "RTX_3060": 170, "RTX_3060_Ti": 200, "RTX_2080_Ti": 260, "RTX_2080": 215, "RTX_2070": 175, "RTX_2060": 160,
    "A100_80GB": 400, "A100_40GB": 400, "A6000": 300, "A5000": 230, "A4000": 140, "H100": 700, "H100_SXM": 700,
    "H100_PCIe": 350, "L40": 300, "L4": 72, "T4": 70, "V100": 300, "V100S": 250, "RX_7900_XTX": 355, "RX_7900_XT": 315,
    "RX_6900_XT": 300, "MI300X": 750, "MI250X": 560, "MI100": 300, "unknown": 250,
}
CLOUD_USD_HOUR = {
    "runpod": {"RTX_4090": 0.69, "RTX_4080": 0.59, "RTX_3090": 0.44, "RTX_3080": 0.34, "A100_80GB": 1.99, "A100_40GB": 1.49, "A6000": 0.79, "H100": 4.49, "L40": 1.19},
    "vastai": {"RTX_4090": 0.45, "RTX_4080": 0.35, "RTX_3090": 0.30, "RTX_3080": 0.22, "A100_80GB": 1.50, "A100_40GB": 1.10, "A6000": 0.55, "H100": 3.50, "L40": 0.85},
    "lambda_labs": {"A100_80GB": 1.29, "A100_40GB": 1.10, "H100": 2.49, "RTX_4090": 0.75},
    "paperspace": {"RTX_4000": 0.45, "RTX_5000": 0.78, "A4000": 0.56, "A5000": 0.87, "A6000": 1.12, "A100_80GB": 3.09},
}
PRESET_TIME = {"fast": 1.0, "quality": 2.5, "archive": 4.0, "anime": 2.0, "film_restoration": 3.5, "ultimate": 6.0, "authentic": 2.0, "vhs": 2.5}
DISK_MB_PER_FRAME = ((480, 0.5), (720, 1.0), (1080, 2.5), (1440, 4.0), (2160, 8.0))
DISK_MB_PER_FRAME_TOP = 32.0
BASE_FRAME_SECONDS = 0.15
ENHANCE_FPS = {"high_end_gpu": 2.5, "mid_gpu": 1.0, "low_gpu": 0.3, "cpu": 0.05}
INTERPOLATE_FPS = {"high_end_gpu": 30.0, "mid_gpu": 15.0, "low_gpu": 5.0, "cpu": 0.5}
EXTRACT_FPS, ENCODE_FPS = 100.0, 30.0
VRAM_MB_PER_MEGAPIXEL = {"realesrgan-x4plus": 450, "realesrgan-x4plus-anime": 400, "realesrgan-x2plus": 250, "realesr-animevideov3": 350}

# --- project stages ---------------------------------------------------------------------------
ALL_STAGES = (
    "analyze", "qp_artifact_removal", "tap_denoise", "frame_generation", "deduplication", "extract_frames", "enhance",
    "face_restore", "interpolate", "temporal_consistency", "colorize", "reassemble", "audio_restore", "validate",
)
PRESET_STAGES = {
    "fast": ("analyze", "extract_frames", "enhance", "reassemble"),
    "balanced": ("analyze", "extract_frames", "enhance", "face_restore", "reassemble"),
    "quality": ("analyze", "extract_frames", "enhance", "face_restore", "temporal_consistency", "reassemble", "validate"),
    "ultimate": ALL_STAGES,
    "archive": ALL_STAGES,
}

# --- request texts: (pattern, weight) per intent, and tag patterns ----------------------------
INTENTS = {
    "restore": (
        (r"\brestore\b", 1.0), (r"\bfix\s+(up|this|my|the)\b", 0.9), (r"\brepair\b", 0.9), (r"\brescue\b", 0.8),
        (r"\bbring\s+back\b", 0.8), (r"\brevive\b", 0.7), (r"\bremaster\b", 0.9), (r"\bclean\s+up\b", 0.8),
    ),
    "upscale": (
        (r"\bupscale\b", 1.0), (r"\bincrease\s+(resolution|res)\b", 0.9), (r"\b(make|get)\s+(it\s+)?(bigger|larger|higher\s+res)\b", 0.8),
        (r"\b4k\b", 0.7), (r"\bhd\b", 0.6), (r"\bsuper\s*res(olution)?\b", 0.9), (r"\benhance\s+(resolution|detail)\b", 0.8),
    ),
    "denoise": (
        (r"\bdenoise\b", 1.0), (r"\bremove\s+noise\b", 1.0), (r"\bnoise\s+reduct(ion)?\b", 0.9), (r"\bclean\b", 0.7),
        (r"\bremove\s+grain\b", 0.8), (r"\breduce\s+grain\b", 0.7), (r"\bgrainy\b", 0.6), (r"\bnoisy\b", 0.6),
    ),
    "colorize": (
        (r"\bcoloriz(e|ation)\b", 1.0), (r"\badd\s+color\b", 1.0), (r"\bcolor\s+(this|it|the)\b", 0.9),
        (r"\bblack\s+and\s+white\s+to\s+color\b", 1.0), (r"\bb&?w\s+to\s+color\b", 0.9), (r"\bconvert\s+to\s+color\b", 0.9),
    ),
    "stabilize": (
        (r"\bstabiliz(e|ation)\b", 1.0), (r"\bremove\s+shake\b", 1.0), (r"\bfix\s+shak(y|ing)\b", 0.9), (r"\bsteady\b", 0.8),
        (r"\bsmooth\s+(out\s+)?(motion|camera)\b", 0.8), (r"\bjitter\b", 0.7),
    ),
    "enhance": (
        (r"\benhance\b", 1.0), (r"\bimprove\b", 0.9), (r"\bmake\s+(it\s+)?(look\s+)?better\b", 0.8), (r"\bbeautify\b", 0.7), (r"\bpolish\b", 0.7),
    ),
    "fix": ((r"\bfix\b", 0.8), (r"\brepair\b", 0.8), (r"\bcorrect\b", 0.7), (r"\bremove\s+(scratches|damage|artifacts)\b", 0.9)),
    "interpolate": (
        (r"\binterpolat(e|ion)\b", 1.0), (r"\bframe\s+(rate\s+)?(increase|boost|up)\b", 0.9), (r"\bsmooth\s+(motion|video)\b", 0.8),
        (r"\b(60|120)\s*fps\b", 0.7), (r"\bslow\s*mo(tion)?\b", 0.6),
    ),
    "analyze": (
        (r"\banalyz(e|is)\b", 1.0), (r"\bcheck\s+quality\b", 0.9), (r"\bassess\b", 0.8), (r"\bevaluat(e|ion)\b", 0.8),
        (r"\bwhat('s| is)\s+(wrong|the\s+issue)\b", 0.7),
    ),
}
VIDEO_WORDS = r"\b(video|film|footage|movie|clip)\b"
SCALE_WORDS = ((r"\b4k\b", 4.0), (r"\b(2k|1440p)\b", 2.0), (r"\b(1080p|full\s*hd)\b", 2.0))
RESOLUTION_WORDS = (
    (r"\b(8k|7680\s*x\s*4320)\b", "8K"), (r"\b(4k|uhd|2160p|3840\s*x\s*2160)\b", "4K"), (r"\b(2k|1440p|2560\s*x\s*1440)\b", "2K"),
    (r"\b(1080p|full\s*hd|1920\s*x\s*1080)\b", "1080p"), (r"\b(720p|hd)\b", "720p"),
)
ERA_WORDS = (
    (r"\bsilent\s+(film|era|movie)\b", "silent"), (r"\b(golden\s+age|classic\s+hollywood)\b", "golden_age"),
    (r"\b(early\s+color|technicolor)\b", "early_color"), (r"\b(home\s+video|camcorder)\b", "home_video"),
)
FORMAT_WORDS = (
    (r"\bvhs\b", "vhs"), (r"\bbeta(max)?\b", "betamax"), (r"\bhi-?8\b", "hi8"), (r"\bsuper\s*8\b", "super8"), (r"\b16\s*mm\b", "16mm"),
    (r"\b35\s*mm\b", "35mm"), (r"\b8\s*mm\b", "8mm"), (r"\blaser\s*disc\b", "laserdisc"), (r"\bdvd\b", "dvd"), (r"\bdigital\b", "digital"),
    (r"\bfilm\b", "film"), (r"\bnitrate\b", "nitrate"),
)
ISSUE_WORDS = (
    (r"\bscratches?\b", "scratches"), (r"\bgrain(y)?\b", "grain"), (r"\bnois(e|y)\b", "noise"), (r"\bflicker(ing)?\b", "flicker"),
    (r"\bshak(e|y|ing)\b", "shake"), (r"\bblur(ry)?\b", "blur"), (r"\bfade[ds]?\b", "fading"), (r"\bdamage[ds]?\b", "damage"),
    (r"\bartifacts?\b", "artifacts"), (r"\bdust\b", "dust"), (r"\bspots?\b", "spots"), (r"\btears?\b", "tears"), (r"\bdropout\b", "dropout"),
    (r"\btracking\b", "tracking"), (r"\bjitter\b", "jitter"), (r"\bcompression\b", "compression"), (r"\bblocking\b", "blocking"),
    (r"\bcolor\s+bleed\b", "color_bleed"), (r"\binterlac(ed|ing)\b", "interlacing"),
)
PRESERVE_WORDS = (
    (r"\b(keep|preserve|maintain)\s+(the\s+)?grain\b", "grain"), (r"\b(keep|preserve|maintain)\s+(the\s+)?color\b", "color"),
    (r"\b(authentic|original|period|vintage)\b", "authenticity"), (r"\b(look|feel|aesthetic|character)\b", "aesthetic"),
    (r"\bdon'?t\s+(make|want)\s+it\s+look\s+(too\s+)?(modern|new|polished)\b", "authenticity"),
)
MODERN_WORDS = r"\b(modern|polished|pristine|flawless|perfect)\b"
