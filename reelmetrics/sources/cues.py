"""Subtitle cue files (SRC6, SRC7, SNK3).

A cue file is one row (``wholetext``); it is parsed with built-in string and array functions, so
parsing runs inside code generation and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import ass_time, cue_seconds, srt_time, vtt_time
from ..operators.sequence import Seq, number_rows

C, L = F.col, F.lit

SRT_HEAD = r"(?s)^\s*(\d+)\s*\n(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})[^\n]*\n(.*)$"
VTT_HEAD = r"(?s)(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})[^\n]*\n?(.*)$"


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as rows ``path, value``."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(C("_metadata.file_path").alias("path"), F.replace("value", L("\r\n"), L("\n")).alias("value"))


def _blocks(value: Column) -> Column:
    return F.split(value, r"\n[ \t]*\n")


def parse_srt(files: DataFrame, value: str = "value") -> DataFrame:
    """SRC6: cues of SRT texts: the file's columns plus cue_index, start_s, end_s, text."""
    blocks = F.filter(_blocks(C(value)), lambda b: b.rlike(SRT_HEAD))
    part = lambda i: F.regexp_extract("_b", SRT_HEAD, i)
    keep = [c for c in files.columns if c != value]
    return files.select(*keep, F.explode(blocks).alias("_b")).select(
        *keep,
        part(1).cast("int").alias("cue_index"),
        cue_seconds(part(2)).alias("start_s"),
        cue_seconds(part(3)).alias("end_s"),
        F.trim(part(4), L(" \t\n")).alias("text"),
    )


def parse_vtt(files: DataFrame, value: str = "value") -> DataFrame:
    """SRC6: cues of VTT texts, numbered in file order."""
    blocks = F.filter(_blocks(C(value)), lambda b: b.rlike(VTT_HEAD))
    part = lambda i: F.regexp_extract("_b", VTT_HEAD, i)
    keep = [c for c in files.columns if c != value]
    lines = F.filter(F.transform(F.split(part(3), "\n"), lambda x: F.trim(x, L(" \t"))), lambda x: x != "")
    return files.select(*keep, F.posexplode(blocks).alias("_i", "_b")).select(
        *keep, (C("_i") + 1).alias("cue_index"), cue_seconds(part(1)).alias("start_s"), cue_seconds(part(2)).alias("end_s"), F.array_join(lines, "\n").alias("text")
    )


def parse_ass(files: DataFrame, value: str = "value") -> DataFrame:
    """SRC7: ``Dialogue:`` lines of the events section with all ten fields; the section ends at a line
    that begins with "["."""
    events = F.regexp_extract(C(value), r"(?ism)^[ \t]*\[Events\](.*?)(?:^\[|\z)", 1)
    lines = F.filter(F.transform(F.split(events, "\n"), lambda x: F.trim(x, L(" \t"))), lambda x: x.startswith("Dialogue:"))
    fields = F.transform(lines, lambda x: F.split(F.substring(x, 10, 2**31 - 1), ",", 10))
    full = F.filter(fields, lambda f: F.size(f) == 10)
    keep = [c for c in files.columns if c != value]
    at = lambda i: F.trim(F.get("_f", i), L(" \t"))
    text = F.replace(F.replace(at(9), L("\\N"), L("\n")), L("\\n"), L("\n"))
    return files.select(*keep, F.posexplode(full).alias("_i", "_f")).select(
        *keep, (C("_i") + 1).alias("cue_index"), cue_seconds(at(1)).alias("start_s"), cue_seconds(at(2)).alias("end_s"), text.alias("text"), at(3).alias("style"), at(0).cast("int").alias("layer")
    )


def cue_block(fmt: str, number: Column, start: Column, end: Column, text: Column, style: Column | None = None, layer: Column | None = None) -> Column:
    """SNK3: one cue as text in ``srt``, ``vtt`` or ``ass``."""
    if fmt == "srt":
        return F.concat(number.cast("string"), L("\n"), srt_time(start), L(" --> "), srt_time(end), L("\n"), text, L("\n"))
    if fmt == "vtt":
        return F.concat(vtt_time(start), L(" --> "), vtt_time(end), L("\n"), text, L("\n"))
    if fmt == "ass":
        return F.concat(
            L("Dialogue: "), F.coalesce(layer, L(0)).cast("string") if layer is not None else L("0"), L(","), ass_time(start), L(","), ass_time(end), L(","),
            F.coalesce(style, L("Default")) if style is not None else L("Default"), L(",,0,0,0,,"), F.replace(text, L("\n"), L("\\N")),
        )
    raise ValueError(fmt)


# What an exported file begins with.
HEADERS = {
    "srt": "",
    "vtt": "WEBVTT\n",
    "ass": "[Script Info]\nTitle: Exported Subtitles\nScriptType: v4.00+\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
}


def cue_lines(cues: DataFrame, keys: tuple[str, ...], fmt: str, width: float | None = 3600.0) -> DataFrame:
    """SNK3: numbered text blocks of every track (block 0 is the header), one row per cue.

    ``cues``: keys, start_s, end_s, text.  A track stays many rows, so its length is unbounded.
    """
    numbered = number_rows(cues, Seq(keys, ("start_s", "end_s", "text"), width), "line_no", start=1)
    body = numbered.select(*keys, "line_no", cue_block(fmt, C("line_no"), C("start_s"), C("end_s"), C("text")).alias("value"))
    if not HEADERS[fmt]:
        return body
    head = cues.select(*keys).distinct().select(*keys, L(0).cast("long").alias("line_no"), L(HEADERS[fmt]).alias("value"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """Write ``key, line_no, value`` as text, one directory per key, parts in line order."""
    lines.repartitionByRange(key, "line_no").sortWithinPartitions(key, "line_no").select(key, "value").write.mode(mode).partitionBy(key).text(path)
