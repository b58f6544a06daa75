"""Edit lists: CMX3600 and FCPXML (SRC8, SRC9, SNK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import frames_to_timecode, timecode_to_frames

C, L = F.col, F.lit

# The grammar of an event line.
TIME = r"(\d{2}[:;]\d{2}[:;]\d{2}[:;]\d{2,})"
EVENT = rf"^(\d{{3,}})\s+(\S+)\s+([VAB]\d?)\s+([CDWK])(\d*)\s+{TIME}\s+{TIME}\s+{TIME}\s+{TIME}"
TIMES = ("source_in", "source_out", "record_in", "record_out")
#: The place before every event line of a text; blanks of a line do not reach over its end.
HEAD = "(?md)^(?=[ \t\r]*" + EVENT[1:].replace(r"\s", r"[^\S\n]") + ")"


def parse_cmx3600(files: DataFrame, fps: float = 24.0, value: str = "value") -> DataFrame:
    """SRC8: events of CMX3600 texts; comment and speed lines belong to the event above them.

    A text is cut once before every event line, so that each event carries its own lines only and a
    list of any length costs time in proportion to it.
    """
    keep = [c for c in files.columns if c != value]
    clean = lambda text: F.transform(F.split(text, "\n"), lambda x: F.trim(x, L(" \t\r")))
    last = lambda hits: F.get(hits, F.size(hits) - 1)
    title = last(F.filter(clean(C(value)), lambda x: x.startswith("TITLE:")))
    fcm = last(F.filter(clean(C(value)), lambda x: x.startswith("FCM:")))
    out = files.select(
        *keep,
        F.trim(F.substring(title, 7, 2**31 - 1)).alias("title"),
        F.coalesce(F.upper(fcm).contains("DROP"), L(False)).alias("drop_frame"),
        F.explode(F.split(C(value), HEAD)).alias("_piece"),
    )
    # One regular expression per event line: all groups, split on a control character.
    groups = "\u0001".join(f"${i}" for i in range(1, 10))
    out = out.select(*keep, "title", "drop_frame", clean(C("_piece")).alias("_lines")).where(F.get("_lines", L(0)).rlike(EVENT))
    out = out.select(
        *keep,
        "title",
        "drop_frame",
        F.split(F.regexp_replace(F.get("_lines", L(0)), EVENT + ".*$", groups), "\u0001").alias("_f"),
        F.slice("_lines", 2, F.size("_lines")).alias("_tail"),
    )
    out = out.withColumn("_notes", F.transform(F.filter("_tail", lambda x: x.startswith("*")), lambda x: F.trim(F.substring(x, 2, 2**31 - 1))))

    def tagged(tag: str) -> Column:
        return F.trim(F.substring(last(F.filter("_notes", lambda x: x.startswith(tag))), len(tag) + 1, 2**31 - 1))

    plain = F.filter("_notes", lambda x: ~(x.startswith("FROM CLIP NAME:") | x.startswith("SOURCE FILE:") | x.startswith("RESTORATION:")))
    speed = F.filter("_tail", lambda x: x.rlike(r"^M2\s+\S+\s+[\d.]+"))
    part = lambda i: F.get("_f", i - 1)
    return out.select(
        *keep,
        "title",
        "drop_frame",
        part(1).cast("int").alias("event_no"),
        part(2).alias("reel"),
        part(3).alias("track"),
        part(4).alias("transition"),
        F.coalesce(part(5).try_cast("int"), L(0)).alias("transition_frames"),
        *[timecode_to_frames(part(6 + i), fps).alias(n) for i, n in enumerate(TIMES)],
        tagged("FROM CLIP NAME:").alias("clip_name"),
        tagged("SOURCE FILE:").alias("source_file"),
        tagged("RESTORATION:").alias("restoration_json"),
        plain.alias("comments"),
        F.regexp_extract(last(speed), r"^M2\s+\S+\s+([\d.]+)", 1).try_cast("double").alias("speed_pct"),
    )


CLIP = "struct<_ref:string,_name:string,_offset:string,_duration:string,_start:string>"
FCPXML = (
    "resources struct<format:struct<_frameDuration:string>>, "
    "library struct<event:struct<project:struct<sequence:struct<_name:string,"
    f"spine:struct<`asset-clip`:array<{CLIP}>>>>>>"
)


def xml_seconds(text: Column) -> Column:
    """Rational time ``a/bs`` or decimal ``n.nnns``."""
    p = F.split(F.rtrim(text, L("s")), "/")
    den = F.get(p, 1).try_cast("double")
    num = F.get(p, 0).try_cast("double")
    return F.coalesce(F.when(den.isNull(), num).when(den != 0, num / den), L(0.0))


def parse_fcpxml(files: DataFrame, fps: float = 24.0, value: str = "value") -> DataFrame:
    """SRC9: clips of FCPXML texts in spine order, times as frames."""
    keep = [c for c in files.columns if c != value]
    seq = C("_x.library.event.project.sequence")
    out = files.select(*keep, F.from_xml(C(value), FCPXML).alias("_x"))
    out = out.select(*keep, seq["_name"].alias("title"), F.posexplode(seq["spine"]["asset-clip"]).alias("_i", "_c"))
    at, dur, start = (xml_seconds(C(f"_c.{n}")) for n in ("_offset", "_duration", "_start"))
    return out.select(
        *keep,
        "title",
        (C("_i") + 1).alias("event_no"),
        F.coalesce("_c._ref", L("AX")).alias("reel"),
        F.coalesce("_c._name", L("")).alias("clip_name"),
        *[F.floor(t * fps + 1e-6).alias(n) for n, t in zip(TIMES, (start, start + dur, at, at + dur))],
    )


def list_duration(events: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Frames and seconds of every clip list (latest record-out)."""
    return events.groupBy(*keys).agg(F.max("record_out").alias("frames"), (F.max("record_out") / fps).alias("seconds"))


def clip_list(events: DataFrame) -> DataFrame:
    """Distinct reels, black and auxiliary reels left out."""
    return events.where((C("reel") != "") & ~C("reel").isin("BL", "AX")).select("reel").distinct()


def padded(text: Column, width: int) -> Column:
    """Text filled with blanks up to a width; longer text stays whole."""
    return F.concat(text, F.repeat(L(" "), F.greatest(L(width) - F.length(text), L(0))))


def cmx3600_lines(events: DataFrame, keys: list[str], fps: float = 24.0, drop_frame: bool = False) -> DataFrame:
    """SNK4: text lines ``keys, line_no, value`` of CMX3600 lists; header lines come first.

    Every event gives its own block of lines; a list is never gathered in one task. Fields are padded
    to their width and never cut.
    """
    tc = lambda n: frames_to_timecode(C(n), fps, drop_frame)
    dur = F.when(C("transition_frames") > 0, F.format_string("%03d", C("transition_frames").cast("int"))).otherwise("")
    head = F.concat(
        F.format_string("%03d", C("event_no").cast("int")), L("  "), padded(C("reel"), 8), L(" "), padded(C("track"), 6), L(" "), C("transition"), padded(dur, 4), L(" "),
        F.concat_ws(" ", *[tc(n) for n in TIMES]),
    )
    rows = F.array_compact(
        F.concat(
            F.array(
                head,
                F.when(C("clip_name") != "", F.concat(L("* FROM CLIP NAME: "), C("clip_name"))),
                F.when(C("source_file") != "", F.concat(L("* SOURCE FILE: "), C("source_file"))),
                F.when(C("restoration_json") != "", F.concat(L("* RESTORATION: "), C("restoration_json"))),
            ),
            F.transform("comments", lambda c: F.concat(L("* "), c)),
            F.array(F.when(C("speed_pct") != 0, F.format_string("M2   %s       %.1f", C("reel"), C("speed_pct"))), L("")),
        )
    )
    body = events.select(*keys, "event_no", F.posexplode(rows).alias("_i", "value"))
    body = body.select(*keys, (C("event_no").cast("long") * (1 << 20) + C("_i")).alias("line_no"), "value")
    tops = F.array(F.concat(L("TITLE: "), C("title")), L(f"FCM: {'DROP FRAME' if drop_frame else 'NON-DROP FRAME'}"), L(""))
    top = events.select(*keys, "title").distinct().select(*keys, F.posexplode(tops).alias("_i", "value"))
    return top.select(*keys, C("_i").cast("long").alias("line_no"), "value").unionByName(body)


def xml_text(text: Column) -> Column:
    """A text as an XML attribute value."""
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        out = F.replace(out, L(plain), L(entity))
    return out


def fcpxml_lines(events: DataFrame, keys: list[str], fps: float = 24.0) -> DataFrame:
    """SNK4: FCPXML documents as text lines ``keys, line_no, value``: head, one asset a reel, one clip an
    event, tail. Black and auxiliary reels are no assets; a list is never gathered in one task.
    """
    # Frame lengths of the two broadcast rates.
    frame = {29.97: "1001/30000s", 23.976: "1001/24000s"}.get(fps, f"1/{int(fps)}s")
    secs = lambda n: F.concat(F.format_string("%.6f", n / L(float(fps))), L("s"))
    name = xml_text(F.coalesce(F.nullif("clip_name", L("")), "reel"))
    clips = events.select(
        *keys,
        (C("event_no").cast("long") + (1 << 40)).alias("line_no"),
        F.concat(
            L('<asset-clip ref="'), xml_text(C("reel")), L('" name="'), name, L('" offset="'), secs(C("record_in")), L('" duration="'),
            secs(C("record_out") - C("record_in")), L('" start="'), secs(C("source_in")), L('" />'),
        ).alias("value"),
    )
    first = events.where(~C("reel").isin("BL", "AX")).groupBy(*keys, "reel").agg(
        F.min("event_no").alias("_no"), F.min_by(name, "event_no").alias("_name"), F.min_by(xml_text(F.coalesce("source_file", L(""))), "event_no").alias("_src")
    )
    assets = first.select(
        *keys, (C("_no").cast("long") + (1 << 20)).alias("line_no"), F.concat(L('<asset id="'), xml_text(C("reel")), L('" name="'), C("_name"), L('" src="'), C("_src"), L('" />')).alias("value")
    )
    title = xml_text(C("title"))
    frames = F.array(
        F.struct(L(0).cast("long").alias("line_no"), L(f'<fcpxml version="1.10"><resources><format id="r1" frameDuration="{frame}" width="1920" height="1080" />').alias("value")),
        F.struct(L(1 << 39).cast("long").alias("line_no"), F.concat(L('</resources><library><event name="'), title, L('"><project name="'), title, L('"><sequence format="r1"><spine>')).alias("value")),
        F.struct(L(1 << 60).cast("long").alias("line_no"), L("</spine></sequence></project></event></library></fcpxml>").alias("value")),
    )
    around = events.groupBy(*keys).agg(F.max("title").alias("title")).select(*keys, F.explode(frames).alias("_l")).select(*keys, "_l.line_no", "_l.value")
    return around.unionByName(assets).unionByName(clips)
