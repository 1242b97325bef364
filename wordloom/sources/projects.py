"""Edits as files of other programs: a project in XMEML (version 5) and a JSON of all decisions.

One text for each recording; frames are whole, rates are those of ``numbers.frame_rate``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.numbers import TICKS, path_url


@dataclass(frozen=True)
class Media:
    """What a sequence has of its source."""

    base: int = 25
    slowed: bool = False
    width: int = 1920
    height: int = 1080
    sample_rate: int = 48000
    channels: int = 2
    focus: tuple[float, float] = (0.5, 0.5)
    crossfade: int = 4
    fade: int = 1
    in_source: bool = True

    @property
    def fps(self) -> float:
        return self.base * 1000 / 1001 if self.slowed else float(self.base)


def tag(name: str, *inner: Column | str, **attributes: str | Column) -> Column:
    """An element; plain strings and columns are its content as they are, nulls nothing."""
    head = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        head += [F.lit(f' {key}="'), value if isinstance(value, Column) else F.lit(value), F.lit('"')]
    body = [F.coalesce(x.cast("string"), F.lit("")) if isinstance(x, Column) else F.lit(x) for x in inner]
    return F.concat(*head, F.lit(">"), *body, F.lit(f"</{name}>"))


def escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def rate(media: Media) -> Column:
    return tag("rate", tag("timebase", str(media.base)), tag("ntsc", str(media.slowed).upper()))


def transitions(clips: DataFrame, frames: Column, crossfade: int) -> DataFrame:
    """Clips (rush_id, shot, in_frame, out_frame, start_frame) with ``joined``: whether a cross-fade lies on the cut before them, and ``fades``.

    It needs media on both sides for half its length, and clips longer than it. A clip with none on
    either side fades by its level.
    """
    half, order, length = max(1, crossfade // 2), W.partitionBy("rush_id").orderBy("shot"), F.col("out_frame") - F.col("in_frame")
    fits = (F.lag("out_frame").over(order) + half <= frames) & (F.col("in_frame") >= half) & (F.lag(length).over(order) > 2 * half) & (length > 2 * half)
    own = clips.withColumn("joined", F.coalesce(fits, F.lit(False)) if crossfade > 0 else F.lit(False))
    return own.withColumn("fades", ~F.col("joined") & ~F.coalesce(F.lead("joined").over(order), F.lit(False)))


def keyframe_frames(points: Column, in_frame: Column, out_frame: Column, media: Media) -> Column:
    """Keyframes (t in seconds of the shot, v) as (when, v): frames of the source or of the clip, within the clip."""
    first = in_frame if media.in_source else F.lit(0)
    last = first + out_frame - in_frame
    when = lambda t: F.greatest(first, F.least(last, first + F.rint(t * media.fps).cast("long")))
    return F.transform(points, lambda p: F.struct(when(p["t"]).alias("when"), p["v"].alias("v")))


def centre(scale: Column, focus: tuple[float, float]) -> Column:
    """How far the picture moves so that its focus stays where it is at a scale in per cent."""
    away = 1 - scale / 100
    return F.struct((away * (focus[0] - 0.5)).alias("horiz"), (away * (focus[1] - 0.5)).alias("vert"))


def _all(items: Column, f) -> Column:
    return F.array_join(F.transform(items, f), "")


def _effect(name: str, code: str, category: str, kind: str, *parameters: Column) -> Column:
    labels = tag("name", name), tag("effectid", code), tag("effectcategory", category), tag("effecttype", category), tag("mediatype", kind), tag("pproBypass", "false")
    return tag("filter", tag("effect", *labels, *parameters))


def _motion(media: Media) -> Column:
    number = lambda c: F.format_string("%.4f", c)
    place = lambda s: (lambda p: tag("value", tag("horiz", F.format_string("%.6f", p["horiz"])), tag("vert", F.format_string("%.6f", p["vert"]))))(centre(s, media.focus))
    still = F.when(F.col("kind") == "direct", F.col("end_scale")).otherwise(F.col("start_scale"))
    parameter = lambda code, name, *inner: tag("parameter", tag("parameterid", code), tag("name", name), *inner, authoringApp="PremierePro")
    fixed = tag("value", tag("horiz", "0"), tag("vert", "0"))
    scale = parameter("scale", "Scale", tag("valuemin", "0"), tag("valuemax", "1000"), tag("value", number(still)), _all(F.col("frames"), lambda k: tag("keyframe", tag("when", k["when"]), tag("value", number(k["v"])))))
    turn = parameter("rotation", "Rotation", tag("valuemin", "-8640"), tag("valuemax", "8640"), tag("value", "0"))
    if all(abs(f - 0.5) < 1e-6 for f in media.focus):
        moved = fixed
    else:
        moved = F.when(F.size("frames") == 0, place(F.col("end_scale"))).otherwise(_all(F.col("frames"), lambda k: tag("keyframe", tag("when", k["when"]), place(k["v"]))))
    return F.when(F.col("kind").isNotNull(), _effect("Basic Motion", "basic", "motion", "video", scale, turn, parameter("center", "Center", moved), parameter("centeroffset", "Anchor Point", fixed)))


def _fade(media: Media) -> Column:
    length = F.col("out_frame") - F.col("in_frame")
    first = F.col("in_frame") if media.in_source else F.lit(0)
    fade = F.least(F.lit(media.fade), F.greatest(F.lit(1), F.floor(length / 3)))
    points = ((first, "0.0000"), (first + fade, "1.0000"), (first + F.greatest(fade, length - fade), "1.0000"), (first + length, "0.0000"))
    level = tag("parameter", tag("parameterid", "level"), tag("name", "Level"), tag("valuemin", "0"), tag("valuemax", "3.98109"), *(tag("keyframe", tag("when", at), tag("value", v)) for at, v in points))
    return F.when(F.col("fades") & F.lit(media.fade > 0), _effect("Audio Levels", "audiolevels", "audiolevels", "audio", level))


def project_xml(clips: DataFrame, zooms: DataFrame, sources: DataFrame, media: Media = Media()) -> DataFrame:
    """(rush_id, xml): the clips of each recording as a sequence.

    ``zooms`` are rows of ``zoom_plan.zooms``; ``sources`` is (rush_id, path, frames). Clips are named and
    linked across one video and ``channels`` audio tracks; the file is described at its first use.
    """
    own = clips.join(sources.select("rush_id", "path", F.col("frames").alias("media_frames")), "rush_id")
    own = transitions(own, F.col("media_frames"), media.crossfade)
    own = own.join(zooms.select("rush_id", "shot", "kind", "start_scale", "end_scale", "keyframes"), ["rush_id", "shot"], "left")
    own = own.withColumn("frames", keyframe_frames(F.coalesce("keyframes", F.array().cast("array<struct<t: double, v: double>>")), F.col("in_frame"), F.col("out_frame"), media))
    ticks = lambda frame: F.rint(frame * (TICKS / media.fps)).cast("long")
    name = escaped(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    number, length = F.col("shot") + 1, F.col("out_frame") - F.col("in_frame")
    tracks = ["v", *(f"a{k}" for k in range(1, media.channels + 1))]
    item = lambda track: F.concat(F.lit(f"clipitem-{track}-"), number.cast("string"))
    sound = tag("audio", tag("samplecharacteristics", tag("depth", "16"), tag("samplerate", str(media.sample_rate))), tag("channelcount", str(media.channels)))
    picture = tag("video", tag("samplecharacteristics", rate(media), tag("width", str(media.width)), tag("height", str(media.height)), tag("pixelaspectratio", "square"), tag("anamorphic", "FALSE")))
    file = tag("file", tag("name", name), tag("pathurl", escaped(path_url(F.col("path")))), rate(media), tag("duration", F.col("media_frames")), tag("media", picture, sound), id="file-1")
    links = [tag("link", tag("linkclipref", item(t)), tag("mediatype", "video" if t == "v" else "audio"), tag("trackindex", "1" if t == "v" else t[1:]), tag("clipindex", number)) for t in tracks]

    def clip(track: str) -> Column:
        described = F.when(F.col("shot") == 0, file).otherwise(F.lit('<file id="file-1"/>')) if track == "v" else F.lit('<file id="file-1"/>')
        times = tag("start", F.col("start_frame")), tag("end", F.col("start_frame") + length), tag("in", F.col("in_frame")), tag("out", F.col("out_frame"))
        exact = tag("pproTicksIn", ticks(F.col("in_frame"))), tag("pproTicksOut", ticks(F.col("out_frame")))
        source = () if track == "v" else (tag("sourcetrack", tag("mediatype", "audio"), tag("trackindex", track[1:])),)
        return tag("clipitem", tag("name", name), tag("enabled", "TRUE"), tag("duration", F.col("media_frames")), rate(media), *times, *exact, described, *source, _motion(media) if track == "v" else _fade(media), *links, id=item(track))

    half = max(1, media.crossfade // 2)
    cross = tag("effect", tag("name", "Cross Fade (+3dB)"), tag("effectid", "KGAudioTransitionCurves"), tag("effectcategory", "Dissolve"), tag("effecttype", "transition"), tag("mediatype", "audio"), tag("wipecode", "0"), tag("wipeaccuracy", "100"), tag("startratio", "0"), tag("endratio", "1"), tag("reverse", "FALSE"))
    joint = tag("transitionitem", rate(media), tag("start", F.col("start_frame") - half), tag("end", F.col("start_frame") + half), tag("alignment", "center"), tag("cutPointTicks", ticks(F.col("start_frame"))), cross)
    before = F.when(F.col("joined"), joint).otherwise("")
    rows = own.select("rush_id", "path", "shot", length.alias("length"), *((clip(t) if t == "v" else F.concat(before, clip(t))).alias(t) for t in tracks))
    whole = rows.groupBy("rush_id").agg(F.max("path").alias("path"), F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("shot", *tracks))).alias("c"))
    track = lambda t: tag("track", _all(F.col("c"), lambda x: x[t]))
    shape = tag("format", tag("samplecharacteristics", rate(media), tag("width", str(media.width)), tag("height", str(media.height)), tag("pixelaspectratio", "square"), tag("fielddominance", "none")))
    audio = tag("audio", tag("numOutputChannels", str(media.channels)), tag("format", tag("samplecharacteristics", tag("depth", "16"), tag("samplerate", str(media.sample_rate)))), *(track(t) for t in tracks[1:]))
    sequence = tag("sequence", tag("name", name), tag("duration", F.col("length")), rate(media), tag("media", tag("video", shape, track("v")), audio), id="sequence-1")
    return whole.select("rush_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n'), tag("xmeml", sequence, version="5"), F.lit("\n")).alias("xml"))


def read_decisions(spark: SparkSession, path: str, **parts: str) -> dict[str, DataFrame]:
    """The tables that ``decisions_json`` wrote, named (one text a file or line), by name; parts name their columns (DDL, without rush_id).

    A text that is no such edit, or of another version, is an error that names the file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    shape = "format string, format_version int, rush_id long, " + ", ".join(f"{n} array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in ddl.split(','))}>>" for n, ddl in parts.items())
    own = raw.select("file", F.from_json("value", shape).alias("t"))
    right = F.coalesce((F.col("t.format") == "wordloom-edit") & (F.col("t.format_version") == 2), F.lit(False))
    own = own.select(F.when(right, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("no edit of version 2: "), "file"))).alias("t"))
    return {n: own.select("t.rush_id", F.inline(f"t.{n}")) for n in parts}


def decisions_json(named: bool = False, /, **parts: DataFrame) -> DataFrame:
    """(rush_id, json): the rows of the named tables (rush_id and more), in order of their columns, under their names; format version 2. ``named`` texts hold rush_id too, which ``read_decisions`` asks for."""
    out = None
    for name, rows in parts.items():
        own = rows.groupBy("rush_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "rush_id")))).alias(name))
        out = own if out is None else out.join(own, "rush_id", "full")
    body = F.struct(F.lit("wordloom-edit").alias("format"), F.lit(2).alias("format_version"), *(["rush_id"] if named else []), *(F.coalesce(F.col(n), F.array()).alias(n) for n in parts))
    return out.select("rush_id", F.to_json(body).alias("json"))
