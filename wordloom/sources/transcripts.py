"""Readers and writers of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.tables import sound_unions

_WORD = "array<struct<text: string, word: string, start: double, `end`: double, probability: double, score: double, language: string>>"
_SCHEMA = f"language string, duration double, segments array<struct<start: double, `end`: double, text: string, language: string, words: {_WORD}>>, words {_WORD}"


#: Suffixes of cue files; all others are JSON.
CUES = (".srt", ".vtt")


def read(spark: SparkSession, path: str, cues: tuple[str, ...] = CUES) -> DataFrame:
    """(rush_id, idx, text, start_ms, end_ms, probability) of the files of a folder, each read as its suffix says; rush_id is the file's path.

    Files come through Spark's readers, from any store that Spark knows, a file at a time. A path without files is an
    error, and so is a file that is not JSON, or a cue file in which no cue has times; the error names the file.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rush_id"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    named = F.lower(F.regexp_extract("rush_id", r"(\.[^./]*)$", 1)).isin(*cues)
    timed = F.when(F.col("value").rlike(r"\d+:\d+:\d+[,.]\d+\s*-->"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no cue has times in "), "rush_id")))
    said = spread(_cues(raw.where(named).withColumn("value", timed)))
    parsed = raw.where(~named).select("rush_id", F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE"}).alias("t"), F.get_json_object("value", "$").alias("ok"))
    fields = ("language", "duration", "segments", "words")
    checked = F.when(F.col("ok").isNull() | F.forall(F.array(*(F.col(f"t.{f}").isNull() for f in fields)), lambda x: x), F.raise_error(F.concat(F.lit("not a transcript: "), "rush_id"))).otherwise(F.col("t"))
    own = _words(parsed.select("rush_id", checked.alias("t")).select("rush_id", "t.*"))
    said = said.withColumn("idx", F.row_number().over(W.partitionBy("rush_id").orderBy("seg_idx", "pos")) - 1)
    sound_unions(spark)
    return own.unionByName(said.select(*own.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(rush_id, idx, text, start_ms, end_ms, probability): words of segments, or of the root if no segment has any."""
    return _words(spark.read.schema(_SCHEMA).option("multiLine", True).json(path).withColumn("rush_id", F.input_file_name()))


def _words(raw: DataFrame) -> DataFrame:
    nested = F.flatten(F.transform(F.coalesce("segments", F.array()), lambda s: F.coalesce(s["words"], F.array())))
    w = raw.select("rush_id", F.posexplode(F.when(F.size(nested) > 0, nested).otherwise(F.coalesce("words", F.array()))).alias("at", "w"))
    text = F.trim(F.coalesce("w.text", "w.word"))
    own = w.select("rush_id", "at", text.alias("text"), F.rint(F.col("w.start") * 1000).cast("long").alias("start_ms"), F.rint(F.col("w.end") * 1000).cast("long").alias("end_ms"), F.coalesce(F.nullif(F.coalesce("w.probability", "w.score"), F.lit(0.0)), F.lit(1.0)).alias("probability"))
    own = own.where("text <> '' and start_ms is not null and end_ms is not null")
    return own.withColumn("idx", F.row_number().over(W.partitionBy("rush_id").orderBy("start_ms", "end_ms", "at")) - 1).drop("at")


def _stamp(c: Column) -> Column:
    part = lambda k: F.regexp_extract(c, r"(\d+):(\d+):(\d+)[,.](\d+)", k).cast("long")
    return part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(rush_id, seg_idx, start_ms, end_ms, text): cues whose times (with hours) stand in the first two lines."""
    return _cues(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("rush_id"), F.regexp_replace("value", "^\ufeff", "").alias("value")))


def _cues(raw: DataFrame) -> DataFrame:
    raw = raw.select("rush_id", F.replace("value", F.lit("\r"), F.lit("")).alias("v"))
    blocks = raw.select("rush_id", F.posexplode(F.split(F.trim("v"), r"\n\s*\n")).alias("seg_idx", "block")).withColumn("lines", F.split("block", "\n"))
    timed = F.when(F.get("lines", F.lit(0)).contains("-->"), 0).when(F.get("lines", F.lit(1)).contains("-->"), 1)
    own = blocks.withColumn("at", timed).where("at is not null").withColumn("sides", F.split(F.get("lines", F.col("at")), "-->"))
    text = F.trim(F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), " "))
    return own.select("rush_id", "seg_idx", _stamp(F.get("sides", F.lit(0))).alias("start_ms"), _stamp(F.get("sides", F.lit(1))).alias("end_ms"), text.alias("text")).where("start_ms is not null and end_ms is not null")


def srt_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_blocks(cues: DataFrame) -> DataFrame:
    """(rush_id, srt): the cues (rush_id, seg_idx, start_ms, end_ms, text) of a recording as one SubRip text."""
    cue = F.struct("seg_idx", F.concat_ws("\n", F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms"))), "text").alias("body"))
    rows = F.transform(F.array_sort(F.collect_list(cue)), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["body"], F.lit("\n")))
    return cues.groupBy("rush_id").agg(F.array_join(rows, "\n").alias("srt"))


def spread(cues: DataFrame) -> DataFrame:
    """(rush_id, seg_idx, pos, text, start_ms, end_ms, probability): cues without words of their own, their time dealt evenly among what blanks part.

    A cue that takes no time gives 250 ms to each; all are half sure.
    """
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    own = cues.withColumn("n", F.size(tokens)).withColumn("step", F.when(F.col("end_ms") > F.col("start_ms"), (F.col("end_ms") - F.col("start_ms")) / F.col("n")).otherwise(250.0))
    at = lambda k: F.col("start_ms") + F.floor(k * F.col("step") + 0.5).cast("long")
    rows = own.where("n > 0").select("rush_id", "seg_idx", "start_ms", "step", F.posexplode(tokens).alias("pos", "word"))
    return rows.select("rush_id", "seg_idx", "pos", F.col("word").alias("text"), at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"), F.lit(0.5).alias("probability"))


def transcript_json(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(rush_id, json): segments (rush_id, seg_idx, start_ms, end_ms, text) with their words (rush_id, seg_idx, idx, text, start_ms, end_ms, probability), times in seconds of four decimals, as ``read_json`` reads them."""
    seconds = lambda c: F.round(F.col(c) / 1000, 4)
    word = F.struct("idx", F.struct("text", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), F.round("probability", 4).alias("probability")).alias("w"))
    said = words.groupBy("rush_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    own = segments.join(said, ["rush_id", "seg_idx"], "left")
    one = F.struct("seg_idx", F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), "text", F.coalesce("words", F.array()).alias("words")).alias("s"))
    out = own.groupBy("rush_id").agg(F.round(F.max("end_ms") / 1000, 4).alias("duration"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    return out.select("rush_id", F.to_json(F.struct(F.lit("wordloom-transcript").alias("format"), F.lit(1).alias("version"), "duration", "segments")).alias("json"))
