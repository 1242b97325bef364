"""Words on a clock, utterances, gaps: windows over one recording at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.audio import is_breath

def by_word():
    """One recording at a time, in order of words."""
    return W.partitionBy("rush_id").orderBy("idx")


@dataclass(frozen=True)
class GapRules:
    """Milliseconds; the middle style."""

    keep_below: int = 300
    target: int = 220
    long_from: int = 950
    long_target: int = 300
    sentence_target: int = 340
    comma_target: int = 200
    pad_in: int = 70
    pad_out: int = 120
    min_removal: int = 90
    recorded_from: int = 120
    breath_max: int = 550
    breath_keep: int = 320


def gap_before(rush: Column, seg: Column, pos: Column, previous: Column) -> Column:
    """The adapter's gap before a word: whole milliseconds from its place, so that every engine agrees."""
    last = F.right(previous, F.lit(1))
    return (
        F.when(previous.isNull(), 500)
        .when(pos == 0, 200 + (31 * rush + 17 * seg) % 1500)
        .when(last.isin(".", "!", "?"), 250 + (13 * rush + 7 * seg + 11 * pos) % 1300)
        .when(last.isin(",", ";", ":"), 150 + (13 * rush + 7 * seg + 11 * pos) % 600)
        .when((rush + 29 * pos) % 23 == 0, 320 + (7 * rush + 11 * pos) % 900)
        .otherwise(35)
    )


def word_clock(segments: DataFrame) -> DataFrame:
    """(rush_id, seg_idx, idx, text, norm, start_ms, end_ms) from (rush_id, seg_idx, text): 115 ms a word and 52 a character."""
    w = segments.select("rush_id", "seg_idx", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "text")).where("text <> ''")
    order = W.partitionBy("rush_id").orderBy("seg_idx", "pos")
    w = w.withColumn("idx", F.row_number().over(order) - 1)
    w = w.withColumn("gap", gap_before(F.col("rush_id"), F.col("seg_idx"), F.col("pos"), F.lag("text").over(order)))
    w = w.withColumn("dur", 115 + 52 * F.char_length("text"))
    w = w.withColumn("end_ms", F.sum(F.col("gap") + F.col("dur")).over(order))
    return w.select("rush_id", "seg_idx", "idx", "text", T.normalize_word("text").alias("norm"), (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def with_breaks(words: DataFrame, break_gap: int = 620, hard_gap: int = 1150) -> DataFrame:
    """``gap`` to the word before and the ``reason`` of a break there (null: none)."""
    w = words.withColumn("_p", F.lag("text").over(by_word())).withColumn("gap", F.greatest(F.lit(0), F.col("start_ms") - F.lag("end_ms").over(by_word())))
    reason = (
        F.when(F.col("_p").isNull(), "start")
        .when(T.ends_sentence("_p"), "sentence")
        .when(T.ends_suspension("_p"), "suspension")
        .when(F.col("gap") >= hard_gap, "long_gap")
        .when(F.col("gap") >= break_gap, "gap")
        .when(T.is_truncated("_p") & (F.col("gap") >= 120), "truncated")
    )
    return w.withColumn("reason", reason).drop("_p")


def with_utterances(words: DataFrame, most: int = 48) -> DataFrame:
    """Each word with the ``run`` and ``part`` of its utterance."""
    w = with_breaks(words).withColumn("run", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(by_word()))
    within = W.partitionBy("rush_id", "run").orderBy("idx")
    return w.withColumn("part", F.floor((F.row_number().over(within) - 1) / most))


def utterances(words: DataFrame, most: int = 48) -> DataFrame:
    """Sessions of words; a session of more than ``most`` words is cut after every ``most``."""
    w = with_utterances(words, most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    out = w.groupBy("rush_id", "run", "part").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min_by("reason", "idx").alias("reason"), text.alias("text"),
    )
    order = W.partitionBy("rush_id").orderBy("first_idx")
    out = out.withColumn("utt_id", F.row_number().over(order) - 1).withColumn("reason", F.when(F.col("part") > 0, "length").otherwise(F.col("reason")))
    out = out.withColumn("gap_before", F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order), F.col("start_ms")))
    out = out.withColumn("gap_after", F.coalesce(F.lead("start_ms").over(order) - F.col("end_ms"), F.lit(0)))
    return out.select("rush_id", "utt_id", "first_idx", "n_words", "start_ms", "end_ms", "reason", "gap_before", "gap_after", "text")


def dominant(words: DataFrame, keys: list[str], value: str = "language") -> DataFrame:
    """(keys, value): the commonest value of each group, the one that comes first (by ``idx``) on ties; groups without any have none.

    Counts and first places are merged by partial aggregation, so a group of any size is no single task's.
    """
    n = words.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("early"))).alias(value))


def gaps(words: DataFrame, rules: GapRules = GapRules()) -> DataFrame:
    """Each gap between words, its kind, and what of it is kept (no removed words).

    Where words have ``energy`` (0 to 1, of the gap before them), a short gap of some is a ``breath``.
    """
    w = words.withColumn("_p", F.lag("text").over(by_word())).withColumn("start", F.lag("end_ms").over(by_word()))
    w = w.where(F.col("_p").isNotNull()).withColumn("d", F.col("start_ms") - F.col("start")).where("d > 0")
    short, long = F.col("d") <= rules.keep_below, F.col("d") >= rules.long_from
    breath = is_breath(F.col("energy")) & (F.col("d") <= rules.breath_max) if "energy" in words.columns else F.lit(False)
    kind = F.when(breath, "breath").when(short, "short").when(long, "long").when(T.ends_sentence("_p"), "sentence").when(T.ends_clause("_p"), "comma").otherwise("hesitation")
    w = w.withColumn("kind", kind)
    target = (
        F.when(F.col("kind") == "short", F.col("d")).when(F.col("kind") == "long", rules.long_target).when(F.col("kind") == "sentence", rules.sentence_target)
        .when(F.col("kind") == "comma", rules.comma_target).when(F.col("kind") == "breath", F.greatest(F.lit(rules.target), F.least(F.col("d"), F.lit(rules.breath_keep)))).otherwise(rules.target)
    )
    kept = F.least(F.col("d"), F.greatest(target, F.least(F.col("d"), F.lit(rules.pad_in + rules.pad_out))))
    w = w.withColumn("removed", F.when(F.col("d") - kept >= rules.min_removal, F.col("d") - kept).otherwise(0))
    w = w.where((F.col("removed") > 0) | (F.col("d") >= rules.recorded_from))
    return w.select("rush_id", "idx", "start", F.col("start_ms").alias("end"), F.col("d").alias("duration"), "kind", (F.col("d") - F.col("removed")).alias("kept"), "removed")


def gap_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("removed").alias("removed_ms"), F.sum("duration").alias("duration_ms"))
