"""Checks of the joints between shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import markers as M
from wordloom.functions import text as T
from wordloom.functions import vocabulary as V
from wordloom.operators.timeline import to_timeline


def words_in_shots(words: DataFrame, shots: DataFrame) -> DataFrame:
    """The words with the shot their centre lies in (closed bounds); the others are left out. Shots don't touch.

    One as-of window over starts and centres, so no pairs of words and shots are made.
    """
    at = shots.select("rush_id", (2 * F.col("start")).alias("t"), F.lit(0).alias("kind"), F.struct("shot", "end").alias("s"))
    own = words.select("rush_id", (F.col("start_ms") + F.col("end_ms")).alias("t"), F.lit(1).alias("kind"), F.struct(*(c for c in words.columns if c not in ("rush_id", "start_ms", "end_ms"))).alias("w"))
    order = W.partitionBy("rush_id").orderBy("t", "kind")
    both = at.unionByName(own, allowMissingColumns=True).withColumn("hit", F.last("s", ignorenulls=True).over(order))
    return both.where("w is not null and t <= 2 * hit.end").select("rush_id", "w.*", F.col("hit.shot").alias("shot"))


def seams(shots: DataFrame, words: DataFrame, removed: DataFrame, benign: DataFrame, short: int = 550, apart: int = 750) -> DataFrame:
    """(rush_id, shot, category, severity) of doubtful joints and very short shots.

    Shots have (rush_id, shot, start, end); removed and benign (rush_id, idx) are words that were cut,
    the benign ones (fillers) without harm to the sentence.
    """
    mark = lambda d, name: d.select("rush_id", "idx", F.lit(True).alias(name)).distinct()
    w = words.select("rush_id", "idx", "text", "norm", "start_ms", "end_ms").join(mark(removed, "gone"), ["rush_id", "idx"], "left").join(mark(benign, "light"), ["rush_id", "idx"], "left")
    w = w.withColumn("r", F.count_if(F.col("light").isNull()).over(W.partitionBy("rush_id").orderBy("idx"))).where("gone is null").drop("gone", "light")
    said = F.array_sort(F.collect_list(F.struct("idx", "norm", "text", "r")))
    held = words_in_shots(w, shots).groupBy("rush_id", "shot").agg(said.alias("said"))
    own = shots.select("rush_id", "shot", "start", "end").join(held, ["rush_id", "shot"], "left")
    order = W.partitionBy("rush_id").orderBy("shot")
    own = own.withColumn("before", F.lag("said").over(order)).withColumn("took", F.lag(F.col("end") - F.col("start")).over(order))
    last, first = F.try_element_at("before", F.lit(-1)), F.try_element_at("said", F.lit(1))
    own = own.withColumn("last", last).withColumn("first", first)
    harmed = F.coalesce(F.col("first.r") - F.col("last.r") > 1, F.lit(False))  # words but benign ones lie between
    open_end = harmed & ~T.ends_sentence(F.col("last.text"))
    names = lambda c, a, n: M.content_words(F.transform(F.slice(c, a, n), lambda x: x["norm"]))
    tail = names(F.col("before"), F.greatest(F.lit(1), F.size("before") - 3), F.lit(4))
    broken = F.when(open_end & F.col("last.norm").isin(*V.DANGLING), "dangling end").when(open_end & F.col("first.norm").isin(*V.CANNOT_START), "awkward start")
    checks = {
        "broken": F.struct(broken.alias("category"), F.lit("medium").alias("severity"), F.col("shot").alias("at")),
        "repeated": F.struct(F.when(harmed & F.arrays_overlap(tail, names(F.col("said"), F.lit(1), F.lit(4))), "repeated word").alias("category"), F.lit("low").alias("severity"), F.col("shot").alias("at")),
        "close": F.struct(F.when((F.col("shot") >= 2) & F.col("said").isNotNull() & F.col("before").isNotNull() & (F.col("took") < apart), "close cuts").alias("category"), F.lit("low").alias("severity"), (F.col("shot") - 1).alias("at")),
        "short": F.struct(F.when(F.col("end") - F.col("start") < short, "short shot").alias("category"), F.lit("low").alias("severity"), F.col("shot").alias("at")),
    }
    found = own.select("rush_id", F.explode(F.array(*checks.values())).alias("c")).where("c.category is not null")
    return found.select("rush_id", F.col("c.at").alias("shot"), "c.category", "c.severity")


def utterance_checks(utterances: DataFrame, words: DataFrame, shots: DataFrame, removed: DataFrame) -> DataFrame:
    """(rush_id, utt_id, t, timeline_t, category, severity) of utterances that should not have been left, or not so.

    ``kept marker``: a marker of correction of which any word stays, at its start; ``empty rest``: one of
    which only function words stay, at the first of them. Times that are in no shot give nothing.
    """
    gone = removed.select("rush_id", "idx", F.lit(True).alias("gone")).distinct()
    own = M.with_marks(utterances).select("rush_id", "utt_id", F.col("start_ms").alias("began"), "marker", "n_words", F.explode(F.sequence("first_idx", F.col("first_idx") + F.col("n_words") - 1)).alias("idx"))
    own = own.join(words.select("rush_id", "idx", "text", "start_ms"), ["rush_id", "idx"]).join(gone, ["rush_id", "idx"], "left_anti")
    kept = own.groupBy("rush_id", "utt_id", "began", "marker", "n_words").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "text"))).alias("kept"))
    said = T.normalize_text(F.array_join(F.transform("kept", lambda w: F.trim(w["text"])), " "))
    kept = kept.withColumn("said", said)
    rest = (F.size("kept") < F.col("n_words")) & (F.size(M.content_words(F.filter(F.split("said", " "), lambda w: w != ""))) == 0) & ~M.standalone_marker(F.col("said"))
    found = F.array(
        F.struct(F.when(F.col("marker"), "kept marker").alias("category"), F.lit("high").alias("severity"), F.col("began").alias("t")),
        F.struct(F.when(rest, "empty rest").alias("category"), F.lit("medium").alias("severity"), F.element_at("kept", 1)["start_ms"].alias("t")),
    )
    found = kept.select("rush_id", "utt_id", F.explode(found).alias("c")).where("c.category is not null").select("rush_id", "utt_id", "c.t", "c.category", "c.severity")
    return to_timeline(found, shots).where("timeline_t is not null").select("rush_id", "utt_id", "t", "timeline_t", "category", "severity")
