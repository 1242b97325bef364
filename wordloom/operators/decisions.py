"""One edit from detectors to shots, with feedback: what was to go but still stands in a shot is withdrawn.

Removed words are kept as runs, rows (rush_id, start, end) of word numbers, half open: a recording's set is as many
rows as it has holes, and union, difference and subset are the interval algebra per recording.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators import cuts, disfluency, intervals, retakes, timeline
from wordloom.operators.seams import words_in_shots
from wordloom.operators.splits import split_utterances
from wordloom.tables import cut, sound_unions

#: Kinds of findings whose loss does no harm to a sentence.
BENIGN = cuts.HESITATION


@dataclass(frozen=True)
class EditRules:
    """The middle style; ``mode`` is ``full``, ``silences_only`` (no detector of speech runs) or ``dry_run`` (all is found, nothing applied)."""

    mode: str = "full"
    thresholds: dict[str, float] = field(default_factory=lambda: {"filler": 0.6, "filler_phrase": 0.6, "stutter": 0.6, "abandoned": 0.6, "retake": 0.6, "marker": 0.6, "fragment": 0.62})
    speech_ratio: float = 0.55
    exempt: float = 0.75
    limit_from: int = 60_000
    least_shot: int = 420

    def __post_init__(self) -> None:
        if self.mode not in ("full", "silences_only", "dry_run"):
            raise ValueError(f"no mode {self.mode!r}")


def runs(marked: DataFrame) -> DataFrame:
    """(rush_id, start, end): the words (rush_id, idx) as runs."""
    own = marked.select("rush_id", "idx").distinct()
    own = own.withColumn("g", F.col("idx") - F.row_number().over(W.partitionBy("rush_id").orderBy("idx")))
    return own.groupBy("rush_id", "g").agg(F.min("idx").cast("long").alias("start"), (F.max("idx") + 1).cast("long").alias("end")).drop("g")


def members(sets: DataFrame) -> DataFrame:
    """(rush_id, idx) of runs."""
    own = sets.where("end > start").select("rush_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    return own.withColumn("idx", F.col("idx").cast("int"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    sound_unions(a.sparkSession)
    return intervals.merge(a.unionByName(b), "rush_id")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return intervals.subtract(a, b, "rush_id")


def subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rush_id, inside) of each recording with words in a: whether b has them all."""
    left = difference(a, b).select("rush_id").distinct().withColumn("out", F.lit(True))
    return a.select("rush_id").distinct().join(left, "rush_id", "left").select("rush_id", F.col("out").isNull().alias("inside"))


def hesitations(words: DataFrame, rules: disfluency.DisfluencyRules = disfluency.DisfluencyRules()) -> DataFrame:
    """Findings (rush_id, source, start_ms, end_ms, confidence, words) of hesitations."""
    return disfluency.disfluencies(words, rules).select("rush_id", F.col("kind").alias("source"), "start_ms", "end_ms", "confidence", "words")


def attempts(words: DataFrame) -> DataFrame:
    """Findings of retakes, markers and fragments, whose words are those of their utterances."""
    u = split_utterances(words)
    taken = retakes.retakes(u)
    loose = retakes.fragments(u, taken.where("confidence >= 0.6"))
    found = taken.select("rush_id", "utt_id", F.when(F.col("role") == "marker", "marker").otherwise("retake").alias("source"), "confidence").unionByName(loose.select("rush_id", "utt_id", F.lit("fragment").alias("source"), "confidence"))
    span = F.sequence("first_idx", (F.col("first_idx") + F.col("n_words") - 1).cast("int"))
    own = u.select("rush_id", F.col("utt_id").cast("long").alias("utt_id"), "start_ms", "end_ms", span.alias("words"))
    return found.join(own, ["rush_id", "utt_id"]).select("rush_id", "source", "start_ms", "end_ms", "confidence", "words")


@dataclass(frozen=True)
class Edit:
    """The tables of an edit."""

    removals: DataFrame  # findings with applied, limited and withdrawn
    gaps: DataFrame
    shots: DataFrame  # with the kind of the gap that each follows
    removed: DataFrame  # runs of words
    benign: DataFrame


def edit(words: DataFrame, findings: DataFrame, rules: EditRules = EditRules(), media: DataFrame | None = None) -> Edit:
    """Findings to removals, silences, shots and the withdrawal of removals whose words survive.

    A finding is applied if it is sure enough for its source; of removed speech the least sure are taken back
    beyond the limit. Each step is written once and read by those after it. Gaps around what is left to go are cut, shots of less than ``least_shot`` grow or join, and a
    removal of which any word's centre then lies in a shot is not applied after all; such words leave
    the sets of removed words, and so do they from the benign ones. Shots stay as they are: they hold what survives.
    """
    words = cut(words.select("rush_id", "idx", "text", "start_ms", "end_ms"), "words")
    own = findings.limit(0) if rules.mode == "silences_only" else findings
    own = own.withColumn("id", F.row_number().over(W.partitionBy("rush_id").orderBy("start_ms", "end_ms", "source")))
    own = cuts.decided(own, {k: 2.0 for k in rules.thresholds} if rules.mode == "dry_run" else rules.thresholds)
    own = own.withColumn("duration", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    speech = words.groupBy("rush_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech"))
    heavy = F.col("applied") & F.col("source").isin(*cuts.SPEECH)
    kept = cuts.limited(own.where(heavy).drop("applied"), speech, rules.speech_ratio, rules.exempt, rules.limit_from)
    own = own.join(kept.select("rush_id", "id", F.col("applied").alias("stays")), ["rush_id", "id"], "left").withColumn("limited", ~F.coalesce("stays", F.lit(True)))
    own = own.withColumn("applied", F.col("applied") & ~F.col("limited")).drop("stays")

    own = cut(own, "removals")
    each = own.where("applied").select("rush_id", "id", "source", F.explode("words").alias("idx"))
    removed, benign = cut(runs(each), "removed"), cut(runs(each.where(F.col("source").isin(*BENIGN))), "benign")
    gaps = cut(cuts.silences(words, members(removed), media), "gaps")
    ends = words.groupBy("rush_id").agg(F.max("end_ms").cast("long").alias("total"))
    if media is not None:
        ends = ends.join(media.select("rush_id", F.col("end_ms").alias("m")), "rush_id", "left").select("rush_id", F.greatest("total", F.coalesce("m", F.lit(0))).cast("long").alias("total"))
    base = ends.select("rush_id", F.lit(0).cast("long").alias("start"), F.col("total").alias("end"))
    kept = intervals.subtract(base, gaps.where("cut_start is not null").select("rush_id", F.col("cut_start").alias("start"), F.col("cut_end").alias("end")), "rush_id")
    kept = timeline.long_enough(kept, ends, rules.least_shot)
    order = W.partitionBy("rush_id").orderBy("start")
    length = F.col("end") - F.col("start")
    shots = kept.withColumns({"shot": F.row_number().over(order) - 1, "timeline_start": F.sum(length).over(order) - length})
    why = gaps.where("cut_end is not null").groupBy("rush_id", F.col("cut_end").alias("start")).agg(F.min("kind").alias("after"))
    shots = cut(shots.join(why, ["rush_id", "start"], "left"), "shots")

    still = words_in_shots(words.join(members(removed), ["rush_id", "idx"], "left_semi").select("rush_id", "idx", "start_ms", "end_ms"), shots).select("rush_id", "idx")
    still = cut(still, "still")
    own = cuts.reconciled(own, still).withColumnRenamed("survived", "withdrawn")
    back = runs(still)
    return Edit(own.drop("duration"), gaps, shots, difference(removed, back), difference(benign, back))


def summary(made: Edit) -> DataFrame:
    """(rush_id, shots, final_ms, applied, limited, withdrawn, removed_words, benign_words, removed_sets, after_removed) of each recording."""
    shots = made.shots.groupBy("rush_id").agg(F.count(F.lit(1)).alias("shots"), F.sum(F.col("end") - F.col("start")).alias("final_ms"), F.count_if(F.col("after") == "removed speech").alias("after_removed"))
    found = made.removals.groupBy("rush_id").agg(F.count_if("applied").alias("applied"), F.count_if("limited").alias("limited"), F.count_if("withdrawn").alias("withdrawn"))
    n = lambda d, name: d.groupBy("rush_id").agg(F.sum(F.col("end") - F.col("start")).alias(name), F.count(F.lit(1)).alias(f"{name}_runs"))
    out = shots.join(found, "rush_id", "left").join(n(made.removed, "removed_words"), "rush_id", "left").join(n(made.benign, "benign_words"), "rush_id", "left")
    return out.na.fill(0)
