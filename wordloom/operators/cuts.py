"""From findings to cuts: silences around removed words, decisions, the limit on removed speech, figures of a recording.

Times are milliseconds. All rules are windows or aggregations over one recording (``rush_id``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.words import GapRules, by_word

#: The part of what a gap keeps that stays before the cut, in hundredths.
KEPT_BEFORE = 55


@dataclass(frozen=True)
class EdgeRules:
    """Milliseconds; the middle style."""

    edge: int = 250
    word_edge: int = 60


def kept_before(kept: Column) -> Column:
    return F.floor(kept * KEPT_BEFORE / 100).cast("long")


def silences(words: DataFrame, removed: DataFrame, media: DataFrame | None = None, rules: GapRules = GapRules(), edges: EdgeRules = EdgeRules()) -> DataFrame:
    """(rush_id, start, end, kind, kept, cut_start, cut_end, holds_removed): the gaps between kept words and at the ends.

    ``removed`` (rush_id, idx) are words that go; ``media`` (rush_id, end_ms) may be longer than the last
    word. A gap around removed words keeps only a margin on either side, taken from the removed speech
    where there is no silence, and less of it where the gap would not be cut otherwise. A recording of
    which no word is kept has no gaps.
    """
    gone = removed.select("rush_id", "idx", F.lit(True).alias("gone")).distinct()
    w = words.select("rush_id", "idx", "text", "start_ms", "end_ms").join(gone, ["rush_id", "idx"], "left")
    w = w.withColumns({"any_end": F.lag("end_ms").over(by_word()), "any_start": F.lead("start_ms").over(by_word()), "last_ms": F.max("end_ms").over(W.partitionBy("rush_id"))})
    w = w.where("gone is null")
    before = {c: F.lag(c).over(by_word()) for c in ("idx", "text", "end_ms", "any_start")}
    w = w.withColumns({f"p_{c}": x for c, x in before.items()}).withColumn("final", F.lead("idx").over(by_word()).isNull())
    if media is None:
        w = w.withColumn("total", F.col("last_ms"))
    else:
        w = w.join(media.select("rush_id", F.col("end_ms").alias("m")), "rush_id", "left").withColumn("total", F.greatest("last_ms", F.coalesce("m", F.lit(0))))
    start, end, d = F.col("p_end_ms"), F.col("start_ms"), F.col("start_ms") - F.col("p_end_ms")
    holds = F.col("idx") != F.col("p_idx") + 1
    free_after = F.greatest(F.lit(0), F.least("p_any_start", end) - start)
    free_before = F.greatest(F.lit(0), end - F.greatest("any_end", start))
    out, into = F.least(F.lit(rules.pad_out), F.greatest(free_after, F.lit(edges.word_edge))), F.least(F.lit(rules.pad_in), F.greatest(free_before, F.lit(edges.word_edge)))
    budget = F.greatest(F.lit(0), d - rules.min_removal)
    tight = out + into > budget
    margin = lambda x: F.when(tight, F.floor(x * budget / (out + into))).otherwise(x).cast("long")
    kind = (
        F.when(holds, "removed speech").when(d <= rules.keep_below, "short").when(d >= rules.long_from, "long")
        .when(T.ends_sentence("p_text"), "sentence").when(T.ends_clause("p_text"), "comma").otherwise("hesitation")
    )
    k = F.col("kind")
    target = F.when(k == "short", d).when(k == "long", rules.long_target).when(k == "sentence", rules.sentence_target).when(k == "comma", rules.comma_target).otherwise(rules.target)
    plain = F.least(d, F.greatest(target, F.least(d, F.lit(rules.pad_in + rules.pad_out))))
    inner = w.where(F.col("p_idx").isNotNull() & (d > 0)).withColumn("kind", kind)
    inner = inner.withColumn("o", F.when(holds, margin(out)).otherwise(kept_before(plain))).withColumn("i", F.when(holds, margin(into)).otherwise(plain - F.col("o")))
    length = d - F.col("o") - F.col("i")
    cut = (length > 0) & (holds | (length >= rules.min_removal))
    inner = inner.select("rush_id", start.alias("start"), end.alias("end"), "kind", F.when(cut, d - length).otherwise(d).alias("kept"), F.when(cut, start + F.col("o")).alias("cut_start"), F.when(cut, end - F.col("i")).alias("cut_end"), holds.alias("holds_removed"))
    inner = inner.where(F.col("cut_start").isNotNull() | (F.col("end") - F.col("start") >= rules.recorded_from) | F.col("holds_removed"))

    def edge(rows: DataFrame, a: Column, b: Column, free: Column, head: bool, holds: Column) -> DataFrame:
        keep = F.least(F.lit(edges.edge), F.greatest(F.lit(0), free)).cast("long")
        first, last = (F.lit(0).cast("long"), F.greatest(F.lit(0), b - keep)) if head else (a + keep, b)
        own = rows.where((b - a > edges.edge + rules.min_removal) & (last - first > rules.min_removal))
        return own.select("rush_id", a.alias("start"), b.alias("end"), F.lit("edge").alias("kind"), keep.alias("kept"), first.alias("cut_start"), last.alias("cut_end"), holds.alias("holds_removed"))

    zero = F.lit(0).cast("long")
    head = edge(w.where("p_idx is null"), zero, F.col("start_ms"), F.col("start_ms") - F.coalesce("any_end", zero), True, F.col("idx") > 0)
    tail = edge(w.where("final"), F.col("end_ms"), F.col("total"), F.coalesce("any_start", "total") - F.col("end_ms"), False, F.col("any_start").isNotNull())
    return reduce(DataFrame.unionByName, [inner, head, tail])


def decided(findings: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``applied``: whether a finding (source, confidence) is sure enough for its source; sources without a threshold are not applied."""
    least = reduce(lambda c, item: c.when(F.col("source") == item[0], item[1]), thresholds.items(), F.when(F.lit(False), 0.0))
    return findings.withColumn("applied", F.coalesce(F.col("confidence") >= least, F.lit(False)))


def all_findings(*parts: DataFrame) -> DataFrame:
    """The findings (rush_id, source, start_ms, end_ms, confidence, words) of all detectors, repeated ones each."""
    return reduce(DataFrame.unionByName, [p.select("rush_id", "source", "start_ms", "end_ms", "confidence", "words") for p in parts])


def limited(removals: DataFrame, speech: DataFrame, ratio: float = 0.55, exempt: float = 0.75, from_ms: int = 60_000) -> DataFrame:
    """Removals (rush_id, id, duration, confidence) with ``applied``: the least sure are taken back, the longest first, until no more than ``ratio`` of the speech goes.

    ``speech`` is (rush_id, speech). Recordings of less speech than ``from_ms`` (or none) have no limit;
    a removal of a confidence of ``exempt`` or more is never taken back.
    """
    own = removals.join(speech.select("rush_id", "speech"), "rush_id", "left")
    order = W.partitionBy("rush_id").orderBy("confidence", F.desc("duration"), "id").rowsBetween(W.unboundedPreceding, -1)
    weak = F.col("confidence") < exempt
    taken = F.coalesce(F.sum(F.when(weak, F.col("duration")).otherwise(0)).over(order), F.lit(0))
    total = F.sum("duration").over(W.partitionBy("rush_id"))
    over = (F.coalesce("speech", F.lit(0)) >= from_ms) & (total - taken > F.floor(F.col("speech") * ratio))
    return own.withColumn("applied", ~(weak & F.coalesce(over, F.lit(False)))).drop("speech")


def reconciled(removals: DataFrame, surviving: DataFrame) -> DataFrame:
    """Applied removals (rush_id, id, words, applied) of which any word still stands in a shot (rush_id, idx) are not applied after all (``survived``)."""
    each = removals.where("applied").select("rush_id", "id", F.explode("words").alias("idx"))
    back = each.join(surviving.select("rush_id", "idx").distinct(), ["rush_id", "idx"], "left_semi").select("rush_id", "id", F.lit(True).alias("survived")).distinct()
    own = removals.join(back, ["rush_id", "id"], "left").withColumn("survived", F.coalesce("survived", F.lit(False)))
    return own.withColumn("applied", F.col("applied") & ~F.col("survived"))


SPEECH, HESITATION = ("retake", "marker", "fragment"), ("filler", "filler_phrase", "stutter", "abandoned")


def statistics(words: DataFrame, shots: DataFrame, gaps: DataFrame, removals: DataFrame) -> DataFrame:
    """A row for each recording: words, shots, durations in the source and the result, what was removed and as what.

    A removal inside another counts in both totals; gaps around removed speech are no silence.
    """
    n = lambda d, *c: d.groupBy("rush_id").agg(*c)
    part = lambda s: F.sum(F.when(F.col("source").isin(*s), F.col("end_ms") - F.col("start_ms")).otherwise(0))
    count = lambda s, name: F.count_if(F.col("source").isin(*s)).alias(name)
    said = n(words, F.count(F.lit(1)).alias("words"), F.max("end_ms").alias("source_ms"))
    cut = n(shots, F.count(F.lit(1)).alias("shots"), F.sum(F.col("end") - F.col("start")).alias("final_ms"))
    still = n(gaps.where("kind <> 'removed speech'"), F.sum(F.coalesce(F.col("cut_end") - F.col("cut_start"), F.lit(0))).alias("silence_ms"))
    gone = n(removals.where("applied"), part(SPEECH).alias("speech_ms"), part(HESITATION).alias("hesitation_ms"), count(HESITATION, "hesitations"), count(("retake",), "retakes"), count(("marker",), "markers"), count(("fragment",), "fragments"))
    out = reduce(lambda a, b: a.join(b, "rush_id", "left"), [said, cut, still, gone]).na.fill(0)
    return out.withColumn("cuts", F.greatest(F.lit(0), F.col("shots") - 1)).withColumn("compression", F.round(F.try_divide("final_ms", "source_ms"), 4))
