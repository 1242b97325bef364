"""Detectors of hesitations, repeated words, abandoned words and stock phrases.

Each of ``hard_fillers``, ``soft_fillers``, ``stutter_runs``, ``abandoned_words`` and ``phrase_hits`` says what SQL can
say of one kind alone. ``disfluencies`` is the whole: all kinds in order within an utterance, where what is found masks
what comes later.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import lexicon as L
from wordloom.functions import text as T
from wordloom.functions import vocabulary as V
from wordloom.functions.numbers import word_stem
from wordloom.operators.words import by_word, with_utterances


@dataclass(frozen=True)
class DisfluencyRules:
    """Milliseconds; the middle style."""

    soft: bool = False
    longest_filler: int = 1200
    stutter_gap: int = 900
    longest_group: int = 3
    most_removed: int = 4
    least_stem: int = 2
    longest_abandoned: int = 850
    truncated_gap: int = 600
    abandoned_gap: int = 250


def hard_fillers(words: DataFrame, longest: int = 1200) -> DataFrame:
    own = words.where(F.col("norm").isin(*L.HARD_FILLERS) & (F.col("end_ms") - F.col("start_ms") <= longest))
    return own.select("rush_id", "idx", "norm", F.when(F.char_length("norm") <= 4, 0.95).otherwise(0.88).alias("confidence"))


def within_utterances(words: DataFrame):
    """The words with their utterance (run, part), and a window over one utterance in order of words."""
    return with_utterances(words), W.partitionBy("rush_id", "run", "part").orderBy("idx")


def soft_fillers(words: DataFrame, longest: int = 1200) -> DataFrame:
    """Only beside a hard filler of the same utterance or after a gap of 200 ms; a dash or apostrophe at the end does not matter."""
    w, own = within_utterances(words)
    hard = lambda c: F.coalesce(c.isin(*L.HARD_FILLERS), F.lit(False))
    w = w.withColumn("near", hard(F.lag("norm").over(own)) | hard(F.lead("norm").over(own)))
    w = w.withColumn("gap", F.col("start_ms") - F.coalesce(F.lag("end_ms").over(by_word()), F.lit(0)))
    soft = F.col("norm").isin(*L.SOFT_FILLERS) | word_stem(F.col("norm")).isin(*L.SOFT_FILLERS)
    w = w.where(soft & ~F.col("norm").isin(*L.HARD_FILLERS) & (F.col("near") | (F.col("gap") >= 200)) & (F.col("end_ms") - F.col("start_ms") <= longest))
    return w.select("rush_id", "idx", "norm", F.lit(0.64).alias("confidence"))


def stutter_runs(words: DataFrame, most_gap: int = 900) -> DataFrame:
    """Runs of one word said again and again in one utterance; all but the last go. Intensifiers and grammatical doubles are meant."""
    w, own = within_utterances(words)
    same = (F.col("norm") == F.lag("norm").over(own)) & (F.col("start_ms") - F.lag("end_ms").over(own) <= most_gap)
    w = w.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("again", F.sum("new").over(own))
    runs = w.groupBy("rush_id", "run", "part", "again").agg(F.first("norm").alias("norm"), F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))
    meant = [*L.INTENSIFIERS, *L.GRAMMATICAL_DOUBLES]
    return runs.where((F.col("n") > 1) & (F.col("norm") != "") & ~F.col("norm").isin(*meant)).select("rush_id", "first_idx", "norm", "n")


def abandoned_words(words: DataFrame) -> DataFrame:
    """A word that the next one of the utterance begins with: marked as cut off, ``compe- competition``, or short and said at once."""
    w, own = within_utterances(words)
    w = w.withColumn("target", F.lead("norm").over(own)).withColumn("gap", F.lead("start_ms").over(own) - F.col("end_ms")).withColumn("stem", word_stem(F.col("norm")))
    n, m = F.char_length("stem"), F.char_length("target")
    w = w.where((F.col("end_ms") - F.col("start_ms") <= 850) & (n >= 2) & F.col("target").startswith(F.col("stem")) & (m > n))
    marked = T.is_truncated(T.opened("text"))
    quick = (F.col("gap") <= 250) & (n <= 5) & (m >= n + 2) & ~F.col("stem").isin(*sorted(_COMMON))
    w = w.withColumn("confidence", F.when(marked & (F.col("gap") <= 600), 0.93).when(~marked & quick, 0.66)).where("confidence is not null")
    return w.select("rush_id", "idx", "norm", "target", "confidence")


def phrase_hits(words: DataFrame, phrases: tuple[str, ...] = L.FILLER_PHRASES) -> DataFrame:
    """Where a stock phrase of several words starts in an utterance that has other words; the first of the list that fits."""
    w, own = within_utterances(words)
    longest = max(len(p.split()) for p in phrases)
    said = F.count_if(F.col("norm") != "").over(W.partitionBy("rush_id", "run", "part"))
    ahead = [F.lead("norm", k).over(own).alias(f"w{k}") if k else F.col("norm").alias("w0") for k in range(longest)]
    w = w.select("rush_id", "idx", said.alias("said"), *ahead)
    test = lambda p: reduce(lambda a, b: a & b, [F.col(f"w{k}") == x for k, x in enumerate(p.split())]) & (F.col("said") > len(p.split()))
    found = F.coalesce(*(F.when(test(p), F.lit(p)) for p in phrases))
    return w.withColumn("phrase", found).where("phrase is not null").select("rush_id", "idx", "phrase")


def distinct_phrases(phrases: tuple[str, ...]) -> list[list[str]]:
    """The phrases as words; an error if one can begin inside another, for then the choice of one would bar the other."""
    words = [p.split() for p in phrases]
    for a in words:
        for b in words:
            if any(a[k : k + len(b)] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError(f"{' '.join(b)!r} can begin inside {' '.join(a)!r}")
    return words


def disfluencies(words: DataFrame, rules: DisfluencyRules = DisfluencyRules(), phrases: tuple[str, ...] = L.FILLER_PHRASES) -> DataFrame:
    """(rush_id, kind, words, start_ms, end_ms, confidence, text, kept_text): the ``idx`` of the words that go, and what stays in their place.

    Each kind masks the ones after it. All that can be told of a word and its neighbours is a window column;
    one aggregation gathers an utterance with its few candidates, and only utterances that have several candidates
    of repeats go through a fold that lets the longest group and then the earliest bar the others.
    """
    u = ("rush_id", "run", "part")
    of, order = W.partitionBy(*u), W.partitionBy(*u).orderBy("idx")
    own = with_utterances(words.select("rush_id", "idx", "text", "norm", "start_ms", "end_ms"))
    own = own.withColumn("before", F.col("start_ms") - F.coalesce(F.lag("end_ms").over(by_word()), F.lit(0)))

    known = distinct_phrases(phrases)
    longest = max(map(len, known))
    ahead = [F.lead("norm", k).over(order) if k else F.col("norm") for k in range(longest)]
    own = own.withColumns({"k": F.row_number().over(order) - 1, "said": F.count_if(F.col("norm") != "").over(of), **{f"w{k}": c for k, c in enumerate(ahead)}})
    fits = lambda p: reduce(lambda a, b: a & b, [F.col(f"w{k}") == x for k, x in enumerate(p)]) & (F.col("said") > len(p))
    own = own.withColumn("phrase", F.coalesce(*(F.when(fits(p), len(p)) for p in known), F.lit(0)))
    own = own.withColumn("in_phrase", F.max(F.col("k") + F.col("phrase")).over(order.rowsBetween(1 - longest, 0)) > F.col("k"))

    hard = lambda c: F.coalesce(c.isin(*L.HARD_FILLERS), F.lit(False))
    is_hard, quick = hard(F.col("norm")), F.col("end_ms") - F.col("start_ms") <= rules.longest_filler
    filler = F.when(is_hard, F.when(F.char_length("norm") <= 4, 0.95).otherwise(0.88))
    if rules.soft:
        soft = F.col("norm").isin(*L.SOFT_FILLERS) | word_stem(F.col("norm")).isin(*L.SOFT_FILLERS)
        beside = hard(F.lag("norm").over(order)) | hard(F.lead("norm").over(order)) | (F.col("before") >= 200)
        filler = F.coalesce(filler, F.when(soft & beside, 0.64))
    own = own.withColumn("filler", F.when(~F.col("in_phrase") & quick, filler))
    own = own.withColumn("masked", F.col("in_phrase") | F.col("filler").isNotNull())

    # repeats, looking through fillers: places count the words that are left
    place = W.partitionBy(*u, "free").orderBy("idx")
    own = own.withColumn("free", ~F.col("masked") & (F.col("norm") != ""))
    own = own.withColumn("p", F.when(F.col("free"), F.row_number().over(place) - 1))
    groups = []
    for n in range(rules.longest_group, 0, -1):
        same = F.coalesce(F.col("free") & (F.lead("norm", n).over(place) == F.col("norm")), F.lit(False))
        own = own.withColumn(f"same{n}", same)
        own = own.withColumn(f"alike{n}", F.min(F.when(~F.col(f"same{n}"), F.col("p"))).over(place.rowsBetween(0, W.unboundedFollowing)) - F.col("p"))
        own = own.withColumn(f"gap{n}", F.lead("start_ms", n).over(place) - F.lead("end_ms", n - 1).over(place) if n > 1 else F.lead("start_ms").over(place) - F.col("end_ms"))
        meant = F.col("norm").isin(*L.INTENSIFIERS, *L.GRAMMATICAL_DOUBLES) if n == 1 else F.lit(False)
        ok = F.col("free") & (F.col(f"alike{n}") >= n) & (F.col(f"gap{n}") <= rules.stutter_gap) & ~meant
        groups.append(F.when(ok, F.struct(F.lit(-n).alias("n"), F.col("p").alias("a"), (F.col("p") + n * (1 + F.floor(F.col(f"alike{n}") / n))).cast("int").alias("b"))))

    # words that the next one begins with
    stem, target = word_stem(F.col("norm")), F.lead("norm").over(order)
    own = own.withColumns({"stem": stem, "target": target, "ahead": F.lead("start_ms").over(order) - F.col("end_ms"), "next_masked": F.lead("masked").over(order)})
    m, t = F.char_length("stem"), F.char_length("target")
    begun = (m >= rules.least_stem) & F.col("target").startswith(F.col("stem")) & (t > m) & (F.col("end_ms") - F.col("start_ms") <= rules.longest_abandoned) & ~F.col("masked") & ~F.col("next_masked")
    marked = T.is_truncated(F.rtrim(F.trim("text"), F.lit("\"'»)]….")))
    short = (F.col("ahead") <= rules.abandoned_gap) & (m <= 5) & (t >= m + 2) & ~F.col("stem").isin(*sorted(_COMMON))
    given_up = F.when(begun & marked & (F.col("ahead") <= rules.truncated_gap), 0.93).when(begun & ~marked & short, 0.66)

    each = own.groupBy(*u).agg(
        F.array_sort(F.collect_list(F.struct("idx", "k", "p", "norm", "start_ms", "end_ms", F.trim("text").alias("text"), "masked"))).alias("said"),
        F.collect_list(F.when(F.col("phrase") > 0, F.struct("k", F.col("phrase").alias("n")))).alias("phrases"),
        F.collect_list(F.when(F.col("filler").isNotNull(), F.struct("k", F.col("filler").alias("c")))).alias("fillers"),
        F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*groups))))).alias("groups"),
        F.collect_list(F.when(given_up.isNotNull(), F.struct("k", given_up.alias("c")))).alias("given_up"),
    )
    each = each.where((F.size("phrases") > 0) | (F.size("fillers") > 0) | (F.size("groups") > 0) | (F.size("given_up") > 0))

    free = lambda taken, g: F.forall(taken, lambda x: (x["b"] <= g["a"]) | (x["a"] >= g["a"] - 2 * g["n"]))
    none = F.array().cast("array<struct<n:int,a:int,b:int>>")
    each = each.withColumn("groups", F.when(F.size("groups") > 1, F.aggregate("groups", none, lambda got, g: F.when(free(got, g), F.array_append(got, g)).otherwise(got))).otherwise(F.col("groups")))

    size = "struct<kind string, words array<int>, kept array<int>, start_ms long, end_ms long, confidence double, text string, kept_text string>"

    def found(kind: str, out, kept, confidence):
        """Words and kept ones are parts of ``said``."""
        names = lambda x: F.transform(x, lambda w: w["idx"])
        texts = lambda x: F.array_join(F.transform(x, lambda w: w["text"]), " ")
        return F.struct(
            F.lit(kind).alias("kind"), names(out).alias("words"), names(kept).alias("kept"), F.element_at(out, 1)["start_ms"].alias("start_ms"), F.element_at(out, -1)["end_ms"].alias("end_ms"),
            confidence.alias("confidence"), texts(out).alias("text"), texts(kept).alias("kept_text"),
        ).cast(size)

    said = F.col("said")
    span = lambda k, n: F.slice(said, k + 1, n)
    places = lambda a, b: F.filter(said, lambda w: (w["p"] >= a) & (w["p"] < b))
    nothing = F.slice(said, 1, 0)
    each = each.withColumn("stutters", F.transform("groups", lambda g: found("stutter", places(F.greatest(g["a"], g["b"] + g["n"] - rules.most_removed), g["b"] + g["n"]), places(g["b"] + g["n"], g["b"]), F.when(g["n"] == -1, 0.92).otherwise(0.86))))
    each = each.withColumn("gone", F.flatten(F.transform("stutters", lambda f: f["words"])))
    kept = F.filter("given_up", lambda c: ~F.array_contains("gone", F.get(said, c["k"])["idx"]) & ~F.array_contains("gone", F.get(said, c["k"] + 1)["idx"]))
    each = each.withColumn("given_up", F.transform(kept, lambda c: found("abandoned", span(c["k"], F.lit(1)), span(c["k"] + 1, F.lit(1)), c["c"])))
    gone = F.concat("gone", F.flatten(F.transform("given_up", lambda f: f["words"])))
    emptied = F.forall(said, lambda w: w["masked"] | (w["norm"] == "") | F.array_contains(gone, w["idx"])) & F.exists(said, lambda w: (F.char_length(w["norm"]) > 1) & ~w["norm"].isin(*sorted(_EMPTY)))
    every = F.concat(
        F.transform("phrases", lambda c: found("filler_phrase", span(c["k"], c["n"]), nothing, F.lit(0.80))), F.transform("fillers", lambda c: found("filler", span(c["k"], F.lit(1)), nothing, c["c"])),
        F.when((F.size("stutters") > 0) & emptied, F.slice("stutters", 1, 0)).otherwise(F.col("stutters")), F.col("given_up"),
    )
    return each.select("rush_id", F.explode(every).alias("f")).select("rush_id", "f.kind", "f.words", "f.start_ms", "f.end_ms", "f.confidence", "f.text", "f.kept_text")


_COMMON = frozenset([*L.COMMON_SHORT_WORDS, *V.STOPWORDS])
_EMPTY = frozenset([*V.STOPWORDS, *L.HARD_FILLERS])
