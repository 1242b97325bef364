"""Queries over the driver's tables, each with the same in SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import lexicon as L
from wordloom.functions import markers as M
from wordloom.functions import numbers
from wordloom.functions import text as T
from wordloom.operators import alignment, containment, cuts, decisions, disfluency, intervals, levels, ranges, retakes, seams, similarity, splits, timeline, words, zoom
from wordloom.operators import zoom_plan as zoom_plans
from wordloom.sources import projects, store, transcripts
from wordloom.streaming import sessions
from wordloom.tables import cut, shared_folder, sound_unions


#: What ``spoken`` puts into turns: markers of correction, stock phrases, words that can't end a sentence.
MARKERS = ("Je recommence", "Attends, je refais la phrase", "On coupe", "Let me rephrase", "Scratch that", "I messed that up", "Non non non", "Sorry, wait")
PHRASES = ("you know", "i mean", "je sais pas", "enfin bref", "comment dire", "what was it")
LOOSE_ENDS = ("mais", "avec", "because", "the")
#: The kinds of turns, by a number of conversation and turn; the other numbers leave a turn as it is.
KINDS = 12


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clock(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "conversations")
    return words.word_clock(c.select(F.col("conv_id").alias("rush_id"), F.col("turn").alias("seg_idx"), "text"))


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    """(rush_id, seg_idx, text): the turns of conversations as people speak, with restarts, repeats, markers and loose ends.

    The tables' invented prose has none, so they are made from each turn's own words, by its numbers.
    """
    c = _read(spark, sf, "conversations").select(F.col("conv_id").alias("rush_id"), F.col("turn").alias("seg_idx"), "text")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), ((F.col("rush_id") + F.col("seg_idx")) % len(words) + 1).cast("int"))
    text, kind, first = F.col("text"), (7 * F.col("rush_id") + 3 * F.col("seg_idx")) % KINDS, lambda n: F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, n), " ")
    made = (
        F.concat(pick(MARKERS), F.lit(", "), text), F.concat(pick(MARKERS), F.lit(". "), text), F.concat(pick(PHRASES), F.lit(" "), text), F.concat(first(5), F.lit("- "), text),
        F.concat(F.lit("euh "), text), F.concat(first(3), F.lit(" "), text), F.concat(first(2), F.lit(" "), text), F.concat(F.regexp_replace(text, r"[.!?]+$", ""), F.lit(" "), pick(LOOSE_ENDS)),
        F.concat(first(1), F.lit(" "), first(1), F.lit(" "), text), F.concat(F.substring(first(1), 1, 3), F.lit("- "), text), F.concat(pick(MARKERS), F.lit(".")),
    )
    said = reduce(lambda c, k: c.when(kind == k, made[k]), range(1, len(made)), F.when(kind == 0, made[0])).otherwise(text)
    return c.select("rush_id", "seg_idx", said.alias("text"))


def spoken_clock(spark: SparkSession, sf: str) -> DataFrame:
    return words.word_clock(spoken(spark, sf))


def word_clock(spark, sf):
    return clock(spark, sf)


def utterance_sessions(spark, sf):
    return words.utterances(clock(spark, sf))


def gap_summary(spark, sf):
    return words.gap_summary(words.gaps(clock(spark, sf)))


def hard_fillers(spark, sf):
    return disfluency.hard_fillers(clock(spark, sf))


def soft_fillers(spark, sf):
    return disfluency.soft_fillers(clock(spark, sf))


def stutter_runs(spark, sf):
    return disfluency.stutter_runs(clock(spark, sf))


def abandoned_words(spark, sf):
    return disfluency.abandoned_words(clock(spark, sf))


def disfluencies(spark, sf):
    found = disfluency.disfluencies(spoken_clock(spark, sf))
    return found.withColumn("words", F.array_join(F.col("words").cast("array<string>"), " "))


def ngram_phrases(spark, sf):
    return disfluency.phrase_hits(clock(spark, sf), (*L.FILLER_PHRASES, "of the", "de la", "the"))


def _gap_cuts(found: DataFrame) -> DataFrame:
    """What gaps lose: a share of what is kept stays before the cut, the rest after it."""
    before = cuts.kept_before(F.col("kept"))
    return found.where("removed > 0").select("rush_id", (F.col("start") + before).alias("start"), (F.col("end") - F.col("kept") + before).alias("end"))


def shots(spark: SparkSession, sf: str) -> DataFrame:
    w = clock(spark, sf)
    return timeline.shots_between(w, _gap_cuts(words.gaps(w)))


def timeline_shots(spark, sf):
    return shots(spark, sf).select("rush_id", "shot", "start", "end", "timeline_start")


def frame_clips(spark, sf):
    return timeline.frame_clips(shots(spark, sf), 25)


def short_shots(spark, sf):
    return shots(spark, sf).where("end - start < 550").select("rush_id", "shot", (F.col("end") - F.col("start")).alias("duration"))


def _days(spark, sf):
    o = _read(spark, sf, "orders")
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("k"), "o_orderkey", day.alias("start"), (day + 5 + F.col("o_orderkey") % 60).alias("end"))


def merge_intervals(spark, sf):
    return intervals.merge(_days(spark, sf), "k")


def subtract_intervals(spark, sf):
    d = _days(spark, sf)
    return intervals.subtract(d.where("o_orderkey % 3 <> 0"), d.where("o_orderkey % 3 = 0"), "k")


def interval_totals(spark, sf):
    return intervals.total(intervals.merge(_days(spark, sf), "k"), "k")


def spaced_topk(spark, sf):
    e = _read(spark, sf, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return intervals.spaced_top(e, "user_id", 86400, 5)


def event_sessions(spark, sf):
    e = _read(spark, sf, "events").withColumnRenamed("event_id", "id")
    return levels.gap_sessions(e, "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")), 21600)


def event_level_percentiles(spark, sf):
    r = levels.reference_levels(_read(spark, sf, "events"), "event_type", "value")
    return r.select("event_type", F.round("floor", 6).alias("floor"), F.round("speech", 6).alias("speech"), "n")


def removal_budget(spark, sf):
    """Removals of each user, of whom speech is a third to twice what is to be removed, under the limit on removed speech."""
    e = _read(spark, sf, "events").select(F.col("user_id").alias("rush_id"), F.col("event_id").alias("id"), (1 + F.col("event_id") % 37).alias("duration"), ((F.col("event_id") * 7) % 100 / 100).alias("confidence"))
    speech = e.groupBy("rush_id").agg((F.sum("duration") * (1 + F.col("rush_id") % 3) * 2 / 3).cast("long").alias("speech"))
    return cuts.limited(e, speech, from_ms=500).select(F.col("rush_id").alias("user_id"), "id", "duration", "applied")


def silence_cuts(spark, sf):
    """Gaps between kept words and at the ends, after the hard fillers are cut out."""
    w = clock(spark, sf)
    ends = w.groupBy("rush_id").agg((F.max("end_ms") + 800).alias("end_ms"))
    return cuts.silences(w, disfluency.hard_fillers(w), ends)


def number_texts(spark, sf):
    """Durations in words, mapped and held values, times of day read and written, and the frame rates near quarter steps, of each order."""
    x, k = F.col("k") % 600 / 4.0, F.col("k")
    rate = numbers.frame_rate(x)
    shown = numbers.shown_size(k % 1920, k % 1080, (k % 4 * 90).cast("int"))
    return _read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select(
        "k", T.timecode(x * 37).alias("code"), F.round(numbers.fraction(F.concat(k.cast("string"), F.lit("/1001"))), 6).alias("ratio"), T.clamp(k % 100, F.lit(70), F.lit(20)).alias("held"),
        numbers.parse_timecode(F.concat_ws(":", *((c).cast("string") for c in (k % 5, k % 60, k * 7 % 60)))).alias("seconds"), shown["width"].alias("width"), shown["height"].alias("height"),
        numbers.human_duration(x * 37).alias("duration"), F.round(numbers.remap(x, 10, 100, 4, 20), 6).alias("mapped"),
        rate["base"].alias("base"), rate["slowed"].alias("slowed"), numbers.ticks(k / 1000.0).alias("ticks"), numbers.overlap(k, k + 10, F.lit(50), F.lit(90)).alias("shared"),
    )


def shot_scores(spark, sf):
    """Tags of shots as text, and how well a zoom would stand at each."""
    own = zoom.tagged(shots(spark, sf), clock(spark, sf))
    scored = zoom.shot_scores(own).select("rush_id", "shot", F.round("score", 6).alias("score"))
    return own.select("rush_id", "shot", F.array_join("tags", ",").alias("tags")).join(scored, ["rush_id", "shot"])


def minimum_shots(spark, sf):
    """Shots of a second at least."""
    w = clock(spark, sf)
    ends = w.groupBy("rush_id").agg(F.max("end_ms").cast("long").alias("total"))
    return timeline.long_enough(shots(spark, sf), ends, 1000)


def cache_retention(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return levels.retained(o).select("id")


def content_jaccard(spark, sf):
    """Benchmark items against each other: Jaccard of distinct normal tokens, by shared tokens."""
    b = _read(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens("text")).alias("w"))
    t = b.select("item_id", F.size("w").alias("n"), F.explode("w").alias("w"))
    u = t.select(F.col("item_id").alias("other_id"), F.col("n").alias("m"), "w")
    pair = t.join(u, "w").where("item_id < other_id").groupBy("item_id", "other_id", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    return pair.select("item_id", "other_id", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


def language_characters(spark, sf):
    d = _read(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


def role_words(spark, sf):
    """The commonest word of each role, the first in order on ties: a stable mode."""
    c = _read(spark, sf, "conversations").select("role", F.explode(T.tokens("text")).alias("w"))
    n = c.groupBy("role", "w").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("role").agg(F.min(F.struct((-F.col("n")).alias("m"), "w")).alias("x")).select("role", "x.w", (-F.col("x.m")).alias("n"))


def weak_markers(spark, sf):
    c = _read(spark, sf, "conversations")
    hit = T.normalize_text("text").rlike(r"\b(" + "|".join(L.WEAK_MARKERS) + r")\b")
    return c.where(hit).select("conv_id", "turn")


def strong_markers(spark, sf):
    c = spoken(spark, sf).select(F.col("rush_id").alias("conv_id"), F.col("seg_idx").alias("turn"), T.normalize_text("text").alias("norm"))
    return c.select("conv_id", "turn", M.strong_marker(F.col("norm")).alias("strong"), M.standalone_marker(F.col("norm")).alias("alone")).where("strong or alone")


def content_words(spark, sf):
    """Content words of each turn, repeated ones counted each."""
    c = _read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(M.content_words(T.tokens("text"))).cast("long").alias("n"))


def curve_samples(spark, sf):
    x = F.col("k") % 101 / 100.0
    names = ("linear", "smoothstep", "smootherstep", "progressive", "ease_out_expo", "ballistic")
    return _read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select("k", *(F.round(timeline.curve(n, x), 6).alias(n) for n in names))


def language_durations(spark, sf):
    """Spoken milliseconds of each language, by the clock of words."""
    d = _read(spark, sf, "documents").select("lang", F.explode(F.split(F.trim("text"), r"[ \t\n\r]+")).alias("w")).where("w <> ''")
    return d.groupBy("lang").agg(F.sum(115 + 52 * F.char_length("w")).alias("spoken_ms"))


def onset_strength(spark, sf):
    """Mean value of the two days from an event on less that of the two days before it, for each user."""
    e = _read(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value")
    by = Window.partitionBy("user_id").orderBy("t")
    own = e.withColumn("after", F.avg("value").over(by.rangeBetween(0, 172800))).withColumn("before", F.avg("value").over(by.rangeBetween(-172800, -1)))
    return own.select("event_id", F.round(F.col("after") - F.coalesce("before", F.lit(0.0)), 6).alias("onset"))


def pair_similarity(spark, sf):
    p = retakes.pair_scores(words.utterances(clock(spark, sf)))
    return p.select("rush_id", "a", "b", *(F.round(c, 6).alias(c) for c in similarity.SCORES))


def retake_groups(spark, sf):
    return retakes.retakes(cut(words.utterances(clock(spark, sf)), "utterances"))


def fragments(spark, sf):
    u = cut(words.utterances(clock(spark, sf)), "utterances")
    return retakes.fragments(u, retakes.retakes(u).where("confidence >= 0.6"))


def edit_lists(spark, sf):
    return timeline.edit_list(shots(spark, sf), "rush")


def seam_checks(spark, sf):
    """Joints after the gaps and the hard fillers are cut out."""
    w = clock(spark, sf)
    fillers = disfluency.hard_fillers(w).select("rush_id", "idx")
    spoken = w.join(fillers, ["rush_id", "idx"]).select("rush_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return seams.seams(timeline.shots(w, _gap_cuts(words.gaps(w)).unionByName(spoken)), w, fillers, fillers)


def repaired_words(spark, sf):
    """Words whose times overlap, run backwards or take no time at all, put right."""
    w = clock(spark, sf).where("norm <> ''")
    k, r = F.col("idx"), F.col("rush_id")
    w = w.withColumns({"start_ms": F.greatest(F.lit(0), F.col("start_ms") - (37 * k + 11 * r) % 400), "end_ms": F.col("end_ms") - (53 * k + 7 * r) % 500})
    return splits.repaired(w).select("rush_id", "idx", "text", "start_ms", "end_ms")


def spread_words(spark, sf):
    """Turns as cues of 90 ms a character, each third of no length, their words spread evenly."""
    c = _read(spark, sf, "conversations").select(F.col("conv_id").alias("rush_id"), F.col("turn").alias("seg_idx"), (F.col("turn") * 10000).alias("start_ms"), "text")
    c = c.withColumn("end_ms", F.col("start_ms") + F.when(F.col("seg_idx") % 3 == 0, 0).otherwise(90 * F.char_length("text")))
    return transcripts.spread(c)


def split_utterances(spark, sf):
    return splits.split_utterances(spoken_clock(spark, sf))


def utterance_checks(spark, sf):
    """Whole utterances after the gaps are cut out, every third word and all of more than three characters taken as removed."""
    w = cut(spoken_clock(spark, sf), "clock")
    gone = w.where("idx % 3 = 0 or length(norm) > 3").select("rush_id", "idx")
    return seams.utterance_checks(splits.split_utterances(w), w, timeline.shots_between(w, _gap_cuts(words.gaps(w))), gone)


def marker_splits(spark, sf):
    """Utterances cut behind the words that announce a correction, not yet where one begins anew."""
    return splits.split_utterances(spoken_clock(spark, sf), restarts=False)


def zoom_plan(spark, sf):
    """The zooms of each conversation, without their keyframes but for their number."""
    own = shots(spark, sf)
    scored = zoom.shot_scores(zoom.tagged(own, clock(spark, sf)))
    plan = zoom_plans.zooms(own, scored)
    rounded = [F.round(c, 6).alias(c) for c in ("t", "t_end", "start_scale", "end_scale", "peak", "seconds", "score")]
    return plan.select("rush_id", "zoom", "shot", "kind", *rounded, "fills", F.size("keyframes").alias("n_keyframes"))


def project_files(spark, sf):
    """Length and checksum of each conversation's project text."""
    own = shots(spark, sf)
    plan = zoom_plans.zooms(own, zoom.shot_scores(zoom.tagged(own, clock(spark, sf))))
    source = clock(spark, sf).groupBy("rush_id").agg(F.max("end_ms").alias("e")).select("rush_id", F.format_string("/media/rush %d.mp4", F.col("rush_id")).alias("path"), F.ceil(F.col("e") / 40).alias("frames"))
    xml = projects.project_xml(timeline.frame_clips(own, 25), plan, source)
    return xml.select("rush_id", F.char_length("xml").alias("n"), F.sha2("xml", 256).alias("sha256"))


def _edit(spark, sf) -> decisions.Edit:
    """Hesitations and lone strong markers to an edit with shots of a second at least."""
    w = cut(spoken_clock(spark, sf), "clock")
    alone = M.with_marks(words.utterances(w)).where("marker and strong")
    alone = alone.select("rush_id", F.lit("marker").alias("source"), "start_ms", "end_ms", F.lit(0.88).alias("confidence"), F.sequence("first_idx", (F.col("first_idx") + F.col("n_words") - 1).cast("int")).alias("words"))
    return decisions.edit(w, decisions.hesitations(w).unionByName(alone), decisions.EditRules(least_shot=1000))


def edit_decisions(spark, sf):
    """Each finding: whether it is applied, or was and is withdrawn because a word of it stands in a shot."""
    own = _edit(spark, sf).removals
    return own.select("rush_id", "source", "start_ms", "end_ms", "confidence", F.array_join(F.col("words").cast("array<string>"), " ").alias("words"), "applied", "limited", "withdrawn")


def edit_shots(spark, sf):
    return _edit(spark, sf).shots.select("rush_id", "shot", "start", "end", "timeline_start", "after")


def edit_sets(spark, sf):
    """Runs of removed and of benign words, without those that survive; whether all of a recording's removed words are benign."""
    made = _edit(spark, sf)
    both = made.removed.withColumn("kind", F.lit("removed")).unionByName(made.benign.withColumn("kind", F.lit("benign")))
    return both.join(decisions.subset(made.removed, made.benign), "rush_id").select("rush_id", "kind", "start", "end", "inside")


def range_assign(spark, sf):
    """Events of a user in the overlapping spans that orders make: how many hold each, and the one that begins first."""
    e = _read(spark, sf, "events").select((F.col("user_id") % 50).cast("long").alias("k"), "event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 864000).alias("t"))
    o = _read(spark, sf, "orders")
    start = F.col("o_orderkey") * 977 % 864000
    spans = o.select((F.col("o_custkey") % 50).cast("long").alias("k"), start.cast("long").alias("start"), (start + 600 + F.col("o_orderkey") % 7200).cast("long").alias("end"), "o_orderkey")
    return ranges.holders(e, spans, "k", 7200, ["o_orderkey"]).select("event_id", "n", F.col("first.o_orderkey").alias("first_order"))


def instants(spark, sf):
    """The first utterance that holds each fifth second of a conversation, null between utterances."""
    u = words.utterances(clock(spark, sf)).select("rush_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "utt_id")
    t = u.groupBy("rush_id").agg(F.max("end").alias("e")).select("rush_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("e"), F.lit(5000).cast("long"))).alias("t"))
    return ranges.first_hit(t, u, "rush_id", ["rush_id", "t"], 10_000, F.col("span.utt_id")).select("rush_id", "t", F.col("span.utt_id").alias("utt_id"))


def window_words(spark, sf):
    """Words whose centre lies in spans of seven seconds that overlap by two."""
    w = clock(spark, sf).select("rush_id", (F.col("start_ms") + F.col("end_ms")).alias("t"), "idx")
    at = w.groupBy("rush_id").agg(F.max("t").alias("e")).select("rush_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("e"), F.lit(10_000).cast("long"))).alias("start"))
    met = ranges.hits(w, at.withColumn("end", F.col("start") + 14_000), "rush_id", 14_000)
    return met.groupBy("rush_id", "span.start").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).select("rush_id", "start", "n", "first_idx", "last_idx")


def chunk_words(spark, sf):
    """Words heard in windows of twenty seconds with two more on either side, each kept once."""
    w = clock(spark, sf).select("rush_id", "idx", "text", "start_ms", "end_ms")
    return ranges.owned(ranges.heard(w, 20_000, 2_000), "rush_id", 20_000, 2_000).select("rush_id", "idx", "text", "start_ms", "end_ms", "window")


def utterance_chunks(spark, sf):
    """Utterances in chunks of five, and what each chunk spans."""
    own = ranges.chunked(words.utterances(clock(spark, sf)), "rush_id", "utt_id", 5)
    return own.groupBy("rush_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_words").alias("n_words"))


def content_loss(spark, sf):
    """Benchmark items of whose content words a document holds a quarter or more by weight, and how many are lost."""
    few = _read(spark, sf, "benchmark").select(F.col("item_id").alias("small_id"), "text")
    many = _read(spark, sf, "documents").select(F.col("doc_id").alias("large_id"), "text")
    found = containment.held(few, many, 0.25)
    return found.select(F.col("small_id").alias("item_id"), F.col("large_id").alias("doc_id"), F.size("shared").alias("shared"), F.size("lost").alias("lost"), F.round("containment", 6).alias("containment"))


def lcs_align(spark, sf):
    """What of an utterance stands in order in each of the next three."""
    u = words.utterances(spoken_clock(spark, sf)).select("rush_id", "utt_id", alignment.described(T.tokens("text")).alias("w"))
    a = u.select("rush_id", F.col("utt_id").alias("a"), "w", F.explode(F.sequence(F.col("utt_id") + 1, F.col("utt_id") + 3)).alias("b"))
    pairs = a.join(u.select("rush_id", F.col("utt_id").alias("b"), F.col("w").alias("v")), ["rush_id", "b"])
    return pairs.select("rush_id", "a", "b", F.round(alignment.align(F.col("w"), F.col("v")), 6).alias("align"))


def utterance_language(spark, sf):
    """The language of most words of an utterance, the first on ties, and how whole the utterance is; words get a language by their place and length."""
    tag = F.when((F.char_length("text") + F.col("idx")) % 3 == 0, "fr").when((F.char_length("text") + F.col("idx")) % 3 == 1, "en")
    w = words.with_utterances(spoken_clock(spark, sf)).withColumn("language", tag)
    said = words.dominant(w, ["rush_id", "run", "part"]).join(w.groupBy("rush_id", "run", "part").agg(F.min("idx").alias("first_idx")), ["rush_id", "run", "part"], "right")
    whole = M.with_marks(words.utterances(spoken_clock(spark, sf))).select("rush_id", "utt_id", "first_idx", F.round(M.completeness(), 6).alias("completeness"))
    return whole.join(said, ["rush_id", "first_idx"]).select("rush_id", "utt_id", "language", "completeness")


def streamed_utterances(spark, sf):
    """The words of all conversations as a stream of files, each a stretch of time, through the stateful sessions to a table."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    w = cut(clock(spark, sf).select("rush_id", F.col("idx").cast("long").alias("idx"), "text", "start_ms", "end_ms", F.timestamp_millis("start_ms").alias("at")), "clock")
    end = w.agg(F.max("start_ms")).first()[0] or 0
    bounds = [end * k // 3 for k in range(4)]
    for low, high in zip(bounds, [*bounds[1:-1], end + 1]):  # one after another, for files are read in order of time
        w.where((F.col("start_ms") >= low) & (F.col("start_ms") < high)).coalesce(1).write.mode("append").parquet(f"{where}/words")
    last = spark.range(1).select((-F.col("id") - 1).alias("rush_id"), F.lit(0).cast("long").alias("idx"), F.lit("end").alias("text"), *(F.lit(end + 86_400_000).cast("long").alias(c) for c in ("start_ms", "end_ms")))
    last.withColumn("at", F.timestamp_millis("start_ms")).coalesce(1).write.mode("append").parquet(f"{where}/words")
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/words")
    out = sessions.stream_utterances(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(sessions.OUT).parquet(f"{where}/out").where("rush_id >= 0")


def edit_seams(spark, sf):
    """Joints of the edit of ``edit_shots``, where words are missing that were not benign."""
    made = _edit(spark, sf)
    gone = decisions.members(made.removed).unionByName(decisions.members(made.benign))
    return seams.seams(made.shots, cut(spoken_clock(spark, sf), "clock"), gone, decisions.members(made.benign), short=1500, apart=2500)


def transcript_files(spark, sf):
    """Conversations written as JSON (even ones) and as cues (odd ones), a file each, and read again by the files' suffixes."""
    where = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    w = cut(clock(spark, sf), "clock")
    cues = w.groupBy("rush_id", "seg_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    said = w.where("rush_id % 2 = 0").select("rush_id", "seg_idx", "idx", "text", "start_ms", "end_ms", F.lit(0.9).alias("probability"))
    transcripts.transcript_json(cues.where("rush_id % 2 = 0"), said).write.partitionBy("rush_id").text(f"{where}/json")
    transcripts.srt_blocks(cues.where("rush_id % 2 = 1")).write.partitionBy("rush_id").option("lineSep", "\n").text(f"{where}/cues")
    read = [transcripts.read(spark, f"{where}/json"), transcripts.read(spark, f"{where}/cues", (*transcripts.CUES, ".txt"))]
    rush = F.regexp_extract("rush_id", r"/rush_id=(\d+)/", 1).cast("long")
    return read[0].unionByName(read[1]).select(rush.alias("rush_id"), "idx", "text", "start_ms", "end_ms", "probability")


def store_hits(spark, sf):
    """Orders as results in a store: the early ones are put, all are asked for, and what is too old or too many is purged."""
    o = _read(spark, sf, "orders").select(F.concat(F.lit("/media/"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderkey").alias("size"), F.to_timestamp("o_orderdate").alias("at"), "o_totalprice")
    o = o.withColumn("key", store.key(F.col("source"), F.col("size"), F.col("at"), {"model": "small", "device": "cpu"}, "1"))
    own = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "double")
    for part in (0, 1):
        own.put(o.where(f"size % 4 = {part}").select("key", "at", F.col("o_totalprice").cast("double").alias("value")))
    again = own.put(o.where("size % 4 < 2").select("key", "at", F.lit(0.0).alias("value")))
    found = own.get(o.select("key", "size"))
    hits = cut(found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.sum("value"), 2).alias("value")), "hits")
    kept, gone = own.purge(1000, 400)
    return hits.select("hits", "misses", "value", F.lit(again is not None).alias("written_again"), F.lit(kept).cast("long").alias("kept"), F.lit(gone).cast("long").alias("purged"), F.lit(own.rows().count()).cast("long").alias("left"))


QUERIES = (
    word_clock, utterance_sessions, gap_summary, hard_fillers, soft_fillers, stutter_runs, abandoned_words, disfluencies, ngram_phrases, timeline_shots, frame_clips,
    short_shots, merge_intervals, subtract_intervals, interval_totals, spaced_topk, event_sessions, event_level_percentiles, removal_budget,
    cache_retention, content_jaccard, language_characters, role_words, weak_markers,
    strong_markers, silence_cuts, number_texts, shot_scores, minimum_shots, content_words, curve_samples, language_durations, onset_strength, pair_similarity, retake_groups, fragments, edit_lists, seam_checks,
    repaired_words, spread_words, split_utterances, utterance_checks, zoom_plan, project_files, edit_decisions, edit_shots, edit_sets, edit_seams, marker_splits,
    range_assign, instants, window_words, chunk_words, utterance_chunks, content_loss, lcs_align, utterance_language, streamed_utterances, transcript_files, store_hits,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
