import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import numbers as N
from wordloom.operators import audio, cuts, intervals, timeline, zoom

WORDS = "rush_id long, idx int, text string, norm string, start_ms long, end_ms long"


def said(spark, *words):
    return spark.createDataFrame([(1, k, t, t.lower().strip(".,"), a, b) for k, (t, a, b) in enumerate(words)], WORDS)


def test_silences_around_removed_words_and_at_the_ends(spark):
    w = said(spark, ("un", 1000, 1300), ("faux", 1340, 1700), ("faux", 1720, 2000), ("deux.", 2030, 2400), ("trois", 3600, 3900))
    gone = w.where("norm = 'faux'").select("rush_id", "idx")
    ends = spark.createDataFrame([(1, 6000)], "rush_id long, end_ms long")
    got = {r.kind: r for r in cuts.silences(w, gone, ends).where("kind <> 'edge'").collect()}
    r = got["removed speech"]  # 40 ms of silence before and 30 after it: the least margin of 60 on either side
    assert (r.start, r.end, r.cut_start, r.cut_end, r.kept, r.holds_removed) == (1300, 2030, 1360, 1970, 120, True)
    r = got["long"]
    assert (r.start, r.end, r.kept, r.cut_start, r.cut_end) == (2400, 3600, 300, 2565, 3465)
    edges = sorted((r.start, r.end, r.cut_start, r.cut_end, r.kept) for r in cuts.silences(w, gone, ends).where("kind = 'edge'").collect())
    assert edges == [(0, 1000, 0, 750, 250), (3900, 6000, 4150, 6000, 250)]
    tight = said(spark, ("a", 0, 100), ("b", 110, 180), ("c", 200, 300))
    r = cuts.silences(tight, tight.where("idx = 1").select("rush_id", "idx")).first()  # 100 ms: all but 10 would be margins
    assert (r.kept, r.cut_end - r.cut_start) == (10, 90)
    assert cuts.silences(w, w.select("rush_id", "idx")).count() == 0


def test_limit_on_removed_speech(spark):
    rows = [(1, 1, 30, 0.6), (1, 2, 20, 0.6), (1, 3, 40, 0.9), (2, 4, 90, 0.1)]
    removals = spark.createDataFrame(rows, "rush_id long, id long, duration long, confidence double")
    speech = spark.createDataFrame([(1, 100), (2, 59)], "rush_id long, speech long")
    got = {r.id: r.applied for r in cuts.limited(removals, speech, from_ms=60).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}  # 90 of 55: the longer of the unsure first, then the other; short recordings have no limit
    got = {r.id: r.applied for r in cuts.limited(removals.where("id <> 3"), speech, from_ms=60).collect()}
    assert got == {1: True, 2: True, 4: True}


def test_decisions_and_reconciliation(spark):
    found = spark.createDataFrame([(1, "filler", 0, 100, 0.9, [1]), (1, "retake", 0, 900, 0.4, [2, 3]), (1, "other", 0, 1, 1.0, [9])], "rush_id long, source string, start_ms long, end_ms long, confidence double, words array<int>")
    own = cuts.decided(cuts.all_findings(found, found.limit(0)), {"filler": 0.6, "retake": 0.6}).withColumn("id", F.element_at("words", 1))
    assert {r.source: r.applied for r in own.collect()} == {"filler": True, "retake": False, "other": False}
    still = spark.createDataFrame([(1, 1), (1, 3)], "rush_id long, idx int")
    got = {r.source: (r.applied, r.survived) for r in cuts.reconciled(own, still).collect()}
    assert got == {"filler": (False, True), "retake": (False, False), "other": (False, False)}


def test_statistics(spark):
    w = said(spark, ("un", 0, 300), ("deux", 1300, 1700))
    shots = spark.createDataFrame([(1, 0, 400), (1, 1200, 1700)], "rush_id long, start long, end long")
    gaps = cuts.silences(w, w.limit(0).select("rush_id", "idx"))
    gone = spark.createDataFrame([(1, "retake", 0, 200, True), (1, "filler", 50, 90, True), (1, "retake", 0, 9, False)], "rush_id long, source string, start_ms long, end_ms long, applied boolean")
    r = cuts.statistics(w, shots, gaps, gone).first()
    assert (r.words, r.shots, r.cuts, r.final_ms, r.speech_ms, r.hesitation_ms, r.retakes, r.hesitations, r.silence_ms, r.compression) == (2, 2, 1, 900, 200, 40, 1, 1, 700, 0.5294)


def test_least_length_of_shots(spark):
    kept = spark.createDataFrame([(1, 0, 1000), (1, 1500, 1600), (1, 3000, 4000), (2, 0, 500), (2, 520, 560), (2, 570, 900), (3, 0, 100)], "rush_id long, start long, end long")
    ends = spark.createDataFrame([(1, 4000), (2, 900), (3, 100)], "rush_id long, total long")
    got = sorted((r.rush_id, r.start, r.end) for r in timeline.long_enough(kept, ends, 300).collect())
    assert got == [(1, 0, 1000), (1, 1400, 1700), (1, 3000, 4000), (2, 0, 500), (2, 520, 900)]
    assert timeline.long_enough(kept.limit(0), ends).count() == 0


def test_places_on_the_timeline(spark):
    kept = spark.createDataFrame([(1, 0, 100, 200, 0), (1, 1, 300, 500, 100)], "rush_id long, shot int, start long, end long, timeline_start long")
    points = spark.createDataFrame([(1, t, k) for k, t in enumerate((150, 200, 250, 500, 150))], "rush_id long, t long, mine int")
    assert sorted((r.mine, r.timeline_t) for r in timeline.to_timeline(points, kept).collect()) == [(0, 50), (1, 100), (2, None), (3, 300), (4, 50)]
    at = spark.createDataFrame([(1, 0), (1, 99), (1, 100), (1, 900)], "rush_id long, t long")
    assert sorted((r.t, r.shot) for r in timeline.shot_at(at, kept).collect()) == [(0, 0), (99, 0), (100, 1), (900, 1)]


def test_keyframes(spark):
    points = zoom.keyframes("ballistic", 2.0, 100.0, 112.0)
    assert points[0] == (0.0, 100.0) and points[-1] == (2.0, 112.0) and 4 <= len(points) <= 90
    t, v = np.array(points).T
    for k in range(61):
        assert abs(np.interp(k / 30, t, v) - (100 + 12 * zoom._at("ballistic", k / 60))) <= 0.2201
    assert len(zoom.keyframes("ballistic", 2.0, 100.0, 112.0, most=5)) <= 5 and zoom.keyframes("linear", 1.0, 1.0, 9.0) == [(0.0, 1.0), (1.0, 9.0)]
    rows = spark.createDataFrame([("linear", 2.0, 1.0, 3.0), (None, 1.0, 1.0, 1.0)], "n string, d double, a double, b double")
    got = rows.select(zoom.curve_keyframes(F.col("n"), F.col("d"), F.col("a"), F.col("b")).alias("k")).select("k", *(zoom.between_keyframes(F.col("k"), F.lit(x)).alias(f"v{i}") for i, x in enumerate((-1.0, 0.5, 9.0)))).collect()
    assert got[0][1:] == (1.0, 1.5, 3.0) and got[1][0] is None


def test_widest_static_stretch(spark):
    zooms = spark.createDataFrame([(1, 4.0), (1, 6.0)], "rush_id long, t double")
    r = zoom.widest_static(zooms, spark.createDataFrame([(1, 10.0)], "rush_id long, duration double")).first()
    assert (r.start, r.end) == (0.0, 4.0)


def test_levels_of_sound(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.001, 3200), rng.normal(0, 0.2, 3200), np.zeros(1000)])
    samples = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "rush_id long, i long, v double")
    levels = audio.envelope(samples).cache()
    padded = np.pad(v, (0, 400))
    want = [max(-90.0, 20 * np.log10(max(1e-10, np.sqrt(np.mean(padded[k : k + 400] ** 2))))) for k in range(0, len(v), 160)]
    assert np.allclose([r.db for r in levels.orderBy("i").collect()], want)
    heard = np.array(want)[np.array(want) > -89]
    r = audio.references(levels).first()
    assert np.allclose((r.noise, r.speech), np.percentile(heard, (8, 88)))
    spans = spark.createDataFrame([(1, 7, 0.05, 0.15), (1, 8, 0.25, 0.35), (1, 9, 0.3, 0.3)], "rush_id long, id long, start double, end double")
    e = {r.id: r for r in audio.energies(spans, levels).collect()}
    assert e[7].energy < 0.1 < 0.8 < e[8].energy <= e[8].peak_energy and np.isclose(e[9].mean_db, want[30])
    got = audio.onsets(spark.createDataFrame([(1, 1, 0.2)], "rush_id long, id long, t double"), levels, around=0.1).first()
    assert 0.7 < got.onset <= 1
    assert audio.loudness_profile(spans.where("id < 9"), levels, 4).count() == 8


@pytest.mark.parametrize(("f", "x", "want"), [
    (N.parse_timecode, "1:02:03", 3723.0), (N.parse_timecode, "01:33,5", 93.5), (N.parse_timecode, "", 0.0), (N.parse_timecode, "a:b", None),
    (N.fraction, "30000/1001", 30000 / 1001), (N.fraction, "5/0", 0.0), (N.fraction, None, 0.0), (N.fraction, "x", 0.0), (N.fraction, "25", 25.0),
    (N.safe_filename, " a<b>:c?. ", "a_b__c_"), (N.safe_filename, None, "sortie"), (N.safe_filename, " . ", "sortie"), (N.word_stem, "compe-", "compe"),
    (N.path_url, "C:\\Mes vidéos\\a (1).mp4", "file://localhost/C:/Mes%20vid%C3%A9os/a%20(1).mp4"), (N.path_url, "/x/~y!.mov", "file://localhost/x/~y!.mov"),
])
def test_texts_and_numbers(spark, f, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y == want


def test_spaced_choice(spark):
    rows = [(1, 0, 5.0, 1), (1, 5, 9.0, 2), (1, 10, 5.0, 3), (1, 11, 4.0, 4), (1, None, 99.0, 5), (2, 3, 1.0, 6), (2, 3, 1.0, 7), (None, 1, 1.0, 8), (3, 1, None, 9)]
    own = spark.createDataFrame(rows, "k long, t long, score double, id long")
    got = {(r.k, r["rank"], r.id) for r in intervals.spaced_top(own, "k", 6, 3).collect()}
    assert got == {(1, 0, 2), (1, 1, 4), (2, 0, 6), (None, 0, 8)}  # 11 is 6 after 5; 0 and 10 are too near; equal rows: the first id
    assert intervals.spaced_top(own.limit(0), "k", 6, 3).count() == 0
