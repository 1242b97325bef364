import json
from random import Random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from wordloom.operators import reports, seams, splits, timeline, words, zoom_plan
from wordloom.sources import projects, transcripts

WORDS = "rush_id long, idx int, text string, norm string, start_ms long, end_ms long"


def spoken(spark, text, gap=35, rush=1):
    rows, t = [], 500
    for k, w in enumerate(text.split()):
        rows.append((rush, k, w, w.lower().strip(".,!?"), t, t + 200))
        t += 200 + gap
    return spark.createDataFrame(rows, WORDS)


def test_repaired_times(spark):
    rows = [(1, 0, "un", "un", 100, 90), (1, 1, "deux", "deux", 120, 400), (1, 2, "trois", "trois", 300, 350), (1, 3, "six", "six", 405, 500), (1, 4, " ", "", 9, 10), (2, 0, "a", "a", 50, 55), (2, 1, "b", "b", None, 5)]
    got = [tuple(r) for r in splits.repaired(spark.createDataFrame(rows, WORDS)).orderBy("rush_id", "idx").select("rush_id", "idx", "text", "start_ms", "end_ms").collect()]
    # "un": no time, so 70 ms; "deux" is pushed behind it; "trois" would end before "deux" does; "six" follows it
    assert got == [(1, 0, "un", 100, 170), (1, 1, "deux", 170, 400), (1, 2, "trois", 400, 420), (1, 3, "six", 420, 500), (2, 0, "a", 50, 100)]
    assert splits.repaired(spark.createDataFrame([], WORDS)).count() == 0


def test_utterances_split_at_markers_and_restarts(spark):
    w = spoken(spark, "non je recommence les joueurs japonais arrivent").unionByName(spoken(spark, "le moteur de la voiture le moteur de la voiture rouge", rush=2))
    w = w.unionByName(spoken(spark, "une phrase tout à fait ordinaire", rush=3))
    got = {}
    for r in splits.split_utterances(w).orderBy("rush_id", "utt_id").collect():
        got.setdefault(r.rush_id, []).append((r.reason, r.text, r.first_idx, r.n_words))
    assert got[1] == [("start", "non je recommence les", 0, 4), ("marker", "joueurs japonais arrivent", 4, 3)]  # the longest head that says no more than the marker
    assert got[2] == [("start", "le moteur de la voiture", 0, 5), ("restart", "le moteur de la voiture rouge", 5, 6)]
    assert got[3] == [("start", "une phrase tout à fait ordinaire", 0, 6)]
    whole = splits.split_utterances(w, isolate_markers=False).where("rush_id = 1").collect()
    assert [r.reason for r in whole] == ["start"]
    assert splits.restart(["a", "", "b", "a", "c", "d"]) is None


def test_plain_utterances_stay_the_same(spark):
    w = spoken(spark, "une phrase. deux phrases, enfin. trois")
    assert sorted(map(tuple, splits.split_utterances(w).collect())) == sorted(map(tuple, words.utterances(w).collect()))


def test_utterance_checks(spark):
    w = spoken(spark, "non je recommence. mais le moteur tourne.", 700)
    u = spark.createDataFrame([(1, 0, 0, 3, 500, 2500, "non je recommence."), (1, 1, 3, 4, 3200, 6100, "mais le moteur tourne.")], "rush_id long, utt_id int, first_idx int, n_words long, start_ms long, end_ms long, text string")
    shots = spark.createDataFrame([(1, 0, 0, 2600, 0), (1, 1, 3000, 9000, 2600)], "rush_id long, shot int, start long, end long, timeline_start long")
    removed = w.where("norm in ('moteur', 'tourne')").select("rush_id", "idx")
    got = {(r.category, r.t, r.timeline_t, r.severity) for r in seams.utterance_checks(u, w, shots, removed).collect()}
    assert got == {("kept marker", 500, 500, "high"), ("empty rest", 3200, 2800, "medium")}
    gone = w.select("rush_id", "idx")
    assert seams.utterance_checks(u, w, shots, gone).count() == 0
    own = reports.ranked(seams.utterance_checks(u, w, shots, removed))
    assert [r.category for r in own.orderBy("rank").collect()] == ["kept marker", "empty rest"]
    assert [r.category for r in reports.ranked(own.drop("rank"), 1).collect()] == ["kept marker"]


def test_breaths(spark):
    w = spark.createDataFrame([(1, 0, "un", "un", 0, 100, None), (1, 1, "deux", "deux", 600, 700, 0.2), (1, 2, "trois", "trois", 1200, 1300, 0.9), (1, 3, "x", "x", 2000, 2100, 0.2)], WORDS + ", energy double")
    got = [(r.kind, r.kept) for r in words.gaps(w).orderBy("idx").collect()]
    assert got == [("breath", 320), ("hesitation", 220), ("hesitation", 220)]  # the last is too long for a breath


def naive_places(starts, scores, total, rules):
    x = rules.intensity / 100
    apart, quota = rules.spacing * (1.55 - 0.93 * x), max(1, round(rules.per_minute * (0.4 + 0.9 * x) * total / 60))
    chosen = []
    ranked = sorted([k for k in range(len(starts)) if scores[k] > -1], key=lambda k: (-scores[k], k))
    for k in ranked:
        if len(chosen) < quota and all(abs(starts[k] - starts[c]) >= apart for c in chosen):
            chosen.append(k)
    while True:
        at = sorted([0.0, total, *(starts[c] for c in chosen)])
        width, a, b = max(((y - x, -x, y) for x, y in zip(at, at[1:])), key=lambda v: (v[0], v[1]))
        free = [k for k in ranked if k not in chosen and -a < starts[k] < b and all(abs(starts[k] - starts[c]) >= 0.7 * apart for c in chosen)]
        if width <= rules.most_static or not free:
            return sorted(chosen, key=lambda k: starts[k])
        chosen.append(free[0])


@pytest.mark.parametrize("seed", range(20))
def test_places_of_zooms_against_a_plain_search(seed):
    r = Random(seed)
    lengths = [r.choice([1.0, 2.5, 4.0, 9.0, 30.0]) for _ in range(r.randint(1, 60))]
    starts = [sum(lengths[:k]) for k in range(len(lengths))]
    scores = [r.choice([-5.0, 0.0, 0.5, 0.5, 1.25]) for _ in lengths]
    rules = zoom_plan.ZoomRules(intensity=r.choice([0.0, 55.0, 100.0]))
    assert [k for k, _ in zoom_plan.placed(starts, scores, sum(lengths), rules)] == naive_places(starts, scores, sum(lengths), rules)


def test_plan_of_zooms(spark):
    shots = spark.createDataFrame([(rush, k, 5000 * k, 5000 * k + 4000, 4000 * k) for rush in (1, 2) for k in range(14)], "rush_id long, shot int, start long, end long, timeline_start long")
    scores = shots.where("shot <> 3").select("rush_id", "shot", F.lit(0.7).alias("score"))
    own = zoom_plan.zooms(shots, scores, seed=4)
    rows = own.orderBy("rush_id", "zoom").collect()
    one, two = ([r for r in rows if r.rush_id == k] for k in (1, 2))
    assert [r[1:] for r in one] == [r[1:] for r in two] and len(one) >= 3  # each recording draws from the seed
    assert all(a.kind != b.kind for a, b in zip(one, one[1:])) and 3 not in {r.shot for r in one}
    for r in one:
        assert 100 < r.end_scale <= 145
        if r.kind == "direct":
            assert r.start_scale == r.end_scale and r.keyframes == [] and r.seconds == 0
        else:
            assert r.start_scale == 100 and r.keyframes[0].t == 0 and r.keyframes[-1].v == pytest.approx(r.end_scale) and r.keyframes[-1].t == pytest.approx(4.0)
    ends = shots.groupBy("rush_id").agg(F.sum(F.col("end") - F.col("start")).alias("duration"))
    count = reports.zoom_counts(own, ends.unionByName(spark.createDataFrame([(9, 0)], "rush_id long, duration long"))).orderBy("rush_id").collect()
    assert (count[0].zooms, count[0].direct + count[0].progressive + count[0].launched) == (len(one), len(one))
    assert count[0].per_minute == pytest.approx(len(one) * 60 / 56) and (count[2].zooms, count[2].per_minute) == (0, 0.0)
    assert zoom_plan.zooms(shots, scores.limit(0)).count() == 0


def test_project_xml(spark):
    kept = spark.createDataFrame([(1, 0, 1000, 5000, 0), (1, 1, 6000, 9000, 4000), (1, 2, 9040, 9100, 7000)], "rush_id long, shot int, start long, end long, timeline_start long")
    clips = timeline.frame_clips(kept, 25)
    source = spark.createDataFrame([(1, "/data/a & b.mp4", 227)], "rush_id long, path string, frames long")
    zooms = spark.createDataFrame([(1, 0, "launched", 100.0, 110.0, [(0.0, 100.0), (1.0, 110.0), (99.0, 110.0)]), (1, 1, "direct", 112.0, 112.0, [])], "rush_id long, shot int, kind string, start_scale double, end_scale double, keyframes array<struct<t: double, v: double>>")
    text = projects.project_xml(clips, zooms, source, projects.Media(focus=(0.6, 0.5))).first().xml
    root = ElementTree.fromstring(text)
    video, sound = root.findall(".//video/track"), root.findall(".//audio/track")
    assert (len(video), len(sound), len(video[0].findall("clipitem"))) == (1, 2, 3)
    first = video[0].find("clipitem")
    assert [first.findtext(x) for x in ("name", "start", "end", "in", "out")] == ["a & b.mp4", "0", "100", "25", "125"]
    assert first.findtext("file/pathurl") == "file://localhost/data/a%20%26%20b.mp4" and len(root.findall(".//file/name")) == 1
    frames = [(k.findtext("when"), k.findtext("value")) for k in first.findall("filter/effect/parameter[parameterid='scale']/keyframe")]
    assert frames == [("25", "100.0000"), ("50", "110.0000"), ("125", "110.0000")]  # the last is held to the clip
    assert [k.findtext("value/horiz") for k in first.findall("filter/effect/parameter[parameterid='center']/keyframe")] == ["0.000000", "-0.010000", "-0.010000"]
    second = video[0].findall("clipitem")[1]
    assert second.findtext("filter/effect/parameter[parameterid='scale']/value") == "112.0000"
    joints = sound[0].findall("transitionitem")  # the last clip is too short, and too near the end
    assert [(j.findtext("start"), j.findtext("end"), j.findtext("cutPointTicks")) for j in joints] == [("98", "102", str(254016000000 * 4))]
    fades = [[k.findtext("when") for k in c.findall("filter/effect/parameter/keyframe")] for c in sound[0].findall("clipitem")]
    assert fades == [[], [], ["226", "227", "227", "228"]]


def test_decisions_json(spark):
    shots = spark.createDataFrame([(1, 1, 5), (1, 0, 3)], "rush_id long, shot int, end long")
    zooms = spark.createDataFrame([(2, "direct")], "rush_id long, kind string")
    got = {r.rush_id: json.loads(r.json) for r in projects.decisions_json(shots=shots, zooms=zooms).collect()}
    assert got[1] == {"format": "wordloom-edit", "format_version": 2, "shots": [{"shot": 0, "end": 3}, {"shot": 1, "end": 5}], "zooms": []}
    assert got[2]["zooms"] == [{"kind": "direct"}]


def test_transcript_json_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, 0, 0, "Un", 500, 700, 0.9), (1, 0, 1, "deux.", 735, 1000, 0.80001)], "rush_id long, seg_idx int, idx int, text string, start_ms long, end_ms long, probability double")
    s = spark.createDataFrame([(1, 0, 500, 1000, "Un deux."), (1, 1, 2000, 2500, "rien")], "rush_id long, seg_idx int, start_ms long, end_ms long, text string")
    (tmp_path / "a.json").write_text(transcripts.transcript_json(s, w).first().json)
    got = transcripts.read_json(spark, str(tmp_path / "a.json")).orderBy("idx").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.probability) for r in got] == [("Un", 500, 700, 0.9), ("deux.", 735, 1000, 0.8)]
    rows = [(r.text, r.start_ms, r.end_ms) for r in transcripts.spread(s.where("seg_idx = 0").unionByName(s.where("seg_idx = 1").withColumn("end_ms", F.col("start_ms")))).orderBy("seg_idx", "pos").collect()]
    assert rows == [("Un", 500, 750), ("deux.", 750, 1000), ("rien", 2000, 2250)]


def test_report_tables(spark):
    stats = spark.createDataFrame([(1, 1000, 600, 200, 50, 150), (2, 0, 0, 0, 0, 0)], "rush_id long, source_ms long, final_ms long, silence_ms long, hesitation_ms long, speech_ms long")
    r = reports.shares(stats).orderBy("rush_id").collect()
    assert (r[0].kept, r[0].silence, r[0].gained_ms, r[0].gained) == (0.6, 0.2, 400, 0.4) and (r[1].kept, r[1].gained) == (0.0, 0.0)
    removals = spark.createDataFrame([(1, 5, "retake", 0.8, True), (1, 6, "retake", 0.9, False)], "rush_id long, utt_id int, source string, confidence double, applied boolean")
    got = {x.utt_id: x.removed for x in reports.taken(removals.select("rush_id", "utt_id"), removals).collect()}
    assert got == {5: True, 6: False} and tuple(reports.surest(removals).first()) == (1, "retake", 2, 0.9)
    gaps = spark.createDataFrame([("short", 0), ("long", 50), ("long", 20)], "kind string, removed long")
    assert [tuple(x) for x in reports.gap_kinds(gaps).collect()] == [("long", 2, 70), ("short", 1, 0)]
    assert tuple(reports.census(spark.createDataFrame([(5,), (6,)], "size long")).first()) == (2, 11)
    assert reports.speech(spark.createDataFrame([(1, 0, 5), (1, 9, 8)], "rush_id long, start_ms long, end_ms long")).first().speech == 5
