import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import markers as M
from wordloom.functions import text as T
from wordloom.operators import intervals, retakes, seams, similarity, timeline, words
from wordloom.plans import catalogue

UTTERANCE = "rush_id long, utt_id long, start_ms long, end_ms long, text string"


def utterances(spark, texts, rush=1):
    return spark.createDataFrame([(rush, i, 3000 * i, 3000 * i + 2000, t) for i, t in enumerate(texts)], UTTERANCE)


def chain(a, b):
    """The best order-keeping chain by plain recursion over all cells."""
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + similarity.degree(x, y) * similarity.weight(x))
    return best[-1][-1]


def test_chain_by_brute_force():
    r, vocabulary = random.Random(1), "jouer jouaient joueurs le la competition competetion saison saisons fort".split()
    for _ in range(200):
        a, b = (r.choices(vocabulary, k=r.randint(1, 9)) for _ in "ab")
        gain = np.array([[similarity.degree(x, y) * similarity.weight(x) for y in b] for x in a])
        assert similarity.in_order(gain) == pytest.approx(chain(a, b))


def test_words_alike():
    assert similarity.degree("roulaient", "rouler") == 0.92
    assert similarity.degree("competition", "competetion") == 0.80
    assert similarity.degree("persos", "tables") == 0.0
    assert similarity.oral("du coup il y a pas mal de gens euh".split()) == "il y a quelques gens".split()
    assert similarity.oral(["euh"]) == ["euh"]


def test_compare_empty_and_equal():
    names = [m.split()[0] for m in similarity.MEASURES.split(", ")]
    same = dict(zip(names, similarity.compare("les joueurs japonais gagnent".split(), "les joueurs japonais gagnent".split())))
    assert same["score"] == 1.0 and same["align"] == 1.0 and same["prefix_tokens"] == 4 and same["lost"] == []
    assert all(not x for x in similarity.compare(None, ["a"])) and len(similarity.compare([], [])) == len(names)


def test_markers(spark):
    rows = spark.createDataFrame([("non, je recommence.",), ("Non non",), ("je recommence la partie demain",), ("",), (None,), ("attends euh non",)], "t string")
    norm = T.normalize_text("t")
    got = rows.select(M.strong_marker(norm).alias("s"), M.standalone_marker(norm).alias("a")).collect()
    assert [(r.s, r.a) for r in got[:4]] == [(True, True), (False, True), (True, False), (False, False)]
    assert (got[5].s, got[5].a) == (False, True)


def test_marker_makes_the_attempt_go(spark):
    u = utterances(spark, ["Les joueurs japonais étaient", "Non, je recommence.", "Les joueurs japonais étaient vraiment redoutables cette saison.", "Passons au classement complet des équipes."])
    got = {(r.utt_id, r.role, r.anchor, r.kept_utt) for r in retakes.retakes(u).collect()}
    assert got == {(0, "attempt", "marker", 2), (1, "marker", "marker", 2)}


def test_better_version_before(spark):
    u = utterances(spark, ["Les joueurs japonais dominent le classement mondial cette saison.", "Les joueurs japonais dominent le"])
    got = retakes.retakes(u).collect()
    assert [(r.utt_id, r.anchor, r.kept_utt) for r in got] == [(1, "better before", 0)]


def test_unlike_sentences_stay_and_lone_ones_go(spark):
    u = utterances(spark, ["Voici le classement complet.", "Et...", "Demain nous partons à la montagne.", "Je recommence.", None])
    got = {(r.utt_id, r.anchor) for r in retakes.retakes(u).collect()}
    assert got == {(1, "lone connector"), (3, "lone marker")}
    assert retakes.retakes(utterances(spark, ["a"]).limit(0)).count() == 0


def test_fragments(spark):
    u = utterances(spark, ["Un premier propos entier.", "les joueurs", "Les joueurs japonais gagnent toujours."])
    removed = spark.createDataFrame([(1, 0)], "rush_id long, utt_id long")
    got = retakes.fragments(u, removed).collect()
    assert [(r.utt_id, r.confidence, r.unique) for r in got] == [(1, 0.81, [])]


def test_fragments_between_the_nearest_kept(spark):
    r, said = random.Random(8), script(8, 80)
    u, gone = utterances(spark, said), {i for i in range(80) if r.random() < 0.4}
    got = retakes.fragments(u, spark.createDataFrame([(1, i) for i in gone], "rush_id long, utt_id long"))
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()  # such a frame is read anew for each row
    content = {x.utt_id: x.content for x in M.with_marks(u).select("utt_id", "content").collect()}
    rows = got.collect()
    for x in rows:
        left = next((content[i] for i in range(x.utt_id - 1, -1, -1) if i not in gone), [])
        right = next((content[i] for i in range(x.utt_id + 1, len(said)) if i not in gone), [])
        assert x.unique == sorted(set(content[x.utt_id]) - {*left, *right})
    assert len(rows) > 5


def script(seed, n):
    """Sentences with restarts, markers, loose ends and small slips among others that have nothing in common."""
    r, out = random.Random(seed), []
    vocabulary = "jouer jouaient joueurs le la competition competetion saison saisons fort classement mondial equipe equipes demain montagne japonais gagnent euh du coup pas mal de".split()
    for k in range(n):
        words_ = r.choices(vocabulary, k=r.randint(1, 14))
        if out and r.random() < 0.4:
            words_ = out[-1].rstrip(".-").split()[: r.randint(1, 9)] + r.choices(vocabulary, k=r.randint(0, 5))
        out.append(" ".join(words_) + r.choice([".", ".", "-", " et", ""]))
        if r.random() < 0.12:
            out.append(r.choice(["Non, je recommence.", "Attends.", "On coupe.", "Et..."]))
    return out


def test_scores_of_many_pairs_as_of_one():
    names, r = [m.split()[0] for m in similarity.MEASURES.split(", ")], np.random.RandomState(5)
    said = [" ".join(t.lower().replace(".", "").replace(",", "").split()) for t in script(5, 500)]
    said += ["", "euh", "du coup", "a", "pas mal de gens", "x\u00a0y z", "\U0001f600 \U0001f600\U0001f600 saison", " ".join(said[:40]), " ".join(said[40:75])]
    a, b = (np.concatenate([own, r.randint(-1, len(said), 2500)]) for own in (np.arange(len(said) - 1), np.arange(1, len(said))))
    got = similarity.scores(said, a, b)
    words_ = lambda k: None if k < 0 else said[k].split(" ") if said[k] else []
    want = [similarity.compare(words_(x), words_(y)) for x, y in zip(a, b)]
    for name in similarity.SCORES:
        assert got[name].tolist() == [w[names.index(name)] for w in want], name
    assert len(set(got["score"])) > 50 and all(not x.size for x in similarity.scores([], a[:0], b[:0]).values())


def test_scores_look_at_few_cells_one_by_one(monkeypatch):
    calls = []
    for f in ("degree", "_begun_alike"):
        monkeypatch.setattr(similarity, f, lambda x, y, f=getattr(similarity, f): (calls.append((x, y)), f(x, y))[1])
    r = random.Random(6)
    said = [" ".join("".join(r.choices("bcdfgklmnprstvz", k=7)) for _ in range(8)) for _ in range(1000)]
    similarity.scores(said, np.arange(999), np.arange(1, 1000))
    assert len(calls) < 999  # of 64 cells a pair


def test_pair_similarity_makes_scores_of_many_pairs(spark):
    sf = "/root/testdata/sf0.001"
    p, own = retakes.utterance_pairs(words.utterances(catalogue.clock(spark, sf))), catalogue.pair_similarity(spark, sf)
    want = p.select("rush_id", F.col("a.utt_id").cast("long").alias("a"), F.col("b.utt_id").cast("long").alias("b"), *(F.round(F.col("m")[c], 6).alias(c) for c in similarity.SCORES))
    assert own.dtypes == want.dtypes and sorted(own.collect()) == sorted(want.collect()) and own.count() > 500
    assert "MapInArrow" in (plan := own._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in plan
    u = utterances(spark, ["Les joueurs gagnent.", "Je recommence.", None, "", "Les joueurs japonais gagnent."])
    got = {(x.a, x.b): (x.score, x.align) for x in retakes.pair_scores(u).collect()}
    assert {k: (x, y) for (k, x, y) in retakes.utterance_pairs(u).select(F.struct("a.utt_id", "b.utt_id"), "m.score", "m.align").collect()} == got and len(got) == 10 and got[0, 4] == (1.0, 1.0)


def test_begins_is_false_only_where_nothing_starts_over():
    r, n = random.Random(4), [0, 0]
    said = [" ".join(t.lower().replace(".", "").replace(",", "").split()) for t in script(4, 600)]
    for a, b in zip(said, said[1:]):
        m = similarity.compare(a.split(), b.split())
        want = m[9] or m[10]
        n[bool(want)] += 1
        assert similarity.begins(a, b) or not want
    assert min(n) > 30 and not similarity.begins("", "a") and not similarity.begins("voici une autre table", "demain nous partons loin")


def test_retakes_measure_only_pairs_that_may_decide(spark):
    rules = retakes.RetakeRules()
    rows = [(rush, i, 3000 * i, 3000 * i + 2000, t) for rush in range(3) for i, t in enumerate(script(rush, 120)) if (rush, i) != (0, 7)]
    u = spark.createDataFrame(rows + [(None, 1, 0, 5, "Et la saison."), (9, None, 0, 5, "Et la saison.")], UTTERANCE)
    every = retakes.judged_pairs(retakes.utterance_pairs(u), rules).groupBy("rush_id").applyInPandas(retakes._choose, retakes._CHOSEN).withColumn("confidence", F.round("confidence", 3))
    own = retakes.retakes(u).where("group_id is not null")
    assert sorted(every.collect()) == sorted(own.collect()) and own.count() > 30
    at = [(rush, i) for rush, i, *_ in rows]
    assert sorted((p.rush_id, p.a.utt_id, p.b.utt_id) for p in retakes.utterance_pairs(u).select("rush_id", "a", "b").collect()) == sorted((r, i, j) for r, i in at for j in range(i + 1, i + 6) if (r, j) in at)
    alone = utterances(spark, [" ".join("".join(random.Random(100 * k + j).choices("bcdfgklmnprstvz", k=7)) for j in range(8)) + "." for k in range(40)])
    assert retakes._deciding(retakes._neighbours(alone, rules), rules).count() < 40 / 4


def test_seams(spark):
    w = words.word_clock(spark.createDataFrame([(1, 0, "je parle de euh choses et mais enfin voila de montagne")], "rush_id long, seg_idx long, text string"))
    cut = w.where("idx in (3, 6, 7)")
    spans = cut.select("rush_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    shots = timeline.shots(w, intervals.merge(spans, "rush_id", 35))
    got = {(r.shot, r.category) for r in seams.seams(shots, w, cut, cut.where("idx = 3")).collect()}
    assert (2, "dangling end") in got  # "et" before two words that went
    assert (1, "dangling end") not in got  # only a filler went


def test_curves_and_edit_list(spark):
    x = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "x double")
    for name in ("linear", "smoothstep", "smootherstep", "progressive", "ease_out_expo", "ballistic"):
        got = [r.y for r in x.select(timeline.curve(name, F.col("x")).alias("y")).collect()]
        assert got[0] == pytest.approx(0) and got[2] == pytest.approx(1) and got[3] == pytest.approx(1)
    shots = spark.createDataFrame([(1, 0, 0, 1000, 0), (1, 1, 61_000, 62_000, 1000)], "rush_id long, shot long, start long, end long, timeline_start long")
    edl = timeline.edit_list(shots, "t").first().edl
    assert "001  AX       AA/V  C        00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00\n" in edl
    assert "002  AX       AA/V  C        00:01:01:00 00:01:02:00 00:00:01:00 00:00:02:00\n" in edl
