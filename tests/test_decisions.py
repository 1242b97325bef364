"""From findings to shots with withdrawal, word sets as runs, and the package on executors that lack it."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordloom.operators import decisions, disfluency, intervals
from wordloom.plans import catalogue
from wordloom.tables import cut, shared_folder


def clock(spark, words, gap=40, rush=0):
    rows, t = [], 0
    for k, w in enumerate(words):
        text, pause, length = w if isinstance(w, tuple) else (w, gap, 300)
        t += pause
        rows.append((rush, k, text, text.lower().strip(".,-!"), t, t + length))
        t += length
    return spark.createDataFrame(rows, "rush_id long, idx int, text string, norm string, start_ms long, end_ms long")


def found(*rows):
    return [(0, s, a, b, c, w) for s, a, b, c, w in rows]


FINDINGS = "rush_id long, source string, start_ms long, end_ms long, confidence double, words array<int>"


def test_subtract_against_points(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.randint(0, 3), a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 60) for _ in range(n))]
    base, holes = rows(60), rows(40)
    table = lambda r: spark.createDataFrame(r, "k int, start long, end long")
    got = {(r.k, r.start, r.end) for r in intervals.subtract(table(base), table(holes), "k").collect()}
    inside = lambda r, k, t: any(x == k and a <= t < b for x, a, b in r)
    points = {(k, t) for k in range(4) for t in range(0, 80) if inside(base, k, t) and not inside(holes, k, t)}
    assert {(k, t) for k, a, b in got for t in range(a, b)} == points
    assert all((k, b) not in points for k, _, b in got)


def test_sets_of_words(spark):
    rng = random.Random(2)
    sets = [{(k, i) for k in range(98) for i in range(60) if rng.random() < 0.3 and (k % 3 or n == 0)} for n in (0, 1)]
    a, b = (decisions.runs(cut(spark.createDataFrame(sorted(s), "rush_id long, idx int").repartition(4))) for s in sets)
    words = lambda d: {(r.rush_id, r.idx) for r in decisions.members(d).collect()}
    assert words(a) == sets[0] and words(b) == sets[1]
    assert words(decisions.union(a, b)) == sets[0] | sets[1] and words(decisions.difference(a, b)) == sets[0] - sets[1]
    inside = {r.rush_id: r.inside for r in decisions.subset(decisions.difference(a, b), decisions.difference(a, decisions.runs(spark.createDataFrame([(1, 70)], "rush_id long, idx int")))).collect()}
    assert all(inside.values()) and set(inside) == {k for k, _ in sets[0] - sets[1]}
    part = {r.rush_id: r.inside for r in decisions.subset(a, b).collect()}
    assert part == {k: not any(x == k for x, _ in sets[0] - sets[1]) for k in {x for x, _ in sets[0]}}


def test_unions_of_shuffled_inputs_are_sound(spark):
    """Without ``sound_unions`` Spark 4.1.2 gives 0 recordings here."""
    rows = [(k, a, a + 1) for k in range(98) for a in range(0, 50, 10)]
    table = lambda r: cut(spark.createDataFrame(r, "rush_id long, start long, end long"))
    every, some = table(rows), table([r for r in rows if r[0] % 3])
    back = decisions.runs(every.where("start = 20").select("rush_id", F.col("start").cast("int").alias("idx")))
    got = decisions.subset(decisions.difference(every, back), decisions.difference(some, back)).where("inside")
    assert got.count() == sum(1 for k in range(98) if k % 3)


def test_removals_whose_words_survive_are_withdrawn(spark):
    words = clock(spark, ["One", "euh", "two", ("three.", 2000, 300), "euh", "four", "five."])
    rows = found(("filler", 380, 680, 0.95, [1]), ("filler", 3360, 3660, 0.95, [4]), ("filler", 700, 1000, 0.3, [2]))
    made = decisions.edit(words, spark.createDataFrame(rows, FINDINGS), decisions.EditRules(least_shot=100))
    assert {(tuple(r.words), r.applied, r.withdrawn) for r in made.removals.collect()} == {((1,), True, False), ((4,), True, False), ((2,), False, False)}
    assert {(r.start, r.end) for r in made.removed.collect()} == {(1, 2), (4, 5)} == {(r.start, r.end) for r in made.benign.collect()}
    shots = [(r.start, r.end) for r in made.shots.orderBy("shot").collect()]
    centres = {r.idx: (r.start_ms + r.end_ms) / 2 for r in words.collect()}
    assert not any(a <= centres[k] <= b for a, b in shots for k in (1, 4)) and all(any(a <= centres[k] <= b for a, b in shots) for k in (0, 2, 3, 5, 6))
    wide = decisions.edit(words, spark.createDataFrame(rows, FINDINGS), decisions.EditRules(least_shot=3500))
    assert [r.withdrawn for r in wide.removals.where("applied or withdrawn").collect()] == [True, True] and wide.removed.count() == 0 == wide.benign.count()


def test_modes(spark):
    words = clock(spark, ["One", "euh", "two", ("three.", 2000, 300)])
    rows = spark.createDataFrame(found(("filler", 380, 680, 0.95, [1])), FINDINGS)
    dry, still = (decisions.edit(words, rows, decisions.EditRules(mode=m)) for m in ("dry_run", "silences_only"))
    assert [(r.applied, r.withdrawn) for r in dry.removals.collect()] == [(False, False)] and still.removals.count() == 0
    assert dry.removed.count() == still.removed.count() == 0
    assert sorted(map(tuple, dry.shots.select("start", "end").collect())) == sorted(map(tuple, still.shots.select("start", "end").collect()))
    with pytest.raises(ValueError):
        decisions.EditRules(mode="other")


def test_removed_speech_is_limited(spark):
    words = clock(spark, [("word", 40, 10_000)] * 10)
    rows = found(*(("retake", k * 10_040 + 40, (k + 1) * 10_040, 0.62 + k / 100, [k]) for k in range(8)))
    made = decisions.edit(words, spark.createDataFrame(rows, FINDINGS))
    assert sorted(tuple(r.words) for r in made.removals.where("limited").collect()) == [(0,), (1,), (2,)]
    assert decisions.summary(made).first().removed_words == 5


def test_all_detectors_feed_an_edit(spark):
    w = cut(catalogue.spoken_clock(spark, "/root/testdata/sf0.001"))
    every = cut(decisions.hesitations(w).unionByName(decisions.attempts(w)))
    assert {"filler", "stutter", "abandoned", "marker"} <= {r.source for r in every.select("source").distinct().collect()}
    made = decisions.edit(w, every)
    assert made.removals.count() == every.count()
    gone = {(r.rush_id, i) for r in made.removals.where("applied").collect() for i in r.words}
    assert {(r.rush_id, r.idx) for r in decisions.members(made.removed).collect()} <= gone
    assert decisions.summary(made).count() == w.select("rush_id").distinct().count()


def test_phrases_that_overlap_are_refused(spark):
    with pytest.raises(ValueError):
        disfluency.distinct_phrases(("a b", "b c"))
    assert disfluency.distinct_phrases(("a b", "a b c")) == [["a", "b"], ["a", "b", "c"]]


def test_shared_folder(spark):
    assert cut(spark.range(3)).count() == 3 and shared_folder(spark) == shared_folder(spark)


UDFS = ("split_utterances", "zoom_plan")


def test_queries_from_another_folder(tmp_path):
    """Python functions run on executors that have neither the repository as working folder nor on their path."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {f"file://{tmp_path}/shared"!r}).getOrCreate()
from wordloom.plans import catalogue
for name in {UDFS!r}:
    print(name, catalogue.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[0] for x in out.stdout.splitlines()] == list(UDFS), out.stderr[-2000:]
