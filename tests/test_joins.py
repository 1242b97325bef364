"""Range assignment, containment, alignment, chunks and stable modes against plain Python."""

import random
from difflib import SequenceMatcher
from os.path import commonprefix

import pytest
from pyspark.sql import functions as F

from wordloom import catalogue
from wordloom.functions import markers as M
from wordloom.operators import alignment, containment, ranges, similarity, words


@pytest.mark.parametrize(("part", "closed"), [(1 << 16, True), (3, True), (3, False)])
def test_hits_are_all_points_in_spans(spark, part, closed):
    rng = random.Random(part)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 50, *range(100)]), i) for i in range(150)] + [(1, 50, 1)] * 20
    spans = [(rng.choice([1, 2, None]), a, a + rng.choice([-1, 0, 5, 60]), i) for i, a in enumerate(rng.choices(range(-20, 100), k=40))] + [(1, None, 5, 99)]
    p, s = spark.createDataFrame(points, "k int, t long, id int"), spark.createDataFrame(spans, "k int, start long, end long, name int")
    got = sorted((r.k, r.t, r.id, r.span.name) for r in ranges.hits(p, s, "k", 10, closed, part).collect())
    inside = lambda t, a, b: a <= t <= b if closed else a <= t < b
    assert got == sorted((k, t, i, n) for k, t, i in points for j, a, b, n in spans if None not in (k, t, a) and k == j and b >= a and inside(t, a, b))
    assert ranges.hits(p.limit(0), s, "k", 10).count() == 0 == ranges.hits(p, s.limit(0), "k", 10).count()


@pytest.mark.parametrize(("part", "closed"), [(1 << 16, True), (3, True), (3, False)])
def test_holders_are_counted_without_their_meetings(spark, part, closed):
    rng = random.Random(part)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 50, *range(100)]), i) for i in range(150)] + [(1, 50, 1)] * 20
    spans = [(rng.choice([1, 2, None]), a, a + rng.choice([-1, 0, 5, 60]), i) for i, a in enumerate(rng.choices(range(-20, 100), k=60))] + [(1, None, 5, 99), (1, 30, None, 98), (1, 7, 7, 97)]
    p, s = spark.createDataFrame(points, "k int, t long, id int"), spark.createDataFrame(spans, "k int, start long, end long, name int")
    got = sorted((r.k, r.t, r.id, r.n, r.first.start, r.first.name) for r in ranges.holders(p, s, "k", 10, ["name"], closed, part).collect())
    inside = lambda t, a, b: a <= t <= b if closed else a <= t < b
    want = []
    for k, t, i in points:
        own = sorted((a, n) for j, a, b, n in spans if None not in (k, t, a, b) and k == j and inside(t, a, b))
        want += [(k, t, i, len(own), *own[0])] if own else []
    assert got == sorted(want)
    assert ranges.holders(p.limit(0), s, "k", 10, ["name"]).count() == 0 == ranges.holders(p, s.limit(0), "k", 10, ["name"]).count()


def test_range_assign_makes_no_pairs_of_points_and_spans(spark, tmp_path):
    t = "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 500)"
    spark.range(2000).selectExpr("id as event_id", f"{t} as ts", "0L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2000).selectExpr("id * 864000 as o_orderkey", "0L as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()["range_assign"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[0]  # nothing meets after the sweep
    day = 1704067200 % 864000
    got = {(r.event_id, r.n, r.first_order) for r in got.collect()}
    spans = [(0, 600 + k * 864000 % 7200, k * 864000) for k in range(2000)]
    want = {(e, len(own), min(own)[1]) for e in range(2000) if (own := [(a, o) for a, b, o in spans if a <= day + e % 500 <= b])}
    assert got == want


def test_first_hit_keeps_every_point(spark):
    p, s = spark.createDataFrame([(1, 5), (1, 50), (None, 5)], "k int, t long"), spark.createDataFrame([(1, 0, 5, "b"), (1, 5, 9, "a")], "k int, start long, end long, name string")
    got = ranges.first_hit(p, s, "k", ["k", "t"], 10, F.col("span.start")).select("k", "t", "span.name").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 5, "b"), (1, 50, None), (None, 5, None)], key=str)


def test_chunks_and_owned_words(spark):
    w = spark.createDataFrame([(1, k, k * 900, k * 900 + 100, f"w{k}") for k in range(60)], "rush_id int, idx int, start_ms long, end_ms long, text string")
    twice = ranges.heard(w, 10_000, 1_000)
    assert twice.count() > 60
    once = ranges.owned(twice, "rush_id", 10_000, 1_000).collect()
    assert sorted(r.idx for r in once) == list(range(60)) and all(r.window * 10_000 - 250 <= r.start_ms < (r.window + 1) * 10_000 + 250 for r in once)
    assert [r.chunk for r in ranges.chunked(w, "rush_id", "idx", 25).orderBy("idx").collect()] == [k // 25 for k in range(60)]
    with pytest.raises(ValueError):
        ranges.chunked(w, "rush_id", "idx", 0)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_containment_loses_no_pair(spark, least):
    rng = random.Random(int(least * 10))
    vocabulary = [f"word{k}" for k in range(40)] + ["car", "le", "the", "air"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    small, large = [(i, text(rng.randint(0, 8))) for i in range(30)] + [(5, "word1 word2"), (50, None)], [(i, text(rng.randint(0, 30))) for i in range(60)] + [(7, None), (8, "")]
    got = containment.held(spark.createDataFrame(small, "small_id int, text string"), spark.createDataFrame(large, "large_id int, text string"), least).collect()
    content = lambda t: list(dict.fromkeys(w for w in (t or "").split() if similarity.is_content(w)))
    weigh = lambda ws: sum(35 if w in similarity._GENERIC else 100 for w in ws)
    want = []
    for i, a in small:
        for j, b in large:
            own, other = content(a), content(b)
            shared = sorted(set(own) & set(other))
            if own and shared and weigh(shared) >= least * weigh(own):
                want.append((i, j, shared, [w for w in own if w not in other], round(weigh(shared) / weigh(own), 9)))
    assert sorted((r.small_id, r.large_id, r.shared, r.lost, round(r.containment, 9)) for r in got) == sorted(want)


def test_alignment_against_the_matrix(spark):
    rng = random.Random(8)
    vocabulary = "moteur moteurs competition competitions le la tres car manger mangeait mangera euh rapide rapidement un deux trois".split()
    pairs = [(rng.choices(vocabulary, k=rng.randint(0, 12)), rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(150)] + [(None, ["un"]), (["un"], None)]
    described = lambda c: alignment.described(F.col(c))
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", alignment.align(described("a"), described("b")).alias("x")).collect()
    for r in got:
        a, b = r.a or [], r.b or []
        gain = similarity.np.array([[similarity.degree(x, y) * similarity.weight(x) for y in b] for x in a]).reshape(len(a), len(b))
        whole = sum(map(similarity.weight, a))
        assert r.x == pytest.approx(similarity.in_order(gain) / whole if whole and b else 0.0)


def plain_degree(x, y):
    if x == y:
        return 1.0
    if similarity.stem(x) == similarity.stem(y):
        return 0.92
    start, shorter = len(commonprefix((x, y))), min(len(x), len(y))
    if start >= 4 and start >= 0.70 * shorter:
        return 0.80
    return 0.80 if shorter >= 5 and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.86 else 0.0


def test_degrees_by_definition():
    """Filters by lengths and trigrams lose no pair of words."""
    rng, found = random.Random(0), 0
    for _ in range(20_000):
        x = "".join(rng.choices("abcde", k=rng.randint(1, 24)))
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 1))
        found += plain_degree(x, "".join(y)) > 0
        assert similarity.degree(x, "".join(y)) == plain_degree(x, "".join(y))
    assert found > 5_000


def test_dominant_value_is_the_first_of_equals(spark):
    rows = [(1, 0, "fr"), (1, 1, "en"), (1, 2, "en"), (1, 3, "fr"), (2, 0, None), (2, 1, ""), (3, 0, None), (3, 5, "en"), (3, 4, "fr")]
    got = words.dominant(spark.createDataFrame(rows, "u int, idx int, language string"), ["u"])
    assert sorted(map(tuple, got.collect())) == [(1, "fr"), (3, "fr")]


def test_completeness(spark):
    texts = ["Le moteur rapide tourne vraiment bien demain.", "Le moteur et", "Je recommence.", "", None, "moteur-", "Le moteur..."]
    own = M.with_marks(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "utt_id int, text string"))
    got = dict(own.select("utt_id", F.round(M.completeness(), 3)).collect())
    assert got[0] == pytest.approx(0.8 + 0.028 * 5) and got[1] == pytest.approx(0.2 + 0.028) and got[2] < 0.5 and got[5] == pytest.approx(0.38 + 0.028) and got[6] == pytest.approx(0.28 + 0.028)
