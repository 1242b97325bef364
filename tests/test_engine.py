import duckdb
import pytest

from wordloom import catalogue
from wordloom.functions import text as T
from wordloom.operators import disfluency, intervals, words
from wordloom.sources import transcripts

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "documents", "benchmark", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["word_clock", "utterance_sessions", "gap_summary", "timeline_shots", "merge_intervals", "subtract_intervals", "event_sessions", "removal_budget"])
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect())) == sorted(want.fetchall())


def test_normal_words(spark):
    rows = spark.createDataFrame([("«Déjà,»",), ("J’ai",), ("peut-être…",), ("",), (None,)], "w string").select(T.normalize_word("w").alias("n")).collect()
    assert [r.n for r in rows] == ["deja", "j'ai", "peut-etre", "", None]


def test_word_ends(spark):
    rows = spark.createDataFrame([("fin.",), ("Raru...",), ("fin.»",), ("a,",), ("cou-",), ("",)], "w string")
    got = rows.select(T.ends_sentence("w").alias("s"), T.ends_suspension("w").alias("u"), T.ends_clause("w").alias("c"), T.is_truncated("w").alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, False), (True, False, False, False), (False, False, True, False), (False, False, False, True), (False, False, False, False)]


def test_intervals(spark):
    base = spark.createDataFrame([(1, 0, 10)], "k int, start long, end long")
    holes = spark.createDataFrame([(1, 2, 3), (1, 5, 6)], "k int, start long, end long")
    assert sorted((r["start"], r["end"]) for r in intervals.subtract(base, holes, "k").collect()) == [(0, 2), (3, 5), (6, 10)]
    many = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 5), (1, 6, 7), (1, 6, 9)], "k int, start long, end long")
    assert sorted((r["start"], r["end"]) for r in intervals.merge(many, "k").collect()) == [(0, 3), (6, 9)]


def test_spaced_top_by_hand(spark):
    rows = spark.createDataFrame([(1, float(t), float(s), t) for t, s in ((3, 9), (5, 8), (11, 7), (12, 6), (20, 5), (40, 1))], "k int, t double, score double, id int")
    got = intervals.spaced_top(rows, "k", 5, 3).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 11, 20]


def test_detectors_on_a_script(spark):
    said = spark.createDataFrame([(1, 0, "euh je je vais compe competition très très bien")], "rush_id long, seg_idx long, text string")
    w = words.word_clock(said)
    assert [r.norm for r in disfluency.hard_fillers(w).collect()] == ["euh"]
    assert [(r.norm, r.n) for r in disfluency.stutter_runs(w).collect()] == [("je", 2)]
    assert [(r.norm, r.target) for r in disfluency.abandoned_words(w).collect()] == [("compe", "competition")]


def test_disfluencies_in_order(spark):
    scripts = [
        "je pense je pense que cela marche", "je euh je vais la", "une compe- competition ouverte", "i i mean it works", "tres tres bien fait",
        "il faut que il faut que il faut que marcher", "et compe competition", "non nonante jours", "ma- ma- maison",
    ]
    rows = []
    for rush, script in enumerate(scripts):
        at = 500
        for idx, text in enumerate(script.split()):
            rows.append((rush, idx, text, at, at + 115 + 52 * len(text)))
            at += 150 + 52 * len(text)
    w = spark.createDataFrame(rows, "rush_id long, idx int, text string, start_ms long, end_ms long").withColumn("norm", T.normalize_word("text"))
    got = disfluency.disfluencies(w).collect()
    assert sorted((r.rush_id, r.kind, r.words, r.confidence, r.kept_text) for r in got) == [
        (0, "stutter", [0, 1], 0.86, "je pense"), (1, "filler", [1], 0.95, ""), (1, "stutter", [0], 0.92, "je"), (2, "abandoned", [1], 0.93, "competition"),
        (3, "filler_phrase", [1, 2], 0.8, ""), (5, "stutter", [2, 3, 4, 5], 0.86, "il faut que"), (6, "abandoned", [1], 0.66, "competition"),
        (8, "abandoned", [1], 0.93, "maison"), (8, "stutter", [0], 0.92, "ma-"),
    ]
    assert "disfluencies" in catalogue.queries()


def test_srt_round_trip(spark, tmp_path):
    path = tmp_path / "a.srt"
    path.write_text("1\n00:00:01,500 --> 00:00:02,000\nbonjour\n\n2\n00:00:03,000 --> 00:00:04,250\nà tous\n", encoding="utf-8")
    cues = transcripts.read_srt(spark, str(path))
    assert [(r.start_ms, r.end_ms, r.text) for r in cues.orderBy("seg_idx").collect()] == [(1500, 2000, "bonjour"), (3000, 4250, "à tous")]
    assert transcripts.srt_blocks(cues).first().srt == path.read_text(encoding="utf-8")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
