"""Reading by suffix with errors, edits read again, the store of results, and the stream's state."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.plans import catalogue, oracle
from wordloom.sources import projects, store, transcripts
from wordloom.streaming.sessions import advance

SRT = "1\n00:00:01,000 --> 00:00:02,000\nUn deux\n\n2\n00:00:03,000 --> 00:00:03,000\nTrois\n"
JSON = '{"language": "fr", "segments": [{"start": 0, "end": 1, "text": "a b", "words": [{"text": "a", "start": 0.0, "end": 0.4}, {"word": "b", "start": 0.5, "end": 1.0, "score": 0.25}]}]}'


def test_files_are_read_by_their_suffix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("one.srt", "﻿" + SRT), ("two.VTT", "WEBVTT\n\n" + SRT.replace(",", ".").replace("\n", "\r\n")), ("three.json", JSON), ("four", JSON)):
        (tmp_path / "in" / name).write_bytes(text.encode())
    rows = transcripts.read(spark, str(tmp_path)).withColumn("f", F.regexp_extract("rush_id", r"([^/]+)$", 1)).collect()
    got = {f: [(r.idx, r.text, r.start_ms, r.end_ms, r.probability) for r in sorted(rows, key=lambda r: r.idx) if r.f == f] for f in ("one.srt", "two.VTT", "three.json", "four")}
    assert got["one.srt"] == got["two.VTT"] == [(0, "Un", 1000, 1500, 0.5), (1, "deux", 1500, 2000, 0.5), (2, "Trois", 3000, 3250, 0.5)]
    assert got["three.json"] == got["four"] == [(0, "a", 0, 400, 1.0), (1, "b", 500, 1000, 0.25)]


@pytest.mark.parametrize(("name", "text"), [("bad.json", "{not json"), ("bad.srt", "no times at all"), ("other.json", '{"x": 1}')])
def test_bad_files_are_errors_that_name_them(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    (tmp_path / "good.json").write_text(JSON)
    with pytest.raises(Exception, match=name):
        transcripts.read(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        transcripts.read(spark, str(tmp_path / "absent")).collect()


def test_edits_are_read_again(spark, tmp_path):
    shots = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 700, 900), (2, 0, 0, 10)], "rush_id long, shot long, start long, end long")
    gone = spark.createDataFrame([(1, "filler", 0.95, None), (1, "marker", 0.88, "x")], "rush_id long, source string, confidence double, text string")
    projects.decisions_json(True, shots=shots, removals=gone).select("json").write.text(f"{tmp_path}/edits")
    again = projects.read_decisions(spark, f"{tmp_path}/edits", shots="shot long, start long, end long", removals="source string, confidence double, text string")
    assert sorted(map(tuple, again["shots"].collect())) == sorted(map(tuple, shots.collect()))
    assert sorted(map(tuple, again["removals"].collect()), key=str) == sorted(map(tuple, gone.collect()), key=str)
    (tmp_path / "old.json").write_text('{"format": "wordloom-edit", "format_version": 1}')
    with pytest.raises(Exception, match="old.json"):
        projects.read_decisions(spark, str(tmp_path / "old.json"), shots="shot long")["shots"].collect()


def test_keys_tell_what_matters(spark):
    one = spark.createDataFrame([("/a", 5, "2024-01-01 00:00:00.1"), ("/a", 5, "2024-01-01 00:00:00.9"), ("/a", 6, "2024-01-01"), ("/b", 5, "2024-01-01"), ("/a", None, None)], "p string, n long, t string").withColumn("t", F.to_timestamp("t"))
    keys = lambda settings, version="1": [r[0] for r in one.select(store.key(F.col("p"), F.col("n"), F.col("t"), settings, version)).collect()]
    base = keys({"model": "small", "beam": 5})
    assert base[0] == base[1] and len(set(base)) == 4 and all(len(k) == 20 for k in base)
    assert keys({"beam": 5, "device": "gpu", "model": "small"}) == base
    assert not set(base) & set(keys({"model": "large", "beam": 5})) and not set(base) & set(keys({"model": "small", "beam": 5}, "2"))


def test_store_writes_once_and_purges(spark, tmp_path):
    own = store.Store(spark, f"{tmp_path}/store", "string")
    rows = lambda ks, v: spark.createDataFrame([(k, f"2024-01-{d:02d}", v) for k, d in ks], "key string, at string, value string").withColumn("at", F.to_timestamp("at"))
    assert own.rows().count() == 0 and own.batches() == []
    assert own.put(rows([("a", 1), ("b", 20), ("b", 21)], "first")) and own.put(rows([("a", 5), ("b", 20)], "again")) is None and own.put(rows([("a", 5), ("c", 22)], "second"))
    assert sorted((r.key, r.value, r.hit) for r in own.get(spark.createDataFrame([("a",), ("c",), ("d",)], "key string")).collect()) == [("a", "first", True), ("c", "second", True), ("d", None, False)]
    (tmp_path / "store" / "_staged-x").mkdir()  # what a writer that died has left is not seen
    assert own.missing(spark.createDataFrame([("a",), ("d",)], "key string")).collect() == [("d",)]
    assert own.purge(newest=2, days=10) == (2, 1) and sorted(r.key for r in own.rows().collect()) == ["b", "c"]
    assert own.purge(newest=0) == (0, 2) and own.rows().count() == 0


def test_state_closes_utterances_as_the_batch_does():
    rng = random.Random(6)
    words, t = [], 0
    for k in range(400):
        gap = rng.choice([35, 35, 35, 620, 619, 1150, 119, 120])
        text = rng.choice(["a", "b", "c.", "d...", "e-", "f,"])
        words.append([k, text, t + gap, t + gap + 100, t + gap, text == "c.", text == "d...", text == "e-"])
        t += gap + 100
    whole = {"waiting": list(words), "open": None, "last": None}
    want = advance(whole, t + 10_000, 5, 620, 1150)
    assert sum(x[1] for x in want) == 400 and max(x[1] for x in want) == 5 and whole["open"] is None
    for seed in range(5):
        r = random.Random(seed)
        state, got, at, late = {"waiting": [], "open": None, "last": None}, [], 0, list(words)
        while late or state["waiting"] or state["open"]:
            upto = at
            at += r.randint(50, 3000)
            arrive = [w for w in late if w[4] <= at + r.randint(0, 2000)]
            r.shuffle(arrive)
            late = [w for w in late if w not in arrive]
            state["waiting"] += arrive
            got += advance(state, upto, 5, 620, 1150)
        assert got == want


def test_stream_equals_the_batch(spark):
    name = "streamed_utterances"
    assert name in oracle.oracle_sql()
    got = sorted(map(tuple, catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    u = catalogue.queries()["utterance_sessions"](spark, "/root/testdata/sf0.001")
    assert got == sorted(map(tuple, u.select("rush_id", F.col("first_idx").cast("long"), "n_words", "start_ms", "end_ms", "reason", "text").collect()))
