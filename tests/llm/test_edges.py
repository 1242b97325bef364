"""Odd tables: ids of several types and null, clashing columns, repeated rows, empty tables, through operators and stages."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wordloom.llm import decontam, langid, line_dedup, lm_scoring, ngram_join, packing, quality, sharding, token_files, toxicity
from wordloom.llm.common import spare

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ("g_id", "g_th", "b_id", "b_th", "kept_before", "score", "Th", "uid", "node", "bands", "shard", "slot", "piece", "label", "terms", "n_chars", "_at")
ITEM = " ".join(f"item{k}" for k in range(20))
BODY = [" ".join(f"w{d}x{k}" for k in range(30)) for d in range(8)]
SHARED = "a line that stands in several documents of this table"


def documents(spark, kind):
    texts = [
        (1, BODY[0] + "\n" + SHARED), (2, BODY[1] + "\n" + SHARED), (3, BODY[2] + "\n" + SHARED), (4, BODY[3]), (5, BODY[3]), (5, BODY[3]),
        (6, None), (7, ""), (None, BODY[4]), (None, BODY[5]), (None, "before it " + ITEM + " after it"), (None, None), (8, "x " + ITEM + " y"), (9, BODY[6]), (9, BODY[7]),
    ]
    rows = [(i, t, "en", *(f"mine {c} {k}" for c in EXTRA if c != "n_chars")) for k, (i, t) in enumerate(texts)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA if c != "n_chars"))
    return own.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("doc_id", F.col("doc_id").cast(kind))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    labels = [(1, 0), (4, 0), (None, 1), (3, None), (77, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, ""), (3, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_stages_keep_columns_and_rows(spark, tables, kind):
    docs = documents(spark, kind)
    before = values(docs)
    kept = {name: f(spark, docs, tables) for name, f in corpus_pipeline.STAGES}
    for name in ("toxicity", "line_dedup", "ngram_join", "decontamination"):
        assert kept[name].schema == docs.schema, name
    assert values(kept["toxicity"]) == before
    lines = {r.score: r for r in kept["line_dedup"].collect()}
    assert len(lines) == len(before)
    for r in docs.collect():
        own = lines[r.score]
        lost = r.text is not None and SHARED in r.text and "0" <= str(r.doc_id) < "3"
        assert own.text == (r.text.replace("\n" + SHARED, "") if lost else r.text)
        assert own.n_chars == (None if own.text is None else len(own.text))
        assert [own[c] for c in EXTRA if c != "n_chars"] == [r[c] for c in EXTRA if c != "n_chars"]
    near = values(kept["ngram_join"].groupBy("text").count())
    assert sorted(map(str, near)) == sorted(map(str, values(docs.where("text is not null and text <> ''").groupBy("text").agg(F.lit(1).alias("count"))) + [(None, 2), ("", 1)]))
    assert kept["ngram_join"].where(F.col("text") == BODY[3]).first().doc_id == docs.where("doc_id = 4").first().doc_id
    assert values(kept["decontamination"]) == values(docs.where(~F.coalesce(F.col("text").contains(ITEM), F.lit(False))))
    assert kept["packing"].select("doc_id", "doc_tokens").where("doc_id is null").count() == 4


def test_stages_of_an_empty_table(spark, tables):
    none = documents(spark, "long").limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, tables).count() == 0, name


def test_operators_take_ids_of_any_type(spark):
    for kind in ("int", "string"):
        docs = documents(spark, kind)
        n = docs.count()
        joined = ngram_join.ngram_join(docs)
        assert joined.count() == n and joined.schema["class_id"].dataType == docs.schema["doc_id"].dataType
        assert langid.predict(docs, langid.fit(docs)).count() == n
        assert lm_scoring.scores(docs).count() == n
        assert sharding.kd_shards(docs, 3).count() == n
        assert quality.judged(docs).count() == n
        assert packing.pack(docs, PATH).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert toxicity.score(docs.drop("score"), toxicity.Machine(0.0)).count() == n
    assert token_files.round_trip(documents(spark, "int"), PATH).count() == n
    with pytest.raises(TypeError):
        token_files.round_trip(documents(spark, "string"), PATH)


def test_taken_names_are_errors(spark):
    docs = documents(spark, "long")
    with pytest.raises(ValueError):
        line_dedup.with_bitmaps(docs)
    assert spare(docs, "TH", "th", "free") == ("TH_", "th__", "free")


def test_rows_of_one_id_are_judged_each_by_its_text(spark, tables):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    docs = spark.createDataFrame([(1, ITEM), (1, "clean words only"), (None, ITEM), (None, "clean too")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.decontaminate(docs, bench).collect()) == ["clean too", "clean words only"]
    found = decontam.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.start_word, r.n_words, r.edits) for r in found) == [("1", 1, 0, 20, 0), ("None", 1, 0, 20, 0)]


@pytest.mark.parametrize(("words", "hot"), [(1, 1), (4, 3), (1 << 20, 8), (1 << 20, 1024)])
def test_lm_scores_of_any_order_and_share(spark, monkeypatch, words, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "WORDS", words)
    rng = random.Random(hot)
    texts = [" ".join(rng.choices("a b c d e f g h".split(), [16, 8, 4, 2, 1, 1, 1, 1], k=rng.randint(0, 40))) for _ in range(40)] + ["a b a b a b", "a", "b a", "", None, "once only said"]
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id int, text string")
    for order, least in ((2, 2), (3, 2), (4, 3)):
        one = sorted(map(tuple, lm_scoring.scores(docs, order, least).collect()), key=str)
        assert one == sorted(map(tuple, lm_scoring.scores_by_joins(docs, order, least).collect()), key=str)
