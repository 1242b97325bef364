import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import components, decontam, langid, line_dedup, lm_scoring, ngram_join, packing, quality, sharding, token_files, toxicity
from wordloom.llm.common import word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node int"
ODD = ["", None, " \n\t ", "one", "It's <|endoftext|> a test 'tis", "Ünï Straße œuvre", "日本語 テスト", "x\x1cy\x85z", "a" * 5000, "word " * 3000, "same line that is long enough here\nb"]


def make(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, 1) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice(["ta", "ri", "mo", "sel", "ku"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    for t in texts[:10]:
        w = t.split()
        texts.append(" ".join(w[:-1] + ["zz"]))
        texts.append(t)
    shared = "A Shared Line that stands in many documents"
    texts = [t + "\n" + (shared if k % 3 else shared.lower() + " ") for k, t in enumerate(texts)]
    return texts + ODD + ODD[:4] + [ODD[-1]] * 3


def test_token_files_and_packing(spark, mixed):
    docs, tokenizer = make(spark, mixed), Tokenizer.from_file(PATH)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in mixed]
    start = np.cumsum([0, *map(len, ids)])
    got = sorted(map(tuple, token_files.round_trip(docs, PATH).collect()))
    assert got == [(k, start[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)]
    rows = packing.pack(docs, PATH, 64, group=50).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == [(k, a, len(x[a : a + 64]), zlib.crc32(x[a : a + 64].tobytes())) for k, x in enumerate(ids) for a in range(0, len(x), 64)]
    windows: dict[int, list] = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 64


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 2000)
    window, _ = packing.best_fit(lengths, 100)
    assert np.bincount(window, weights=lengths).max() <= 100 and lengths.sum() / (100 * (window.max() + 1)) > 0.97


def test_ranks_round_trip():
    r = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], np.uint32)
    assert token_files.decode_ranks(*token_files.encode_ranks(r), len(r)).tolist() == r.tolist()


def sets(texts):
    words = [(t or "").lower().encode().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_ngram_join(spark, mixed):
    s, n = sets(mixed), len(mixed)
    link = [[j for j in range(n) if j != i and s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) and s[j]] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in link[i])]) for i in range(n)]
    got = {r.doc_id: r for r in ngram_join.ngram_join(make(spark, mixed)).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(n)] == [(label[i], len(link[i])) for i in range(n)]
    kept = ngram_join.keep_one(make(spark, mixed)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label))
    assert ngram_join.keep_one(make(spark, ["a b c d e f", "a b c d e f"], [5, 5])).count() == 1


def test_large_blocks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:50] + [f"own{k}"] + base[51:]) for k in range(40)]
    got = ngram_join.ngram_join(make(spark, texts)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "u long, v long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_lm_scores_agree(spark, mixed):
    one = sorted(map(tuple, lm_scoring.scores(make(spark, mixed)).collect()), key=str)
    assert one == sorted(map(tuple, lm_scoring.scores_by_joins(make(spark, mixed)).collect()), key=str)
    assert len(one) == len(mixed)


def test_lm_scoring_of_a_text_beyond_a_buffer(spark):
    texts = ["b a", "a b " * 270_000 + "c", " " * (1 << 20) + "b a", None]
    d = make(spark, texts)
    assert sorted(map(tuple, lm_scoring.scores(d).collect())) == sorted(map(tuple, lm_scoring.scores_by_joins(d).collect()))


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(spark, mixed):
    lines = [(t or "").split("\n") for t in mixed]
    holders: dict[str, set] = {}
    for i, own in enumerate(lines):
        for x in own:
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    want = ["\n".join(x for x in own if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i) for i, own in enumerate(lines)]
    out = line_dedup.drop_repeated_lines(make(spark, mixed))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] or "" for i in range(len(mixed))] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    items = [rng.sample(words, n) for n in (12, 20, 35, 60) for _ in range(5)]
    texts, leaks = [], set()
    for d in range(200):
        own = rng.choices(words, k=rng.randint(0, 150))
        if d % 2:
            k = rng.randrange(len(items))
            leak = list(items[k])
            for _ in range(rng.randint(0, decontam.edits_allowed(len(leak), 0.8))):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["new"], [leak[at], "more"]])
            own[len(own) // 2 : len(own) // 2] = leak
            leaks.add((d, k))
        texts.append(" ".join(own))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    rows = decontam.contamination(make(spark, [*texts, None, ""]), bench).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(leaks & found) >= 0.97 * len(leaks) and found <= leaks
    for r in rows:
        part = texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
        assert distance(items[r.item_id], part) == r.edits <= decontam.edits_allowed(len(items[r.item_id]), 0.8)
    left = decontam.decontaminate(make(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(200)) - {d for d, _ in found}


def test_sharding(spark, mixed):
    texts = mixed * 5
    rows = sharding.kd_shards(make(spark, texts), 7).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)]
    assert {r.shard for r in rows} <= set(range(7))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_quality_base(spark, mixed):
    got = {r.doc_id: r for r in quality.judged(make(spark, mixed)).collect()}
    for i, t in enumerate(mixed):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x, c in Counter(windows).items() if c > 1}
        repeats = len({k + j for k, x in enumerate(windows) if x in twice for j in range(3)})
        lines = [x for x in (t or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        failed = len(w) < 50 or 100 * repeats > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeats, failed)
        assert not (failed and r.kept)


def test_quality_of_a_rare_language(spark):
    rng = random.Random(6)
    common = {"large": "the of and to in that is for on with", "rare": "el y los las del se por una con no"}
    text = lambda k: " ".join(x for _ in range(60) for x in (rng.choice(common[k].split()), f"{rng.choice('bcdfg')}{rng.randrange(10**6)}"))
    for n in (1, 7, 19):
        rows = [(i, text(k), k) for i, k in enumerate(["large"] * 25 + ["rare"] * n)] + [(90, text("rare"), None), (91, "# " + "$%& <|> " * 3 + " ".join(f"$%{i}#|<" for i in range(120)), None)]
        got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert len(got) == len(rows) and all(r.kept for i, r in got.items() if i < 91) and not got[91].kept


def test_quality_of_many_languages(spark):
    text = lambda common, k: " ".join(f"{common[i % len(common)]} {'bcdfg'[i % 5]}{k}{i}" for i in range(60))
    english, spanish = "the of and to in that is for on with".split(), "el y los las del se por una con no".split()
    rows = [(2 * k + j, text(english, 2 * k + j), f"l{k:03d}") for k in range(260) for j in (0, 1)] + [(900, text(spanish, 900), "zz")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(1500):
        w = [f"w{rng.randrange(200)}" for _ in range(30)]
        bad, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["insult"] * bad + ["group"] * group + ["vile"] * (i % 10 == 0)
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, int((bad and group) or i % 10 == 0)))
    docs = make(spark, [*texts, None, ""])
    table = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, table)).select("doc_id", "score", toxicity.held_out().alias("held"), "node").collect()
    assert len(out) == 1502 and all(0 <= r.score <= 1 for r in out)
    held = [(r.score >= 0.7, labels[r.doc_id][1] == 1) for r in out if r.held and r.doc_id < 1500]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.score(make(spark, []), toxicity.fit(make(spark, []), table.limit(0))).count() == 0


def test_language(spark):
    words = {"aa": "the of and thing other with", "bb": "der die und nicht einer schon", "cc": "que los una para como este"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=40)), k) for i, k in enumerate(rng.choices(list(words), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    parser = langid.build({"x": b"abracadabra"})
    assert parser.phrases(["abracabra", "zz", "abra" * 600])[:2, 0].tolist() == [2, 2]


def test_empty_tables(spark):
    none, bench = make(spark, []), spark.createDataFrame([], "item_id long, text string")
    for f in (ngram_join.ngram_join, lm_scoring.scores, line_dedup.drop_repeated_lines, sharding.kd_shards, quality.judged, lambda d: packing.pack(d, PATH), lambda d: token_files.round_trip(d, PATH), lambda d: decontam.contamination(d, bench)):
        assert f(none).count() == 0


def test_word_hashes_follow_words(mixed):
    texts = [(t or "").lower() for t in mixed]
    seen: dict[int, bytes] = {}
    for i, h in word_hashes(texts):
        own = texts[i].encode().split()
        assert len(own) == len(h) and all(seen.setdefault(a, b) == b for a, b in zip(h.tolist(), own, strict=True))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    kept = corpus_pipeline.drop_lines(spark, docs, "")
    assert kept.columns == docs.columns and kept.where(F.char_length("text") != F.col("n_chars")).count() == docs.where(F.char_length("text") != F.col("n_chars")).count()
