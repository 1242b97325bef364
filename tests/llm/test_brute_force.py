"""Earlier operators against brute force: banding, language phrases, the machine's pairs, blocks of items, shards."""

import random
import zlib

import numpy as np
import pytest

from wordloom.llm import decontam, langid, ngram_join, sharding, toxicity


def test_bands_reach_the_recall():
    assert ngram_join.bands_for(0.8) == (32, 6)
    for threshold in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
        for recall in (0.9, 0.99, 0.9999):
            bands, rows = ngram_join.bands_for(threshold, recall, 64)
            assert 1 - (1 - threshold**rows) ** bands >= recall - 1e-9 and bands <= 64
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.05, 0.9999, 8)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_join_at_other_thresholds(spark, threshold):
    rng = random.Random(int(10 * threshold))
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 1, 2, 4):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [None, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    want = {i: sum(bool(i != j and a and b and len(a & b) >= threshold * len(a | b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(docs, threshold=threshold).collect()}
    assert got == want


def phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest matches, one byte at least, by search alone."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        if text[at : at + 1] not in sample:
            size = 1
        at += size
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    samples = {k: "".join(rng.choices("abc é", [4, 3, 2, 1, 1], k=300)).encode() for k in ("x", "y")}
    parser = langid.build(samples)
    texts = ["".join(rng.choices("abcdé ", k=rng.randint(1, 200))) for _ in range(50)]
    got = parser.phrases(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(parser.languages):
            # the automaton starts its first phrase at the root, so it counts the phrases that end inside the text
            assert abs(int(got[i, j]) - phrases(samples[name], langid.fold(t).encode())) <= 1


def test_large_scripts_and_short_documents(spark):
    rng = random.Random(5)
    scripts = {"zh": range(0x4E00, 0x4E00 + 2500), "ko": range(0xAC00, 0xAC00 + 2500), "en": range(97, 123)}
    text = lambda k, n: "".join(chr(rng.choice(scripts[k])) if rng.random() > 0.15 else " " for _ in range(n))
    rows = [(i, text(k, rng.choice([3, 20, 400])), k) for i in range(300) for k in (rng.choice(list(scripts)),)] + [(900, "字" * 50_000, "zh"), (901, "字" * 50_000, "zh")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    real = [(i, k) for i, t, k in rows if len(t.strip()) > 10]
    assert sum(got[i] == k for i, k in real) >= 0.98 * len(real)
    few = langid.fit(docs, languages=2)
    assert len(few.languages) == 2
    assert langid.fit(docs.limit(0)).languages == []


def test_margin_is_the_sum_of_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.Machine(0.3, np.arange(20, dtype=np.int32), rng.normal(size=20), rng.normal(size=(20, 4)))
    for _ in range(20):
        terms = rng.choice(20, size=rng.integers(0, 12), replace=False)
        want = 0.3 + sum(model.weights[i] for i in terms) + sum(model.vectors[a] @ model.vectors[b] for x, a in enumerate(terms) for b in terms[x + 1 :])
        assert model.margin(terms) == pytest.approx(want)
    assert toxicity.sigmoid(0.0) == 0.5 and toxicity.train_machine([], np.zeros(0, np.int32)).bias < -20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contamination_in_several_blocks_and_over_all_passages(spark, kind):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    items = [rng.sample(words, n) for n in (6, 9, 12) for _ in range(4)] + [["w1"] * 8]
    texts = []
    for d in range(40):
        own = rng.choices(words, k=rng.randint(0, 40))
        if d % 2:
            leak = list(items[rng.randrange(len(items))])
            if d % 4 == 1 and len(leak) > 5:
                leak[rng.randrange(len(leak))] = "new"
            own[len(own) // 2 : len(own) // 2] = leak
        texts.append(own)
    near = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) for most in (decontam.edits_allowed(len(x), 0.8),) if any(distance(x, t[a : a + n]) <= most for a in range(len(t)) for n in range(max(1, len(x) - most), len(x) + most + 1))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id int, text string")
    name = str if kind == "string" else int
    bench = spark.createDataFrame([(name(k), " ".join(x)) for k, x in enumerate(items)] + [(None, "absent words only here now"), (None, None)], f"item_id {kind}, text string")
    for block in (3, 1000):
        rows = decontam.contamination(docs, bench, block=block)
        assert rows.schema["item_id"].dataType == bench.schema["item_id"].dataType
        found = {(r.doc_id, int(r.item_id)) for r in rows.collect()}
        assert found <= near and len(found) >= 0.97 * len(near)
        assert {r.doc_id for r in decontam.decontaminate(docs, bench, block=block).collect()} == set(range(40)) - {d for d, _ in found}


def test_recall_at_the_limit_of_edits():
    for n in (5, 20, 60):
        assert decontam.recall_at_limit(n, trials=200) >= 0.97


def test_shards_of_odd_texts(spark):
    texts = ["é" * 10, None, "", "x" * 200_000, *(f"text {k % 7} " * (k % 13) for k in range(400))]
    docs = spark.createDataFrame([(i if i % 90 else None, t, "s" if i % 3 else "hot", "mine") for i, t in enumerate(texts)], "doc_id int, text string, source string, shard string")
    rows = sharding.kd_shards(docs, 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i if i % 90 else None), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    by = {s: [r for r in rows if r.shard == s] for s in range(5)}
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
