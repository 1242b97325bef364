"""Ranked search, URL filters and the audit of filters, each against brute force, and on odd tables."""

import pickle
import random
import re
from itertools import permutations
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import interactions, lm_scoring, search, urls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "needle " + "hay " * 300_000 + "needle"
IDS = {"int": int, "long": int, "string": str}


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df: dict[str, int] = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in own:
            score = 0
            for t in terms(text):
                if t in df and w.count(t):
                    weight = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * (25 + 75 * len(w) * n_docs // total)))
            if score > 0:
                scored.append((-score, i is not None, i))
        scored.sort(key=lambda r: r if r[1] else r[:2])
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Café", "ÉTÉ", "日本"]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) for _ in range(n)]
    texts += texts[:40] + [texts[0]] * 30 + [None, "", "--- !", "W1,w2;W3", "w1" * 4000]
    return texts, [" ".join(rng.sample(words, 5)) for _ in range(20)] + ["w1 w1 w2", "absent", "", None, "W1-É"]


@pytest.mark.parametrize(("kind", "block"), [("int", 3), ("string", 64)])
def test_search_is_exact(spark, monkeypatch, kind, block):
    monkeypatch.setattr(search, "BLOCK", block)
    texts, items = corpus(block)
    docs = [(IDS[kind](i) if i % 50 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, "mine", 1) for i, t in docs], f"doc_id {kind}, text string, block string, score int").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = search.rank_documents(table, bench)
    assert got.schema["doc_id"].dataType == table.schema["doc_id"].dataType
    assert sorted(map(tuple, got.collect()), key=str) == best(docs, list(enumerate(items)))


def test_search_in_blocks_of_items_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 7)
    texts, items = corpus(9)
    docs, rows = list(enumerate(texts)), [(k // 2 if k > 1 else None, t) for k, t in enumerate(items)]
    bench = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    got = search.search(search.build(spark.createDataFrame(docs, "doc_id long, text string")), bench, 3)
    assert sorted(map(tuple, got.collect()), key=str) == best(docs, rows, 3)


def test_search_leaves_blocks_out(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=30)) + (" rare" * 5 if k % 500 == 0 else "") for k in range(4000)]
    index = search.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    rows = [tuple(r) for r in index.table.orderBy("block").collect()]
    items = search.prepare([(0, "rare a")])
    items.weights = items.repeats * search.weight(search.np.array([8 if t == search.prepare([(0, "rare")]).terms[0] else 3990 for t in items.terms]), index.n_docs)[items.which]
    packed = [(r[0], *map(bytes, r[1:6]), r[6]) for r in rows]
    ranking = search.Ranking(3, search.np.ones(1, search.np.int64))
    assert search._score(packed, items, ranking) <= 10 < len(rows)


def test_search_of_empty_tables_and_long_texts(spark):
    docs, bench = spark.createDataFrame([(1, LONG), (2, "needle"), (3, "hay")], "doc_id long, text string"), spark.createDataFrame([(0, "Needle")], "item_id long, text string")
    assert [tuple(r) for r in search.rank_documents(docs, bench).select("rank", "doc_id").orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert search.rank_documents(docs.limit(0), bench).count() == 0 and search.rank_documents(docs, bench.limit(0)).count() == 0
    assert search.rank_documents(docs, bench).columns == search.rank_documents(docs, bench.limit(0)).columns


def test_norm_beyond_64_bits():
    n = search.np.array([5, 10**9, 3 * 10**9])
    assert search.norm(n, 4 * 10**10, 10**13).tolist() == [25 + 75 * int(x) * 4 * 10**10 // 10**13 for x in n]


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parsed(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


ODD_URLS = [
    "http://a.NET/x", "http://net/", "http://net", "https://www.example.net/en/1", "https://example.net/en", "http://xexample.com/de/1", "http://example.com/de/", "http://b.org/fr/?q=://net/", "http://b.org?x=/fr/",
    "no scheme", "", None, "http://", "ftp://u@h.example.org:80/fr/é#f", "://NET/", "http://casinowin.example.org/1", "http://free-casino.example.com/pills.html", "http://quiet.example.org/en/", "x\nhttp://a.net/1",
    "http://" + "y" * 50_000 + ".org/fr/", "http://b.example.org/" + "word-" * 100_000,
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k if k % 5 else None, u, "<p>some quiet words here and there</p>" if k % 3 else None, "mine") for k, u in enumerate([*ODD_URLS, *ODD_URLS[:3]])], "page_id int, url string, html string, words string")
    got = urls.judged(pages).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((k if k % 5 else None, *parsed(u)) for k, u in enumerate([*ODD_URLS, *ODD_URLS[:3]])), key=str)
    assert all(r.verdict == RULES[r.rule] for r in got if r.rule)
    by = {r.host: r for r in got}
    assert by["casinowin.example.org"].words[0] == "casino" and by["casinowin.example.org"].verdict == "block"
    assert by["free-casino.example.com"].verdict == "block" and by["quiet.example.org"].verdict == "allow"
    assert urls.judged(pages.limit(0)).count() == 0


def cheapest(run, counts, total):
    """All cuts into known words and loose letters."""
    best = {0: (0.0, [])}
    for b in range(1, len(run) + 1):
        options = [(best[a][0] + log(total / counts[run[a:b]]), [*best[a][1], run[a:b]]) for a in range(b) if b - a >= 2 and run[a:b] in counts]
        best[b] = min([*options, (best[b - 1][0] + log(total + 1) + 1, [*best[b - 1][1], None])], key=lambda x: round(x[0], 9))
    return best[len(run)][0]


def test_segments_cost_least():
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choices("abc", k=rng.randint(2, 4))): rng.randint(1, 50) for _ in range(12)}
        total, run = sum(counts.values()), "".join(rng.choices("abcd", k=rng.randint(1, 14)))
        known = {(a, b): log(total / counts[run[a:b]]) for a in range(len(run)) for b in range(a + 2, len(run) + 1) if run[a:b] in counts}
        words = urls.segment(run, known, log(total + 1) + 1)
        assert "".join(words) == run
        cost = sum(log(total / counts[w]) if len(w) > 1 and w in counts else len(w) * (log(total + 1) + 1) for w in words)
        assert cost <= cheapest(run, counts, total) + 1e-6 or any(len(w) > 1 and w in counts for w in words)


def test_naive_bayes_counts(spark):
    texts = [["casino", "win", "en"], ["quiet", "en"], ["quiet", "farm", "en"], ["spam", "farm"]] * 3
    pages = spark.createDataFrame([(w,) for w in texts], "words array<string>")
    model = urls.fit(pages)
    odds = dict(spark.createDataFrame([("casino",), ("quiet",), ("en",), ("farm",), ("never",)], "w string").select("w", urls.bucket(F.col("w")).alias("b")).collect())
    bad, good = [w for t in texts if {"casino", "spam"} & set(t) for w in t], [w for t in texts if not {"casino", "spam"} & set(t) for w in t]
    every = len(bad) + len(good)
    for w, b in odds.items():
        assert model.odds[b] == pytest.approx(log((bad.count(w) / len(bad) + 1 / every) / (good.count(w) / len(good) + 1 / every)))
    assert model.prior == pytest.approx(log(7 / 7)) and urls.fit(pages.where("words[0] = 'quiet'")).prior < 0


def audit_rows(docs, labels):
    text = lambda t: t or ""
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", text(t)) if w]
    below = lambda a, b: a is None and b is not None or None not in (a, b) and a < b
    fails = []
    for i, t, _ in docs:
        w = words(t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text(t))) > 3 * len(text(t)), "D": bool(re.search(r"[#$%&*|]", text(t)))}
        fails.append(own | {"E": any(text(u) == text(t) and below(j, i) for j, u, _ in docs)})
    good = [any(j == i and i is not None and q == 1 for j, q, _ in labels) for i, _, _ in docs]
    toxic = [any(j == i and i is not None and x == 1 for j, _, x in labels) for i, _, _ in docs]
    out = []
    for part in {p or "" for _, _, p in docs}:
        own, shapley, rows = [k for k, d in enumerate(docs) if (d[2] or "") == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                shapley[f] += len(gone)
                earlier = set(own) - set(left)
                left = [k for k in left if not fails[k][f]]
                rows.append((f, (part, "".join(order), step, len(left), len(gone), sum(fails[k][f] for k in earlier), sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own), sum(good[k] for k in gone), sum(toxic[k] for k in gone))))
        out += [(*r, shapley[f]) for f, r in rows]
    return sorted(out)


def test_audit(spark, kind="string"):
    rng = random.Random(5)
    base = ["word " * 250, " ".join(f"w{k}" for k in range(220)), "SHOUT " * 10, "a # b", "", None, " ".join(f"v{k}" for k in range(300)) + " 100%", "x\x1cy " * 210, "Ab " + "w " * 100_000, "é" * 300]
    docs = [(IDS[kind](i) if i % 11 else None, rng.choice(base), rng.choice(["en", "fr", None, "", "zz"])) for i in range(60)] + [(IDS[kind](7), base[0], "en")]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs[::2]] + [(IDS[kind](4), 1, 0), (IDS[kind](999), 1, 1)]
    table = spark.createDataFrame([(*d, "mine", 3) for d in docs], f"doc_id {kind}, text string, lang string, part string, h int")
    got = interactions.audit(table, spark.createDataFrame(labels, f"doc_id {kind}, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audit_rows(docs, labels)


def test_audit_of_an_empty_table_and_hot_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same text of many" if i % 3 else f"text {i}") for i in range(90)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs.limit(0), labels).count() == 0
    own = docs.select("doc_id", F.xxhash64("text").alias("h"))
    for hot in (2, 1 << 20):
        monkeypatch.setattr(interactions, "HOT", hot)
        assert {r.doc_id for r in interactions.copies(own, 90).where("copy").collect()} == {i for i in range(90) if i % 3} - {1}


@pytest.mark.parametrize("n", [0, 1, 5, 50_000])
def test_frequent_hashes_are_found_by_their_leading_bits(n):
    r = np.random.default_rng(n)
    keys = np.unique(np.concatenate((r.integers(0, 2**64 - 1, n, dtype=np.uint64), np.arange(min(n, 40), dtype=np.uint64))))  # some share a bucket
    hot = lm_scoring.Hot(keys, r.integers(1, 99, len(keys)))
    assert len(pickle.dumps(hot)) < 40 * len(keys) + 2000  # the index of buckets is not sent
    known = dict(zip(keys.tolist(), hot.counts.tolist()))
    asked = np.concatenate((keys[:300], r.integers(0, 2**64 - 1, 300, dtype=np.uint64), np.array([0, 45, 2**63, 2**64 - 1], np.uint64)))
    counts, codes = hot.find(asked)
    assert counts.tolist() == hot.counted(asked).tolist() == [known.get(h, 0) for h in asked.tolist()]
    rank = dict(zip(keys.tolist(), hot.ranks.tolist()))
    assert codes.tolist() == [rank.get(h, (h | 1 << 63) - (1 << 64)) for h in asked.tolist()]
