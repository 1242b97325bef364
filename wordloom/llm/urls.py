"""URL filters: fixed rules first, then naive Bayes on the words of host and path.

A rule is a host and the start of a path (``example.net/en/``); it fits its host and all subdomains, and the
longest rule that fits decides. Urls without a rule are judged by their words: runs of letters of
the path, and of the host after segmentation.

Hosts are segmented by unigram Viterbi. Word counts come from the text of all pages, from paths, and from
the parts of hyphenated labels; ``SEEDS`` are known once at least. A run of letters is cut into known
words so that the product of their shares is greatest; a letter that is in no known word costs more than
the rarest word, and such letters side by side are one word. Only distinct runs are segmented, and only
counts of their own substrings are joined to them, so no vocabulary is broadcast.

The naive Bayes model is multinomial over words of two letters or more, each once a page so that a very long
path does not outweigh all others, hashed into ``BUCKETS`` buckets (the bound of what is sent to the tasks). It learns from all pages: a page with a seed word among its words is an
example of ``block``, any other of ``allow``. Smoothing is in proportion to the classes, so that a word
never seen says nothing. A page is blocked if its log-odds are above 0.

A null url, or one without ``://``, has an empty host and path, no rule and no words, and is judged by the
prior alone (``allow`` where no page has a seed). Runs of more than 63 letters, which no host name may have, are
cut after every 63 before they are segmented; texts and urls may be of any length. Equal products take the cut
whose last word is longest. Repeated rows and page ids (null or of any type) are judged each for itself, an
empty table gives no rows, and other columns are not read. A null html has no words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import cut, ship
from wordloom.llm.components import lookup
from wordloom.llm.line_dedup import ascii_lower

#: (verdict, host and start of the path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that make a page an example of what is to be blocked.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
BUCKETS = 1 << 18
#: Letters of a known word, and of a run, at most.
WORD, RUN = 24, 63
#: Script, style, comments and tags.
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
_LETTERS = r"\p{L}+"
_HOST, _AFTER_HOST = "^[^/?#]*", "^[^/?#]*([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, _HOST, 0)), F.regexp_extract(rest, _AFTER_HOST, 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (rule, verdict) that fits; null if none does."""

    def fits(rule: str) -> Column:
        name, _, start = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)

    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for v, r in longest))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_LETTERS), F.lit(0))


def runs(host: Column) -> Column:
    return F.regexp_extract_all(host, F.lit(rf"\p{{L}}{{1,{RUN}}}"), F.lit(0))


def word_counts(pages: DataFrame, urls: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(word, n) of all words of two to WORD letters."""
    hyphenated = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    parts = (
        pages.select(F.explode(_words(F.regexp_replace("html", _MARKUP, " "))).alias("word")),
        urls.select(F.explode(F.concat(_words(F.col("path")), F.flatten(F.transform(hyphenated, _words)))).alias("word")),
        pages.sparkSession.createDataFrame([(s,) for s in seeds], "word string"),
    )
    own = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return own.where(F.char_length("word").between(2, WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(run: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest cut of a run: ``known`` has the costs of words by (start, end), any other letter costs ``unknown``."""
    cost, last = [0.0] + [np.inf] * len(run), [0] * (len(run) + 1)
    ends: dict[int, list[tuple[int, float]]] = {}
    for (a, b), c in sorted(known.items()):
        ends.setdefault(b, []).append((a, c))
    for b in range(1, len(run) + 1):
        for a, c in [*ends.get(b, ()), (b - 1, unknown)]:  # the longest word first
            if cost[a] + c < cost[b] - 1e-9:
                cost[b], last[b] = cost[a] + c, a
    out, b, loose = [], len(run), False
    while b:
        a = last[b]
        alone = (a, b) not in known
        if alone and loose:
            out[-1] = run[a:b] + out[-1]
        else:
            out.append(run[a:b])
        b, loose = a, alone
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of different hosts (host, n)."""
    pieces = cut(hosts.select("host", F.posexplode(runs(F.col("host"))).alias("pos", "run")), "runs")
    known = pieces.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    at = known.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run") - 1)).alias("a")).where("a > 0")
    at = at.select("run", "a", F.explode(F.sequence(F.lit(2), F.lit(WORD))).alias("len")).where("a + len - 1 <= char_length(run)")
    at = at.select("run", "a", "len", F.substr("run", F.col("a"), F.col("len")).alias("word")).join(counts, "word")
    lattice = at.groupBy("run").agg(F.collect_list(F.struct("a", "len", F.col("n").cast("double").alias("n"))).alias("known"))  # RUN * WORD at most
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    @F.pandas_udf("array<string>")
    def cheapest(run: pd.Series, known: pd.Series) -> pd.Series:
        cost = lambda e: (e["a"] - 1, e["a"] - 1 + e["len"])
        return pd.Series([segment(r, {} if k is None else {cost(e): log(total / e["n"]) for e in k}, log(total + 1) + 1) for r, k in zip(run, known, strict=True)])

    ship(hosts.sparkSession)
    words = cut(known.join(lattice, "run", "left").select("run", "n", cheapest("run", "known").alias("words")), "segments")
    own = lookup(pieces, words, "run", pieces.count())
    return own.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))  # runs of one host


@dataclass
class Bayes:
    """The log-odds of the prior and of each bucket."""

    prior: float = -1.0
    odds: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def with_words(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(page_id, host, path, fit, words): the rule that fits, and the different words of host and path, written to the shared folder."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = cut(urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    hosts = cut(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    named = hosts.join(segmented(hosts, cut(word_counts(pages, urls, seeds), "counts")), "host", "left")
    words = F.concat(F.coalesce("words", F.array().cast("array<string>")), _words(F.col("path")))
    own = lookup(urls, named, "host", urls.count())
    return cut(own.select("page_id", "host", "path", "fit", F.array_distinct(F.filter(words, lambda w: F.char_length(w) > 1)).alias("words")), "words")


def fit(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> Bayes:
    """Learns from pages with ``words``; the driver gets two counts for each bucket."""
    bad = F.exists("words", lambda w: w.isin(*seeds))
    own = pages.select(bad.alias("bad"), F.transform("words", bucket).alias("b"))
    n_bad, n_all = own.agg(F.count_if("bad"), F.count(F.lit(1))).first()
    if not n_bad:
        return Bayes()
    sums = own.select("bad", F.explode("b").alias("b")).groupBy("b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).toPandas()  # BUCKETS rows at most
    n = np.zeros((2, BUCKETS))
    n[:, sums["b"]] = sums["bad"], sums["good"]
    total = np.maximum(n.sum(axis=1, keepdims=True), 1)
    shares = n / total + 1 / max(n.sum(), 1)
    return Bayes(log((n_bad + 1) / (n_all - n_bad + 1)), np.log(shares[0] / shares[1]))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) of pages (page_id, url, html): score is the method's log-odds of block."""
    own = with_words(pages, rules, seeds)
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(fit(own, seeds))

    def run(batches):
        model = sent.value
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("b"))
            size = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            odds = model.odds[at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
            score = model.prior + np.bincount(np.repeat(np.arange(len(size)), size), weights=odds, minlength=len(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 6), pa.float64())], names=[*batch.schema.names, "score"])

    flat = own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "words", F.transform("words", bucket).alias("b"))
    scored = flat.mapInArrow(run, T.StructType([*flat.schema.fields, T.StructField("score", T.DoubleType())]))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "words")


__all__ = ["Bayes", "fit", "host_and_path", "judged", "rule_of", "segment", "segmented", "with_words", "word_counts"]
