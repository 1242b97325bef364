"""Quality rules by divergence of distributions, in DataFrame expressions alone.

Each document has two histograms: its characters by class, and its words by common word in lower case
(any other is one bin). Each is compared by Jensen-Shannon distance (base 2, 0 to 1) with the reference of
every language, which is the sum of the histograms of all documents of that ``lang`` that pass the base rules; the nearest
language counts, so that lang need not be right. Of very many values of lang the ``languages`` most frequent have a
reference (1,024, which bounds what is sent to the tasks). A document is kept if it passes the base rules and
is within ``char_limit`` and ``word_limit`` of some language. Texts of fewer than ``min_chars``
characters or ``min_words`` words are not judged by that histogram.

Null and empty texts have no words and fail the base rules; a null lang adds to no reference, any other
gives one, however few its documents; without any reference the base rules decide alone; repeated rows
are judged each for itself; texts may be of any length, each in one row's memory; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import SPACE, cut

#: Common words of some languages; a corpus in others takes its own list.
COMMON_WORDS = (
    "the of and to in that is for on with "
    "de la le et les des en un est que "
    "der die und den von das mit ist zu ein "
    "el y los las del se por una con no"
).split()
#: Character classes, each counted in what the ones before have left; the rest is the last bin.
CLASSES = ("[a-z]+", "[A-Z]+", "[#*$%&|<>]+", "[0-9]+", "[.,;:!?'\"()\\-]+", "\\p{Ll}+", "\\p{Lu}+")
_SPACES = "[ \t\n\x0b\x0c\r]+"


def _length(c: Column | str) -> Column:
    return F.char_length(c)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base columns, and the histograms ``chars`` and ``common``."""
    text, known = F.coalesce("text", F.lit("")), list(dict.fromkeys(COMMON_WORDS))
    own = docs.select("doc_id", F.col("lang"), text.alias("text"))
    own = own.withColumn("words", F.filter(F.split("text", _SPACES), lambda w: w != ""))
    own = own.withColumn("low", F.filter("words", lambda w: w.isin(*known)))
    own = own.withColumn("joined", F.concat(F.lit(" "), F.array_join("low", "  "), F.lit(" ")))  # each word with a space on either side
    own = own.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    own = own.withColumn("left0", F.regexp_replace("text", _SPACES, ""))
    for k, kind in enumerate(CLASSES):
        own = own.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", kind, ""))
    chars = [_length("text") - _length("left0"), *(_length(f"left{k}") - _length(f"left{k + 1}") for k in range(len(CLASSES))), _length(f"left{len(CLASSES)}")]
    common = [((F.octet_length("joined") - F.octet_length(F.replace(F.col("joined"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int") for w in known]
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    own = own.withColumn("hashes", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    own = own.withColumn("repeats", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(0))
    return own.select(
        "doc_id", "lang",
        n.cast("long").alias("n_words"),
        _length("left0").cast("long").alias("word_chars"),
        (_length("left2") - _length("left3")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeats").cast("long").alias("n_repeat_words"),
        F.array(*(c.cast("int") for c in chars)).alias("chars"),
        F.array(*(c.cast("int") for c in [*common, n - F.size("low")])).alias("common"),
    )


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash is not alone: sorted, equal ones are neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    twice = lambda s: F.transform(F.filter(s, lambda x, i: beside(s, x, i)), lambda x: x["i"])
    at = F.get(F.transform(F.array(placed), twice), F.lit(0))  # the one-element array names the sorted windows once
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))


def references(counts: DataFrame, languages: int = 1024) -> DataFrame:
    """One row: ``refs``, the two histograms of each of the most frequent languages as shares."""
    sizes = (len(CLASSES) + 2, len(dict.fromkeys(COMMON_WORDS)) + 1)
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, n in zip(("chars", "common"), sizes, strict=True) for k in range(n)]
    known = counts.where("lang is not null and n_words > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy(F.desc("n"), "lang").limit(languages)
    share = lambda c, n: F.transform(F.array(*(F.col(f"{c}{k}") for k in range(n))), lambda x: x / F.greatest(F.lit(1), reduce(add, (F.col(f"{c}{k}") for k in range(n)))))
    return known.agg(F.collect_list(F.struct(share("chars", sizes[0]).alias("chars"), share("common", sizes[1]).alias("common"))).alias("refs"))


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts, whose sum is total, from shares."""

    def term(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)

    parts = F.zip_with(counts, reference, term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / (2 * math.log(2))))


def judged(docs: DataFrame, char_limit: float = 0.25, word_limit: float = 0.35, min_chars: int = 200, min_words: int = 100, languages: int = 1024) -> DataFrame:
    """doc_id, the base columns, base_failed, the distances from the nearest language, kept."""
    out = cut(base_counts(docs)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    known = cut(references(out.where(~F.col("base_failed")), languages))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_chars", n_chars).crossJoin(F.broadcast(known))  # one row of at most `languages` references
    each = F.transform("refs", lambda r: F.struct(js_distance(F.col("chars"), F.col("n_chars"), r["chars"]).alias("c"), js_distance(F.col("common"), F.col("n_words"), r["common"]).alias("w")))
    out = out.withColumn("each", F.when(~F.col("base_failed"), each)).withColumn("far_c", F.col("n_chars") >= min_chars).withColumn("far_w", F.col("n_words") >= min_words)
    near = (F.size("refs") == 0) | F.exists("each", lambda x: (~F.col("far_c") | (x["c"] <= char_limit)) & (~F.col("far_w") | (x["w"] <= word_limit)))
    return out.select("doc_id", *_BASE, "base_failed", F.array_min("each.c").alias("char_distance"), F.array_min("each.w").alias("word_distance"), (~F.col("base_failed") & F.coalesce(near, F.lit(False))).alias("kept"))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
