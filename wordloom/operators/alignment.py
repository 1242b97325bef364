"""Weighted alignment of two lists of words as nested folds: the rows of the matrix follow each other, two at a time.

All is one expression, so pairs stay in the JVM and are spread as their rows are. Lists are of utterances, 48 words
at most; a cell costs a comparison, so two lists of n and m words take n * m of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions import lexicon as L
from wordloom.functions import vocabulary as V

_STEM = rf"^(.{{4,}}?)(?:{'|'.join(V.INFLECTIONS)})$"


def stem(word: Column) -> Column:
    """Without the first inflection that leaves four characters."""
    found = F.regexp_extract(word, _STEM, 1)
    return F.when(found == "", word).otherwise(found)


def weight(word: Column) -> Column:
    empty = (F.char_length(word) < 2) | word.isin(*V.STOPWORDS, *L.HARD_FILLERS)
    return F.when(empty, 0.15).when(word.isin(*L.COMMON_SHORT_WORDS), 0.35).otherwise(1.0)


def same(x: Column, y: Column) -> Column:
    """1 for equal words, 0.92 for equal stems, 0.8 for a long common start, else 0."""
    shorter = F.least(F.char_length(x["w"]), F.char_length(y["w"]))
    n = F.greatest(F.lit(4), F.ceil(shorter * 0.70 - 1e-9)).cast("int")
    return F.when(x["w"] == y["w"], 1.0).when(x["stem"] == y["stem"], 0.92).when((shorter >= n) & (F.left(x["w"], n) == F.left(y["w"], n)), 0.80).otherwise(0.0)


def described(words: Column) -> Column:
    """Words with their stem and weight, once a list and not once a cell."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), stem(w).alias("stem"), weight(w).alias("weight")))


def chain(a: Column, b: Column, match: Callable[[Column, Column], Column] = same) -> Column:
    """The best sum of weights of words of ``a`` matched in order with words of ``b`` (both ``described``); 0 for empty lists."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0.0))

    def row(before: Column, x: Column) -> Column:
        cell = lambda r, j: F.array_append(r, F.greatest(F.get(before, j + 1), F.element_at(r, -1), F.when(match(x, F.get(b, j)) > 0, F.get(before, j) + match(x, F.get(b, j)) * x["weight"]).otherwise(0.0)))
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0.0)), cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, start, row), -1)).otherwise(0.0)


def align(a: Column, b: Column, match: Callable[[Column, Column], Column] = same) -> Column:
    """The part of a's weight that ``chain`` finds in b; null lists are empty."""
    none = F.array().cast("array<struct<w:string,stem:string,weight:double>>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x["weight"])
    return F.coalesce(F.try_divide(chain(a, b, match), total), F.lit(0.0))
