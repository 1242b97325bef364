"""Scalar text functions: normal forms of words and the predicates on how a word ends."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the two Latin blocks that lose a mark, by rule; ``translate`` takes the pairs.
_PAIRS = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c)) != chr(c)}
ACCENTED, PLAIN = "".join(_PAIRS), "".join(_PAIRS.values())
APOSTROPHES = "’ʼ‘`"
EDGES = ".,;:!?()[]{}\"«»…"
CLOSING = "\"'»)]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_word(c: Column | str) -> Column:
    """Lower case, without accents and edge punctuation, one kind of apostrophe."""
    x = F.trim(F.translate(as_column(c), APOSTROPHES, "'" * len(APOSTROPHES)))
    x = F.lower(F.translate(x, ACCENTED, PLAIN))
    return F.trim(F.replace(F.btrim(x, F.lit(EDGES)), F.lit("…"), F.lit("")))


def normalize_text(c: Column | str) -> Column:
    """Normal words with single spaces; all but letters, digits, ``_``, ``'`` and ``-`` separates."""
    x = F.lower(F.translate(F.translate(as_column(c), APOSTROPHES, "'" * len(APOSTROPHES)), ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_'\-]+", " "), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda w: w != "")


def opened(c: Column | str) -> Column:
    """Without closing quotes and brackets."""
    return F.rtrim(F.trim(as_column(c)), F.lit(CLOSING))


def ends_suspension(c: Column | str) -> Column:
    return opened(c).endswith("...") | opened(c).endswith("…")


def ends_sentence(c: Column | str) -> Column:
    return F.coalesce(F.right(opened(c), F.lit(1)).isin(".", "!", "?"), F.lit(False)) & ~ends_suspension(c)


def ends_clause(c: Column | str) -> Column:
    return F.coalesce(F.right(opened(c), F.lit(1)).isin(",", ";", ":"), F.lit(False))


def is_truncated(c: Column | str) -> Column:
    return F.coalesce(F.right(F.trim(as_column(c)), F.lit(1)).isin("-", "_"), F.lit(False)) & (F.char_length(F.trim(as_column(c))) > 1)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Bounds may come in either order."""
    return F.greatest(F.least(low, high), F.least(x, F.greatest(low, high)))


def timecode(seconds: Column) -> Column:
    """``mm:ss.mmm``, ``h:mm:ss.mmm`` from an hour on; null and NaN are ``--:--``."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    h, m, s, f = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    out = F.when(h > 0, F.format_string("%d:%02d:%02d.%03d", h, m, s, f)).otherwise(F.format_string("%02d:%02d.%03d", m, s, f))
    return F.when(seconds.isNull() | F.isnan(seconds), "--:--").otherwise(out)
