"""Numbers, times of day and names as column expressions: parsing, formatting, mapping, frame rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions import text as T

#: Frame rates in use, as a whole base and whether it is slowed by 1000/1001. Fixed values.
RATES = ((24, True), (24, False), (25, False), (30, True), (30, False), (48, True), (48, False), (50, False), (60, True), (60, False), (100, False), (120, True), (120, False))
TICKS = 254_016_000_000


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def remap(x: Column, in_low: float, in_high: float, out_low: float, out_high: float) -> Column:
    """x from one range to another, held to its bounds; an empty range gives the lower bound."""
    if in_low == in_high:
        return F.lit(float(out_low))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - in_low) / (in_high - in_low)))
    return lerp(F.lit(float(out_low)), F.lit(float(out_high)), t)


def parse_timecode(c: Column) -> Column:
    """Seconds of ``1:02:03``, ``01:33`` or ``12.5`` (a comma will do); empty is 0, null and nonsense null."""
    parts = F.transform(F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.when(F.trim(c) == "", 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def human_duration(seconds: Column) -> Column:
    """``12.5 s``, ``2 min 05 s`` or ``1 h 02 min``; less than nothing is nothing."""
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    n = F.rint(s).cast("long")
    short, long = F.format_string("%d min %02d s", F.floor(n / 60), n % 60), F.format_string("%d h %02d min", F.floor(n / 3600), F.floor(n / 60) % 60)
    return F.when(s < 60, F.format_string("%.1f s", F.bround(s, 1))).when(n < 3600, short).otherwise(long)


def fraction(c: Column, default: float = 0.0) -> Column:
    """``30000/1001`` as a number; the default for null, nonsense and a division by 0."""
    x = F.split(F.trim(c), "/", 2)
    top, below = F.get(x, F.lit(0)).try_cast("double"), F.get(x, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.size(x) > 1, F.try_divide(top, below)).otherwise(top), F.lit(default))


def frame_rate(fps: Column) -> Column:
    """(base, slowed, fps): the rate in use nearest to fps if within 0.08, else the nearest whole number; 25 for no rate."""
    exact = lambda base, slowed: base * 1000 / 1001 if slowed else float(base)
    shape = lambda base, slowed, x: F.struct(base.cast("int").alias("base"), slowed.alias("slowed"), x.cast("double").alias("fps"))
    each = [F.struct(F.abs(F.lit(round(exact(b, s), 3)) - fps).alias("off"), F.lit(k).alias("k"), shape(F.lit(b), F.lit(s), F.lit(exact(b, s))).alias("rate")) for k, (b, s) in enumerate(RATES)]
    best, whole = F.array_min(F.array(*each)), F.greatest(F.lit(1.0), F.rint(fps))
    return F.when(fps <= 0, shape(F.lit(25), F.lit(False), F.lit(25.0))).when(best["off"] <= 0.08, best["rate"]).otherwise(shape(whole, F.lit(False), whole))


def shown_size(width: Column, height: Column, rotation: Column) -> Column:
    """(width, height) as shown: a quarter turn swaps them."""
    turned = F.coalesce(rotation.isin(90, 270), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def ticks(seconds: Column) -> Column:
    return F.rint(seconds * TICKS).cast("long")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def safe_filename(name: Column, longest: int = 120, default: str = "sortie") -> Column:
    """A name that any file system takes: no reserved characters, no dots or blanks at the ends."""
    x = F.translate(F.coalesce(F.when(name != "", name), F.lit(default)), T.APOSTROPHES, "'" * len(T.APOSTROPHES))
    x = F.btrim(F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    return F.substring(F.when(x == "", default).otherwise(x), 1, longest)


def word_stem(norm: Column) -> Column:
    return F.rtrim(norm, F.lit("-_'"))


def ends_of(words: Column, most: int = 6) -> Column:
    """(head, tail): the first and last few words as text."""
    head, tail = F.slice(words, 1, most), F.slice(words, F.greatest(F.lit(1), F.size(words) - most + 1), F.lit(most))
    return F.struct(F.array_join(head, " ").alias("head"), F.array_join(tail, " ").alias("tail"))


def path_url(path: Column) -> Column:
    """A file URL, percent-encoded but for what paths may hold; drive letters keep their colon."""
    plain = {"+": "%20", "%3A": ":", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}

    def segment(s: Column) -> Column:
        out = F.url_encode(s)
        for code, char in plain.items():
            out = F.replace(out, F.lit(code), F.lit(char))
        return out

    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    return F.concat(F.lit("file://localhost"), F.array_join(F.transform(F.split(rooted, "/"), segment), "/"))

