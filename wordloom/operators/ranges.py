"""Points and intervals that overlap: a binned join, so that neither a long interval nor a busy time meets in one task.

Intervals are cut at the bounds of bins of equal width and joined to points on (key, bin). Bins in which many
points fall are dealt over several parts: their points by a hash, their intervals to each part. A bin's
number of points is counted first, with partial sums; the parts are what the count asks for, so a key or a
time that holds a third of all points is spread over as many tasks as its share.

Where only the number of a point's spans and the first of them are asked, ``holders`` sweeps over bounds
and points in order instead, so its work grows with their number and not with that of their meetings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.tables import cut, sound_unions

#: Points of one bin that go to one part.
PART = 1 << 16


def _bin(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("long")


def hits(points: DataFrame, spans: DataFrame, key: str, width: int, closed: bool = True, part: int | None = None) -> DataFrame:
    """The points (key, t and more) with every span (key, start, end and more, as ``span``) of their key that holds them.

    Bounds belong to a span (with ``closed`` false the end does not). ``width`` is of the bins: of the order of a
    usual span. Null keys and times hold nothing; spans whose end is before their start are empty; repeated
    points and spans meet each with each. Columns of spans but the key come in the struct ``span``.
    """
    sound_unions(points.sparkSession)
    part = part or PART
    own = points.where(F.col(key).isNotNull() & F.col("t").isNotNull()).withColumn("_b", _bin(F.col("t"), width))
    busy = own.groupBy(key, "_b").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts")).where("_parts > 1")
    busy = cut(busy, "busy")  # a row for each `part` points at most
    rest = [c for c in spans.columns if c != key]
    cells = spans.where("end >= start").select(F.col(key), F.struct(*rest).alias("span"), F.explode(F.sequence(_bin(F.col("start"), width), _bin(F.col("end"), width))).alias("_b"))
    cells = cells.join(busy, [key, "_b"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    own = own.join(busy, [key, "_b"], "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    upper = F.col("t") <= F.col("span.end") if closed else F.col("t") < F.col("span.end")
    met = own.join(cells, [key, "_b", "_part"]).where((F.col("t") >= F.col("span.start")) & upper)
    return met.select(*points.columns, "span")


def first_hit(points: DataFrame, spans: DataFrame, key: str, ident: list[str], width: int, by: Column, closed: bool = True) -> DataFrame:
    """Each point once, named by ``ident`` (key and more), with the least of its spans in ``by`` (of ``span``), null if none holds it."""
    met = hits(points, spans, key, width, closed).groupBy(*ident).agg(F.min_by("span", by).alias("span"))
    return points.join(met, ident, "left")


def holders(points: DataFrame, spans: DataFrame, key: str, width: int, by: list[str], closed: bool = True, part: int | None = None) -> DataFrame:
    """The points that some span of their key holds, with ``n``, the number of those spans, and ``first``.

    ``first`` is a struct of ``start`` and the columns ``by`` of the span that begins first, the least in ``by`` where
    several begin together. Bounds, nulls, empty and repeated rows are taken as ``hits`` takes them. Columns of points
    are other than n and first.

    A span of a bin holds t if it ends at t or later and does not begin after t, so in a sweep from late to early both
    n and first are running values. Spans that end after the bin are one row for it, by partial aggregates. Bins
    with more than ``part`` points or bounds have their bounds folded to one row for each time, and
    these are copied to each part of their points.
    """
    sound_unions(points.sparkSession)
    part = part or PART
    first = F.struct("start", *by)
    own = points.where(F.col(key).isNotNull() & F.col("t").isNotNull()).withColumn("_b", _bin(F.col("t"), width))
    live = spans.where(F.col(key).isNotNull() & (F.col("end") >= F.col("start"))).select(key, "end", first.alias("first"), _bin(F.col("start"), width).alias("_from"), _bin(F.col("end"), width).alias("_to"))
    none = F.lit(None).cast(live.schema["first"].dataType)
    # what comes first at one time, from late to early: bounds that still hold it, the point, bounds that do not
    begin = F.struct(F.col("_from").alias("_b"), F.col("first.start").alias("t"), F.lit(2).alias("_kind"), F.lit(-1).cast("long").alias("_n"), none.alias("_first"))
    end = F.struct(F.col("_to").alias("_b"), F.col("end").alias("t"), F.lit(0 if closed else 2).alias("_kind"), F.lit(1).cast("long").alias("_n"), F.col("first").alias("_first"))
    bounds = live.select(key, F.explode(F.array(begin, end)).alias("x")).select(key, "x.*")
    over = live.where("_from < _to").select(key, F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_b"), "first")
    over = over.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("first").alias("_first"))

    size = lambda df, p, b: df.groupBy(key, "_b").agg(F.count(F.lit(p)).alias("p"), F.count(F.lit(b)).alias("b"))
    busy = size(own, 1, None).unionByName(size(bounds, None, 1)).groupBy(key, "_b").agg(F.sum("p").alias("p"), F.sum("b").alias("b"))
    busy = busy.where((F.col("p") > part) | (F.col("b") > part)).select(key, "_b", F.greatest(F.lit(1), F.ceil(F.col("p") / part)).cast("int").alias("_parts"))
    busy = cut(busy, "busy")  # a row for each `part` points or bounds at most

    bounds = bounds.join(busy, [key, "_b"], "left")
    folded = bounds.where("_parts is not null").groupBy(key, "_b", "t", "_kind", "_parts").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    bounds = bounds.where("_parts is null").unionByName(folded)
    over = over.join(busy, [key, "_b"], "left").withColumns({"t": F.lit(None).cast(bounds.schema["t"].dataType), "_kind": F.lit(0)})
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    marks = bounds.unionByName(over).withColumn("_part", each).drop("_parts").withColumn("_point", F.lit(None).cast(points.schema))
    own = own.join(busy, [key, "_b"], "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1))).cast("int"))
    own = own.select(key, "_b", "t", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), none.alias("_first"), "_part", F.struct(*points.columns).alias("_point"))
    late = W.partitionBy(key, "_b", "_part").orderBy(F.desc_nulls_first("t"), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = own.unionByName(marks).withColumns({"n": F.sum("_n").over(late), "first": F.min("_first").over(late)})
    return swept.where("_point is not null and n > 0").select("_point.*", "n", "first")


def chunked(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Rows with ``chunk``: their number in chunks of ``size`` of each key, in order."""
    if size < 1:
        raise ValueError("a chunk has a row at least")
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / size).cast("long"))


def owned(words: DataFrame, key: str, length: int, overlap: int, slack: int = 250) -> DataFrame:
    """Words recognised in overlapping windows, each once: ``window`` is the one that owns its start.

    Windows begin every ``length`` and hear ``overlap`` more on either side. A window keeps words from ``slack``
    before its begin to ``slack`` after its end (half open); where two keep one, the earlier does.
    Rows are (key, start_ms, end_ms, text and more), one for each window that heard the word, named by ``heard``.
    """
    begin = F.col("heard") * length
    kept = words.where((F.col("start_ms") >= begin - slack) & (F.col("start_ms") < begin + length + slack))
    same = [key, "start_ms", "end_ms", "text"]
    rest = [c for c in words.columns if c not in (*same, "heard")]
    return kept.groupBy(*same).agg(F.min("heard").alias("window"), *(F.min_by(c, "heard").alias(c) for c in rest))


def heard(words: DataFrame, length: int, overlap: int) -> DataFrame:
    """Words with ``heard``: a row for each window of ``length`` that hears them, ``overlap`` beyond its bounds included."""
    first = F.floor((F.col("start_ms") - overlap) / length)
    last = F.floor((F.col("start_ms") + overlap) / length)
    return words.withColumn("heard", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
