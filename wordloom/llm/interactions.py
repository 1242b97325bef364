"""Filter interaction audit: what each filter removes in every order, by a memoised walk of the permutation trie.

Every text is read once, for one narrow row of verdicts a document. The trie of all orders is then walked depth
first: a node is what the filters so far have left, a persisted DataFrame made from its parent by one more
filter. Nodes that hold the same filters in another order are the same survivors, so each of the 2**n sets is
made once (memoised) and an order's nodes are found by their set. At every node the removals of each edge
that leaves it, by a filter not yet applied, are counted on the survivors; the counts are appended to a
table in the shared folder, and a node is unpersisted when the walk leaves it, so that n of them are persisted at
most. A lost executor's blocks are made again from the verdicts' table.

All n! orders are rows of a constant table; each looks up its n edges by (set, filter).

A document whose text equals that of a smaller doc_id is found by a 256-bit hash: partial minima for each hash, of
which those that occur more than once are joined back, the frequent ones by a broadcast of at most ``HOT``.

Null texts are empty ones and equal to them; a null doc_id is smaller than any other; rows of equal doc_id are
each a document, and none of them a copy of the other by that alone; texts may be of any length; labels that
are null or of unknown documents say nothing, and of several labels of a document the greatest counts; an
empty table has no parts and gives no rows; other columns are not read, except the one of parts (null: empty).
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wordloom.llm.common import UPPER, cut, shared_path
from wordloom.llm.components import HOT

_WORDS = r"[\x20\x09-\x0D]+"
#: Filters at most: their orders are n!.
MOST = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a document by itself: too few words, too few different ones, too many capitals, signs."""
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def copies(docs: DataFrame, total: int) -> DataFrame:
    """The rows (doc_id, h and more) with ``copy``: whether a smaller doc_id has the same h."""
    found = docs.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found, hot = cut(found, "copies"), F.col("n") * HOT >= total
    later = F.coalesce(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id") > F.col("first"), F.lit(False)).alias("copy")
    often = F.broadcast(found.where(hot).select("h", "first"))  # HOT rows at most, since their n add up to no more than total
    marked = docs.join(often, "h", "left")
    rest = marked.where("first is null").drop("first").join(found.where(~hot).select("h", "first"), "h", "left")
    return marked.where("first is not null").unionByName(rest).select(*docs.columns, later)


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang", copy_name: str = "E") -> tuple[DataFrame, list[str]]:
    """One row a document: its part, whether it is good and toxic by the labels, and a flag for each filter it fails."""
    text = F.coalesce("text", F.lit(""))
    filters = text_filters(F.col("t"))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    own = own.select("doc_id", "part", F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("h"), *(c.alias(f"fails_{k}") for k, c in filters.items()))
    own = cut(own, "verdicts")
    own = copies(own, own.count()).withColumnRenamed("copy", f"fails_{copy_name}").drop("h")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    out = own.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"]).drop("doc_id")
    return cut(out, "flags"), [*filters, copy_name]


def edges(flags: DataFrame, names: list[str]) -> DataFrame:
    """(part, applied, filter, kept, removed, good_lost, toxic_lost) of every edge of the trie that some document of the part reaches.

    ``applied`` is the set of filters before the edge, as bits. Rows of flags are (part, good, toxic, fails_<name>).
    """
    if len(names) > MOST:
        raise ValueError(f"the orders of {len(names)} filters are too many; {MOST} at most")
    path, seen = shared_path(flags.sparkSession, "edges"), set()
    fails = {n: F.col(f"fails_{n}") for n in names}

    def visit(applied: int, survivors: DataFrame) -> None:
        seen.add(applied)
        ahead = [(k, n) for k, n in enumerate(names) if not applied >> k & 1]
        if not ahead:
            return
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.struct(
            F.lit(n).alias("filter"), F.count_if(~fails[n]).alias("kept"), F.count_if(fails[n]).alias("removed"),
            F.count_if(fails[n] & F.col("good")).alias("good_lost"), F.count_if(fails[n] & F.col("toxic")).alias("toxic_lost"),
        ) for _, n in ahead]
        own = survivors.groupBy("part").agg(F.array(*counts).alias("edges"))
        own.select("part", F.lit(applied).alias("applied"), F.inline("edges")).write.mode("append").parquet(path)
        for k, n in ahead:
            if applied | 1 << k not in seen:
                visit(applied | 1 << k, survivors.where(~fails[n]))
        survivors.unpersist()

    visit(0, flags)
    return flags.sparkSession.read.schema("part string, applied int, filter string, kept long, removed long, good_lost long, toxic_lost long").parquet(path)


def orders(names: list[str]) -> list[tuple[str, int, int, str]]:
    """(filter_order, step, applied, filter) of all steps of all orders."""
    bit = {n: 1 << k for k, n in enumerate(names)}
    return [("".join(p), step + 1, sum(bit[n] for n in p[:step]), n) for p in permutations(names) for step, n in enumerate(p)]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step, zeros included."""
    flags, names = verdicts(docs, labels, part)
    found = cut(edges(flags, names), "edges")
    spark = docs.sparkSession
    fails = [F.col(f"fails_{n}").cast("int") for n in names]
    one = sum(fails[1:], fails[0]) == 1
    sums = [F.struct(F.lit(n).alias("filter"), F.count_if(F.col(f"fails_{n}")).alias("fail"), F.count_if(F.col(f"fails_{n}") & one).alias("unique_fails")) for n in names]
    alone = flags.groupBy("part").agg(F.array(*sums).alias("s")).select("part", F.inline("s"))

    steps = orders(names)
    rows = spark.createDataFrame(steps, "filter_order string, step int, applied int, filter string")
    times = spark.createDataFrame([(a, n, sum(s[2:] == (a, n) for s in steps)) for a, n in {s[2:] for s in steps}], "applied int, filter string, times long")
    assert len(steps) == factorial(len(names)) * len(names)
    shapley = found.join(F.broadcast(times), ["applied", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    per = alone.join(shapley, ["part", "filter"], "left")
    own = per.join(F.broadcast(rows), "filter").join(found, ["part", "applied", "filter"], "left")  # steps of all orders, a constant number
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    redundant = (F.col("fail") - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant")
    return own.select("part", "filter_order", "step", zero("kept"), zero("removed"), redundant, zero("unique_fails"), zero("good_lost"), zero("toxic_lost"), zero("shapley"))


__all__ = ["audit", "copies", "edges", "orders", "text_filters", "verdicts"]
