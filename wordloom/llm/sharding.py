"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

A node of k shards is split at the weighted quantile (its bytes in the ratio of the shards on either
side) of its widest dimension, until each node is one shard. Dimensions are functions of the text:
the logarithm of its size, characters per byte, lines per kilobyte; points on one place are ordered
by a hash of the text and then of the row, so equal texts lie side by side and a cut goes through
them only if moving it to their edge would misplace more than ``GROUP_SLACK`` of a shard.

Quantiles are found by sums over ten bits of the sort key at a time (a row for each node and value
at most comes to the driver), never by sorting, until a cut is within ``SLACK`` of a shard. Places in
a shard are numbered by counts of sorted partitions. Null texts have no bytes but the ``extra`` of
each row; texts of any length count by their bytes alone, and one that is larger than a shard has its own; null doc_ids and repeated rows are rows like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import cut, partitions

#: How far a cut may miss its quantile, as a share of one shard's bytes; and to keep equal texts together.
SLACK, GROUP_SLACK = 0.0005, 0.01
_DIM_BITS, _HASH_BITS, _ROW_BITS, _STEP = 20, 30, 40, 10
_FIRST = _DIM_BITS + _HASH_BITS


def default_dimensions() -> dict[str, Column]:
    size = F.octet_length("text") + 1
    lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return {"size": F.log2(size), "density": F.char_length("text") / size, "lines": 1000 * lines / size}


@dataclass
class _Cut:
    """The search for one node's cut: of the rows under ``prefix`` (bits of the key), ``below`` bytes lie lower."""

    want: float
    below: int = 0
    prefix: int = 0
    bits: int = 0
    done: bool = False


def _narrow(c: _Cut, sums: dict[int, int], leaf: float) -> None:
    """One more step: the value in which the wanted quantile falls, or a boundary near enough."""
    step, seen = 1 << _STEP, c.below
    for value in sorted(sums):
        low, high = seen, seen + sums[value]
        if high >= c.want or value == max(sums):
            whole_text = c.bits + _STEP == _FIRST  # the value is one text
            slack = leaf * (GROUP_SLACK if whole_text else SLACK)
            last = c.bits + _STEP == _FIRST + _ROW_BITS
            miss, at = min((abs(low - c.want), value), (abs(high - c.want), value + 1))
            c.bits += _STEP
            if miss <= slack or last:
                c.prefix, c.done = c.prefix * step + at, True
            else:
                c.prefix, c.below = c.prefix * step + value, low
            return
        seen = high


def _search(rows: DataFrame, cuts: dict[int, _Cut], leaf: float) -> None:
    """Finds all cuts of a level; rows hold node, size, key1 (dimension and text), key2 (row)."""
    while open_cuts := {n: c for n, c in cuts.items() if not c.done}:
        under, digit = F.lit(False), F.lit(0)
        for node, c in open_cuts.items():
            upto = c.bits + _STEP
            if upto <= _FIRST:
                at, own = F.shiftright("key1", _FIRST - upto), F.shiftright("key1", _FIRST - c.bits) == c.prefix
            else:
                more = c.bits - _FIRST
                own = (F.col("key1") == c.prefix >> more) & (F.shiftright("key2", _ROW_BITS - more) == c.prefix & (1 << more) - 1)
                at = F.shiftright("key2", _ROW_BITS - more - _STEP)
            own = (F.col("node") == node) & own
            under, digit = under | own, F.when(own, at % (1 << _STEP)).otherwise(digit)
        found = rows.where(under).groupBy("node", digit.alias("digit")).agg(F.sum("size")).collect()  # 1,024 rows a node at most
        sums: dict[int, dict[int, int]] = {n: {} for n in open_cuts}
        for node, value, n in found:
            sums[node][value] = n
        for node, c in open_cuts.items():
            if sums[node]:
                _narrow(c, sums[node], leaf)
            else:
                c.done = True


def _below(c: _Cut) -> Column:
    """Whether a row is on the lower side of a cut."""
    if c.bits <= _FIRST:
        return F.col("key1") < F.lit(c.prefix << (_FIRST - c.bits)).cast("long")
    more = c.bits - _FIRST
    high, low = c.prefix >> more, (c.prefix & (1 << more) - 1) << (_ROW_BITS - more)
    return (F.col("key1") < high) | ((F.col("key1") == high) & (F.col("key2") < F.lit(low).cast("long")))


def kd_shards(docs: DataFrame, shards: int = 40, dimensions: dict[str, Column] | None = None, extra: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    given = dimensions or default_dimensions()
    text = F.coalesce("text", F.lit(""))
    dims = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"d{k}") for k, c in enumerate(given.values())]
    names = [f"d{k}" for k in range(len(dims))]
    rows = docs.select("doc_id", (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - _HASH_BITS).alias("th"), *dims)
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("key2", F.shiftrightunsigned(F.xxhash64("uid"), 64 - _ROW_BITS)))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max))).first()
    if not ends["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaf = ends["size"] / shards
    top = (1 << _DIM_BITS) - 1
    for n in names:  # whole numbers over the corpus' range
        low, span = ends[f"min_{n}"], max(ends[f"max_{n}"] - ends[f"min_{n}"], 1e-300)
        rows = rows.withColumn(n, F.floor((F.col(n) - low) / span * top).cast("long"))
    rows = rows.withColumn("node", F.lit(0)).withColumn("width", F.lit(shards))  # a node is named by its first shard
    nodes = {0: shards}
    while any(k > 1 for k in nodes.values()):
        wide = [n for n, k in nodes.items() if k > 1]
        stats = rows.where(F.col("node").isin(wide)).groupBy("node").agg(F.sum("size").alias("size"), *(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max))).collect()  # a row a node
        cuts, dim = {}, F.lit(0).cast("long")
        for s in stats:
            node, k = s["node"], nodes[s["node"]]
            widest = max(names, key=lambda n: (s[f"max_{n}"] - s[f"min_{n}"], -names.index(n)))
            dim = F.when(F.col("node") == node, F.col(widest)).otherwise(dim)
            cuts[node] = _Cut(s["size"] * (k // 2) / k)
        rows = cut(rows.withColumn("key1", F.shiftleft(dim, _HASH_BITS) + F.col("th")))
        _search(rows, cuts, leaf)
        to = F.col("node")
        for node, c in cuts.items():
            to = F.when((F.col("node") == node) & ~_below(c), F.lit(node + nodes[node] // 2)).otherwise(to)
        rows = rows.withColumn("node", to)
        nodes = {x: y for n, k in nodes.items() for x, y in ([(n, k)] if k == 1 else [(n, k // 2), (n + k // 2, k - k // 2)])}
    return numbered(rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "uid"), "shard").drop("uid")


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """``slot``: 0, 1, ... within each group in order of uid; groups may be larger than any partition."""
    n = partitions(rows.sparkSession)
    rows = cut(rows.repartitionByRange(n, group, "uid").sortWithinPartitions(group, "uid").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # partitions and groups at most
    runs = runs.withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(runs), [group, "_part"]).withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
