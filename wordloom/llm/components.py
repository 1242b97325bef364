"""Connected components of an edge table, by alternating large and small stars.

Edges are pairs of whole numbers; null nodes are not allowed, loops and repeated edges say nothing,
an empty table has no components. Very long paths take a number of rounds that grows with the
logarithm of their length. A node with very many neighbours is looked up apart (``lookup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut

#: Keys with a larger share of the rows than 1/HOT are looked up in a broadcast table, which so has HOT rows at most.
HOT = 1024


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """The inner join of rows with a table of one row a key, where ``n`` says how many of the ``total`` rows have that key.

    Frequent keys never meet in one task: their few rows of the table are sent to where the rows are.
    """
    hot = F.col("n") * HOT >= max(total, 1)
    sent = F.broadcast(table.where(hot))  # HOT rows at most, since their n add up to no more than total
    return rows.join(sent, key).unionByName(rows.join(sent.select(key), key, "left_anti").join(table.where(~hot), key))


def _stars(pairs: DataFrame, total: int, keep_smaller: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself; pairs hold (u, v), total of them at most."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = lookup(pairs, least, "u", total)
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_smaller:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(now: DataFrame) -> bool:
    """Whether every node has one neighbour at most that is less than it, and that one has none."""
    ends = now.select("u", F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("n"), F.min("up").alias("least"), F.max("up").alias("most")).where("n > 1 or least <> most").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component, for each node of an edge (u, v); no row for others.

    Each round is cut in the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_stars(both, both.count(), keep_smaller=False))
        now = cut(_stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large.count(), keep_smaller=True))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
