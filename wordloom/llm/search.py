"""Ranked lexical search over a forward index in blocks, with block-max pruning.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case,
named by 64 bits of hash. ``build`` reads every text once and writes one row for each block, a range of
``BLOCK`` consecutive documents (fewer where they are long): the block's terms, for each term the
documents that hold it with their integer impacts, and the largest of those impacts. Nothing is
shuffled for that; N and L, which impacts need, come from one aggregate before.

``search`` takes items in blocks of at most ``ITEMS`` items or about ``WORDS`` words, which are sent to
all tasks, and reads the index in passes that touch only the columns they need:

1. how many documents hold each term of the items (sums of numbers that the blocks hold);
2. an upper bound of each item in each block, from the largest impacts; the ``LEADERS`` best blocks of each item;
3. exact scores in those few blocks: the k-th best score of an item is its threshold;
4. in each task, an item's blocks in order of bound, scored until the bound drops below the threshold,
   which rises with what the task itself finds; the best k of a task and item go on.

A block is left out only if its bound is below a score that k documents reach, so the result is exact;
ties at the threshold are scored. Rows that leave a task number k for each item at most, and none below
the threshold.

Null texts and texts without terms count nowhere and are found by nothing; null and empty items, and items of
which no term occurs, find nothing; repeated items are answered each for itself; repeated rows are
documents of their own; equal scores are ranked by ascending doc_id (null before any other, of any type
that can be ordered); texts and items may be of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import ALNUM, cut, ship, word_hashes

#: What a term is made of, for expressions; ``common.ALNUM`` says the same of bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block, and words after which a block ends early.
BLOCK, BLOCK_WORDS = 64, 1 << 18
#: Items, and words of items, that are sent to the executors at once.
ITEMS, WORDS = 5_000, 1 << 19
#: Blocks of each item that are scored to find its threshold.
LEADERS = 4
#: Bytes of index rows that are held together in a task.
TOGETHER = 1 << 26

#: Columns of the index besides the documents' ids; numbers are packed, little-endian.
_INDEX = ("block long", "terms binary", "held binary", "best binary", "places binary", "impacts binary")


def ascii_lower(text: str | None) -> str:
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m, from its number of terms; whole numbers of any size."""
    top = int(lengths.max(initial=0))
    if 75 * top * n_docs >= 1 << 63:
        return np.array([min(25 + 75 * int(n) * n_docs // max(n_terms, 1), 1 << 58) for n in lengths], np.int64)
    return 25 + 75 * lengths.astype(np.int64) * n_docs // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf.astype(np.int64) // (1_000 * tf.astype(np.int64) + 8 * m)


def weight(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


@dataclass
class Index:
    """The table of blocks, the number of documents with terms, and the number of their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def block_row(words: list[np.ndarray], n_docs: int, n_terms: int) -> list[bytes]:
    """terms, held, best, places and impacts of one block of documents, given by their words."""
    m = norm(np.array([len(w) for w in words], np.int64), n_docs, n_terms)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    terms, at = np.unique(np.concatenate(words), return_inverse=True)
    pair, tf = np.unique(at * len(words) + owner, return_counts=True)
    term, place = np.divmod(pair, len(words))
    gain = impact(tf, m[place])
    first = np.searchsorted(term, np.arange(len(terms)))
    held = np.bincount(term, minlength=len(terms))
    best = np.maximum.reduceat(gain, first) if len(gain) else gain
    return [x.astype(kind).tobytes() for x, kind in ((terms, "<u8"), (held, "<u2"), (best, "<i4"), (place, "<u1"), (gain, "<i4"))]


def build(docs: DataFrame) -> Index:
    """The index of all documents, written to the shared folder."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM))
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL(", ".join(_INDEX)).fields, T.StructField("ids", T.ArrayType(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, words, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            row = [pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in block_row(words, n_docs, n_terms)), pa.array([ids], pa.list_(id_arrow))]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            id_arrow = batch.column(0).type
            own = batch.column(0).to_pylist()
            for i, h in word_hashes([ascii_lower(t) for t in batch.column(1).to_pylist()], ALNUM):
                if not len(h):
                    continue
                ids.append(own[i])
                words.append(h)
                size += len(h)
                if len(ids) == BLOCK or size >= BLOCK_WORDS:
                    yield made()
                    block, ids, words, size = block + 1, [], [], 0
        if ids:
            yield made()

    ship(docs.sparkSession)
    return Index(cut(docs.select("doc_id", "text").mapInArrow(run, schema), "index"), n_docs, n_terms)


@dataclass
class Items:
    """A block of items: their different terms in order, and each item's share of an array of (term, weight)."""

    ids: list
    terms: np.ndarray
    starts: np.ndarray  # of the items with terms
    owners: np.ndarray  # the items they are of
    which: np.ndarray  # place in terms
    repeats: np.ndarray
    weights: np.ndarray

    def found(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``terms`` of those that a block has, and where it has them."""
        own = np.frombuffer(packed, "<u8")
        at = np.minimum(np.searchsorted(own, self.terms), len(own) - 1)
        hit = np.flatnonzero(own[at] == self.terms)
        return hit, at[hit]

    def bounds(self, terms: bytes, best: bytes) -> np.ndarray:
        """The most that a document of the block can score, for each item with terms."""
        hit, at = self.found(terms)
        most = np.zeros(len(self.terms), np.int64)
        most[hit] = np.frombuffer(best, "<i4")[at]
        return np.add.reduceat(self.weights * most[self.which], self.starts)

    def scores(self, item: int, at: np.ndarray, first: np.ndarray, held: np.ndarray, places: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
        """The scores of a block's n documents; at says where in the block each of ``terms`` is (-1: nowhere)."""
        end = self.starts[item + 1] if item + 1 < len(self.starts) else len(self.which)
        out = np.zeros(n, np.int64)
        for k in range(self.starts[item], end):
            t = at[self.which[k]]
            if t >= 0 and self.weights[k]:
                own = slice(first[t], first[t] + held[t])
                out[places[own]] += self.weights[k] * impacts[own]
        return out


def prepare(rows: list[tuple]) -> Items:
    """Items (id, text) without weights yet."""
    which, repeats, owners, starts, n = [], [], [], [], 0
    for i, h in word_hashes([ascii_lower(t) for _, t in rows], ALNUM):
        if len(h):
            own, times = np.unique(h, return_counts=True)
            which.append(own)
            repeats.append(times)
            owners.append(i)
            starts.append(n)
            n += len(own)
    hashes = np.concatenate(which) if which else np.zeros(0, np.uint64)
    terms, at = np.unique(hashes, return_inverse=True)
    times = np.concatenate(repeats) if repeats else np.zeros(0, np.int64)
    return Items([r[0] for r in rows], terms, np.array(starts, np.int64), np.array(owners, np.int64), at, times, np.zeros(len(at), np.int64))


def _held(batches: Iterator[pa.RecordBatch], tell=None) -> Iterator[list[tuple]]:
    """Rows, in lists of about TOGETHER bytes; ``tell`` is told the schema."""
    rows, size = [], 0
    for batch in batches:
        if tell is not None:
            tell(batch.schema)
        for k in range(batch.num_rows):
            row = tuple(c[k].as_py() for c in batch.columns)
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if size >= TOGETHER:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


class Ranking:
    """The best k (score, doc_id) of each item so far; ``least`` is what a score must reach."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.best: dict[int, list[tuple]] = {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        own = np.flatnonzero(scores >= self.least[item])
        if not len(own):
            return
        rows = self.best.get(item, []) + [(-int(scores[p]), ids[p] is not None, ids[p]) for p in own]
        rows.sort(key=lambda r: r if r[1] else r[:2])
        self.best[item] = rows = rows[: self.k]
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], -rows[-1][0])


def _score(rows: list[tuple], items: Items, ranking: Ranking, allowed: dict[int, set[int]] | None = None) -> int:
    """Scores blocks (block, terms, held, best, places, impacts, ids), each item's in order of bound; returns how many pairs were scored."""
    bounds = np.stack([items.bounds(r[1], r[3]) for r in rows])
    open_blocks: dict[int, tuple] = {}
    scored = 0
    for item in np.flatnonzero((bounds >= ranking.least).any(axis=0)).tolist():
        for b in np.argsort(-bounds[:, item], kind="stable").tolist():
            if bounds[b, item] < ranking.least[item]:
                break
            if allowed is not None and item not in allowed[rows[b][0]]:
                continue
            if b not in open_blocks:
                hit, where = items.found(rows[b][1])
                at = np.full(len(items.terms), -1, np.int64)
                at[hit] = where
                held = np.frombuffer(rows[b][2], "<u2").astype(np.int64)
                open_blocks[b] = at, np.cumsum(held) - held, held, np.frombuffer(rows[b][4], "<u1"), np.frombuffer(rows[b][5], "<i4").astype(np.int64)
            ranking.add(item, items.scores(item, *open_blocks[b], len(rows[b][6])), rows[b][6])
            scored += 1
    return scored


def _search(index: Index, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the best of each task, for items by their place in the block."""
    table, spark = index.table, index.table.sparkSession

    def documents_with(batches):
        items, n = sent.value, None
        for rows in _held(batches):
            n = np.zeros(len(items.terms), np.int64) if n is None else n
            for terms, held in rows:
                hit, at = items.found(terms)
                n[hit] += np.frombuffer(held, "<u2")[at]
        own = np.flatnonzero(n) if n is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n[own] if len(own) else [], pa.int64())], names=["term", "n"])

    sent = spark.sparkContext.broadcast(items)  # ITEMS items and about WORDS words at most
    found = table.select("terms", "held").mapInArrow(documents_with, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # the items' terms
    sent.unpersist()
    df = np.zeros(len(items.terms), np.int64)
    df[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    items.weights = items.repeats * np.where(df > 0, weight(df, index.n_docs), 0)[items.which]

    def leaders_of(batches):
        items = sent.value
        best: list[list] = [[] for _ in items.starts]
        for rows in _held(batches):
            bounds = np.stack([items.bounds(terms, top) for _, terms, top in rows])
            for b in np.argsort(-bounds, axis=0, kind="stable")[:LEADERS]:
                for item in range(len(items.starts)):
                    if bounds[b[item], item] > 0:
                        best[item].append((-int(bounds[b[item], item]), rows[b[item]][0]))
            best = [sorted(x)[:LEADERS] for x in best]
        out = [(item, block, -bound) for item, x in enumerate(best) for bound, block in x]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["item", "block", "bound"])

    sent = spark.sparkContext.broadcast(items)
    order = W.partitionBy("item").orderBy(F.desc("bound"), "block")
    lead = table.select("block", "terms", "best").mapInArrow(leaders_of, "item long, block long, bound long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS)
    wanted: dict[int, set[int]] = {}
    for item, block in lead.select("item", "block").collect():  # LEADERS for each item at most
        wanted.setdefault(block, set()).add(item)

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", table.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    columns = [*(c.split()[0] for c in _INDEX), "ids"]

    def best_of(least: np.ndarray, allowed: dict[int, set[int]] | None):
        def run(batches):
            items, ranking, seen = sent.value, Ranking(k, least), {}
            for rows in _held(batches, lambda schema: seen.update(ids=schema.field("ids").type.value_type)):
                _score(rows, items, ranking, allowed)
            if out := [(item, r[2], -r[0]) for item, rows in ranking.best.items() for r in rows]:
                item, ids, score = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, seen["ids"]), pa.array(score, pa.int64())], names=schema.names)

        return run

    none = np.ones(len(items.starts), np.int64)  # a score above 0
    blocks = spark.createDataFrame([(b,) for b in wanted], "block long")
    first = table.join(F.broadcast(blocks), "block", "left_semi").select(*columns).mapInArrow(best_of(none, wanted), schema)  # LEADERS times ITEMS blocks at most
    by_item = W.partitionBy("item").orderBy(F.desc("score"))
    floor = first.withColumn("r", F.row_number().over(by_item)).where(F.col("r") == k).select("item", "score")
    least = none.copy()
    for item, score in floor.collect():  # one for each item
        least[item] = score
    return table.select(*columns).mapInArrow(best_of(least, None), schema)


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """Rows of items in blocks, and whether it is the only one."""
    held, words, made = [], 0, 0
    for r in items.select("item_id", "text").toLocalIterator():
        if len(held) >= ITEMS or words >= WORDS:
            yield held, False
            held, words, made = [], 0, made + 1
        held.append((r[0], r[1]))
        words += len(r[1] or "") // 5
    yield held, not made


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text), best first."""
    spark = index.table.sparkSession
    ship(spark)
    id_type = items.schema["item_id"].dataType
    parts: list[DataFrame] = []
    for rows, only in _blocks(items):
        own = prepare(rows)
        if not len(own.starts):
            continue
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = _search(index, own, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(p, rows[i][0]) for p, i in enumerate(own.owners.tolist())], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type)]))
        best = best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # ITEMS rows at most
        parts.append(best if only else cut(best, "found"))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    found = index.table.limit(0).select(F.explode("ids").alias("doc_id"))
    return found.select(F.lit(None).cast(id_type).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``build`` and ``search`` in one."""
    return search(build(docs), items, k)


__all__ = ["Index", "build", "rank_documents", "search"]
