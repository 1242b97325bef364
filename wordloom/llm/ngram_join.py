"""Similarity join on sets of word n-grams: MinHash banding, then exact verification.

Words are runs of anything but ``[\\x20\\x09-\\x0D]`` in the lower-cased text; a text of fewer
words than n has one n-gram of them all; a text without words (or null) has none and joins nothing.
Texts with equal sets form a class, and only its representative goes on. Signatures of
``bands * rows`` MinHashes are cut into bands; representatives that share the hash of a band are a
candidate pair, which is verified on the full n-gram sets. ``bands_for`` chooses bands and rows so that a
pair at the threshold shares a band with probability ``recall`` (0.99994 unless said), and pairs above it
more surely: at 0.8 these are 32 bands of 6 rows, at 0.5 14 bands of one. Lower thresholds bring more unlike
texts together for verification; ``most_bands`` allows more bands of more rows, which bring fewer.

Pairs are never rows. The members of a bucket (the representatives with one hash in one band) are
brought together with their sets, in blocks of ``BLOCK`` members or ``GRAMS`` n-grams; a larger
bucket is dealt into pairs of blocks. A pair that shares several bands is counted in the first of
them, and a bucket with the same members as an earlier one is left out. Where buckets overlap so much
that their whole component (representatives joined by buckets) takes fewer rows, the component is
brought together instead of its buckets; there too only pairs that share a band count. So the rows that carry sets are never more than one for each
member of a bucket, and with m members of one bucket (m * m / BLOCK rows for m * m / 2 candidate
pairs) stay in proportion to the candidate pairs: exact numbers of links in a group of m texts, all
different and all alike, are quadratic work.

Result: a row for each document with ``class_id`` (the least doc_id of its group of linked
documents, its own if it has no link), ``n_links`` (documents at a similarity of ``threshold`` or
more, copies counted each) and ``n_copies`` (documents of an equal set). Repeated rows are documents
of their own; a null doc_id takes part and never names a class that has another id; an empty table
gives no rows; other columns are not read. A doc_id is of any type that can be ordered.
"""

from __future__ import annotations

from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import cut, grams, mix, ship, spare, with_id, word_hashes
from wordloom.llm.components import components, lookup

#: The probability that a pair at the threshold is found, and the bands at most.
RECALL, MOST_BANDS = 0.99994, 32
#: Members of a block, and n-grams of all its members (or one member's); a task compares two blocks with each other.
BLOCK, GRAMS = 128, 1 << 20


def shingle_sets(texts: list[str | None], n: int):
    """Yields (index, sorted distinct hashes of the word n-grams) in order."""
    for i, h in word_hashes([(t or "").lower() for t in texts]):
        yield i, np.unique(grams(h, n))


def set_key(s: np.ndarray) -> tuple[int, int]:
    k = xxhash.xxh3_128_intdigest(s.tobytes())
    return (k >> 64) - (1 << 63), (k & (1 << 64) - 1) - (1 << 63)


def bands_for(threshold: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows with which no more than ``most_bands`` bands reach the recall at the threshold."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("the threshold must be above 0 and no more than 1, the recall between 0 and 1")
    for rows in range(16, 0, -1):
        bands = 1 if threshold == 1 else ceil(log(1 - recall) / log1p(-(threshold**rows)) - 1e-9)
        if bands <= most_bands:
            return bands, rows
    raise ValueError(f"{most_bands} bands can't reach a recall of {recall} at {threshold}; allow more")


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of the set's MinHash signature."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    by, plus = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        v = x[a : a + 1024, None] * by + plus
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for c in least.reshape(bands, rows).T.astype(np.uint64):
        out = mix(out * np.uint64(0x100000001B3) + c)
    return out


def signatures(docs: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, th, k1, k2, n_grams, bands): th is the text's hash, k1 and k2 name the set."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, s in shingle_sets(batch.column(2).to_pylist(), n):
                rows.append((*set_key(s), len(s), band_hashes(s, bands, per_band).view(np.int64).tolist() if len(s) else None))
            k1, k2, size, hashes = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "th", "k1", "k2", "n_grams", "bands"])

    ship(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, with_id(docs, "th long", "k1 long", "k2 long", "n_grams int", "bands array<long>"))


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """[i, j]: whether sets i of a and j of b (of a itself if None) reach the threshold, by full intersections."""
    both = a if b is None else a + b
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    keys, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = np.cumsum(count > 1)[column[shared]] - 1, owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    hits = np.zeros((len(a), len(both) if b is None else len(b)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        x = np.zeros((len(both), 4096), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        hits += x[: len(a)] @ (x if b is None else x[len(a) :]).T
    size = np.array([len(s) for s in both], float)
    own, other = size[: len(a)], size if b is None else size[len(a) :]
    return hits >= threshold * (own[:, None] + other[None, :] - hits) - 1e-9


def _groups(batches, keys: int):
    """Rows of equal leading columns, from batches sorted by them; one group in memory at a time."""
    held: list[list] = []
    now = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j]: the first band in which row i of a and row j of b have the same hash; the number of bands if there is none."""
    out = np.full((len(a), len(b)), a.shape[1], np.int16)
    for t in range(a.shape[1] - 1, -1, -1):
        out[a[:, t, None] == b[None, :, t]] = t
    return out


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(node, peer, links) of each linked node in each pair of blocks: peer is the least node linked with it, however far.

    Groups are named by ``t`` and ``g``: with t of -1 a component, in which pairs count that share any
    band, else a bucket of band t, in which pairs count that share no band before t.
    """

    def run(batches):
        rows: list[tuple[int, int, int]] = []
        for (t, _, i, j), own in _groups(batches, 4):
            own = {r[1]: r for r in own}.values()  # a task run twice, or repeated rows of one document
            sides = [[r for r in own if r[0] == side] for side in ((i, j) if i != j else (i,))]
            if not all(sides):
                continue
            sets = [[np.frombuffer(r[4], np.uint64) for r in side] for side in sides]
            ok = linked(sets[0], sets[1] if i != j else None, threshold)
            bands = [np.array([r[3] for r in side], np.int64) for side in sides]
            first = first_shared(bands[0], bands[-1])
            ok &= first == t if t >= 0 else first < bands[0].shape[1]
            if i == j:
                np.fill_diagonal(ok, False)
            nodes = [r[1] for side in sides for r in side]
            copies = [np.array([r[2] for r in side], np.int64) for side in sides]
            links = ok @ copies[-1] if i == j else np.concatenate((ok @ copies[1], ok.T @ copies[0]))
            root = list(range(len(nodes)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(*np.nonzero(np.triu(ok) if i == j else ok)):
                x, y = find(int(x)), find(int(y) + (len(sides[0]) if i != j else 0))
                if x != y:
                    root[y] = x
            least: dict[int, int] = {}
            for k, node in enumerate(nodes):
                least[find(k)] = min(node, least.get(find(k), node))
            rows += [(node, least[find(k)], int(links[k])) for k, node in enumerate(nodes) if links[k]]
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["node", "peer", "links"])
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["node", "peer", "links"])

    own = members.select("t", "g", "i", "j", "side", "node", "n_copies", "bands", "grams")
    own = own.repartition("t", "g", "i", "j").sortWithinPartitions("t", "g", "i", "j")
    return own.mapInArrow(run, "node long, peer long, links long")


def placements(classes: DataFrame) -> DataFrame:
    """(node, t, g, parts): the groups, buckets or whole components, in which each candidate is compared."""
    banded = cut(classes.select("node", "n_grams", F.posexplode("bands").alias("t", "g")))  # g tells the band too
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    found = banded.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("size"), F.min("node").alias("lead"), *names).where("n > 1")
    found = found.groupBy("n", "size", "lead", "x1", "x2").agg(F.min(F.struct("t", "g")).alias("b"))  # the first of those with the same members
    found = cut(found.select("b.t", "b.g", "n", "size", "lead"))
    rows = cut(lookup(banded.drop("t"), found, "g", banded.count()))
    nodes = components(rows.select(F.col("node").alias("u"), F.col("lead").alias("v"))).join(classes.select("node", "n_grams"), "node")
    nodes = cut(nodes)
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / GRAMS)).cast("int")
    whole = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("size"))
    split = found.join(nodes.select(F.col("node").alias("lead"), "root"), "lead").groupBy("root").agg(F.sum(F.col("n") * parts).alias("in_buckets"))
    whole = cut(whole.join(split, "root").withColumn("dense", F.col("n") * parts <= F.col("in_buckets")))
    own = cut(lookup(nodes.select("node", "root"), whole, "root", nodes.count()))
    dense = own.where("dense").select("node", F.lit(-1).alias("t"), F.col("root").alias("g"), parts.alias("parts"))
    kept = found.join(own.where("not dense").select(F.col("node").alias("lead")), "lead", "left_semi").select("g", "n")
    sparse = lookup(rows.select("node", "t", "g", "size", F.col("n").alias("members")), kept, "g", rows.count())
    return dense.unionByName(sparse.select("node", "t", "g", parts.alias("parts")))


def _with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of the wanted representatives, from the documents' whole texts."""
    kept = [c for c in wanted.columns if c not in ("rep", "rep_th")]
    at = len(kept)

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets: list[bytes] = []
            rows: list[int] = []

            def flush():
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in batch.columns[:at]), pa.array(sets, pa.binary())], names=[*kept, "grams"])

            for i, s in shingle_sets(batch.column(at).to_pylist(), n):
                if set_key(s) == (k1[i], k2[i]):
                    sets.append(s.tobytes())
                    rows.append(i)
                    if sum(map(len, sets[-64:])) > 1 << 24 or len(sets) >= 2048:
                        yield flush()
                        sets, rows = [], []
            yield flush()

    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), "text")
    joined = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))).select(*kept, "text")
    schema = T.StructType([*wanted.select(*kept).schema.fields, T.StructField("grams", T.BinaryType())])
    return joined.mapInArrow(run, schema)


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = RECALL, most_bands: int = MOST_BANDS) -> DataFrame:
    """(doc_id, th, class_id, n_links, n_copies, kept): kept is true for one row of each group."""
    sig = cut(signatures(docs, n, *bands_for(threshold, recall, most_bands)).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "uid"))
    classes = sig.where("n_grams > 0").groupBy("k1", "k2").agg(first.alias("f"), F.count(F.lit(1)).alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = cut(classes.select("k1", "k2", F.col("f.doc_id").alias("rep"), F.col("f.th").alias("rep_th"), F.col("f.uid").alias("rep_uid"), "n_copies", "n_grams", "bands").withColumn("node", F.monotonically_increasing_id()))

    placed = placements(classes).groupBy("node").agg(F.collect_list(F.struct("t", "g", "parts")).alias("groups"))  # a group for each band at most
    wanted = classes.join(placed, "node").select("k1", "k2", "rep", "rep_th", "node", "n_copies", "bands", "groups")
    members = _with_sets(docs, wanted, n).withColumn("x", F.explode("groups")).select("node", "n_copies", "bands", "grams", "x.*")
    dealt = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    links = cut(_verify(dealt, threshold))

    roots = components(links.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.drop("bands").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.select("k1", "k2", "rep", "rep_uid", "node", "n_copies", "root", "links"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "rep_uid")).alias("least"), F.count(F.lit(1)).alias("n"))
    labels = cut(lookup(named, least, "root", named.count()).select("k1", "k2", "n_copies", "links", F.col("least.rep").alias("class_id"), F.col("least.rep_uid").alias("class_uid")))
    # copies of one set, and texts without n-grams, never meet in one task
    said = lookup(sig.where("n_grams > 0"), labels.withColumn("n", F.col("n_copies")), ["k1", "k2"], sig.count())
    out = said.unionByName(sig.where("n_grams = 0"), allowMissingColumns=True)
    return out.select(
        "doc_id", "th",
        F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n_copies"), F.lit(1)) - 1).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("uid") == F.col("class_uid"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without all but one of each group of linked documents; columns and texts as they were, null ids included."""
    found = ngram_join(docs, n, threshold)
    per = cut(found.groupBy("doc_id", "th").agg(F.count_if("kept").alias("keep"), F.count(F.lit(1)).alias("rows")))
    g_id, g_th = spare(docs, "g_id", "g_th")
    named = lambda where: per.where(where).select(F.col("doc_id").alias(g_id), F.col("th").alias(g_th))
    same = docs["doc_id"].eqNullSafe(F.col(g_id)) & (F.xxhash64(docs["text"]) == F.col(g_th))
    out = docs.join(named("keep = 0"), same, "left_anti")
    some = named("keep > 0 and keep < rows")
    if some.isEmpty():
        return out
    once = docs.join(some, same, "left_semi").dropDuplicates(["doc_id", "text"])  # repeated rows, of which one stays
    return out.join(some, same, "left_anti").unionByName(once)


__all__ = ["band_hashes", "bands_for", "keep_one", "linked", "ngram_join", "placements", "set_key", "shingle_sets", "signatures"]
