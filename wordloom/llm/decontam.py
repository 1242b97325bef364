"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are words: runs of letters, digits and characters beyond ASCII, lower-cased. A document is
contaminated by an item if some passage of it is within ``floor((1 - threshold) * words)`` word
edits of the item (``threshold`` 0.8).

The search is LSH over item-sized windows. The CGK random walk maps a text of n words to n steps: in
each step it writes the word it stands on and goes to the next if a random bit of (walk, step, word)
says so; texts a few edits apart soon walk together again, so many of their steps agree. A repeat
samples ``BITS`` steps of one of ``WALKS`` walks, and a window and an item whose samples are equal in
any of ``REPEATS`` repeats meet in a bucket. A passage at the limit of edits meets its item in a
repeat with probability 0.2 (60 words) to 0.6 (5 words); with 64 repeats 0.99 or more of such passages
are found (``recall_at_limit`` measures it), and nearer ones more surely. Each pair that met is then
verified by exact edit distance against the text around the window.

Windows in which no item of their size can be are not embedded: an edit spoils one word and two word
pairs at most, so a window at the start of a passage holds all but k of an item's different words and all
but 2k of its different pairs. Windows with fewer words and pairs of items of their size (or of a class of
sizes, if there are over 64) are left out; that loses nothing and names no item.

Items go to the executors in blocks of at most ``ITEMS`` items or about ``WORDS`` words, a pass over
the documents for each; with several blocks the hits (or the documents kept) of each are written to the
shared folder before the next block is made, so one block is in memory at a time. Null and empty texts
and items without words are never contaminated nor contaminate; each row is judged by its own text,
whatever its doc_id (of any type); repeated items are reported each for itself; texts and items may be
of any length; other columns are passed on whatever their names. An item_id is null or of any type; an empty
table of documents gives no rows, an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from wordloom.llm.common import ALNUM, cut, mix, ship, with_id, word_hashes

REPEATS, WALKS, BITS = 64, 16, 3
#: Steps within which a repeat samples, from a random one on: walks that are together stay so for a while.
STRETCH = 16
#: Items, and words of items, that are sent to the executors at once.
ITEMS, WORDS = 20_000, 1 << 21
#: Words of the windows that are embedded together.
TOGETHER = 1 << 19
_MASK, _TABLE, _CLASSES = 1 << 24, 1 << 21, 64


def edits_allowed(n: int, threshold: float) -> int:
    return int((1 - threshold) * n + 1e-9)


def cgk_keys(windows: np.ndarray, seed: int = 0) -> np.ndarray:
    """[window, repeat]: a hash of the size, the repeat and the sampled steps; all windows (rows of word hashes) are of one size."""
    m, n = windows.shape
    flat, first = windows.reshape(-1), np.arange(m) * n
    draw = np.random.default_rng(seed).random((REPEATS, BITS + 1))
    places = np.minimum((draw[:, :1] * n).astype(np.int64) + (draw[:, 1:] * STRETCH).astype(np.int64), n - 1)
    out = mix(np.arange(REPEATS, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(n))[None, :].repeat(m, axis=0)
    for walk in range(WALKS):
        own = range(walk, REPEATS, WALKS)
        salts = mix(np.arange(n, dtype=np.uint64) + np.uint64((seed * WALKS + walk) * 1_000_003 + 1))
        at, wrote = first.copy(), {}
        wanted = {int(j) for r in own for j in places[r]}
        for j in range(max(wanted) + 1):  # a step goes on by one at most, so the walk never leaves the window
            word = flat[at]
            if j in wanted:
                wrote[j] = word
            at += (((word ^ salts[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
        for r in own:
            for j in places[r].tolist():
                out[:, r] = mix(out[:, r] * np.uint64(3) + wrote[j])
    return out


def recall_at_limit(n: int, threshold: float = 0.8, trials: int = 500, seed: int = 0) -> float:
    """The share of random passages of n words at the limit of edits that meet their item in a bucket, from their own start alone."""
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 1 << 62, (trials, n)).astype(np.uint64)
    windows = np.zeros((trials, n), np.uint64)
    for t in range(trials):
        own = items[t].tolist()
        for _ in range(edits_allowed(n, threshold)):
            at, new = int(rng.integers(len(own))), int(rng.integers(1, 1 << 62))
            own[at : at + 1] = ([], [new], [own[at], new])[int(rng.integers(3))]
        windows[t] = (own + rng.integers(1, 1 << 62, n).tolist())[:n]
    return float((cgk_keys(items) == cgk_keys(windows)).any(1).mean())


def best_end(item: np.ndarray, region: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the prefix of the region (or of its best passage) that is nearest to the item."""
    w = np.arange(len(region) + 1)
    row = w.copy() if anchored else np.zeros(len(region) + 1, np.int64)
    for i, x in enumerate(item.tolist()):
        step = np.minimum(row[1:] + 1, row[:-1] + (region != x))
        row = np.minimum.accumulate(np.concatenate(([i + 1], step)) - w) + w
    end = int(row.argmin())
    return int(row[end]), end


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of the region that is nearest to the item, by word edits."""
    edits, end = best_end(item, region)
    _, back = best_end(item[::-1], region[:end][::-1], anchored=True)
    return edits, end - back, end


@dataclass
class Items:
    """A block of items and its buckets."""

    ids: list
    words: list[np.ndarray]
    allowed: list[int]
    sizes: np.ndarray  # the different sizes, each with its class and the different words and pairs a window must hold
    groups: list[np.ndarray]  # indices of sizes that are near each other
    classes: np.ndarray
    least_words: np.ndarray
    least_pairs: np.ndarray
    mask: np.ndarray  # by the hash of a pair: whether items have it
    word_classes: np.ndarray  # by the hash of a word or pair: a bit for each class of sizes in which items have it
    pair_classes: np.ndarray
    keys: np.ndarray  # sorted, with the item of each
    owners: np.ndarray


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _class_bits(hashes: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    out = np.zeros(_TABLE, np.uint64)
    for h, c in zip(hashes, classes.tolist(), strict=True):
        out[(h % np.uint64(_TABLE)).astype(np.int64)] |= np.uint64(1 << c)
    return out


def _first_before(h: np.ndarray) -> np.ndarray:
    """The place of the same hash before each, -1 if there is none."""
    order = np.argsort(h, kind="stable")
    out = np.full(len(h), -1, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of equal sizes, of TOGETHER words at most (one index at least)."""
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        step = max(1, TOGETHER // n)
        for a in range(0, len(own), step):
            yield own[a : a + step]


def prepare(rows: list[tuple], threshold: float) -> Items:
    """The block of rows (item_id, text)."""
    ids, words, allowed = [], [], []
    for i, h in word_hashes([(t or "").lower() for _, t in rows], ALNUM):
        if len(h):
            ids.append(rows[i][0])
            words.append(h)
            allowed.append(edits_allowed(len(h), threshold))
    lengths = np.array([len(h) for h in words], np.int64)
    pairs = [_pairs(h) for h in words]
    sizes, at = np.unique(lengths, return_inverse=True)
    classes = np.arange(len(sizes)) * _CLASSES // max(len(sizes), 1) if len(sizes) > _CLASSES else np.arange(len(sizes))
    least = np.full((2, len(sizes)), np.iinfo(np.int64).max)
    for k, (h, p, most) in enumerate(zip(words, pairs, allowed, strict=True)):  # an edit spoils one word and two pairs at most
        least[:, at[k]] = np.minimum(least[:, at[k]], (len(np.unique(h)) - most, len(np.unique(p)) - 2 * most))
    mask = np.zeros(_MASK, bool)
    for p in pairs:
        mask[(p % np.uint64(_MASK)).astype(np.int64)] = True
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for own in _by_size(lengths):
        keys.append(cgk_keys(np.stack([words[i] for i in own])).reshape(-1))
        owners.append(np.repeat(own.astype(np.int32), REPEATS))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    near = np.floor(2 * np.log2(np.maximum(sizes, 1))).astype(np.int64)
    groups = [np.flatnonzero(near == g) for g in np.unique(near)]
    return Items(ids, words, allowed, sizes, groups, classes, *least, np.packbits(mask, bitorder="little"), _class_bits(words, classes[at]), _class_bits(pairs, classes[at]), key[order], owner[order])


def windows_of(h: np.ndarray, items: Items) -> list[tuple[int, np.ndarray]]:
    """(size, starts) of the windows in which an item of that size can be; a window may run over the end of the text."""
    if not len(items.sizes) or not len(h):
        return []
    pairs, at = _pairs(h), np.arange(len(h))
    hit = (pairs % np.uint64(_MASK)).astype(np.int64)
    hit = items.mask[hit >> 3] >> (hit & 7).astype(np.uint8) & 1
    held, groups, out = np.concatenate(([0], np.cumsum(hit, dtype=np.int32))), [], []
    for own in items.groups:  # pairs of any items first
        wide = int(items.sizes[own].max())
        starts = np.flatnonzero(held[np.minimum(at + wide - 1, len(pairs))] - held[at] >= items.least_pairs[own].min())
        if len(starts):
            groups.append((own, starts))
    if not groups:
        return []
    word_bits, pair_bits = (table[(x % np.uint64(_TABLE)).astype(np.int64)] for table, x in ((items.word_classes, h), (items.pair_classes, pairs)))
    before = _first_before(h), _first_before(pairs)
    for own, near in groups:
        some = np.bitwise_or.reduce(pair_bits[near[near < len(pairs)]], initial=np.uint64(0))
        for k in own.tolist():
            n, c, need = int(items.sizes[k]), np.uint64(items.classes[k]), (int(items.least_words[k]), int(items.least_pairs[k]))
            if need[1] > 0 and not some >> c & np.uint64(1) and not (pair_bits >> c & np.uint64(1)).any():
                continue
            starts, kinds = near, ((pair_bits >> c & np.uint64(1), before[1], n - 1, need[1]), (word_bits >> c & np.uint64(1), before[0], n, need[0]))
            for x, _, wide, least in kinds:
                if len(starts) and least > 0:
                    total = np.concatenate(([0], np.cumsum(x, dtype=np.int32)))
                    starts = starts[total[np.minimum(starts + wide, len(x))] - total[starts] >= least]
            for x, last, wide, least in kinds:  # each different word or pair once
                if len(starts) and least > 0:
                    starts = starts[_different(x.astype(bool), last, starts, wide) >= least]
            if len(starts):
                out.append((n, starts))
    return out


def _different(held: np.ndarray, before: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """How many places of each window are held and the first of their kind in it."""
    out, step = np.zeros(len(starts), np.int64), max(1, TOGETHER // wide)
    for a in range(0, len(starts), step):
        s = starts[a : a + step, None]
        place = s + np.arange(wide)
        inside = np.minimum(place, len(held) - 1)
        out[a : a + step] = (held[inside] & (before[inside] < s) & (place < len(held))).sum(1)
    return out


def met(docs: list[np.ndarray], items: Items) -> list[tuple[int, int, int]]:
    """(document, item, start of a window) of all that share a bucket."""
    found: set[tuple[int, int, int]] = set()
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for d, h in enumerate(docs):
        for n, starts in windows_of(h, items):
            by_size.setdefault(n, []).append((d, starts))
    for n, own in by_size.items():
        where = np.concatenate([np.full(len(s), d) for d, s in own])
        start = np.concatenate([s for _, s in own])
        step = max(1, TOGETHER // n)
        for a in range(0, len(start), step):
            d, s = where[a : a + step], start[a : a + step]
            windows = np.zeros((len(s), n), np.uint64)
            for r, (x, b) in enumerate(zip(d.tolist(), s.tolist(), strict=True)):
                part = docs[x][b : b + n]
                windows[r, : len(part)] = part
            keys = cgk_keys(windows).reshape(-1)
            low, high = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
            for k in np.flatnonzero(high > low).tolist():
                r = k // REPEATS
                found.update((int(d[r]), item, int(s[r])) for item in items.owners[low[k] : high[k]].tolist())
    return sorted(found)


def verified(docs: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, length, edits) of passages near an item; of passages that start within half an item of each other the first found."""
    last, seen = None, []
    for d, k, s in met(docs, items):
        if last != (d, k):
            last, seen = (d, k), []
        item, most = items.words[k], items.allowed[k]
        if any(abs(s - a) <= max(most, len(item) // 2) for a in seen):
            continue
        low = max(0, s - 2 * most)
        region = docs[d][low : s + len(item) + 2 * most]
        if np.isin(item, region).sum() < len(item) - most:  # each word that is missing is an edit
            continue
        edits, a, b = nearest(item, region)
        if edits <= most and not any(abs(low + a - x) <= max(most, len(item) // 2) for x in seen):
            seen.append(low + a)
            yield d, k, low + a, b - a, edits


def _blocks(benchmark: DataFrame, threshold: float, block: int) -> Iterator[tuple[Items, bool]]:
    """Blocks of items, and whether it is the only one; an empty one if there are no items."""
    held, words, made = [], 0, 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if len(held) >= block or words >= WORDS:
            yield prepare(held, threshold), False
            held, words, made = [], 0, made + 1
        held.append((r[0], r[1]))
        words += len(r[1] or "") // 5
    yield prepare(held, threshold), not made


def _texts(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    out = [np.zeros(0, np.uint64)] * batch.num_rows
    for i, h in word_hashes([(t or "").lower() for t in batch.column(at).to_pylist()], ALNUM):
        out[i] = h
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block: int = ITEMS) -> DataFrame:
    """A row for each passage near an item: its first word, its words, the word edits, 1 - edits / words of the item."""
    spark = docs.sparkSession
    ship(spark)
    item_type = benchmark.schema["item_id"].dataType
    schema = with_id(docs, "item_id long", "start_word long", "n_words long", "edits long", "similarity double")

    schema["item_id"].dataType = item_type
    item_arrow = to_arrow_type(item_type)

    def search(items: Items, only: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches):
            items = sent.value
            for batch in batches:
                rows = [(d, items.ids[k], s, n, e, 1 - e / len(items.words[k])) for d, k, s, n, e in verified(_texts(batch, 1), items)]
                at, item, *rest, similar = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_arrow), *(pa.array(c, pa.int64()) for c in rest), pa.array(similar, pa.float64())], names=schema.names)

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if not only:
            found = cut(found, "hits")
            sent.destroy()
        return found

    return reduce(DataFrame.unionByName, [search(*b) for b in _blocks(benchmark, threshold, block)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block: int = ITEMS) -> DataFrame:
    """The documents that no item contaminates; columns and texts as they were."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index("text")

    def left(docs: DataFrame, items: Items, only: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches):
            items = sent.value
            for batch in batches:
                gone = {d for d, *_ in verified(_texts(batch, at), items)}
                yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_())) if gone else batch

        kept = docs.mapInArrow(run, docs.schema)
        if not only:
            kept = cut(kept, "kept")
            sent.destroy()
        return kept

    for items, only in _blocks(benchmark, threshold, block):
        docs = left(docs, items, only)
    return docs


__all__ = ["cgk_keys", "contamination", "decontaminate", "edits_allowed", "recall_at_limit"]
