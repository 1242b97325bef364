"""How alike two utterances are: every measure is read off one matrix of word-to-word degrees.

The degree of two words is 1 (equal), 0.92 (equal without an inflection), 0.80 (a long common start,
or a matching-blocks ratio of 0.86) or 0. Candidate pairs are made by joins; ``compare`` works on one pair
at a time in Arrow batches, for the ratio of matching blocks has no built-in form. ``scores`` has the measures
that are plain numbers for many pairs at a time.
"""

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import lexicon as L
from wordloom.functions import vocabulary as V
from wordloom.shipping import ship

_INFLECTIONS = frozenset(V.INFLECTIONS)
_LONGEST = max(map(len, _INFLECTIONS))
_DROPPED = re.compile(rf"(?<!\S)(?:{'|'.join(V.FILLER_SEQUENCES)})(?!\S)")
_SAME = re.compile(rf"(?<!\S)(?:{'|'.join(V.ORAL_EQUIVALENTS)})(?!\S)")
_DROPPED_FIRST, _SAME_FIRST = (frozenset(x.split()[0] for x in own) for own in (V.FILLER_SEQUENCES, V.ORAL_EQUIVALENTS))
_FILLERS = frozenset(V.COMPARISON_FILLERS)
_EMPTY = frozenset(V.STOPWORDS) | frozenset(L.HARD_FILLERS)
_GENERIC = frozenset(L.COMMON_SHORT_WORDS)
OPENING, TAIL = 8, 6

MEASURES = (
    "align double, containment double, loss double, bag double, opening double, tail double, structure double, prefix_tokens int, prefix double, "
    "restart_prefix boolean, restart_structure boolean, n_shared int, shared array<string>, lost array<string>, gained array<string>, lost_in_prefix array<string>, "
    "sequence double, jaccard double, score double, score_interrupted double"
)


def oral(tokens: list[str]) -> list[str]:
    """Without stock phrases and fillers, turns of phrase in one form; the tokens themselves if nothing is left."""
    text = " ".join(tokens)
    said = text.split()
    if not _DROPPED_FIRST.isdisjoint(said):
        said = _DROPPED.sub(" ", text).split()
    said = [t for t in said if t not in _FILLERS]
    if not _SAME_FIRST.isdisjoint(said):
        said = _SAME.sub(lambda m: V.ORAL_EQUIVALENTS[m.group()], " ".join(said)).split()
    return said or [t for t in tokens if t]


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """Without the longest inflection that leaves four characters."""
    for k in range(min(_LONGEST, len(word) - 4), 0, -1):
        if word[-k:] in _INFLECTIONS:
            return word[:-k]
    return word


@lru_cache(1 << 14)
def trigrams(word: str) -> frozenset[str]:
    return frozenset(word[k : k + 3] for k in range(len(word) - 2))


def _begun_alike(x: str, y: str) -> float:
    """The degree of two words by their stems and starts."""
    if x == y:
        return 1.0
    if stem(x) == stem(y):
        return 0.92
    shorter = min(len(x), len(y))
    start = max(4, ceil(0.70 * shorter))
    return 0.80 if shorter >= start and x[:start] == y[:start] else 0.0


@lru_cache(1 << 17)
def degree(x: str, y: str) -> float:
    begun_alike = _begun_alike(x, y)
    if begun_alike:
        return begun_alike
    shorter = min(len(x), len(y))
    # at a ratio of 0.86 so few characters are unmatched that some matching block has three at least
    if shorter < 5 or 2 * shorter < 0.86 * (len(x) + len(y)) or trigrams(x).isdisjoint(trigrams(y)):
        return 0.0
    blocks = SequenceMatcher(None, x, y, autojunk=False)
    return 0.80 if blocks.quick_ratio() >= 0.86 and blocks.ratio() >= 0.86 else 0.0


def is_content(word: str) -> bool:
    return len(word) >= 2 and word not in _EMPTY


@lru_cache(1 << 17)
def weight(word: str) -> float:
    return 0.15 if not is_content(word) else 0.35 if word in _GENERIC else 1.0


def in_order(gain: np.ndarray) -> float:
    """The best sum of gains along a chain that goes down and right: a running maximum for each row."""
    best = np.zeros(gain.shape[1] + 1)
    for row in gain:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(row > 0, best[:-1] + row, 0.0)))
    return float(best[-1])


def _share(part: float, whole: float) -> float:
    return part / whole if whole > 0 else 0.0


def _agree(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _without(words: list[str]) -> Iterator[list[str]]:
    """The words, and the words without one of the first six."""
    yield words
    for k in range(min(6, len(words))):
        yield words[:k] + words[k + 1 :]


def compare(a: list[str] | None, b: list[str] | None) -> tuple:
    """The measures of MEASURES for the earlier words a and the later words b; null or empty sides have zero in all."""
    a, b = oral(list(a)) if a is not None else [], oral(list(b)) if b is not None else []
    if not a or not b:
        return (0.0,) * 7 + (0, 0.0, False, False, 0, [], [], [], [], 0.0, 0.0, 0.0, 0.0)
    w, v = np.array([weight(x) for x in a]), np.array([weight(y) for y in b])
    same = np.array([[degree(x, y) for y in b] for x in a])
    gain = same * w[:, None]
    align = _share(in_order(gain), w.sum())

    def ends(rows: slice, columns: slice) -> float:
        return _share(in_order(gain[rows, columns]), min(w[rows].sum(), v[columns].sum()))

    opening, tail = ends(slice(OPENING), slice(OPENING)), ends(slice(-TAIL, None), slice(-TAIL, None))
    structure = max(opening, tail)

    own = {x: i for i, x in reversed(list(enumerate(a))) if is_content(x)}
    own = dict(sorted(own.items(), key=lambda item: item[1]))
    others = [j for j, y in enumerate(b) if is_content(y)]
    free = same[np.ix_(list(own.values()), others)]
    found = free.any(axis=1) if others else np.zeros(len(own), bool)
    shared, lost = [x for x, hit in zip(own, found) if hit], [x for x, hit in zip(own, found) if not hit]
    gained = [y for y in dict.fromkeys(b[j] for j in others) if not any(degree(y, x) for x in own)]
    total = sum(map(weight, own))
    bag = 0.0
    for k, x in enumerate(own if others else ()):
        j = int(free[k].argmax())
        if free[k, j] > 0:
            bag += float(free[k, j]) * weight(x)
            free[:, j] = 0
    bag = _share(bag, total)
    containment, loss = _share(sum(map(weight, shared)), total), _share(sum(map(weight, lost)), total)

    agreed = max(max(_agree(x, b) for x in _without(a)), max(_agree(a, y) for y in _without(b)))
    prefix = agreed / min(len(a), len(b))
    begun = set(a[:agreed])
    union = set(own) | {b[j] for j in others}
    jaccard = _share(len(set(own) & {b[j] for j in others}), len(union))

    core = max(align, bag, structure)
    anchored = structure >= 0.60 or align >= 0.72
    whole = bool(own) and bool(others) and not lost and containment >= 1.0 and len(own) <= len(others)
    if whole:
        score = 1.0
    elif anchored:
        score = max(core, 0.90)
    elif structure >= 0.35 and max(align, bag) >= 0.50:
        score = max(core, 0.72)
    else:
        score = core
    stopped = max(core, 0.90) if core >= 0.40 and not whole else score
    return (
        align, containment, loss, bag, opening, tail, structure, agreed, prefix, agreed >= 3 and prefix >= 0.42, structure >= 0.60 and len(shared) >= 2,
        len(shared), sorted(shared), lost, gained, [x for x in lost if x in begun], SequenceMatcher(None, a, b, autojunk=False).ratio(), jaccard, float(score), float(stopped),
    )


@lru_cache(1 << 17)
def _seen(word: str) -> tuple[str, str, int, int] | None:
    """A content word with its start, length and letters (a bit each, of 64), None for other words."""
    letters = 0
    for c in word:
        letters |= 1 << (ord(c) & 63)
    return (word, word[:4], len(word), letters) if is_content(word) else None


@lru_cache(1 << 14)
def _said(text: str) -> tuple:
    """Of normal tokens with single spaces: the words as ``compare`` takes them, their three-word beginnings without one, content words as ``_seen``."""
    words = oral(text.split(" ")) if text else []
    return words, {tuple(x[:3]) for x in _without(words[:4]) if len(x) > 2}, [x for x in map(_seen, dict.fromkeys(words)) if x]


def _met(own: list[tuple], others: list[tuple]) -> list[list[tuple[str, str]]]:
    """For each word, where there are any, the others it may have a degree above zero with: a common start of four, or letters that leave a ratio of 0.86 open."""
    out = []
    for x, start, n, letters in own:
        near = [(x, y) for y, other, m, z in others if start == other or (n > 4 and m > 4 and (letters ^ z).bit_count() <= 0.1400001 * (n + m))]
        if near:
            out.append(near)
    return out


def _share_of_ends(a: list[str], b: list[str]) -> float:
    w = np.array([weight(x) for x in a])
    return _share(in_order(np.array([[degree(x, y) for y in b] for x in a]) * w[:, None]), min(w.sum(), np.array([weight(y) for y in b]).sum()))


def begins(a: str, b: str) -> bool:
    """False where ``compare`` finds neither ``restart_prefix`` nor ``restart_structure``, read off as little as that takes.

    Of most pairs of sentences only the beginnings are read, and the starts and letters of words.
    """
    (own, starts, content), (others, other_starts, other_content) = _said(a), _said(b)
    if tuple(own[:3]) in other_starts or tuple(others[:3]) in starts:
        return True
    met = _met(content, other_content)
    if len(met) < 2:
        return False
    able = {near[0][0] for near in met}
    most = lambda end: sum(weight(x) for x in own[end] if x in able or not is_content(x)) + 1e-9
    need = lambda end: 0.60 * min(sum(map(weight, own[end])), sum(map(weight, others[end])))
    if all(most(end) < need(end) for end in (slice(OPENING), slice(-TAIL, None))):
        return False
    if sum(any(degree(x, y) for x, y in near) for near in met) < 2:
        return False
    return _share_of_ends(own[:OPENING], others[:OPENING]) >= 0.60 or _share_of_ends(own[-TAIL:], others[-TAIL:]) >= 0.60


def _begun(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[x is not None and y is not None and begins(x, y) for x in xs] for xs, y in zip(a, b, strict=True)])


def begun(a: Column, b: Column) -> Column:
    """For each of the texts a (an array; of normal tokens) whether b may start it over, see ``begins``; null texts start nothing."""
    ship()
    return F.pandas_udf(_begun, "array<boolean>")(a, b)


#: The measures that ``scores`` has.
SCORES = ("align", "containment", "bag", "structure", "prefix", "jaccard", "score")
#: Cells of matrices that ``scores`` works on at a time, if one pair has no more.
CELLS = 1 << 17


@lru_cache(1 << 14)
def _weights(generic: int, others: int) -> float:
    return sum([0.35] * generic + [1.0] * others)


def _chains(gain: np.ndarray) -> np.ndarray:
    """``in_order`` of each matrix; where a gain is zero the chain before is no better than the one above."""
    best = np.zeros((gain.shape[0], gain.shape[2] + 1))
    for i in range(gain.shape[1]):
        np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + gain[:, i]), axis=1, out=best[:, 1:])
    return best[:, -1]


def _packed(p: np.ndarray, i: np.ndarray, j: np.ndarray, values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Matrices of the cells' values without the rows and columns that have none, filled up with zeros at the end."""
    rows, columns = np.zeros((shape[0], shape[1]), bool), np.zeros((shape[0], shape[2]), bool)
    rows[p, i] = columns[p, j] = True
    rows, columns = rows.cumsum(axis=1, dtype=np.int32), columns.cumsum(axis=1, dtype=np.int32)
    out = np.zeros((shape[0], rows[:, -1].max(), columns[:, -1].max()))
    out[p, rows[p, i] - 1, columns[p, j] - 1] = values
    return out


def _run(same: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row the first place from ``begin`` on that is not the same; its length if there is none."""
    ended = np.column_stack([~same & (np.arange(same.shape[1]) >= begin[:, None]), np.ones(len(same), bool)])
    return ended.argmax(axis=1)


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def scores(texts: list[str], a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """SCORES of many pairs, the same as ``compare`` gives. a, b: the places of their texts (normal tokens with single spaces), -1 for null.

    Pairs of like sizes share padded matrices; starts and letters of words leave few cells for ``degree``, and chains go over those alone.
    """
    said = [oral(t.split(" ")) if t else [] for t in texts]
    size = np.array([*map(len, said), 0])  # the last text, that of null, is empty
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(x, len(ids)) for words in said for x in words] + [-1], np.int32)  # the last fills up, a word without letters
    first, owner = size.cumsum() - size, np.repeat(np.arange(len(size)), size)

    known, starts = [*ids, ""], {}
    start = np.array([starts.setdefault(x[:4], len(starts)) for x in known], np.int32)
    length = np.array([*map(len, known)])
    code = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    held = np.bincount(np.repeat(np.arange(len(known)), length) * 32 + code, minlength=32 * len(known)).reshape(-1, 32)
    once, twice = (np.packbits(held >= k, axis=1, bitorder="little").view(np.uint32)[:, 0] for k in (1, 2))
    # at a ratio of 0.86 at most 0.14 of all characters are unmatched, and the other word has at most 1.14 / 0.86 times the length
    spare = np.where(length > 4, np.minimum(0.14 / 0.86 * 2 * length + 1e-6, 32).astype(int) + 1, 0).astype(np.uint8)
    others_once = np.where(length > 4, once, np.uint32((1 << 32) - 1))
    content = np.array([is_content(x) for x in known])
    generic = np.array([x in _GENERIC for x in known]) & content
    heavy = np.where(generic, 0.35, np.where(content, 1.0, 0.15))

    # of each text: sums of weights, words of content as they come first
    total, opening, tail = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        w = heavy[flat[first[rows][:, None] + np.arange(n)]]
        total[rows], opening[rows], tail[rows] = w.sum(axis=1), w[:, :OPENING].sum(axis=1), w[:, -TAIL:].sum(axis=1)
    own = np.zeros(len(flat), bool)
    own[np.unique(owner * len(known) + flat[:-1], return_index=True)[1]] = True
    own &= content[flat]
    count = lambda flags: np.bincount(owner[flags[:-1]], minlength=len(size))
    n_own, n_generic, n_others = count(own), count(own & generic[flat]), count(content[flat])
    own_weight = np.array([*map(_weights, n_generic.tolist(), (n_own - n_generic).tolist())])

    out = {k: np.zeros(len(a)) for k in SCORES}
    order = np.flatnonzero((size[a] > 0) & (size[b] > 0))
    order = order[np.lexsort((size[b[order]], size[a[order]]))]
    lengths, others = size[a[order]], size[b[order]]
    begin = 0
    while begin < len(order):
        n = int(lengths[begin])
        most = others[begin : min(np.searchsorted(lengths, n, "right"), begin + CELLS // n + 1)]
        now = order[begin : begin + max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1) * n, CELLS, "right")))]
        begin += len(now)
        x, y = a[now], b[now]
        m, place = size[y], np.arange(size[y[-1]])
        at = first[x][:, None] + np.arange(n)
        own_a, u, v = own[at], flat[at], flat[np.where(place < m[:, None], first[y][:, None] + place, len(flat) - 1)]

        near = np.bitwise_count(once[u][:, :, None] ^ others_once[v][:, None, :]) < spare[u][:, :, None]
        near |= start[u][:, :, None] == start[v][:, None, :]
        p, i, j = np.nonzero(near)
        k, l = u[p, i], v[p, j]
        unmatched = np.bitwise_count(once[k] ^ once[l]).astype(int) + np.bitwise_count(twice[k] ^ twice[l])
        able, d = (np.minimum(length[k], length[l]) > 4) & (unmatched * 50 <= 7 * (length[k] + length[l])), (k == l).astype(float)
        for rows, f in ((np.flatnonzero(able & (k != l)), degree), (np.flatnonzero(~able & (k != l) & (start[k] == start[l])), _begun_alike)):
            d[rows] = [f(known[q], known[r]) for q, r in zip(k[rows].tolist(), l[rows].tolist())]
        hit = np.flatnonzero(d)
        p, i, j, k, l, d = p[hit], i[hit], j[hit], k[hit], l[hit], d[hit]

        def chains(of: np.ndarray | slice) -> np.ndarray:
            return _chains(_packed(p[of], i[of], j[of], (d * heavy[k])[of], near.shape))  # noqa: B023

        out["align"][now] = align = _shares(chains(slice(None)), total[x])
        structure = _shares(chains((i < OPENING) & (j < OPENING)), np.minimum(opening[x], opening[y]))
        out["structure"][now] = structure = np.maximum(structure, _shares(chains((i >= n - TAIL) & (j >= m[p] - TAIL)), np.minimum(tail[x], tail[y])))

        told = np.flatnonzero(own_a[p, i] & content[l])
        p, i, j, k, l, d = p[told], i[told], j[told], k[told], l[told], d[told]
        found, same = np.zeros(u.shape, bool), np.zeros(u.shape, bool)
        found[p, i] = True
        same[p[k == l], i[k == l]] = True
        bag, n_found = np.zeros(len(now)), found.sum(axis=1)
        met = np.flatnonzero(n_found)
        if len(met):
            rank, rows = np.searchsorted(met, p), np.arange(len(met))
            free, weights = _packed(rank, i, j, d, (len(met), *near.shape[1:])), _packed(rank, i, np.zeros_like(i), heavy[k], (len(met), n, 1))
            for q in range(free.shape[1]):
                best = free[:, q].argmax(axis=1)
                d = free[rows, q, best]
                bag[met] += d * weights[:, q, 0]
                hit = np.flatnonzero(d)
                free[hit, :, best[hit]] = 0
        n_found_generic = (found & generic[u]).sum(axis=1)
        found_weight = np.array([*map(_weights, n_found_generic.tolist(), (n_found - n_found_generic).tolist())])
        out["bag"][now] = bag = _shares(bag, own_weight[x])
        out["containment"][now] = _shares(found_weight, own_weight[x])
        both = same.sum(axis=1)
        out["jaccard"][now] = _shares(both, n_own[x] + n_own[y] - both)

        shorter = min(n, len(place))
        agreed = _run(u[:, :shorter] == v[:, :shorter], np.zeros(len(now), int))
        without_a = _run(u[:, 1 : shorter + 1] == v[:, : min(n - 1, shorter)], np.minimum(agreed, min(5, n - 1)))
        without_b = _run(u[:, : min(len(place) - 1, shorter)] == v[:, 1 : shorter + 1], np.minimum(agreed, np.minimum(5, m - 1)))
        out["prefix"][now] = np.maximum(agreed, np.maximum(without_a, without_b)) / np.minimum(n, m)

        core = np.maximum(np.maximum(align, bag), structure)
        whole = (n_found > 0) & (n_found == n_own[x]) & (n_own[x] <= n_others[y])
        anchored, fairly = (structure >= 0.60) | (align >= 0.72), (structure >= 0.35) & (np.maximum(align, bag) >= 0.50)
        out["score"][now] = np.select([whole, anchored, fairly], [1.0, np.maximum(core, 0.90), np.maximum(core, 0.72)], core)
    return out


def _measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    names = [m.split()[0] for m in MEASURES.split(", ")]
    return pd.DataFrame([compare(x, y) for x, y in zip(a, b, strict=True)], columns=names)


def measures(a: Column, b: Column) -> Column:
    """MEASURES of two columns of normal tokens, the earlier utterance first."""
    ship()
    return F.pandas_udf(_measure, MEASURES)(a, b)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        each = pc.list_parent_indices(t["near"]).to_numpy()
        said = pa.concat_arrays([t["near_said"].flatten(), t["said"]]).dictionary_encode()
        at = said.indices.fill_null(-1).to_numpy()
        found = scores(said.dictionary.to_pylist(), at[: len(each)], at[len(each) :][each])
        yield pa.RecordBatch.from_arrays([t["rush_id"].take(pa.array(each)), t["near"].flatten(), t["b"].take(pa.array(each)), *map(pa.array, found.values())], ["rush_id", "a", "b", *found])


def scored(neighbours: DataFrame) -> DataFrame:
    """(rush_id, a, b, SCORES) of each b with all that are near, from (rush_id, near, near_said, b, said): longs, and what they say as normal tokens with single spaces."""
    ship(neighbours.sparkSession)
    rush = neighbours.schema["rush_id"].dataType.simpleString()
    schema = f"rush_id {rush}, a long, b long, {', '.join(f'{k} double' for k in SCORES)}"
    return neighbours.select("rush_id", "near", "near_said", "b", "said").mapInArrow(_scored, schema)
