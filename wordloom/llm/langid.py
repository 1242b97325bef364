"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a text is parsed greedily into the
longest phrases that occur in it, and the language that needs fewest phrases wins. Texts are parsed as
UTF-8, so scripts of any number of characters have an alphabet of 256 at most and none is left out.
The automata are made total (a byte that cannot go on starts the next phrase), so
numpy steps many blocks of text through all of them at once. Texts are read whole, of any length, in blocks of
``BLOCK`` bytes, each of which starts a new phrase.

The automata are built on the driver from a bounded sample: ``budget`` bytes over all
languages (at least 2,000 each), the ``languages`` most frequent labels (so their automata are bounded too: about two
states a byte, 256 cells of four bytes each at most), at most ``per_document`` characters from one document, documents taken in
order of a hash of doc_id, as many as their mean length asks for. Case is folded, and what is no letter is one space;
bytes that no sample has end a phrase. A text that is null or has no letter is ``und`` with score
0; with no labelled rows (an empty table among others) every text is; ties go to the language that comes first in the alphabet;
repeated rows are judged each for itself; other columns are not read. A doc_id is null or of any type.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import ship, with_id
from wordloom.llm.toxicity import held_out

BLOCK = 1024
#: Blocks that are parsed side by side.
WIDTH = 4096
_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, and every path from it is a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
        last = cur
    return nxt


@dataclass
class Parser:
    """All automata in one table: cell [state * width + symbol] holds twice the next row's start, plus 1 if a phrase starts."""

    languages: list[str]
    symbols: np.ndarray  # by byte
    width: int
    roots: np.ndarray
    table: np.ndarray

    def codes(self, text: str) -> np.ndarray:
        return self.symbols[np.frombuffer(fold(text).encode("utf-8", "surrogatepass"), np.uint8)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language]: phrases of each text."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            for a in range(0, len(t), 1 << 20):
                c = self.codes(t[a : a + (1 << 20)])
                for b in range(0, len(c), BLOCK):
                    blocks.append(c[b : b + BLOCK])
                    owner.append(i)
                    if len(blocks) == WIDTH:
                        self._parse(blocks, owner, out)
                        blocks, owner = [], []
        if blocks:
            self._parse(blocks, owner, out)
        return out

    def _parse(self, blocks: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        codes = np.zeros((int(lengths.max()), len(blocks)), np.int32)
        for k, i in enumerate(order.tolist()):
            codes[: lengths[i], k] = blocks[i]
        live = len(blocks) - np.searchsorted(lengths[order][::-1], np.arange(len(codes)), side="right")
        state = np.repeat(self.roots[:, None], len(blocks), axis=1)
        ended = np.zeros(state.shape, np.int32)
        for t in range(len(codes)):
            n = live[t]
            cell = self.table.take(state[:, :n] + codes[t, :n])
            ended[:, :n] += cell & 1
            state[:, :n] = cell >> 1
        np.add.at(out, np.array(owner)[order], ended.T)


def build(samples: dict[str, bytes]) -> Parser:
    """The automata of folded samples in UTF-8."""
    languages = sorted(samples)
    kept = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
    symbols = np.zeros(256, np.int16)
    symbols[kept] = np.arange(1, len(kept) + 1)
    width, tables, roots, base = len(kept) + 1, [], [], 0
    if 2 * sum(map(len, samples.values())) * width >= 1 << 30:
        raise ValueError("the samples are too large for cells of 32 bits; lower the budget or the number of languages")
    for name in languages:
        text = symbols[np.frombuffer(samples[name], np.uint8)].tolist()
        nxt = suffix_automaton(text)
        start = np.full(width, 2 * base + 1, np.int64)
        for c, s in nxt[0].items():
            start[c] = 2 * (base + s * width) + 1
        start[0] = 2 * base + 1
        rows = np.tile(start, (len(nxt), 1))
        for s, edges in enumerate(nxt):
            for c, to in edges.items():
                if c and s:  # what leaves the root starts a phrase
                    rows[s, c] = 2 * (base + to * width)
        roots.append(base)
        base += len(nxt) * width
        tables.append(rows.reshape(-1).astype(np.int32))
    return Parser(languages, symbols, width, np.array(roots, np.int32), np.concatenate(tables) if tables else np.zeros(0, np.int32))


def fit(docs: DataFrame, budget: int = 120_000, per_document: int = 1500, languages: int = 60) -> Parser:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    used = F.least(F.char_length("text"), F.lit(per_document))
    labels = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(used).alias("mean")).orderBy(F.desc("n"), "lang").limit(languages).collect()  # `languages` rows at most
    if not labels:
        return build({})
    each = max(2000, budget // len(labels))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for name, n, mean in labels:  # twice as many as the mean length asks for
        want = 4 + 2 * each / max(mean, 1.0)
        chosen = chosen | ((F.col("lang") == name) & (rank < int(min(1.0, want / n) * (1 << 30))))
    rows = known.where(chosen).select("lang", rank.alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, per_document)).collect()  # about 2 * budget characters
    parts: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], len(r[2]), r[2], r[3])):
        if sum(map(len, parts[r[0]])) < each:
            parts[r[0]].append(fold(r[3]).encode("utf-8", "surrogatepass"))
    return build({k: b" ".join(v)[:each] for k, v in parts.items()})


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, lang_pred, score): the score is the winner's share of the inverse phrase counts to the eighth power."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(parser)

    def run(batches):
        parser = sent.value
        names = np.array([*parser.languages, "und"], object)
        for batch in batches:
            texts = [t if t and parser.languages and _LETTER.search(t) else "" for t in batch.column(1).to_pylist()]
            if parser.languages:
                phrases = parser.phrases(texts)
                best = phrases.argmin(1)
                ratio = (phrases.min(1, keepdims=True) / np.maximum(phrases, 1)) ** 8.0
                share = 1 / np.maximum(ratio.sum(1), 1)
            else:
                best, share = np.zeros(len(texts), int), np.zeros(len(texts))
            none = np.array([not t for t in texts], bool)
            best, share = np.where(none, len(names) - 1, best), np.where(none, 0.0, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, with_id(docs, "lang_pred string", "score double"))
