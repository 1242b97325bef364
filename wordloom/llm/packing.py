"""Packing of documents into token windows by best-fit decreasing.

Each document's ids (with the closing id) are cut into full windows and one rest. Pieces are dealt
by row number into groups of about ``GROUP`` pieces, so that a group is bounded however large the
input or however often one document repeats, and each group is packed longest piece first: a
segment tree indexed by remaining capacity finds the open window that the piece fills most tightly.
Only spans travel; ids stay where they were made.

Nulls and empty texts give one piece with the closing id alone; texts of any length are cut into full windows; pieces of
equal length are taken in order of their rows, and of windows with equal room the last opened; repeated rows are packed each for
itself; an empty table gives no rows; other columns are not read. A doc_id may be of any type and null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import cut, ship, with_id

#: Pieces that are packed together.
GROUP = 1 << 16

_PIECES = ("start long", "length long", "ids_crc32 long", "doc_tokens long")


class CapacityTree:
    """Open windows by remaining capacity; ``tightest`` finds the least capacity that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.windows[capacity].pop()

    def tightest(self, need: int) -> int | None:
        node, count = self.leaves + need, self.count
        if count[node]:
            return need
        while True:  # up until something to the right is open
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if count[node]:
                break
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.leaves


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = tree.tightest(n) if n < capacity else None
        if room is None:
            at, room, opened = opened, capacity, opened + 1
        else:
            at = tree.take(room)
        window[i], offset[i] = at, capacity - room
        tree.put(room - n, at)
    return window, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """The full windows and the rest of each document, with the checksum of their ids."""

    def run(batches):
        from wordloom.llm.tokens import documents

        for batch in batches:
            rows: list[tuple] = []
            for i, parts in documents(tokenizer, batch.column(1).to_pylist()):
                own, start, held = [], 0, np.zeros(0, np.uint32)
                for k, part in enumerate(parts):
                    held = np.concatenate((held, part))
                    last = k == len(parts) - 1
                    full = len(held) // capacity * capacity
                    for a in range(0, len(held) if last else full, capacity):
                        piece = held[a : a + capacity]
                        own.append((start + a, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
                    start, held = start + full, held[full:]
                total = own[-1][0] + own[-1][1]
                rows += [(i, *x, total) for x in own]
            at, *rest = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, with_id(docs, *_PIECES))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """A row for each piece: its span in the document, its window (sequence_id, from 0) and its place there."""
    made = cut(token_pieces(docs, tokenizer, capacity).withColumn("piece", F.monotonically_increasing_id()))
    groups = max(1, -(-made.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", ignore_index=True)
        window, offset = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(window=window, offset=offset)

    dealt = made.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = cut(dealt.groupBy("group").applyInPandas(run, with_id(docs, *_PIECES, "piece long", "group long", "window long", "offset long")))
    first = packed.groupBy("group").agg((F.max("window") + 1).alias("n"))
    first = first.select("group", (F.sum("n").over(W.orderBy("group")) - F.col("n")).alias("first"))
    out = packed.join(first, "group")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("window")).alias("sequence_id"), "offset")


__all__ = ["CapacityTree", "best_fit", "pack", "token_pieces"]
