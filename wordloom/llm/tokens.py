"""Ids of a public tokenizer for whole texts, by 64-bit hashes of their units.

The tokenizer never joins ids across white space, so a text's ids are those of its
space-separated words. In texts of Latin letters up to U+017F without apostrophes it also never
joins a letter with anything else, and lower case letter by letter is what it applies; there the
units are the runs of letters and of other characters, of which few differ. Each different unit
is encoded by the library once and kept, so most of a text is looked up.

Null texts are empty ones and have no ids but the closing one; equal texts have equal ids; texts of any length are cut before
white space and encoded in parts; an empty list of texts gives nothing.
"""

from __future__ import annotations

import os

import numpy as np

from wordloom.llm.common import CHUNK, SPACE, byte_classes, chunks, pieces

#: The id that ends each document.
END_ID = 1
#: Units kept by one Python worker before it starts anew.
KEEP_UNITS = 2_000_000

#: What a plain text may not hold: apostrophes, special tokens, separators that are no white space, and beyond ASCII what is no letter of one small form.
_NOT_PLAIN = ("'", "<", "\x1c", "\x1d", "\x1e", "\x1f", "×", "÷", "İ")
_LETTERS_C2 = ("ª", "µ", "º")
_LETTERS = byte_classes(SPACE.encode(), b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), rest=2)
_SPACED = byte_classes(SPACE.encode(), rest=1)
_open: dict[str, "Encoder"] = {}


class _Store:
    """Ids by the hash of a unit: an index, and one flat array."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.off = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, keys: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.off) - 1
        self.at.update(zip(keys, range(begin, begin + len(keys)), strict=True))
        self.off = np.concatenate((self.off, self.off[-1] + np.cumsum(lengths, dtype=np.int64)))
        self.flat = np.concatenate((self.flat, ids))


def is_plain(text: str) -> bool:
    if any(x in text for x in _NOT_PLAIN):
        return False
    if text.isascii():
        return True
    data = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8).max() <= 0xC5 and data.count(b"\xc2") == sum(map(text.count, _LETTERS_C2))


class Encoder:
    """``encode(texts)`` yields (index of text, ids of a part of it) in order; parts of a text follow each other."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stores = {True: _Store(), False: _Store()}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, store: _Store, keys: list[int], words: list[bytes], plain: bool) -> None:
        """Encodes new units; runs of letters together, since an id that closes a word shows where each ends."""
        for a in range(0, len(words), 4000):
            own = words[a : a + 4000]
            if plain:
                ids = np.array(self.tokenizer.encode(b" ".join(own).decode(), add_special_tokens=False).ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(own) and ends[-1] == len(ids):
                    store.add(keys[a : a + 4000], np.diff(ends, prepend=0), ids)
                    continue
            each = [x.ids for x in self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in own], add_special_tokens=False)]
            store.add(keys[a : a + 4000], np.array([len(x) for x in each]), np.array([i for x in each for i in x], np.uint32))

    def _units(self, w, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all units of a buffer, and the number of ids of each unit."""
        store = self.stores[plain]
        if len(store.at) > KEEP_UNITS:
            store = self.stores[plain] = _Store()
        keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        found = list(map(store.at.get, keys.tolist()))
        if None in found:
            new = [k for k, x in enumerate(found) if x is None]
            letters = _LETTERS[w.buf[w.starts[first[new]]]] == 1
            data = w.buf.tobytes()
            for own in (True, False):
                some = np.array(new)[letters == own]
                if len(some):
                    s, e = w.starts[first[some]].tolist(), w.ends[first[some]].tolist()
                    self._learn(store, keys[some].tolist(), [data[a:b] for a, b in zip(s, e, strict=True)], plain and own)
            found = list(map(store.at.get, keys.tolist()))
        at = np.array(found, np.int64)[inverse]
        begin, n = store.off[at], store.off[at + 1] - store.off[at]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        take = np.repeat(begin - (upto - n), n) + np.arange(total)
        return store.flat[take], n

    def encode(self, texts: list[str]):
        plain = [is_plain(t) for t in texts]
        at = 0
        while at < len(texts):  # runs of texts of one kind
            end = at + 1
            while end < len(texts) and plain[end] == plain[at]:
                end += 1
            own = [t.lower() for t in texts[at:end]] if plain[at] else texts[at:end]
            for idx, counts, w in chunks(own, _LETTERS if plain[at] else _SPACED):
                ids, n = self._units(w, plain[at])
                upto = np.concatenate(([0], np.cumsum(n)))
                word = np.concatenate(([0], np.cumsum(counts)))
                for k, i in enumerate(idx):
                    yield at + i, ids[upto[word[k]] : upto[word[k + 1]]]
            at = end


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def documents(path: str, texts: list[str | None]):
    """Yields (index, list of id arrays) for each text, the last array ending with END_ID."""
    end = np.array([END_ID], np.uint32)
    at, held = 0, []
    for i, ids in encoder(path).encode([t or "" for t in texts]):
        if i != at:
            yield at, [*held, end]
            at, held = i, []
        held.append(ids)
    if texts:
        yield at, [*held, end]


__all__ = ["CHUNK", "END_ID", "Encoder", "documents", "encoder", "pieces"]
