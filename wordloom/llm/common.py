"""Shared tools: shared-folder tables, packaging, names and types of ids, vectorised word hashes.

Null texts are hashed as empty ones; empty tables are written and read again like others; a text of
any length is hashed in buffers of ``CHUNK`` bytes.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wordloom.tables import sound_unions

#: The white space that separates words: ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that the vectorised functions take at a time.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other an error, for the
    executors of a cluster cannot see a folder of the driver's.
    """
    sc = spark.sparkContext
    sound_unions(spark)
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wordloom-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, under this application's own, which goes when the driver ends."""
    own = f"{shared_dir(spark).rstrip('/')}/wordloom-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


_folders: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, what: str = "rows") -> DataFrame:
    """The rows written once to the shared folder as a table; what follows starts from those files."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each lengthened until no column of docs has it in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def with_id(docs: DataFrame, *fields: str) -> T.StructType:
    """``doc_id`` of the type it has in docs (any type that can be ordered), then the fields ("name type")."""
    rest = T.StructType.fromDDL(", ".join(fields))
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *rest.fields])


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless their Python path has it already."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    path = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if getattr(sc, "_wordloom_shipped", False) or str(root) in map(os.path.abspath, filter(None, path)):
        return
    out = Path(tempfile.mkdtemp(prefix="wordloom-zip-")) / "wordloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "wordloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._wordloom_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- vectorised hashing of words -------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW, _INV = out
    return _POW, _INV


def byte_classes(*groups: bytes, rest: int = 0) -> np.ndarray:
    """A class for each byte: 0 separates words; a change of class does too."""
    table = np.full(256, rest, np.uint8)
    for k, g in enumerate(groups):
        table[list(g)] = k
    return table


#: Words are runs of anything but white space.
BY_SPACE = byte_classes(SPACE.encode(), rest=1)
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
ALNUM = byte_classes(b"", (LOWER + UPPER + "0123456789").encode() + bytes(range(128, 256)), rest=0)


class Words:
    """The words of one buffer: byte ranges, 64-bit hashes, and the buffer's sums for hashes of parts."""

    def __init__(self, data: bytes, classes: np.ndarray) -> None:
        self.buf = buf = np.frombuffer(data, np.uint8)
        n = len(buf)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        c = classes[buf]
        starts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        ends = np.concatenate((starts[1:], [n]))
        keep = c[starts] != 0
        self.starts, self.ends = starts[keep], ends[keep]
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:n], out=self.sums[1:])
        self.hashes = self.parts(self.starts, self.ends)

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def pieces(text: str, most: int = CHUNK) -> list[str]:
    """The text cut before white space into parts of about ``most`` characters; words stay whole."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end] not in " \n\t":
            end += 1
        out.append(text[at:end])
        at = end
    return out


def chunks(texts: list[str], classes: np.ndarray):
    """Yields (indices of texts, word counts, Words) over buffers of about CHUNK bytes.

    A long text comes as several parts, each in one buffer; parts of a text come in order.
    """
    idx: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush():
        ends = np.cumsum([len(p) + 1 for p in parts])
        w = Words(b"\n".join(parts), classes)
        upto = np.searchsorted(w.starts, ends)
        return idx, np.diff(upto, prepend=0), w

    for i, t in enumerate(texts):
        for part in pieces(t):
            b = part.encode("utf-8", "surrogatepass")
            idx.append(i)
            parts.append(b)
            size += len(b) + 1
            if size >= CHUNK:
                yield flush()
                idx, parts, size = [], [], 0
    if parts:
        yield flush()


def word_hashes(texts: list[str], classes: np.ndarray = BY_SPACE):
    """Yields (index of text, hashes of its words), one for each text in order."""
    held: list[np.ndarray] = []
    at = None
    for idx, counts, w in chunks(texts, classes):
        begin = 0
        for i, n in zip(idx, counts.tolist(), strict=True):
            h = w.hashes[begin : begin + n]
            begin += n
            if at is not None and i != at:
                yield at, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            at = i
            held.append(h)
    if at is not None:
        yield at, held[0] if len(held) == 1 else np.concatenate(held)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; fewer words than n make one window of them all, none make none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15 | 1) + h[k : len(h) - n + 1 + k]
    return mix(out + np.uint64(n))
