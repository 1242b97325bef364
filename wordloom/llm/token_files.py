"""Token files: frequency-ranked ids, byte-aligned and of variable length, with separate control bytes.

An id is replaced by its rank among all ids of the corpus (the most frequent has rank 0), so most
take one byte. Two bits of a control byte say how many bytes (1 to 4) each of four ranks takes; the
control bytes of a block stand together before its data bytes, so numpy decodes a block by looking
up 256 rows of lengths.

A table directory holds ``ranks.bin`` (little-endian uint32 ids in order of rank) and
``shard-NNNNNN.wlt`` files in ascending doc_id order (null first). A shard is ``WLTOKEN1`` and then
blocks: uint32 n_docs, n_ids, n_data; int64 doc_ids; uint8 flags (1: null doc_id, 2: goes on from
the block before); uint32 counts of ids; control bytes; data bytes. Files are written under another
name and renamed, so a repeated task replaces its own file as a whole.

Nulls and empty texts give the closing id alone; rows that share a doc_id stay rows of their own,
one after the other; very long texts run over several blocks; an empty table gives no shards with
documents; other columns are not read. A doc_id is a whole number or null; any other type is an error.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import cut, drop_path, partitions, shared_path, ship

MAGIC = b"WLTOKEN1"
#: Ids of a block, about.
BLOCK = 1 << 18
_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    r = ranks.astype("<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    four = np.zeros((-(-len(r) // 4), 4), np.uint8)
    four.reshape(-1)[: len(r)] = code
    control = (four << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _fs(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of that store
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _block(docs: list[tuple[int | None, bool, np.ndarray]], rank: np.ndarray) -> bytes:
    ids = np.concatenate([d[2] for d in docs])
    control, data = encode_ranks(rank[ids])
    head = struct.pack("<III", len(docs), len(ids), len(data))
    names = np.array([d[0] or 0 for d in docs], "<i8").tobytes()
    flags = np.array([(d[0] is None) + 2 * d[1] for d in docs], np.uint8).tobytes()
    return head + names + flags + np.array([len(d[2]) for d in docs], "<u4").tobytes() + control + data


def _tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Parts of documents as ids, and each task's counts of ids."""

    def run(batches):
        from wordloom.llm.tokens import documents, encoder

        size = encoder(tokenizer).tokenizer.get_vocab_size(True)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        count, n, task = np.zeros(size, np.int64), 0, TaskContext.get().partitionId() << 40
        names = ["doc_id", "uid", "part", "ids", "tokens", "counts"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)
        for batch in batches:
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for i, parts in documents(tokenizer, batch.column(1).to_pylist()):
                flat = np.concatenate(parts)
                count += np.bincount(flat, minlength=size)
                for part, a in enumerate(range(0, len(flat), BLOCK)):
                    rows.append((ids[i], task + n, part, flat[a : a + BLOCK].astype(kind).tobytes(), None, None))
                    held += len(rows[-1][3])
                n += 1
                if held > 1 << 23:
                    yield pack(rows)
                    rows, held = [], 0
            yield pack(rows)
        seen = np.flatnonzero(count)
        yield pack([(None, -1, -1, None, seen.tolist(), count[seen].tolist())])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, uid long, part int, ids binary, tokens array<int>, counts array<long>")


def write(docs: DataFrame, tokenizer: str, path: str) -> list[tuple[int, str, int, int, int]]:
    """Writes the table; returns (shard, file, documents, ids, bytes) of each shard in order."""
    if docs.schema["doc_id"].dataType not in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        raise TypeError("token files hold whole numbers as doc_id")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    stage = shared_path(spark, "ids")
    _tokenized(docs, tokenizer).write.option("compression", "zstd").parquet(stage)
    made = spark.read.schema("doc_id long, uid long, part int, ids binary, tokens array<int>, counts array<long>").parquet(stage)
    counts = made.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("n"))
    order = [r[0] for r in sorted(counts.collect(), key=lambda r: (-r[1], r[0]))]  # at most the vocabulary
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size(True)
    order += sorted(set(range(size)) - set(order))
    by_rank = np.array(order, "<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    where, base = _fs(path)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/ranks.bin") as f:
        f.write(by_rank.tobytes())
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        task = TaskContext.get()
        name = f"{path}/shard-{task.partitionId():06d}.wlt"
        out, to = _fs(name)
        draft, n_docs, n_ids, size_out = f"{to}.{task.taskAttemptId()}", 0, 0, len(MAGIC)
        with out.open_output_stream(draft) as f:
            f.write(MAGIC)
            held: list = []
            n_held = 0
            for batch in batches:
                for doc, part, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    held.append((doc, part > 0, np.frombuffer(ids, kind)))
                    n_docs, n_ids, n_held = n_docs + (part == 0), n_ids + len(held[-1][2]), n_held + len(held[-1][2])
                    if n_held >= BLOCK:
                        size_out += f.write(_block(held, rank))
                        held, n_held = [], 0
            if held:
                size_out += f.write(_block(held, rank))
        out.move(draft, to)
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": name, "docs": n_docs, "ids": n_ids, "bytes": size_out}])

    ordered = made.where("ids is not null").select("doc_id", "uid", "part", "ids").repartitionByRange(partitions(spark), "doc_id", "uid").sortWithinPartitions("doc_id", "uid", "part")
    shards = cut(ordered.mapInArrow(run, "shard long, file string, docs long, ids long, bytes long")).collect()  # one row a shard
    drop_path(spark, stage)
    return sorted(map(tuple, shards))


def _blocks(file: str):
    """Yields (doc_ids, flags, counts, ranks) of each block; one block in memory at a time."""
    where, name = _fs(file)
    with where.open_input_stream(name) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{file} is no token file")
        while head := f.read(12):
            n_docs, n_ids, n_data = struct.unpack("<III", head)
            names = np.frombuffer(f.read(8 * n_docs), "<i8")
            flags = np.frombuffer(f.read(n_docs), np.uint8)
            counts = np.frombuffer(f.read(4 * n_docs), "<u4")
            control = f.read(-(-n_ids // 4))
            yield names, flags, counts, decode_ranks(control, f.read(n_data), n_ids)


def read(spark: SparkSession, path: str, shards: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    first, todo = 0, []
    for _, file, _, n, _ in shards:
        todo.append((file, first))
        first += n

    def run(batches):
        cached: dict[str, np.ndarray] = {}
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path not in cached:
                    where, base = _fs(path)
                    with where.open_input_stream(f"{base}/ranks.bin") as f:
                        cached[path] = np.frombuffer(f.read(), "<u4")
                rows: list[list] = []
                for names, flags, counts, ranks in _blocks(file):
                    ids, upto = cached[path][ranks].astype("<u4"), 0
                    for name, flag, n in zip(names.tolist(), flags.tolist(), counts.tolist(), strict=True):
                        part = ids[upto : upto + n].tobytes()
                        upto += n
                        if flag & 2:
                            rows[-1][2:] = [rows[-1][2] + n, zlib.crc32(part, rows[-1][3])]
                        else:
                            rows.append([None if flag & 1 else name, at, n, zlib.crc32(part)])
                        at += n
                    if len(rows) > 10_000:
                        yield _rows(rows[:-1])
                        rows = rows[-1:]
                yield _rows(rows)

    ship(spark)
    table = spark.createDataFrame(todo, "file string, first long").repartition(max(1, len(todo)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes token files and returns what they hold of each document."""
    path = path or shared_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, path, write(docs, tokenizer, path))
