"""Toxicity by a factorization machine over hashed terms.

Terms are words (runs of letters and digits, lower case) and the first four and five bytes of longer words,
hashed into 2**20 buckets; a document has a bucket or has not. Besides a weight for each bucket the
machine learns a small vector, and the product of two vectors is the weight of the pair, so that an
insult together with the mention of a group can count for more than the two by themselves.

It is fitted on the driver on at most ``sample`` labelled rows (half of them toxic at most, chosen
by a hash of doc_id) and at most ``active`` buckets, those whose share differs most between the
labels. Scoring reads every document whole. Null and empty texts get the score of a document
without any term; labels that are null or of unknown documents are not read; without both labels in
the sample the score is the share of toxic rows (0 if there are none); repeated rows are scored
each for itself; texts may be of any length; an empty table gives no rows; other columns are passed on whatever their names. A doc_id may be of any type and null;
labels are matched to it as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import ALNUM, chunks, cut, mix, ship, spare

BUCKETS = 1 << 20
PREFIXES = (4, 5)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_buckets(texts: list[str | None]):
    """Yields (index, buckets of a part of that text) in order."""
    for idx, counts, w in chunks([(t or "").lower() for t in texts], ALNUM):
        own = (w.hashes % np.uint64(BUCKETS)).astype(np.int32)
        kinds = [own]
        for size in PREFIXES:
            head = mix(w.parts(w.starts, np.minimum(w.starts + size, w.ends)) + np.uint64(size))
            kinds.append(np.where(w.ends - w.starts > size, (head % np.uint64(BUCKETS)).astype(np.int32), own))
        upto = np.concatenate(([0], np.cumsum(counts)))
        for k, i in enumerate(idx):
            yield i, np.concatenate([x[upto[k] : upto[k + 1]] for x in kinds])


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))

    def table(self) -> np.ndarray:
        at = np.full(BUCKETS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at

    def margin(self, terms: np.ndarray) -> float:
        v = self.vectors[terms]
        return self.bias + self.weights[terms].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train_machine(rows: list[tuple[np.ndarray, int]], buckets: np.ndarray, factors: int = 8, epochs: int = 30, seed: int = 0) -> Machine:
    """Adagrad on the logistic loss; rows hold places in ``buckets`` and a label."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Machine(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    n = len(buckets)
    model = Machine(float(np.log(y.sum() / (1 - y).sum())), buckets, np.zeros(n), np.random.default_rng(seed).normal(0, 0.01, (n, factors)))
    rng, gw, gv, gb = np.random.default_rng(seed), np.full(n, 1e-6), np.full(model.vectors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), 512):
            take = order[a : a + 512]
            x = np.zeros((len(take), n), np.float32)
            for k, i in enumerate(take):
                x[k, rows[i][0]] = 1
            sums = x @ model.vectors
            out = model.bias + x @ model.weights + 0.5 * (sums**2 - x @ model.vectors**2).sum(1)
            err = (sigmoid(out) - y[take]) / len(take)
            dw = x.T @ err + 1e-5 * model.weights
            dv = x.T @ (err[:, None] * sums) - model.vectors * (x.T @ err)[:, None] + 1e-4 * model.vectors
            gw += dw**2
            gv += dv**2
            gb += err.sum() ** 2
            model.weights -= 0.2 * dw / np.sqrt(gw)
            model.vectors -= 0.02 * dv / np.sqrt(gv)
            model.bias -= 0.2 * err.sum() / gb**0.5
    return model


def telling_buckets(rows: DataFrame, active: int) -> np.ndarray:
    """Up to ``active`` buckets in which the labels of rows (label, terms) differ most: a z-square of 12 at least, three rows at least."""
    total = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    n1, n0 = (max(int(x), 1) for x in total)
    own = rows.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    p, c1, c0 = (F.col("c1") + F.col("c0")) / (n1 + n0), F.col("c1"), F.col("c0")
    z = F.pow(c1 / n1 - c0 / n0, 2) / F.greatest(p * (1 - p) * (1 / n1 + 1 / n0), F.lit(1e-12))
    best = own.where(c1 + c0 >= 3).select("bucket", z.alias("z")).where("z > 12").orderBy(F.desc("z"), "bucket").limit(active)
    return np.array([r[0] for r in best.collect()], np.int32)  # `active` rows at most


def fit(docs: DataFrame, labels: DataFrame, sample: int = 16_000, active: int = 4096) -> Machine:
    """Learns from at most ``sample`` rows, of which the driver sees the labels and the places of at most ``active`` buckets (2 bytes each)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = half[0].unionByName(half[1])

    def run(batches):
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for i, b in term_buckets(batch.column(0).to_pylist()):
                found[i].append(np.unique(b))
            terms = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["terms", "label", "doc_id"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id")  # `chosen` has at most `sample` rows
    own = cut(own.mapInArrow(run, "terms array<int>, label int, doc_id string"), "terms")
    buckets = telling_buckets(own, active)
    at = Machine(0.0, buckets).table()

    def places(batches):
        for batch in batches:
            flat = [at[np.array(t, np.int64)] for t in batch.column(0).to_pylist()]
            packed = [x[x >= 0].astype("<u2").tobytes() for x in flat]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], names=["terms", "label", "doc_id"])

    rows = own.mapInArrow(places, "terms binary, label int, doc_id string").collect()
    rows.sort(key=lambda r: (len(r[2]), r[2], r[0]))
    return train_machine([(np.frombuffer(r[0], "<u2"), r[1]) for r in rows], buckets)


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """The documents' columns and a last one, ``name``, of scores (0 to 1); one of that name in docs is replaced."""
    docs, spark = docs.drop(name), docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        model = sent.value
        table = model.table()
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for i, b in term_buckets(batch.column(at).to_pylist()):
                own = table[b]
                found[i].append(np.unique(own[own >= 0]))
            out = np.array([float(sigmoid(model.margin(np.unique(np.concatenate(x))))) if x else 0.0 for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Machine, limit: float = 0.7) -> DataFrame:
    """The documents that score less than the limit; columns as they were."""
    (name,) = spare(docs, "score")
    return score(docs, model, name).where(F.col(name) < limit).drop(name)
