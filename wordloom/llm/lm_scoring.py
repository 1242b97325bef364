"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Words are runs of anything but ``[\\x20\\x09-\\x0D]`` in the lower-cased text. With c(.) the counts
over all documents and N all words, a word w after a context of ``order - 1`` words scores
c(context w) / c(context) if c(context w) >= ``min_count``, else ``BACKOFF`` times its score after the
context without its first word; without context it scores c(w) / N. Words near the start of a document
begin with the shorter context they have. A document's score is the sum of the natural logarithms, kept
as whole billionths so that the order of summing cannot show.

The n-grams of all levels (2 to ``order``) are exploded into rows of document, context and word and dealt
by the hash of the n-gram, where a window joins each row with the count of its n-gram: one shuffle of
rows, and the sorts and windows spill. Contexts of two words or more are dealt by the context and
counted in the same way; contexts of one word and words that no level settles are joined with the table
of word counts. A level counts its n-grams within the longer ones too, and so knows which words a
higher level has settled. Rows are summed by document.

Words with a share of 1/WORDS of the corpus or more (WORDS at most) are sent to the tasks with their
counts: rows name them by rank, and a document's score starts with what they are worth without context.
So are frequent longer n-grams (KNOWN of each length at most, all with a share of 1/HOT among them),
counted by partial sums and settled where they stand; after such a context rows are dealt by the n-gram.
So no key has more than 1/HOT of the rows. Other words are named by 63 bits of hash.

Null and empty texts have no words and score 0 with null mean; repeated rows are scored each for
itself and count each; texts may be of any length; an empty table gives no rows; other columns are not
read. A doc_id may be of any type and null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import BY_SPACE, chunks, cut, mix, ship

BACKOFF = 0.4
UNIT = 1e9
#: Words with a larger share of all words than 1/WORDS are known to every task; longer n-grams from a share of 1/HOT.
WORDS, HOT = 1 << 23, 1024
#: Longer n-grams that tasks know at most, and words among which they are looked for.
KNOWN, TOGETHER = 1 << 19, 1 << 22
#: Rows that leave the explosion together.
ROWS = 1 << 17
_A, _SIGN, _RANKS = np.uint64(0x9E3779B97F4A7C15), np.int64(-(1 << 63)), 23


def logs(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * UNIT).astype(np.int64)


def _buffers(texts: list[str | None], order: int):
    """Yields (text of each word, its place there, hashes, whether it is new, texts that have ended) for each buffer.

    Where a long text goes on from the buffer before, its last words stand in front once more, not new.
    """
    at, count, tail = None, 0, np.zeros(0, np.uint64)
    for idx, counts, w in chunks([(t or "").lower() for t in texts], BY_SPACE):
        goes_on = idx[0] == at
        ended = [] if goes_on or at is None else [(at, count, tail)]
        before = len(tail) if goes_on else 0
        owner = np.repeat(np.array(idx), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        if goes_on:
            place[: counts[0]] += count
            owner = np.concatenate((np.full(before, at), owner))
            place = np.concatenate((np.arange(count - before, count), place))
        h = np.concatenate((tail[len(tail) - before :], w.hashes))
        upto = np.cumsum(counts) + before
        ends = [(idx[k], int(n), h[max(0, e - min(int(n), order)) : e]) for k, (n, e) in enumerate(zip(counts.tolist(), upto.tolist(), strict=True))]
        if goes_on:
            n = count + int(counts[0])
            ends[0] = (at, n, h[: upto[0]][-min(n, order) :] if n else tail)
        at, count, tail = ends[-1]
        yield owner, place, h, np.arange(len(h)) >= before, ended + ends[:-1]
    if at is not None:
        none = np.zeros(0, np.int64)
        yield none, none, np.zeros(0, np.uint64), none.astype(bool), [(at, count, tail)]


def _grams(h: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n of 1 to most; those that begin before the array are not valid."""
    out = [h]
    for _ in range(most - 1):
        last = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))[: len(h)]
        out.append(mix(last * _A + h))
    return out


class Hot:
    """Frequent n-grams of one length: sorted hashes, counts, and ranks by count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = np.append(keys[order], np.uint64(2**64 - 1)), np.append(counts[order], 0)
        self.ranks = np.empty(len(order) + 1, np.int64)
        self.ranks[np.lexsort((self.keys, -self.counts))] = np.arange(len(order) + 1)
        self.starts = None  # of each bucket of leading bits; made where it is used, so it is not sent

    def _at(self, h: np.ndarray) -> np.ndarray:
        """The first place whose key is not below h: buckets are short, since hashes are spread evenly."""
        if self.starts is None:
            bits = min(20, len(self.keys).bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            self.starts = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        at = self.starts[h >> self.shift]
        below = np.flatnonzero(self.keys[at] < h)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < h[below]]
        return at

    def counted(self, h: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Counts of h, 0 for those that are not frequent."""
        at = self._at(h) if at is None else at
        return np.where(self.keys[at] == h, self.counts[at], 0)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, codes) of h: 0 and the hash with its sign bit set for those that are not frequent, else the rank as code."""
        at = self._at(h)
        n = self.counted(h, at)
        return n, np.where(n > 0, self.ranks[at], h.view(np.int64) | _SIGN)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of word hashes over all documents, summed in each TOGETHER words before the shuffle."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, h, new, _ in _buffers(batch.column(0).to_pylist(), 1):
                held.append(h[new])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame, total: int, share: int) -> Hot:
    own = counts.where(F.col("n") * share >= max(total, 1)).toPandas()  # `share` rows at most, since the n add up to no more than total
    return Hot(own.iloc[:, 0].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64))


def _hot_grams(docs: DataFrame, shorter: list[Hot], total: int) -> Hot:
    """Frequent n-grams one word longer than the last of ``shorter``, with exact counts.

    Those with a share of 1/HOT in some TOGETHER words, which is all that have it in the corpus, and
    those that stand there 4 times are named first; the KNOWN most frequent of them are then counted.
    """
    spark, length = docs.sparkSession, len(shorter) + 1
    sent = spark.sparkContext.broadcast(shorter)

    def counted(among: Hot | None) -> DataFrame:
        def run(batches):
            shorter, held, size = sent.value, [], 0

            def flush():
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                ok = (n >= 4) | (n * HOT >= size) if among is None else among.counted(keys) > 0
                return pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(n[ok].astype(np.int64))], names=["gram", "n"])

            for batch in batches:
                for _, place, h, new, _ in _buffers(batch.column(0).to_pylist(), length):
                    grams = _grams(h, length)
                    known = shorter[0].counted(h) > 0
                    at = np.flatnonzero(new & (place >= length - 1) & known)
                    before = known[at - 1] if length == 2 else shorter[-1].counted(grams[-2][at - 1]) > 0
                    held.append(grams[-1][at[before]])
                    size += int(new.sum())
                    if size >= TOGETHER:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))

    named = _hot(counted(None).orderBy(F.desc("n"), "gram").limit(KNOWN), 1, 1)
    return _hot(counted(named), 1, 1)  # KNOWN rows at most


def _columns(order: int) -> list[str]:
    """What rows of an order above 2 have besides."""
    return ["x", "n_g", *(f"l{k}" for k in range(3, order + 1))] if order > 2 else []


def _exploded(docs: DataFrame, order: int, hot: list[Hot], total: int, min_count: int) -> DataFrame:
    """Rows (level, back, uid, g, w, ...) of n-grams, and one (uid, doc_id, n_words, score) for each document.

    ``g`` is the code of the context and ``w`` that of the word, or both are in g where both are frequent; w is
    null also where a text ends on a context (which counts) and, on level 1, where g is a word no level
    settles. ``back`` is the number of levels above; of an order above 2 there are also the contexts of
    those levels (l3 and so on), the count ``n_g`` where it is known, and what such a row is dealt by (x).
    score is what is settled already, with what other words would score without context if they are frequent.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    more = _columns(order)
    names = ["level", "back", "uid", "g", "w", *more, "doc_id", "n_words", "score"]
    kinds = {"level": pa.int8(), "back": pa.int8()}
    schema = T.StructType.fromDDL("level tinyint, back tinyint, uid long, g long, w long" + "".join(f", {x} long" for x in more))
    schema = T.StructType([*schema.fields, T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("n_words long, score long").fields])

    def run(batches):
        hot = sent.value
        log_total, log_back = int(logs(np.array([max(total, 1)]))[0]), int(logs(np.array([BACKOFF]))[0])
        uid, parts, size = TaskContext.get().partitionId() << 33, [], 0

        def put(n: int, **columns):
            nonlocal size
            if n:
                parts.append((n, columns))
                size += n

        def flush():
            nonlocal parts, size
            out = []
            for name in names[:-3]:
                own = [c.get(name) for _, c in parts]
                own = [pa.array(x, kinds.get(name, pa.int64())) if x is not None else pa.nulls(n, kinds.get(name, pa.int64())) for x, (n, _) in zip(own, parts)]
                out.append(pa.concat_arrays(own))
            parts, size, n = [], 0, len(out[0])
            return pa.RecordBatch.from_arrays([*out, pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

        for batch in batches:
            texts, id_type = batch.column(1).to_pylist(), batch.column(0).type
            n_words, score = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owner, place, h, new, ended in _buffers(texts, order):
                grams = _grams(h, order)
                known, codes = zip(*(x.find(g) for x, g in zip(hot, grams, strict=True)))
                worth = np.where(known[0] > 0, logs(np.maximum(known[0], 1)) - log_total, 0)
                add = lambda at, x: np.add.at(score, owner[at], x)
                np.add.at(n_words, owner[new], 1)

                def alone(at, back):
                    """Words that no level settles, after ``back`` steps."""
                    easy = known[0][at] > 0
                    add(at[easy], worth[at[easy]] + back[easy] * log_back)
                    at, back = at[~easy], back[~easy]
                    put(len(at), uid=uid + owner[at], level=np.ones(len(at), np.int8), g=codes[0][at], back=back.astype(np.int8))

                first = np.flatnonzero(new & (place == 0))
                alone(first, np.zeros(len(first), np.int64))
                goes = np.zeros(len(h), bool)
                for k in range(2, order + 1):
                    at = np.flatnonzero(new & (place >= k - 1))
                    back = np.minimum(place[at] + 1, order) - k
                    n_c, n_g, c = known[k - 2][at - 1], known[k - 1][at], codes[k - 2][at - 1]
                    above = np.where(back > 0, known[k][at], 0) if k < order else np.zeros(len(at), np.int64)
                    settled = (n_g > 0) & (n_c > 0) & ((above > 0) | (back == 0))  # all that counts is known
                    here = settled & (above < min_count) & (n_g >= min_count)
                    add(at[here], logs(np.maximum(n_g[here], 1)) - logs(np.maximum(n_c[here], 1)) + back[here] * log_back)
                    if k == 2:
                        lost = settled & (above < min_count) & (n_g < min_count)
                        alone(at[lost], back[lost] + 1)
                    go = ~settled
                    at, back, n_c, n_g, c = at[go], back[go], n_c[go], n_g[go], c[go]
                    goes[at] = True
                    c, w = np.where(n_c > 0, (k - 2 << _RANKS) + c, c), codes[0][at]
                    both = (c >= 0) & (w >= 0)
                    rest = {}
                    if order > 2:
                        longer = grams[k][at].view(np.int64) if k < order else w
                        rest = {"x": pa.array(longer, mask=(n_g == 0) | (back == 0)), "n_g": pa.array(n_g, mask=n_g == 0)}
                        rest |= {f"l{j}": pa.array(grams[j - 2][at - 1].view(np.int64), mask=place[at] < j - 1) for j in range(k + 1, order + 1)}
                    put(len(at), uid=uid + owner[at], level=np.full(len(at), k, np.int8), back=back.astype(np.int8), g=np.where(both, (c << _RANKS) + w, c), w=pa.array(w, mask=both), **rest)
                at = np.flatnonzero(goes)
                add(at, np.where(known[0][at] > 0, worth[at] + (np.minimum(place[at] + 1, order) - 1) * log_back, 0))
                for i, n, tail in ended if order > 2 else ():  # the end of a text counts for its last contexts
                    last = _grams(tail, order)
                    for k in range(3, order + 1):
                        if n >= k - 1 and (code := hot[k - 2].find(last[k - 2][-1:])[1])[0] < 0:
                            put(1, uid=np.array([uid + i]), level=np.array([k], np.int8), g=code)
                if size >= ROWS:
                    yield flush()
            if size:
                yield flush()
            own = pa.array(uid + np.arange(len(texts)))
            none = [pa.nulls(len(texts), kinds.get(x, pa.int64())) for x in names[:2]], [pa.nulls(len(texts), pa.int64()) for _ in more]
            yield pa.RecordBatch.from_arrays([*none[0], own, own, own, *none[1], batch.column(0), pa.array(n_words), pa.array(score)], names=names)
            uid += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _counts_of(spark, hot: list[Hot]) -> DataFrame:
    """(code, known) of the frequent words, and of the frequent contexts of several words."""
    rows = [(x.ranks[:-1] + (k << _RANKS), x.counts[:-1]) for k, x in enumerate(hot)]
    return spark.createDataFrame(pa.table({"code": np.concatenate([r[0] for r in rows]), "known": np.concatenate([r[1] for r in rows])}))


def scores(docs: DataFrame, order: int = 2, min_count: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of each document; order is 2 or more."""
    spark = docs.sparkSession
    words = cut(word_counts(docs), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [_hot(words, total, WORDS)]
    for _ in range(order - 1):
        hot.append(_hot_grams(docs, hot, total))

    rows, more = _exploded(docs, order, hot, total, min_count), _columns(order)
    g, w, level = F.col("g"), F.col("w"), F.col("level")
    above, n_c = F.lit(True), F.lit(None).cast("long")
    if more:
        by_context = (level > 2) & (g < 0)
        rows = rows.withColumn("x", F.coalesce("x", F.when(by_context, g).otherwise(F.xxhash64(g, w)))).repartition("x")
        over = lambda *c: F.count(F.lit(1)).over(W.partitionBy("x", "level", "g", *c))
        for k in more[2:]:
            rows = rows.withColumn(f"n_{k}", F.when(F.col(k).isNotNull(), over("w", k)))
            above &= F.coalesce(F.col(f"n_{k}") < min_count, F.lit(True))
        rows, n_c = rows.withColumn("n_g", F.coalesce("n_g", over("w"))).withColumn("n_c", F.when(by_context, over())), F.col("n_c")
    else:
        rows = rows.repartition("g", "w").withColumn("n_g", F.count(F.lit(1)).over(W.partitionBy("g", "w")))
    both = (g >= 0) & w.isNull()
    rows = rows.withColumn("c_code", F.when(both, F.shiftright(g, _RANKS)).otherwise(g)).withColumn("w_code", F.when(both, g.bitwiseAND((1 << _RANKS) - 1)).otherwise(w))
    codes = F.broadcast(cut(_counts_of(spark, hot[:-1])))  # WORDS rows and HOT for each longer length at most
    for name in ("c", "w"):
        rows = rows.join(codes.select(F.col("code").alias(f"{name}_code"), F.col("known").alias(f"known_{name}")), f"{name}_code", "left")

    log = lambda c: F.rint(F.log(c) * UNIT).cast("long")
    log_total, log_back = int(logs(np.array([max(total, 1)]))[0]), int(logs(np.array([BACKOFF]))[0])
    back, n_c = F.col("back").cast("long"), F.coalesce("known_c", n_c)
    steps = back + F.greatest(level - 1, F.lit(0)).cast("long")  # from the word's highest level to none
    live, ok = (level > 1) & F.col("w_code").isNotNull() & above, F.col("n_g") >= min_count
    credit = F.when(F.col("w_code") >= 0, log(F.col("known_w")) - log_total + steps * log_back).otherwise(F.lit(0))
    unsettled = live & ~ok & (level == 2) & (F.col("w_code") < 0)
    part = (
        F.when(live & ok, log(F.col("n_g")) - F.coalesce(log(n_c), F.lit(0)) + back * log_back - credit)
        .when(unsettled | (level == 1), steps * log_back - log_total)
        .otherwise(F.coalesce("score", F.lit(0)))
    )
    asks = F.when(unsettled, w).when(level == 1, g).when(live & ok & n_c.isNull(), g)  # words whose count is added, or taken off
    asks = F.when(live & ok, asks.bitwiseAND(~int(_SIGN))).otherwise(asks)  # a code without its sign bit is taken off
    own = rows.select("uid", "doc_id", "n_words", part.alias("part"), asks.alias("word")).where("part <> 0 or word is not null or n_words is not null")
    own = own.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("part").alias("part"), F.sort_array(F.collect_list("word")).alias("words"))
    own = cut(own, "parts")  # a row for each document, with words of its own
    rare = words.where((F.col("n") * WORDS < max(total, 1)) & (F.col("n") > 1)).select(F.col("word").bitwiseOR(int(_SIGN)).alias("code"), "n")  # the logarithm of 1 adds nothing
    asked = own.select("uid", F.explode("words").alias("word")).withColumn("code", F.col("word").bitwiseOR(int(_SIGN))).join(rare, "code")
    asked = asked.groupBy("uid").agg(F.sum(F.when(F.col("word") < 0, 1).otherwise(-1) * log(F.col("n"))).alias("more"))
    out = own.drop("words").join(asked, "uid", "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0)))
    score = F.round(F.col("score") / UNIT, 4)
    return out.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / UNIT / F.col("n_words"), 4)).alias("mean_log_score"))


def scores_by_joins(docs: DataFrame, order: int = 2, min_count: int = 2) -> DataFrame:
    """The same scores from plain joins of exploded words with a table of counts for each level; what tests compare with."""
    numbered = cut(docs.select("doc_id", F.filter(F.split(F.lower("text"), "[ \t\n\x0b\x0c\r]+"), lambda x: x != "").alias("words")).withColumn("uid", F.monotonically_increasing_id()))
    rows = numbered.select("uid", F.posexplode("words").alias("at", "v1"))
    by = W.partitionBy("uid").orderBy("at")
    for k in range(2, order + 1):
        rows = rows.withColumn(f"v{k}", F.lag("v1", k - 1).over(by))
    total = max(1, rows.count())
    log = lambda c: F.rint(F.log(c) * UNIT).cast("long")
    step = int(np.rint(np.log(BACKOFF) * UNIT))
    counted = {k: rows.where(f"v{k} is not null").groupBy(*(f"v{j}" for j in range(1, k + 1))).agg(F.count(F.lit(1)).alias(f"n{k}")) for k in range(1, order + 1)}
    for k in range(1, order + 1):
        names = [f"v{j}" for j in range(1, k + 1)]
        rows = rows.join(counted[k], names, "left")
        if k > 1:  # the context: the same table, its words one place further back
            context = counted[k - 1].select(*(F.col(f"v{j}").alias(f"v{j + 1}") for j in range(1, k)), F.col(f"n{k - 1}").alias(f"c{k}"))
            rows = rows.join(context, [f"v{j + 1}" for j in range(1, k)], "left")
    score = log(F.col("n1")) - int(np.rint(np.log(total) * UNIT))
    for k in range(2, order + 1):
        score = F.when(F.col(f"v{k}").isNull(), score).when(F.col(f"n{k}") >= min_count, log(F.col(f"n{k}")) - log(F.col(f"c{k}"))).otherwise(score + step)
    sums = rows.groupBy("uid").agg(F.sum(score).alias("score"))
    out = numbered.join(sums, "uid", "left").select("doc_id", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), F.coalesce("score", F.lit(0)).alias("score"))
    return out.select("doc_id", "n_words", F.round(F.col("score") / UNIT, 4).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / UNIT / F.col("n_words"), 4)).alias("mean_log_score"))
