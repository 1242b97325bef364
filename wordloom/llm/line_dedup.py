"""Line dedup: lines that several documents share stay in the last of them only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at
least ``min_chars`` characters found in at least ``min_docs`` documents lose all their lines except
in the document with the largest doc_id that holds them. Keys are 128 bits of hash.

Hashes are partitioned by ranges of equal width (they are uniform), sorted inside by hash, document
descending and position; the first document of each run is the one that keeps its lines. Only
(hash, doc_id, position) travel, and what comes back for a document is a compressed keep bitmap: the
numbers of kept lines before each dropped one. Keys that hold more than 1/1024 of all entries (fewer
than 1,024 keys, by that definition) are taken out by partial sums before the shuffle, and their few
verdicts are sent to the lines instead.

All of it is DataFrame expressions. Null and empty texts are one empty line, and null texts come back
empty from ``kept_text``; a null doc_id is below every other; rows that share a doc_id count as
documents of their own and are decided alike; an empty table gives no rows; other columns stay as they
are, whatever their names. A doc_id is of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import LOWER, SPACE, UPPER, cut, partitions, spare

#: Keys with a larger share of all entries are decided before the shuffle.
HOT_SHARE = 1024


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does that fast where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of each line with a long enough key."""
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    own = own.withColumn("key", F.btrim("line", F.lit(SPACE))).where(F.char_length("key") >= min_chars)
    own = own.withColumn("key", ascii_lower(F.col("key")))
    return own.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _hot_keys(entries: DataFrame) -> DataFrame:
    """(h1, h2, hot_docs, hot_last) of keys that hold a large share of all entries.

    A frequent-items sketch names them (it never misses such a share); their counts are exact.
    """
    total = entries.count()
    named = entries.agg(F.expr(f"approx_top_k(h1, {4 * HOT_SHARE}, {64 * HOT_SHARE})").alias("x")).select(F.explode("x").alias("x"))
    named = named.where(F.col("x.count") * HOT_SHARE >= total).select(F.col("x.item").alias("h1"))
    own = entries.join(F.broadcast(named), "h1")  # at most 4 * HOT_SHARE rows
    own = own.groupBy("h1", "h2", "doc_id", "th").agg(F.first("pos"))
    return cut(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("hot_docs"), F.max("doc_id").alias("hot_last")))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, pos): the lines that go; th is the hash of the text."""
    entries = cut(_entries(docs, min_chars), "lines")
    marked = entries.join(F.broadcast(_hot_keys(entries)), ["h1", "h2"], "left")  # at most 4 * HOT_SHARE rows
    frequent = marked.where((F.col("hot_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("hot_last"))).select("doc_id", "th", "pos")

    n = partitions(docs.sparkSession)
    span = F.floor((F.shiftright("h1", 32).cast("double") + 2.0**31) / 2.0**32 * n).cast("int")  # ranges of equal width
    rest = marked.where("hot_docs is null").select(span.alias("span"), "h1", "h2", "doc_id", "th", "pos").repartitionById(n, F.col("span"))
    by_key = W.partitionBy("span", "h1", "h2").orderBy(F.desc_nulls_last("doc_id"), "th", "pos")
    whole = by_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    again = F.lag("th").over(by_key).eqNullSafe(F.col("th")) & F.lag("doc_id").over(by_key).eqNullSafe(F.col("doc_id"))
    seen = rest.withColumn("new", F.when(again & F.lag("pos").over(by_key).isNotNull(), 0).otherwise(1)).withColumn("last", F.first("doc_id").over(by_key))
    seen = seen.withColumn("docs", F.sum("new").over(whole))
    gone = seen.where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "th", "pos")
    return gone.unionByName(frequent)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, kept_before): for each dropped line of a document, the kept lines between it and the dropped one before."""
    drops = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("pos"))  # lines of one document
    gap = lambda p, i: p - F.when(i > 0, F.element_at("pos", i) + 1).otherwise(0)
    return drops.select("doc_id", "th", F.transform("pos", gap).alias("kept_before"))


def with_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, name: str = "kept_before") -> DataFrame:
    """The documents' columns and a last one, ``name``, of bitmaps (null: all lines stay); docs must have no column of that name."""
    if name != spare(docs, name)[0]:
        raise ValueError(f"the documents have a column {name}")
    b_id, b_th = spare(docs, "b_id", "b_th")
    found = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(b_id), F.col("th").alias(b_th), F.col("kept_before").alias(name))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(b_id)) & (F.xxhash64(docs["text"]) == F.col(b_th)), "left").drop(b_id, b_th)


def kept_text(text: Column, kept_before: Column) -> Column:
    """The text that a bitmap leaves."""
    keep = F.flatten(F.transform(kept_before, lambda n: F.concat(F.array_repeat(F.lit(True), n.cast("int")), F.array(F.lit(False)))))
    left = F.filter(text_lines(text), lambda _, i: F.coalesce(F.get(keep, i), F.lit(True)))
    return F.when(kept_before.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their kept lines as text (and n_chars, if they have it, of that text); null texts stay null."""
    (name,) = spare(docs, "kept_before")
    out, bitmap = with_bitmaps(docs, min_chars, min_docs, name), F.col(name)
    out = out.withColumn("text", F.when(bitmap.isNull(), F.col("text")).otherwise(kept_text(F.col("text"), bitmap)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(bitmap.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(name)
