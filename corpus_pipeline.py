"""From documents to packed training windows: five stages, each on all that the one before kept."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontam, line_dedup, ngram_join, packing, toxicity
from wordloom.llm.common import shared_path
from wordloom.llm.queries import TOKENIZER, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than 0.7; the machine learns from the labels of these documents.

    A null or empty text has the score of a document without terms; labels of unknown documents are
    not read; repeated rows are scored each for itself; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others share and a later one keeps.

    A null text stays null, an empty one empty; a null doc_id is below any other, so it never keeps a
    shared line; rows of one doc_id are decided alike; an empty table stays empty.
    """
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id, of equal ids the first row.

    Texts without words (null and empty ones) are no copies of each other and stay; a null doc_id goes
    before any other does; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no passage is near an item of the benchmark.

    Each row is decided by its own text, whatever its doc_id; null and empty texts stay; an empty table
    stays empty, and an empty benchmark leaves all.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2,048 tokens.

    Null and empty texts are one piece of the closing id; repeated rows are packed each for itself; an
    empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: The stages train a model and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, f = stage
        path = shared_path(spark, f"stage-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
