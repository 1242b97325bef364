"""Word times put right, and utterances cut further: behind a marker of correction, and where one begins anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import markers as M
from wordloom.functions import text as T
from wordloom.operators.similarity import MEASURES, compare, degree
from wordloom.operators.words import with_utterances
from wordloom.shipping import ship

#: Words on either side of a restart, at least; words of a marker at the head, at most.
TAKE, HEAD = 3, 6
_AT = {m.split()[0]: k for k, m in enumerate(MEASURES.split(", "))}


def repaired(words: DataFrame) -> DataFrame:
    """Words (rush_id, idx, norm, start_ms, end_ms and more) in order of time, numbered anew, none before the end of the one before.

    An end before its start is the start; words of less than 12 ms last 35 ms a character of their normal
    form, 50 ms at least; a start before the end of the word before is moved there, and 20 ms are given to
    a word that would end before it. Words without times or text are left out. The recurrence streams
    through the sorted rows and keeps one number, so a recording may be of any length.
    """
    order = W.partitionBy("rush_id").orderBy("start_ms", "end_ms", "idx")
    own = words.where("start_ms is not null and end_ms is not null").where(F.trim("text") != "")
    own = own.withColumn("_n", F.greatest(F.lit(1), F.char_length("norm"))).withColumn("idx", F.row_number().over(order) - 1)
    schema = own.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached = 0
        for pdf in batches:
            start = pdf["start_ms"].to_numpy(np.int64, copy=True)
            end = np.maximum(start, pdf["end_ms"].to_numpy(np.int64))
            end = np.where(end - start < 12, start + np.maximum(50, 35 * pdf["_n"].fillna(1).to_numpy(np.int64)), end)
            new = pdf["idx"].to_numpy() == 0
            for k in range(len(pdf)):
                reached = 0 if new[k] else reached
                if start[k] < reached:
                    start[k] = reached
                    end[k] = end[k] if end[k] >= reached else reached + 20
                reached = end[k]
            yield pdf.assign(start_ms=start, end_ms=end)

    return own.sortWithinPartitions("rush_id", "idx").mapInPandas(run, schema).drop("_n")


def _marker_end(said: Column) -> Column:
    """How many words at the head announce a correction, the most that do; null where none do."""

    def whole(n: int) -> Column:
        head = T.normalize_text(F.array_join(F.transform(F.slice(said, 1, n), lambda w: F.trim(w["text"])), " "))
        return F.when((F.size(said) >= max(4, n + 2)) & M.strong_marker(head) & M.standalone_marker(head), n)

    return F.coalesce(*(whole(n) for n in range(HEAD, 1, -1)))


def restart(tokens: list[str]) -> int | None:
    """After how many tokens the speaker begins anew: where both sides are most alike as two attempts, the earliest on ties."""
    if len(tokens) < 2 * TAKE or not all(tokens):
        return None
    begun = (p for p in range(TAKE, len(tokens) - TAKE + 1) if degree(tokens[p], tokens[0]) or degree(tokens[p + 1], tokens[1]))
    found = [(m[_AT["score"]], -p) for p in begun if (m := compare(tokens[:p], tokens[p:]))[_AT["restart_prefix"]] or m[_AT["restart_structure"]]]
    best, at = max(found, default=(0.0, 0))
    return -at if best > 0 else None


def _restarts(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else restart(list(t)) for t in tokens], dtype="Int32")


def restart_at(tokens: Column) -> Column:
    ship()
    return F.pandas_udf(_restarts, "int")(tokens)


def _cut(groups: DataFrame, at: Column, reason: str) -> DataFrame:
    """Groups (rush_id, reason, said), those with a place ``at`` as two."""
    said, part = F.col("said"), lambda r, s: F.struct(r.alias("reason"), s.alias("said"))
    two = F.array(part(F.col("reason"), F.slice(said, 1, F.col("at"))), part(F.lit(reason), F.slice(said, F.col("at") + 1, F.size(said))))
    own = groups.withColumn("at", at).withColumn("parts", F.when(F.col("at").isNull(), F.array(part(F.col("reason"), said))).otherwise(two))
    return own.select("rush_id", F.explode("parts").alias("g")).select("rush_id", "g.*")


def split_utterances(words: DataFrame, most: int = 48, isolate_markers: bool = True, restarts: bool = True) -> DataFrame:
    """Utterances as ``words.utterances`` gives them, cut once behind a strong marker at the head (``marker``) and once at a restart (``restart``).

    A group has ``most`` words at most, so it is one row here.
    """
    w = with_utterances(words, most)
    said = F.array_sort(F.collect_list(F.struct("idx", "text", "norm", "start_ms", "end_ms")))
    groups = w.groupBy("rush_id", "run", "part").agg(said.alias("said"), F.min_by("reason", "idx").alias("reason"))
    groups = groups.select("rush_id", F.when(F.col("part") > 0, "length").otherwise(F.col("reason")).alias("reason"), "said")
    if isolate_markers:
        groups = _cut(groups, _marker_end(F.col("said")), "marker")
    if restarts:
        norms = F.transform("said", lambda x: x["norm"])
        groups = _cut(groups, restart_at(F.when(F.size("said") >= 2 * TAKE, norms)), "restart")
    out = groups.select(
        "rush_id", F.element_at("said", 1)["idx"].alias("first_idx"), F.size("said").cast("long").alias("n_words"), F.element_at("said", 1)["start_ms"].alias("start_ms"),
        F.array_max(F.transform("said", lambda x: x["end_ms"])).alias("end_ms"), "reason", F.array_join(F.transform("said", lambda x: x["text"]), " ").alias("text"),
    )
    order = W.partitionBy("rush_id").orderBy("first_idx")
    out = out.withColumn("utt_id", F.row_number().over(order) - 1)
    out = out.withColumn("gap_before", F.greatest(F.lit(0), F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order), F.col("start_ms"))))
    out = out.withColumn("gap_after", F.greatest(F.lit(0), F.lead("start_ms").over(order) - F.col("end_ms")))
    return out.select("rush_id", "utt_id", "first_idx", "n_words", "start_ms", "end_ms", "reason", "gap_before", "gap_after", "text")
