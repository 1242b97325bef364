"""Several attempts at one sentence: which utterances a later (or an earlier, better) one replaces.

All that can be said of a pair of utterances is a column of the pair table, made within blocks of
utterances, so a long recording is spread over tasks. Pairs are measured only where a short look at their words
leaves it open whether one starts over. Only the choice of attempts, in which
one group's claims bar the next, goes through a recording in order, on flags and confidences alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.markers import with_marks
from wordloom.operators.similarity import begun, measures, scored
from wordloom.shipping import ship


@dataclass(frozen=True)
class RetakeRules:
    """Times in milliseconds; the middle style."""

    alike_after_marker: float = 0.50
    alike: float = 0.70
    window: int = 26_000
    steps: int = 5
    shared: int = 2
    long_attempt: int = 7_500
    loss: float = 0.50
    whole_from: int = 7


#: Utterances of a recording that look for their neighbours in one task.
BLOCK = 256
_SIDE = ("utt_id", "start_ms", "end_ms", "tokens", "content", "complete", "abandoned", "marker", "strong")


def utterance_pairs(utterances: DataFrame, rules: RetakeRules = RetakeRules()) -> DataFrame:
    """(rush_id, a, b, m): each utterance with each of the next few within the window, and their measures.

    Utterances have (rush_id, utt_id, start_ms, end_ms, text), utt_id counting from 0.
    """
    return _measured(_neighbours(utterances, rules))


def pair_scores(utterances: DataFrame, rules: RetakeRules = RetakeRules()) -> DataFrame:
    """(rush_id, a, b, SCORES): the pairs of ``utterance_pairs`` by their numbers, with the measures that are plain numbers, made for many pairs at a time."""
    near = _neighbours(utterances, rules, ("utt_id", "start_ms", "end_ms", "said"))
    number = lambda x: x["utt_id"].cast("long")
    return scored(near.select("rush_id", F.transform("near", number).alias("near"), F.col("near.said").alias("near_said"), number(F.col("b")).alias("b"), "b.said"))


def _neighbours(utterances: DataFrame, rules: RetakeRules, side: tuple[str, ...] = _SIDE) -> DataFrame:
    """(rush_id, near, b): each utterance with the few before it within the window, the nearest last.

    Recordings are dealt in blocks of utterances, each with the last few of the block before.
    """
    u = with_marks(utterances).withColumn("said", F.when(~F.col("marker"), F.array_join("tokens", " "))).withColumn("at", F.col("utt_id").cast("long")).where("rush_id is not null")
    block = lambda c: F.floor(c / BLOCK)
    u = u.select("rush_id", "at", F.struct(*side).alias("b"), F.explode(F.sequence(block(F.col("at")), block(F.col("at") + rules.steps))).alias("block"))
    before = W.partitionBy("rush_id", "block").orderBy("at").rangeBetween(-rules.steps, -1)
    u = u.withColumn("near", F.collect_list("b").over(before)).where(block(F.col("at")) == F.col("block"))
    return u.select("rush_id", F.filter("near", lambda a: F.col("b.start_ms") - a["end_ms"] <= rules.window).alias("near"), "b").where(F.size("near") > 0)


def _loose(a: Column, rules: RetakeRules) -> Column:
    return a["abandoned"] | ((F.size(a["tokens"]) < rules.whole_from) & ~a["complete"])


def _deciding(neighbours: DataFrame, rules: RetakeRules) -> DataFrame:
    """Without the utterances that can neither be kept nor go: none near starts over, and no marker stands before after loose ones.

    An attempt passes only if it starts over; a walk back from a kept utterance gets to a marker only over markers and
    attempts, and an attempt that does not pass is loose.
    """
    text = lambda x: F.when(~x["marker"], F.array_join(x["tokens"], " "))
    nearest = F.element_at("near", -1)
    own = neighbours.where("not b.marker").withColumn("begun", begun(F.transform("near", text), text(F.col("b"))))
    marked = F.exists("near", lambda a: a["marker"]) & (nearest["marker"] | _loose(nearest, rules))
    return own.where(F.exists("begun", lambda x: x) | marked).drop("begun")


def _measured(neighbours: DataFrame) -> DataFrame:
    near = neighbours.select("rush_id", F.explode("near").alias("a"), "b")
    spoken = ~F.col("a.marker") & ~F.col("b.marker")
    return near.select("rush_id", "a", "b", measures(F.when(spoken, F.col("a.tokens")), F.when(spoken, F.col("b.tokens"))).alias("m"))


def passes(score: Column, marked: bool, rules: RetakeRules) -> Column:
    """Alike enough: a visible restart, words in common, and a score that depends on a marker between."""
    m, need = F.col("m"), rules.alike_after_marker if marked else rules.alike
    begun = m["restart_prefix"] | (m["restart_structure"] & (m["n_shared"] >= rules.shared))
    verbatim = (m["prefix_tokens"] >= 4) & (m["prefix"] >= 0.70) & (score >= need * 0.75)
    return begun & ((score >= need) | verbatim | (m["restart_prefix"] & (score >= 0.30) if marked else F.lit(False)))


def confidence(own: str, kept: str, score: Column, mark: str | None, rules: RetakeRules) -> Column:
    """How surely ``own`` (a or b) is an attempt that ``kept`` replaces, after a strong, a weak or no marker."""
    u, k, m = F.col(own), F.col(kept), F.col("m")
    restarted = m["restart_prefix"] | m["restart_structure"]
    literal = m["restart_prefix"] if mark else F.lit(False)
    few = F.when(F.size(u["content"]) < 4, 0.05).otherwise(0.0)
    c = score + {"strong": 0.16, "weak": 0.08, None: 0.0}[mark]
    c = c + F.when(literal, F.least(F.lit(0.26), 0.10 + 0.045 * m["prefix_tokens"])).when(m["restart_structure"], 0.10).otherwise(0.0)
    c = c + F.when(u["abandoned"], 0.10).otherwise(0.0) + F.when(k["complete"] & (F.size(k["tokens"]) >= F.size(u["tokens"])), 0.06).otherwise(0.0) + few
    c = c - F.when(F.when(literal, F.size(m["lost_in_prefix"]) > 0).otherwise(m["loss"] > rules.loss), 0.25).otherwise(0.0)
    if mark == "strong":
        c = F.when(u["abandoned"], F.greatest(c, F.lit(0.78))).otherwise(c)
    else:
        c = c - F.when(u["complete"], F.when(restarted, 0.12).otherwise(0.20)).otherwise(0.0)
        c = c - F.when(u["end_ms"] - u["start_ms"] > rules.long_attempt, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def judged_pairs(pairs: DataFrame, rules: RetakeRules = RetakeRules()) -> DataFrame:
    """The flags and confidences of each pair that the choice of attempts reads."""
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    up = F.when(a["abandoned"], m["score_interrupted"]).otherwise(m["score"])
    down = F.when(b["abandoned"], m["score_interrupted"]).otherwise(m["score"])
    cut_short = a["complete"] & (F.size(m["gained"]) == 0) & (F.size(b["content"]) < F.size(a["content"])) & (m["opening"] >= 0.95)
    b_weaker = (b["abandoned"] & ~a["abandoned"]) | cut_short
    thin = (F.size(a["content"]) >= 5) & (F.size(b["content"]) <= 1)
    loose = _loose(a, rules)
    gates = {False: passes(up, False, rules), True: passes(up, True, rules)}
    return pairs.select(
        "rush_id", a["utt_id"].cast("long").alias("a"), b["utt_id"].cast("long").alias("b"), a["marker"].alias("a_marker"), a["strong"].alias("a_strong"), a["abandoned"].alias("a_abandoned"),
        (~b["marker"] & (b["complete"] | (F.size(b["tokens"]) >= rules.whole_from))).alias("keepable"),
        *(gates[k].alias(f"gate{int(k)}") for k in gates), *((~thin & ~b_weaker & (loose | gates[k])).alias(f"may{int(k)}") for k in gates),
        *(confidence("a", "b", up, mark, rules).alias(f"sure_{mark}") for mark in ("strong", "weak", None)),
        (~a["marker"] & a["complete"] & ~a["abandoned"] & ~b["marker"] & b_weaker & passes(down, False, rules)).alias("down"),
        confidence("b", "a", down, None, rules).alias("sure_down"),
    )


_CHOSEN = "rush_id long, group_id long, kept_utt long, utt_id long, role string, anchor string, confidence double"


def _choose(pairs: pd.DataFrame) -> pd.DataFrame:
    rush, taken, groups, out = pairs["rush_id"].iloc[0], set(), 0, []
    earlier: dict[int, list] = {}
    later: dict[int, list] = {}
    for p in pairs.sort_values(["a", "b"]).itertuples(index=False):
        later.setdefault(p.a, []).append(p)
        earlier.setdefault(p.b, []).insert(0, p)

    def close(kept: int, anchor: str, rows: list[tuple[int, str, float]]) -> None:
        nonlocal groups
        out.extend((rush, groups, kept, u, role, anchor, sure) for u, role, sure in sorted(rows))
        taken.update(u for u, _, _ in rows)
        groups += 1

    for kept in sorted(earlier):
        if not earlier[kept][0].keepable:
            continue
        tries, marks = [], []
        for back, p in enumerate(earlier[kept], 1):
            if p.a != kept - back or p.a in taken:
                break
            if p.a_marker:
                marks.append(p)
            elif p.may1 if marks else p.may0:
                tries.append(p)
            else:
                break
        strong, weak = any(p.a_strong for p in marks), any(not p.a_strong for p in marks)
        if strong and tries:
            anchor = "marker"
        elif any(p.gate1 if marks else p.gate0 for p in tries):
            anchor = "similar"
        elif weak and any(p.a_abandoned for p in tries):
            anchor = "weak marker"
        else:
            continue
        sure = "sure_strong" if strong else "sure_weak" if weak else "sure_None"
        close(kept, anchor, [(p.a, "attempt", getattr(p, sure)) for p in tries] + [(p.a, "marker", 0.92 if p.a_strong else 0.70) for p in marks])

    for kept in sorted(later):
        if kept in taken:
            continue
        tries = []
        for ahead, p in enumerate(later[kept], 1):
            if p.b != kept + ahead or p.b in taken or not p.down:
                break
            tries.append((p.b, "attempt", p.sure_down))
        if tries:
            close(kept, "better before", tries)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _CHOSEN.split(", ")])


def retakes(utterances: DataFrame, rules: RetakeRules = RetakeRules()) -> DataFrame:
    """(rush_id, group_id, kept_utt, utt_id, role, anchor, confidence) of each utterance that may go.

    Lone connectors and lone strong markers are in no group: group_id and kept_utt are null there.
    An empty table gives no rows; null texts are utterances without words.
    """
    ship(utterances.sparkSession)
    chosen = judged_pairs(_measured(_deciding(_neighbours(utterances, rules), rules)), rules).groupBy("rush_id").applyInPandas(_choose, _CHOSEN)
    chosen = chosen.withColumn("confidence", F.round("confidence", 3))
    u = with_marks(utterances).withColumn("utt_id", F.col("utt_id").cast("long")).join(chosen.select("rush_id", "utt_id"), ["rush_id", "utt_id"], "left_anti")
    connector = ~F.col("marker") & F.col("abandoned") & (F.size("tokens") <= 2) & (F.size("content") == 0) & (F.col("dangling") | F.col("suspended"))
    kind = F.when(connector, "attempt").when(F.col("marker") & F.col("strong"), "marker")
    none = F.lit(None).cast("long")
    lone = u.withColumn("role", kind).where("role is not null").select(
        "rush_id", none.alias("group_id"), none.alias("kept_utt"), "utt_id", "role", F.when(F.col("role") == "marker", "lone marker").otherwise("lone connector").alias("anchor"),
        F.when(F.col("role") == "marker", 0.88).otherwise(0.85).alias("confidence"),
    )
    return chosen.unionByName(lone)


def fragments(utterances: DataFrame, removed: DataFrame, longest: int = 2600, most: int = 6) -> DataFrame:
    """(rush_id, utt_id, confidence, unique) of short utterances beside removed ones (rush_id, utt_id) or beside markers.

    ``unique`` holds the content words that the nearest kept utterances on both sides don't have.
    """
    gone = removed.select("rush_id", F.col("utt_id").cast("long").alias("utt_id"), F.lit(True).alias("gone")).distinct()
    u = with_marks(utterances).withColumn("utt_id", F.col("utt_id").cast("long")).join(gone, ["rush_id", "utt_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    order = W.partitionBy("rush_id").orderBy("utt_id")
    beside = lambda c, f: F.coalesce(f(c).over(order), F.lit(False))
    back = W.partitionBy("rush_id").orderBy(F.desc("utt_id")).rowsBetween(W.unboundedPreceding, -1)  # a frame that only grows; one to the end would be read anew for each row
    kept = F.when(~F.col("gone"), F.col("content"))
    u = u.withColumns({
        "gone_before": beside("gone", F.lag), "gone_after": beside("gone", F.lead), "near_marker": beside("marker", F.lag) | beside("marker", F.lead),
        "left": F.last(kept, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)),
        "right": F.last(kept, ignorenulls=True).over(back),
    })
    one, both = F.col("gone_before") | F.col("gone_after"), F.col("gone_before") & F.col("gone_after")
    u = u.where(~F.col("gone") & (F.col("end_ms") - F.col("start_ms") <= longest) & F.size("tokens").between(1, most) & (one | F.col("near_marker")))
    none = F.array().cast("array<string>")
    u = u.withColumn("unique", F.array_sort(F.array_except("content", F.concat(F.coalesce("left", none), F.coalesce("right", none)))))
    c = 0.45 + F.when(F.col("abandoned"), 0.18).when(F.col("complete"), -0.18).otherwise(0.0)
    c = c + F.when(both, 0.22).when(one, 0.12).when(F.col("near_marker"), 0.08).otherwise(0.0) + F.when(F.size("tokens") <= 3, 0.10).otherwise(0.0)
    c = c + F.when(F.size("unique") == 0, 0.14).when(F.size("unique") >= 2, -0.22).otherwise(0.0)
    return u.select("rush_id", "utt_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3).alias("confidence"), "unique")
