"""Utterances of a stream of words: keyed state with event-time timers, equal to the batch's.

``session_window`` can say neither what ends a sentence nor the cap on words, and merges a gap of exactly the
limit. Here the state of a recording holds the words that the watermark has not passed, and the open utterance (its
bounds, its words, 48 at most); nothing else, so a recording may go on for ever. When the watermark passes a
word, it joins the open utterance or closes it; a timer at the first waiting word wakes a recording that falls silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.functions import text as T
from wordloom.shipping import ship

#: What is known of a word before it reaches the state; the scalar rules stay in expressions.
_WORD = ("idx", "text", "start_ms", "end_ms", "at_ms", "sentence", "suspension", "cut_off")
OUT = "rush_id long, first_idx long, n_words long, start_ms long, end_ms long, reason string, text string"


def _reason(last: list, gap: int, break_gap: int, hard_gap: int) -> str | None:
    """Why an utterance begins after ``last``, the word before; null if it goes on."""
    if last[5]:
        return "sentence"
    if last[6]:
        return "suspension"
    if gap >= hard_gap:
        return "long_gap"
    if gap >= break_gap:
        return "gap"
    return "truncated" if last[7] and gap >= 120 else None


def advance(state: dict, upto: int, most: int, break_gap: int, hard_gap: int) -> list[tuple]:
    """Moves the waiting words that are no later than ``upto`` into utterances; returns the closed ones. An utterance whose last word lies ``hard_gap`` back is closed too."""
    ready = sorted((w for w in state["waiting"] if w[4] <= upto), key=lambda w: w[0])
    state["waiting"] = [w for w in state["waiting"] if w[4] > upto]
    closed, now = [], state["open"]

    def close() -> None:
        first, n, start, end, reason, words, _ = now
        closed.append((first, n, start, end, reason, " ".join(words)))

    for w in ready:
        last = now[6] if now else state["last"]
        why = "start" if last is None else _reason(last, max(0, w[2] - last[3]), break_gap, hard_gap)
        if why is None and now and now[1] == most:
            why = "length"
        if now and why is not None:
            close()
            now = None
        if now is None:
            now = [w[0], 0, w[2], w[3], why, [], w]
        now = [now[0], now[1] + 1, min(now[2], w[2]), max(now[3], w[3]), now[4], [*now[5], w[1]], w]
    if now and not state["waiting"] and upto - now[6][4] >= hard_gap + (now[6][3] - now[6][2]):
        close()
        state["last"], now = now[6], None
    state["open"] = now
    return closed


def stream_utterances(words: DataFrame, delay: str = "10 seconds", most: int = 48, break_gap: int = 620, hard_gap: int = 1150) -> DataFrame:
    """(rush_id, first_idx, n_words, start_ms, end_ms, reason, text) of a stream of words (rush_id, idx, text, start_ms, end_ms, at), in append mode.

    ``at`` is the event time, in order of ``start_ms`` within a recording. Words may come in any order within
    ``delay``; a later one is dropped, as the watermark says. Each utterance comes once, when the watermark has passed
    the word that ends it or the longest gap after it.
    """
    ship(words.sparkSession)
    own = words.withWatermark("at", delay).select(
        F.col("rush_id").cast("long").alias("rush_id"), "at", "idx", "text", "start_ms", "end_ms", F.unix_millis("at").alias("at_ms"),
        T.ends_sentence("text").alias("sentence"), T.ends_suspension("text").alias("suspension"), T.is_truncated("text").alias("cut_off"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "open": None, "last": None}
        upto = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                rows = pdf[list(_WORD)].astype(object).to_numpy().tolist()
                held["waiting"] += [[int(r[0]), r[1], int(r[2]), int(r[3]), int(r[4]), *map(bool, r[5:])] for r in rows if int(r[4]) > upto]
        closed = advance(held, upto, most, break_gap, hard_gap)
        if held["waiting"] or held["open"]:
            state.update((json.dumps(held),))
            ahead = [w[4] for w in held["waiting"]] or [held["open"][6][4] + hard_gap + held["open"][6][3] - held["open"][6][2]]
            state.setTimeoutTimestamp(max(min(ahead), upto + 1))
        else:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(upto + 365 * 86_400_000)
        yield pd.DataFrame([(key[0], *c) for c in closed], columns=[c.split()[0] for c in OUT.split(", ")])

    return own.groupBy("rush_id").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
