"""Where zooms stand, of which kind and how far: one recording in one task, since each choice rests on those before."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wordloom.operators.zoom import keyframes
from wordloom.shipping import ship


@dataclass(frozen=True)
class ZoomRules:
    """Seconds and per cent; the middle style."""

    intensity: float = 55.0
    spacing: float = 6.5
    per_minute: float = 5.5
    most_static: float = 22.0
    delta: tuple[float, float] = (4.0, 20.0)
    floor: float = 100.0
    ceiling: float = 145.0
    #: (kind, weight, seconds of a shot from which it may be drawn), in the order of drawing.
    kinds: tuple[tuple[str, float, float], ...] = (("progressive", 1.0, 2.6), ("launched", 1.2, 1.5), ("direct", 1.0, 0.8))
    no_repeats: bool = True
    launch: float = 1.05
    launch_jitter: float = 0.18
    overshoot: float = 0.11
    stiffness: float = 5.6
    fps: float = 30.0
    most_keyframes: int = 90
    tolerance: float = 0.22


#: Amplitudes of kinds against a progressive zoom; fill-ins may stand this much closer.
AMPLITUDE, CLOSER = {"direct": 0.85, "launched": 1.05}, 0.7
FILLS = 200
PLAN = "zoom int, shot int, kind string, t double, t_end double, start_scale double, end_scale double, peak double, seconds double, score double, fills boolean, keyframes array<struct<t: double, v: double>>"


def _between(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def _far(t: float, taken: list[float], apart: float) -> bool:
    """Whether t is ``apart`` from its neighbours among the sorted times."""
    k = bisect_left(taken, t)
    return all(abs(t - x) >= apart for x in taken[max(0, k - 1) : k + 1])


def placed(starts: list[float], scores: list[float], total: float, rules: ZoomRules) -> list[tuple[int, bool]]:
    """(position, whether it fills a static stretch) of the shots that get a zoom, in order of time.

    The best scores are taken first, no closer than the spacing and no more than the quota; then the
    widest stretch without a zoom gets its best shot, until none is too wide or its shots are used up.
    """
    x = _between(rules.intensity, 0.0, 100.0) / 100
    apart = rules.spacing * (1.55 + (0.62 - 1.55) * x)
    quota = max(1, round(rules.per_minute * (0.40 + (1.30 - 0.40) * x) * total / 60))
    ranked = sorted((k for k, s in enumerate(scores) if s > -1), key=lambda k: -scores[k])
    chosen: dict[int, bool] = {}
    taken: list[float] = []

    def take(k: int, fills: bool) -> None:
        chosen[k] = fills
        insort(taken, starts[k])

    for k in ranked:
        if len(chosen) == quota:
            break
        if _far(starts[k], taken, apart):
            take(k, False)
    for _ in range(FILLS if rules.most_static > 0 and ranked else 0):
        edges = np.array([0.0, *taken, total])
        width = np.diff(edges)
        at = int(width.argmax())
        if width[at] <= rules.most_static:
            break
        k = next((k for k in ranked if k not in chosen and edges[at] < starts[k] < edges[at + 1] and _far(starts[k], taken, CLOSER * apart)), None)
        if k is None:
            break
        take(k, True)
    return sorted(chosen.items(), key=lambda item: starts[item[0]])


def _kind(seconds: float, before: str | None, rules: ZoomRules, draw: Random) -> str:
    """One of the kinds a shot is long enough for, by weight, not the one before if there is another."""
    fit = [(kind, max(0.0, w)) for kind, w, least in rules.kinds if seconds >= least]
    if not fit:
        return "direct"
    if rules.no_repeats and before and len(fit) > 1:
        others = [f for f in fit if f[0] != before]
        fit = others if sum(w for _, w in others) > 0 else fit
    upto = np.cumsum([w for _, w in fit])
    if upto[-1] <= 0:
        return fit[0][0]
    return fit[min(int(np.searchsorted(upto, draw.random() * upto[-1])), len(fit) - 1)][0]


def planned(shots: list[tuple[int, float, float, float]], rules: ZoomRules, seed: int) -> list[tuple]:
    """Rows of PLAN for the shots (shot, start on the timeline, seconds, score) of a recording."""
    draw, rows, before = Random(seed), [], None
    total = sum(s[2] for s in shots)
    low, high = rules.delta
    reach = low + (high - low) * _between(rules.intensity, 0.0, 100.0) / 100
    for k, fills in placed([s[1] for s in shots], [s[3] for s in shots], total, rules):
        shot, start, seconds, score = shots[k]
        kind = before = _kind(seconds, before, rules, draw)
        delta = reach * (1 + draw.uniform(-0.18, 0.18)) * (1 + 0.10 * _between(score, 0.0, 2.0)) * AMPLITUDE.get(kind, 1.0)
        a, b = rules.floor, _between(rules.floor + delta, rules.floor, rules.ceiling)
        shape = (rules.fps, rules.most_keyframes, rules.tolerance)
        peak, lasts, points = b, 0.0, []
        if kind == "direct":
            a = b
        elif kind == "progressive":
            lasts = seconds
            points = keyframes("progressive", lasts, a, b, *shape)
        else:
            lasts = _between(rules.launch + draw.uniform(-rules.launch_jitter, rules.launch_jitter), 0.55, max(0.55, seconds))
            peak = _between(a + (b - a) * (1 + rules.overshoot), rules.floor, rules.ceiling + 6)
            points = keyframes("ballistic", lasts, a, b, *shape, stiffness=rules.stiffness, overshoot=rules.overshoot)
            if seconds > lasts + 1 / max(rules.fps, 1.0):
                points.append((seconds, b))  # held to the end of the shot
        rows.append((len(rows), shot, kind, start, start + seconds, a, b, peak, lasts, score, fills, [{"t": t, "v": v} for t, v in points]))
    return rows


def zooms(shots: DataFrame, scores: DataFrame, rules: ZoomRules = ZoomRules(), seed: int = 0) -> DataFrame:
    """(rush_id, ``PLAN``): the zooms of each recording from its shots (rush_id, shot, start, end, timeline_start in ms) and their scores.

    The draws begin anew from the seed in each recording, so the plan does not hang on the partitions.
    Shots without a score get none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shot")
        own = [(int(s), at / 1000, (b - a) / 1000, float(x)) for s, at, a, b, x in zip(pdf["shot"], pdf["timeline_start"], pdf["start"], pdf["end"], pdf["score"], strict=True)]
        out = pd.DataFrame(planned(own, rules, seed), columns=[c.split()[0] for c in PLAN.split(", ", 11)])
        out.insert(0, "rush_id", pdf["rush_id"].iloc[0])
        return out

    ship(shots.sparkSession)
    kind = shots.schema["rush_id"].dataType.simpleString()
    own = shots.select("rush_id", "shot", "start", "end", "timeline_start").join(scores.select("rush_id", "shot", "score"), ["rush_id", "shot"], "left").na.fill({"score": -5.0})
    return own.groupBy("rush_id").applyInPandas(run, f"rush_id {kind}, {PLAN}")
