"""The queries of the catalogue in SQL."""

from __future__ import annotations

from wordloom.functions import lexicon as L
from wordloom.functions import markers as M
from wordloom.functions import text as T
from wordloom.functions import vocabulary as V
from wordloom.functions.numbers import RATES
from wordloom.operators.alignment import _STEM
from wordloom.plans.catalogue import KINDS, LOOSE_ENDS, MARKERS, PHRASES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def normal(x: str) -> str:
    plain = f"lower(translate(trim(translate({x}, {q(T.APOSTROPHES)}, {q(chr(39) * len(T.APOSTROPHES))})), {q(T.ACCENTED)}, {q(T.PLAIN)}))"
    return f"trim(replace(trim({plain}, {q(T.EDGES)}), '…', ''))"


def normal_text(x: str) -> str:
    plain = f"lower(translate(translate({x}, {q(T.APOSTROPHES)}, {q(chr(39) * len(T.APOSTROPHES))}), {q(T.ACCENTED)}, {q(T.PLAIN)}))"
    return rf"trim(regexp_replace(regexp_replace({plain}, '[^\p{{L}}\p{{N}}_''\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def opened(x: str) -> str:
    return f"rtrim(trim({x}), {q(T.CLOSING)})"


SUSPENSION = f"({opened('p')} LIKE '%...' OR {opened('p')} LIKE '%…')"
SENTENCE = f"(right({opened('p')}, 1) IN ('.', '!', '?') AND NOT {SUSPENSION})"
CLAUSE = f"(right({opened('p')}, 1) IN (',', ';', ':'))"

WORDS = rf"""
t AS (SELECT conv_id AS rush_id, turn AS seg_idx, unnest(range(0, len(x))) AS pos, unnest(x) AS text FROM (SELECT *, regexp_split_to_array(trim(text), '\s+') AS x FROM conversations)),
u AS (SELECT *, row_number() OVER o - 1 AS idx, lag(text) OVER o AS pw, 115 + 52 * length(text) AS dur FROM t WHERE text <> '' WINDOW o AS (PARTITION BY rush_id ORDER BY seg_idx, pos)),
v AS (SELECT *, CASE WHEN pw IS NULL THEN 500 WHEN pos = 0 THEN 200 + (31 * rush_id + 17 * seg_idx) % 1500
  WHEN right(pw, 1) IN ('.', '!', '?') THEN 250 + (13 * rush_id + 7 * seg_idx + 11 * pos) % 1300
  WHEN right(pw, 1) IN (',', ';', ':') THEN 150 + (13 * rush_id + 7 * seg_idx + 11 * pos) % 600
  WHEN (rush_id + 29 * pos) % 23 = 0 THEN 320 + (7 * rush_id + 11 * pos) % 900 ELSE 35 END AS g FROM u),
w AS (SELECT rush_id, seg_idx, idx, text, {normal("text")} AS norm, CAST(e - dur AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms
  FROM (SELECT *, sum(g + dur) OVER (PARTITION BY rush_id ORDER BY idx) AS e FROM v)),
l AS (SELECT *, lag(text) OVER o AS p, greatest(0, start_ms - lag(end_ms) OVER o) AS gap, lag(end_ms) OVER o AS before_ms, lag(norm) OVER o AS before,
  lead(norm) OVER o AS target, lead(start_ms) OVER o - end_ms AS ahead FROM w WINDOW o AS (PARTITION BY rush_id ORDER BY idx))"""

def picked(words) -> str:
    return f"[{', '.join(map(q, words))}][1 + (conv_id + turn) % {len(words)}]"


FIRST = "array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:{}], ' ')"
MADE = (
    f"{picked(MARKERS)} || ', ' || text", f"{picked(MARKERS)} || '. ' || text", f"{picked(PHRASES)} || ' ' || text", f"{FIRST.format(5)} || '- ' || text", "'euh ' || text",
    f"{FIRST.format(3)} || ' ' || text", f"{FIRST.format(2)} || ' ' || text", f"regexp_replace(text, '[.!?]+$', '') || ' ' || {picked(LOOSE_ENDS)}",
    f"{FIRST.format(1)} || ' ' || {FIRST.format(1)} || ' ' || text", f"left({FIRST.format(1)}, 3) || '- ' || text", f"{picked(MARKERS)} || '.'",
)
TURNS = f"turns AS (SELECT conv_id, turn, CASE (7 * conv_id + 3 * turn) % {KINDS} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(MADE))} ELSE text END AS text FROM conversations)"


def on_turns(sql: str) -> str:
    """The same on what ``spoken`` makes of conversations."""
    return TURNS + ",\n" + sql.lstrip().replace("FROM conversations", "FROM turns")


UTTERANCES = f"""WITH {WORDS},
r AS (SELECT *, CASE WHEN p IS NULL THEN 'start' WHEN {SENTENCE} THEN 'sentence' WHEN {SUSPENSION} THEN 'suspension' WHEN gap >= 1150 THEN 'long_gap' WHEN gap >= 620 THEN 'gap'
  WHEN right(trim(p), 1) IN ('-', '_') AND length(trim(p)) > 1 AND gap >= 120 THEN 'truncated' END AS reason FROM l),
n AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rush_id ORDER BY idx) AS run FROM r),
m AS (SELECT *, (row_number() OVER (PARTITION BY rush_id, run ORDER BY idx) - 1) // 48 AS part FROM n),
s AS (SELECT rush_id, run, part, min(idx) AS first_idx, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  CASE WHEN part > 0 THEN 'length' ELSE arg_min(reason, idx) END AS reason, string_agg(text, ' ' ORDER BY idx) AS text FROM m GROUP BY rush_id, run, part)
SELECT rush_id, row_number() OVER o - 1 AS utt_id, first_idx, n_words, start_ms, end_ms, reason,
  coalesce(start_ms - lag(end_ms) OVER o, start_ms) AS gap_before, coalesce(lead(start_ms) OVER o - end_ms, 0) AS gap_after, text FROM s WINDOW o AS (PARTITION BY rush_id ORDER BY first_idx)"""

REPAIRED = f"""WITH RECURSIVE {WORDS},
ra AS (SELECT rush_id, idx AS k, text, norm, greatest(0, start_ms - (37 * idx + 11 * rush_id) % 400) AS s, end_ms - (53 * idx + 7 * rush_id) % 500 AS e FROM w WHERE norm <> ''),
rb AS (SELECT rush_id, row_number() OVER (PARTITION BY rush_id ORDER BY s, e, k) - 1 AS idx, text, s, greatest(s, e) AS e, length(norm) AS n FROM ra),
rc AS MATERIALIZED (SELECT rush_id, idx, text, s, CASE WHEN e - s < 12 THEN s + greatest(50, 35 * n) ELSE e END AS e FROM rb),
rz AS (SELECT rush_id, idx, text, s AS start_ms, e AS end_ms FROM rc WHERE idx = 0
  UNION ALL SELECT rc.rush_id, rc.idx, rc.text, greatest(rc.s, rz.end_ms), CASE WHEN rc.e < rz.end_ms THEN rz.end_ms + 20 ELSE rc.e END FROM rz JOIN rc ON rc.rush_id = rz.rush_id AND rc.idx = rz.idx + 1)
SELECT rush_id, idx, text, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM rz"""

SPREAD = r"""WITH c AS (SELECT conv_id AS rush_id, turn AS seg_idx, turn * 10000 AS s, CASE WHEN turn % 3 = 0 THEN 0 ELSE 90 * length(text) END AS d,
  list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS x FROM conversations),
e AS (SELECT *, CASE WHEN d > 0 THEN d / len(x) ELSE 250.0 END AS step FROM c WHERE len(x) > 0), u AS (SELECT *, unnest(range(0, len(x))) AS pos, unnest(x) AS text FROM e)
SELECT rush_id, seg_idx, pos, text, CAST(s + floor(pos * step + 0.5) AS BIGINT) AS start_ms, CAST(s + floor((pos + 1) * step + 0.5) AS BIGINT) AS end_ms, CAST(0.5 AS DOUBLE) AS probability FROM u"""

SPACED = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
g AS (SELECT user_id, r, [id] AS ids, [t] AS times FROM e WHERE r = 1
  UNION ALL SELECT user_id, r, CASE WHEN far THEN list_append(ids, id) ELSE ids END, CASE WHEN far THEN list_append(times, t) ELSE times END
  FROM (SELECT e.*, ids, times, len(list_filter(times, lambda x: abs(x - t) < 86400)) = 0 AS far FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1 WHERE len(ids) < 5)),
b AS (SELECT user_id, arg_max(ids, r) AS ids, arg_max(times, r) AS times FROM g GROUP BY user_id)
SELECT user_id, unnest(range(0, len(ids))) AS rank, unnest(ids) AS id, unnest(times) AS t FROM b"""

SPOKEN = f"""{WORDS},
r AS (SELECT *, CASE WHEN p IS NULL THEN 'start' WHEN {SENTENCE} THEN 'sentence' WHEN {SUSPENSION} THEN 'suspension' WHEN gap >= 1150 THEN 'long_gap' WHEN gap >= 620 THEN 'gap'
  WHEN right(trim(p), 1) IN ('-', '_') AND length(trim(p)) > 1 AND gap >= 120 THEN 'truncated' END AS reason FROM l),
n AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rush_id ORDER BY idx) AS run FROM r),
m AS (SELECT *, (row_number() OVER (PARTITION BY rush_id, run ORDER BY idx) - 1) // 48 AS part FROM n),
uw AS (SELECT rush_id, run, part, idx, text, norm, start_ms, end_ms, before_ms, rtrim(norm, {q("-_'")}) AS stem, lag(norm) OVER o AS before, lead(norm) OVER o AS target, start_ms - lag(end_ms) OVER o AS behind,
  lead(start_ms) OVER o - end_ms AS ahead, count(*) FILTER (norm <> '') OVER (PARTITION BY rush_id, run, part) AS said FROM m WINDOW o AS (PARTITION BY rush_id, run, part ORDER BY idx))"""

GAPS = f"""{WORDS},
k AS (SELECT *, start_ms - before_ms AS d, CASE WHEN start_ms - before_ms <= 300 THEN 'short' WHEN start_ms - before_ms >= 950 THEN 'long' WHEN {SENTENCE} THEN 'sentence'
  WHEN {CLAUSE} THEN 'comma' ELSE 'hesitation' END AS kind FROM l WHERE p IS NOT NULL AND start_ms > before_ms),
h AS (SELECT *, least(d, greatest(CASE kind WHEN 'short' THEN d WHEN 'long' THEN 300 WHEN 'sentence' THEN 340 WHEN 'comma' THEN 200 ELSE 220 END, least(d, 190))) AS wanted FROM k),
gp AS (SELECT rush_id, idx, before_ms AS start, start_ms AS "end", d AS duration, kind, CASE WHEN d - wanted >= 90 THEN d - wanted ELSE 0 END AS removed FROM h WHERE d - wanted >= 90 OR d >= 120)"""

SHOTS = f"""{GAPS},
c AS (SELECT rush_id, "start" + floor((duration - removed) * 55 / 100) AS a, "end" - ((duration - removed) - floor((duration - removed) * 55 / 100)) AS b FROM gp WHERE removed > 0),
z AS (SELECT rush_id, a, lag(b) OVER (PARTITION BY rush_id ORDER BY a) AS prev FROM (SELECT * FROM c UNION ALL SELECT rush_id, max(end_ms), NULL FROM w GROUP BY rush_id)),
sh AS (SELECT rush_id, row_number() OVER o - 1 AS shot, CAST(coalesce(prev, 0) AS BIGINT) AS "start", CAST(a AS BIGINT) AS "end", CAST(sum(a - coalesce(prev, 0)) OVER o - (a - coalesce(prev, 0)) AS BIGINT) AS timeline_start
  FROM z WHERE a > coalesce(prev, 0) WINDOW o AS (PARTITION BY rush_id ORDER BY a))"""

DAYS = "days AS (SELECT o_custkey AS k, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 5 + o_orderkey % 60 AS e FROM orders)"


def merged(name: str, source: str) -> str:
    return f"""{name}_f AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}),
{name}_i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f),
{name} AS (SELECT k, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY k, island)"""


def _phrases() -> str:
    phrases = (*L.FILLER_PHRASES, "of the", "de la", "the")
    longest = max(len(p.split()) for p in phrases)
    ahead = ", ".join(f"lead(norm, {k}) OVER o AS w{k}" if k else "norm AS w0" for k in range(longest))
    cases = " ".join("WHEN " + " AND ".join(f"w{k} = {q(x)}" for k, x in enumerate(p.split())) + f" AND said > {len(p.split())} THEN {q(p)}" for p in phrases)
    return f"WITH {SPOKEN}, a AS (SELECT rush_id, idx, said, {ahead} FROM uw WINDOW o AS (PARTITION BY rush_id, run, part ORDER BY idx)) SELECT * FROM (SELECT rush_id, idx, CASE {cases} END AS phrase FROM a) WHERE phrase IS NOT NULL"


TOKENS = f"list_filter(string_split({normal_text('text')}, ' '), lambda x: x <> '')"


CONTENT = f"(length(x) >= 2 AND x NOT IN {among([*V.STOPWORDS, *L.HARD_FILLERS])})"


def _strong() -> str:
    weak = q(M._WEAK_WORD)
    return f"""WITH {TURNS}, n AS (SELECT conv_id, turn, {normal_text('text')} AS norm FROM turns),
s AS (SELECT *, regexp_matches(norm, {q(M.STRONG)}) AS strong, list_filter(string_split(norm, ' '), lambda x: x <> '') AS said FROM n),
a AS (SELECT conv_id, turn, strong, CASE WHEN len(said) = 0 THEN false WHEN norm IN {among(V.STANDALONE_MARKERS)} THEN true
  WHEN strong THEN len(list_filter(regexp_split_to_array(regexp_replace(norm, {q(M.STRONG)}, ' ', 'g'), ' +'), lambda x: {CONTENT})) = 0
  ELSE len(said) <= 4 AND len(list_filter(said, lambda x: NOT regexp_matches(x, {weak}) AND x NOT IN {among([*L.HARD_FILLERS, *V.STOPWORDS])})) = 0
    AND len(list_filter(said, lambda x: regexp_matches(x, {weak}))) > 0 END AS alone FROM s)
SELECT conv_id, turn, strong, alone FROM a WHERE strong OR alone"""


def _found() -> str:
    """All kinds of hesitations in order, as ``fo``; ``dg`` goes through an utterance's candidates of repeats, the longest group and then the earliest first."""
    longest = max(len(p.split()) for p in L.FILLER_PHRASES)
    o = "PARTITION BY rush_id, run, part ORDER BY idx"
    ahead = ", ".join(f"lead(norm, {k}) OVER o AS w{k}" if k else "norm AS w0" for k in range(longest))
    fits = " ".join("WHEN " + " AND ".join(f"w{k} = {q(x)}" for k, x in enumerate(p.split())) + f" AND said > {len(p.split())} THEN {len(p.split())}" for p in L.FILLER_PHRASES)
    same = ", ".join(f"coalesce(lead(norm, {n}) OVER v = norm, false) AS s{n}, lead(start_ms, {n}) OVER v - {f'lead(end_ms, {n - 1}) OVER v' if n > 1 else 'end_ms'} AS g{n}" for n in (1, 2, 3))
    alike = ", ".join(f"min(CASE WHEN NOT s{n} THEN p END) OVER (PARTITION BY rush_id, run, part ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - p AS r{n}" for n in (1, 2, 3))
    meant = among([*L.INTENSIFIERS, *L.GRAMMATICAL_DOUBLES])
    groups = " UNION ALL ".join(f"SELECT rush_id, run, part, {n} AS n, p AS a, p + {n} * (1 + r{n} // {n}) AS b FROM alike WHERE r{n} >= {n} AND g{n} <= 900" + (f" AND norm NOT IN {meant}" if n == 1 else "") for n in (1, 2, 3))
    shown = f"rtrim(trim(text), {q(chr(34) + chr(39) + '»)]….')})"
    return f"""WITH RECURSIVE {on_turns(SPOKEN)},
ka AS (SELECT rush_id, run, part, idx, text, norm, start_ms, end_ms, stem, target, ahead, said, row_number() OVER o - 1 AS k, {ahead} FROM uw WINDOW o AS ({o})),
kb AS (SELECT *, CASE {fits} ELSE 0 END AS phrase FROM ka),
kc AS (SELECT *, max(k + phrase) OVER ({o} ROWS BETWEEN {longest - 1} PRECEDING AND CURRENT ROW) > k AS in_phrase FROM kb),
kd AS (SELECT *, CASE WHEN NOT in_phrase AND norm IN {among(L.HARD_FILLERS)} AND end_ms - start_ms <= 1200 THEN CASE WHEN length(norm) <= 4 THEN 0.95::DOUBLE ELSE 0.88::DOUBLE END END AS filler FROM kc),
ke AS MATERIALIZED (SELECT *, in_phrase OR filler IS NOT NULL AS masked FROM kd),
pl AS MATERIALIZED (SELECT *, row_number() OVER ({o}) - 1 AS p FROM ke WHERE NOT masked AND norm <> ''),
sa AS (SELECT *, {same} FROM pl WINDOW v AS ({o})), alike AS MATERIALIZED (SELECT *, {alike} FROM sa),
ca AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rush_id, run, part ORDER BY n DESC, a) AS i FROM ({groups})),
dg AS (SELECT rush_id, run, part, i, [{{'n': n, 'a': a, 'b': b}}] AS got FROM ca WHERE i = 1
  UNION ALL SELECT ca.rush_id, ca.run, ca.part, ca.i, CASE WHEN len(list_filter(got, lambda x: x.b > ca.a AND x.a < ca.a + 2 * ca.n)) = 0 THEN list_append(got, {{'n': ca.n, 'a': ca.a, 'b': ca.b}}) ELSE got END
  FROM dg JOIN ca ON ca.rush_id = dg.rush_id AND ca.run = dg.run AND ca.part = dg.part AND ca.i = dg.i + 1),
gb AS (SELECT rush_id, run, part, unnest(arg_max(got, i)) AS x FROM dg GROUP BY rush_id, run, part),
st AS MATERIALIZED (SELECT gb.rush_id, gb.run, gb.part, x, list(idx ORDER BY p) FILTER (p >= x.b - x.n - 4 AND p < x.b - x.n) AS words, min(start_ms) FILTER (p >= x.b - x.n - 4 AND p < x.b - x.n) AS start_ms,
  max(end_ms) FILTER (p < x.b - x.n) AS end_ms, string_agg(trim(text), ' ' ORDER BY p) FILTER (p >= x.b - x.n - 4 AND p < x.b - x.n) AS text, string_agg(trim(text), ' ' ORDER BY p) FILTER (p >= x.b - x.n) AS kept_text
  FROM gb JOIN pl ON pl.rush_id = gb.rush_id AND pl.run = gb.run AND pl.part = gb.part AND p >= x.a AND p < x.b GROUP BY ALL),
sw AS (SELECT DISTINCT rush_id, unnest(words) AS idx FROM st),
kf AS MATERIALIZED (SELECT *, masked OR (rush_id, idx) IN (SELECT rush_id, idx FROM sw) AS taken, trim(lead(text) OVER o) AS next_text FROM ke WINDOW o AS ({o})),
ab AS (SELECT *, right({shown}, 1) IN ('-', '_') AND length({shown}) > 1 AS marked, lead(taken) OVER ({o}) AS next_taken FROM kf),
ac AS MATERIALIZED (SELECT *, CASE WHEN marked AND ahead <= 600 THEN 0.93::DOUBLE WHEN NOT marked AND ahead <= 250 AND length(stem) <= 5 AND length(target) >= length(stem) + 2 AND stem NOT IN {among([*L.COMMON_SHORT_WORDS, *V.STOPWORDS])} THEN 0.66::DOUBLE END AS c
  FROM ab WHERE NOT taken AND NOT next_taken AND length(stem) >= 2 AND starts_with(target, stem) AND length(target) > length(stem) AND end_ms - start_ms <= 850),
em AS (SELECT rush_id, run, part FROM kf LEFT JOIN (SELECT rush_id, idx, true AS up FROM ac WHERE c IS NOT NULL) USING (rush_id, idx) GROUP BY rush_id, run, part
  HAVING bool_and(taken OR norm = '' OR coalesce(up, false)) AND bool_or(length(norm) > 1 AND norm NOT IN {among([*V.STOPWORDS, *L.HARD_FILLERS])})),
fo AS (SELECT rush_id, 'filler' AS kind, [idx] AS words, start_ms, end_ms, filler AS confidence, trim(text) AS text, '' AS kept_text FROM ke WHERE filler IS NOT NULL
UNION ALL SELECT a.rush_id, 'filler_phrase', list(b.idx ORDER BY b.k), min(b.start_ms), max(b.end_ms), 0.8::DOUBLE, string_agg(trim(b.text), ' ' ORDER BY b.k), '' FROM ke a JOIN ke b ON b.rush_id = a.rush_id AND b.run = a.run AND b.part = a.part AND b.k >= a.k AND b.k < a.k + a.phrase WHERE a.phrase > 0 GROUP BY a.rush_id, a.idx
UNION ALL SELECT rush_id, 'stutter', words, start_ms, end_ms, CASE WHEN x.n = 1 THEN 0.92::DOUBLE ELSE 0.86::DOUBLE END, text, kept_text FROM st ANTI JOIN em USING (rush_id, run, part)
UNION ALL SELECT rush_id, 'abandoned', [idx], start_ms, end_ms, c, trim(text), next_text FROM ac WHERE c IS NOT NULL)"""


def _disfluencies() -> str:
    return _found() + " SELECT rush_id, kind, array_to_string(words, ' ') AS words, start_ms, end_ms, confidence, text, kept_text FROM fo"


def least_shots(source: str, ends: str, least: int, changes: int = 60) -> str:
    """``ls`` (rush_id, a, b): intervals of ``source`` (rush_id, a, b) in [0, total of ``ends``], of ``least`` at least; one change of a recording in each step."""
    near = f"""SELECT *, s[k].a AS a, s[k].b AS b, greatest(0, s[k].a - CASE WHEN k > 1 THEN s[k - 1].b ELSE 0 END) AS lft, greatest(0, CASE WHEN k < len(s) THEN s[k + 1].a ELSE total END - s[k].b) AS rgt, {least} - (s[k].b - s[k].a) AS short
    FROM (SELECT *, list_position(list_transform(s, lambda x: x.b - x.a < {least}), true) AS k FROM lx WHERE step < {changes}) WHERE k > 0"""
    grown = "greatest(least(lft, short // 2), short - rgt)"
    return f"""l0 AS (SELECT rush_id, total, list({{'a': CAST(a AS BIGINT), 'b': CAST(b AS BIGINT)}} ORDER BY a) AS s FROM {source} JOIN {ends} USING (rush_id) GROUP BY rush_id, total),
lx AS (SELECT rush_id, CAST(total AS BIGINT) AS total, s, 0 AS step FROM l0
  UNION ALL SELECT rush_id, total, CASE WHEN lft + rgt >= short THEN s[:k - 1] || [{{'a': CAST(a - {grown} AS BIGINT), 'b': CAST(b + short - {grown} AS BIGINT)}}] || s[k + 1:]
    WHEN k > 1 AND (k = len(s) OR lft <= rgt) THEN s[:k - 2] || [{{'a': s[k - 1].a, 'b': b}}] || s[k + 1:] WHEN k < len(s) THEN s[:k - 1] || [{{'a': a, 'b': s[k + 1].b}}] || s[k + 2:] ELSE s[:k - 1] END, step + 1
  FROM ({near})),
ls AS (SELECT rush_id, x.a AS a, x.b AS b FROM (SELECT rush_id, unnest(arg_max(s, step)) AS x FROM lx GROUP BY rush_id) WHERE x.b > x.a)"""


def _minimum_shots() -> str:
    return f"""WITH RECURSIVE {SHOTS}, sk AS (SELECT rush_id, "start" AS a, "end" AS b FROM sh), en AS (SELECT rush_id, max(end_ms) AS total FROM w GROUP BY rush_id),
{least_shots("sk", "en", 1000)} SELECT rush_id, a AS "start", b AS "end" FROM ls"""


def marked(norm: str) -> tuple[str, str]:
    """(strong, alone) of a normal text."""
    said = f"list_filter(string_split({norm}, ' '), lambda x: x <> '')"
    strong, weak = f"regexp_matches({norm}, {q(M.STRONG)})", q(M._WEAK_WORD)
    alone = f"""CASE WHEN len({said}) = 0 THEN false WHEN {norm} IN {among(V.STANDALONE_MARKERS)} THEN true
  WHEN {strong} THEN len(list_filter(regexp_split_to_array(regexp_replace({norm}, {q(M.STRONG)}, ' ', 'g'), ' +'), lambda x: {CONTENT})) = 0
  ELSE len({said}) <= 4 AND len(list_filter({said}, lambda x: NOT regexp_matches(x, {weak}) AND x NOT IN {among([*L.HARD_FILLERS, *V.STOPWORDS])})) = 0
    AND len(list_filter({said}, lambda x: regexp_matches(x, {weak}))) > 0 END"""
    return strong, alone


def _edit(select: str) -> str:
    """The edit of hesitations and lone strong markers: ``re`` removals, ``es`` shots, ``ew`` removed words with ``up`` (survives) and ``light``."""
    strong, alone = marked("nt")
    return f"""{_found()},
mk AS (SELECT rush_id, run, part, list(idx ORDER BY idx) AS words, min(start_ms) AS start_ms, max(end_ms) AS end_ms, {normal_text("string_agg(text, ' ' ORDER BY idx)")} AS nt FROM m GROUP BY rush_id, run, part),
rf AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rush_id, start_ms, end_ms, kind) AS id, * FROM (SELECT rush_id, kind, words, start_ms, end_ms, confidence FROM fo
  UNION ALL SELECT rush_id, 'marker', words, start_ms, end_ms, 0.88::DOUBLE FROM mk WHERE {strong} AND {alone})),
rw AS MATERIALIZED (SELECT id, rush_id, kind <> 'marker' AS light, unnest(words) AS idx FROM rf WHERE confidence >= 0.6),
gw AS (SELECT DISTINCT rush_id, idx, true AS gone FROM rw),
a AS (SELECT rush_id, idx, text, start_ms, end_ms, lag(end_ms) OVER o AS any_end, lead(start_ms) OVER o AS any_start, max(end_ms) OVER (PARTITION BY rush_id) AS total, coalesce(gone, false) AS gone FROM w LEFT JOIN gw USING (rush_id, idx) WINDOW o AS (PARTITION BY rush_id ORDER BY idx)),
{SILENCE_STEPS},
ec AS MATERIALIZED (SELECT rush_id, cut_start AS a, cut_end AS b, kind FROM f WHERE cut_start IS NOT NULL),
en AS (SELECT rush_id, max(end_ms) AS total FROM w GROUP BY rush_id),
ez AS (SELECT rush_id, a, lag(b) OVER (PARTITION BY rush_id ORDER BY a, b) AS prev FROM (SELECT rush_id, a, b FROM ec UNION ALL SELECT rush_id, total, NULL FROM en)),
sk AS (SELECT rush_id, coalesce(prev, 0) AS a, a AS b FROM ez WHERE a > coalesce(prev, 0)),
{least_shots("sk", "en", 1000)},
es AS MATERIALIZED (SELECT ls.rush_id, row_number() OVER o - 1 AS shot, ls.a, ls.b, CAST(sum(ls.b - ls.a) OVER o - (ls.b - ls.a) AS BIGINT) AS timeline_start, ec.kind AS after FROM ls LEFT JOIN ec ON ec.rush_id = ls.rush_id AND ec.b = ls.a WINDOW o AS (PARTITION BY ls.rush_id ORDER BY ls.a)),
ew AS MATERIALIZED (SELECT rush_id, idx, light, EXISTS (SELECT 1 FROM es WHERE es.rush_id = x.rush_id AND x.start_ms + x.end_ms BETWEEN 2 * es.a AND 2 * es.b) AS up FROM (SELECT rush_id, idx, bool_or(light) AS light, any_value(w.start_ms) AS start_ms, any_value(w.end_ms) AS end_ms FROM rw JOIN w USING (rush_id, idx) GROUP BY rush_id, idx) x),
wd AS (SELECT DISTINCT id FROM rw JOIN ew USING (rush_id, idx) WHERE up),
re AS (SELECT rush_id, kind, words, start_ms, end_ms, confidence, confidence >= 0.6 AND wd.id IS NULL AS applied, wd.id IS NOT NULL AS withdrawn FROM rf LEFT JOIN wd ON wd.id = rf.id)
{select}"""


def seam_steps(short: int, apart: int) -> str:
    """``sq``: joints of shots ``sx`` (rush_id, shot, a, b), from words ``wx`` with gone and light."""
    content = lambda x: f"list_filter(list_transform({x}, lambda z: z.norm), lambda x: {CONTENT})"
    return f"""wr AS (SELECT *, sum(CASE WHEN light THEN 0 ELSE 1 END) OVER (PARTITION BY rush_id ORDER BY idx) AS r FROM wx),
hd AS (SELECT sx.rush_id, shot, list({{'norm': norm, 'text': text, 'r': r}} ORDER BY idx) AS said FROM wr JOIN sx ON sx.rush_id = wr.rush_id AND start_ms + end_ms BETWEEN 2 * a AND 2 * b WHERE NOT gone GROUP BY sx.rush_id, shot),
sv AS (SELECT sx.*, said, lag(said) OVER o AS before, lag(b - a) OVER o AS took FROM sx LEFT JOIN hd USING (rush_id, shot) WINDOW o AS (PARTITION BY rush_id ORDER BY shot)),
sw2 AS (SELECT *, before[-1].text AS p, before[-1].norm AS last_norm, said[1].norm AS first_norm, coalesce(said[1].r - before[-1].r > 1, false) AS harmed FROM sv),
sy AS (SELECT *, harmed AND NOT coalesce({SENTENCE}, false) AS open_end FROM sw2),
sq AS (SELECT rush_id, shot, CASE WHEN last_norm IN {among(V.DANGLING)} THEN 'dangling end' ELSE 'awkward start' END AS category, 'medium' AS severity FROM sy WHERE open_end AND (last_norm IN {among(V.DANGLING)} OR first_norm IN {among(V.CANNOT_START)})
UNION ALL SELECT rush_id, shot, 'repeated word', 'low' FROM sy WHERE harmed AND list_has_any({content("before[greatest(1, len(before) - 3):]")}, {content("said[:4]")})
UNION ALL SELECT rush_id, shot - 1, 'close cuts', 'low' FROM sy WHERE shot >= 2 AND said IS NOT NULL AND before IS NOT NULL AND took < {apart}
UNION ALL SELECT rush_id, shot, 'short shot', 'low' FROM sy WHERE b - a < {short})"""


def _seam_checks() -> str:
    hard = among(L.HARD_FILLERS)
    return f"""WITH {GAPS}, hf AS (SELECT rush_id, idx, start_ms, end_ms FROM w WHERE norm IN {hard} AND end_ms - start_ms <= 1200),
ct AS (SELECT rush_id, "start" + floor((duration - removed) * 55 / 100) AS a, "end" - ((duration - removed) - floor((duration - removed) * 55 / 100)) AS b FROM gp WHERE removed > 0 UNION ALL SELECT rush_id, start_ms, end_ms FROM hf),
cf AS (SELECT *, max(b) OVER (PARTITION BY rush_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ct),
ci AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far THEN 1 ELSE 0 END) OVER (PARTITION BY rush_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM cf), cm AS (SELECT rush_id, min(a) AS a, max(b) AS b FROM ci GROUP BY rush_id, island),
cz AS (SELECT rush_id, a, lag(b) OVER (PARTITION BY rush_id ORDER BY a) AS prev FROM (SELECT * FROM cm UNION ALL SELECT rush_id, max(end_ms), NULL FROM w GROUP BY rush_id)),
sx AS MATERIALIZED (SELECT rush_id, row_number() OVER (PARTITION BY rush_id ORDER BY a) - 1 AS shot, CAST(coalesce(prev, 0) AS BIGINT) AS a, CAST(a AS BIGINT) AS b FROM cz WHERE a > coalesce(prev, 0)),
wx AS (SELECT w.*, hf.idx IS NOT NULL AS gone, hf.idx IS NOT NULL AS light FROM w LEFT JOIN hf USING (rush_id, idx)),
{seam_steps(550, 750)} SELECT rush_id, shot, category, severity FROM sq"""


def _edit_seams() -> str:
    return _edit("SELECT rush_id, shot, category, severity FROM sq").replace("\nSELECT rush_id, shot, category", f""",
sx AS (SELECT rush_id, shot, a, b FROM es), wx AS (SELECT w.*, ew.idx IS NOT NULL AS gone, coalesce(ew.light, false) AS light FROM w LEFT JOIN (SELECT rush_id, idx, light FROM ew WHERE NOT up) ew USING (rush_id, idx)),
{seam_steps(1500, 2500)}
SELECT rush_id, shot, category""")


EDIT_DECISIONS = "SELECT rush_id, kind AS source, start_ms, end_ms, confidence, array_to_string(words, ' ') AS words, applied, false AS limited, withdrawn FROM re"
EDIT_SHOTS = 'SELECT rush_id, shot, a AS "start", b AS "end", timeline_start, after FROM es'
EDIT_SETS = """SELECT rush_id, kind, "start", "end", NOT heavy AS inside FROM (SELECT rush_id, kind, CAST(min(idx) AS BIGINT) AS "start", CAST(max(idx) + 1 AS BIGINT) AS "end" FROM (
  SELECT rush_id, kind, idx, idx - row_number() OVER (PARTITION BY rush_id, kind ORDER BY idx) AS g FROM (SELECT rush_id, 'removed' AS kind, idx FROM ew WHERE NOT up UNION ALL SELECT rush_id, 'benign', idx FROM ew WHERE NOT up AND light)) GROUP BY rush_id, kind, g)
  JOIN (SELECT rush_id, bool_or(NOT light) AS heavy FROM ew WHERE NOT up GROUP BY rush_id) USING (rush_id)"""


def _curves() -> str:
    soft = lambda t: f"({t}) * ({t}) * ({t}) * (({t}) * (({t}) * 6 - 15) + 10)"
    expo = lambda t: f"(1 - exp(-4.0::DOUBLE * ({t}))) / (1 - exp(-4.0::DOUBLE))"
    thrown = f"CASE WHEN x <= 0.55 THEN 1.11 * {expo('x / 0.55::DOUBLE')} ELSE 1.11 - 0.11 * {soft('(x - 0.55::DOUBLE) / 0.45::DOUBLE')} END"
    known = {"linear": "x", "smoothstep": "x * x * (3 - 2 * x)", "smootherstep": soft("x"), "progressive": f"0.72 * x + 0.28 * {soft('x')}", "ease_out_expo": expo("x"), "ballistic": thrown}
    return "SELECT k, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {n}" for n, v in known.items()) + " FROM (SELECT o_orderkey AS k, (o_orderkey % 101) / 100.0::DOUBLE AS x FROM orders)"


EDL = f"""WITH {SHOTS}, times AS (SELECT rush_id, shot, [CAST(round_even(v * 25 / 1000.0, 0) AS BIGINT) FOR v IN ["start", "end", timeline_start, timeline_start + "end" - "start"]] AS n FROM sh),
codes AS (SELECT rush_id, shot, list_transform(n, lambda f: printf('%02d:%02d:%02d:%02d', f // 90000, (f // 1500) % 60, (f // 25) % 60, f % 25)) AS c FROM times)
SELECT rush_id, 'TITLE: rush' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10)
  || string_agg(printf('%03d  AX       AA/V  C        ', shot + 1) || array_to_string(c, ' ') || chr(10), chr(10) ORDER BY shot) AS edl FROM codes GROUP BY rush_id"""


#: From words (rush_id, idx, text, start_ms, end_ms, any_end, any_start, total, gone) ``a`` to gaps ``f``.
SILENCE_STEPS = f"""k AS (SELECT *, lag(idx) OVER o AS p_idx, lag(text) OVER o AS p, lag(end_ms) OVER o AS p_end, lag(any_start) OVER o AS p_any, lead(idx) OVER o AS next_idx FROM a WHERE NOT gone WINDOW o AS (PARTITION BY rush_id ORDER BY idx)),
i AS (SELECT *, start_ms - p_end AS d, idx <> p_idx + 1 AS holds, least(120, greatest(greatest(0, least(p_any, start_ms) - p_end), 60)) AS o0, least(70, greatest(greatest(0, start_ms - greatest(any_end, p_end)), 60)) AS i0 FROM k WHERE p_idx IS NOT NULL AND start_ms > p_end),
j AS (SELECT *, CASE WHEN holds THEN 'removed speech' WHEN d <= 300 THEN 'short' WHEN d >= 950 THEN 'long' WHEN {SENTENCE} THEN 'sentence' WHEN {CLAUSE} THEN 'comma' ELSE 'hesitation' END AS kind, greatest(0, d - 90) AS budget FROM i),
h AS (SELECT *, least(d, greatest(CASE kind WHEN 'short' THEN d WHEN 'long' THEN 300 WHEN 'sentence' THEN 340 WHEN 'comma' THEN 200 ELSE 220 END, least(d, 190))) AS plain FROM j),
g AS (SELECT *, CASE WHEN NOT holds THEN floor(plain * 55 / 100) WHEN o0 + i0 > budget THEN floor(o0 * budget / (o0 + i0)) ELSE o0 END AS co, CASE WHEN NOT holds THEN plain - floor(plain * 55 / 100) WHEN o0 + i0 > budget THEN floor(i0 * budget / (o0 + i0)) ELSE i0 END AS ci FROM h),
c AS (SELECT *, d - co - ci > 0 AND (holds OR d - co - ci >= 90) AS cut FROM g),
f AS (SELECT rush_id, p_end AS "start", start_ms AS "end", kind, CASE WHEN cut THEN co + ci ELSE d END AS kept, CASE WHEN cut THEN p_end + co END AS cut_start, CASE WHEN cut THEN start_ms - ci END AS cut_end, holds AS holds_removed FROM c WHERE cut OR d >= 120 OR holds
UNION ALL SELECT rush_id, 0, start_ms, 'edge', least(250, greatest(0, start_ms - coalesce(any_end, 0))), 0, greatest(0, start_ms - least(250, greatest(0, start_ms - coalesce(any_end, 0)))), idx > 0 FROM k
  WHERE p_idx IS NULL AND start_ms > 340 AND start_ms - least(250, greatest(0, start_ms - coalesce(any_end, 0))) > 90
UNION ALL SELECT rush_id, end_ms, total, 'edge', least(250, greatest(0, coalesce(any_start, total) - end_ms)), end_ms + least(250, greatest(0, coalesce(any_start, total) - end_ms)), total, any_start IS NOT NULL FROM k
  WHERE next_idx IS NULL AND total - end_ms > 340 AND total - end_ms - least(250, greatest(0, coalesce(any_start, total) - end_ms)) > 90)"""


def _silences() -> str:
    hard = among(L.HARD_FILLERS)
    return f"""WITH {WORDS},
a AS (SELECT rush_id, idx, text, start_ms, end_ms, lag(end_ms) OVER o AS any_end, lead(start_ms) OVER o AS any_start, max(end_ms) OVER (PARTITION BY rush_id) + 800 AS total, norm IN {hard} AND end_ms - start_ms <= 1200 AS gone FROM w WINDOW o AS (PARTITION BY rush_id ORDER BY idx)),
{SILENCE_STEPS}
SELECT rush_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", kind, CAST(kept AS BIGINT) AS kept, CAST(cut_start AS BIGINT) AS cut_start, CAST(cut_end AS BIGINT) AS cut_end, holds_removed FROM f"""


def _shot_scores() -> str:
    return f"""WITH {SHOTS},
x AS (SELECT rush_id, idx, text, norm, (start_ms + end_ms) / 2.0 AS mid FROM w),
s AS (SELECT sh.rush_id, sh.shot, list(x.norm ORDER BY idx) FILTER (idx IS NOT NULL) AS norms, min(idx) AS first_idx, max(idx) AS last_idx, arg_max(text, idx) AS last_text, any_value(sh."end" - sh."start") / 1000.0::DOUBLE AS sec
  FROM sh LEFT JOIN x ON x.rush_id = sh.rush_id AND x.mid BETWEEN sh."start" AND sh."end" GROUP BY sh.rush_id, sh.shot),
b AS (SELECT *, lag(last_idx) OVER o AS before, lag(last_text) OVER o AS p FROM s WINDOW o AS (PARTITION BY rush_id ORDER BY shot)),
f AS (SELECT *, norms IS NOT NULL AND (before IS NULL OR {SENTENCE} OR {SUSPENSION}) AS fresh FROM b),
tg AS (SELECT rush_id, shot, norms, sec, fresh, last_text AS p, norms IS NOT NULL AND NOT fresh AND first_idx <> before + 1 AS cut FROM f)
SELECT rush_id, shot, concat_ws(',', CASE WHEN norms IS NULL THEN 'silent' END, CASE WHEN fresh THEN 'sentence start' WHEN cut THEN 'after cut' END, CASE WHEN norms IS NOT NULL AND {SENTENCE} THEN 'sentence end' END, CASE WHEN norms IS NOT NULL AND sec >= 6 THEN 'long' END) AS tags,
  round(CASE WHEN norms IS NULL OR sec < 0.8 THEN -5.0::DOUBLE ELSE CASE WHEN len(list_filter(norms[1:4], lambda z: z IN {among(V.IDEA_SHIFTS)})) > 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(norms, lambda z: z IN {among(V.EMPHASIS)})) > 0 THEN 0.45::DOUBLE ELSE 0 END
    + CASE WHEN fresh THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN sec >= 5 THEN least(0.5::DOUBLE, 0.5::DOUBLE * (sec - 5) / 12 + 0.16::DOUBLE) ELSE 0 END + CASE WHEN cut THEN -0.45::DOUBLE ELSE 0 END + 0.25::DOUBLE * least(1.0::DOUBLE, sec / 6) END, 6) AS score FROM tg"""


def _numbers() -> str:
    rates = ", ".join(f"({k}, {b}, {str(s).lower()}, {round(b * 1000 / 1001 if s else float(b), 3)}::DOUBLE)" for k, (b, s) in enumerate(RATES))
    return f"""WITH g AS (SELECT o_orderkey AS k, (o_orderkey % 600) / 4.0::DOUBLE AS x FROM orders), rates(i, base, slowed, fps) AS (VALUES {rates}),
b AS (SELECT k, base, slowed, abs(fps - x) AS off, row_number() OVER (PARTITION BY k ORDER BY abs(fps - x), i) AS nth FROM g CROSS JOIN rates),
s AS (SELECT g.k, x, base, slowed, off, x * 37 AS sec, CAST(round_even(x * 37, 0) AS BIGINT) AS n FROM g JOIN b ON b.k = g.k AND nth = 1)
SELECT k, CASE WHEN sec < 60 THEN printf('%.1f s', sec) WHEN n < 3600 THEN printf('%d min %02d s', n // 60, n % 60) ELSE printf('%d h %02d min', n // 3600, (n // 60) % 60) END AS duration,
  round(4 + 16 * greatest(0, least(1, (x - 10) / 90)), 6) AS mapped, CAST(CASE WHEN x <= 0 THEN 25 WHEN off <= 0.08 THEN base ELSE greatest(1, round_even(x, 0)) END AS INTEGER) AS base,
  x > 0 AND off <= 0.08 AND slowed AS slowed, k * 254016000 AS ticks, greatest(0, least(k + 10, 90) - greatest(k, 50)) AS shared,
  CASE WHEN sec * 1000 < 3600000 THEN printf('%02d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) ELSE printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) END AS code,
  round(k / 1001.0::DOUBLE, 6) AS ratio, greatest(20, least(k % 100, 70)) AS held, CAST((k % 5) * 3600 + (k % 60) * 60 + (k * 7) % 60 AS DOUBLE) AS seconds,
  CASE WHEN k % 4 IN (1, 3) THEN k % 1080 ELSE k % 1920 END AS width, CASE WHEN k % 4 IN (1, 3) THEN k % 1920 ELSE k % 1080 END AS height FROM (SELECT *, CAST(round_even(sec * 1000, 0) AS BIGINT) AS ms FROM s)"""


def _content_loss() -> str:
    own = lambda table, i: f"SELECT {i}, list_distinct(list_filter({TOKENS}, lambda x: {CONTENT})) AS w FROM {table}"
    heavy = f"CASE WHEN w IN {among(L.COMMON_SHORT_WORDS)} THEN 35 ELSE 100 END"
    return f"""WITH b AS ({own("benchmark", "item_id")}), d AS ({own("documents", "doc_id")}), x AS (SELECT item_id, unnest(w) AS w FROM b), y AS (SELECT doc_id, unnest(w) AS w FROM d),
n AS (SELECT item_id, count(*) AS n, sum({heavy}) AS whole FROM x GROUP BY item_id), s AS (SELECT item_id, doc_id, count(*) AS shared, sum({heavy}) AS got FROM x JOIN y USING (w) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CAST(shared AS INTEGER) AS shared, CAST(n - shared AS INTEGER) AS lost, round(got / whole, 6) AS containment FROM s JOIN n USING (item_id) WHERE got >= 0.25 * whole"""


def _align() -> str:
    """``z`` goes through the words of the first utterance; its list holds the row of the matrix before."""
    stem = f"CASE WHEN regexp_matches(x, {q(_STEM)}) THEN regexp_extract(x, {q(_STEM)}, 1) ELSE x END"
    heavy = f"CASE WHEN length(x) < 2 OR x IN {among([*V.STOPWORDS, *L.HARD_FILLERS])} THEN 0.15::DOUBLE WHEN x IN {among(L.COMMON_SHORT_WORDS)} THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END"
    short = "least(length(x.w), length(y.w))"
    n = f"greatest(4, CAST(ceil({short} * 0.70::DOUBLE - 1e-9) AS INTEGER))"
    degree = f"CASE WHEN x.w = y.w THEN 1.0::DOUBLE WHEN x.stem = y.stem THEN 0.92::DOUBLE WHEN {short} >= {n} AND left(x.w, {n}) = left(y.w, {n}) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""WITH RECURSIVE {on_turns(UTTERANCES.removeprefix("WITH ").rsplit("SELECT rush_id, row_number()", 1)[0].rstrip())},
uu AS MATERIALIZED (SELECT rush_id, row_number() OVER (PARTITION BY rush_id ORDER BY first_idx) - 1 AS utt_id, list_transform({TOKENS}, lambda x: {{'w': x, 'stem': {stem}, 'heavy': {heavy}}}) AS w FROM s),
pa AS MATERIALIZED (SELECT a.rush_id, a.utt_id AS a, b.utt_id AS b, a.w, b.w AS v FROM uu a JOIN uu b ON b.rush_id = a.rush_id AND b.utt_id BETWEEN a.utt_id + 1 AND a.utt_id + 3),
z AS (SELECT rush_id, a, b, 1 AS i, list_transform(range(0, len(v) + 1), lambda j: 0.0::DOUBLE) AS row FROM pa WHERE len(w) > 0 AND len(v) > 0
  UNION ALL SELECT rush_id, a, b, i + 1, [0.0::DOUBLE] || list_transform(range(1, len(top) + 1), lambda j: list_max(top[:j]))
  FROM (SELECT z.rush_id, z.a, z.b, i, list_transform(range(1, len(v) + 1), lambda j: greatest(row[j + 1], gains[j] * CASE WHEN gains[j] > 0 THEN 1 ELSE 0 END + CASE WHEN gains[j] > 0 THEN row[j] ELSE 0 END)) AS top
    FROM (SELECT *, list_transform(v, lambda y: {degree} * x.heavy) AS gains FROM (SELECT z.*, v, w[i] AS x FROM z JOIN pa ON pa.rush_id = z.rush_id AND pa.a = z.a AND pa.b = z.b WHERE i <= len(w))) z)),
ze AS (SELECT rush_id, a, b, arg_max(row, i)[-1] AS got FROM z GROUP BY rush_id, a, b)
SELECT pa.rush_id, pa.a, pa.b, round(coalesce(got / list_sum(list_transform(w, lambda x: x.heavy)), 0), 6) AS align FROM pa LEFT JOIN ze ON ze.rush_id = pa.rush_id AND ze.a = pa.a AND ze.b = pa.b"""


def _utterance_language() -> str:
    strong, alone = marked("nt")
    words = f"list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda y: {normal('y')}), lambda y: y <> '')"
    return f"""WITH {on_turns(UTTERANCES.removeprefix("WITH ").rsplit("SELECT rush_id, row_number()", 1)[0].rstrip())},
lg AS (SELECT rush_id, run, part, CASE (length(text) + idx) % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' END AS language, count(*) AS n, min(idx) AS early FROM m GROUP BY ALL),
lb AS (SELECT rush_id, run, part, language FROM (SELECT *, row_number() OVER (PARTITION BY rush_id, run, part ORDER BY n DESC, early) AS nth FROM lg WHERE language IS NOT NULL) WHERE nth = 1),
ua AS (SELECT s.*, row_number() OVER (PARTITION BY rush_id ORDER BY first_idx) - 1 AS utt_id, regexp_split_to_array(trim(text), '\\s+')[-1] AS p, {words} AS said, {normal_text('text')} AS nt FROM s),
ub AS (SELECT *, {SENTENCE} AS terminal, {SUSPENSION} AS suspended, right(trim(p), 1) IN ('-', '_') AND length(trim(p)) > 1 AS truncated, len(list_filter(said, lambda x: {CONTENT})) AS n_content FROM ua),
uc AS (SELECT *, coalesce(said[-1] IN {among(V.DANGLING)}, false) AND NOT terminal AS dangling, {alone} AS alone FROM ub)
SELECT rush_id, utt_id, language, round(greatest(0, least(1, CASE WHEN terminal THEN 0.42::DOUBLE ELSE 0 END + CASE WHEN dangling THEN 0 ELSE 0.18::DOUBLE END + CASE WHEN truncated THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN suspended THEN 0 ELSE 0.1::DOUBLE END
  + least(0.2::DOUBLE, 0.028::DOUBLE * n_content) - CASE WHEN alone THEN 0.45::DOUBLE ELSE 0 END)), 6) AS completeness FROM uc LEFT JOIN lb USING (rush_id, run, part)"""


def _marker_splits() -> str:
    strong, alone = marked("head")
    steps = UTTERANCES.removeprefix("WITH ").rsplit("s AS (SELECT", 1)[0].rstrip().removesuffix(",")
    head = normal_text("array_to_string(list_transform(s[1:n], lambda x: trim(x.text)), ' ')")
    return f"""WITH {on_turns(steps)},
gs AS MATERIALIZED (SELECT rush_id, run, part, list({{'idx': idx, 'text': text, 'start_ms': start_ms, 'end_ms': end_ms}} ORDER BY idx) AS s, CASE WHEN part > 0 THEN 'length' ELSE arg_min(reason, idx) END AS reason FROM m GROUP BY rush_id, run, part),
hn AS (SELECT rush_id, run, part, n, {head} AS head FROM (SELECT *, unnest([2, 3, 4, 5, 6]) AS n FROM gs) WHERE len(s) >= greatest(4, n + 2)),
hm AS (SELECT rush_id, run, part, max(n) AS n FROM hn WHERE {strong} AND {alone} GROUP BY rush_id, run, part),
ht AS (SELECT rush_id, run, part, s, reason, n FROM gs LEFT JOIN hm USING (rush_id, run, part)),
hp AS (SELECT rush_id, reason, CASE WHEN n IS NULL THEN s ELSE s[1:n] END AS s FROM ht UNION ALL SELECT rush_id, 'marker', s[n + 1:] FROM ht WHERE n IS NOT NULL),
hu AS (SELECT rush_id, s[1].idx AS first_idx, len(s) AS n_words, s[1].start_ms AS start_ms, list_max(list_transform(s, lambda x: x.end_ms)) AS end_ms, reason, array_to_string(list_transform(s, lambda x: x.text), ' ') AS text FROM hp)
SELECT rush_id, row_number() OVER o - 1 AS utt_id, first_idx, n_words, start_ms, end_ms, reason, greatest(0, coalesce(start_ms - lag(end_ms) OVER o, start_ms)) AS gap_before, greatest(0, coalesce(lead(start_ms) OVER o - end_ms, 0)) AS gap_after, text FROM hu WINDOW o AS (PARTITION BY rush_id ORDER BY first_idx)"""


RANGES = {
    "range_assign": """WITH e AS (SELECT user_id % 50 AS k, event_id, CAST(floor(epoch(ts)) AS BIGINT) % 864000 AS t FROM events), o AS (SELECT o_custkey % 50 AS k, o_orderkey, o_orderkey * 977 % 864000 AS a FROM orders)
SELECT event_id, count(*) AS n, arg_min(o_orderkey, (a, o_orderkey)) AS first_order FROM e JOIN o ON o.k = e.k AND t BETWEEN a AND a + 600 + o_orderkey % 7200 GROUP BY event_id""",
    "instants": f"""WITH u AS ({UTTERANCES}), t AS (SELECT rush_id, unnest(range(0, CAST(max(end_ms) AS BIGINT) + 1, 5000)) AS t FROM u GROUP BY rush_id)
SELECT t.rush_id, t.t, min(utt_id) AS utt_id FROM t LEFT JOIN u ON u.rush_id = t.rush_id AND t.t BETWEEN start_ms AND end_ms GROUP BY t.rush_id, t.t""",
    "window_words": f"""WITH {WORDS}, c AS (SELECT rush_id, idx, start_ms + end_ms AS t FROM w), b AS (SELECT rush_id, unnest(range(0, max(t) + 1, 10000)) AS a FROM c GROUP BY rush_id)
SELECT c.rush_id, a AS "start", count(*) AS n, CAST(min(idx) AS INTEGER) AS first_idx, CAST(max(idx) AS INTEGER) AS last_idx FROM c JOIN b ON b.rush_id = c.rush_id AND t BETWEEN a AND a + 14000 GROUP BY c.rush_id, a""",
    "chunk_words": f"WITH {WORDS} SELECT rush_id, CAST(idx AS INTEGER) AS idx, text, start_ms, end_ms, CASE WHEN start_ms >= 20000 AND start_ms % 20000 < 250 THEN start_ms // 20000 - 1 ELSE start_ms // 20000 END AS window FROM w",
    "utterance_chunks": f"WITH u AS ({UTTERANCES}) SELECT rush_id, utt_id // 5 AS chunk, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(n_words) AS BIGINT) AS n_words FROM u GROUP BY rush_id, utt_id // 5",
}


def oracle_sql() -> dict[str, str]:
    hard, soft = among(L.HARD_FILLERS), among(L.SOFT_FILLERS)
    return {
        "silence_cuts": _silences(),
        "shot_scores": _shot_scores(),
        "number_texts": _numbers(),
        "word_clock": f"WITH {WORDS} SELECT * FROM w",
        "utterance_sessions": UTTERANCES,
        "gap_summary": f"WITH {GAPS} SELECT kind, count(*) AS n, CAST(sum(removed) AS BIGINT) AS removed_ms, CAST(sum(duration) AS BIGINT) AS duration_ms FROM gp GROUP BY kind",
        "hard_fillers": f"WITH {WORDS} SELECT rush_id, idx, norm, CASE WHEN length(norm) <= 4 THEN 0.95::DOUBLE ELSE 0.88::DOUBLE END AS confidence FROM w WHERE norm IN {hard} AND end_ms - start_ms <= 1200",
        "soft_fillers": f"WITH {SPOKEN} SELECT rush_id, idx, norm, 0.64::DOUBLE AS confidence FROM uw WHERE (norm IN {soft} OR stem IN {soft}) AND norm NOT IN {hard} AND (coalesce(before IN {hard}, false) OR coalesce(target IN {hard}, false) OR start_ms - coalesce(before_ms, 0) >= 200) AND end_ms - start_ms <= 1200",
        "stutter_runs": f"WITH {SPOKEN}, s AS (SELECT *, sum(CASE WHEN norm = before AND behind <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY rush_id, run, part ORDER BY idx) AS again FROM uw) SELECT rush_id, min(idx) AS first_idx, any_value(norm) AS norm, count(*) AS n FROM s GROUP BY rush_id, run, part, again HAVING count(*) > 1 AND any_value(norm) <> '' AND any_value(norm) NOT IN {among([*L.INTENSIFIERS, *L.GRAMMATICAL_DOUBLES])}",
        "abandoned_words": f"""WITH {SPOKEN}, a AS (SELECT *, right({opened('text')}, 1) IN ('-', '_') AND length({opened('text')}) > 1 AS marked FROM uw
  WHERE end_ms - start_ms <= 850 AND length(stem) >= 2 AND starts_with(target, stem) AND length(target) > length(stem)),
c AS (SELECT *, CASE WHEN marked AND ahead <= 600 THEN 0.93::DOUBLE WHEN NOT marked AND ahead <= 250 AND length(stem) <= 5 AND length(target) >= length(stem) + 2 AND stem NOT IN {among([*L.COMMON_SHORT_WORDS, *V.STOPWORDS])} THEN 0.66::DOUBLE END AS confidence FROM a)
SELECT rush_id, idx, norm, target, confidence FROM c WHERE confidence IS NOT NULL""",
        "disfluencies": _disfluencies(),
        "minimum_shots": _minimum_shots(),
        **RANGES,
        "marker_splits": _marker_splits(),
        "seam_checks": _seam_checks(),
        "edit_seams": _edit_seams(),
        "transcript_files": rf"""WITH {WORDS}, cu AS (SELECT rush_id, seg_idx, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n FROM w GROUP BY rush_id, seg_idx),
sp AS (SELECT rush_id, idx, text, s, CASE WHEN e > s THEN (e - s) / n ELSE 250.0 END AS step, row_number() OVER (PARTITION BY rush_id, seg_idx ORDER BY idx) - 1 AS pos FROM w JOIN cu USING (rush_id, seg_idx) WHERE rush_id % 2 = 1)
SELECT rush_id, CAST(idx AS INTEGER) AS idx, text, start_ms, end_ms, 0.9::DOUBLE AS probability FROM w WHERE rush_id % 2 = 0
UNION ALL SELECT rush_id, CAST(idx AS INTEGER), text, CAST(s + floor(pos * step + 0.5) AS BIGINT), CAST(s + floor((pos + 1) * step + 0.5) AS BIGINT), 0.5::DOUBLE FROM sp""",
        "store_hits": """WITH p AS (SELECT o_orderkey, o_orderdate AS d, o_totalprice FROM orders WHERE o_orderkey % 4 < 2), r AS (SELECT *, row_number() OVER (ORDER BY d DESC, o_orderkey) AS nth, max(d) OVER () AS m FROM p),
k AS (SELECT count(*) AS kept FROM r WHERE nth <= 1000 AND d >= m - INTERVAL 400 DAY)
SELECT (SELECT count(*) FROM p) AS hits, (SELECT count(*) FROM orders WHERE o_orderkey % 4 >= 2) AS misses, (SELECT round(CAST(sum(CAST(o_totalprice AS DOUBLE)) AS DOUBLE), 2) FROM p) AS value, false AS written_again, kept, (SELECT count(*) FROM p) - kept AS purged, kept AS "left" FROM k""",
        "streamed_utterances": f"WITH u AS ({UTTERANCES}) SELECT rush_id, first_idx, n_words, start_ms, end_ms, reason, text FROM u",
        "content_loss": _content_loss(),
        "lcs_align": _align(),
        "utterance_language": _utterance_language(),
        "edit_decisions": _edit(EDIT_DECISIONS),
        "edit_shots": _edit(EDIT_SHOTS),
        "edit_sets": _edit(EDIT_SETS),
        "ngram_phrases": _phrases(),
        "timeline_shots": f"WITH {SHOTS} SELECT * FROM sh",
        "frame_clips": f"""WITH {SHOTS}, f AS (SELECT rush_id, shot, "start", CAST(round_even("start" * 25 / 1000.0, 0) AS BIGINT) AS a, CAST(round_even("end" * 25 / 1000.0, 0) AS BIGINT) AS b FROM sh)
SELECT rush_id, shot, a AS in_frame, greatest(b, a + 1) AS out_frame, CAST(sum(greatest(b, a + 1) - a) OVER (PARTITION BY rush_id ORDER BY "start") - (greatest(b, a + 1) - a) AS BIGINT) AS start_frame FROM f""",
        "short_shots": f"""WITH {SHOTS} SELECT rush_id, shot, "end" - "start" AS duration FROM sh WHERE "end" - "start" < 550""",
        "merge_intervals": f'WITH {DAYS}, {merged("m", "days")} SELECT k, s AS "start", e AS "end" FROM m',
        "subtract_intervals": f"""WITH {DAYS}, pos AS (SELECT * FROM days WHERE o_orderkey % 3 <> 0), neg AS (SELECT * FROM days WHERE o_orderkey % 3 = 0), {merged("b", "pos")}, {merged("h", "neg")},
d AS (SELECT k, unnest(range(s, e)) AS day FROM b), x AS (SELECT k, unnest(range(s, e)) AS day FROM h), y AS (SELECT d.k, d.day FROM d ANTI JOIN x ON x.k = d.k AND x.day = d.day),
i AS (SELECT k, day, day - row_number() OVER (PARTITION BY k ORDER BY day) AS g FROM y) SELECT k, min(day) AS "start", max(day) + 1 AS "end" FROM i GROUP BY k, g""",
        "interval_totals": f"WITH {DAYS}, {merged('m', 'days')} SELECT k, CAST(sum(e - s) AS BIGINT) AS total FROM m GROUP BY k",
        "event_sessions": "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= 21600 THEN 1 ELSE 0 END AS new FROM e), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM s) SELECT user_id, session, count(*) AS n, min(t) AS first_at, max(t) AS last_at FROM r GROUP BY user_id, session",
        "event_level_percentiles": 'SELECT event_type, round(quantile_cont(value, 0.08), 6) AS "floor", round(quantile_cont(value, 0.88), 6) AS speech, count(*) AS n FROM events GROUP BY event_type',
        "removal_budget": """WITH e AS (SELECT user_id, event_id AS id, 1 + event_id % 37 AS duration, ((event_id * 7) % 100) / 100 AS confidence FROM events),
t AS (SELECT user_id, CAST(sum(duration) AS BIGINT) AS total, CAST(floor(sum(duration) * (1 + user_id % 3) * 2 / 3) AS BIGINT) AS speech FROM e GROUP BY user_id),
s AS (SELECT e.*, total, speech, coalesce(sum(CASE WHEN confidence < 0.75 THEN duration ELSE 0 END) OVER (PARTITION BY e.user_id ORDER BY confidence, duration DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e JOIN t USING (user_id))
SELECT user_id, id, duration, NOT (confidence < 0.75 AND speech >= 500 AND total - before > floor(speech * 0.55::DOUBLE)) AS applied FROM s""",
        "cache_retention": "SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r, max(o_orderdate) OVER () AS m FROM orders) WHERE r <= 60 AND o_orderdate >= m - INTERVAL 120 DAY",
        "content_jaccard": f"WITH b AS (SELECT item_id, list_distinct({TOKENS}) AS w FROM benchmark), t AS (SELECT item_id, len(w) AS n, unnest(w) AS w FROM b), p AS (SELECT t.item_id, u.item_id AS other_id, t.n, u.n AS m, count(*) AS k FROM t JOIN t u ON t.w = u.w AND t.item_id < u.item_id GROUP BY ALL) SELECT item_id, other_id, round(k / (n + m - k), 6) AS jaccard FROM p",
        "language_characters": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
        "role_words": f"WITH t AS (SELECT role, unnest({TOKENS}) AS w FROM conversations), n AS (SELECT role, w, count(*) AS n FROM t GROUP BY ALL) SELECT role, w, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS r FROM n) WHERE r = 1",
        "strong_markers": _strong(),
        "content_words": f"SELECT conv_id, turn, CAST(len(list_filter({TOKENS}, lambda x: {CONTENT})) AS BIGINT) AS n FROM conversations",
        "curve_samples": _curves(),
        "language_durations": r"SELECT lang, CAST(sum(115 + 52 * length(w)) AS BIGINT) AS spoken_ms FROM (SELECT lang, unnest(regexp_split_to_array(trim(text), '[ \t\n\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY lang",
        "onset_strength": """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), o AS (SELECT event_id,
avg(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT event_id, round(a - coalesce(b, 0), 6) AS onset FROM o""",
        "edit_lists": EDL,
        "repaired_words": REPAIRED,
        "spread_words": SPREAD,
        "spaced_topk": SPACED,
        "weak_markers": f"SELECT conv_id, turn FROM conversations WHERE regexp_matches({normal_text('text')}, {q(chr(92) + 'b(' + '|'.join(L.WEAK_MARKERS) + ')' + chr(92) + 'b')})",
    }
