"""The queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontam, interactions, langid, line_dedup, lm_scoring, ngram_join, packing, quality, search, sharding, token_files, toxicity, urls

#: Name of the tokenizer file; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.with_bitmaps(table(spark, sf_dir, "documents"))
    text, bitmap = F.col("text"), F.col("kept_before")
    return out.select(
        "doc_id",
        F.size(line_dedup.text_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(bitmap), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.encode(line_dedup.kept_text(text, bitmap), "UTF-8"), 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_token_files, op3_packing, op4_lm_scoring, op5_line_dedup, op6_decontamination, op7_sharding, op8_quality, op9_toxicity, op10_language, op11_search, op12_url_filter, op13_interactions)
    return {f.__name__: f for f in own}


_SPLIT = r"regexp_split_to_array({}, '[ \t\n\x0b\x0c\r]+')"
_WORDS = f"list_filter({_SPLIT.format('{}')}, lambda w: w <> '')"

_JOIN_SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, k, x.n = k AND y.n = k AS copy FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a AS u, b AS v, copy FROM l UNION ALL SELECT b, a, copy FROM l),
c AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, c.c FROM c JOIN e ON e.u = c.u WHERE c.c < e.v)
SELECT d.doc_id, (SELECT min(c) FROM c WHERE c.u = d.doc_id) AS class_id,
  (SELECT count(*) FROM e WHERE e.u = d.doc_id) AS n_links,
  1 + (SELECT count(*) FROM e WHERE e.u = d.doc_id AND e.copy) AS n_copies
FROM documents d
"""

_LM_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM w),
b AS (SELECT doc_id, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
c1 AS (SELECT v, count(*) AS n FROM b GROUP BY v),
c2 AS (SELECT u, v, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY u, v),
k AS (SELECT CAST(round_even(ln(count(*)) * 1e9, 0) AS BIGINT) AS total, CAST(round_even(ln(0.4) * 1e9, 0) AS BIGINT) AS backoff FROM b),
s AS (SELECT b.doc_id, sum(CASE
    WHEN b.u IS NULL THEN CAST(round_even(ln(v.n) * 1e9, 0) AS BIGINT) - k.total
    WHEN c2.n >= 2 THEN CAST(round_even(ln(c2.n) * 1e9, 0) AS BIGINT) - CAST(round_even(ln(u.n) * 1e9, 0) AS BIGINT)
    ELSE CAST(round_even(ln(v.n) * 1e9, 0) AS BIGINT) - k.total + k.backoff END) AS score
  FROM b CROSS JOIN k JOIN c1 v ON v.v = b.v LEFT JOIN c1 u ON u.v = b.u LEFT JOIN c2 ON c2.u = b.u AND c2.v = b.v GROUP BY b.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(coalesce(s.score, 0) / 1e9, 4) AS log_score,
  CASE WHEN len(w.w) > 0 THEN round(s.score / 1e9 / len(w.w), 4) END AS mean_log_score
FROM w LEFT JOIN s USING (doc_id)
"""

_LINES_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


_TERMS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM f CROSS JOIN k WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
i AS (SELECT f.doc_id, f.term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)) AS gain FROM f CROSS JOIN k WHERE f.term IN (SELECT term FROM q)),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * gain) AS BIGINT) AS score FROM q JOIN g USING (term) JOIN i USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _audit_sql() -> str:
    steps = ", ".join(f"('{o}', {step}, {applied}, {'ABCDE'.index(f)})" for o, step, applied, f in interactions.orders(list("ABCDE")))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS w, row_number() OVER (PARTITION BY t ORDER BY doc_id) > 1 AS e FROM t),
b AS (SELECT part, l.quality = 1 AS good, l.toxic = 1 AS toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM b GROUP BY part, fails),
s(filter_order, step, applied, f) AS (VALUES {steps}),
x AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN fails & (applied | (1 << f)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails & applied = 0 AND fails & (1 << f) > 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails & applied > 0 AND fails & (1 << f) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = (1 << f) THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN fails & applied = 0 AND fails & (1 << f) > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails & applied = 0 AND fails & (1 << f) > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g CROSS JOIN s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM x
"""


def _quality_sql() -> str:
    words = list(dict.fromkeys(quality.COMMON_WORDS))
    strip, lefts = f"regexp_replace(t, '{quality._SPACES}', '', 'g')", []
    for k, kind in enumerate(quality.CLASSES):
        lefts.append(f"h{k + 1} AS (SELECT *, regexp_replace(l{k}, '{kind.replace(chr(39), chr(39) * 2)}', '', 'g') AS l{k + 1} FROM h{k})")
    n = len(quality.CLASSES)
    chars = ", ".join(["length(t) - length(l0)", *(f"length(l{k}) - length(l{k + 1})" for k in range(n)), f"length(l{n})"])
    common = ", ".join(f"len(list_filter(low, lambda x: x = '{w}'))" for w in words)
    known = ", ".join(f"'{w}'" for w in words)

    def far(own: str, ref: str) -> str:
        p, q = f"({own}[i] / list_sum({own}))", f"({ref}[i] / list_sum({ref}))"
        half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * ln({a} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({own}) + 1), lambda i: {half(p)} + {half(q)})) / (2 * ln(2))))"

    sums = lambda c, k: "[" + ", ".join(f"CAST(sum({c}[{i + 1}]) AS DOUBLE)" for i in range(k)) + "]"
    return rf"""
WITH h0 AS (SELECT doc_id, lang, t, {strip} AS l0, {_WORDS.format("t")} AS w,
    list_filter({_SPLIT.format("t")}, lambda x: x IN ({known})) AS low,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
{", ".join(lefts)},
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM h0))),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT h.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(l0) AS word_chars, length(l2) - length(l3) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    [{chars}] AS chars, [{common}, len(w) - len(low)] AS common FROM h{n} h LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT lang, {sums("chars", n + 2)} AS rc, {sums("common", len(words) + 1)} AS rw FROM b WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1024),
d AS (SELECT doc_id, bool_or((list_sum(chars) < 200 OR {far("chars", "rc")} <= 0.25) AND (n_words < 100 OR {far("common", "rw")} <= 0.35)) AS near
  FROM b CROSS JOIN f WHERE NOT base_failed GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, false) AS kept
FROM b LEFT JOIN d USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _JOIN_SQL, "op4_lm_scoring": _LM_SQL, "op5_line_dedup": _LINES_SQL, "op8_quality": _quality_sql(), "op11_search": _SEARCH_SQL, "op13_interactions": _audit_sql()}
