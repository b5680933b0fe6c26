"""The queries of the text operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, fingerprints, language_id, licenses, mixing, near_duplicates, quality, quality_rules, secrets, source_divergence, token_counts, toxicity, whitening
from tidewell.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", limit=1024)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), spans.alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(read(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return judged.withColumn("broken", F.array_join("broken", ","))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": op2_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mix_sources": op5_mix_sources,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_quality_rules": op11_quality_rules,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}

_BLANK = r"\x20\x09-\x0D"


def _op11_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    broken = []
    for r in quality_rules.RULES:
        low, high = (f"100 * {r.part} < {r.low} * {r.whole}" if r.low is not None else "false"), (f"100 * {r.part} > {r.high} * {r.whole}" if r.high is not None else "false")
        broken.append(f"CASE WHEN {r.whole} > 0 AND ({low} OR {high}) THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^{_BLANK}]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^{_BLANK}]+'), 1) AS i FROM d),
g AS (SELECT r, i, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x AS g FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY r),
by_word AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words,
  count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS n_letter_words FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
by_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[{_BLANK}]*[-*•]')) AS n_bullet_lines,
  count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[{_BLANK}]*\z')) AS n_ellipsis_lines FROM l WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY r),
c AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_letter_words, 0) AS n_letter_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(broken)}) AS broken FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept,
  n_stop_words, n_letter_words, n_lines, n_bullet_lines, n_ellipsis_lines, broken FROM b"""


_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN found f ON g.lang = f.lang AND g.source = f.source GROUP BY g.lang, g.source),
p AS (SELECT k.lang, t.source, k.term, coalesce(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 2)) // (t.total + 2 * l.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM kept k JOIN langs l USING (lang) JOIN totals t USING (lang) LEFT JOIN found f ON f.lang = k.lang AND f.source = t.source AND f.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
said AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank
FROM said QUALIFY part = 'pair' OR rank <= 10"""

#: For the other operators see the README: each needs a model, a tokenizer, hashing or a decomposition.
ORACLE_SQL: dict[str, str] = {"op11_quality_rules": _op11_sql(), "op12_source_divergence": _OP12_SQL}
