"""Score stages P1 to P22 over the notes table, each beside the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import scoring as S
from tidewell.functions import text as T
from tidewell.queries import query

NOW = model.NOW
BASE = "(0.3 + confidence / 1.9::DOUBLE)"
_C = "greatest(0.0, least(1.0, {}))"
_AGE = f"(({NOW} - ts) / 86400000.0::DOUBLE)"
_LAST = f"(({NOW} - last_accessed_at) / 86400000.0::DOUBLE)"
_TIER = "(CASE WHEN tier IS NOT NULL THEN tier WHEN importance >= 0.95 OR access_count >= 10 THEN 'core' WHEN importance >= 0.8 OR access_count >= 3 THEN 'working' ELSE 'peripheral' END)"
_EXEMPT = f"(category = 'patterns' OR (coalesce(tier, '') = 'core' AND importance >= 0.95) OR coalesce({_LAST} <= 7, false))"
_BETA = f"(CASE {_TIER} WHEN 'core' THEN 0.8 WHEN 'working' THEN 1.0 ELSE 1.3 END)"
_FLOOR = f"(CASE {_TIER} WHEN 'core' THEN 0.85 WHEN 'working' THEN 0.65 ELSE 0.45 END)"
_HALF = f"(CASE WHEN access_count <= 0 OR last_accessed_at IS NULL THEN 60.0 ELSE least(60.0 + 60.0 * 0.5 * ln(1 + access_count * exp(-{_LAST} / 30)), 180.0) END)"
_WEIBULL = f"(CASE WHEN {_AGE} <= 0 THEN 1.0 ELSE {_FLOOR} + (1 - {_FLOOR}) * exp(-(ln(2) / pow({_HALF}, {_BETA})) * pow({_AGE}, {_BETA})) END)"
_DECAY = f"(0.2 * pow(0.5, greatest(0.0, ({NOW} - coalesce(valid_from, ts)) / 86400000.0::DOUBLE) / 90) + 0.3 * least(1.0, log2(1 + evo_access_count) * CASE WHEN last_accessed_at IS NULL THEN 0.5 ELSE pow(0.5, greatest(0.0, {_LAST}) / 30) END) + 0.5 * greatest(0.0, least(1.0, importance)))"
_HOT = f"(1 / (1 + exp(-ln(1 + access_count))) * exp(-0.1 * greatest(0.0, {_LAST})))"


def _base() -> Column:
    return F.lit(0.3) + F.col("confidence") / 1.9


def _exempt() -> Column:
    return S.decay_exempt(F.col("category"), F.col("tier"), F.col("importance"), F.col("last_accessed_at"), NOW)


def _tier() -> Column:
    return S.resolve_tier(F.col("tier"), F.col("importance"), F.col("access_count"))


def _half() -> Column:
    return S.effective_half_life(60.0, F.col("access_count"), F.col("last_accessed_at"), NOW)


def _decay() -> Column:
    return S.decay_score(F.coalesce("valid_from", "ts"), F.col("evo_access_count"), F.col("last_accessed_at"), F.col("importance"), NOW)


def _sql(expression: str) -> str:
    return f"WITH notes AS ({model.NOTES_SQL}) SELECT id, round({expression}, 6) AS score FROM notes"


def _add(name: str, column: Column | object, sql: str) -> None:
    @query(name, _sql(sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return model.notes(spark, sf_dir).select("id", F.round(column(), 6).alias("score"))


_add("P3_rerank", lambda: S.rerank_blend(_base(), F.when(F.col("i") % 2 == 0, F.col("importance"))), _C.format(f"CASE WHEN i % 2 = 0 THEN importance * 0.6 + {BASE} * 0.4 ELSE {BASE} * 0.8 END"))
_add("P4_cosine_rerank", lambda: S.cosine_rerank(_base(), F.col("importance")), _C.format(f"{BASE} * 0.7 + importance * 0.3"))
_add("P5_recency", lambda: S.recency_boost(_base(), F.col("ts"), NOW), _C.format(f"{BASE} + exp(-{_AGE} / 14) * 0.1"))
_add("P6_importance", lambda: S.importance_weight(_base(), F.col("importance")), _C.format(f"{BASE} * (0.5 + 0.5 * importance)"))
_add("P7_confidence", lambda: S.confidence_weight(_base(), F.col("confidence")), _C.format(f"{BASE} * (0.5 + 0.5 * confidence)"))
_add("P8_emotion", lambda: S.emotion_alignment(_base(), F.col("valence"), 0.5), f"CASE WHEN abs(valence) >= 0.2 THEN {_C.format(f'{BASE} * (1 + 0.15 * (1 - abs(valence - 0.5) / 2))')} ELSE {BASE} END")
_add("P9_boundary", lambda: S.boundary_weight(_base(), F.col("layer"), F.col("authority"), F.col("scope")), _C.format(f"{BASE} * CASE layer WHEN 'durable' THEN 1.01 WHEN 'evidence' THEN 0.99 ELSE 1.0 END"))
_add("P10_asset", lambda: S.asset_weight(_base(), F.when(F.col("i") % 2 == 0, F.lit("asset:brief:x")).when(F.col("i") % 3 == 0, F.lit("asset:pin")).otherwise(F.col("scope"))), _C.format(f"{BASE} * CASE WHEN i % 2 = 0 THEN 0.88 WHEN i % 3 = 0 THEN 1.04 ELSE 1.0 END"))
_add("P11_length", lambda: S.length_norm(_base(), F.length("text")), _C.format(f"{BASE} / (1 + 0.5 * log2(greatest(length(text) / 800.0::DOUBLE, 1.0)))"))
_add("P12_weibull", lambda: S.time_decay(_base(), F.col("ts"), _half(), _tier(), F.col("arousal"), _exempt(), NOW), f"CASE WHEN {_EXEMPT} THEN {BASE} ELSE {_C.format(f'{BASE} * (1 + 0.1 * arousal) * {_WEIBULL}')} END")
_add("P13_evolution", lambda: S.evolution_blend(_base(), _decay(), _exempt()), _C.format(f"{BASE} * 0.9 + 0.1 * CASE WHEN {_EXEMPT} THEN 1.0 ELSE {_DECAY} END"))
_add("P14_access", lambda: S.access_boost(_base(), F.col("evo_access_count")), _C.format(f"{BASE} * (1 + least(0.15, 0.03 * log2(1 + evo_access_count)))"))
_add("P15_hotness", lambda: S.hotness_blend(_base(), F.col("access_count"), F.col("last_accessed_at"), NOW, 0.2), f"CASE WHEN access_count <= 0 OR last_accessed_at IS NULL THEN {BASE} ELSE {_C.format(f'0.8 * {BASE} + 0.2 * {_HOT}')} END")
_add("P16_frequency", lambda: S.frequency_boost(_base(), F.col("access_count"), F.col("ts"), NOW), f"CASE WHEN access_count >= 2 AND access_count * pow(0.5, {_AGE} / 30) >= 2 THEN {_C.format(f'{BASE} * (1 + 0.15 * log2(access_count * pow(0.5, {_AGE} / 30)))')} ELSE {BASE} END")
_add("P17_error_signature", lambda: S.error_boost(_base(), F.array("scope_root", "language"), ["src3", "fr"]), f"CASE WHEN scope_root = 'src3' OR language = 'fr' THEN least(1.0, {BASE} * 1.5) ELSE {BASE} END")
_add("P18_suppress", lambda: S.suppress(_base(), F.col("i") % 6 == 0), f"{BASE} * CASE WHEN i % 6 = 0 THEN 0.3 ELSE 1.0 END")
_add(
    "P19_usage_decay",
    lambda: S.usage_decay(F.coalesce("valid_from", "ts"), F.col("evo_access_count"), F.col("last_accessed_at"), F.col("importance"), S.usage_status(F.col("access_count"), F.lit(0)), F.col("importance") >= 0.95, NOW),
    _DECAY.replace("0.3 * least", "0.3 * (CASE WHEN access_count >= 6 AND importance < 0.95 THEN 0.2 ELSE 1.0 END) * least"),
)
_add("P22_rebalance_tier_band", lambda: S.by_tier(_tier(), S.TIER_BAND, 0), f"CASE {_TIER} WHEN 'core' THEN 0.85 WHEN 'working' THEN 0.6 ELSE 0.3 END")
_add("P0_interference_score", lambda: S.interference_score(F.col("importance"), F.col("confidence"), F.col("ts"), NOW), f"confidence * importance * pow(0.5, greatest(0.0, {_AGE}) / 60)")
_add("P0_version_rank", lambda: S.version_rank(F.col("importance"), F.col("confidence"), F.col("access_count")), "(0.5 * importance + 0.5 * confidence) * (1 + ln(1 + access_count))")
_add("P0_read_boost", lambda: S.read_boost(_base(), F.col("access_count")), f"least(0.99, {BASE} + least(1.0, access_count / 4.0::DOUBLE) * 0.15)")
_add("P0_bayes", lambda: S.smoothed_confidence(F.col("access_count")), "access_count / (access_count + 2.0::DOUBLE)")


@query("P20_tier", f"WITH notes AS ({model.NOTES_SQL}) SELECT id, {_TIER} AS tier FROM notes")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.notes(spark, sf_dir).select("id", _tier().alias("tier"))


@query(
    "P21_tier_change",
    f"WITH notes AS ({model.NOTES_SQL}) SELECT id, CASE WHEN t = 'peripheral' AND access_count >= 3 AND importance >= 0.5 THEN 'working' WHEN t IN ('working', 'peripheral') AND access_count >= 10 AND importance >= 0.8 THEN 'core' WHEN t = 'core' AND access_count < 3 AND (last_accessed_at IS NULL OR {_LAST} > 60) THEN 'working' WHEN t = 'working' AND access_count < 3 AND (last_accessed_at IS NULL OR {_LAST} > 60) THEN 'peripheral' ELSE t END AS tier FROM (SELECT *, {_TIER} AS t FROM notes) x",
)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.notes(spark, sf_dir).select("id", S.tier_change(_tier(), F.col("access_count"), F.col("importance"), F.col("last_accessed_at"), NOW).alias("tier"))


_SIGNAL = "CASE WHEN access_count <= 0 THEN 0.0 WHEN t = 'peripheral' THEN greatest(0.0, least(1.0, access_count / greatest(1, least(5, most))::DOUBLE)) WHEN t = 'working' THEN greatest(0.0, least(1.0, (least(access_count, 5) - 1) / 4.0::DOUBLE)) ELSE CASE WHEN greatest(6, most) <= 6 THEN 1.0 ELSE greatest(0.0, least(1.0, (least(access_count, greatest(6, most)) - 6) / greatest(1, greatest(6, most) - 6)::DOUBLE)) END END"


@query(
    "P22_rebalance",
    f"WITH notes AS ({model.NOTES_SQL}), x AS (SELECT *, CASE WHEN access_count <= 0 THEN 'peripheral' WHEN tier IS NOT NULL THEN tier WHEN access_count > 5 THEN 'core' ELSE 'working' END AS t, max(access_count) OVER () AS most, (ts - min(ts) OVER ()) / (max(ts) OVER () - min(ts) OVER ())::DOUBLE AS recency FROM notes), y AS (SELECT *, {_SIGNAL} AS signal FROM x) SELECT id, t AS tier, round(CASE t WHEN 'core' THEN 0.85 WHEN 'working' THEN 0.6 ELSE 0.3 END + CASE t WHEN 'core' THEN 0.95 - 0.85 WHEN 'working' THEN 0.8 - 0.6 ELSE 0.5 - 0.3 END * CASE WHEN t = 'peripheral' AND access_count = 0 THEN greatest(0.0, least(1.0, importance * 0.15 + recency * 0.85)) ELSE greatest(0.0, least(1.0, importance * 0.25 + signal * 0.65 + recency * 0.1)) END, 3) AS importance FROM y",
)
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = model.notes(spark, sf_dir)
    ends = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max("access_count").alias("most"))
    tier = S.rebalanced_tier(F.col("tier"), F.col("access_count"))
    recency = F.when(F.col("hi") > F.col("lo"), (F.col("ts") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return df.crossJoin(F.broadcast(ends)).select("id", tier.alias("tier"), S.rebalanced_importance(F.col("importance"), tier, F.col("access_count"), F.col("most"), recency).alias("importance"))


def _tok(t: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_EN)
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({stop}))"


_QUERY = "there is the token and that license this version here"


@query(
    "P1_multi_vector",
    f"WITH notes AS ({model.NOTES_SQL}), q AS (SELECT {_tok(repr(_QUERY))} AS q), x AS (SELECT id, {BASE} AS s, q, {_tok('l0_abstract')} AS a, {_tok('l1_overview')} AS b FROM notes, q), y AS (SELECT *, len(list_filter(q, lambda t: list_contains(a, t))) AS ha, len(list_filter(q, lambda t: list_contains(b, t))) AS hb FROM x) "
    "SELECT id, round(s * 0.65 + 0.20 * CASE WHEN len(a) = 0 THEN 0.0 ELSE 0.7 * ha / len(q) + 0.3 * ha / len(a) END + 0.15 * CASE WHEN len(b) = 0 THEN 0.0 ELSE 0.7 * hb / len(q) + 0.3 * hb / len(b) END, 6) AS score FROM y",
)
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.tokens(F.lit(_QUERY))
    df = model.notes(spark, sf_dir).withColumns({"q": q, "a": T.tokens(F.regexp_replace("l0_abstract", "[^\\x00-\\x7f]", " ")), "b": T.tokens(F.regexp_replace("l1_overview", "[^\\x00-\\x7f]", " "))})
    return df.select("id", F.round(S.multi_vector_blend(_base(), T.overlap(F.col("q"), F.col("a")), T.overlap(F.col("q"), F.col("b")), 5), 6).alias("score"))


@query(
    "P2_anchor",
    f"WITH notes AS ({model.NOTES_SQL}), q AS (SELECT {_tok(repr(_QUERY))} AS q), x AS (SELECT id, {BASE} AS s, q, {_tok('anchor')} AS a FROM notes, q), y AS (SELECT *, len(list_filter(q, lambda t: list_contains(a, t))) AS ha FROM x) SELECT id, round(greatest(0.0, least(1.0, s * (1 + 0.25 * CASE WHEN len(a) = 0 THEN 0.0 ELSE 0.7 * ha / len(q) + 0.3 * ha / len(a) END))), 6) AS score FROM y",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = model.notes(spark, sf_dir).withColumns({"q": T.tokens(F.lit(_QUERY)), "a": T.tokens(F.regexp_replace("anchor", "[^\\x00-\\x7f]", " "))})
    return df.select("id", F.round(S.anchor_boost(_base(), T.overlap(F.col("q"), F.col("a"))), 6).alias("score"))
