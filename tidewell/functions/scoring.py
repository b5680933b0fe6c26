"""Score stages as column expressions.

Each function takes columns and returns one; nothing here shuffles, so a whole chain
of stages is one projection over the candidates.  Ages are in days; `now` is epoch ms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import DAY_MS, DURABLE_SCOPES, TRANSCRIPT_SCOPES

#: Fixed values of the tiers: shape and floor of forgetting, and importance bands.
TIER_SHAPE = {"core": (0.8, 0.85), "working": (1.0, 0.65), "peripheral": (1.3, 0.45)}
TIER_BAND = {"core": (0.85, 0.95), "working": (0.6, 0.8), "peripheral": (0.3, 0.5)}


def clamp01(x: Column, fallback: float = 0.0) -> Column:
    """Between 0 and 1; the fallback stands for values that are not finite, it is no floor."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(fallback)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def age_days(ts: Column, now: int) -> Column:
    return (F.lit(now) - ts) / F.lit(float(DAY_MS))


def by_tier(tier: Column, table: dict[str, tuple[float, float]], which: int) -> Column:
    return F.when(tier == "core", table["core"][which]).when(tier == "working", table["working"][which]).otherwise(table["peripheral"][which])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bm25_normalised(raw: Column) -> Column:
    return F.when(raw > 0, sigmoid(raw / 5)).otherwise(0.5)


def multi_vector_blend(score: Column, l0: Column, l1: Column, query_tokens: Column | int) -> Column:
    """Weighted mean of the score and what the abstract and the overview share with the query; absent ones count out.

    Weights by query length: the shorter the query, the more its summaries count.
    """
    n = F.lit(query_tokens) if isinstance(query_tokens, int) else query_tokens
    by_length = lambda short, middle, long: F.when(n <= 3, short).when(n <= 10, middle).otherwise(long)
    w, w0, w1 = by_length(0.50, 0.65, 0.80), by_length(0.25, 0.20, 0.10), by_length(0.25, 0.15, 0.10)
    part = lambda x, k: F.when(x.isNotNull(), x * k).otherwise(0.0)
    some = lambda x, k: F.when(x.isNotNull(), k).otherwise(0.0)
    return (score * w + part(l0, w0) + part(l1, w1)) / (w + some(l0, w0) + some(l1, w1))


def anchor_boost(score: Column, overlap: Column) -> Column:
    return clamp01(score * (1 + 0.25 * overlap))  # P2


def rerank_blend(score: Column, judged: Column) -> Column:
    """What a cross-encoder judged, or a penalty where it returned nothing."""
    return F.when(judged.isNull(), clamp01(score * 0.8)).otherwise(clamp01(judged * 0.6 + score * 0.4))


def cosine_rerank(score: Column, cos: Column) -> Column:
    return clamp01(score * 0.7 + cos * 0.3)  # P4


def recency_boost(score: Column, ts: Column, now: int, half_life: float = 14.0, weight: float = 0.10) -> Column:
    return clamp01(score + F.exp(-age_days(ts, now) / half_life) * weight)  # P5


def importance_weight(score: Column, importance: Column) -> Column:
    return clamp01(score * (0.5 + 0.5 * importance))  # P6


def confidence_weight(score: Column, confidence: Column) -> Column:
    return clamp01(score * (0.5 + 0.5 * confidence))  # P7


def emotion_alignment(score: Column, valence: Column, query_valence: float) -> Column:
    """Only for texts and queries with feeling."""
    if abs(query_valence) < 0.2:
        return score
    return F.when(F.abs(valence) >= 0.2, clamp01(score * (1 + 0.15 * (1 - F.abs(valence - query_valence) / 2)))).otherwise(score)


def starts_with_any(scope: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | scope.startswith(p)
    return out


def boundary_weight(score: Column, layer: Column, authority: Column, scope: Column) -> Column:
    """Durable layers a little up, evidence a little down; without a boundary the scope decides."""
    factor = (
        F.when(layer == "durable", F.when(authority == "structured-memory", 1.03).otherwise(1.01))
        .when(layer == "evidence", F.when(authority == "transcript-ingest", 0.97).otherwise(0.99))
        .when(layer.isNotNull(), 1.0)
        .when(starts_with_any(scope, TRANSCRIPT_SCOPES), 0.99)
        .when(starts_with_any(scope, DURABLE_SCOPES), 1.01)
        .otherwise(1.0)
    )
    return clamp01(score * factor)


def asset_weight(score: Column, scope: Column) -> Column:
    factor = F.when(scope.startswith("asset:brief:"), 0.88).when(scope.startswith("asset:"), 1.04).otherwise(1.0)  # P10
    return clamp01(score * factor)


def length_norm(score: Column, length: Column, anchor: int = 800) -> Column:
    return clamp01(score / (1 + 0.5 * F.log2(F.greatest(length / anchor, F.lit(1.0)))))  # P11


def effective_half_life(base: float, access: Column, last: Column, now: int, freshness: float = 30.0, factor: float = 0.5, most: float = 3.0) -> Column:
    """A half-life that recent accesses extend, up to a multiple."""
    effective = access * F.exp(-age_days(last, now) / freshness)
    return F.when((access <= 0) | last.isNull() | (last <= 0), F.lit(base)).otherwise(F.least(base + base * factor * F.log1p(effective), F.lit(base * most)))


def weibull(age: Column, half_life: Column, tier: Column) -> Column:
    """floor + (1 - floor) e^(-ln2 (age / half_life)^beta); 1 at no age."""
    beta, floor = by_tier(tier, TIER_SHAPE, 0), by_tier(tier, TIER_SHAPE, 1)
    positive = F.greatest(age, F.lit(1e-12))
    decay = F.exp(-(F.lit(math.log(2)) / F.pow(half_life, beta)) * F.pow(positive, beta))
    return F.when((half_life <= 0) | (age <= 0), 1.0).otherwise(floor + (1 - floor) * decay)


def emotion_half_life(half_life: Column, valence: Column) -> Column:
    return F.when(F.abs(valence) >= 0.1, half_life * (1 + 0.3 * F.abs(valence))).otherwise(half_life)


def resolve_tier(tier: Column, importance: Column, access: Column) -> Column:
    """P20: the stored tier, or one by importance and accesses."""
    return F.when(tier.isin("core", "working", "peripheral"), tier).when((importance >= 0.95) | (access >= 10), "core").when((importance >= 0.8) | (access >= 3), "working").otherwise("peripheral")


def decay_exempt(category: Column, tier: Column, importance: Column, last: Column, now: int, pinned: Column | None = None) -> Column:
    """Patterns, important core rows, what was used in the last 7 days and what is pinned do not decay."""
    out = (category == "patterns") | (F.coalesce(tier, F.lit("")) == "core") & (importance >= 0.95)
    out = out | F.coalesce((last > 0) & (age_days(last, now) <= 7), F.lit(False))
    return out if pinned is None else out | pinned


def time_decay(score: Column, ts: Column, half_life: Column, tier: Column, arousal: Column | None, exempt: Column, now: int) -> Column:
    """P12."""
    boost = F.lit(1.0) if arousal is None else 1 + 0.1 * arousal
    return F.when(exempt, score).otherwise(clamp01(score * boost * weibull(age_days(ts, now), half_life, tier)))


def decay_score(valid_from: Column, access: Column, last: Column, importance: Column, now: int, frequency_factor: Column | float = 1.0) -> Column:
    """0.2 time + 0.3 frequency + 0.5 importance: how much a row is worth keeping."""
    time = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(valid_from, now)) / 90)
    recent = F.when(last.isNull() | (last == 0), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(last, now)) / 30))
    frequency = F.least(F.lit(1.0), F.log2(1 + access) * recent) * frequency_factor
    return 0.2 * time + 0.3 * frequency + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance))


def evolution_blend(score: Column, decay: Column, exempt: Column) -> Column:
    return clamp01(score * 0.9 + F.when(exempt, 1.0).otherwise(decay) * 0.1)  # P13


def access_boost(score: Column, access: Column) -> Column:
    return F.when(access > 0, clamp01(score * (1 + F.least(F.lit(0.15), 0.03 * F.log2(1 + access))))).otherwise(score)  # P14


def hotness(access: Column, last: Column, now: int, rate: float = 0.1) -> Column:
    return F.when(access <= 0, 0.0).otherwise(sigmoid(F.log1p(access)) * F.exp(-rate * F.greatest(F.lit(0.0), age_days(last, now))))


def hotness_blend(score: Column, access: Column, last: Column, now: int, alpha: float) -> Column:
    return F.when((access <= 0) | last.isNull(), score).otherwise(clamp01((1 - alpha) * score + alpha * hotness(access, last, now)))  # P15


def frequency_boost(score: Column, hits: Column, last_hit: Column, now: int, half_life: float = 30.0, factor: float = 0.15, least: int = 2) -> Column:
    """Hits fade with time; fewer than `least` do nothing."""
    effective = F.coalesce(hits * F.pow(F.lit(0.5), age_days(last_hit, now) / half_life), F.lit(0.0))
    return F.when((F.coalesce(hits, F.lit(0)) >= least) & (effective >= least), clamp01(score * (1 + F.log2(effective) * factor))).otherwise(score)


def error_boost(score: Column, signatures: Column, query_signatures: list[str]) -> Column:
    return F.when(F.arrays_overlap(signatures, F.array(*map(F.lit, query_signatures))), F.least(F.lit(1.0), score * 1.5)).otherwise(score)  # P17


def suppress(score: Column, seen: Column) -> Column:
    return F.when(seen, score * 0.3).otherwise(score)  # P18


def usage_status(injections: Column, uses: Column) -> Column:
    """unused, cold, warm or hot."""
    return F.when(injections <= 0, "unused").when((uses <= 0) & (injections >= 6), "cold").when(uses / injections >= 0.3, "hot").otherwise("warm")


def usage_decay(valid_from: Column, access: Column, last: Column, importance: Column, status: Column, protected: Column, now: int) -> Column:
    """What is shown again and again and never used counts its frequency at a fifth."""
    return decay_score(valid_from, access, last, importance, now, F.when((status == "cold") & ~protected, 0.2).otherwise(1.0))


def tier_change(tier: Column, access: Column, importance: Column, last: Column, now: int, core_count: int = 0, core_cap: int = 500) -> Column:
    """Promotion by use and importance, demotion after 60 days; a full core raises its own thresholds."""
    overflow = min(core_count / core_cap, 3.0) if core_count > core_cap else 1.0
    core_access, core_importance = math.ceil(10 * overflow), min(0.8 * (0.5 + 0.5 * overflow), 0.98) if overflow > 1 else 0.8
    stale = F.coalesce((last <= 0) | (age_days(last, now) > 60), F.lit(True)) & (access < 3)
    return (
        F.when((tier == "peripheral") & (access >= 3) & (importance >= 0.5), "working")
        .when(tier.isin("working", "peripheral") & (access >= core_access) & (importance >= core_importance), "core")
        .when((tier == "core") & stale, "working")
        .when((tier == "working") & stale, "peripheral")
        .otherwise(tier)
    )


def rebalanced_tier(tier: Column, access: Column) -> Column:
    return F.when(access <= 0, "peripheral").when(tier.isNotNull(), tier).when(access > 5, "core").otherwise("working")


def rebalanced_importance(importance: Column, tier: Column, access: Column, most_access: Column, recency: Column) -> Column:
    """Importance moved into its tier's band by a blend of itself, accesses and recency; three decimals."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    top = F.greatest(F.lit(6), most_access)
    signal = (
        F.when(access <= 0, 0.0)
        .when(tier == "peripheral", unit(access / F.greatest(F.lit(1), F.least(F.lit(5), most_access))))
        .when(tier == "working", unit((F.least(access, F.lit(5)) - 1) / 4))
        .otherwise(F.when(top <= 6, 1.0).otherwise(unit((F.least(access, top) - 6) / F.greatest(F.lit(1), top - 6))))
    )
    blend = F.when((tier == "peripheral") & (access == 0), unit(unit(importance) * 0.15 + recency * 0.85)).otherwise(unit(unit(importance) * 0.25 + signal * 0.65 + recency * 0.1))
    low, high = by_tier(tier, TIER_BAND, 0), by_tier(tier, TIER_BAND, 1)
    return F.round(low + (high - low) * blend, 3)


def interference_score(importance: Column, confidence: Column, ts: Column, now: int) -> Column:
    """By which the members of a near-duplicate cluster are ranked: confidence, importance and a 60-day half-life."""
    return confidence * F.coalesce(importance, F.lit(0.5)) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(ts, now)) / 60)


def version_rank(importance: Column, confidence: Column, access: Column) -> Column:
    return (0.5 * F.coalesce(importance, F.lit(0.5)) + 0.5 * F.coalesce(confidence, F.lit(0.7))) * (1 + F.log1p(F.coalesce(access, F.lit(0))))


def confidence_by_source(source: Column) -> Column:
    return F.when(source == "manual", 0.9).when(source == "agent", 0.7).when(source == "distill", 0.6).otherwise(0.5)


def read_boost(base: Column, reads: Column) -> Column:
    return F.least(F.lit(0.99), base + F.least(F.lit(1.0), reads / 4) * 0.15)


def smoothed_confidence(n: Column) -> Column:
    return n / (n + 2)
