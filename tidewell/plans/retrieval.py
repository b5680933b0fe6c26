"""The retrieval pipelines as one plan each: candidates, shared score stages, selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import scoring as S
from tidewell.functions import text as T
from tidewell.functions import vector as V
from tidewell.operators import search, selecting
from tidewell.operators.lifecycle import is_active
from tidewell.plans.trace import Trace, staged


@dataclass(frozen=True)
class Profile:
    """Weights of one way to search; `candidates` is capped at 20, as every search is."""

    name: str
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    least_score: float = 0.35
    half_life: float = 14.0
    recency: float = 0.10
    length_anchor: int = 800
    decay_half_life: float = 60.0
    hotness: float = 0.0
    candidates: int = search.MOST

    def least_by_category(self) -> dict[str, float]:
        """the categories' least scores, in proportion to the profile's own; three decimals."""
        return {c: round(s * self.least_score / 0.35, 3) for c, s in search.CATEGORY_MIN.items()}


#: The built-in profiles.
PROFILES = {
    p.name: p
    for p in (
        Profile("default"),
        Profile("writing", vector_weight=0.8, keyword_weight=0.2, least_score=0.24, half_life=90.0, recency=0.06, decay_half_life=365.0, length_anchor=800),
        Profile("debug", vector_weight=0.55, keyword_weight=0.45, least_score=0.34, half_life=7.0, recency=0.15, decay_half_life=30.0, length_anchor=420),
        Profile("fact-check", vector_weight=0.5, keyword_weight=0.5, least_score=0.38, half_life=21.0, recency=0.08, decay_half_life=45.0, length_anchor=360),
    )
}


def shared_stages(df: DataFrame, profile: Profile, now: int, trace: Trace | None = None) -> DataFrame:
    """The stages both pipelines share, in their order; rows may have the length of their text, `text_length`, in its place.

    Each stage is a projection of its own: a stage reads its score several times, so
    nesting the expressions would make the last one exponentially large.
    """
    c = F.col
    s: Column = c("score")
    tier = S.resolve_tier(c("tier"), c("importance"), c("access_count"))
    df = df.withColumns(
        {
            "__tier": tier,
            "__exempt": S.decay_exempt(c("category"), c("tier"), c("importance"), c("last_accessed_at"), now),
            "__half": S.effective_half_life(profile.decay_half_life, c("access_count"), c("last_accessed_at"), now),
            "__decay": S.decay_score(F.coalesce("valid_from", "ts"), c("evo_access_count"), c("last_accessed_at"), c("importance"), now),
        }
    )
    stages = {
        "recency_boost": S.recency_boost(s, c("ts"), now, profile.half_life, profile.recency),
        "importance_weight": S.importance_weight(s, c("importance")),
        "confidence_weight": S.confidence_weight(s, c("confidence")),
        "boundary_weight": S.boundary_weight(s, c("layer"), c("authority"), c("scope")),
        "asset_type_weight": S.asset_weight(s, c("scope")),
        "length_norm": S.length_norm(s, c("text_length") if "text_length" in df.columns else F.length("text"), profile.length_anchor),
        "time_decay": S.time_decay(s, c("ts"), c("__half"), c("__tier"), None, c("__exempt"), now),
        "evolution_blend": S.evolution_blend(s, c("__decay"), c("__exempt")),
        "access_boost": S.access_boost(s, c("evo_access_count")),
    }
    if profile.hotness:
        stages["hotness_blend"] = S.hotness_blend(s, c("access_count"), c("last_accessed_at"), now, profile.hotness)
    for name, stage in stages.items():
        df = staged(trace, df.withColumn("score", stage), name)
    return df.drop("__tier", "__exempt", "__half", "__decay")


def finalise(df: DataFrame, limit: int) -> DataFrame:
    """O1: best first, ties by id, with the place in each query's list."""
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


SHORT_TOKENS, SHORT_FACTOR = 4, 0.6


def _asked(queries: DataFrame) -> DataFrame:
    """`queries` (query_id, query, query_vector) with their tokens and whether they are short."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vector", T.tokens(F.col("query")).alias("__q"))
    return asked.withColumn("short", F.size("__q") <= SHORT_TOKENS)


def _place(score: str = "score") -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "id"))


def nearest(df: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, cos, rank) of the nearest active rows, as many as a search may have; the same for all profiles."""
    return search.knn_batch(df.where(is_active(F.col("status"))), queries.select("query_id", "query_vector"))


def vector_pipeline(df: DataFrame, queries: DataFrame, profile: Profile, now: int, limit: int = 10, suppressed: DataFrame | None = None, trace: Trace | None = None, near: DataFrame | None = None) -> DataFrame:
    """K9: nearest neighbours of active rows, then the shared stages.  Filters come before ranking.

    With the queries' text (a column `query`) the profile's least score holds and anchors count (P2); `suppressed`
    (id) are rows that the session does not want to see again (P18).  `near` is what `nearest` gave, where it is at hand.
    """
    active = df.where(is_active(F.col("status")))
    near = (nearest(df, queries) if near is None else near).where(F.col("rank") <= profile.candidates)
    scored = near.select("query_id", "id", S.clamp01(1 / (2 - F.col("cos"))).alias("score"))
    if "query" in queries.columns:
        asked = _asked(queries)
        least = F.lit(profile.least_score) * F.when(F.col("short"), SHORT_FACTOR).otherwise(1.0)
        scored = scored.join(asked.drop("query_vector"), "query_id").where(F.col("score") >= least)
    scored = staged(trace, scored, "vector_search").join(active.drop("score"), "id")
    if "query" in queries.columns:
        boost = S.anchor_boost(F.col("score"), T.overlap(F.col("__q"), T.tokens(F.col("anchor"))))
        scored = staged(trace, scored.withColumn("score", boost).drop("__q", "short"), "anchor_boost")
    scored = shared_stages(scored, profile, now, trace)
    if suppressed is not None:
        seen = suppressed.select("id", F.lit(True).alias("__seen")).distinct()
        scored = scored.join(seen, "id", "left").withColumn("score", S.suppress(F.col("score"), F.coalesce("__seen", F.lit(False)))).drop("__seen")
        scored = staged(trace, scored, "session_suppression")
    return staged(trace, finalise(scored, limit), "finalise")


def hybrid_pipeline(df: DataFrame, queries: DataFrame, words: DataFrame, profile: Profile, now: int, limit: int = 10, graph: DataFrame | None = None, judged: DataFrame | None = None, trace: Trace | None = None, near: DataFrame | None = None) -> DataFrame:
    """Vectors, keywords and the graph, fused by weight; summaries (P1), anchors (P2), the least score, a second look (P3 or P4), the shared stages, diversity of sources.

    `queries` is (query_id, query, query_vector); `words` and `graph` are the other channels'
    (query_id, id, score), `judged` what a cross-encoder said of (query_id, id), where one is
    at hand; without it the cosine takes its place.  `near` is what `nearest` gave, where it is at hand.
    """
    active, asked = df.where(is_active(F.col("status"))), _asked(queries)
    live = lambda rows: rows.select("query_id", "id", "score").join(active.select("id"), "id", "left_semi")
    near = (nearest(df, queries) if near is None else near).where(F.col("rank") <= profile.candidates).select("query_id", "id", S.clamp01(1 / (2 - F.col("cos"))).alias("score"))
    near = staged(trace, near, "vector_search", ())
    found = staged(trace, live(words), "bm25_search", ())
    linked = near.where(F.lit(False)) if graph is None else staged(trace, live(graph), "graph_search", ())
    fused = search.fuse(near, found, linked, asked.select("query_id", "short"), profile.vector_weight, profile.keyword_weight)
    fused = staged(trace, fused, "fusion", ("vector_search", "bm25_search", *(() if graph is None else ("graph_search",))))
    rows = fused.select("query_id", "id", "score").join(active.drop("score"), "id").join(asked, "query_id")
    share = lambda c: F.when(F.col(c).isNotNull(), T.overlap(F.col("__q"), T.tokens(F.col(c))))
    rows = staged(trace, rows.withColumn("score", S.multi_vector_blend(F.col("score"), share("l0_abstract"), share("l1_overview"), F.size("__q"))), "multi_vector_blend")
    rows = staged(trace, rows.withColumn("score", S.anchor_boost(F.col("score"), T.overlap(F.col("__q"), T.tokens(F.col("anchor"))))), "anchor_boost")
    rows = staged(trace, rows.where(F.col("score") >= F.lit(profile.least_score) * F.when(F.col("short"), SHORT_FACTOR).otherwise(1.0)), "min_score_filter")
    rows = rows.withColumn("__place", _place()).where(F.col("__place") <= 2 * limit).drop("__place")
    if judged is None:
        again = S.cosine_rerank(F.col("score"), V.cosine("vector", "query_vector"))
    else:
        rows = rows.join(judged.select("query_id", "id", F.col("judged").alias("__judged")), ["query_id", "id"], "left")
        again = S.rerank_blend(F.col("score"), F.col("__judged"))
    rows = staged(trace, rows.withColumn("score", again).drop("__judged", "__q", "short", "query_vector"), "rerank")
    return staged(trace, selecting.source_diversity(shared_stages(rows, profile, now, trace), limit, "scope_root"), "finalise")
