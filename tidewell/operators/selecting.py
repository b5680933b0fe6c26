"""Choosing from ranked lists: deduplication, diversity, budgets, admission.

Operators whose result depends on the order of a short list run once for each query in
a grouped pandas function (lists are of at most a few dozen rows by construction); the
others are window expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIST = "query_id string, id string, score double, vector array<float>"


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.0
    d = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / d if d else 0.0


def defer_similar(rows: list[np.ndarray], threshold: float = 0.85) -> list[int]:
    """Order of the list after rows too similar to one already taken are moved to its end."""
    taken, late = [], []
    for i, v in enumerate(rows):
        (late if any(_cos(v, rows[j]) > threshold for j in taken) else taken).append(i)
    return taken + late


def filter_interference(rows: list[np.ndarray], scores: list[float], threshold: float = 0.85, ratio: float = 0.8, top: int = 3) -> list[tuple[int, float]]:
    """(row, score) after weak near-duplicates are dropped and rows beyond a cluster's first `top` are halved and moved to the end.

    Lists of up to 2 rows stay as they are.
    """
    if len(rows) <= 2:
        return list(enumerate(scores))
    kept: list[tuple[int, int]] = []  # row, cluster
    sizes: list[int] = []
    late: list[tuple[int, float]] = []
    for i, v in enumerate(rows):
        match = next(((j, c) for j, c in kept if _cos(v, rows[j]) > threshold), None)
        if match is None:
            kept.append((i, len(sizes)))
            sizes.append(1)
        elif scores[i] < scores[match[0]] * ratio:
            continue
        elif sizes[match[1]] >= top:
            late.append((i, scores[i] * 0.5))
        else:
            kept.append((i, match[1]))
            sizes[match[1]] += 1
    return [(i, scores[i]) for i, _ in kept] + late


def _per_query(df: DataFrame, f: object, schema: str) -> DataFrame:
    return df.select("query_id", "id", "score", "vector").groupBy("query_id").applyInPandas(f, schema)


def mmr(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        order = defer_similar(g["vector"].tolist(), threshold)
        return g.loc[order, ["query_id", "id", "score"]].assign(position=range(1, len(g) + 1))

    return _per_query(df, f, "query_id string, id string, score double, position long")


def interference(df: DataFrame, threshold: float = 0.85, ratio: float = 0.8, top: int = 3) -> DataFrame:
    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        out = filter_interference(g["vector"].tolist(), g["score"].tolist(), threshold, ratio, top)
        return pd.DataFrame({"query_id": [g["query_id"][i] for i, _ in out], "id": [g["id"][i] for i, _ in out], "score": [s for _, s in out], "position": range(1, len(out) + 1)})

    return _per_query(df, f, "query_id string, id string, score double, position long")


def best_version(df: DataFrame, group: str, rank: str, order: list[Column]) -> DataFrame:
    """D3: of each version group the row with the highest rank, the first in order among equals; rows without a group stay."""
    w = W.partitionBy(group).orderBy(F.col(rank).desc_nulls_last(), *order)
    alone = df.where(F.col(group).isNull())
    return df.where(F.col(group).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").unionByName(alone)


def drop_covered(df: DataFrame, insights: DataFrame) -> DataFrame:
    """Without the rows that an insight in the list (id, source_memories) was made from."""
    covered = insights.select(F.explode("source_memories").alias("id")).distinct()
    return df.join(covered, "id", "left_anti")


def source_diversity(df: DataFrame, limit: int, source: str = "scope") -> DataFrame:
    """The best of each source first, then the rest by score, if there are more rows than wanted and 3 sources or more."""
    all_ = W.partitionBy("query_id")
    rn = F.row_number().over(W.partitionBy("query_id", source).orderBy(F.col("score").desc(), "id"))
    df = df.withColumn("__rn", rn).withColumn("__n", F.count("*").over(all_)).withColumn("__first", F.sum((F.col("__rn") == 1).cast("int")).over(all_))
    spread = (F.col("__n") > limit) & (F.col("__first") >= 3)
    order = W.partitionBy("query_id").orderBy(F.when(spread & (F.col("__rn") > 1), 1).otherwise(0), F.col("score").desc(), "id")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("__rn", "__n", "__first")


def govern(df: DataFrame, seen: DataFrame, budget: int = 8000, most: int = 10) -> DataFrame:
    """Unseen active rows by score while their characters fit; the first always stays, the first that overflows ends the list."""
    left = df.where(F.col("status").isin("active", "pending_review")).join(seen.select("id"), "id", "left_anti")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    run = left.withColumn("position", F.row_number().over(w)).withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.where(((F.col("chars") <= budget) | (F.col("position") == 1)) & (F.col("position") <= most))


def collapse(rows: list[tuple[float, int, int, int]], budget: int = 8000, levels: tuple[float, float, float] = (0.85, 0.65, 0.50)) -> list[str]:
    """Level of detail of each ranked row (score, tokens of full text, overview, abstract): what its score earns, less if the budget asks for it."""
    out, used = [], 0
    for score, full, middle, least in rows:
        wanted = 2 if score >= levels[0] else 1 if score >= levels[1] else 0 if score >= levels[2] else -1
        level = next((k for k in range(wanted, -1, -1) if used + (least, middle, full)[k] <= budget), -1)
        used += (least, middle, full)[level] if level >= 0 else 0
        out.append({2: "L2", 1: "L1", 0: "L0", -1: "drop"}[level])
    return out


def collapse_to_budget(df: DataFrame, budget: int = 8000) -> DataFrame:
    """D7 for each query of (query_id, id, score, full, middle, least)."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        g["level"] = collapse(list(g[["score", "full", "middle", "least"]].itertuples(index=False, name=None)), budget)
        return g[["query_id", "id", "level"]]

    return df.groupBy("query_id").applyInPandas(f, "query_id string, id string, level string")


def batch_dedup(vectors: list[np.ndarray], threshold: float = 0.93) -> list[bool]:
    """D8 for one short list: which rows stay, the earlier of two near-duplicates first; `similar.batch_dedup` is for tables."""
    kept: list[int] = []
    out = []
    for i, v in enumerate(vectors):
        out.append(not any(_cos(v, vectors[j]) > threshold for j in kept))
        if out[-1]:
            kept.append(i)
    return out


def dedup_decision(nearest_cos: Column, same_text: Column, preference_conflict: Column) -> Column:
    """What becomes of a chunk by its nearest neighbour's search score (0.92 hard, 0.78 to be judged)."""
    score = 1 / (2 - nearest_cos)
    return F.when(same_text, "exact").when(nearest_cos.isNull(), "unique").when((score >= 0.92) & ~preference_conflict, "hard").when(score >= 0.78, "llm").otherwise("unique")


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))  # D10


def exact_dedup(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each normalised text."""
    w = W.partitionBy(F.sha2(normal_text(F.col("text")).cast("binary"), 256)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered_merge(parts: list[DataFrame], limit: int) -> DataFrame:
    """Lists (query_id, id, position) in order of priority; the first place of an id counts."""
    every = None
    for n, p in enumerate(parts):
        p = p.select("query_id", "id", F.lit(n).alias("part"), F.col("position").cast("long").alias("position"))
        every = p if every is None else every.unionByName(p)
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("part", "position")).alias("at"))
    w = W.partitionBy("query_id").orderBy("at.part", "at.position", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "id", "at.part", "place")


def diverse_nodes(df: DataFrame, linked: DataFrame, limit: int) -> DataFrame:
    """Linked rows first, then the categories in turn by importance."""
    flagged = df.join(linked.select("id").distinct().withColumn("linked", F.lit(True)), "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    turn = F.row_number().over(W.partitionBy("linked", "category").orderBy(F.col("importance").desc(), "id"))
    return flagged.withColumn("turn", turn).orderBy(F.col("linked").desc(), "turn", "category", "id").limit(limit)


def preference_action(cos: Column) -> Column:
    """Skip what is there already, merge what is close, create the rest; by search score."""
    score = 1 / (2 - cos)
    return F.when(score >= 0.92, "skip").when(score >= 0.78, "merge").otherwise("create")


def admission(text: Column, noise: Column, importance: Column, recent_writes: Column, least_chars: int = 10, least_importance: float = 0.2, most_recent: int = 50) -> Column:
    """F16: why a write is refused, null if it is not."""
    return F.when(F.length(F.trim(text)) < least_chars, "too_short").when(noise, "noise").when(importance < least_importance, "low_importance").when(recent_writes >= most_recent, "rate_limited")


def layer_admission(df: DataFrame, evidence: Column, least: int = 3) -> DataFrame:
    """without evidence rows, unless fewer than `least` durable ones are left for the query."""
    n = F.sum((~evidence).cast("int")).over(W.partitionBy("query_id"))
    return df.withColumn("__n", n).where(~evidence | (F.col("__n") < least)).drop("__n")


def zero_hit_fallback(df: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass; all rows of a query of which none does."""
    any_ = F.max(passes.cast("int")).over(W.partitionBy("query_id"))
    return df.withColumn("__any", any_).where(passes | (F.col("__any") == 0)).drop("__any")
