"""What happens to memories over time: archiving, forgetting, boosting, superseding, promoting, reminding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import scoring as S
from tidewell.functions import vector as V



def is_active(status: Column) -> Column:
    """Active or pending review; a missing status is active."""
    return F.coalesce(status, F.lit("active")).isin("active", "pending_review")


def retention(age: Column, active_rank: Column, after_days: int = 0, most: int = 0) -> Column:
    """Why a policy archives a row, null if it does not; 0 switches a rule off.  `active_rank` counts a scope's rows in scan order."""
    out = F.when(F.lit(after_days > 0) & (age > after_days), "age")
    return out.when(F.lit(most > 0) & (active_rank > most), "count")


def collect_garbage(df: DataFrame, now: int, threshold: float = 0.15, least_age: int = 30, most: int = 100, after_days: int = 0, most_rows: int = 0) -> DataFrame:
    """(id, reason) of the rows that one run archives: worn out and old, or against the policy; the important are safe."""
    active = df.where(is_active(F.col("status")))
    age = S.age_days(F.col("ts"), now)
    expired = F.coalesce(F.col("valid_until") < now, F.lit(False))
    score = S.decay_score(F.coalesce("valid_from", "ts"), F.col("evo_access_count"), F.col("last_accessed_at"), F.col("importance"), now) * F.when(expired, 0.5).otherwise(1.0)
    rank = F.row_number().over(W.partitionBy("scope").orderBy(F.col("ts").desc(), "id")) if most_rows else F.lit(0)
    reason = F.coalesce(F.when((score < threshold) & (age >= least_age), "decay"), retention(age, rank, after_days, most_rows))
    return active.withColumn("decay", score).withColumn("reason", reason).where(F.col("reason").isNotNull() & (F.col("importance") < 0.95)).orderBy(F.round("decay", 9), "id").limit(most).select("id", "scope", "decay", "reason")


def cascade(neighbours: DataFrame, threshold: float = 0.70, cut: float = 0.3, floor: float = 0.05, most: int = 10) -> DataFrame:
    """New importance and tier of what is near to a forgotten row; the nearer, the lower.  Input (query_id, id, score, importance, tier, status)."""
    near = neighbours.where((F.col("score") >= threshold) & is_active(F.col("status")) & (F.col("id") != F.col("query_id")))
    new = F.greatest(F.col("importance") - cut * (F.col("score") - threshold) / (1 - threshold), F.lit(floor))
    near = near.withColumn("new_importance", new).where(F.abs(F.col("new_importance") - F.col("importance")) >= 0.01)
    tier = F.when((F.col("tier") == "working") & (new < 0.5), "peripheral").when((F.col("tier") == "core") & (new < 0.8), "working").otherwise(F.col("tier"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return near.withColumn("new_tier", tier).withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", "new_importance", "new_tier")


def retroactive_boost(neighbours: DataFrame, now: int, trigger: float = 0.8, below: float = 0.6, boost: float = 0.15, cap: float = 0.75, most: int = 5, least_days: int = 1) -> DataFrame:
    """An important new row lifts older, less important neighbours.  Input (query_id, query_importance, id, score, importance, ts)."""
    near = neighbours.where((F.col("query_importance") >= trigger) & (F.col("importance") < below) & (S.age_days(F.col("ts"), now) >= least_days))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", F.least(F.col("importance") + boost, F.lit(cap)).alias("new_importance"))


def supersede(old: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Slowly changing rows of type 2.  A change (id, text) ends the current version of its id and opens the next one.

    Rows have id, version, text, valid_from, valid_until; the current version has no end.
    """
    c = changes.select("id", F.col("text").alias("__text"))
    hit = old.where("valid_until is null").join(c, "id").where("text <> __text")
    ended = old.join(hit.select("id", "version"), ["id", "version"], "left_semi").withColumn("valid_until", F.lit(now))
    opened = hit.select("id", (F.col("version") + 1).alias("version"), F.col("__text").alias("text"), F.lit(now).alias("valid_from"), F.lit(None).cast("long").alias("valid_until"))
    new = changes.join(old.select("id"), "id", "left_anti").select("id", F.lit(1).cast("long").alias("version"), "text", F.lit(now).alias("valid_from"), F.lit(None).cast("long").alias("valid_until"))
    rest = old.join(hit.select("id", "version"), ["id", "version"], "left_anti")
    cols = ["id", "version", "text", "valid_from", "valid_until"]
    return rest.select(cols).unionByName(ended.select(cols)).unionByName(opened.select(cols)).unionByName(new.select(cols))


def write_disposition(category: Column, same_key: Column, same_text: Column, same_authority: Column) -> Column:
    """What becomes of a durable write that meets its canonical key."""
    return F.when(~same_key, "append").when(same_text, "duplicate").when(category.isin("events", "cases"), "append").when(category.isin("profile", "preferences") & same_authority, "latest_wins").otherwise("conflict")


def greedy_clusters(vectors: list[np.ndarray], threshold: float) -> list[int]:
    """Each row joins the first cluster whose running mean is near enough, or starts one."""
    means: list[np.ndarray] = []
    sizes: list[int] = []
    out = []
    for v in vectors:
        v = np.asarray(v, dtype=np.float64)
        best = next((c for c, m in enumerate(means) if len(m) == len(v) and np.dot(m, v) >= threshold * np.linalg.norm(m) * np.linalg.norm(v) > 0), None)
        if best is None:
            means.append(v.copy())
            sizes.append(1)
            out.append(len(means) - 1)
        else:
            sizes[best] += 1
            means[best] += (v - means[best]) / sizes[best]
            out.append(best)
    return out


def cluster_groups(df: DataFrame, threshold: float, group: str = "scope") -> DataFrame:
    """G7 within each group, in order of importance and id: (group, id, cluster).

    The result depends on the order, so a group is one unit of work; group by something fine.
    """

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["importance", "id"], ascending=[False, True])
        return g[[group, "id"]].assign(cluster=greedy_clusters(g["vector"].tolist(), threshold))

    return df.select(group, "id", "importance", "vector").groupBy(group).applyInPandas(f, f"{group} string, id string, cluster long")


def promotable(clusters: DataFrame, least_size: int = 3, least_importance: float = 0.6) -> DataFrame:
    """Clusters large and important enough.  Input (scope, cluster, id, importance)."""
    g = clusters.groupBy("scope", "cluster").agg(F.count("*").alias("size"), F.avg("importance").alias("importance"), F.sort_array(F.collect_list("id")).alias("ids"))
    return g.where((F.col("size") >= least_size) & (F.col("importance") >= least_importance))


def canonical_members(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Of each near-duplicate group (id, root) the member kept: importance (1 + ln(1 + accesses)), ties by id; others go into it."""
    scored = pairs.join(df.select("id", "importance", "evo_access_count"), "id").withColumn("s", F.round(F.col("importance") * (1 + F.log1p("evo_access_count")), 9))
    best = F.first("id").over(W.partitionBy("root").orderBy(F.col("s").desc(), "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return scored.select("id", "root", best.alias("canonical"))


BLOCK_ROWS = 32_768  # rows of one block at most
CELLS = 2_000_000  # products that a unit holds at once


def _similar(df: DataFrame, threshold: float, group: list[str], block: int, differ: str | None, out: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """`out` of the linked pairs (ids, i, j, cos) of each unit: rows of a group with at least that cosine, that differ in `differ` if given.

    A group is cut into up to 8 blocks of `block` rows or more by hash, into more only where a
    block would have over BLOCK_ROWS rows, and each pair of blocks is a unit of work; vectors
    travel once for each partner block.  A unit holds the products of a few rows at a time, and
    `merge` sums up what `out` said of them.
    """
    sized = df.groupBy(*group).agg(F.count("*").alias("__n"))
    rows = df.select(*group, "id", "vector", (F.col(differ) if differ else F.lit(None).cast("string")).alias("__kind"))
    rows = rows.join(sized, group).withColumn("__parts", F.greatest(F.least(F.ceil(F.col("__n") / block), F.lit(8)), F.ceil(F.col("__n") / BLOCK_ROWS)).cast("int"))
    at = F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")
    rows = rows.withColumn("__at", at).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    rows = rows.select(*group, F.least("__at", "__other").alias("__i"), F.greatest("__at", "__other").alias("__j"), "__at", "__kind", "id", "vector")

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        m = np.stack([np.asarray(v, np.float64) for v in g["vector"]])
        n = np.linalg.norm(m, axis=1)
        m = m / np.where(n > 0, n, 1)[:, None]
        ids, at, kind = g["id"].to_numpy(), g["__at"].to_numpy(), g["__kind"].to_numpy()
        same = g["__i"].iloc[0] == g["__j"].iloc[0]
        found, step = [], max(1, CELLS // len(m))
        for k in range(0, len(m), step):
            i, j = np.nonzero(m[k : k + step] @ m.T >= threshold - 1e-12)
            i = i + k
            good = i < j
            if not same:
                good &= at[i] != at[j]
            if differ:
                good &= kind[i] != kind[j]
            i, j = i[good], j[good]
            found.append(out(ids, i, j, (m[i] * m[j]).sum(axis=1)))
            if sum(map(len, found)) > CELLS // 4:
                found = [merge(pd.concat(found))]
        return merge(pd.concat(found))

    return rows.groupBy(*group, "__i", "__j").applyInPandas(f, schema)


def similar_links(df: DataFrame, threshold: float, group: list[str], block: int = 2048, differ: str | None = None) -> DataFrame:
    """(id, links): how many rows of its group each linked row is near to.  Units return counts, never pairs."""

    def counts(ids: np.ndarray, i: np.ndarray, j: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        n = np.bincount(np.concatenate([i, j]), minlength=len(ids))
        return pd.DataFrame({"id": ids[n > 0], "links": n[n > 0]})

    return _similar(df, threshold, group, block, differ, counts, "id string, links long", lambda d: d.groupby("id", as_index=False)["links"].sum()).groupBy("id").agg(F.sum("links").alias("links"))


def best_pairs(df: DataFrame, threshold: float, group: list[str], most: int, block: int = 2048, differ: str | None = None) -> DataFrame:
    """(a, b, cos) of the `most` nearest pairs, ties by id; a unit returns as many at most."""

    def top(ids: np.ndarray, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pd.DataFrame:
        return first(pd.DataFrame({"a": ids[i], "b": ids[j], "cos": cos}))

    def first(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.assign(r=pairs["cos"].round(9)).sort_values(["r", "a", "b"], ascending=[False, True, True]).head(most)[["a", "b", "cos"]]

    return _similar(df, threshold, group, block, differ, top, "a string, b string, cos double", lambda d: first(d)).orderBy(F.round("cos", 9).desc(), "a", "b").limit(most)


def triggered(reminders: DataFrame, message: str, now: int) -> DataFrame:
    """Pending reminders (id, trigger, expires_at) all of whose words of 2 characters or more are in the message."""
    words = F.filter(F.split(F.lower("trigger"), r"[\s,;，；]+"), lambda w: F.length(w) >= 2)
    alive = F.col("expires_at").isNull() | (F.col("expires_at") >= now)
    return reminders.where(alive & (F.size(words) > 0) & F.forall(words, lambda w: F.lit(message.lower()).contains(w)))


def checkpoint_fate(records: DataFrame, now: int, keep_rich: int = 5) -> DataFrame:
    """Keep, archive or delete: the newest rich records of a scope and each session's newest of two days stay."""
    rich_rank = F.row_number().over(W.partitionBy("scope", "rich").orderBy(F.col("at_ms").desc(), "id"))
    session_rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("at_ms").desc(), "id"))
    age = S.age_days(F.col("at_ms"), now)
    fate = (
        F.when(F.col("rich") & (rich_rank <= keep_rich), "keep")
        .when((session_rank == 1) & (age <= 2), "keep")
        .when(~F.col("rich") & (age > 7), "delete")
        .when(F.col("rich") & (age > 30), "archive")
        .otherwise("keep")
    )
    return records.withColumn("fate", fate)


def usable_centroid(df: DataFrame, group: str) -> DataFrame:
    """Element-wise mean of each group's vectors."""
    parts = df.select(group, F.posexplode("vector").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def cosine_to(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key).withColumn("cos", V.cosine("vector", "centroid"))
