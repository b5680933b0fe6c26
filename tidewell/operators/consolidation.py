"""One consolidation run over all scopes at once, and runs to a fixed point.

A run goes over the active rows of each scope and category in their order.  A row that is
in no cluster yet becomes a seed, and all rows that are near enough and in no cluster join
it; that is the lexicographically first independent set (`similar.first_centers`).  Of each
cluster the member with the highest score is the canonical one.  Another member is merged
into it if it is very near or if the facts drawn from both are mostly the same, and is
linked otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import vector as V
from tidewell.operators.graph import materialise
from tidewell.operators.similar import first_centers, near_pairs, oriented, vector_classes

MENTION, MENTION_CAP = 0.06, 1.1


def facts_jaccard(pairs: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """`pairs` (id, canonical, ...) with `jaccard` of their fact sets; 0 if one has fewer than `least`.  `facts` is (id, fact), each once."""
    sizes = facts.groupBy("id").agg(F.count("*").alias("n"))
    mine = pairs.join(facts, "id").select("id", "canonical", "fact")
    common = mine.join(facts.withColumnRenamed("id", "canonical"), ["canonical", "fact"]).groupBy("id").agg(F.count("*").alias("common"))
    sized = pairs.join(common, "id", "left").join(sizes.withColumnRenamed("n", "n1"), "id", "left")
    sized = sized.join(sizes.withColumnsRenamed({"id": "canonical", "n": "n2"}), "canonical", "left")
    both = (F.coalesce("n1", F.lit(0)) >= least) & (F.coalesce("n2", F.lit(0)) >= least)
    share = F.coalesce("common", F.lit(0)) / (F.col("n1") + F.col("n2") - F.coalesce("common", F.lit(0)))
    return sized.withColumn("jaccard", F.when(both, share).otherwise(0.0)).drop("common", "n1", "n2")


def consolidate_once(
    df: DataFrame,
    facts: DataFrame,
    cluster_score: float = 0.82,
    merge_score: float = 0.92,
    least_jaccard: float = 0.5,
    least_facts: int = 2,
    recall: float = 0.9999,
) -> DataFrame:
    """(id, canonical, action, score, jaccard) of each row of a cluster; action is canonical, merge or link.

    `df` is (id, scope, category, vector, importance, accesses, place): the active rows, and
    the order in which a scope lists them; `facts` is (id, fact, mentions).  Scores are search
    scores, 1 / (2 - cosine); a member that is not near to the canonical one itself has the
    cluster's least score.
    """
    facts = materialise(facts.select("id", "fact", "mentions"))  # read four times
    group = ["scope", "category"]
    rows = materialise(vector_classes(df.select("id", *group, "vector", "importance", "accesses", "place"), group, [F.col("place")]).withColumn("o", F.struct("place", "id")))
    own = rows.where("id = first and vector is not null")
    seeds = first_centers(oriented(near_pairs(own, V.cosine_of_score(cluster_score), group, recall), own))
    member = rows.join(seeds.withColumnRenamed("id", "first"), "first", "left").withColumn("seed", F.coalesce("center", "first"))
    many = member.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    mentions = facts.groupBy("id").agg(F.max("mentions").alias("mentions"))
    boost = F.least(F.lit(MENTION_CAP), 1 + MENTION * F.log1p(F.coalesce("mentions", F.lit(0))))
    worth = F.round(F.col("importance") * (1 + F.log1p("accesses")) * boost, 9)
    clustered = materialise(member.join(many, "seed").join(mentions, "id", "left").select("id", "seed", "vector", "o", worth.alias("worth")))
    best = clustered.groupBy("seed").agg(F.min(F.struct((-F.col("worth")).alias("w"), "o", "id"))["id"].alias("canonical"))
    vectors = clustered.select(F.col("id").alias("canonical"), F.col("vector").alias("canonical_vector"))
    pairs = clustered.join(best, "seed").join(vectors, "canonical")
    # Equal vectors are near whatever rounding says.
    cos = F.when(F.col("vector") == F.col("canonical_vector"), 1.0).otherwise(V.cosine("vector", "canonical_vector"))
    pairs = materialise(pairs.select("id", "canonical", F.round(1 / (2 - cos), 9).alias("score")))
    scored = facts_jaccard(pairs, facts.select("id", "fact").distinct(), least_facts)
    score = F.when(F.col("score") >= cluster_score, F.col("score")).otherwise(cluster_score)
    action = F.when(F.col("id") == F.col("canonical"), "canonical").when((score >= merge_score) | (F.col("jaccard") >= least_jaccard), "merge").otherwise("link")
    return scored.select("id", "canonical", action.alias("action"), score.alias("score"), "jaccard")


def consolidate(df: DataFrame, facts: DataFrame, most_runs: int = 20, **settings: float) -> DataFrame:
    """(id, canonical, action, run): runs until none merges; merged rows are out of the next one, so canonicals are chosen anew.

    A row has the action of the last run that it was in.
    """
    left, merged = df, None
    for run in range(1, most_runs + 1):
        found = materialise(consolidate_once(left, facts, **settings).select("id", "canonical", "action", F.lit(run).alias("run")))
        gone = found.where("action = 'merge'")
        if run == most_runs or not gone.limit(1).count():
            return found if merged is None else merged.unionByName(found)
        merged = gone if merged is None else merged.unionByName(gone)
        left = materialise(left.join(gone.select("id"), "id", "left_anti"))
    return merged
