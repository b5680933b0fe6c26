"""Graph operators over triples: neighbourhoods, personalised PageRank, chains, components.

Iterations run as joins over edge tables; each round is written out (`materialise`), so
plans stay short and a lost executor costs one round.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How much a predicate's edge weighs.
PREDICATE_WEIGHT = {
    "created_by": 0.95, "depends_on": 0.90, "uses": 0.90, "works_with": 0.80, "works_at": 0.80, "friend_of": 0.75, "member_of": 0.75, "knows": 0.75, "manages": 0.75, "built": 0.85,
    "wrote": 0.85, "prefers": 0.70, "discussed": 0.70, "lives_in": 0.70, "located_in": 0.70, "mentioned_in": 0.60, "related_to": 0.50, "is_a": 0.80, "has": 0.75,
}


def shared_path(spark: SparkSession) -> str:
    """A folder of this application that all executors share, below the session's spark.checkpoint.dir; it goes when the driver ends.

    Only a session on a single machine may have none (as in tests): then it is one on this machine.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"{(where or '/tmp/tidewell-checkpoints').rstrip('/')}/tidewell-{sc.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write a round to the folder that all executors share, and read it back."""
    spark = df.sparkSession
    path = f"{shared_path(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edge_weight(predicate: Column) -> Column:
    out = F.lit(0.60)
    for p, w in PREDICATE_WEIGHT.items():
        out = F.when(predicate == p, w).otherwise(out)
    return out


def edges(triples: DataFrame) -> DataFrame:
    """G1: (src, dst, w), both directions of every distinct triple."""
    w = edge_weight(F.col("predicate")) * F.col("confidence")
    one = triples.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence")).withColumn("w", w)
    both = F.explode(F.array(F.struct(F.col("subject").alias("src"), F.col("object").alias("dst"), "w"), F.struct(F.col("object").alias("src"), F.col("subject").alias("dst"), "w")))
    return one.select(both.alias("e")).select("e.*")


def neighbourhood(edge: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(entity, hop, path) of what can be reached in up to `hops`, with its least hop and a shortest path.

    Only the frontier joins with the edges in each round.
    """
    seen = seeds.select("entity", F.lit(0).alias("hop"), F.array("entity").alias("path"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edge, frontier["entity"] == edge["src"]).select(F.col("dst").alias("entity"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("entity").agg(F.min("path").alias("path")).join(seen.select("entity"), "entity", "left_anti")
        frontier = materialise(step.select("entity", F.lit(hop).alias("hop"), "path"))
        seen = seen.unionByName(frontier)
    return seen


def pagerank(edge: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, tolerance: float = 0.001) -> DataFrame:
    """(entity, rank_score) by personalised PageRank; restarts go to the seeds only, in equal parts.

    Entities of score 0 are left out, so a round touches only what the seeds have reached.
    """
    out = edge.groupBy("src").agg(F.sum("w").alias("total"))
    flow = materialise(edge.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    present = seeds.select("entity").distinct().join(flow.select(F.col("src").alias("entity")).distinct(), "entity", "left_semi")
    n = present.count()
    if not n:
        return present.select("entity", F.lit(0.0).alias("rank_score"))
    restart = materialise(present.select("entity", F.lit(1.0 / n).alias("rank_score")))
    scores = restart
    for _ in range(iterations):
        moved = scores.join(flow, scores["entity"] == flow["src"]).select(F.col("dst").alias("entity"), (F.col("rank_score") * F.col("p") * damping).alias("s"))
        back = restart.select("entity", (F.col("rank_score") * (1 - damping)).alias("s"))
        fresh = materialise(moved.unionByName(back).groupBy("entity").agg(F.sum("s").alias("rank_score")))
        last, scores = scores, fresh
        if tolerance > 0:
            step = fresh.select("entity", F.col("rank_score").alias("s")).join(last, "entity", "full_outer")
            if step.agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("rank_score", F.lit(0.0))))).first()[0] < tolerance:
                break
    return scores


def pagerank_batch(edge: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """G3 for many queries at once: (query_id, entity, rank_score); `seeds` is (query_id, entity), restarts go to a query's own seeds in equal parts.

    A round joins what every query has reached with the edges; queries without a seed in the graph have no rows.
    """
    out = edge.groupBy("src").agg(F.sum("w").alias("total"))
    flow = materialise(edge.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    present = seeds.select("query_id", "entity").distinct().join(flow.select(F.col("src").alias("entity")).distinct(), "entity", "left_semi")
    n = present.groupBy("query_id").agg(F.count("*").alias("n"))
    restart = materialise(present.join(n, "query_id").select("query_id", "entity", (1 / F.col("n")).alias("rank_score")))
    scores, back = restart, restart.select("query_id", "entity", (F.col("rank_score") * (1 - damping)).alias("s"))
    for _ in range(iterations):
        moved = scores.join(flow, scores["entity"] == flow["src"]).select("query_id", F.col("dst").alias("entity"), (F.col("rank_score") * F.col("p") * damping).alias("s"))
        scores = materialise(moved.unionByName(back).groupBy("query_id", "entity").agg(F.sum("s").alias("rank_score")))
    return scores


def chain(links: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """(start, id, depth): a start and what superseded it, step by step; `links` is (id, superseded_by)."""
    at = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    every = at
    step = links.where("superseded_by is not null").select(F.col("id").alias("from_id"), "superseded_by")
    for d in range(1, most + 1):
        at = materialise(at.join(step, at["id"] == step["from_id"]).select("start", F.col("superseded_by").alias("id"), F.lit(d).alias("depth")))
        if not at.limit(1).count():
            break
        every = every.unionByName(at)
    return every


def components(edge: DataFrame) -> DataFrame:
    """(id, root) for undirected edges (a, b): the smallest id of each component, by hooking and shortcutting.

    Tables of ids are small as files and large in memory, so no join may broadcast them.
    """
    e = materialise(edge.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).where("id <> root").distinct())
    while True:
        low = materialise(e.groupBy("id").agg(F.min("root").alias("low")))
        up = low.select(F.col("id").alias("root"), F.col("low").alias("above"))
        if low.count() == e.count() and not low.join(up.hint("merge"), F.col("low") == up["root"], "left_semi").limit(1).count():
            return low.withColumnRenamed("low", "root").unionByName(low.select(F.col("low").alias("id"), F.col("low").alias("root")).distinct())
        under = e.join(low.hint("merge"), "id").select(F.explode(F.array(F.struct("id", F.col("low").alias("root")), F.struct(F.col("root").alias("id"), F.col("low").alias("root")))).alias("e")).select("e.id", "e.root").where("root <> id")
        raised = under.join(up.hint("merge"), "root", "left")
        e = materialise(raised.select("id", F.coalesce("above", "root").alias("root")).unionByName(raised.where("above is not null").select(F.col("root").alias("id"), F.col("above").alias("root"))).distinct())
