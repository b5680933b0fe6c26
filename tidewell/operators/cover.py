"""A greedy choice of texts for many tasks at once, in rounds over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import materialise


def greedy_cover(candidates: DataFrame, cues: DataFrame, limit: int, gain: float = 3.0, late: float = 0.01) -> DataFrame:
    """(task, rank, id): of each task's candidates up to `limit`, each time the one worth most.

    `candidates` is (task, id, text, priority, position); of those whose texts are the same
    but for case and blanks the first counts.  `cues` is (task, id, cue).  A candidate is
    worth its priority, `gain` for each of its cues that no chosen one has, and `late` less for
    each place further down; of equal ones the first.  A round picks one for every task and
    removes the cues that it covers; so there are `limit` rounds, whatever the number of tasks.
    """
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = candidates.where(F.length(key) > 0).withColumn("key", F.xxhash64(key)).withColumn("key2", F.xxhash64(F.lit(1), key))
    firsts = rows.groupBy("task", "key", "key2").agg(F.min(F.struct("position", "id", "priority")).alias("f"))
    left = materialise(firsts.select("task", F.col("f.id").alias("id"), F.col("f.priority").alias("priority"), F.col("f.position").alias("position")))
    every = materialise(cues.select("task", "id", "cue").distinct().join(left.select("task", "id"), ["task", "id"], "left_semi"))
    open_, covered, chosen = every, None, None
    for rank in range(1, limit + 1):
        gains = open_.groupBy("task", "id").agg(F.count("*").alias("open"))
        worth = F.round(F.col("priority") + gain * F.coalesce("open", F.lit(0)) - late * F.col("position"), 9)
        best = left.join(gains, ["task", "id"], "left").groupBy("task").agg(F.min(F.struct((-worth).alias("w"), "position", "id"))["id"].alias("id"))
        best = materialise(best.select("task", F.lit(rank).alias("rank"), "id"))
        chosen = best if chosen is None else chosen.unionByName(best)
        if rank == limit or not best.limit(1).count():
            break
        left = materialise(left.join(best.select("task", "id"), ["task", "id"], "left_anti"))
        # Written, so that the few cues that are covered have a known size and the many open ones need not move.
        now = materialise(open_.join(best.select("task", "id"), ["task", "id"], "left_semi").select("task", "cue").distinct())
        covered = now if covered is None else covered.unionByName(now)
        open_ = every.join(covered, ["task", "cue"], "left_anti")
    return chosen
