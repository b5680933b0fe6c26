"""The states of conflicts as the fold of an event log.

A conflict is detected (open), resolved, and may be detected again (reopened).  The state
after an event is that of the last event that says anything, so a run of events is summed up
by its first and last kind and by what happened inside, and such sums join to those of
longer runs.  A key's log is therefore cut into cells of time: cells fold by themselves and
only their sums are put in order for a key, so no task sorts a hot key's whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text as T

DETECT, RESOLVE = "detect", "resolve"


def fold_log(events: DataFrame, cell: int) -> DataFrame:
    """(key, status, detections, reopens, resolved, refused, opened_at, reopened_at, resolved_at) of each key that was ever detected.

    `events` is (key, at, seq, kind, outcome): kinds detect and resolve, others say nothing;
    `cell` is a span of `at`.  status is open or the outcome of the resolution.  A resolution
    of what is not open is refused and changes nothing.
    """
    said = events.where(F.col("kind").isin(DETECT, RESOLVE)).withColumn("cell", F.floor(F.col("at") / cell))
    inside = W.partitionBy("key", "cell").orderBy("at", "seq")
    steps = said.withColumn("before", F.coalesce(F.lag("kind").over(inside), F.lit("none")))
    opens = (F.col("kind") == DETECT) & (F.col("before") == RESOLVE)
    closes = (F.col("kind") == RESOLVE) & (F.col("before") == DETECT)
    place = F.struct("at", "seq")
    sums = steps.groupBy("key", "cell").agg(
        F.min_by("kind", place).alias("first"), F.max_by("kind", place).alias("last"),
        F.min_by("at", place).alias("first_at"), F.min_by("outcome", place).alias("first_outcome"),
        F.sum((F.col("kind") == DETECT).cast("long")).alias("detections"),
        F.sum(opens.cast("long")).alias("reopens"), F.max(F.when(opens, F.col("at"))).alias("reopened_at"),
        F.sum(closes.cast("long")).alias("resolved"), F.max(F.when(closes, F.struct("at", "seq", "outcome"))).alias("closed"),
        F.sum(((F.col("kind") == RESOLVE) & (F.col("before") == RESOLVE)).cast("long")).alias("refused"),
        F.min(F.when(F.col("kind") == DETECT, F.col("at"))).alias("opened_at"),
    )
    order = W.partitionBy("key").orderBy("cell")
    linked = sums.withColumns({"before": F.coalesce(F.lag("last").over(order), F.lit("none")), "known": F.coalesce(F.sum("detections").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    # What a cell's first event does depends on the cells before it; what is inside counts from its first detection on.
    reopens = (F.col("first") == DETECT) & (F.col("before") == RESOLVE) & (F.col("known") > 0)
    closes = (F.col("first") == RESOLVE) & (F.col("before") == DETECT)
    # A reopening inside a cell whose key was never detected before is its first opening.
    false_open = (F.col("known") == 0) & (F.col("first") == RESOLVE) & (F.col("detections") > 0)
    joined = linked.select(
        "key", "cell", "detections", "opened_at", "last",
        (F.col("reopens") + reopens.cast("long") - false_open.cast("long")).alias("reopens"),
        F.when(F.col("reopens") - false_open.cast("long") > 0, F.col("reopened_at")).otherwise(F.when(reopens, F.col("first_at"))).alias("reopened_at"),
        (F.col("resolved") + closes.cast("long")).alias("resolved"),
        F.coalesce("closed", F.when(closes, F.struct(F.col("first_at").alias("at"), F.lit(0).cast("long").alias("seq"), F.col("first_outcome").alias("outcome")))).alias("closed"),
        (F.col("refused") + ((F.col("first") == RESOLVE) & ~closes).cast("long")).alias("refused"),
    )
    out = joined.groupBy("key").agg(
        F.max_by("last", "cell").alias("last"), F.sum("detections").alias("detections"), F.sum("reopens").alias("reopens"), F.sum("resolved").alias("resolved"), F.sum("refused").alias("refused"),
        F.min("opened_at").alias("opened_at"), F.max("reopened_at").alias("reopened_at"), F.max("closed").alias("closed"),
    )
    open_ = F.col("last") == DETECT
    return out.where("detections > 0").select("key", F.when(open_, "open").otherwise(F.col("closed.outcome")).alias("status"), "detections", "reopens", "resolved", "refused", "opened_at", "reopened_at", F.when(~open_, F.col("closed.at")).alias("resolved_at"))


def attention(states: DataFrame, now: int, day: int, aging: float = 3, stale: float = 7, escalated: float = 14, reopens: int = 2) -> DataFrame:
    """Open conflicts with `age` in days since they were last opened and `attention`: fresh, aging, stale or escalated, by age or by how often they came back."""
    age = (F.lit(now) - F.coalesce("reopened_at", "opened_at")) / day
    level = F.when((F.col("age") >= escalated) | (F.col("reopens") >= reopens), "escalated").when(F.col("age") >= stale, "stale").when(F.col("age") >= aging, "aging").otherwise("fresh")
    return states.where("status = 'open'").withColumn("age", age).withColumn("attention", level)


#: Why a record is a conflict.
KEY_TAKEN, PROMOTION = "canonical_key_conflicts_with_existing_durable", "promotion_conflicts_with_existing_durable"


def advise(records: DataFrame, tighter: int = 2, alike: float = 0.72, apart: float = 0.35) -> DataFrame:
    """`records` with similarity, resolution, confidence and cluster_key.

    `records` is (conflict_id, canonical_key, reason, existing_text, existing_category,
    incoming_text, incoming_category, reopens, attention).  Texts are compared without
    punctuation, symbols and blanks; similarity is that of their character trigrams, in
    hundredths.  Of two that say nearly the same the one shorter by more than `tighter`
    characters wins.
    """
    compact = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[\p{P}\p{S}\s]+", "")
    rows = records.withColumns({"__a": compact(F.col("existing_text")), "__b": compact(F.col("incoming_text"))})
    equal = (F.col("__a") == F.col("__b")) & (F.col("__a") != "")
    similar = F.when(equal, 1.0).otherwise(T.set_similarity(T.trigrams(F.col("existing_text")), T.trigrams(F.col("incoming_text"))))
    rows = rows.withColumn("similarity", F.round(similar, 2))
    same = F.col("existing_category") == F.col("incoming_category")
    near = (F.col("reason") == PROMOTION) & same & (F.col("similarity") >= alike)
    shorter = F.length("__b") + tighter < F.length("__a")
    longer = F.length("__a") + tighter < F.length("__b")
    pick = lambda a, b: F.struct(F.lit(a).alias("resolution"), b.alias("confidence"))
    c = F.lit
    advice = (
        F.when(equal, pick("keep_existing", c("high")))
        .when((F.col("reason") == KEY_TAKEN) & ~same, pick("keep_existing", F.when(F.col("reopens") > 0, "high").otherwise("medium")))
        .when(near & shorter, pick("accept_incoming", c("medium")))
        .when(near & longer, pick("keep_existing", c("medium")))
        .when(near, pick("manual_review", c("low")))
        .when(F.col("similarity") < apart, pick("manual_review", F.when(F.col("attention").isin("stale", "escalated"), "high").otherwise("medium")))
        .otherwise(pick("manual_review", c("low")))
    )
    key = F.concat_ws("::", F.coalesce(F.nullif(T.canonical_key(F.col("canonical_key")), F.lit("")), F.lit("na")), "reason", "incoming_category")
    return rows.withColumn("__advice", advice).select(*records.columns, "similarity", "__advice.resolution", "__advice.confidence", F.substring(key, 1, 240).alias("cluster_key"))
