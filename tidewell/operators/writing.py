"""The write pipeline as one call over a batch of requests: scan and redact, gates, keys, disposition, new rows, an audit trail.

What needs a language model (a summary of a long text, a judged importance) or an embedding
comes as a column of the batch, made before; without it long texts are cut.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import scoring as S
from tidewell.functions import text as T
from tidewell.operators import lifecycle, selecting
from tidewell.operators.graph import materialise

LONGEST = 8000


class Written(NamedTuple):
    records: DataFrame  # what became of each request
    rows: DataFrame  # rows to upsert
    audit: DataFrame


def write_memories(batch: DataFrame, store: DataFrame, now: int, most_per_minute: int = 50, own_prompts: list[str] = ()) -> Written:
    """What a batch of requests does to the store, and the records and audit lines of it.

    `batch` is (request_id, at, text, category, scope, importance, source, authority, confidence);
    `store` is (id, canonical_key, scope, category, authority, text) of the active rows, one for
    each scope and key.  Requests are taken in order of `at` and request_id.

    * Personal data is counted in the text as it came, and secrets are redacted before anything
      else sees it; a text over 8,000 characters is cut.
    * Refused, with a reason: short, noise, unimportant, or over `most_per_minute` requests of
      a scope in the minute before.
    * Of requests with one id (scope and text) the first is written, the others are duplicates.
    * The canonical key decides the rest: append, duplicate, latest_wins or conflict with the
      stored row of the scope and key, or with the first request of the batch that has it.
    """
    c = F.col
    seen = F.col("text")
    found = [n for n in T.pii_counts(seen).values()]
    high = [n for kind, n in T.pii_counts(seen).items() if kind not in ("phone", "email")]
    total = lambda parts: sum(parts[1:], parts[0])
    minute = W.partitionBy("scope").orderBy("at").rangeBetween(-60_000, -1)
    rows = batch.withColumns(
        {
            "pii": total(found),
            "pii_severity": F.when(total(high) > 0, "high").when(total(found) > 0, "medium"),
            "text": F.substring(T.redact(seen), 1, LONGEST),
            "recent": F.count("*").over(minute),
        }
    )
    rows = rows.withColumn("reason", selecting.admission(c("text"), T.is_noise(c("text"), own_prompts), c("importance"), c("recent"), most_recent=most_per_minute))
    rows = rows.withColumns({"id": T.content_id(c("scope"), c("text")), "canonical_key": T.default_key(c("category"), c("text"))})
    rows = materialise(rows)  # redaction and keys are worked out once

    order = [c("at"), c("request_id")]
    good = rows.where("reason is null")
    first = good.groupBy("id").agg(F.min(F.struct("at", "request_id"))["request_id"].alias("first"))
    good = good.join(first, "id").withColumn("again", c("request_id") != c("first"))
    kept = store.select("scope", "canonical_key", *(c(x).alias(f"old_{x}") for x in ("id", "category", "authority", "text")))
    met = good.join(kept, ["scope", "canonical_key"], "left")
    # The first new request of a key stands for it if the store has none.
    ahead = W.partitionBy("scope", "canonical_key").orderBy(*order)
    for x in ("id", "category", "authority", "text"):
        met = met.withColumn(f"old_{x}", F.coalesce(f"old_{x}", F.when(F.row_number().over(ahead) > 1, F.first(x).over(ahead.rowsBetween(W.unboundedPreceding, W.currentRow)))))
    fate = lifecycle.write_disposition(c("category"), c("old_id").isNotNull(), F.coalesce(c("old_text") == c("text"), F.lit(False)), F.coalesce(c("old_authority").eqNullSafe(c("authority")), F.lit(False)))
    fate = F.when(c("again"), "duplicate").otherwise(fate)
    met = materialise(met.withColumn("disposition", fate))

    confidence = F.coalesce("confidence", S.confidence_by_source(c("source")))
    target = F.when(c("disposition") == "latest_wins", c("old_id")).otherwise(c("id"))
    written = met.where("disposition in ('append', 'latest_wins')").withColumn("id", target)
    # Of several that replace one row the last counts.
    last = written.groupBy("id").agg(F.max(F.struct("at", "request_id"))["request_id"].alias("request_id"))
    new = written.join(last, ["id", "request_id"], "left_semi").select(
        "id", "text", "category", "scope", "importance", F.lit(now).alias("timestamp"), "canonical_key", "authority", confidence.alias("confidence"), T.topic_tag(c("text")).alias("topic_tag"), "pii", "pii_severity"
    )
    refused = rows.where("reason is not null").select("request_id", "scope", "category", "source", F.lit(None).cast("string").alias("id"), F.lit("rejected").alias("disposition"), "reason", F.lit(None).cast("string").alias("conflict_with"), "text", "pii", "pii_severity")
    done = met.select("request_id", "scope", "category", "source", target.alias("id"), "disposition", F.lit(None).cast("string").alias("reason"), F.when(c("disposition") == "conflict", c("old_id")).alias("conflict_with"), "text", "pii", "pii_severity")
    every = done.unionByName(refused)
    head = F.substring("text", 1, 100)
    audit = every.select(F.when(c("disposition") == "rejected", "reject").otherwise("store").alias("operation"), "scope", c("id").alias("memory_id"), c("source").alias("actor"), F.concat(F.coalesce("reason", "category"), F.lit(": "), head).alias("details"))
    return Written(every.drop("text"), new, audit)
