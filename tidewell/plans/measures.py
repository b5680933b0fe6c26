"""Reports and rankings as functions of their tables and parameters: filters by tag and tier, health, timelines, signals, context selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import similar, store

# --- Filters and parsing -----------------------------------------------------------------------------


def topic_filter(df: DataFrame, tag: str, column: str = "topic_tag") -> DataFrame:
    """rows of a topic tag, whatever its case; rows without a tag are of none."""
    return df.where(F.lower(F.trim(column)) == tag.strip().lower())


#: What a privacy tier may be; the first stands for missing and unknown ones.
PRIVACY_TIERS = ("durable", "private", "ephemeral")


def privacy_tier(metadata: Column) -> Column:
    """the tier in a JSON text, also in a nested boundary; malformed JSON and unknown tiers are durable."""
    raw = F.try_parse_json(metadata)
    tier = F.lower(F.coalesce(F.try_variant_get(raw, "$.privacyTier", "string"), F.try_variant_get(raw, "$.boundary.privacyTier", "string")))
    return F.when(tier.isin(*PRIVACY_TIERS), tier).otherwise(PRIVACY_TIERS[0])


def leaves_traces(tier: Column) -> Column:
    """may triples be drawn from a row of this tier?"""
    return ~tier.isin("ephemeral", "private")


def unreturned(results: DataFrame, judged: DataFrame, penalty: float = 0.8) -> DataFrame:
    """Results (query_id, id, score) that a reranker gave nothing back for, at `penalty` of their score."""
    return results.join(judged.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.col("score") * penalty)


def workflow_text(title: Column, trigger: Column, steps: Column, tools: Column, outcome: Column) -> Column:
    """A workflow pattern as text; parts that are empty leave no line."""
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    head = F.array(F.concat(F.lit("Workflow pattern: "), title), F.concat(F.lit("Use when: "), trigger), F.lit("Steps:"))
    return F.array_join(F.array_compact(F.concat(head, numbered, _tail(tools, outcome))), "\n")


def case_text(title: Column, problem: Column, context: Column, steps: Column, tools: Column, outcome: Column) -> Column:
    """A case as text; parts that are empty leave no line."""
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    head = F.array(F.concat(F.lit("Case: "), title), F.concat(F.lit("Problem: "), problem), F.when(context != "", F.concat(F.lit("Context: "), context)), F.lit("Solution:"))
    return F.array_join(F.array_compact(F.concat(head, numbered, _tail(tools, outcome))), "\n")


def _tail(tools: Column, outcome: Column) -> Column:
    return F.array(F.when(F.size(tools) > 0, F.concat(F.lit("Tools: "), F.array_join(tools, ", "))), F.when(outcome != "", F.concat(F.lit("Outcome: "), outcome)))


# --- Health ------------------------------------------------------------------------------------------


def workflow_status(workflows: DataFrame, observations: DataFrame, now: Column, days: int) -> DataFrame:
    """(workflow_id, total, status) of every workflow over the last days; no-data for one without an observation.

    `observations` is (workflow_id, outcome, recorded_at).
    """
    recent = observations.where((F.col("recorded_at") > now - F.make_interval(days=F.lit(days))) & (F.col("recorded_at") <= now))
    n = lambda *outcomes: F.sum(F.col("outcome").isin(*outcomes).cast("int"))
    g = recent.groupBy("workflow_id").agg(F.count("*").alias("total"), n("success").alias("ok"), n("failure").alias("failures"), n("missed").alias("missed"), n("failure", "corrected", "missed").alias("issues"))
    rate = F.col("ok") / F.col("total")
    status = (
        F.when(F.col("total").isNull(), "no-data")
        .when((F.col("failures") >= 1) | (F.col("missed") >= 2) | (F.col("issues") >= 3) | ((F.col("total") >= 4) & (rate < 0.5)), "critical")
        .when((F.col("issues") >= 1) | (rate < 0.75), "watch")
        .otherwise("healthy")
    )
    return workflows.select("workflow_id").distinct().join(g, "workflow_id", "left").select("workflow_id", F.coalesce("total", F.lit(0)).alias("total"), status.alias("status"))


def health_score(total: Column, contradictions: Column, duplicates: Column, stale: Column, orphans: Column, weak: Column, cold: Column) -> Column:
    """100 less penalties, between 0 and 100; cold rows cost what their share is over 10 per cent, 10 at most."""
    share = F.when(total > 0, cold / total * 100).otherwise(0.0)
    penalty = contradictions * 10 + duplicates * 5 + F.floor(stale * 0.5) + orphans * 3 + weak * 2 + F.least(F.lit(10), F.greatest(F.lit(0), F.floor(share - 10)))
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long")


def lint_counts(df: DataFrame, now: int, stale_days: int = 30, cold_after: int = 6) -> DataFrame:
    """One row (total, duplicates, stale, orphans, cold) of `df` (id, text, scope, ts, access_count, evo_access_count): a copy of a text counts as one duplicate for each row beyond the first."""
    copies = df.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("duplicates"))
    old = (F.lit(now) - F.col("ts")) / 86_400_000 > stale_days
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name)
    rest = df.agg(F.count("*").alias("total"), n(old & (F.col("access_count") <= 1), "stale"), n(F.coalesce(F.trim("scope"), F.lit("")) == "", "orphans"), n((F.col("access_count") >= cold_after) & (F.col("evo_access_count") <= 0), "cold"))
    return rest.crossJoin(copies)  # one row each


# --- Time --------------------------------------------------------------------------------------------


def timeline(df: DataFrame, categories: Sequence[str], ts: str = "ts") -> DataFrame:
    """B2: (month, one column for each category) of `df` (ts in ms, category), months without rows left out."""
    month = F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM")
    return df.groupBy(month.alias("month")).pivot("category", list(categories)).agg(F.count(F.lit(1))).na.fill(0)


def dense_histogram(df: DataFrame, unit: str, ts: str = "ts", zone: str = "UTC") -> DataFrame:
    """(at, n) for every hour of the day or day of the week (0 is Sunday) in a time zone, zeros too."""
    local = F.from_utc_timestamp(F.timestamp_millis(F.col(ts)), zone)
    at, size = (F.hour(local), 24) if unit == "hour" else (F.dayofweek(local) - 1, 7)
    counts = df.groupBy(at.cast("long").alias("at")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).select(F.col("id").alias("at")).join(counts, "at", "left").na.fill(0)


def orphan_scopes(df: DataFrame, scope: str = "scope") -> DataFrame:
    """(id, scope) of the rows that are alone in their scope and were never read."""
    one = df.groupBy(scope).agg(F.count("*").alias("n"), F.max("access_count").alias("most"), F.min("id").alias("id")).where("n = 1 and most = 0")
    return one.select("id", scope)


# --- Text reports ------------------------------------------------------------------------------------


def years(df: DataFrame, text: str, first: int = 2000, last: int = 2099) -> DataFrame:
    """(year, n): how often a text names a year of the range; every 20.. by default."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit("(20[0-9]{2})"), F.lit(1))).alias("year")).select(F.col("year").cast("int"))
    return found.where(F.col("year").between(first, last)).groupBy("year").agg(F.count("*").alias("n"))


# Words of what may be out of date.
OUTDATED = ("deprecated", "removed", "old", "legacy", "TODO", "FIXME", "HACK", "temporary", "workaround", "临时", "废弃", "已删除", "待修复")


def stale_keywords(df: DataFrame, text: str, words: Sequence[str] = OUTDATED) -> DataFrame:
    """(word, n): how many texts hold a word in any case; words that none holds are left out.  One pass for all words."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w)))
    return df.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def near_duplicate_rate(df: DataFrame, sample: Column, least_cos: float = 0.95, recall: float = 0.9999) -> DataFrame:
    """One row (sampled, pairs, rate, estimate): near pairs among the rows of `sample`, and how many the whole table should have.

    Copies of a vector are counted as the pairs that they make, without making them.
    """
    rows = similar.vector_classes(df.where(sample).select("id", "vector"), [], [])
    sizes = rows.groupBy("first").agg(F.count("*").alias("n"))
    firsts = rows.where("id = first and vector is not null").select("id", "vector")
    near = similar.near_pairs(firsts, least_cos, recall=recall).where(F.col("cos") > least_cos)
    side = lambda x: sizes.select(F.col("first").alias(x), F.col("n").alias(f"n{x}"))
    across = near.join(side("a"), "a").join(side("b"), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    within = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("w"), F.sum("n").alias("sampled"))
    total = df.agg(F.count("*").alias("total"))
    one = across.crossJoin(within).crossJoin(total)  # one row each
    pairs, of = F.col("x") + F.col("w"), F.col("sampled") * (F.col("sampled") - 1) / 2
    return one.select("sampled", pairs.cast("long").alias("pairs"), (pairs / of).alias("rate"), F.round(pairs / of * F.col("total") * (F.col("total") - 1) / 2).cast("long").alias("estimate"))


# --- Scopes and signals ------------------------------------------------------------------------------


def cue_scopes(rows: DataFrame, cues: DataFrame) -> DataFrame:
    """(id, scope, reason) of each text of `rows` (id, text) by the cues (cue, scope) that it holds: a scope only if all agree.

    Cues are a setting, a few hundred at most, and go along as one row; texts are read once.
    """
    listed = cues.agg(F.collect_list(F.struct(F.lower("cue").alias("cue"), "scope")).alias("cues"))
    # Below the join, or the text would be worked out again for each cue.
    low = rows.select("id", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("low"))
    hit = low.crossJoin(F.broadcast(listed)).withColumn("scopes", F.array_sort(F.array_distinct(F.transform(F.filter("cues", lambda c: F.col("low").contains(c["cue"])), lambda c: c["scope"]))))
    one = F.size("scopes") == 1
    reason = F.when(F.size("cues") == 0, "no cues configured").when(one, "matched").when(F.size("scopes") > 1, F.concat(F.lit("conflicting cues: "), F.array_join("scopes", ", "))).otherwise("no cue match")
    return hit.select("id", F.when(one, F.col("scopes")[0]).alias("scope"), reason.alias("reason"))


# How much a kind of signal counts.
SIGNAL_WEIGHTS = {"stale_open_loop": 0.9, "workflow_issue": 0.85, "stale_high_frequency": 0.7, "uncovered_topic": 0.65}


def signals(checkpoints: DataFrame, memories: DataFrame, observations: DataFrame, topics: DataFrame, now: int, loop_hours: int = 24, memory_days: int = 14) -> DataFrame:
    """(kind, subject, weight) from what happened: open loops left alone, memories once much used, workflows with issues, topics asked for in vain.

    `checkpoints` is (loop, at), `memories` (id, access_count, last_accessed_at), `observations`
    (workflow_id, outcome), `topics` (topic); times in ms.  A loop counts by its newest checkpoint.
    """
    kind = lambda name: F.lit(name).alias("kind")
    hours = (F.lit(now) - F.col("at")) / 3_600_000
    loops = checkpoints.groupBy(F.lower(F.trim("loop")).alias("subject")).agg(F.max("at").alias("at")).withColumn("h", hours).where(F.col("h") >= loop_hours)
    days = (F.lit(now) - F.col("last_accessed_at")) / 86_400_000
    often = memories.withColumn("d", days).where((F.col("d") >= memory_days) & (F.col("access_count") >= 3))
    rested = 0.5 + 0.3 * F.least(F.col("d") / (3 * memory_days), F.lit(1.0)) + 0.2 * F.least(F.col("access_count") / 10, F.lit(1.0))
    issues = observations.where(F.col("outcome").isin("corrected", "missed")).groupBy(F.col("workflow_id").alias("subject")).agg(F.count("*").alias("n"))
    parts = [
        loops.select(kind("stale_open_loop"), "subject", (0.6 + 0.4 * F.least(F.col("h") / (3 * loop_hours), F.lit(1.0))).alias("weight")),
        often.select(kind("stale_high_frequency"), F.col("id").alias("subject"), F.least(rested, F.lit(1.0)).alias("weight")),
        issues.select(kind("workflow_issue"), "subject", F.least(0.6 + 0.1 * F.col("n"), F.lit(1.0)).alias("weight")),
        topics.select(kind("uncovered_topic"), F.col("topic").alias("subject"), F.lit(0.65).alias("weight")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predictions(found: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """The `most` strongest signals, confidence in hundredths."""
    factor = F.lit(0.0)
    for name, w in SIGNAL_WEIGHTS.items():
        factor = F.when(F.col("kind") == name, w).otherwise(factor)
    return found.withColumn("confidence", F.round(F.col("weight") * factor, 2)).where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "kind", "subject").limit(most).select("kind", "subject", "confidence")


# --- Forgetting and export ---------------------------------------------------------------------------


def forget(rows: DataFrame, triples: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that stay, collapsed triples that stay, evidence) after the rows of a condition are forgotten.

    Their ids leave the triples' sources, and triples without any other source go.  The evidence
    is (scope, forgotten, triples): what was forgotten of each scope, and how many triples it touched.
    """
    out = rows.where(F.coalesce(gone, F.lit(False)))
    ids = out.select("id", "scope")
    flat = triples.select("triple_id", F.explode("sources").alias("id")).join(ids, "id")
    left = triples.select("*", F.explode("sources").alias("__s")).join(ids.select(F.col("id").alias("__s")), "__s", "left_anti")
    kept = left.groupBy("triple_id", "subject", "predicate", "object", "confidence").agg(F.sort_array(F.collect_list("__s")).alias("sources")).withColumn("mention_count", F.size("sources").cast("long"))
    touched = flat.groupBy("scope").agg(F.count_distinct("triple_id").alias("triples"))
    evidence = ids.groupBy("scope").agg(F.count("*").alias("forgotten")).join(touched, "scope", "left").na.fill(0, ["triples"])
    return store.delete(rows, ids), kept, evidence


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, weight, degree) of the nodes (id, kind, weight) and how many of the edges (source, target) end at each; an edge to itself counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").na.fill(0, ["degree"]).select("id", "kind", "weight", "degree")


# --- What goes into a context ------------------------------------------------------------------------


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text holds."""
    return sum(((text.contains(t)).cast("int") for t in terms), F.lit(0))


def task_useful(category: str, df: DataFrame, cues: Sequence[str], resolved: Sequence[str], plans: Sequence[str] = ()) -> DataFrame:
    """The rows (text, category, scope, layer, canonical_key, score) worth showing for a task of a category (cases or patterns).

    `cues` are its words, `resolved` words of a solution, `plans` those of mere plans.  Durable
    rows need structure, a cue or the category; others structure, or, for cases, 80 characters, a
    score of 0.70 and a cue.
    """
    text = normal(F.col("text"))
    hits, planned = term_hits(text, cues), term_hits(text, plans) > 0
    structured = text.startswith("workflow pattern:") if category == "patterns" else text.startswith("case:")
    memory_scope = F.col("scope").startswith("memory:") | F.col("scope").startswith("asset:")
    durable = memory_scope | F.coalesce(F.col("layer") == "durable", F.lit(False))
    kept = ~(planned & ~structured) & (structured | (hits > 0) | (F.col("category") == category))
    if category == "cases":
        kept = kept & (structured | memory_scope | F.coalesce(F.col("canonical_key") != "", F.lit(False)))
        loose = structured | ((F.length(text) >= 80) & (F.col("score") >= 0.70) & (hits >= 2) & (term_hits(text, resolved) > 0))
    else:
        loose = structured
    return df.where((F.length(text) >= 12) & F.when(durable, kept).otherwise(~planned & loose))


def workflow_fallback(df: DataFrame, cues: Sequence[str], scope: str | None, limit: int) -> DataFrame:
    """(id, value): durable rows with a cue, by 4 for each cue and bonuses; of equal texts the best."""
    text = normal(F.col("text"))
    hits = term_hits(text, cues)
    memory_scope = F.col("scope").startswith("memory:") | F.col("scope").startswith("asset:")
    value = hits * 4 + F.col("score") + F.when(F.col("category") == "patterns", 3).when(F.col("category") == "cases", 1).otherwise(0) + F.when(memory_scope, 2).otherwise(0)
    if scope:
        value = value + F.when(F.col("scope") == scope, 2).otherwise(0)
    rows = df.where(memory_scope & (hits > 0)).select("id", F.round(value, 9).alias("value"), F.xxhash64(text).alias("k"))
    best = rows.groupBy("k").agg(F.min(F.struct((-F.col("value")).alias("v"), "id")).alias("b"))
    return best.select(F.col("b.id").alias("id"), (-F.col("b.v")).alias("value")).orderBy(F.desc("value"), "id").limit(limit)


def pins(df: DataFrame, terms: Sequence[str], scope: str | None, limit: int) -> DataFrame:
    """(id, value) of the pinned rows (id, title, summary, scope, position): 2 for each term, 3 for the scope, a little for coming early; nothing that has neither."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    value = term_hits(text, terms) * 2 - 0.01 * F.col("position")
    if scope:
        value = value + F.when(F.col("scope") == scope, 3).otherwise(0)
    scored = df.select("id", F.round(value, 9).alias("value"))
    if terms or scope:
        scored = scored.where("value > 0")
    return scored.orderBy(F.desc("value"), "id").limit(limit)
