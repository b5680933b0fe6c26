"""Reports and rankings with parameters over the test tables; SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import errors
from tidewell.functions import text as T
from tidewell.operators import store
from tidewell.plans import measures
from tidewell.queries import query
from tidewell.queries.memory import _TOKENS
from tidewell.queries.rounds import _COS, _TWINS, _twins

NOW, DAY = model.NOW, model.DAY_MS
Spark = SparkSession
N = f"WITH notes AS ({model.NOTES_SQL})"
M = f"WITH memories AS ({model.MEMORIES_SQL})"


def _on(spark: Spark, sql: str, **tables: DataFrame) -> DataFrame:
    """`sql` over DataFrames by name."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


# --- Filters and texts -------------------------------------------------------------------------------

_TAGGED = "SELECT id, CASE topic % 4 WHEN 0 THEN concat('Topic', CAST(topic AS STRING)) WHEN 1 THEN concat('topic', CAST(topic AS STRING), ' ') WHEN 2 THEN 'TOPIC4' END AS topic_tag FROM memories"


@query("F14_topic", f"{M}, t AS ({_TAGGED.replace('STRING', 'VARCHAR')}) SELECT id FROM t WHERE lower(trim(topic_tag)) = 'topic4'")
def f14(spark: Spark, d: str) -> DataFrame:
    return measures.topic_filter(_on(spark, _TAGGED, memories=model.memories(spark, d)), " Topic4").select("id")


_META = """SELECT id, CASE i % 7 WHEN 0 THEN '{"privacyTier": "Private"}' WHEN 1 THEN '{"boundary": {"privacyTier": "ephemeral"}}' WHEN 2 THEN '{"privacyTier": "secret"}' WHEN 3 THEN '{broken' WHEN 4 THEN '{"privacyTier": "durable", "boundary": {"privacyTier": "private"}}' WHEN 5 THEN '[]' END AS metadata FROM notes"""


@query("F21_privacy", f"""{N}, m AS ({_META}), t AS (SELECT id, CASE WHEN json_valid(metadata) THEN lower(coalesce(metadata::JSON->>'$.privacyTier', metadata::JSON->>'$.boundary.privacyTier')) END AS t FROM m), v AS (SELECT id, CASE WHEN t IN ('durable', 'private', 'ephemeral') THEN t ELSE 'durable' END AS tier FROM t) SELECT id, tier, tier NOT IN ('private', 'ephemeral') AS traced FROM v""")
def f21(spark: Spark, d: str) -> DataFrame:
    rows = _on(spark, _META, notes=model.notes(spark, d)).withColumn("tier", measures.privacy_tier(F.col("metadata")))
    return rows.select("id", "tier", measures.leaves_traces(F.col("tier")).alias("traced"))


@query("U7_except", f"{M} SELECT CAST(i % 4 AS VARCHAR) AS query_id, id, round(importance * 0.8, 6) AS score FROM memories WHERE i % 2 = 0 AND NOT (i % 3 = 0)")
def u7(spark: Spark, d: str) -> DataFrame:
    rows = model.memories(spark, d).select((F.col("i") % 4).cast("string").alias("query_id"), "id", F.col("importance").alias("score"), "i")
    return measures.unreturned(rows.where("i % 2 = 0").drop("i"), rows.where("i % 3 = 0")).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    "T30_template",
    """SELECT p_partkey, concat('Workflow pattern: ', p_name, chr(10), 'Use when: ', p_type, chr(10), 'Steps:', CASE WHEN p_partkey % 3 > 0 THEN chr(10) || '1. ' || p_type ELSE '' END, CASE WHEN p_partkey % 3 > 1 THEN chr(10) || '2. ' || p_brand ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Tools: ' || p_brand || ', hand' ELSE '' END, CASE WHEN p_partkey % 5 > 1 THEN chr(10) || 'Outcome: ' || p_brand ELSE '' END) AS workflow,
    concat('Case: ', p_name, chr(10), 'Problem: ', p_type, CASE WHEN p_partkey % 5 > 1 THEN chr(10) || 'Context: ' || p_brand ELSE '' END, chr(10), 'Solution:', CASE WHEN p_partkey % 3 > 0 THEN chr(10) || '1. ' || p_type ELSE '' END, CASE WHEN p_partkey % 3 > 1 THEN chr(10) || '2. ' || p_brand ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Tools: ' || p_brand || ', hand' ELSE '' END) AS case_text FROM part""",
)
def t30(spark: Spark, d: str) -> DataFrame:
    p, k = model.table(spark, d, "part"), F.col("p_partkey")
    steps = F.slice(F.array("p_type", "p_brand"), F.lit(1), (k % 3).cast("int"))
    tools = F.when(k % 2 == 0, F.array("p_brand", F.lit("hand"))).otherwise(F.array().cast("array<string>"))
    maybe = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(F.col("p_brand"))
    c = F.col
    return p.select("p_partkey", measures.workflow_text(c("p_name"), c("p_type"), steps, tools, maybe).alias("workflow"), measures.case_text(c("p_name"), c("p_type"), maybe, steps, tools, F.lit(None).cast("string")).alias("case_text"))


# --- Health ------------------------------------------------------------------------------------------


@query(
    "A16_status",
    f"""WITH o AS ({model.OBSERVATIONS_SQL.replace('AS STRING', 'AS VARCHAR')}), w AS (SELECT DISTINCT workflow_id FROM o UNION SELECT 'never'), g AS (SELECT workflow_id, count(*) AS total, count(*) FILTER (outcome = 'success') AS ok, count(*) FILTER (outcome = 'failure') AS f, count(*) FILTER (outcome <> 'success') AS issues FROM o WHERE recorded_at > TIMESTAMP '2024-01-15 06:00:00' - INTERVAL 4 HOUR AND recorded_at <= TIMESTAMP '2024-01-15 06:00:00' GROUP BY workflow_id)
    SELECT workflow_id, coalesce(total, 0) AS total, CASE WHEN total IS NULL THEN 'no-data' WHEN f >= 1 OR issues >= 3 OR (total >= 4 AND ok / total::DOUBLE < 0.5) THEN 'critical' WHEN issues >= 1 OR ok / total::DOUBLE < 0.75 THEN 'watch' ELSE 'healthy' END AS status FROM w LEFT JOIN g USING (workflow_id)""".replace("INTERVAL 4 HOUR", "INTERVAL 1 DAY"),
)
def a16(spark: Spark, d: str) -> DataFrame:
    o = model.observations(spark, d)
    every = o.select("workflow_id").unionByName(spark.createDataFrame([("never",)], "workflow_id string"))
    return measures.workflow_status(every, o, F.lit("2024-01-15 06:00:00").cast("timestamp"), 1)


@query("A24_health_score", f"{N}, d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM notes GROUP BY text) x), s AS (SELECT count(*) AS total, count(*) FILTER (({NOW} - ts) / 86400000.0::DOUBLE > 31.8 AND access_count <= 1) AS stale, count(*) FILTER (trim(coalesce(scope, '')) = '') AS orphan, count(*) FILTER (access_count >= 6 AND evo_access_count <= 0) AS cold FROM notes) SELECT total, dup AS duplicates, stale, orphan AS orphans, cold, greatest(0, least(100, 100 - (CAST(floor(dup / 20) AS BIGINT) * 5 + CAST(floor(stale * 0.5) AS BIGINT) + orphan * 3 + least(10, greatest(0, CAST(floor(cold / total::DOUBLE * 100 - 10) AS BIGINT)))))) AS health FROM d, s")
def a24(spark: Spark, d: str) -> DataFrame:
    """Copies by the score of twenty, as the test tables hold many."""
    counts = measures.lint_counts(model.notes(spark, d), NOW, 31.8)
    nought, c = F.lit(0), F.col
    score = measures.health_score(c("total"), nought, F.floor(c("duplicates") / 20), c("stale"), c("orphans"), nought, c("cold"))
    return counts.select("total", "duplicates", "stale", "orphans", "cold", score.alias("health"))


# --- Time --------------------------------------------------------------------------------------------

_TIMES = "SELECT category, ts + (i % 5) * 2592000000 AS ts FROM notes"


@query("B2_timeline", f"{N}, t AS ({_TIMES}) SELECT strftime(to_timestamp(ts / 1000.0) AT TIME ZONE 'UTC', '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in model.CATEGORIES) + " FROM t GROUP BY 1")
def b2(spark: Spark, d: str) -> DataFrame:
    return measures.timeline(_on(spark, _TIMES, notes=model.notes(spark, d)), model.CATEGORIES)


def _dense_sql(part: str, size: int) -> str:
    return f"{N}, h AS (SELECT CAST({part} AS BIGINT) AS at_, count(*) AS n FROM (SELECT to_timestamp(floor(ts / 1000)) AT TIME ZONE 'UTC' AS t FROM notes WHERE i % 3 = 0 AND (ts // 3600000) % 24 NOT IN (3, 4)) x GROUP BY 1) SELECT r.k AS \"at\", coalesce(n, 0) AS n FROM (SELECT unnest(range({size})) AS k) r LEFT JOIN h ON at_ = k"


@query("B4_hours", _dense_sql("hour(t)", 24))
def b4(spark: Spark, d: str) -> DataFrame:
    return measures.dense_histogram(model.notes(spark, d).where("i % 3 = 0 and cast(floor(ts / 3600000) as bigint) % 24 not in (3, 4)"), "hour")


@query("B4_weekdays", _dense_sql("dayofweek(t)", 7))
def b4w(spark: Spark, d: str) -> DataFrame:
    return measures.dense_histogram(model.notes(spark, d).where("i % 3 = 0 and cast(floor(ts / 3600000) as bigint) % 24 not in (3, 4)"), "weekday")


_RARE = "SELECT id, access_count, CASE WHEN i % 9 = 0 THEN concat('only:', id) ELSE scope END AS scope FROM notes"


@query("B16_orphan_scopes", f"{N}, r AS ({_RARE}) SELECT min(id) AS id, scope FROM r GROUP BY scope HAVING count(*) = 1 AND max(access_count) = 0")
def b16(spark: Spark, d: str) -> DataFrame:
    return measures.orphan_scopes(_on(spark, _RARE, notes=model.notes(spark, d)))


# --- Texts and pairs ---------------------------------------------------------------------------------

_DATED = "SELECT page_id, concat(html, CASE page_id % 6 WHEN 0 THEN ' since 2021, legacy of 2019' WHEN 1 THEN ' TODO 2024 and 2024' WHEN 2 THEN ' Deprecated 20245' WHEN 3 THEN ' 临时 2026 2027' ELSE '' END) AS html FROM pages"


@query("B12_years", f"WITH p AS ({_DATED}) SELECT CAST(y AS INT) AS year, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '20[0-9]{{2}}')) AS y FROM p) x GROUP BY y")
def b12(spark: Spark, d: str) -> DataFrame:
    return measures.years(_on(spark, _DATED, pages=model.table(spark, d, "pages")), "html")


@query("B12_stale_keywords", f"WITH p AS ({_DATED}) SELECT w AS word, count(*) AS n FROM p JOIN (SELECT unnest([{', '.join(repr(w) for w in measures.OUTDATED)}]) AS w) k ON contains(lower(html), lower(w)) GROUP BY w")
def b12b(spark: Spark, d: str) -> DataFrame:
    return measures.stale_keywords(_on(spark, _DATED, pages=model.table(spark, d, "pages")), "html")


@query("B18_near_dup_rate", f"WITH {_TWINS}, s AS (SELECT * FROM twins WHERE i % 2 = 0), p AS (SELECT count(*) AS n FROM s a JOIN s b ON a.id < b.id AND ({_COS} > 0.95 OR a.vector = b.vector)), k AS (SELECT count(*) AS k FROM s), t AS (SELECT count(*) AS t FROM twins) SELECT k AS sampled, n AS pairs, round(n / (k * (k - 1) / 2.0::DOUBLE), 9) AS rate, CAST(round(n / (k * (k - 1) / 2.0::DOUBLE) * t * (t - 1) / 2) AS BIGINT) AS estimate FROM p, k, t")
def b18(spark: Spark, d: str) -> DataFrame:
    """Half of the memories and their rephrasings are the sample."""
    rows = _twins(spark, d)
    return measures.near_duplicate_rate(rows, F.col("i") % 2 == 0).withColumn("rate", F.round("rate", 9))


# --- Scopes, signals, forgetting, export -------------------------------------------------------------

_CUES = "SELECT concat('license, version ', CAST(n_nationkey % 4 AS STRING)) AS cue, concat('r', CAST(n_regionkey AS STRING)) AS scope FROM nation WHERE n_nationkey < 12 UNION ALL SELECT lower(substring(n_name, 1, 6)), concat('r', CAST(n_regionkey AS STRING)) FROM nation UNION ALL SELECT 'mit license', 'mit' FROM nation WHERE n_nationkey = 1"


@query("J16_cue_scope", f"WITH c AS ({_CUES.replace('STRING', 'VARCHAR')}), h AS (SELECT doc_id, list_sort(list_distinct(list(c.scope))) AS scopes FROM documents d JOIN c ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(c.cue)) GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN len(scopes) = 1 THEN scopes[1] END AS scope, CASE WHEN scopes IS NULL THEN 'no cue match' WHEN len(scopes) = 1 THEN 'matched' ELSE 'conflicting cues: ' || array_to_string(scopes, ', ') END AS reason FROM documents d LEFT JOIN h USING (doc_id)")
def j16(spark: Spark, d: str) -> DataFrame:
    """Cues made of the nations' names and of license versions."""
    cues = _on(spark, _CUES, nation=model.table(spark, d, "nation"))
    return measures.cue_scopes(model.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), cues)


_LOOPS = "SELECT concat(' Loop ', CAST(i % 23 AS STRING)) AS loop, ts + 518400000 AS at_ms FROM notes WHERE category = 'events'"
_W = f"least(0.5 + 0.3 * least(({NOW} - last_accessed_at) / 86400000.0::DOUBLE / 42, 1.0) + 0.2 * least(access_count / 10.0::DOUBLE, 1.0), 1.0)"


@query(
    "G23_predictions",
    f"""WITH memories AS ({model.MEMORIES_SQL}), notes AS ({model.NOTES_SQL}), o AS ({model.OBSERVATIONS_SQL.replace('AS STRING', 'AS VARCHAR')}), l AS (SELECT lower(trim(loop)) AS subject, ({NOW} - max(at_ms)) / 3600000.0::DOUBLE AS h FROM ({_LOOPS.replace('AS STRING', 'AS VARCHAR')}) x GROUP BY 1),
    s AS (SELECT 'stale_open_loop' AS kind, subject, 0.6 + 0.4 * least(h / 72, 1.0) AS w, 0.9 AS f FROM l WHERE h >= 24 UNION ALL SELECT 'stale_high_frequency', id, {_W}, 0.7 FROM memories WHERE ({NOW} - last_accessed_at) / 86400000.0::DOUBLE >= 14 AND access_count >= 3
      UNION ALL SELECT 'workflow_issue', workflow_id, least(0.6 + 0.1 * count(*), 1.0), 0.85 FROM o WHERE outcome IN ('corrected', 'missed') GROUP BY workflow_id UNION ALL SELECT 'uncovered_topic', CAST(topic AS VARCHAR), 0.65, 0.65 FROM memories GROUP BY topic HAVING max(ts) < {NOW - 4 * DAY})
    SELECT kind, subject, round(w * f, 2) AS confidence FROM s WHERE round(w * f, 2) >= 0.6 ORDER BY confidence DESC, kind, subject LIMIT 25""",
)
def g23(spark: Spark, d: str) -> DataFrame:
    m, notes = model.memories(spark, d), model.notes(spark, d)
    topics = m.groupBy("topic").agg(F.max("ts").alias("t")).where(F.col("t") < NOW - 4 * DAY).select(F.col("topic").cast("string").alias("topic"))
    loops = _on(spark, _LOOPS, notes=notes).withColumnRenamed("at_ms", "at")
    found = measures.signals(loops, m.select("id", "access_count", "last_accessed_at"), model.observations(spark, d), topics, NOW)
    return measures.predictions(found, most=25)


@query("G14_forget_scope", f"WITH notes AS ({model.NOTES_SQL}), tr AS ({model.TRIPLES_SQL}), s AS (SELECT DISTINCT subject, predicate, object, source_memory_id FROM tr), k AS (SELECT s.* FROM s LEFT JOIN notes n ON n.id = s.source_memory_id WHERE n.id IS NULL OR n.scope NOT LIKE 'src1:%') SELECT subject, predicate, object, count(*) AS mention_count FROM k GROUP BY subject, predicate, object")
def g14(spark: Spark, d: str) -> DataFrame:
    _, kept, _ = measures.forget(model.notes(spark, d), store.collapse_triples(model.triples(spark, d)), F.col("scope").startswith("src1:"))
    return kept.select("subject", "predicate", "object", "mention_count")


@query("G14_evidence", f"WITH notes AS ({model.NOTES_SQL}), tr AS ({model.TRIPLES_SQL}), g AS (SELECT id, scope FROM notes WHERE i % 7 = 3), t AS (SELECT g.scope, count(DISTINCT (subject, predicate, object)) AS triples FROM g JOIN tr ON tr.source_memory_id = g.id GROUP BY g.scope) SELECT g.scope, count(*) AS forgotten, coalesce(max(triples), 0) AS triples FROM g LEFT JOIN t USING (scope) GROUP BY g.scope")
def g14b(spark: Spark, d: str) -> DataFrame:
    return measures.forget(model.notes(spark, d), store.collapse_triples(model.triples(spark, d)), F.col("i") % 7 == 3)[2]


_EDGES = "SELECT id AS source, superseded_by AS target FROM notes WHERE superseded_by IS NOT NULL UNION ALL SELECT id, consolidated_into FROM notes WHERE consolidated_into IS NOT NULL"


@query("G27_graph_nodes", f"{N}, e AS ({_EDGES}), x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e WHERE target <> source), g AS (SELECT id, count(*) AS degree FROM x GROUP BY id) SELECT n.id, n.category AS kind, round(n.importance, 6) AS weight, coalesce(degree, 0) AS degree FROM notes n LEFT JOIN g USING (id)")
def g27(spark: Spark, d: str) -> DataFrame:
    notes = model.notes(spark, d)
    nodes = notes.select("id", F.col("category").alias("kind"), F.round("importance", 6).alias("weight"))
    return measures.graph_nodes(nodes, _on(spark, _EDGES, notes=notes))


# --- Context -----------------------------------------------------------------------------------------

_TASKS = """SELECT id, i, CASE WHEN i % 6 = 5 THEN concat('memory:', language) ELSE scope END AS scope, category, layer, CASE WHEN i % 4 = 0 THEN '' ELSE canonical_key END AS canonical_key, importance AS score, concat(CASE i % 8 WHEN 0 THEN 'Case: the ' WHEN 1 THEN 'Workflow pattern: ' WHEN 2 THEN 'The error was fixed, root cause found. ' WHEN 3 THEN 'We plan to fix it. ' WHEN 4 THEN 'workflow and step: ' ELSE '' END, substring(text, 1, CAST(i % 130 AS INT))) AS text FROM notes"""
_CASE_CUES, _FLOW_CUES, _RESOLVED, _PLANNED = ["error", "fix", "root cause", "bug"], ["workflow", "step", "license"], ["root cause", "resolved", "fixed"], ["we plan"]
_HITS = lambda terms: " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in terms)
_NORMAL = f"SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, scope LIKE 'memory:%' OR scope LIKE 'asset:%' AS ms FROM ({_TASKS}) x"


@query(
    "X2_useful",
    f"""{N}, n AS ({_NORMAL}), c AS (SELECT *, starts_with(t, 'case:') AS st, {_HITS(_CASE_CUES)} AS h, {_HITS(_PLANNED)} > 0 AS pl, ms OR coalesce(layer = 'durable', false) AS du FROM n), p AS (SELECT *, starts_with(t, 'workflow pattern:') AS st, {_HITS(_FLOW_CUES)} AS h, {_HITS(_PLANNED)} > 0 AS pl, ms OR coalesce(layer = 'durable', false) AS du FROM n)
    SELECT 'cases' AS task, id FROM c WHERE length(t) >= 12 AND CASE WHEN du THEN NOT (pl AND NOT st) AND (st OR ms OR canonical_key <> '') AND (st OR h > 0 OR category = 'cases') ELSE NOT pl AND (st OR (length(t) >= 80 AND score >= 0.70 AND h >= 2 AND ({_HITS(_RESOLVED)}) > 0)) END
    UNION ALL SELECT 'patterns', id FROM p WHERE length(t) >= 12 AND CASE WHEN du THEN NOT (pl AND NOT st) AND (st OR h > 0 OR category = 'patterns') ELSE NOT pl AND st END""",
)
def x2(spark: Spark, d: str) -> DataFrame:
    rows = _on(spark, _TASKS, notes=model.notes(spark, d))
    part = lambda task, cues: measures.task_useful(task, rows, cues, _RESOLVED, _PLANNED).select(F.lit(task).alias("task"), "id")
    return part("cases", _CASE_CUES).unionByName(part("patterns", _FLOW_CUES))


@query("X5_workflow_fallback", f"{N}, n AS ({_NORMAL}), v AS (SELECT id, t, round(4 * ({_HITS(_FLOW_CUES)}) + score + CASE category WHEN 'patterns' THEN 3 WHEN 'cases' THEN 1 ELSE 0 END + 2 + CASE WHEN scope = 'memory:en' THEN 2 ELSE 0 END, 9) AS value FROM n WHERE ms AND ({_HITS(_FLOW_CUES)}) > 0), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY t ORDER BY value DESC, id) = 1) SELECT id, round(value, 6) AS value FROM b ORDER BY b.value DESC, id LIMIT 15")
def x5(spark: Spark, d: str) -> DataFrame:
    return measures.workflow_fallback(_on(spark, _TASKS, notes=model.notes(spark, d)), _FLOW_CUES, "memory:en", 15).withColumn("value", F.round("value", 6))


@query("X7_pins", f"{N}, p AS (SELECT id, scope, i AS position, lower(concat(anchor, ' ', l1_overview)) AS t FROM notes WHERE tier = 'core'), v AS (SELECT id, round(2 * (CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'token') AS INT)) - 0.01 * position + CASE WHEN scope = 'src1:en' THEN 3 ELSE 0 END, 9) AS value FROM p) SELECT id, round(value, 6)::DOUBLE AS value FROM v WHERE v.value > 0 ORDER BY v.value DESC, id LIMIT 40")
def x7(spark: Spark, d: str) -> DataFrame:
    """All core notes as pins, in the order of their ids."""
    rows = model.notes(spark, d).where("tier = 'core'").select("id", F.col("anchor").alias("title"), F.col("l1_overview").alias("summary"), "scope", F.col("i").alias("position"))
    return measures.pins(rows, ["the", "token"], "src1:en", 40).withColumn("value", F.round("value", 6))


# --- Store -------------------------------------------------------------------------------------------


@query("S6_upsert_one", f"{N} SELECT id, CASE WHEN id = '7' THEN 'new text' ELSE substring(text, 1, 30) END AS text FROM notes UNION ALL SELECT 'brand-new', 'another'")
def s6(spark: Spark, d: str) -> DataFrame:
    old = model.notes(spark, d).select("id", F.substring("text", 1, 30).alias("text"))
    return store.upsert(store.upsert(old, spark.createDataFrame([("7", "new text")], "id string, text string")), spark.createDataFrame([("brand-new", "another")], "id string, text string"))


@query("S10_patch_batch", f"{N} SELECT id, CASE WHEN i % 4 = 1 THEN 'merged' WHEN i % 4 = 2 THEN 'linked' ELSE status END AS status, CASE WHEN i % 4 = 1 THEN CAST(i - 1 AS VARCHAR) ELSE superseded_by END AS superseded_by FROM notes")
def s10(spark: Spark, d: str) -> DataFrame:
    """Patches of many rows at once; a patch's null leaves a value as it is."""
    old = model.notes(spark, d)
    p = old.where("i % 4 in (1, 2)").select("id", F.when(F.col("i") % 4 == 1, "merged").otherwise("linked").alias("status"), F.when(F.col("i") % 4 == 1, (F.col("i") - 1).cast("string")).alias("superseded_by"))
    return store.patch(old.select("id", "status", "superseded_by"), p, ["status", "superseded_by"])


@query("S1_migrate", f"{N} SELECT id, scope, CAST(NULL AS VARCHAR) AS metadata, CASE WHEN i % 3 = 0 THEN 'en' ELSE language END AS language, md5(text) AS digest FROM notes")
def s1(spark: Spark, d: str) -> DataFrame:
    """A table of an older version, without the columns added since, and with nulls in one of them."""
    old = model.notes(spark, d).select("id", "text", "category", "scope", "importance", F.col("ts").alias("timestamp"), F.when(F.col("i") % 3 != 0, F.col("language")).alias("language"))
    return model.evolve(old).select("id", "scope", "metadata", "language", F.md5(F.col("fts_text").cast("binary")).alias("digest"))


@query("A7_collapse", f"WITH tr AS ({model.TRIPLES_SQL}), s AS (SELECT subject, predicate, object, max(confidence) AS confidence, list_sort(list_distinct(list(source_memory_id))) AS all_ FROM tr GROUP BY ALL) SELECT subject, predicate, object, round(confidence, 6) AS confidence, len(all_) AS mention_count, array_to_string(all_[1:3], ',') AS sources FROM s".replace("GROUP BY ALL", "GROUP BY subject, predicate, object"))
def a7(spark: Spark, d: str) -> DataFrame:
    c = store.collapse_triples(model.triples(spark, d), 3)
    return c.select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"), "mention_count", F.array_join("sources", ",").alias("sources"))


_LIST = lambda c: _TOKENS.replace("lower(text)", f"lower({c})")


@query("T4_overlap", f"{N}, x AS (SELECT id, {_LIST('anchor')} AS q, {_LIST('l1_overview')} AS c FROM notes), h AS (SELECT *, len(list_filter(q, lambda t: list_contains(c, t))) AS hits FROM x) SELECT id, round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0 ELSE 0.7 * hits / len(q) + 0.3 * hits / len(c) END, 6) AS overlap, len(q) <= 4 AS short FROM h")
def t4(spark: Spark, d: str) -> DataFrame:
    """What the anchor and the overview of a note share, and whether the anchor would be a short query."""
    x = model.notes(spark, d).select("id", T.tokens(F.col("anchor")).alias("q"), T.tokens(F.col("l1_overview")).alias("c"))
    return x.select("id", F.round(T.overlap(F.col("q"), F.col("c")), 6).alias("overlap"), (F.size("q") <= 4).alias("short"))


@query("T17_case_signatures")
def t17(spark: Spark, d: str) -> DataFrame:
    """Conversations as cases: outcomes of success say nothing, those of failure count."""
    c = model.table(spark, d, "conversations")
    t = F.col("conv_id") + F.col("turn")
    outcome = F.when(t % 3 == 0, F.concat(F.lit("All fine, exit code 0: "), F.substring("text", 1, 20))).when(t % 3 == 1, "It failed with error: disk not found, exit code 5")
    return c.select("conv_id", "turn", F.array_join(errors.case_signatures(F.col("text"), F.lit(None).cast("string"), outcome, F.when(t % 5 == 0, F.array(F.lit("step one"), F.lit("TypeError: x is undefined in /a/b.ts")))), "|").alias("signatures"))
