"""Reports and relational checks as SQL over the model's tables.

Each is one declarative statement that the optimizer plans; `{notes}`, `{memories}`,
`{observations}` and `{triples}` stand for the model's tables.  A statement uses only
constructs whose meaning the SQL standard fixes, so another engine can check it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewell import model

NOW = model.NOW
DAY = model.DAY_MS
SOURCES = {
    "notes": (model.NOTES_SQL, ("documents",)),
    "memories": (model.MEMORIES_SQL, ("documents", "embeddings")),
    "observations": (model.OBSERVATIONS_SQL, ("events",)),
    "triples": (model.TRIPLES_SQL, ("supplier", "nation", "customer")),
}
_AGE = f"({NOW} - ts) / CAST({DAY} AS DOUBLE)"
_TIER = "CASE WHEN tier IS NOT NULL THEN tier WHEN importance >= 0.95 OR access_count >= 10 THEN 'core' WHEN importance >= 0.8 OR access_count >= 3 THEN 'working' ELSE 'peripheral' END"
_WINDOW = f"sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) AS successes, sum(CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END) AS failures, sum(CASE WHEN outcome = 'corrected' THEN 1 ELSE 0 END) AS corrected, sum(CASE WHEN outcome = 'missed' THEN 1 ELSE 0 END) AS missed, sum(CASE WHEN outcome <> 'success' THEN 1 ELSE 0 END) AS issues"
_NORM = "lower(trim(text))"

REPORTS: dict[str, str] = {
    # scans, predicates
    "F3_category": "SELECT id, importance FROM {notes} WHERE category = 'cases'",
    "F4_archived": "SELECT id, category FROM {notes} WHERE status <> 'archived'",
    "F5_active": "SELECT id, status FROM {notes} WHERE status IN ('active', 'pending_review')",
    "F6_validity": f"SELECT id, CASE WHEN valid_until IS NOT NULL AND valid_until < {NOW} THEN round(importance * 0.2, 6) ELSE round(importance, 6) END AS score FROM {{notes}} WHERE valid_from IS NULL OR valid_from <= {NOW}",
    "F8_temporal": f"SELECT id, ts FROM {{notes}} WHERE ts BETWEEN {NOW - 20 * DAY} AND {NOW - 10 * DAY}",
    "F12_category_min_score": "SELECT id, category, round(importance, 6) AS score FROM {notes} WHERE importance >= CASE category WHEN 'profile' THEN 0.25 WHEN 'preferences' THEN 0.25 WHEN 'entities' THEN 0.30 WHEN 'events' THEN 0.35 WHEN 'cases' THEN 0.40 ELSE 0.45 END",
    "F18_legacy_scope": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN scope IS NULL THEN 'missing' WHEN trim(scope) = '' THEN 'empty' WHEN trim(scope) = 'global' THEN 'global' ELSE 'scoped' END AS kind FROM {notes}) k GROUP BY kind",
    "F19_evidence": "SELECT id, layer FROM {notes} WHERE layer = 'evidence'",
    "F23_usage_status": "SELECT id, CASE WHEN access_count <= 0 THEN 'unused' WHEN evo_access_count <= 0 AND access_count >= 6 THEN 'cold' WHEN evo_access_count / CAST(access_count AS DOUBLE) >= 0.3 THEN 'hot' ELSE 'warm' END AS usage FROM {notes}",
    "F25_after_before": f"SELECT id, ts FROM {{notes}} WHERE ts >= {NOW - 25 * DAY} AND ts < {NOW - 5 * DAY} ORDER BY importance DESC, i LIMIT 20",
    "F26_scope_fallback": "SELECT id FROM {notes} WHERE scope = 'nowhere:en' OR (scope_root = 'src1' AND NOT EXISTS (SELECT 1 FROM {notes} x WHERE x.scope = 'nowhere:en'))",
    # joins
    "J3_attach_vectors": "SELECT n.id, CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS has_vector FROM {notes} n LEFT JOIN {memories} v ON n.id = v.id",
    "J4_anti": "SELECT n.id FROM {notes} n LEFT ANTI JOIN {memories} v ON n.id = v.id",
    "J5_semi": "SELECT subject, object FROM {triples} t WHERE subject IN (SELECT object FROM {triples}) AND object IN (SELECT object FROM {triples})",
    "J7_entity_or": "SELECT subject, predicate, object FROM {triples} WHERE subject = 'n3' UNION ALL SELECT subject, predicate, object FROM {triples} WHERE object = 'n3' AND subject <> 'n3'",
    "J8_evolution_links": "SELECT a.id AS id, b.id AS linked, 'next' AS way FROM {notes} a JOIN {notes} b ON a.superseded_by = b.id UNION ALL SELECT b.id, a.id, 'previous' FROM {notes} a JOIN {notes} b ON a.superseded_by = b.id",
    # The newest four of a scope hold the three that are not the row itself, so no scope joins with itself.
    "J9_narrative_siblings": "SELECT id, sibling, round(score, 6) AS score FROM (SELECT a.id AS id, b.id AS sibling, b.importance * 0.7 AS score, row_number() OVER (PARTITION BY a.id ORDER BY b.ts DESC, b.i) AS rn FROM {notes} a JOIN (SELECT id, i, ts, scope, importance FROM (SELECT id, i, ts, scope, importance, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, i) AS newest FROM {notes} WHERE superseded_by IS NOT NULL) n WHERE newest <= 4) b ON a.scope = b.scope AND a.id <> b.id WHERE a.superseded_by IS NOT NULL) s WHERE rn <= 3",
    "J12_orphan_links": "SELECT n.id, n.consolidated_into FROM {notes} n LEFT JOIN {notes} t ON n.consolidated_into = t.id WHERE n.consolidated_into IS NOT NULL AND t.id IS NULL",
    "J13_point_in_time": f"SELECT id FROM {{notes}} WHERE coalesce(valid_from, ts) <= {NOW - 3 * DAY} AND coalesce(valid_until, {NOW * 2}) >= {NOW - 3 * DAY}",
    "J14_topic_coverage": f"SELECT q.topic FROM (SELECT DISTINCT topic FROM {{memories}}) q WHERE NOT EXISTS (SELECT 1 FROM {{memories}} m WHERE m.topic = q.topic AND m.ts >= {NOW - 4 * DAY})",
    # aggregates
    "A1_grouping_sets": "SELECT scope, category, count(*) AS n FROM {notes} GROUP BY GROUPING SETS ((scope), (category), ())",
    "A2_legacy_audit": "SELECT count(*) AS total, sum(CASE WHEN scope IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN scope = '' THEN 1 ELSE 0 END) AS empty_scope, sum(CASE WHEN scope = 'global' THEN 1 ELSE 0 END) AS global_scope, max(ts) AS newest FROM {notes}",
    "A3_scope_inventory": "SELECT scope, count(DISTINCT layer) AS layers, sum(n) AS n FROM (SELECT scope, 'memories' AS layer, count(*) AS n FROM {notes} GROUP BY scope UNION ALL SELECT scope, 'vectors' AS layer, count(*) AS n FROM {memories} GROUP BY scope UNION ALL SELECT scope, 'observations' AS layer, count(*) AS n FROM {observations} GROUP BY scope) u GROUP BY scope",
    "A4_active_per_scope": "SELECT scope, count(*) AS active FROM {notes} WHERE status IN ('active', 'pending_review') GROUP BY scope",
    "A6_best_triple": "SELECT source_memory_id AS id, round(max(confidence), 6) AS score FROM {triples} GROUP BY source_memory_id",
    "A8_mentions": "SELECT subject, predicate, object, count(DISTINCT source_memory_id) AS mentions, round(max(confidence), 6) AS confidence FROM {triples} GROUP BY subject, predicate, object",
    "A10_version_groups": "SELECT version_group, count(*) AS size, sum(CASE WHEN confidence < 0.1 THEN 1 ELSE 0 END) AS unranked FROM {notes} WHERE version_group IS NOT NULL GROUP BY version_group",
    "A11_dimensions": "SELECT cardinality(vector) AS dim, count(*) AS n FROM {memories} GROUP BY cardinality(vector)",
    "A12_tiers": f"SELECT sum(CASE WHEN t = 'core' THEN 1 ELSE 0 END) AS core, sum(CASE WHEN t = 'working' THEN 1 ELSE 0 END) AS working, sum(CASE WHEN t = 'peripheral' THEN 1 ELSE 0 END) AS peripheral FROM (SELECT {_TIER} AS t FROM {{notes}}) x",
    "A13_usage": "SELECT usage, count(*) AS n, max(access_count) AS most FROM (SELECT access_count, CASE WHEN access_count <= 0 THEN 'unused' WHEN evo_access_count <= 0 AND access_count >= 6 THEN 'cold' WHEN evo_access_count / CAST(access_count AS DOUBLE) >= 0.3 THEN 'hot' ELSE 'warm' END AS usage FROM {notes}) x GROUP BY usage",
    "A14_workflow_windows": f"SELECT workflow_id, days, count(*) AS total, {_WINDOW} FROM {{observations}} o CROSS JOIN (SELECT 7 AS days, TIMESTAMP '2024-01-25 00:00:00' AS since UNION ALL SELECT 30, TIMESTAMP '2024-01-02 00:00:00') w WHERE o.recorded_at >= w.since GROUP BY workflow_id, days",
    "A14_top_signals": "SELECT workflow_id, signal, n FROM (SELECT workflow_id, signal, n, row_number() OVER (PARTITION BY workflow_id ORDER BY n DESC, signal) AS rn FROM (SELECT workflow_id, signal, count(*) AS n FROM {observations} WHERE signal IS NOT NULL AND outcome <> 'success' GROUP BY workflow_id, signal) c) r WHERE rn <= 3",
    "A15_dashboard": f"SELECT scope, workflow_id, total, issues, CASE WHEN failures >= 1 OR missed >= 2 OR issues >= 3 OR (total >= 4 AND successes / CAST(total AS DOUBLE) < 0.5) THEN 'critical' WHEN issues >= 1 OR successes / CAST(total AS DOUBLE) < 0.75 THEN 'watch' ELSE 'healthy' END AS status FROM (SELECT scope, workflow_id, count(*) AS total, {_WINDOW} FROM {{observations}} WHERE recorded_at >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY scope, workflow_id) g",
    "A17_conflict_clusters": "SELECT canonical_key, count(*) AS n, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS open_n, max(ts) AS latest FROM {notes} GROUP BY canonical_key HAVING count(*) > 1",
    "A18_conflict_summary": "SELECT count(*) AS clusters, sum(n) AS members, max(n) AS largest FROM (SELECT canonical_key, count(*) AS n FROM {notes} GROUP BY canonical_key HAVING count(*) > 1) c",
    "A21_uptake": "SELECT scope_root, round(sum(CASE WHEN access_count > 0 THEN 1 ELSE 0 END) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS uptake FROM {notes} WHERE category = 'patterns' GROUP BY scope_root",
    "A22_dominant_category": "SELECT topic, category, n, round(most, 6) AS most FROM (SELECT topic, category, n, max(m) OVER (PARTITION BY topic) AS most, row_number() OVER (PARTITION BY topic ORDER BY n DESC, category) AS rn FROM (SELECT topic, category, count(*) AS n, max(importance) AS m FROM {memories} GROUP BY topic, category) c) r WHERE rn = 1",
    "A23_skip_counts": f"SELECT sum(CASE WHEN r = 'short' THEN 1 ELSE 0 END) AS short_n, sum(CASE WHEN r = 'copy' THEN 1 ELSE 0 END) AS copy_n, sum(CASE WHEN r = 'new' THEN 1 ELSE 0 END) AS new_n FROM (SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN row_number() OVER (PARTITION BY {_NORM} ORDER BY i) > 1 THEN 'copy' ELSE 'new' END AS r FROM {{notes}}) x",
    "A26_extents": "SELECT min(ts) AS min_ts, max(ts) AS max_ts, max(access_count) AS most FROM {notes}",
    # windows, sorts, sets
    "W1_channel_rank": "SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, i) AS rank FROM {notes}",
    "W3_cluster_rank": "SELECT topic, id, r AS rank, CASE WHEN r = 0 THEN 'low' WHEN r <= 2 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY confidence * importance DESC, i) - 1 AS r FROM {memories}) x",
    "W4_budget": "SELECT scope, id, chars FROM (SELECT scope, id, sum(length(text)) OVER (PARTITION BY scope ORDER BY importance DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chars, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, i) AS rn FROM {notes}) b WHERE chars <= 8000 OR rn = 1",
    "O4_priority_sort": "SELECT id, category, importance FROM {notes} ORDER BY category, importance DESC, i LIMIT 50",
    "O2_omitted": "SELECT scope, count(*) - least(count(*), 20) AS omitted FROM {notes} GROUP BY scope",
    "U5_entities": "SELECT subject AS entity FROM {triples} UNION SELECT object FROM {triples}",
    "U6_edge_dedup": "SELECT DISTINCT subject, predicate, object FROM {triples}",
    # analytical reports
    "B1_category_tier": f"SELECT category, t AS tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT category, {_TIER} AS t FROM {{notes}}) x GROUP BY category, t",
    "B3_daily": f"SELECT CAST(floor(ts / CAST({DAY} AS DOUBLE)) AS BIGINT) AS day, count(*) AS n FROM {{notes}} WHERE ts >= {NOW - 90 * DAY} GROUP BY CAST(floor(ts / CAST({DAY} AS DOUBLE)) AS BIGINT)",
    "B5_histograms": "SELECT least(19, CAST(floor(importance * 20) AS BIGINT)) AS bin, least(29, CAST(floor(least(length(text), 3000) / CAST(100 AS DOUBLE)) AS BIGINT)) AS length_bin, count(*) AS n FROM {notes} GROUP BY least(19, CAST(floor(importance * 20) AS BIGINT)), least(29, CAST(floor(least(length(text), 3000) / CAST(100 AS DOUBLE)) AS BIGINT))",
    "B6_buckets": f"SELECT CASE WHEN access_count = 0 THEN '0' WHEN access_count <= 2 THEN '1-2' WHEN access_count <= 5 THEN '3-5' ELSE '6+' END AS accesses, CASE WHEN {_AGE} < 7 THEN '<7' WHEN {_AGE} < 30 THEN '<30' ELSE '30+' END AS age, count(*) AS n FROM {{notes}} GROUP BY CASE WHEN access_count = 0 THEN '0' WHEN access_count <= 2 THEN '1-2' WHEN access_count <= 5 THEN '3-5' ELSE '6+' END, CASE WHEN {_AGE} < 7 THEN '<7' WHEN {_AGE} < 30 THEN '<30' ELSE '30+' END",
    "B7_scope_matrix": "SELECT n.scope, n.category, count(*) AS n FROM {notes} n JOIN (SELECT scope FROM (SELECT scope, row_number() OVER (ORDER BY count(*) DESC, scope) AS rn FROM {notes} GROUP BY scope) r WHERE rn <= 10) t ON n.scope = t.scope GROUP BY n.scope, n.category",
    "B8_index_percentiles": "SELECT max(CASE WHEN rn = CAST(floor(n * 0.10) AS BIGINT) + 1 THEN len END) AS p10, max(CASE WHEN rn = CAST(floor(n * 0.50) AS BIGINT) + 1 THEN len END) AS p50, max(CASE WHEN rn = CAST(floor(n * 0.90) AS BIGINT) + 1 THEN len END) AS p90, max(CASE WHEN rn = CAST(floor(n * 0.99) AS BIGINT) + 1 THEN len END) AS p99, min(len) AS least, max(len) AS most FROM (SELECT len, c, sum(c) OVER () AS n, rn FROM (SELECT len, c, sum(c) OVER (ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rn FROM (SELECT length(text) AS len, count(*) AS c FROM {notes} GROUP BY length(text)) h) r) p",
    "B11_prefixes": "SELECT prefix, count(*) AS n FROM (SELECT substring(text, 1, 40) AS prefix FROM {notes}) p GROUP BY prefix HAVING count(*) >= 3",
    "B13_fingerprint_dups": "SELECT id, fp_n FROM (SELECT id, count(*) OVER (PARTITION BY substring(text, 1, 100)) AS fp_n, row_number() OVER (PARTITION BY substring(text, 1, 100) ORDER BY access_count DESC, length(text) DESC, ts, i) AS rn FROM {notes}) d WHERE fp_n > 1 AND rn = 1",
    "B14_exact_dups": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY text ORDER BY access_count DESC, ts, i) AS rn FROM {notes}) d WHERE rn > 1",
    "B15_scope_ecology": "SELECT count(*) AS scopes, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS single, sum(CASE WHEN n <= 5 THEN 1 ELSE 0 END) AS tiny, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM (SELECT scope, count(*) AS n FROM {notes} GROUP BY scope) s",
    "B17_stale_keywords": "SELECT w.word, count(*) AS hits, sum(CASE WHEN n.access_count = 0 THEN 1 ELSE 0 END) AS dead FROM {notes} n JOIN (SELECT 'Version' AS word UNION ALL SELECT 'License' UNION ALL SELECT 'token') w ON n.text LIKE concat('%', w.word, '%') GROUP BY w.word",
    "B21_outliers": f"SELECT sum(CASE WHEN scope = '' THEN 1 ELSE 0 END) AS empty_scope, sum(CASE WHEN importance >= 0.8 AND access_count = 0 THEN 1 ELSE 0 END) AS unused_important, sum(CASE WHEN tier = 'working' AND {_AGE} > 60 THEN 1 ELSE 0 END) AS old_working FROM {{notes}}",
    "B23_dashboard": f"SELECT count(*) AS total, sum(CASE WHEN ts >= {NOW - 7 * DAY} THEN 1 ELSE 0 END) AS week, sum(CASE WHEN ts >= {NOW - 30 * DAY} THEN 1 ELSE 0 END) AS month FROM {{notes}}",
    "B24_summary": "SELECT round(100.0 * sum(CASE WHEN access_count = 0 THEN 1 ELSE 0 END) / count(*), 4) AS dead_pct, min(ts) AS oldest, max(ts) AS newest, round(avg(importance), 6) AS importance FROM {notes}",
    # extras on the same tables
    "A0_rollup": "SELECT scope_root, scope, count(*) AS n FROM {notes} GROUP BY ROLLUP (scope_root, scope)",
    "A0_cube": "SELECT tier, category, count(*) AS n FROM {notes} GROUP BY CUBE (tier, category)",
    # composed operators as relations
    "J10_cluster_members": "SELECT insight, member, round(score, 6) AS score FROM (SELECT a.id AS insight, b.id AS member, b.importance * 0.5 AS score, row_number() OVER (PARTITION BY a.id ORDER BY b.importance DESC, b.i) AS rn FROM {notes} a JOIN {notes} b ON a.consolidated_into = b.id OR a.superseded_by = b.id) x WHERE rn <= 3",
    "U3_candidates": "SELECT id, origin FROM (SELECT id, origin, row_number() OVER (PARTITION BY id ORDER BY priority) AS rn FROM (SELECT id, 'direct' AS origin, 1 AS priority FROM {notes} WHERE importance > 0.9 UNION ALL SELECT source_memory_id, 'kg', 2 FROM {triples} WHERE subject LIKE 'n%' UNION ALL SELECT superseded_by, 'evolution', 3 FROM {notes} WHERE superseded_by IS NOT NULL) u) r WHERE rn = 1",
    "W2_top_two": "SELECT scope, id FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY confidence DESC, i) AS rn FROM {notes}) x WHERE rn <= 2",
    "F22_prefilter": "SELECT query_id, id FROM (SELECT scope AS query_id, id, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, i) AS rn FROM {notes} WHERE importance >= 0.40) x WHERE rn <= 10",
    "G10_orient": "SELECT scope, count(*) AS total, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS active, max(ts) AS newest, CASE WHEN count(*) >= 10 THEN 'run' ELSE 'skip' END AS decision FROM {notes} GROUP BY scope",
    "G27_graph_edges": "SELECT source, target, kind FROM (SELECT id AS source, superseded_by AS target, 'evolution' AS kind FROM {notes} WHERE superseded_by IS NOT NULL UNION ALL SELECT id, consolidated_into, 'consolidation' FROM {notes} WHERE consolidated_into IS NOT NULL UNION ALL SELECT id, lead(id) OVER (PARTITION BY version_group ORDER BY confidence DESC, i), 'version' FROM {notes} WHERE version_group IS NOT NULL) e WHERE target IN (SELECT id FROM {notes})",
    "G28_conflict_fingerprint": "SELECT md5(concat(canonical_key, '/', category)) AS fingerprint, count(*) AS n, CASE WHEN max(access_count) >= 8 THEN 'escalated' WHEN max(ts) < 1706140800000 THEN 'stale' WHEN max(ts) < 1706572800000 THEN 'aging' ELSE 'fresh' END AS attention FROM {notes} GROUP BY canonical_key, category HAVING count(*) > 1",
    # lifecycle as relations
    "G12_retention": f"SELECT id, CASE WHEN {_AGE} > 25 THEN 'age' ELSE 'count' END AS reason FROM (SELECT id, ts, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, i) AS rn FROM {{notes}} WHERE status <> 'archived') r WHERE {_AGE} > 25 OR rn > 10",
    "G22_skill_outcomes": "SELECT workflow_id, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) AS ok, sum(CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END) AS failed, count(*) AS n FROM {observations} GROUP BY workflow_id",
    "G35_duplicate_ids": "SELECT id FROM (SELECT id FROM {notes} UNION ALL SELECT id FROM {memories}) u GROUP BY id HAVING count(*) > 1",
    "G26_checkup": f"SELECT 'orphans' AS check_name, count(*) AS n FROM {{notes}} WHERE scope IS NULL OR trim(scope) = '' UNION ALL SELECT 'core', count(*) FROM (SELECT {_TIER} AS t FROM {{notes}}) x WHERE t = 'core' UNION ALL SELECT 'unranked_groups', count(DISTINCT version_group) FROM {{notes}} WHERE version_group IS NOT NULL AND confidence < 0.1 UNION ALL SELECT 'bad_dimension', count(*) FROM {{memories}} WHERE cardinality(vector) <> 64 UNION ALL SELECT 'cold', count(*) FROM {{notes}} WHERE access_count >= 6 AND evo_access_count <= 0 UNION ALL SELECT 'open_conflicts', count(*) FROM (SELECT canonical_key FROM {{notes}} WHERE status = 'active' GROUP BY canonical_key HAVING count(*) > 1) c UNION ALL SELECT 'stale_sources', count(*) FROM (SELECT scope_root FROM {{notes}} GROUP BY scope_root HAVING max(ts) < {NOW - 7 * DAY}) s UNION ALL SELECT 'singleton_groups', count(*) FROM (SELECT version_group FROM {{notes}} WHERE version_group IS NOT NULL GROUP BY version_group HAVING count(*) = 1) v",
}


#: The same relations for Spark where the statement's own form would compare all rows with all.
PLANS = {
    "J10_cluster_members": "SELECT insight, member, round(score, 6) AS score FROM (SELECT a.id AS insight, b.id AS member, b.importance * 0.5 AS score, row_number() OVER (PARTITION BY a.id ORDER BY b.importance DESC, b.i) AS rn FROM (SELECT id, explode(array_distinct(array_compact(array(consolidated_into, superseded_by)))) AS target FROM {notes}) a JOIN {notes} b ON a.target = b.id) x WHERE rn <= 3",
}


def oracle(name: str) -> str:
    """The statement on plain tables, the model's tables as common table expressions."""
    sql = REPORTS[name]
    used = [s for s in SOURCES if "{" + s + "}" in sql]
    sql = re.sub(r"\{(\w+)\}", r"\1", sql).replace("LEFT ANTI JOIN", "ANTI JOIN").replace("cardinality(vector)", "len(vector)")
    return "WITH " + ", ".join(f"{s} AS ({SOURCES[s][0]})" for s in used) + " " + sql


def report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PLANS.get(name, REPORTS[name])
    used = {s for s in SOURCES if "{" + s + "}" in sql}
    frames = {s: getattr(model, s)(spark, sf_dir) for s in used}
    return spark.sql(sql.replace("cardinality(vector)", "size(vector)"), **frames)
