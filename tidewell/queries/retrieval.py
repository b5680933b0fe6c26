"""The retrieval pipelines whole: all profiles, all channels and stages, and the trace of what each stage did; SQL stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.operators import graph, search
from tidewell.plans import retrieval
from tidewell.plans.trace import SCHEMA, Trace
from tidewell.queries import query
from tidewell.queries import scoring as q
from tidewell.queries.kept import bm25_sql, documents_index
from tidewell.queries.memory import _TOKENS

NOW = model.NOW
Spark = SparkSession
Profile = retrieval.Profile

# --- Requests ----------------------------------------------------------------------------------------

#: Every hundredth memory asks with its vector and the beginning of its text; every other time with a few words only.
_ASK = "SELECT id AS query_id, substring(text, 1, CAST(CASE WHEN i % 200 = 0 THEN 14 ELSE 60 END AS INT)) AS query, vector AS query_vector FROM memories WHERE i % 100 = 0"


def _requests(spark: Spark, d: str) -> DataFrame:
    return spark.sql(_ASK.replace("FROM memories", "FROM {memories}"), memories=model.memories(spark, d))


def _rows(spark: Spark, d: str) -> DataFrame:
    """Memories with the length of their text in its place, written once: texts are cut before the join with vectors, so none travels."""
    notes = model.notes(spark, d).withColumn("text_length", F.length("text")).drop("text")
    vectors = model.table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))
    return graph.materialise(notes.join(vectors, "i"))


def _suppressed(rows: DataFrame) -> DataFrame:
    """What the session has had enough of: every third memory."""
    return rows.where("i % 3 = 0").select("id")


# --- SQL of the stages -------------------------------------------------------------------------------

_CLAMP = "greatest(0.0, least(1.0, {}))".format
_MEMORIES = f"memories AS (SELECT * REPLACE (CAST(vector AS DOUBLE[]) AS vector) FROM ({model.MEMORIES_SQL}) mm)"
_ACTIVE = "status IN ('active', 'pending_review')"
_LEAST = lambda p: f"{p.least_score} * CASE WHEN short THEN 0.6 ELSE 1.0 END"
_LIST = lambda column: _TOKENS.replace("lower(text)", f"lower({column})")
_SHARE = lambda column: f"CASE WHEN len(qt) = 0 OR len({column}) = 0 THEN 0.0 ELSE 0.7 * len(list_filter(qt, lambda t: list_contains({column}, t))) / len(qt) + 0.3 * len(list_filter(qt, lambda t: list_contains({column}, t))) / len({column}) END"


def _shared(p: Profile) -> list[tuple[str, str]]:
    """(name, the score s after it) of the shared stages."""
    half = q._HALF.replace("180.0", str(3 * p.decay_half_life)).replace("60.0", str(p.decay_half_life))
    weibull = q._WEIBULL.replace(q._HALF, half)
    return [
        ("recency_boost", _CLAMP(f"s + exp(-{q._AGE} / {p.half_life}) * {p.recency}")),
        ("importance_weight", _CLAMP("s * (0.5 + 0.5 * importance)")),
        ("confidence_weight", _CLAMP("s * (0.5 + 0.5 * confidence)")),
        ("boundary_weight", _CLAMP("s * CASE layer WHEN 'durable' THEN 1.01 WHEN 'evidence' THEN 0.99 ELSE 1.0 END")),
        ("asset_type_weight", _CLAMP("s")),
        ("length_norm", _CLAMP(f"s / (1 + 0.5 * log2(greatest(length(text) / {p.length_anchor}.0::DOUBLE, 1.0)))")),
        ("time_decay", f"CASE WHEN {q._EXEMPT} THEN s ELSE {_CLAMP(f's * {weibull}')} END"),
        ("evolution_blend", _CLAMP(f"s * 0.9 + 0.1 * CASE WHEN {q._EXEMPT} THEN 1.0 ELSE {q._DECAY} END")),
        ("access_boost", f"CASE WHEN evo_access_count > 0 THEN {_CLAMP('s * (1 + least(0.15, 0.03 * log2(1 + evo_access_count)))')} ELSE s END"),
    ]


def _chained(prefix: str, first: str, stages: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """CTEs of stages one after the other, from the rows of `first`; the names of the stages' tables."""
    names, out, last = [], [], first
    for k, (_, expression) in enumerate(stages):
        names.append(f"{prefix}{k}")
        out.append(f"{names[-1]} AS (SELECT * REPLACE ({expression} AS s) FROM {last})")
        last = names[-1]
    return ", ".join(out), names


def _vector_sql(p: Profile, prefix: str) -> tuple[str, list[tuple[str, str]]]:
    """CTEs of one profile's vector pipeline and (stage, table) in order; the last table is the result."""
    base = f"""{prefix}n AS (SELECT query_id, id, {_CLAMP('1 / (2 - cos)')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM cosines) r WHERE rank <= {p.candidates}),
    {prefix}v AS (SELECT n.s AS s, a.query_id, a.qt, m.* FROM {prefix}n n JOIN asked a USING (query_id) JOIN memories m ON m.id = n.id WHERE n.s >= {_LEAST(p)}),
    {prefix}a AS (SELECT * REPLACE ({_CLAMP(f"s * (1 + 0.25 * {_SHARE('ta')})")} AS s) FROM (SELECT *, {_LIST('anchor')} AS ta FROM {prefix}v) t)"""
    chain, names = _chained(f"{prefix}s", f"{prefix}a", _shared(p))
    end = f"""{prefix}x AS (SELECT * REPLACE (CASE WHEN i % 3 = 0 THEN s * 0.3 ELSE s END AS s) FROM {names[-1]}),
    {prefix}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS position FROM {prefix}x) z WHERE position <= 10)"""
    stages = [("vector_search", f"{prefix}v"), ("anchor_boost", f"{prefix}a"), *((n, t) for (n, _), t in zip(_shared(p), names)), ("session_suppression", f"{prefix}x"), ("finalise", f"{prefix}f")]
    return f"{base}, {chain}, {end}", stages


_ASKED = f"ask AS ({_ASK}), asked AS (SELECT *, len(qt) <= 4 AS short FROM (SELECT *, {_LIST('query')} AS qt FROM ask) x)"
_COSINES = f"cosines AS (SELECT a.query_id, m.id, list_cosine_similarity(m.vector, a.query_vector) AS cos FROM memories m, ask a WHERE m.id <> a.query_id AND m.{_ACTIVE})"


def _profiles_sql() -> str:
    parts = [(p.name, *_vector_sql(p, f"p{k}")) for k, p in enumerate(retrieval.PROFILES.values())]
    return f"WITH {_MEMORIES}, {_ASKED}, {_COSINES}, {', '.join(c for _, c, _ in parts)} " + " UNION ALL ".join(f"SELECT '{n}' AS profile, query_id, id, position, round(s, 6) AS score FROM {stages[-1][1]}" for n, _, stages in parts)


@query("K11_profiles", _profiles_sql())
def k11(spark: Spark, d: str) -> DataFrame:
    """Every profile over the vector path, with anchors, least scores and what a session suppresses."""
    rows, requests, out = _rows(spark, d), graph.materialise(_requests(spark, d)), None
    near = graph.materialise(retrieval.nearest(rows, requests))
    for p in retrieval.PROFILES.values():
        found = retrieval.vector_pipeline(rows, requests, p, NOW, suppressed=_suppressed(rows), near=near)
        found = found.select(F.lit(p.name).alias("profile"), "query_id", "id", "position", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


# --- The hybrid path ---------------------------------------------------------------------------------

_ROUNDS = 3


def _graph_sql() -> str:
    sql = f"""triples AS ({model.TRIPLES_SQL}), o AS (SELECT subject, predicate, object, max(confidence) * CASE predicate WHEN 'lives_in' THEN 0.70 WHEN 'located_in' THEN 0.70 ELSE 0.60 END AS w FROM triples GROUP BY subject, predicate, object),
    e AS (SELECT subject AS src, object AS dst, w FROM o UNION ALL SELECT object, subject, w FROM o), fl AS (SELECT e.src, e.dst, e.w / t.total AS p FROM e JOIN (SELECT src, sum(w) AS total FROM e GROUP BY src) t USING (src)),
    sd AS (SELECT DISTINCT a.query_id, t.subject AS entity FROM ask a JOIN triples t ON t.source_memory_id = a.query_id), r0 AS (SELECT query_id, entity, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS s FROM sd)"""
    for k in range(1, _ROUNDS + 1):
        sql += f", r{k} AS (SELECT query_id, entity, sum(s) AS s FROM (SELECT r.query_id, fl.dst AS entity, r.s * fl.p * 0.85 AS s FROM r{k - 1} r JOIN fl ON fl.src = r.entity UNION ALL SELECT query_id, entity, s * 0.15 FROM r0) u GROUP BY query_id, entity)"
    return sql + f""", gh AS (SELECT r.query_id, t.source_memory_id AS id, max(r.s * t.confidence) AS s FROM triples t JOIN r{_ROUNDS} r ON r.entity = t.subject OR r.entity = t.object GROUP BY r.query_id, t.source_memory_id),
    linked AS (SELECT query_id, id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM gh WHERE s > 0) x WHERE rank <= 20 AND id IN (SELECT id FROM memories WHERE {_ACTIVE}))"""


def _hybrid_sql(p: Profile, prefix: str) -> tuple[str, list[tuple[str, str]]]:
    vw, bw, short_v, short_b = p.vector_weight, p.keyword_weight, p.vector_weight * 0.7, min(p.keyword_weight * 1.5, 0.6)
    average = lambda a, b: f"({a!r} * v + {b!r} * b) / ({a!r} + {b!r})"
    fused = f"""CASE WHEN v IS NOT NULL AND b IS NOT NULL THEN {_CLAMP(f"CASE WHEN short THEN {average(short_v, short_b)} ELSE {average(vw, bw)} END * 1.05 + coalesce(g, 0) * 0.15")} WHEN v IS NOT NULL THEN {_CLAMP('v + coalesce(g, 0) * 0.15')}
      WHEN g IS NOT NULL THEN {_CLAMP('g + CASE WHEN coalesce(b, 0) > 0 THEN 0.10 ELSE 0 END')} ELSE {_CLAMP('b * CASE WHEN short THEN 1.15 ELSE 1.0 END')} END"""
    by_length = lambda a, b, c: f"(CASE WHEN len(qt) <= 3 THEN {a} WHEN len(qt) <= 10 THEN {b} ELSE {c} END)"
    w, w0, w1 = by_length(0.5, 0.65, 0.8), by_length(0.25, 0.2, 0.1), by_length(0.25, 0.15, 0.1)
    base = f"""{prefix}n AS (SELECT query_id, id, {_CLAMP('1 / (2 - cos)')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM cosines) r WHERE rank <= {p.candidates}),
    {prefix}c AS (SELECT coalesce(n.query_id, w.query_id, l.query_id) AS query_id, coalesce(n.id, w.id, l.id) AS id, n.s AS v, w.s AS b, l.s AS g FROM {prefix}n n FULL JOIN words w ON n.query_id = w.query_id AND n.id = w.id FULL JOIN linked l ON l.query_id = coalesce(n.query_id, w.query_id) AND l.id = coalesce(n.id, w.id)),
    {prefix}u AS (SELECT {fused} AS s, a.query_id, a.qt, a.short, a.query_vector, m.*, {_LIST('l0_abstract')} AS t0, {_LIST('l1_overview')} AS t1, {_LIST('anchor')} AS ta FROM {prefix}c c JOIN asked a USING (query_id) JOIN memories m ON m.id = c.id),
    {prefix}b AS (SELECT * REPLACE ((s * {w} + {w0} * {_SHARE('t0')} + {w1} * {_SHARE('t1')}) / ({w} + {w0} + {w1}) AS s) FROM {prefix}u),
    {prefix}a AS (SELECT * REPLACE ({_CLAMP(f"s * (1 + 0.25 * {_SHARE('ta')})")} AS s) FROM {prefix}b),
    {prefix}m AS (SELECT * FROM {prefix}a WHERE s >= {_LEAST(p)}),
    {prefix}r AS (SELECT * REPLACE ({_CLAMP('s * 0.7 + 0.3 * list_cosine_similarity(vector, query_vector)')} AS s) FROM (SELECT * FROM {prefix}m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 20) t)"""
    chain, names = _chained(f"{prefix}s", f"{prefix}r", _shared(p))
    end = f"""{prefix}d AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope_root ORDER BY s DESC, id) AS rn FROM {names[-1]}) x),
    {prefix}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 AND f >= 3 AND rn > 1 THEN 1 ELSE 0 END, s DESC, id) AS position FROM {prefix}d) y WHERE position <= 10)"""
    stages = [("vector_search", f"{prefix}n"), ("bm25_search", "words"), ("graph_search", "linked"), ("fusion", f"{prefix}u"), ("multi_vector_blend", f"{prefix}b"), ("anchor_boost", f"{prefix}a"), ("min_score_filter", f"{prefix}m"), ("rerank", f"{prefix}r"), *((n, t) for (n, _), t in zip(_shared(p), names)), ("finalise", f"{prefix}f")]
    return f"{base}, {chain}, {end}", stages


_WORDS = f"words AS (SELECT query_id, id, 1 / (1 + exp(-raw / 5)) AS s FROM rk WHERE rank <= 20 AND id IN (SELECT id FROM memories WHERE {_ACTIVE}))"
_CHANNELS = f"{_MEMORIES}, {_ASKED}, {_COSINES}, {bm25_sql('SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents', 'SELECT query_id, query FROM ask')}, {_WORDS}, {_graph_sql()}"


def _hybrid_profiles_sql() -> str:
    parts = [(p.name, *_hybrid_sql(p, f"h{k}")) for k, p in enumerate(retrieval.PROFILES.values())]
    return f"WITH {_CHANNELS}, {', '.join(c for _, c, _ in parts)} " + " UNION ALL ".join(f"SELECT '{n}' AS profile, query_id, id, position, round(s, 6) AS score FROM {stages[-1][1]}" for n, _, stages in parts)


def _channels(spark: Spark, d: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score) of keywords and of the graph, written once for all profiles."""
    words = graph.materialise(documents_index(spark, d).search(requests.select("query_id", "query")).select("query_id", "id", "score"))
    triples = model.triples(spark, d)
    seeds = requests.select("query_id").join(triples, F.col("query_id") == F.col("source_memory_id")).select("query_id", F.col("subject").alias("entity"))
    ranks = graph.pagerank_batch(graph.edges(triples), seeds, iterations=_ROUNDS)
    return words, graph.materialise(search.graph_scores_batch(triples, ranks))


@query("K10_hybrid_pipeline", _hybrid_profiles_sql())
def k10(spark: Spark, d: str) -> DataFrame:
    """Every profile over the hybrid path with all three channels."""
    rows, requests, out = _rows(spark, d), graph.materialise(_requests(spark, d)), None
    words, linked = _channels(spark, d, requests)
    near = graph.materialise(retrieval.nearest(rows, requests))
    for p in retrieval.PROFILES.values():
        found = retrieval.hybrid_pipeline(rows, requests, words, p, NOW, graph=linked, near=near)
        found = found.select(F.lit(p.name).alias("profile"), "query_id", "id", "position", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def _trace_sql() -> str:
    p = retrieval.PROFILES["default"]
    vector, vector_stages = _vector_sql(p, "v")
    hybrid, hybrid_stages = _hybrid_sql(p, "h")
    rows = []
    for name, stages in (("vector", vector_stages), ("hybrid", hybrid_stages)):
        for k, (stage, t) in enumerate(stages, 1):
            before = "0" if k == 1 or stage in ("bm25_search", "graph_search") else "(SELECT count(*) FROM hn) + (SELECT count(*) FROM words) + (SELECT count(*) FROM linked)" if stage == "fusion" else f"(SELECT count(*) FROM {stages[k - 2][1]})"
            rows.append(f"SELECT '{name}' AS pipeline, {k} AS place, '{stage}' AS stage, {before} AS rows_in, (SELECT count(*) FROM {t}) AS rows_out, (SELECT round(min(s), 6) FROM {t}) AS least, (SELECT round(max(s), 6) FROM {t}) AS most")
    return f"WITH {_CHANNELS}, {vector}, {hybrid} SELECT pipeline, place, stage, rows_in, rows_out, greatest(rows_in - rows_out, 0) AS dropped, least, most FROM ({' UNION ALL '.join(rows)}) r"


@query("G34_stage_trace", _trace_sql())
def g34(spark: Spark, d: str) -> DataFrame:
    """Both pipelines run once each, with what every stage took in and gave out."""
    rows, requests, p = _rows(spark, d), graph.materialise(_requests(spark, d)), retrieval.PROFILES["default"]
    words, linked = _channels(spark, d, requests)
    near = graph.materialise(retrieval.nearest(rows, requests))
    seen = {"vector": Trace(), "hybrid": Trace()}
    graph.materialise(retrieval.vector_pipeline(rows, requests, p, NOW, suppressed=_suppressed(rows), trace=seen["vector"], near=near).select("query_id", "id", "score"))
    graph.materialise(retrieval.hybrid_pipeline(rows, requests, words, p, NOW, graph=linked, trace=seen["hybrid"], near=near).select("query_id", "id", "score"))
    stages = [(name, *r) for name, t in seen.items() for r in t.rows()]
    out = spark.createDataFrame(stages, f"pipeline string, {SCHEMA}")
    return out.withColumns({"least": F.round("least", 6), "most": F.round("most", 6)})
