"""Operators that work in rounds: deduplication of batches, consolidation, message trees, event segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import chunking
from tidewell.functions import vector as V
from tidewell.operators import conflicts, consolidation, cover, promotion, sets, similar
from tidewell.queries import query
from tidewell.sources import trees

Spark = SparkSession

# --- Memories and rephrasings of them, which are near to the original by varying degrees --------------

_SHARED = "i, scope_root, category, importance, evo_access_count, ts"
#: id, vector of doubles and more; every memory and its rephrasing, whose vector is the same for every 16th.
_TWINS = f"""twins AS (SELECT id, {_SHARED}, CAST(vector AS DOUBLE[]) AS vector FROM ({model.MEMORIES_SQL}) a
  UNION ALL SELECT concat(id, 'r'), i, scope_root, category, importance - 0.01 * (i % 3), evo_access_count, ts, list_transform(CAST(vector AS DOUBLE[]), lambda x, k: x + CASE WHEN ((k - 1) * 7 + i) % 5 = 0 THEN ((i * 13) % 16) * 0.02::DOUBLE ELSE 0.0::DOUBLE END) FROM ({model.MEMORIES_SQL}) b)"""
_COS = "list_cosine_similarity(a.vector, b.vector)"


def _twins(spark: Spark, d: str) -> DataFrame:
    m = model.memories(spark, d).select("id", "i", "scope_root", "category", "importance", "evo_access_count", "ts", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    moved = F.transform("vector", lambda x, k: x + F.when((k * 7 + F.col("i")) % 5 == 0, ((F.col("i") * 13) % 16) * F.lit(0.02)).otherwise(0.0))
    twin = m.withColumns({"id": F.concat("id", F.lit("r")), "importance": F.col("importance") - F.lit(0.01) * (F.col("i") % 3), "vector": moved})
    return m.unionByName(twin)


def _greedy(least: str, group: str, order: str) -> str:
    """The loop over each group in order, as recursion: `last` has the centers' places of each group, `near` each row's earlier near rows."""
    return f"""t AS (SELECT *, concat_ws('/', {group}) AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM twins),
near AS (SELECT b.grp, b.rn, list(a.rn) AS earlier FROM t a JOIN t b ON a.grp = b.grp AND a.rn < b.rn AND {_COS} {least} GROUP BY b.grp, b.rn),
c AS (SELECT grp, 1::BIGINT AS rn, [1::BIGINT] AS centers FROM t WHERE rn = 1 UNION ALL SELECT c.grp, c.rn + 1, CASE WHEN n.earlier IS NOT NULL AND list_has_any(n.earlier, c.centers) THEN c.centers ELSE list_append(c.centers, c.rn + 1) END
  FROM c JOIN t ON t.grp = c.grp AND t.rn = c.rn + 1 LEFT JOIN near n ON n.grp = c.grp AND n.rn = c.rn + 1),
last AS (SELECT grp, arg_max(centers, rn) AS centers FROM c GROUP BY grp),
own AS (SELECT t.*, list_contains(l.centers, t.rn) AS center, list_min(list_intersect(n.earlier, l.centers)) AS seat FROM t JOIN last l USING (grp) LEFT JOIN near n USING (grp, rn))"""


@query("D8_batch_dedup", f"WITH RECURSIVE {_TWINS}, {_greedy('> 0.93', 'scope_root', 'importance DESC, i, id')} SELECT o.id, o.center AS kept, s.id AS \"like\" FROM own o LEFT JOIN own s ON s.grp = o.grp AND s.rn = o.seat AND NOT o.center")
def d8(spark: Spark, d: str) -> DataFrame:
    """Every memory and its rephrasing; a batch is what one source brings."""
    return similar.batch_dedup(_twins(spark, d).select("id", "vector", "importance", F.col("i").alias("position"), "scope_root"), 0.93, ["scope_root"])


_FACTS = f"""tr AS ({model.TRIPLES_SQL}), f AS (SELECT concat_ws('|', subject, predicate, object) AS fact, source_memory_id AS id FROM tr),
facts AS (SELECT DISTINCT id, fact, mentions FROM (SELECT id, fact FROM f UNION ALL SELECT concat(id, 'r'), fact FROM f WHERE length(fact) % 3 <> 0) u JOIN (SELECT fact, count(DISTINCT id) AS mentions FROM f GROUP BY fact) m USING (fact))"""


def _facts(spark: Spark, d: str) -> DataFrame:
    f = model.triples(spark, d).select(F.concat_ws("|", "subject", "predicate", "object").alias("fact"), F.col("source_memory_id").alias("id"))
    mentions = f.groupBy("fact").agg(F.count_distinct("id").alias("mentions"))
    every = f.unionByName(f.where("length(fact) % 3 <> 0").withColumn("id", F.concat("id", F.lit("r"))))
    return every.join(mentions, "fact").select("id", "fact", "mentions").distinct()


_LEAST = 2 - 1 / 0.82


@query(
    "G8_consolidation",
    f"""WITH RECURSIVE {_TWINS}, {_FACTS}, {_greedy(f'>= {_LEAST!r}::DOUBLE - 1e-12', 'scope_root, category', 'ts DESC, id')},
    m AS (SELECT own.*, CASE WHEN center THEN rn ELSE seat END AS seed FROM own), big AS (SELECT grp, seed FROM m GROUP BY grp, seed HAVING count(*) > 1),
    w AS (SELECT m.*, round(importance * (1 + ln(1 + evo_access_count)) * least(1.1, 1 + 0.06 * ln(1 + coalesce(k.mentions, 0))), 9) AS worth FROM m JOIN big USING (grp, seed) LEFT JOIN (SELECT id, max(mentions) AS mentions FROM facts GROUP BY id) k USING (id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp, seed ORDER BY worth DESC, rn) AS place FROM w),
    p AS (SELECT a.id, b.id AS canonical, round(1 / (2 - CASE WHEN a.vector = b.vector THEN 1 ELSE {_COS} END), 9) AS score FROM r a JOIN r b ON a.grp = b.grp AND a.seed = b.seed AND b.place = 1),
    n AS (SELECT id, count(*) AS n FROM facts GROUP BY id),
    j AS (SELECT p.id, p.canonical, CASE WHEN p.score >= 0.82 THEN p.score ELSE 0.82 END AS score, CASE WHEN coalesce(n1.n, 0) >= 2 AND coalesce(n2.n, 0) >= 2 THEN (SELECT count(*) FROM facts x JOIN facts y ON x.fact = y.fact WHERE x.id = p.id AND y.id = p.canonical) END AS common, n1.n AS a, n2.n AS b FROM p LEFT JOIN n n1 ON n1.id = p.id LEFT JOIN n n2 ON n2.id = p.canonical),
    s AS (SELECT id, canonical, score, CASE WHEN common IS NULL THEN 0.0::DOUBLE ELSE common / (a + b - common)::DOUBLE END AS jaccard FROM j)
    SELECT id, canonical, CASE WHEN id = canonical THEN 'canonical' WHEN score >= 0.92 OR jaccard >= 0.5 THEN 'merge' ELSE 'link' END AS action, round(score, 6) AS score, round(jaccard, 6) AS jaccard FROM s""",
)
def g8_run(spark: Spark, d: str) -> DataFrame:
    """One run over all scopes: clusters, canonicals, and what is merged or linked."""
    rows = _twins(spark, d).select("id", F.col("scope_root").alias("scope"), "category", "vector", "importance", F.col("evo_access_count").alias("accesses"), (-F.col("ts")).alias("place"))
    out = consolidation.consolidate_once(rows, _facts(spark, d))
    return out.select("id", "canonical", "action", F.round("score", 6).alias("score"), F.round("jaccard", 6).alias("jaccard"))


# --- U4, B22: likeness of fact sets ------------------------------------------------------------------

_SETS = f"""tr AS ({model.TRIPLES_SQL}), s AS (SELECT source_memory_id AS id, list_sort(list_distinct(list(object))) AS items FROM tr GROUP BY source_memory_id), k AS (SELECT min(id) AS id, items FROM s WHERE len(items) >= 2 GROUP BY items)"""


@query("U4_jaccard", f"WITH {_SETS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))::DOUBLE, 6) AS jaccard FROM k a JOIN k b ON a.id < b.id WHERE len(list_intersect(a.items, b.items)) > 0")
def u4(spark: Spark, d: str) -> DataFrame:
    """Pairs of different sets of objects that share one, however little alike, each set by the first memory that has it; members are in U4_set_classes."""
    classes = sets.set_classes(model.triples(spark, d).select(F.col("source_memory_id").alias("id"), F.col("object").alias("item")), 2)
    return sets.similar_sets(classes, 0.0).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("U4_set_classes", f"WITH {_SETS} SELECT s.id, k.id AS class FROM s JOIN k USING (items)")
def u4_classes(spark: Spark, d: str) -> DataFrame:
    return sets.set_classes(model.triples(spark, d).select(F.col("source_memory_id").alias("id"), F.col("object").alias("item")), 2).select("id", "class")


_BANDS = [("high", 0.92, 1.01), ("grey", 0.82, 0.92), ("low", 0.70, 0.82)]
_BAND = "CASE WHEN score >= 0.92 AND score < 1.01 THEN 'high' WHEN score >= 0.82 AND score < 0.92 THEN 'grey' WHEN score >= 0.70 AND score < 0.82 THEN 'low' END"


@query(
    "B22_jaccard_bands",
    f"""WITH {_TWINS}, {_FACTS}, f2 AS (SELECT id, list(DISTINCT fact) AS items FROM facts GROUP BY id),
    p AS (SELECT a.id AS a, b.id AS b, round(1 / (2 - {_COS}), 9) AS score FROM twins a JOIN twins b ON a.scope_root = b.scope_root AND a.id < b.id WHERE {_COS} >= {2 - 1 / 0.7!r}::DOUBLE - 1e-12),
    j AS (SELECT {_BAND} AS band, CASE WHEN coalesce(len(x.items), 0) >= 2 AND coalesce(len(y.items), 0) >= 2 THEN round(len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items)))::DOUBLE, 9) END AS j FROM p LEFT JOIN f2 x ON x.id = p.a LEFT JOIN f2 y ON y.id = p.b),
    r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY j) AS rn, count(j) OVER (PARTITION BY band) AS n FROM j WHERE band IS NOT NULL)
    SELECT band, count(*) AS seen, count(*) - count(j) AS thin, count(j) AS measured, round(avg(j), 6) AS mean, min(CASE WHEN j IS NOT NULL AND rn = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1 THEN j END) AS p50, min(CASE WHEN j IS NOT NULL AND rn = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1 THEN j END) AS p90,
      max(j) AS most, count(*) FILTER (j >= 0.3) AS over_0_3, count(*) FILTER (j >= 0.5) AS over_0_5, count(*) FILTER (j >= 0.7) AS over_0_7 FROM r GROUP BY band""",
)
def b22(spark: Spark, d: str) -> DataFrame:
    """How alike the facts are of memories that are as near as it takes to merge, to cluster, and less."""
    rows = similar.vector_classes(_twins(spark, d), ["scope_root"], [F.col("id")])
    firsts = rows.where("id = first")
    near = similar.near_pairs(firsts, V.cosine_of_score(0.70), ["scope_root"])
    # Pairs of classes are pairs of all their members, and members of a class are as near as can be.
    of = rows.select("id", "first")
    across = near.join(of.select(F.col("id").alias("x"), F.col("first").alias("a")), "a").join(of.select(F.col("id").alias("y"), F.col("first").alias("b")), "b").select("x", "y", "cos")
    within = of.select(F.col("id").alias("x"), "first").join(of.select(F.col("id").alias("y"), "first"), "first").where("x < y").select("x", "y", F.lit(1.0).alias("cos"))
    pairs = across.unionByName(within).select(F.col("x").alias("a"), F.col("y").alias("b"), F.round(1 / (2 - F.col("cos")), 9).alias("score"))
    out = sets.jaccard_by_band(pairs, _facts(spark, d).select("id", F.col("fact").alias("item")), _BANDS)
    return out.withColumn("mean", F.round("mean", 6))


# --- G28: conflict states ----------------------------------------------------------------------------

_LOG = "SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'detect' WHEN 'view' THEN 'note' ELSE 'resolve' END AS kind, CASE event_type WHEN 'click' THEN 'accepted-incoming' WHEN 'purchase' THEN 'merged' ELSE 'kept-existing' END AS outcome, ts FROM events"
_CELL = 6 * 3_600_000_000


@query(
    "G28_conflict_states",
    f"""WITH l AS (SELECT *, epoch_us(ts) AS t0 FROM ({_LOG}) x WHERE kind <> 'note'), w AS (SELECT *, coalesce(lag(kind) OVER o, 'none') AS before, coalesce(sum(CASE WHEN kind = 'detect' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM l WINDOW o AS (PARTITION BY key ORDER BY t0, seq)),
    e AS (SELECT *, kind = 'detect' AND before = 'resolve' AND known > 0 AS reopen, kind = 'resolve' AND before = 'detect' AS closes FROM w),
    s AS (SELECT key, arg_max(kind, (t0, seq)) AS last, count(*) FILTER (kind = 'detect') AS detections, count(*) FILTER (reopen) AS reopens, count(*) FILTER (closes) AS resolved, count(*) FILTER (kind = 'resolve' AND NOT closes) AS refused, min(t0) FILTER (kind = 'detect') AS opened_at, max(t0) FILTER (reopen) AS reopened_at, max(t0) FILTER (closes) AS closed_at, arg_max(outcome, (t0, seq)) FILTER (closes) AS outcome FROM e GROUP BY key),
    t AS (SELECT *, CASE WHEN last = 'detect' THEN 'open' ELSE outcome END AS status, ({model.NOW} * 1000 - coalesce(reopened_at, opened_at)) / 86400000000.0::DOUBLE AS age FROM s WHERE detections > 0)
    SELECT key, status, detections, reopens, resolved, refused, opened_at, reopened_at, CASE WHEN last <> 'detect' THEN closed_at END AS resolved_at, CASE WHEN status = 'open' THEN CASE WHEN age >= 14 OR reopens >= 16 THEN 'escalated' WHEN age >= 7 THEN 'stale' WHEN age >= 3 THEN 'aging' ELSE 'fresh' END END AS attention FROM t""",
)
def g28(spark: Spark, d: str) -> DataFrame:
    """The events table as a log of conflicts, one for each user: errors open, most other events resolve."""
    log = model._views(spark, d, _LOG, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    states = conflicts.fold_log(log, _CELL)
    level = conflicts.attention(states, model.NOW * 1000, 86_400_000_000, reopens=16).select("key", "attention")
    return states.join(level, "key", "left")


# --- X3: greedy cover --------------------------------------------------------------------------------

_X3 = 5


def _cover_sql() -> str:
    sql = f"""m AS ({model.MEMORIES_SQL}), c0 AS (SELECT topic AS task, id, i AS position, round(importance, 2) AS priority, lower(trim(regexp_replace(anchor, '\s+', ' ', 'g'))) AS key, l1_overview FROM m),
    l1 AS (SELECT task, id, position, priority FROM c0 WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY task, key ORDER BY position, id) = 1),
    o1 AS (SELECT DISTINCT task, id, cue FROM (SELECT task, id, unnest(regexp_extract_all(lower(l1_overview), '[a-z]{{4,}}')) AS cue FROM c0) x SEMI JOIN l1 USING (task, id))"""
    for k in range(1, _X3 + 1):
        sql += f""", b{k} AS (SELECT task, arg_min(id, (-worth, position, id)) AS id FROM (SELECT l.*, round(priority + 3.0 * coalesce(g.n, 0) - 0.01 * position, 9) AS worth FROM l{k} l LEFT JOIN (SELECT task, id, count(*) AS n FROM o{k} GROUP BY task, id) g USING (task, id)) w GROUP BY task),
        l{k + 1} AS (SELECT * FROM l{k} ANTI JOIN b{k} USING (task, id)), o{k + 1} AS (SELECT * FROM o{k} ANTI JOIN (SELECT task, cue FROM o{k} JOIN b{k} USING (task, id)) v USING (task, cue))"""
    return f"WITH {sql} " + " UNION ALL ".join(f"SELECT task, {k} AS rank, id FROM b{k}" for k in range(1, _X3 + 1))


@query("X3_greedy_cover", _cover_sql())
def x3(spark: Spark, d: str) -> DataFrame:
    """For each topic the memories that together say most of it."""
    m = model.memories(spark, d)
    rows = m.select(F.col("topic").alias("task"), "id", F.col("anchor").alias("text"), F.round("importance", 2).alias("priority"), F.col("i").alias("position"))
    cues = m.select(F.col("topic").alias("task"), "id", F.explode(F.regexp_extract_all(F.lower("l1_overview"), F.lit("([a-z]{4,})"), F.lit(1))).alias("cue"))
    return cover.greedy_cover(rows, cues, _X3)


# --- G7, G20, G21: clusters and promotion ------------------------------------------------------------

_NEAREST = f"""own2 AS (SELECT * FROM own), nearest AS (SELECT a.grp, a.rn, b.id AS center, round({_COS}, 9) AS cos, row_number() OVER (PARTITION BY a.grp, a.rn ORDER BY round({_COS}, 9) DESC, b.rn) AS place FROM own2 a JOIN own2 b ON a.grp = b.grp AND NOT a.center AND b.center AND {_COS} >= 0.75 - 1e-12),
g7 AS (SELECT o.*, CASE WHEN o.center THEN o.id ELSE n.center END AS of, CASE WHEN o.center THEN 1.0 ELSE n.cos END AS cos FROM own o LEFT JOIN nearest n ON n.grp = o.grp AND n.rn = o.rn AND n.place = 1)"""


@query("G7_greedy_clusters", f"WITH RECURSIVE {_TWINS}, {_greedy('>= 0.75 - 1e-12', 'scope_root', 'importance DESC, id')}, {_NEAREST} SELECT scope_root, id, of AS center, round(cos, 6) AS cos FROM g7")
def g7(spark: Spark, d: str) -> DataFrame:
    """Clusters of each source: the first rows that are not near to an earlier one, and the others by the nearest of them."""
    return promotion.clusters(_twins(spark, d), 0.75, ["scope_root"], [-F.col("importance")]).select("scope_root", "id", "center", F.round("cos", 6).alias("cos"))


_UNIT = "list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y))))"


@query(
    "G20_promotable",
    f"""WITH RECURSIVE {_TWINS}, {_greedy('>= 0.75 - 1e-12', 'scope_root', 'importance DESC, id')}, {_NEAREST},
    p AS (SELECT a.scope_root, a.of, avg({_COS}) AS tight FROM g7 a JOIN g7 b ON a.grp = b.grp AND a.of = b.of AND a.id < b.id GROUP BY a.scope_root, a.of)
    SELECT g.scope_root, g.of AS center, count(*) AS n, round(coalesce(max(p.tight), 1.0), 6) AS tightness, round(avg(importance), 6) AS importance, sum(evo_access_count) AS reads FROM g7 g LEFT JOIN p ON p.scope_root = g.scope_root AND p.of = g.of GROUP BY g.scope_root, g.of HAVING count(*) >= 2 AND avg(importance) >= 0.5""",
)
def g20(spark: Spark, d: str) -> DataFrame:
    t = _twins(spark, d).withColumns({"reads": F.col("evo_access_count"), "readers": F.col("evo_access_count") % 5})
    members = promotion.clusters(t, 0.75, ["scope_root"], [-F.col("importance")])
    sums = promotion.cluster_sums(t, members, ["scope_root"]).where("n >= 2 and importance >= 0.5")
    return sums.select("scope_root", "center", "n", F.round("tightness", 6).alias("tightness"), F.round("importance", 6).alias("importance"), "reads")


#: Patterns, and three cases made of each: near or far, with its words or without, with its tools or others.
_DRAFTS = "SELECT id, i, topic, concat('When ', l1_overview, chr(10), 'Tools: ', scope_root, CASE WHEN i % 4 = 0 THEN ', awk, sed' ELSE '' END) AS text, access_count % 5 AS readers FROM memories WHERE category = 'patterns'"
_CASES = "SELECT concat(id, 'c', k) AS id, i, topic, k, concat(CASE WHEN (i + k) % 3 = 0 THEN 'Nothing of it' ELSE substring(l1_overview, 1, 90) END, chr(10), 'Tools: ', CASE WHEN (i + k) % 2 = 0 THEN scope_root ELSE 'grep' END) AS text, (access_count + k) % 5 AS readers FROM memories, (SELECT unnest([0, 1, 2]) AS k) ks WHERE category = 'patterns'"
_TOKENS = """list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_./-]{3,}'), lambda w: NOT list_contains(STOP, w)))""".replace("STOP", "[" + ", ".join(f"'{w}'" for w in promotion.EMPTY_WORDS) + "]")
_TOOLS = r"list_distinct(list_filter(list_transform(string_split(regexp_extract(text, '(?:^|\n)Tools:\s*([^\n]+)', 1), ','), lambda t: lower(trim(t))), lambda t: t <> ''))"


@query(
    "G21_skill_scan",
    f"""WITH memories AS (SELECT * REPLACE (CAST(vector AS DOUBLE[]) AS vector) FROM ({model.MEMORIES_SQL}) mm), p AS ({_DRAFTS}), c AS ({_CASES}),
    pv AS (SELECT p.*, m.vector, {_TOKENS} AS tokens, {_TOOLS} AS tools FROM p JOIN (SELECT id, vector FROM memories) m USING (id)),
    cv AS (SELECT c.*, list_transform(m.vector, lambda x, j: x + CASE WHEN ((j - 1) * 7 + c.i) % 5 = 0 THEN ((c.i * 13 + c.k * 5) % 16) * 0.02::DOUBLE ELSE 0.0::DOUBLE END) AS vector, {_TOKENS} AS tokens, {_TOOLS} AS tools FROM c JOIN (SELECT id AS of_id, vector FROM memories) m ON m.of_id = regexp_replace(c.id, 'c[0-9]$', '')),
    s AS (SELECT a.id, b.id AS case_id, len(list_intersect(a.tokens, b.tokens)) >= 2 AS hit, a.tools AS tools, b.tools AS case_tools, a.readers AS r1, b.readers AS r2 FROM pv a JOIN cv b ON a.topic = b.topic AND {_COS} >= 0.75 - 1e-12),
    g AS (SELECT id, count(*) AS cases, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS resonance, greatest(max(r1), max(r2)) AS readers, any_value(tools) AS tools, list_distinct(flatten(list(case_tools))) AS named FROM s GROUP BY id HAVING count(*) >= 2),
    v AS (SELECT *, CASE WHEN len(tools) = 0 THEN 1.0 ELSE len(list_intersect(tools, named)) / len(tools)::DOUBLE END AS coverage FROM g)
    SELECT id, cases, round(coverage, 6) AS coverage, round(resonance, 6) AS resonance, coverage >= 0.5 AND resonance >= 0.5 AS ok, round(least(0.99, cases / (cases + 2.0::DOUBLE) + least(1.0, readers / 4.0::DOUBLE) * 0.15), 6) AS confidence FROM v""",
)
def g21(spark: Spark, d: str) -> DataFrame:
    """Patterns with two cases or more near to them, and whether these bear them out."""
    m = model.memories(spark, d)
    rows = m.where("category = 'patterns'").withColumn("v", F.transform("vector", lambda x: x.cast("double")))
    text = F.concat(F.lit("When "), "l1_overview", F.lit("\nTools: "), "scope_root", F.when(F.col("i") % 4 == 0, ", awk, sed").otherwise(""))
    drafts = rows.select("id", "topic", text.alias("text"), F.col("v").alias("vector"), (F.col("access_count") % 5).alias("readers"))
    c = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    moved = F.transform("v", lambda x, j: x + F.when((j * 7 + F.col("i")) % 5 == 0, ((F.col("i") * 13 + F.col("k") * 5) % 16) * F.lit(0.02)).otherwise(0.0))
    said = F.concat(F.when((F.col("i") + F.col("k")) % 3 == 0, "Nothing of it").otherwise(F.substring("l1_overview", 1, 90)), F.lit("\nTools: "), F.when((F.col("i") + F.col("k")) % 2 == 0, F.col("scope_root")).otherwise("grep"))
    cases = c.select(F.concat("id", F.lit("c"), F.col("k").cast("string")).alias("id"), "topic", said.alias("text"), moved.alias("vector"), ((F.col("access_count") + F.col("k")) % 5).alias("readers"))
    found = promotion.support_of(drafts, cases, 0.75, ["topic"])
    out = promotion.verify_patterns(drafts, cases, found)
    return out.select("id", "cases", F.round("coverage", 6).alias("coverage"), F.round("resonance", 6).alias("resonance"), "ok", F.round("confidence", 6).alias("confidence"))


# --- S19: message trees ------------------------------------------------------------------------------

#: Turns hang on earlier ones; some conversations have a cycle, a second root, or a turn without text.
_TREE = """SELECT conv_id AS tree, CAST(turn AS STRING) AS id, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 10 = 3 AND turn = 2 THEN '3' WHEN conv_id % 10 = 7 AND turn = 3 THEN 'gone' WHEN (turn + conv_id) % 3 = 0 THEN CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING) ELSE CAST(turn - 1 AS STRING) END AS parent,
  (turn * 7919 + conv_id * 31) % 1009 AS place, (turn * 31 + 5) % 17 AS at, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, CASE WHEN turn % 7 = 6 THEN '  ' ELSE text END AS text, CAST(NULL AS DOUBLE) AS at_s FROM conversations"""


@query(
    "S19_message_trees",
    f"""WITH RECURSIVE nodes AS ({_TREE.replace('AS STRING', 'AS VARCHAR')}), known AS (SELECT n.*, EXISTS (SELECT 1 FROM nodes p WHERE p.tree = n.tree AND p.id = n.parent) AS has FROM nodes n),
    root AS (SELECT tree, arg_min(id, (place, id)) AS id FROM known WHERE NOT has GROUP BY tree),
    walk AS (SELECT tree, id, 0 AS depth, []::BIGINT[] AS path FROM root UNION ALL SELECT k.tree, k.id, w.depth + 1, list_concat(w.path, [k.at, k.place]) FROM walk w JOIN known k ON k.tree = w.tree AND k.parent = w.id WHERE k.has AND w.depth < 1000)
    SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY depth, path) - 1 AS position, id, role, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM walk JOIN nodes USING (tree, id) WHERE role IN ('user', 'assistant', 'system') AND regexp_matches(text, '\\S')""",
)
def s19_trees(spark: Spark, d: str) -> DataFrame:
    """Conversations as trees of turns, in the order of a walk by levels."""
    nodes = model._views(spark, d, _TREE, "conversations")
    return trees.ordered_messages(nodes).select("tree", F.col("position").cast("long").alias("position"), "id", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- T8: event segments ------------------------------------------------------------------------------

#: Each conversation as one text with role tags, and with cues of every kind of boundary before some turns.
_CUE = """CASE (conv_id + turn) % 9 WHEN 1 THEN 'By the way, ' WHEN 3 THEN '2024-01-0' || CAST(turn + 1 AS STRING) || ' ' WHEN 5 THEN 'so?' || chr(10) || '- one ' || chr(10) || '2) two' || chr(10) || 'And then ' WHEN 7 THEN chr(10) || '```' || chr(10) || 'code on 2024-01-01' || chr(10) || '- no list' || chr(10) || '```' || chr(10) ELSE '' END"""
_LINE = f"concat(CASE WHEN role = 'user' THEN '[用户] ' ELSE '[助手] ' END, {_CUE}, text)"
_MOST, _SHORT = 700, 120


def _segments_sql() -> str:
    rx = lambda p: "regexp_matches(x, '" + p.replace("'", "''") + "')"
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    fence, item = "starts_with(regexp_replace(x, '^\\s+', ''), '```')", rx(chunking.LIST_ITEM)
    kind = f"""CASE WHEN size < {_SHORT} THEN NULL WHEN {' OR '.join(map(rx, chunking.TOPIC_SHIFTS))} THEN 'topic_shift' WHEN starts_with(x, '[用户]') AND k > start AND starts_with(regexp_replace(prev, '^\\s+', ''), '[助手]') THEN 'qa_boundary'
      WHEN {rx(chunking.TIME_JUMP)} THEN 'time_jump' WHEN listed AND regexp_matches(x, '\\S') THEN 'list_end' WHEN size + length(x) + 1 > {_MOST} THEN 'max_size' END"""
    # One step reads line k; state: size of the open segment, its first line, in a code block, in a list; what it flushes: kind, from, to.
    state = f"""CASE WHEN {fence} THEN {{'size': size + length(x) + 1, 'start': start, 'code': NOT code, 'listed': listed, 'kind': NULL::VARCHAR, 'a': 0::BIGINT, 'b': 0::BIGINT}}
      WHEN code AND size + length(x) + 1 > {2 * _MOST} THEN {{'size': 0, 'start': k + 1, 'code': false, 'listed': listed, 'kind': 'code_block', 'a': start, 'b': k}}
      WHEN code THEN {{'size': size + length(x) + 1, 'start': start, 'code': code, 'listed': listed, 'kind': NULL, 'a': 0, 'b': 0}}
      WHEN {item} THEN {{'size': size + length(x) + 1, 'start': start, 'code': code, 'listed': true, 'kind': NULL, 'a': 0, 'b': 0}}
      WHEN cut IS NULL THEN {{'size': size + length(x) + 1, 'start': start, 'code': code, 'listed': listed AND NOT regexp_matches(x, '\\S'), 'kind': NULL, 'a': 0, 'b': 0}}
      ELSE {{'size': length(x) + 1, 'start': k, 'code': code, 'listed': listed AND NOT regexp_matches(x, '\\S'), 'kind': cut, 'a': start, 'b': k - 1}} END"""
    line = _LINE.replace("AS STRING", "AS VARCHAR")
    return f"""WITH RECURSIVE docs AS (SELECT conv_id, string_agg({line}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, string_split(text, chr(10)) AS lines, text FROM docs WHERE length(text) > {_SHORT} AND regexp_matches(text, '\\S')),
    w AS (SELECT conv_id, 0::BIGINT AS k, {{'size': 0::BIGINT, 'start': 1::BIGINT, 'code': false, 'listed': false, 'kind': NULL::VARCHAR, 'a': 0::BIGINT, 'b': 0::BIGINT}} AS s FROM l
      UNION ALL SELECT conv_id, k, {state} FROM (SELECT *, {kind} AS cut FROM (SELECT w.conv_id, w.k + 1 AS k, w.s.size AS size, w.s.start AS start, w.s.code AS code, w.s.listed AS listed, l.lines[w.k + 1] AS x, coalesce(l.lines[w.k], '') AS prev FROM w JOIN l USING (conv_id) WHERE w.k < len(l.lines)) a) b),
    cuts AS (SELECT conv_id, s.a AS a, s.b AS b, s.kind AS kind FROM w WHERE s.kind IS NOT NULL UNION ALL SELECT w.conv_id, w.s.start, len(l.lines), NULL FROM w JOIN l USING (conv_id) WHERE w.k = len(l.lines) AND w.s.start <= len(l.lines)),
    seg AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a) AS n, count(*) OVER (PARTITION BY conv_id) AS of FROM (SELECT c.conv_id, a, kind, {strip("array_to_string(l.lines[a:b], chr(10))")} AS t FROM cuts c JOIN l USING (conv_id)) x WHERE t <> ''),
    named AS (SELECT conv_id, n, of, t, coalesce(kind, CASE WHEN n = 1 THEN 'initial' ELSE 'max_size' END) AS kind, max(CASE WHEN n = of THEN t END) OVER (PARTITION BY conv_id) AS final FROM seg),
    ends AS (SELECT conv_id, n, kind, CASE WHEN of > 1 AND n = of - 1 AND length(final) < {_SHORT} THEN t || chr(10) || final ELSE t END AS t FROM named WHERE NOT (of > 1 AND n = of AND length(final) < {_SHORT})
      UNION ALL SELECT conv_id, 1, 'initial', {strip('text')} FROM docs WHERE length(text) <= {_SHORT} AND regexp_matches(text, '\\S'))
    SELECT conv_id, CAST(n - 1 AS INT) AS position, kind, length(t) AS n, md5(t) AS digest FROM ends"""


@query("T8_segments", _segments_sql())
def t8(spark: Spark, d: str) -> DataFrame:
    c = model.table(spark, d, "conversations").withColumn("line", F.expr(_LINE))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = chunking.event_segments(docs, "text", _MOST, _SHORT)
    return out.select("conv_id", F.col("segment_no").alias("position"), F.col("segment_kind").alias("kind"), F.length("segment").cast("long").alias("n"), F.md5(F.col("segment").cast("binary")).alias("digest"))
