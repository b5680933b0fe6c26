"""Store, search, selection, text, graph and lifecycle operators over the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import errors, gates
from tidewell.functions import scoring as S
from tidewell.functions import text as T
from tidewell.functions import vector as V
from tidewell.operators import graph, lifecycle, overlap, search, selecting, store
from tidewell.plans import retrieval
from tidewell.queries import query

NOW, DAY = model.NOW, model.DAY_MS
N = f"WITH notes AS ({model.NOTES_SQL})"
M = f"WITH memories AS (SELECT * REPLACE (CAST(vector AS DOUBLE[]) AS vector) FROM ({model.MEMORIES_SQL}) mm)"
TR = f"WITH triples AS ({model.TRIPLES_SQL})"
notes, memories, triples = model.notes, model.memories, model.triples
Spark = SparkSession


def _vector(spark: Spark, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in model.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _query_vectors(spark: Spark, sf_dir: str) -> DataFrame:
    """The batch of queries of a search: every vector whose id is divisible by 100, against all rows."""
    return model.table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"))


# --- S: store ----------------------------------------------------------------------------------------


@query("S2_list", f"{N} SELECT id, text, category, scope, importance, ts FROM notes WHERE (scope LIKE 'src1%') AND category = 'cases' ORDER BY ts DESC, id LIMIT 20 OFFSET 5")
def s2(spark: Spark, d: str) -> DataFrame:
    return store.listed(notes(spark, d), ["src1"], "cases", 20, 5)


@query("S3_page", f"{N} SELECT id, scope FROM notes WHERE scope LIKE 'src2%' OR scope = 'src3:en'")
def s3(spark: Spark, d: str) -> DataFrame:
    return store.scan(notes(spark, d), ["src2", "src3:en"], columns=("id", "scope"))


@query("S4_lookup", f"{N} SELECT id, category FROM notes WHERE id = '17'")
def s4(spark: Spark, d: str) -> DataFrame:
    return store.lookup(notes(spark, d), "17").select("id", "category")


@query("S5_vectors", f"{M} SELECT id, round(list_sum(vector), 5) AS total FROM memories WHERE i % 3 = 0")
def s5(spark: Spark, d: str) -> DataFrame:
    found = store.vectors_of(memories(spark, d), notes(spark, d).where("i % 3 = 0"))
    return found.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("S7_upsert", f"{N}, b AS (SELECT id, concat('new ', CAST(seq AS VARCHAR)) AS text FROM (SELECT CAST(i % 50 AS VARCHAR) AS id, i AS seq, row_number() OVER (PARTITION BY i % 50 ORDER BY i DESC) AS rn FROM notes WHERE i % 3 = 0) x WHERE rn = 1) SELECT id, text FROM b UNION ALL SELECT id, substring(text, 1, 30) FROM notes WHERE id NOT IN (SELECT id FROM b)")
def s7(spark: Spark, d: str) -> DataFrame:
    old = notes(spark, d).select("id", F.substring("text", 1, 30).alias("text"))
    batch = notes(spark, d).where("i % 3 = 0").select((F.col("i") % 50).cast("string").alias("id"), F.concat(F.lit("new "), F.col("i").cast("string")).alias("text"), F.col("i").alias("seq"))
    return store.upsert(old, store.last_of_each(batch).select("id", "text"))


@query("S8_import", f"{N} SELECT id, ts FROM notes UNION ALL SELECT concat('x', id), ts FROM notes WHERE i % 100 = 0")
def s8(spark: Spark, d: str) -> DataFrame:
    old = notes(spark, d).select("id", "ts")
    return store.append_import(old, notes(spark, d).where("i % 100 = 0").select(F.concat(F.lit("x"), "id").alias("id"), "ts"))


@query("S9_patch", f"{N} SELECT id, CASE WHEN i % 7 = 0 THEN 'patched' ELSE category END AS category, CASE WHEN i % 14 = 0 THEN 0.5 ELSE round(importance, 6) END AS importance FROM notes")
def s9(spark: Spark, d: str) -> DataFrame:
    old = notes(spark, d).select("id", "category", F.round("importance", 6).alias("importance"))
    patches = notes(spark, d).where("i % 7 = 0").select("id", F.lit("patched").alias("category"), F.when(F.col("i") % 14 == 0, 0.5).alias("importance"))
    return store.patch(old, patches, ["category", "importance"])


@query("S11_delete", f"{N} SELECT id FROM notes WHERE i % 3 <> 0")
def s11(spark: Spark, d: str) -> DataFrame:
    return store.delete(notes(spark, d).select("id"), notes(spark, d).where("i % 3 = 0"))


@query("S12_bulk_delete", f"{N} SELECT id FROM notes WHERE NOT (scope LIKE 'src1%' AND ts < {NOW - 10 * DAY})")
def s12(spark: Spark, d: str) -> DataFrame:
    return store.bulk_delete(notes(spark, d), ["src1"], NOW - 10 * DAY).select("id")


@query("S13_content_id", f"{N}, h AS (SELECT id, sha256('tidewell:v1' || chr(0) || scope || chr(0) || text) AS h FROM notes) SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS content_id FROM h")
def s13(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).select("id", T.content_id(F.col("scope"), F.col("text")).alias("content_id"))


@query("S21_latest_record", f"{N} SELECT scope, id FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY rich DESC, rn) AS pick FROM (SELECT scope, id, CASE WHEN access_count > 5 THEN 1 ELSE 0 END AS rich, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, id) AS rn FROM notes) a WHERE rn <= 5) b WHERE pick = 1")
def s21(spark: Spark, d: str) -> DataFrame:
    return store.latest_record(notes(spark, d), "scope", "ts", F.col("access_count") > 5).select("scope", "id")


@query("S23_stale_sources", f"{N} SELECT scope AS source, max(ts) AS last_ms, CAST(floor(({NOW} - max(ts)) / 86400000.0::DOUBLE) AS BIGINT) AS days FROM notes GROUP BY scope HAVING floor(({NOW} - max(ts)) / 86400000.0::DOUBLE) > 3")
def s23(spark: Spark, d: str) -> DataFrame:
    return store.stale_sources(notes(spark, d).select(F.col("scope").alias("source"), F.col("ts").alias("at_ms")), NOW, 3)


_TRIPLES = "SELECT subject, predicate, object, round(max(confidence), 6) AS confidence, count(DISTINCT source_memory_id) AS mention_count FROM {} GROUP BY subject, predicate, object"


@query("S25_triples", f"{TR} {_TRIPLES.format('triples')}")
def s25(spark: Spark, d: str) -> DataFrame:
    t = triples(spark, d)
    old, new = t.where("length(subject) % 2 = 0"), t.where("length(subject) % 2 = 1 or subject like 's%'")
    merged = store.merge_triples(store.collapse_triples(old), store.collapse_triples(new))
    return merged.select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"), "mention_count")


@query("S26_entities", f"{TR} SELECT subject AS entity FROM triples UNION SELECT object FROM triples")
def s26(spark: Spark, d: str) -> DataFrame:
    return store.entities(triples(spark, d))


@query("S26_outgoing_incoming", f"{TR} SELECT subject, predicate, object FROM triples WHERE subject = 'n7' OR object = 'n7'")
def s26b(spark: Spark, d: str) -> DataFrame:
    return store.triples_of_entity(triples(spark, d), "n7").select("subject", "predicate", "object")


@query("S27_forget_source", f"{TR} SELECT subject, object FROM triples GROUP BY subject, predicate, object HAVING count(DISTINCT CASE WHEN source_memory_id <> '3' THEN source_memory_id END) > 0")
def s27(spark: Spark, d: str) -> DataFrame:
    return store.forget_source(store.collapse_triples(triples(spark, d)), "3").select("subject", "object")


@query("J6_triples_of_memories", f"{TR} SELECT DISTINCT subject, object FROM triples WHERE CAST(source_memory_id AS BIGINT) % 10 = 0")
def j6(spark: Spark, d: str) -> DataFrame:
    c = store.collapse_triples(triples(spark, d))
    ids = store.triples_of_memories(c, notes(spark, d).where("i % 10 = 0"))
    return c.join(ids, "triple_id", "left_semi").select("subject", "object")


# --- F, T: predicates and text -----------------------------------------------------------------------


@query("F1_scope", f"{N} SELECT id FROM notes WHERE scope = 'src4:de' OR scope LIKE 'src1%'")
def f1(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).where(T.scope_predicate(F.col("scope"), ["src4:de", "src1"])).select("id")


def _conversation(spark: Spark, d: str) -> DataFrame:
    return model.table(spark, d, "conversations")


def _noise_sql() -> str:
    """The families in order; the SQL engine's flags are written in front as here."""
    like = lambda patterns: " OR ".join("regexp_matches(t, '" + p.replace("'", "''") + "')" for p in patterns)
    cases = ["WHEN length(t) < 5 THEN 'short'"]
    for family, patterns in T.NOISE.items():
        cases.append(f"WHEN {like(patterns)} THEN '{family}'")
        if family == "boilerplate":
            cases.append(f"WHEN length(t) <= 10 AND ({like(T.SHORT_NOISE)}) THEN '{family}'")
    said = "SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, -turn - 1, substring(text, 1, 9) FROM conversations UNION ALL SELECT conv_id, 1000 + turn, concat('Hello there, ', text) FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 2000 + turn, concat('\"turn\": ', CAST(turn AS VARCHAR), ', ', text) FROM conversations"
    return f"WITH s AS (SELECT conv_id, turn, trim(text) AS t FROM ({said}) u) SELECT conv_id, turn, family FROM (SELECT conv_id, turn, CASE {' '.join(cases)} END AS family FROM s) x WHERE family IS NOT NULL"


@query("F9_noise", _noise_sql())
def f9(spark: Spark, d: str) -> DataFrame:
    """Messages as they are, their beginnings, and with what makes noise of them put before."""
    c = _conversation(spark, d).select("conv_id", "turn", "role", "text")
    t = F.col("turn")
    said = c.select("conv_id", "turn", "text").unionByName(c.select("conv_id", (-t - 1).alias("turn"), F.substring("text", 1, 9).alias("text")))
    said = said.unionByName(c.where("role = 'user'").select("conv_id", (1000 + t).alias("turn"), F.concat(F.lit("Hello there, "), "text").alias("text")))
    said = said.unionByName(c.select("conv_id", (2000 + t).alias("turn"), F.concat(F.lit('"turn": '), t.cast("string"), F.lit(", "), "text").alias("text")))
    return said.withColumn("family", T.noise_family(F.col("text"))).where("family is not null").select("conv_id", "turn", "family")


def _any_sql(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


#: Messages as they are, and with cues before and after some of them, so that every branch has hits, misses and near misses.
_SAID = """SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT conv_id, 1000 + turn, concat(CASE (conv_id + turn) % 12 WHEN 0 THEN 'Do you remember ' WHEN 1 THEN 'the auto-recall of ' WHEN 2 THEN 'ok' WHEN 3 THEN '上次 ' WHEN 4 THEN 'git log ' WHEN 5 THEN 'on 2024-01-05 '
    WHEN 6 THEN '下次要 ' WHEN 7 THEN 'REMEMBER: ' WHEN 8 THEN 'edit notes.md ' WHEN 9 THEN '继续' WHEN 10 THEN '谢谢，好的' ELSE 'mv a b, ' END, CASE WHEN (conv_id + turn) % 12 IN (2, 9, 10) THEN '' ELSE substring(text, 1, 40) END) FROM conversations
  UNION ALL SELECT conv_id, 2000 + turn, substring(text, 1, CAST(conv_id % 23 AS INT)) FROM conversations"""


def _said(spark: Spark, d: str) -> DataFrame:
    return model._views(spark, d, _SAID, "conversations")


_ALONE = "NOT regexp_matches(t, '\\s') OR regexp_matches(t, '[?？]')"
#: This engine writes code points in patterns in braces.
_BRACED = lambda p: re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p)
_CJK = _BRACED(f"regexp_matches(t, '[{T.HAN}\\u3040-\\u30ff]')")


@query("F10_skip_search", f"WITH s AS (SELECT conv_id, turn, trim(text) AS t FROM ({_SAID}) x) SELECT conv_id, turn, NOT {_any_sql('t', gates.FORCE_SEARCH)} AND (length(t) < CASE WHEN {_CJK} THEN 2 ELSE 4 END OR {_any_sql('t', gates.SKIP_SEARCH)} OR (length(t) < CASE WHEN {_CJK} THEN 2 ELSE 15 END AND NOT ({_ALONE}))) AS skip FROM s")
def f10(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", gates.skip_search(F.col("text")).alias("skip"))


_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_FLUFF = gates.FLUFF.replace("'", "''")
#: A cue's edges as characters that are taken, as this engine has no look-around.
_CUES_EN = [p.replace(r"(?<![\w-])", r"(^|[^\w-])").replace(r"(?![\w-])", r"([^\w-]|$)") for p in gates.FORCE_EN]
_GATE = f"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ({_SAID}) x), b AS (SELECT *, lower(t) AS low, regexp_replace(lower(t), '{_FLUFF}', '') AS bare FROM s),
p AS (SELECT *, list_filter(regexp_split_to_array(bare, '[\\s,，。!！~]+'), lambda x: x <> '') AS parts FROM b),
g AS (SELECT conv_id, turn, CASE WHEN t = '' THEN 'skip-all/skip:empty' WHEN {_any_sql('t', list(gates.FORCE))} THEN 'full-recall/force:memory-cue-zh' WHEN {_any_sql('low', _CUES_EN)} THEN 'full-recall/force:memory-cue-en' WHEN length(t) > 80 THEN 'pass/pass:long'
  WHEN regexp_matches(t, '^/\\S+') THEN 'skip-all/skip:slash' WHEN regexp_matches(t, '(?i)^HEARTBEAT') THEN 'skip-all/skip:heartbeat' WHEN length(t) <= 60 AND regexp_matches(t, '{_BRACED(gates.COMMAND)}') THEN 'skip-all/skip:cli' WHEN bare IN {_IN(gates.GREETINGS)} THEN 'skip-all/skip:greeting'
  WHEN bare <> '' AND (bare IN {_IN(gates.ACKS)} OR (len(parts) > 1 AND len(list_filter(parts, lambda x: regexp_replace(x, '{_FLUFF}', '') NOT IN {_IN(gates.ACKS)})) = 0)) THEN 'skip-all/skip:ack' WHEN bare IN {_IN(gates.RESUME)} THEN 'resume-only/resume:continuity' ELSE 'pass/pass:default' END AS g FROM p)
SELECT conv_id, turn, string_split(g, '/')[1] AS decision, string_split(g, '/')[2] AS rule FROM g"""


@query("F11_recall_gate", _GATE)
def f11(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d).withColumn("g", gates.recall_gate(F.col("text"))).select("conv_id", "turn", "g.decision", "g.rule")


def _noise_case() -> str:
    cases = ["WHEN length(t) < 5 THEN true"]
    for family, patterns in T.NOISE.items():
        cases.append(f"WHEN {_any_sql('t', patterns)} THEN true")
        if family == "boilerplate":
            cases.append(f"WHEN length(t) <= 10 AND {_any_sql('t', T.SHORT_NOISE)} THEN true")
    return f"CASE {' '.join(cases)} ELSE false END"


@query("F17_salient", f"WITH s AS (SELECT conv_id, turn, trim(text) AS t FROM ({_SAID}) x) SELECT conv_id, turn, length(t) >= 20 AND NOT {_noise_case()} AS salient FROM s")
def f17(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", gates.salient(F.col("text")).alias("salient"))


@query("F20_temporal_or_action", f"SELECT conv_id, turn, {_any_sql('text', [gates.DATES, gates.FILE_OPERATIONS, gates.INSTRUCTIONS, gates.CORRECTIONS])} AS hit FROM ({_SAID}) x")
def f20(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", gates.temporal_or_action(F.col("text")).alias("hit"))


@query("T17_error_signatures")
def t17(spark: Spark, d: str) -> DataFrame:
    return _conversation(spark, d).select("conv_id", "turn", F.array_join(errors.error_signatures(F.col("text")), "|").alias("signatures"))


@query("T25_query_entities")
def t25(spark: Spark, d: str) -> DataFrame:
    return _conversation(spark, d).where("role = 'user'").select("conv_id", "turn", F.array_join(errors.query_entities(F.col("text")), "|").alias("entities"))


@query("F15_exact_token", f"{N} SELECT id FROM notes WHERE len(list_filter(regexp_split_to_array(text, '[\\s，。、；：（）()【】「」\"''`?？!！]+'), lambda t: length(t) >= 5 AND (regexp_matches(t, '^[A-Z][A-Z0-9]*_[A-Z0-9_]+$') OR regexp_matches(t, '(?i)^[a-z][a-z0-9]*_[a-z0-9_]+$') OR regexp_matches(t, '(?i)^[\\w./-]+\\.(ts|tsx|js|jsx|py|md|sh|json|sql|go|rs|java|cpp|yml|yaml|toml)$') OR (regexp_matches(t, '(?i)^[0-9a-f]{{7,40}}$') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '(?i)[a-f]'))))) > 0")
def f15(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).where(T.has_exact_token(F.col("text"))).select("id")


@query("F13_layer_admission", f"{N} SELECT scope AS query_id, id FROM (SELECT scope, id, layer, sum(CASE WHEN coalesce(layer, '') <> 'evidence' THEN 1 ELSE 0 END) OVER (PARTITION BY scope) AS n FROM notes) x WHERE coalesce(layer, '') <> 'evidence' OR n < 3")
def f13(spark: Spark, d: str) -> DataFrame:
    return selecting.layer_admission(notes(spark, d).withColumn("query_id", F.col("scope")), F.coalesce("layer", F.lit("")) == "evidence").select("query_id", "id")


_F16 = "SELECT id, scope_root, ts, importance, CASE WHEN i % 9 = 1 THEN ' tiny ' WHEN i % 9 = 2 THEN concat('I don\\'t recall ', substring(text, 1, 50)) ELSE text END AS text FROM notes"


@query("F16_admission", f"{N}, r AS ({_F16.replace(chr(92) + chr(39), chr(39) * 2)}), w AS (SELECT id, importance, trim(text) AS t, count(*) OVER (PARTITION BY scope_root ORDER BY ts RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING) AS n FROM r) SELECT id, CASE WHEN length(t) < 10 THEN 'too_short' WHEN {_noise_case()} THEN 'noise' WHEN importance < 0.35 THEN 'low_importance' WHEN n >= 3 THEN 'rate_limited' END AS reason FROM w")
def f16(spark: Spark, d: str) -> DataFrame:
    """Notes as writes, some of them short or noise; three writes of a source in a day are enough."""
    rows = spark.sql(_F16.replace("FROM notes", "FROM {notes}"), notes=notes(spark, d))
    w = W.partitionBy("scope_root").orderBy("ts").rangeBetween(-DAY, -1)
    df = rows.withColumn("n", F.count("*").over(w))
    return df.select("id", selecting.admission(F.col("text"), T.is_noise(F.col("text")), F.col("importance"), F.col("n"), least_importance=0.35, most_recent=3).alias("reason"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_EN)
_HAN = "[一-鿿㐀-䶿]"
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{_HAN}|[a-z0-9_]+'), lambda x: (length(x) > 1 OR regexp_matches(x, '{_HAN}')) AND x NOT IN ({_STOP}, {', '.join(repr(w) for w in T.STOP_ZH)}))"


@query("T1_tokens", f"SELECT doc_id, len({_TOKENS}) AS n FROM documents")
def t1(spark: Spark, d: str) -> DataFrame:
    return model.table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


_TAGS = {k: v for k, v in T.TOPICS.items()}
_COUNTS = ", ".join(f"len(regexp_extract_all(h, '\\b({p})\\b')) AS c_{k}" for k, p in _TAGS.items())
_BEST = "greatest(" + ", ".join(f"c_{k}" for k in _TAGS) + ")"


@query("T14_topic_tag", f"WITH t AS (SELECT conv_id, turn, lower(substring(text, 1, 2000)) AS h FROM conversations UNION ALL SELECT page_id, -1, lower(substring(html, 1, 2000)) FROM pages), c AS (SELECT conv_id, turn, {_COUNTS} FROM t) SELECT conv_id, turn, CASE WHEN {_BEST} = 0 THEN NULL " + " ".join(f"WHEN c_{k} = {_BEST} THEN '{k}'" for k in _TAGS) + " END AS tag FROM c")
def t14(spark: Spark, d: str) -> DataFrame:
    rows = _conversation(spark, d).select("conv_id", "turn", "text").unionByName(model.table(spark, d, "pages").select(F.col("page_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.col("html").alias("text")))
    return rows.select("conv_id", "turn", T.topic_tag(F.col("text")).alias("tag"))


@query("T15_emotion", f"{N}, c AS (SELECT id, lower(text) AS low, text FROM notes) SELECT id, round(greatest(-1.0, least(1.0, (" + " + ".join(f"CAST(contains(low, '{w.lower()}') AS INT)" for w in T.POSITIVE) + " - " + " - ".join(f"CAST(contains(low, '{w.lower()}') AS INT)" for w in T.NEGATIVE) + ") * 0.3)), 6) AS valence, least(1.0, (" + " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in T.AROUSING) + ") * 0.25) AS arousal FROM c")
def t15(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).withColumn("e", T.emotion(F.col("text"))).select("id", F.round("e.valence", 6).alias("valence"), F.col("e.arousal").alias("arousal"))


@query("T13_redact")
def t13(spark: Spark, d: str) -> DataFrame:
    """Every document; the rules need look-around, so a test holds them against plain patterns instead of SQL."""
    r = model.table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.regexp_count("r", F.lit(r"\[REDACTED:")).cast("long").alias("n"), F.sha2(F.col("r").cast("binary"), 256).alias("digest"))


_FIRST = "trim(regexp_extract(text, '^([^.!?。！？\\n]*[.!?。！？]?)', 1))"


@query("T16_anchor", f"{N}, f AS (SELECT id, length(text) AS n, {_FIRST} AS f FROM notes) SELECT id, CASE WHEN n <= 80 THEN NULL WHEN length(f) <= 80 THEN f WHEN regexp_matches(f, '{_HAN}') THEN substring(f, 1, 80) ELSE regexp_replace(substring(f, 1, 80), '\\s+\\S*$', '') END AS anchor FROM f")
def t16(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).select("id", T.anchor(F.col("text")).alias("anchor"))


def _stance_sql(k: int) -> str:
    return " + ".join(f"{1 << i} * CAST(regexp_matches(lower(text), '{pair[k]}') AS INT)" for i, pair in enumerate(T.OPPOSED))


@query("T18_contradiction", f"{N}, s AS (SELECT i, id, {_stance_sql(0)} AS n, {_stance_sql(1)} AS p, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 3) AS words FROM (SELECT i, id, CASE WHEN category = 'cases' THEN concat('It is not so: ', text) ELSE text END AS text FROM notes) c) SELECT a.id AS id, count(*) AS contradicted_by, min(b.i) AS first FROM s a JOIN s b ON a.i % 100 = 0 AND a.i <> b.i AND ((a.n & b.p) <> 0 OR (b.n & a.p) <> 0) AND list_has_any(a.words, b.words) GROUP BY a.id")
def t18(spark: Spark, d: str) -> DataFrame:
    """Every hundredth note against all that share a word with it; one row for each of them, no pairs."""
    said = F.when(F.col("category") == "cases", F.concat(F.lit("It is not so: "), "text")).otherwise(F.col("text"))
    stated = lambda n: n.where("text is not null").select("i", "id", T.stance(said).alias("stance"), F.transform(T.long_words(said), lambda w: F.xxhash64(w)).alias("words"))
    return overlap.contradicted(stated(notes(spark, d)), stated(notes(spark, d).where("i % 100 = 0")))


@query("T20_canonical_key", f"{N} SELECT id, substring(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[''\"`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS key FROM notes")
def t20(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).select("id", T.canonical_key(F.col("text")).alias("key"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(c) - 1, 2)), lambda k: substring(c, k, 3)))"


@query("T21_similarity", f"{N}, c AS (SELECT id, scope, i, regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g') AS c FROM notes), g AS (SELECT id, scope, i, {_GRAMS} AS g FROM c WHERE length(c) > 0) SELECT id, sim FROM (SELECT a.id AS id, round(max(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE), 6) AS sim FROM g a JOIN g b ON a.i % 100 = 0 AND a.scope = b.scope AND a.i <> b.i GROUP BY a.id) x")
def t21(spark: Spark, d: str) -> DataFrame:
    """Whole texts: how like every hundredth note the likest other one of its scope is."""
    rows = notes(spark, d).select("id", "scope", "i", T.compact(F.col("text")).alias("text")).where(F.length("text") > 0)
    return overlap.likest(rows, rows.where("i % 100 = 0")).select("id", F.round("sim", 6).alias("sim"))


@query("T23_scope_suggestion", f"{N}, s AS (SELECT DISTINCT scope_root AS scope FROM notes) SELECT scope, CASE WHEN scope = 'srcc1' THEN 0.0 WHEN starts_with(scope, 'srcc1') OR starts_with('srcc1', scope) THEN 0.5 ELSE levenshtein(scope, 'srcc1')::DOUBLE END AS rank FROM s WHERE levenshtein(scope, 'srcc1') <= 2")
def t23(spark: Spark, d: str) -> DataFrame:
    known = notes(spark, d).select(F.col("scope_root").alias("scope")).distinct()
    return known.withColumn("rank", T.scope_suggestion(F.col("scope"), "srcc1")).where("rank is not null")


@query("T29_token_estimate", f"{N} SELECT id, CAST(ceil(length(text) * 0.25) AS BIGINT) AS n FROM notes")
def t29(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).select("id", T.token_estimate(F.col("text")).alias("n"))


@query("T24_normalise", "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda x: upper(substring(x, 1, 1)) || substring(x, 2)), 'string_agg', ' ') AS entity FROM part")
def t24(spark: Spark, d: str) -> DataFrame:
    return model.table(spark, d, "part").select("p_partkey", T.normal_entity(F.concat(F.lit(' "'), F.regexp_replace("p_name", " ", "  "), F.lit('" '))).alias("entity"))


@query("B9_language", f"{N} SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS lang, count(*) AS n FROM notes GROUP BY 1")
def b9(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).groupBy(T.language_mix(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


@query("B10_words", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents) x WHERE w NOT IN ({_STOP}) GROUP BY w ORDER BY n DESC, w LIMIT 40")
def b10(spark: Spark, d: str) -> DataFrame:
    words = model.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word"))
    return words.where(~F.col("word").isin(T.STOP_EN)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(40)


_NAMES = "regexp_extract_all(text, '[A-Za-z0-9_\\x{00c0}-\\x{024f}]+')"


@query("A5_entity_mentions", f"SELECT w AS entity, count(*) AS n FROM (SELECT unnest({_NAMES}) AS w FROM documents) x WHERE regexp_matches(w, '^[A-Z][a-z]{{5,}}$') GROUP BY w ORDER BY n DESC, length(w) DESC, w LIMIT 25")
def a5(spark: Spark, d: str) -> DataFrame:
    e = model.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_\x{00c0}-\x{024f}]+)"), F.lit(1))).alias("entity"))
    return e.where(F.col("entity").rlike("^[A-Z][a-z]{5,}$")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.length("entity").desc(), "entity").limit(25)


# --- K: search ---------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(m.vector, q.vector)"


@query("K1_knn", f"{M} SELECT m.id, round(1 / (2 - {_COS}), 6) AS score FROM memories m, (SELECT vector FROM memories WHERE id = '0') q WHERE m.scope LIKE 'src1%' OR m.scope LIKE 'src2%' ORDER BY 1 / (2 - {_COS}) DESC, m.id LIMIT 20")
def k1(spark: Spark, d: str) -> DataFrame:
    return search.knn(memories(spark, d), _vector(spark, d), 20, where=T.scope_predicate(F.col("scope"), ["src1", "src2"])).select("id", F.round("score", 6).alias("score"))


_BATCH = f"SELECT q.id AS query_id, m.id AS id, {_COS} AS cos FROM memories m, (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 100 = 0) q WHERE m.id <> q.id"


@query("K1_knn_batch", f"{M} SELECT query_id, id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM ({_BATCH}) b) r WHERE rank <= 10")
def k1b(spark: Spark, d: str) -> DataFrame:
    return search.knn_batch(memories(spark, d), _query_vectors(spark, d), 10).select("query_id", "id", F.round("cos", 6).alias("cos"), "rank")


@query("K12_skills", f"{M} SELECT query_id, id, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM (SELECT b.* FROM ({_BATCH}) b JOIN memories c ON c.id = b.id WHERE c.category = 'patterns') p) r WHERE rank <= 5")
def k12(spark: Spark, d: str) -> DataFrame:
    return search.knn_batch(memories(spark, d).where("category = 'patterns'"), _query_vectors(spark, d), 5).select("query_id", "id", F.round("cos", 6).alias("cos"))


def _channels(spark: Spark, d: str) -> list[DataFrame]:
    m = memories(spark, d)
    ch = lambda k, c: m.where(f"i % {k} = 0").select((F.col("i") % 4).cast("string").alias("query_id"), "id", F.col(c).alias("score"))
    return [ch(2, "importance"), ch(3, "confidence"), ch(5, "arousal")]


_CH = "SELECT CAST(i % 4 AS VARCHAR) AS query_id, id, CASE WHEN i % 2 = 0 THEN importance END AS v, CASE WHEN i % 3 = 0 THEN confidence END AS b, CASE WHEN i % 5 = 0 THEN arousal END AS g FROM memories WHERE i % 2 = 0 OR i % 3 = 0 OR i % 5 = 0"
_FUSED = "greatest(0.0, least(1.0, CASE WHEN v IS NOT NULL AND b IS NOT NULL THEN (0.7 * v + 0.3 * b) / 1.0 * 1.05 + coalesce(g, 0) * 0.15 WHEN v IS NOT NULL THEN v + coalesce(g, 0) * 0.15 WHEN g IS NOT NULL THEN g + CASE WHEN coalesce(b, 0) > 0 THEN 0.10 ELSE 0 END ELSE b END))"


@query("K4_fusion", f"{M} SELECT query_id, id, round({_FUSED}, 5) AS score FROM ({_CH}) c")
def k4(spark: Spark, d: str) -> DataFrame:
    return search.fuse(*_channels(spark, d)).select("query_id", "id", F.round("score", 5).alias("score"))


@query("J2_full_outer", f"{M} SELECT query_id, id, CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END + CASE WHEN g IS NULL THEN 0 ELSE 4 END AS channels FROM ({_CH}) c")
def j2(spark: Spark, d: str) -> DataFrame:
    f = search.fuse(*_channels(spark, d))
    return f.select("query_id", "id", (F.col("v").isNotNull().cast("long") + 2 * F.col("b").isNotNull().cast("long") + 4 * F.col("g").isNotNull().cast("long")).alias("channels"))


@query("K5_supplement", f"{M}, c AS ({_CH}), n AS (SELECT query_id, id, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS rn FROM c WHERE b IS NOT NULL AND v IS NULL), u AS (SELECT query_id, id, score, 0 AS part FROM n WHERE rn <= 3 UNION ALL SELECT query_id, id, v, 1 FROM c WHERE v IS NOT NULL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, score DESC, id) AS position FROM u")
def k5(spark: Spark, d: str) -> DataFrame:
    v, b, _ = _channels(spark, d)
    return search.supplement(v, b).select("query_id", "id", "position")


@query("K6_merge", f"{M} SELECT query_id, id, round(greatest(coalesce(v, 0), coalesce(b, 0), coalesce(g, 0)), 6) AS score FROM ({_CH}) c")
def k6(spark: Spark, d: str) -> DataFrame:
    return search.merge_by_max(*_channels(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


@query("K7_zero_hits", f"{N} SELECT scope AS query_id, id FROM (SELECT scope, id, importance, max(CASE WHEN importance >= 0.99 THEN 1 ELSE 0 END) OVER (PARTITION BY scope) AS any_hit FROM notes) x WHERE importance >= 0.99 OR any_hit = 0")
def k7(spark: Spark, d: str) -> DataFrame:
    return selecting.zero_hit_fallback(notes(spark, d).withColumn("query_id", F.col("scope")), F.col("importance") >= 0.99).select("query_id", "id")


def _chain() -> str:
    """The shared stages as nested selects, one for each."""
    from tidewell.queries import scoring as q

    clamp = "greatest(0.0, least(1.0, {}))".format
    stages = [
        clamp(f"s + exp(-{q._AGE} / 14) * 0.1"),
        clamp("s * (0.5 + 0.5 * importance)"),
        clamp("s * (0.5 + 0.5 * confidence)"),
        clamp("s * CASE layer WHEN 'durable' THEN 1.01 WHEN 'evidence' THEN 0.99 ELSE 1.0 END"),
        clamp("s / (1 + 0.5 * log2(greatest(length(text) / 800.0::DOUBLE, 1.0)))"),
        f"CASE WHEN {q._EXEMPT} THEN s ELSE {clamp(f's * {q._WEIBULL}')} END",
        clamp(f"s * 0.9 + 0.1 * CASE WHEN {q._EXEMPT} THEN 1.0 ELSE {q._DECAY} END"),
        f"CASE WHEN evo_access_count > 0 THEN {clamp('s * (1 + least(0.15, 0.03 * log2(1 + evo_access_count)))')} ELSE s END",
    ]
    sql = f"SELECT r.query_id, {clamp('1 / (2 - r.cos)')} AS s, m.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM (SELECT b.* FROM ({_BATCH}) b JOIN memories a ON a.id = b.id WHERE a.status IN ('active', 'pending_review')) c) r JOIN memories m ON m.id = r.id WHERE r.rank <= 20"
    for stage in stages:
        sql = f"SELECT * REPLACE ({stage} AS s) FROM ({sql}) x"
    return f"{M} SELECT query_id, id, position, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS position FROM ({sql}) y) z WHERE position <= 10"


@query("K9_vector_pipeline", _chain())
def k9(spark: Spark, d: str) -> DataFrame:
    out = retrieval.vector_pipeline(memories(spark, d), _query_vectors(spark, d), retrieval.PROFILES["default"], NOW)
    return out.select("query_id", "id", "position", F.round("score", 6).alias("score"))


@query("K14_auto_recall", f"{N} SELECT query_id, id, round(s, 6) AS score FROM (SELECT scope AS query_id, id, i, s, row_number() OVER (PARTITION BY scope ORDER BY s DESC, id) AS rn FROM (SELECT *, importance * CASE WHEN tier = 'peripheral' THEN 0.85 ELSE 1.0 END AS s FROM notes) x) y WHERE rn <= 5")
def k14(spark: Spark, d: str) -> DataFrame:
    s = F.col("importance") * F.when(F.col("tier") == "peripheral", 0.85).otherwise(1.0)
    df = notes(spark, d).withColumn("query_id", F.col("scope")).withColumn("score", s)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return df.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("query_id", "id", F.round("score", 6).alias("score"))


@query("K13_related_scopes", f"{M} SELECT relation, id FROM (SELECT 'own' AS relation, m.id, row_number() OVER (ORDER BY {_COS} DESC, m.id) AS rn FROM memories m, (SELECT vector FROM memories WHERE id = '0') q WHERE m.scope LIKE 'src1:%' UNION ALL SELECT 'related', m.id, row_number() OVER (ORDER BY {_COS} DESC, m.id) FROM memories m, (SELECT vector FROM memories WHERE id = '0') q WHERE m.scope LIKE 'src2:%') r WHERE rn <= 5")
def k13(spark: Spark, d: str) -> DataFrame:
    v = _vector(spark, d)
    part = lambda tag, root: search.knn(memories(spark, d), v, 5, where=F.col("scope").startswith(root + ":")).select(F.lit(tag).alias("relation"), "id")
    return part("own", "src1").unionByName(part("related", "src2"))


@query("K15_resume", f"{N} SELECT category AS section, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY importance DESC, i) AS rn FROM notes WHERE status = 'active') x WHERE rn <= 4")
def k15(spark: Spark, d: str) -> DataFrame:
    w = W.partitionBy("category").orderBy(F.col("importance").desc(), "i")
    return notes(spark, d).where("status = 'active'").withColumn("rn", F.row_number().over(w)).where("rn <= 4").select(F.col("category").alias("section"), "id")


@query("O1_top", f"{N} SELECT id, round(importance, 6) AS score FROM notes ORDER BY importance DESC, id LIMIT 20")
def o1(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).orderBy(F.col("importance").desc(), "id").limit(20).select("id", F.round("importance", 6).alias("score"))


# --- D: selection ------------------------------------------------------------------------------------


def _ranked(spark: Spark, d: str) -> DataFrame:
    """A list for each topic: as a search would return it."""
    w = W.partitionBy("topic").orderBy(F.col("importance").desc(), "id")
    return memories(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 20").withColumns({"query_id": F.col("topic").cast("string"), "score": F.col("importance")})


#: The lists with their rows' earlier near ones, for loops as recursion.
_LISTS = f"""t AS (SELECT *, CAST(topic AS VARCHAR) AS query_id, importance AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, id) AS rn FROM memories) x WHERE rn <= 20),
near AS (SELECT m.query_id, m.rn, list(q.rn) AS earlier FROM t q JOIN t m ON q.query_id = m.query_id AND q.rn < m.rn AND {_COS} > 0.3 GROUP BY m.query_id, m.rn)"""


@query(
    "D1_mmr",
    f"""{M.replace('WITH', 'WITH RECURSIVE')}, {_LISTS}, c AS (SELECT query_id, 0::BIGINT AS rn, []::BIGINT[] AS taken FROM (SELECT DISTINCT query_id FROM t) x
      UNION ALL SELECT c.query_id, c.rn + 1, CASE WHEN n.earlier IS NOT NULL AND list_has_any(n.earlier, c.taken) THEN c.taken ELSE list_append(c.taken, c.rn + 1) END FROM c JOIN t ON t.query_id = c.query_id AND t.rn = c.rn + 1 LEFT JOIN near n ON n.query_id = c.query_id AND n.rn = c.rn + 1),
    l AS (SELECT query_id, arg_max(taken, rn) AS taken FROM c GROUP BY query_id)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY list_contains(taken, rn) DESC, rn) AS position FROM t JOIN l USING (query_id)""",
)
def d1(spark: Spark, d: str) -> DataFrame:
    return selecting.mmr(_ranked(spark, d), 0.3)


@query(
    "D2_interference",
    f"""{M.replace('WITH', 'WITH RECURSIVE')}, {_LISTS}, c AS (SELECT query_id, 0::BIGINT AS rn, []::BIGINT[] AS kept, []::BIGINT[] AS cids, []::BIGINT[] AS late FROM (SELECT DISTINCT query_id FROM t) x
      UNION ALL SELECT query_id, rn, CASE WHEN fate = 'keep' THEN list_append(kept, rn) ELSE kept END, CASE WHEN fate = 'keep' THEN list_append(cids, coalesce(cid, rn)) ELSE cids END, CASE WHEN fate = 'late' THEN list_append(late, rn) ELSE late END
      FROM (SELECT *, CASE WHEN m IS NULL THEN 'keep' WHEN score < best * 0.8 THEN 'drop' WHEN len(list_filter(cids, lambda x: x = cid)) >= 3 THEN 'late' ELSE 'keep' END AS fate
        FROM (SELECT w.*, cids[list_position(kept, m)] AS cid, b.score AS best FROM (SELECT c.query_id, c.rn + 1 AS rn, c.kept, c.cids, c.late, t.score, list_min(list_intersect(n.earlier, c.kept)) AS m FROM c JOIN t ON t.query_id = c.query_id AND t.rn = c.rn + 1 LEFT JOIN near n ON n.query_id = c.query_id AND n.rn = c.rn + 1) w LEFT JOIN t b ON b.query_id = w.query_id AND b.rn = w.m) y) z),
    l AS (SELECT query_id, max(rn) AS n, arg_max(kept, rn) AS kept, arg_max(late, rn) AS late FROM c GROUP BY query_id)
    SELECT query_id, id, CASE WHEN n > 2 AND list_contains(late, rn) THEN score * 0.5 ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 2 AND list_contains(late, rn) THEN 1 ELSE 0 END, rn) AS position FROM t JOIN l USING (query_id) WHERE n <= 2 OR list_contains(kept, rn) OR list_contains(late, rn)""",
)
def d2(spark: Spark, d: str) -> DataFrame:
    return selecting.interference(_ranked(spark, d), 0.3)


@query("D3_versions", f"{N} SELECT id FROM notes WHERE version_group IS NULL UNION ALL SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY version_group ORDER BY confidence DESC, i) AS rn FROM notes WHERE version_group IS NOT NULL) x WHERE rn = 1")
def d3(spark: Spark, d: str) -> DataFrame:
    return selecting.best_version(notes(spark, d), "version_group", "confidence", [F.col("i")]).select("id")


@query("D4_covered", f"{N} SELECT id FROM notes WHERE i NOT IN (SELECT i + 1 FROM notes WHERE i % 50 = 0) AND i NOT IN (SELECT i + 2 FROM notes WHERE i % 50 = 0)")
def d4(spark: Spark, d: str) -> DataFrame:
    ins = notes(spark, d).where("i % 50 = 0").select("id", F.array((F.col("i") + 1).cast("string"), (F.col("i") + 2).cast("string")).alias("source_memories"))
    return selecting.drop_covered(notes(spark, d), ins).select("id")


@query("D5_diversity", f"{N} SELECT query_id, id, position FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 AND f >= 3 AND rn > 1 THEN 1 ELSE 0 END, importance DESC, id) AS position FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS f FROM (SELECT category AS query_id, id, importance, row_number() OVER (PARTITION BY category, scope ORDER BY importance DESC, id) AS rn FROM notes) a) b) c WHERE position <= 10")
def d5(spark: Spark, d: str) -> DataFrame:
    df = notes(spark, d).withColumns({"query_id": F.col("category"), "score": F.col("importance")})
    return selecting.source_diversity(df, 10).select("query_id", "id", "position")


@query("D6_governor", f"{N} SELECT query_id, id, position FROM (SELECT category AS query_id, id, row_number() OVER (PARTITION BY category ORDER BY importance DESC, id) AS position, sum(length(text)) OVER (PARTITION BY category ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS chars FROM notes WHERE status IN ('active', 'pending_review') AND i % 4 <> 0) x WHERE (chars <= 8000 OR position = 1) AND position <= 10")
def d6(spark: Spark, d: str) -> DataFrame:
    df = notes(spark, d).withColumns({"query_id": F.col("category"), "score": F.col("importance")})
    return selecting.govern(df, notes(spark, d).where("i % 4 = 0")).select("query_id", "id", "position")


@query(
    "D7_collapse",
    f"""WITH RECURSIVE notes AS ({model.NOTES_SQL}), t AS (SELECT scope AS query_id, id, importance AS score, CAST(ceil(length(text) * 0.25) AS BIGINT) AS f, CAST(ceil(length(l1_overview) * 0.25) AS BIGINT) AS m, CAST(ceil(length(l0_abstract) * 0.25) AS BIGINT) AS l, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, id) AS rn FROM notes),
    c AS (SELECT query_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::VARCHAR AS level FROM (SELECT DISTINCT query_id FROM t) x
      UNION ALL SELECT query_id, rn, used + CASE level WHEN 'L2' THEN f WHEN 'L1' THEN m WHEN 'L0' THEN l ELSE 0 END, level FROM (SELECT c.query_id, c.rn + 1 AS rn, c.used, t.f, t.m, t.l, CASE WHEN t.score >= 0.85 AND c.used + t.f <= 8000 THEN 'L2' WHEN t.score >= 0.65 AND c.used + t.m <= 8000 THEN 'L1' WHEN t.score >= 0.50 AND c.used + t.l <= 8000 THEN 'L0' ELSE 'drop' END AS level FROM c JOIN t ON t.query_id = c.query_id AND t.rn = c.rn + 1) y)
    SELECT t.query_id, t.id, c.level FROM c JOIN t ON t.query_id = c.query_id AND t.rn = c.rn""",
)
def d7(spark: Spark, d: str) -> DataFrame:
    df = notes(spark, d).select(F.col("scope").alias("query_id"), "id", F.col("importance").alias("score"), T.token_estimate(F.col("text")).alias("full"), T.token_estimate(F.col("l1_overview")).alias("middle"), T.token_estimate(F.col("l0_abstract")).alias("least"))
    return selecting.collapse_to_budget(df)


@query("D9_dedup_decision", f"{M} SELECT id, CASE WHEN s >= 0.92 THEN 'hard' WHEN s >= 0.78 THEN 'llm' ELSE 'unique' END AS decision FROM (SELECT b.id AS id, max(1 / (2 - b.cos)) AS s FROM ({_BATCH}) b GROUP BY b.id) x")
def d9(spark: Spark, d: str) -> DataFrame:
    near = search.nearest_query(memories(spark, d), _query_vectors(spark, d))
    return near.select("id", selecting.dedup_decision(F.col("cos"), F.lit(False), F.lit(False)).alias("decision"))


@query("D10_exact", f"{N} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY i) AS rn FROM notes) x WHERE rn = 1")
def d10(spark: Spark, d: str) -> DataFrame:
    return selecting.exact_dedup(notes(spark, d), [F.col("i")]).select("id")


@query("D11_ordered_merge", f"{N}, l AS (SELECT category AS query_id, id, 0 AS part, row_number() OVER (PARTITION BY category ORDER BY importance DESC, i) AS position FROM notes UNION ALL SELECT category, id, 1, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, i) FROM notes WHERE i % 2 = 0), p AS (SELECT * FROM l WHERE position <= 10), f AS (SELECT query_id, id, min(part * 1000 + position) AS first_at FROM p GROUP BY query_id, id) SELECT query_id, id, place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first_at, id) AS place FROM f) r WHERE place <= 15")
def d11(spark: Spark, d: str) -> DataFrame:
    def part(df: DataFrame, c: str) -> DataFrame:
        w = W.partitionBy("category").orderBy(F.col(c).desc(), "i")
        return df.withColumn("position", F.row_number().over(w)).where("position <= 10").select(F.col("category").alias("query_id"), "id", "position")

    return selecting.ordered_merge([part(notes(spark, d), "importance"), part(notes(spark, d).where("i % 2 = 0"), "confidence")], 15).select("query_id", "id", "place")


@query("D12_nodes", f"{N} SELECT id FROM (SELECT id, category, CASE WHEN superseded_by IS NOT NULL THEN 0 ELSE 1 END AS l, row_number() OVER (PARTITION BY superseded_by IS NOT NULL, category ORDER BY importance DESC, id) AS turn FROM notes) x ORDER BY l, turn, category, id LIMIT 150")
def d12(spark: Spark, d: str) -> DataFrame:
    return selecting.diverse_nodes(notes(spark, d), notes(spark, d).where("superseded_by is not null"), 150).select("id")


@query("D13_preferences", f"{M} SELECT id, CASE WHEN s >= 0.92 THEN 'skip' WHEN s >= 0.78 THEN 'merge' ELSE 'create' END AS action FROM (SELECT m.id, 1 / (2 - {_COS}) AS s FROM memories m, (SELECT vector FROM memories WHERE id = '1') q WHERE m.category = 'preferences') x")
def d13(spark: Spark, d: str) -> DataFrame:
    q = F.array(*(F.lit(x) for x in _vector(spark, d, 1)))
    return memories(spark, d).where("category = 'preferences'").select("id", selecting.preference_action(V.cosine("vector", q)).alias("action"))


# --- J, G: pairs, graph, lifecycle -------------------------------------------------------------------


@query("J1_pairs", f"{M}, p AS (SELECT m.id AS a, q.id AS b FROM memories m JOIN memories q ON m.category = q.category AND m.id < q.id WHERE {_COS} >= 0.35) SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) u GROUP BY id")
def j1(spark: Spark, d: str) -> DataFrame:
    return lifecycle.similar_links(memories(spark, d), 0.35, ["category"])


@query("J11_bridges", f"{M} SELECT m.id AS a, q.id AS b FROM memories m JOIN memories q ON m.topic = q.topic AND m.id < q.id AND m.scope <> q.scope WHERE {_COS} >= 0.3 ORDER BY round({_COS}, 9) DESC, m.id, q.id LIMIT 30")
def j11(spark: Spark, d: str) -> DataFrame:
    return lifecycle.best_pairs(memories(spark, d), 0.3, ["topic"], 30, differ="scope").select("a", "b")


_BAND = 90_000_000  # microseconds


@query("J15_band_join", "SELECT a.event_id AS a, count(DISTINCT b.user_id % 5) AS scopes, min_by(b.event_id, (abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id)) AS nearest FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id % 5 <> b.user_id % 5 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 90000000 GROUP BY a.event_id HAVING count(DISTINCT b.user_id % 5) = 1")
def j15(spark: Spark, d: str) -> DataFrame:
    """A band join without pairs: of each scope only the last event up to a time and the first from then on can be the nearest.

    A time falls in a cell of ten bands, and an event near its edge goes to the next one too, so all that
    an event meets is in its own cell's task, which passes over its rows once forwards and once backwards.
    """
    e = model.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 5).alias("scope"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cell = lambda us: us - F.pmod(us, F.lit(10 * _BAND))
    dealt = e.where("event_type is not null and scope is not null and us is not null").withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("us") - _BAND), cell(F.col("us") + _BAND)))))
    w, scopes = W.partitionBy("cell", "event_type"), range(-4, 5)  # remainders keep their sign
    # Of equal times the smaller id: its complement is the greater one.
    last = [F.max(F.when(F.col("scope") == v, F.struct("us", F.bitwise_not("event_id").alias("id")))).over(w.orderBy("us").rangeBetween(W.unboundedPreceding, W.currentRow)) for v in scopes]
    first = [F.min(F.when(F.col("scope") == v, F.struct("us", F.col("event_id").alias("id")))).over(w.orderBy(F.desc("us")).rangeBetween(W.unboundedPreceding, W.currentRow)) for v in scopes]

    def met(df: DataFrame, side: str, found: list[Column], event: Callable[[Column], Column]) -> DataFrame:
        """Adds the least and greatest scope met on one side, and (gap, id) of the nearest event."""
        df = df.select("*", *(c.alias(f"s{i}") for i, c in enumerate(found)))
        gap = [F.abs(F.col("us") - F.col(f"s{i}.us")) for i in range(len(scopes))]
        of = lambda value: [F.when((F.col("scope") != v) & (gap[i] <= _BAND), value(i, v)) for i, v in enumerate(scopes)]
        near = F.least(*of(lambda i, v: F.struct(gap[i].alias("gap"), event(F.col(f"s{i}.id")).alias("id"))))
        new = {f"low{side}": F.least(*of(lambda i, v: F.lit(v))), f"high{side}": F.greatest(*of(lambda i, v: F.lit(v))), f"near{side}": near}
        return df.withColumns(new).drop(*(f"s{i}" for i in range(len(scopes))))

    both = met(met(dealt, "_before", last, F.bitwise_not), "_after", first, lambda c: c).where(F.col("cell") == cell(F.col("us")))
    low, high = F.least("low_before", "low_after"), F.greatest("high_before", "high_after")
    seen = both.where(low.isNotNull()).select(F.col("event_id").alias("a"), low.alias("low"), high.alias("high"), F.when(low == high, F.least("near_before", "near_after")).alias("near"))
    g = seen.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("near")["id"].alias("nearest"))
    return g.where("low = high").select("a", F.lit(1).cast("long").alias("scopes"), "nearest")


def _edge(spark: Spark, d: str) -> DataFrame:
    return graph.edges(triples(spark, d))


_E = f"{TR}, o AS (SELECT subject, predicate, object, max(confidence) * CASE predicate WHEN 'lives_in' THEN 0.70 WHEN 'located_in' THEN 0.70 ELSE 0.60 END AS w FROM triples GROUP BY subject, predicate, object), e AS (SELECT subject AS src, object AS dst, w FROM o UNION ALL SELECT object, subject, w FROM o)"


@query("G1_edges", f"{_E} SELECT src, dst, round(w, 6) AS w FROM e")
def g1(spark: Spark, d: str) -> DataFrame:
    return _edge(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


def _seeds(spark: Spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "entity string")


@query("G2_neighbourhood", f"{_E}, h1 AS (SELECT DISTINCT dst AS entity FROM e WHERE src IN ('s1', 'c2')), h2 AS (SELECT DISTINCT dst AS entity FROM e WHERE src IN (SELECT entity FROM h1)), u AS (SELECT 's1' AS entity, 0 AS hop UNION ALL SELECT 'c2', 0 UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2) SELECT entity, min(hop) AS hop FROM u GROUP BY entity")
def g2(spark: Spark, d: str) -> DataFrame:
    return graph.neighbourhood(_edge(spark, d), _seeds(spark, "s1", "c2"), 2).select("entity", "hop")


_PR = f"{_E}, f AS (SELECT e.src, e.dst, e.w / t.total AS p FROM e JOIN (SELECT src, sum(w) AS total FROM e GROUP BY src) t USING (src)), p0 AS (SELECT 's1' AS entity, 0.5::DOUBLE AS s UNION ALL SELECT 'c2', 0.5)"
for _k in range(1, 11):
    _PR += f", p{_k} AS (SELECT entity, sum(s) AS s FROM (SELECT f.dst AS entity, p{_k - 1}.s * f.p * 0.85 AS s FROM p{_k - 1} JOIN f ON f.src = p{_k - 1}.entity UNION ALL SELECT entity, s * 0.15 FROM p0) u GROUP BY entity)"


@query("G3_pagerank", f"{_PR} SELECT entity, round(s, 6) AS rank_score FROM p10 ORDER BY round(s, 9) DESC, entity LIMIT 20")
def g3(spark: Spark, d: str) -> DataFrame:
    ranks = graph.pagerank(_edge(spark, d), _seeds(spark, "s1", "c2"), tolerance=0.0)
    return ranks.orderBy(F.round("rank_score", 9).desc(), "entity").limit(20).select("entity", F.round("rank_score", 6).alias("rank_score"))


@query("K3_graph_search", f"{_PR}, x AS (SELECT t.source_memory_id AS id, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) * t.confidence AS s FROM triples t LEFT JOIN p10 a ON a.entity = t.subject LEFT JOIN p10 b ON b.entity = t.object) SELECT id, round(max(s), 6) AS score FROM x WHERE s > 0 GROUP BY id ORDER BY round(max(s), 9) DESC, id LIMIT 20")
def k3(spark: Spark, d: str) -> DataFrame:
    ranks = graph.pagerank(_edge(spark, d), _seeds(spark, "s1", "c2"), tolerance=0.0)
    return search.graph_scores(triples(spark, d), ranks).select("id", F.round("score", 6).alias("score"))


@query("G4_paths", f"{_E}, h1 AS (SELECT dst AS entity, min(['s1', dst]) AS path FROM e WHERE src = 's1' GROUP BY dst), h2 AS (SELECT e.dst AS entity, min(list_append(h1.path, e.dst)) AS path FROM e JOIN h1 ON e.src = h1.entity WHERE e.dst <> 's1' AND e.dst NOT IN (SELECT entity FROM h1) GROUP BY e.dst) SELECT entity, array_to_string(path, '>') AS path FROM h1 UNION ALL SELECT entity, array_to_string(path, '>') FROM h2 UNION ALL SELECT 's1', 's1'")
def g4(spark: Spark, d: str) -> DataFrame:
    return graph.neighbourhood(_edge(spark, d), _seeds(spark, "s1"), 2).select("entity", F.array_join("path", ">").alias("path"))


@query("G5_chain", f"WITH RECURSIVE notes AS ({model.NOTES_SQL}), c(start_id, id, depth) AS (SELECT id, id, 0 FROM notes UNION ALL SELECT c.start_id, n.superseded_by, c.depth + 1 FROM c JOIN notes n ON n.id = c.id WHERE n.superseded_by IS NOT NULL AND c.depth < 10) SELECT start_id, id, depth FROM c")
def g5(spark: Spark, d: str) -> DataFrame:
    n = notes(spark, d)
    return graph.chain(n.select("id", "superseded_by"), n).select(F.col("start").alias("start_id"), "id", "depth")


_LINKED = "SELECT a.id AS a, b.id AS b FROM notes a JOIN notes b ON a.canonical_key = b.canonical_key AND a.i < b.i"


@query("G6_components", f"{N} SELECT id, min(CAST(id AS BIGINT)) OVER (PARTITION BY canonical_key) AS root FROM notes WHERE canonical_key IN (SELECT canonical_key FROM notes GROUP BY canonical_key HAVING count(*) > 1)")
def g6(spark: Spark, d: str) -> DataFrame:
    n = notes(spark, d).select("i", "canonical_key")
    # Each note and the first of its key: one round, and no key is sorted in one task.
    first = n.groupBy("canonical_key").agg(F.min("i").alias("b"))
    linked = n.join(first.hint("merge"), "canonical_key").where("i <> b")
    return graph.components(linked.select(F.col("i").alias("a"), "b")).select(F.col("id").cast("string").alias("id"), "root")


@query("G8_canonical", f"{N}, g AS (SELECT id, i, canonical_key, round(importance * (1 + ln(1 + evo_access_count)), 9) AS s FROM notes WHERE canonical_key IN (SELECT canonical_key FROM notes GROUP BY canonical_key HAVING count(*) > 1)) SELECT id, first_value(id) OVER (PARTITION BY canonical_key ORDER BY s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS canonical FROM g")
def g8(spark: Spark, d: str) -> DataFrame:
    n = notes(spark, d)
    many = n.groupBy("canonical_key").agg(F.count("*").alias("c")).where("c > 1")
    pairs = n.join(many, "canonical_key").select("id", F.col("canonical_key").alias("root"))
    return lifecycle.canonical_members(pairs, n).select("id", "canonical")


_GC = f"(0.2 * pow(0.5, greatest(0.0, ({NOW + 60 * DAY} - coalesce(valid_from, ts)) / 86400000.0::DOUBLE) / 90) + 0.3 * least(1.0, log2(1 + evo_access_count) * CASE WHEN last_accessed_at IS NULL THEN 0.5 ELSE pow(0.5, greatest(0.0, ({NOW + 60 * DAY} - last_accessed_at) / 86400000.0::DOUBLE) / 30) END) + 0.5 * importance) * CASE WHEN valid_until < {NOW + 60 * DAY} THEN 0.5 ELSE 1.0 END"


@query("G11_gc", f"{N} SELECT id, scope, round({_GC}, 6) AS decay, 'decay' AS reason FROM notes WHERE status IN ('active', 'pending_review') AND importance < 0.95 AND {_GC} < 0.3 ORDER BY round({_GC}, 9), id LIMIT 100")
def g11(spark: Spark, d: str) -> DataFrame:
    return lifecycle.collect_garbage(notes(spark, d), NOW + 60 * DAY, threshold=0.3).withColumn("decay", F.round("decay", 6))


_NEAR = f"SELECT b.query_id, b.id, 1 / (2 - b.cos) AS score, m.importance, m.tier, m.status, m.ts FROM ({_BATCH}) b JOIN memories m ON m.id = b.id"


def _near(spark: Spark, d: str, near: DataFrame) -> DataFrame:
    return near.withColumn("score", V.score_of_cosine(F.col("cos"))).join(memories(spark, d).drop("vector"), "id")


@query("G13_cascade", f"{M} SELECT query_id, id, round(ni, 6) AS new_importance, CASE WHEN tier = 'working' AND ni < 0.5 THEN 'peripheral' WHEN tier = 'core' AND ni < 0.8 THEN 'working' ELSE tier END AS new_tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (SELECT *, greatest(importance - 0.3 * (score - 0.55) / 0.45, 0.05) AS ni FROM ({_NEAR}) n WHERE score >= 0.55 AND status IN ('active', 'pending_review')) x WHERE abs(ni - importance) >= 0.01) y WHERE rn <= 10")
def g13(spark: Spark, d: str) -> DataFrame:
    return lifecycle.cascade(_near(spark, d, search.within(memories(spark, d), _query_vectors(spark, d), V.cosine_of_score(0.55) - 1e-9)), 0.55).withColumn("new_importance", F.round("new_importance", 6))


@query("G15_retroactive", f"{M} SELECT query_id, id, round(least(importance + 0.15, 0.75), 6) AS new_importance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM ({_NEAR}) n WHERE importance < 0.6 AND ({NOW} - ts) / 86400000.0::DOUBLE >= 1) x WHERE rn <= 5")
def g15(spark: Spark, d: str) -> DataFrame:
    old = memories(spark, d).where((F.col("importance") < 0.6) & (S.age_days(F.col("ts"), NOW) >= 1))  # what can be lifted; ranked after that
    near = _near(spark, d, search.knn_batch(old, _query_vectors(spark, d), 5)).withColumn("query_importance", F.lit(0.9))
    return lifecycle.retroactive_boost(near, NOW).withColumn("new_importance", F.round("new_importance", 6))


@query("G17_supersede", f"{N}, o AS (SELECT id, 1 AS version, category AS text, ts AS valid_from, NULL::BIGINT AS valid_until, i FROM notes), c AS (SELECT id, CASE WHEN i % 2 = 0 THEN 'changed' ELSE category END AS text FROM notes WHERE i % 5 = 0) SELECT o.id, o.version, o.text, o.valid_from, CASE WHEN c.text IS NOT NULL AND c.text <> o.text THEN {NOW} END AS valid_until FROM o LEFT JOIN c USING (id) UNION ALL SELECT o.id, 2, c.text, {NOW}, NULL FROM o JOIN c USING (id) WHERE c.text <> o.text")
def g17(spark: Spark, d: str) -> DataFrame:
    n = notes(spark, d)
    old = n.select("id", F.lit(1).cast("long").alias("version"), F.col("category").alias("text"), F.col("ts").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"))
    changes = n.where("i % 5 = 0").select("id", F.when(F.col("i") % 2 == 0, "changed").otherwise(F.col("category")).alias("text"))
    return lifecycle.supersede(old, changes, NOW)


@query("G18_disposition", f"{N} SELECT id, CASE WHEN k IS NULL THEN 'append' WHEN same THEN 'duplicate' WHEN category IN ('events', 'cases') THEN 'append' WHEN category IN ('profile', 'preferences') AND i % 2 = 0 THEN 'latest_wins' ELSE 'conflict' END AS disposition FROM (SELECT n.*, p.k, coalesce(n.text = p.t, false) AS same FROM notes n LEFT JOIN (SELECT canonical_key AS k, min_by(text, i) AS t FROM notes WHERE i % 2 = 0 GROUP BY canonical_key) p ON n.canonical_key = p.k WHERE n.i % 2 = 1 OR n.i % 10 = 0) x")
def g18(spark: Spark, d: str) -> DataFrame:
    n = notes(spark, d)
    old = n.where("i % 2 = 0").groupBy(F.col("canonical_key").alias("k")).agg(F.min_by("text", "i").alias("t"))
    x = n.where("i % 2 = 1 or i % 10 = 0").join(old, F.col("canonical_key") == F.col("k"), "left")
    return x.select("id", lifecycle.write_disposition(F.col("category"), F.col("k").isNotNull(), F.coalesce(F.col("text") == F.col("t"), F.lit(False)), F.col("i") % 2 == 0).alias("disposition"))


@query("G24_reminders", f"{N} SELECT id FROM notes WHERE (valid_until IS NULL OR valid_until >= {NOW}) AND language IN ('en', 'fr') AND scope_root IN ('src1', 'src2')")
def g24(spark: Spark, d: str) -> DataFrame:
    r = notes(spark, d).select("id", F.concat_ws(" ", "scope_root", "language").alias("trigger"), F.col("valid_until").alias("expires_at"))
    return lifecycle.triggered(r, "on src1 or src2, en and fr alike", NOW).where(~F.col("trigger").rlike("^src1[0-9]")).select("id")


@query("G30_checkpoints", f"{N} SELECT id, CASE WHEN rich AND rr <= 5 THEN 'keep' WHEN sr = 1 AND age <= 2 THEN 'keep' WHEN NOT rich AND age > 7 THEN 'delete' WHEN rich AND age > 30 THEN 'archive' ELSE 'keep' END AS fate FROM (SELECT id, rich, ({NOW} - ts) / 86400000.0::DOUBLE AS age, row_number() OVER (PARTITION BY scope, rich ORDER BY ts DESC, id) AS rr, row_number() OVER (PARTITION BY canonical_key ORDER BY ts DESC, id) AS sr FROM (SELECT *, access_count > 5 AS rich FROM notes) n) x")
def g30(spark: Spark, d: str) -> DataFrame:
    r = notes(spark, d).select("id", "scope", F.col("canonical_key").alias("session_id"), F.col("ts").alias("at_ms"), (F.col("access_count") > 5).alias("rich"))
    return lifecycle.checkpoint_fate(r, NOW).select("id", "fate")


@query("A9_cluster_stats", f"{M} SELECT count(*) AS clusters, round(avg(n), 6) AS mean_size, sum(CASE WHEN n > 3 THEN n - 3 ELSE 0 END) AS high_risk FROM (SELECT topic, count(*) AS n FROM memories GROUP BY topic) c")
def a9(spark: Spark, d: str) -> DataFrame:
    c = memories(spark, d).groupBy("topic").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 6).alias("mean_size"), F.sum(F.greatest(F.col("n") - 3, F.lit(0))).alias("high_risk"))


@query("A19_read_evidence", "SELECT event_id % 100 AS id, count(*) AS reads, count(DISTINCT user_id) AS readers, round(least(0.99, 0.5 + least(1.0, count(DISTINCT user_id) / 4.0::DOUBLE) * 0.15), 6) AS boosted FROM events GROUP BY event_id % 100")
def a19(spark: Spark, d: str) -> DataFrame:
    e = model.table(spark, d, "events").groupBy((F.col("event_id") % 100).alias("id")).agg(F.count("*").alias("reads"), F.count_distinct("user_id").alias("readers"))
    return e.withColumn("boosted", F.round(S.read_boost(F.lit(0.5), F.col("readers")), 6))


@query("A20_cluster_similarity", f"{M} SELECT m.topic AS topic, round(avg({_COS}), 6) AS mean FROM memories m JOIN memories q ON m.topic = q.topic AND m.id < q.id GROUP BY m.topic")
def a20(spark: Spark, d: str) -> DataFrame:
    """Mean over pairs without the pairs: the square of the sum of unit vectors holds every product."""
    u = memories(spark, d).select("topic", F.posexplode(V.unit("vector")).alias("pos", "x"))
    per = u.groupBy("topic", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    t = per.groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n > 1")
    return t.select("topic", F.round((F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean"))


@query("A25_centroid", f"{M} SELECT topic, pos - 1 AS pos, round(avg(x), 5) AS x FROM (SELECT topic, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM memories) u GROUP BY topic, pos")
def a25(spark: Spark, d: str) -> DataFrame:
    c = lifecycle.usable_centroid(memories(spark, d), "topic")
    return c.select("topic", F.posexplode("centroid").alias("pos", "x")).select("topic", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("A27_eval", f"{M} SELECT round(sum(CASE WHEN rank = 1 AND hit THEN 1 ELSE 0 END) / count(DISTINCT query_id)::DOUBLE, 6) AS hit1, round(sum(CASE WHEN hit THEN 1 ELSE 0 END) / (10 * count(DISTINCT query_id))::DOUBLE, 6) AS precision10 FROM (SELECT r.query_id, r.rank, m.topic = e.label AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM ({_BATCH}) b) r JOIN memories m ON m.id = r.id JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = r.query_id WHERE rank <= 10) x")
def a27(spark: Spark, d: str) -> DataFrame:
    near = search.knn_batch(memories(spark, d), _query_vectors(spark, d), 10)
    truth = model.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "label")
    j = near.join(memories(spark, d).select("id", "topic"), "id").join(truth, "query_id").withColumn("hit", F.col("topic") == F.col("label"))
    n = F.count_distinct("query_id")
    return j.agg(F.round(F.sum(((F.col("rank") == 1) & F.col("hit")).cast("int")) / n, 6).alias("hit1"), F.round(F.sum(F.col("hit").cast("int")) / (10 * n), 6).alias("precision10"))


@query("G25_lint", f"{M}, p AS (SELECT m.id AS a, q.id AS b FROM memories m JOIN memories q ON m.scope = q.scope AND m.category = q.category AND m.id < q.id WHERE {_COS} >= 0.3) SELECT 'duplicate' AS check_name, id FROM (SELECT a AS id FROM p UNION SELECT b FROM p) u UNION ALL SELECT 'stale', id FROM memories WHERE ({NOW} - ts) / 86400000.0::DOUBLE > 20 AND evo_access_count <= 1 AND (last_accessed_at IS NULL OR ({NOW} - last_accessed_at) / 86400000.0::DOUBLE > 20) UNION ALL SELECT 'orphan', m.id FROM memories m WHERE m.consolidated_into IS NOT NULL AND m.consolidated_into NOT IN (SELECT id FROM memories) UNION ALL SELECT 'cold', id FROM memories WHERE access_count >= 6 AND evo_access_count <= 0")
def g25(spark: Spark, d: str) -> DataFrame:
    m = memories(spark, d)
    tag = lambda name, df: df.select(F.lit(name).alias("check_name"), "id")
    dup = lifecycle.similar_links(m, 0.3, ["scope", "category"])
    old = lambda c: (F.lit(NOW) - F.col(c)) / float(DAY) > 20
    stale = m.where(old("ts") & (F.col("evo_access_count") <= 1) & (F.col("last_accessed_at").isNull() | old("last_accessed_at")))
    orphan = m.where("consolidated_into is not null").join(m.select(F.col("id").alias("t")), F.col("consolidated_into") == F.col("t"), "left_anti")
    return tag("duplicate", dup).unionByName(tag("stale", stale)).unionByName(tag("orphan", orphan)).unionByName(tag("cold", m.where("access_count >= 6 and evo_access_count <= 0")))


def _features(spark: Spark, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return memories(spark, d).select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))


@query("B19_kmeans")
def b19(spark: Spark, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return KMeans(k=8, seed=1).fit(_features(spark, d)).transform(_features(spark, d)).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query("B20_pca")
def b20(spark: Spark, d: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    f = _features(spark, d)
    out = PCA(k=2, inputCol="features", outputCol="p").fit(f).transform(f).withColumn("p", vector_to_array("p"))
    return out.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


# --- X, W: resume rankers and windows ----------------------------------------------------------------

_CUES = "CAST(contains(text, 'token') AS INT) + CAST(contains(text, 'License') AS INT) + CAST(contains(text, 'the') AS INT)"


@query("X1_task_score", f"{N} SELECT id, round(5.0 * CAST(scope_root = 'src1' AS INT) + CASE layer WHEN 'durable' THEN 4 WHEN 'evidence' THEN -4 ELSE 0 END + 2 * CAST(category IN ('cases', 'patterns') AS INT) + 3 * CAST(authority = 'structured' AS INT) + 1.5 * least(3, {_CUES}), 6) AS score FROM (SELECT * REPLACE (coalesce(authority, '') AS authority) FROM notes) n")
def x1(spark: Spark, d: str) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    cues = sum((F.col("text").contains(w).cast("int") for w in ("token", "License", "the")), F.lit(0))
    layer = F.when(F.col("layer") == "durable", 4).when(F.col("layer") == "evidence", -4).otherwise(0)
    score = 5.0 * flag(F.col("scope_root") == "src1") + layer + 2 * flag(F.col("category").isin("cases", "patterns")) + 3 * flag(F.col("authority") == "structured") + 1.5 * F.least(F.lit(3), cues)
    return notes(spark, d).select("id", F.round(score, 6).alias("score"))


@query("X4_group_max", f"{N} SELECT scope, id FROM (SELECT scope, id, access_count, max(access_count) OVER (PARTITION BY scope) AS most FROM notes) x WHERE access_count = most")
def x4(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).withColumn("most", F.max("access_count").over(W.partitionBy("scope"))).where("access_count = most").select("scope", "id")


@query("X6_stable", f"{N} SELECT id FROM (SELECT id, i, s, row_number() OVER (PARTITION BY canonical_key ORDER BY s DESC, i) AS rn FROM (SELECT *, importance + 2 * CAST(tier = 'core' AS INT) + 2 * CAST(layer = 'durable' AS INT) + CAST(access_count > 5 AS INT) AS s FROM (SELECT * REPLACE (coalesce(tier, '') AS tier, coalesce(layer, '') AS layer) FROM notes) n WHERE category IN ('profile', 'preferences', 'entities')) a) b WHERE rn = 1 ORDER BY round(s, 9) DESC, i LIMIT 30")
def x6(spark: Spark, d: str) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    s = F.col("importance") + 2 * flag(F.col("tier") == "core") + 2 * flag(F.col("layer") == "durable") + flag(F.col("access_count") > 5)
    n = notes(spark, d).where(F.col("category").isin("profile", "preferences", "entities")).withColumn("s", s)
    one = n.withColumn("rn", F.row_number().over(W.partitionBy("canonical_key").orderBy(F.col("s").desc(), "i"))).where("rn = 1")
    return one.orderBy(F.round("s", 9).desc(), "i").limit(30).select("id")


@query("X9_light_resume", f"{N} SELECT id FROM (SELECT id, sum(n) OVER (ORDER BY importance DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT id, i, importance, CAST(ceil(length(anchor) * 0.25) AS BIGINT) AS n FROM notes WHERE status = 'active' AND category = 'cases' ORDER BY importance DESC, i LIMIT 100) t) x WHERE used <= 300")
def x9(spark: Spark, d: str) -> DataFrame:
    top = notes(spark, d).where("status = 'active' and category = 'cases'").orderBy(F.col("importance").desc(), "i").limit(100).withColumn("n", T.token_estimate(F.col("anchor")))
    w = W.orderBy(F.col("importance").desc(), "i").rowsBetween(W.unboundedPreceding, 0)  # over the 100 rows of a report
    return top.withColumn("used", F.sum("n").over(w)).where("used <= 300").select("id")


@query("W5_turn_pairs", "SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) x WHERE role = 'user' AND next_role = 'assistant'")
def w5(spark: Spark, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    c = _conversation(spark, d).withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w)})
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "next_turn")


@query("W6_line_boundaries", "SELECT conv_id, turn, len(string_split(text, chr(10))) AS lines FROM conversations")
def w6(spark: Spark, d: str) -> DataFrame:
    return _conversation(spark, d).select("conv_id", "turn", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query("W7_write_rate", "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS n FROM events) x WHERE n > 0")
def w7(spark: Spark, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, -1)
    return model.table(spark, d, "events").withColumn("us", us).withColumn("n", F.count("*").over(w)).where("n > 0").select("event_id", "n")


@query("W9_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def w9(spark: Spark, d: str) -> DataFrame:
    return store.last_of_each(model.table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("seq")), "user_id").select("user_id", "event_id")


@query("O5_sample", f"{N} SELECT id FROM notes ORDER BY md5(id), id LIMIT 200")
def o5(spark: Spark, d: str) -> DataFrame:
    return notes(spark, d).orderBy(F.md5(F.col("id").cast("binary")), "id").limit(200).select("id")


@query("T9_chunks")
def t9(spark: Spark, d: str) -> DataFrame:
    from tidewell.functions.chunking import chunk_column

    return model.table(spark, d, "documents").select("doc_id", F.posexplode(chunk_column("text")).alias("position", "chunk")).select("doc_id", "position", F.length("chunk").alias("n"))


@query("S19_dialogue", "SELECT conv_id AS file, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def s19(spark: Spark, d: str) -> DataFrame:
    from tidewell.sources import readers

    c = _conversation(spark, d).where("role in ('user', 'assistant')").withColumn("line", F.concat("role", F.lit(": "), F.regexp_replace("text", "(?i)(^|\n)(user|human|me|assistant|ai|bot)\\s*[:：]", "$1-")))
    raw = c.groupBy(F.col("conv_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return readers.plain_dialogue(raw).groupBy("file").agg(F.count("*").alias("turns"))
