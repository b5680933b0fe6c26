"""The data model: schemas, defaults, and the model's tables derived from a star schema and text tables.

A *memory* is one row of text with a vector, a scope, a category and a lifecycle record.
Metadata arrives as a JSON string and is parsed once (`parse_metadata`) into flat columns;
malformed JSON yields the defaults.  Every operator takes `now` explicitly, in epoch
milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000
#: 2024-02-01 00:00:00 UTC, the harness's fixed clock.
NOW = 1_706_745_600_000
CATEGORIES = ("profile", "preferences", "entities", "events", "cases", "patterns")
TRANSCRIPT_SCOPES = ("cc:", "codex:", "gemini:", "kimi:", "antigravity:", "minis:")
DURABLE_SCOPES = ("memory:", "asset:")

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("category", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("fts_text", T.StringType()),
    ]
)
#: Columns that later versions of the table added, and what older rows get for them.
ADDED_COLUMNS = {"language": "'en'", "fts_text": "text"}

TRIPLE_SCHEMA = "id string, scope string, subject string, predicate string, object string, confidence double, source_memory_id string, source_text string, timestamp long, mention_count int, first_seen long, source_memory_ids array<string>"

_EVOLUTION = "struct<status:string,version:int,accessCount:int,lastAccessedAt:bigint,supersededBy:string,supersedes:string,evolutionNote:string,consolidatedInto:string,contributedToPattern:string,sourceMemories:array<string>,validFrom:bigint,validUntil:bigint,eventTime:bigint>"
METADATA_SCHEMA = (
    f"struct<evolution:{_EVOLUTION},accessCount:int,lastAccessedAt:bigint,readerIds:array<string>,tier:string,confidence:string,"
    "boundary:struct<layer:string,authority:string,canonicalKey:string>,emotion:struct<valence:double,arousal:double,salience:double>,"
    "topicTag:string,anchor:string,l0_abstract:string,l1_overview:string,tags:array<string>,version_group:string,version_rank:double,archived:boolean>"
)


def evolve(df: DataFrame) -> DataFrame:
    """Additive migration: columns of the schema that `df` lacks, with their defaults; existing nulls get them too."""
    for f in MEMORY_SCHEMA:
        default = F.expr(ADDED_COLUMNS.get(f.name, "null")).cast(f.dataType)
        df = df.withColumn(f.name, F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default)
    return df.select(*MEMORY_SCHEMA.names)


def confidence_of(raw: Column) -> Column:
    """A confidence given as a number or as an object with a score; 0.7 where it is neither."""
    return F.coalesce(raw.try_cast("double"), F.try_variant_get(F.try_parse_json(raw), "$.score", "double"), F.lit(0.7))


def parse_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """`df` with the metadata's flat columns, parsed once; null or malformed JSON gives the defaults."""
    m = F.from_json(F.col(column), METADATA_SCHEMA, {"mode": "PERMISSIVE"})
    df = df.withColumn("__m", m)
    e = F.col("__m.evolution")
    return df.select(
        *[c for c in df.columns if c != "__m"],
        F.coalesce(e["status"], F.lit("active")).alias("status"),
        F.coalesce(e["version"], F.lit(1)).alias("version"),
        F.coalesce(e["accessCount"], F.lit(0)).alias("evo_access_count"),
        e["lastAccessedAt"].alias("evo_last_accessed_at"),
        e["supersedes"].alias("supersedes"),
        e["supersededBy"].alias("superseded_by"),
        e["consolidatedInto"].alias("consolidated_into"),
        e["sourceMemories"].alias("source_memories"),
        e["validFrom"].alias("valid_from"),
        e["validUntil"].alias("valid_until"),
        e["eventTime"].alias("event_time"),
        F.coalesce("__m.accessCount", F.lit(0)).alias("access_count"),
        F.col("__m.lastAccessedAt").alias("last_accessed_at"),
        F.col("__m.readerIds").alias("reader_ids"),
        F.col("__m.tier").alias("tier"),
        confidence_of(F.col("__m.confidence")).alias("confidence"),
        F.col("__m.boundary.layer").alias("layer"),
        F.col("__m.boundary.authority").alias("authority"),
        F.col("__m.boundary.canonicalKey").alias("canonical_key"),
        F.col("__m.emotion.valence").alias("valence"),
        F.col("__m.emotion.arousal").alias("arousal"),
        F.col("__m.topicTag").alias("topic_tag"),
        F.col("__m.anchor").alias("anchor"),
        F.col("__m.l0_abstract").alias("l0_abstract"),
        F.col("__m.l1_overview").alias("l1_overview"),
        F.coalesce("__m.tags", F.array().cast("array<string>")).alias("tags"),
        F.col("__m.version_group").alias("version_group"),
        F.col("__m.version_rank").alias("version_rank"),
        F.coalesce("__m.archived", F.lit(False)).alias("archived"),
    )


# --- The model's tables from the generic test tables -------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same select list runs on Spark and on the oracle engine; i is the document's number.
MEMORY_SELECT = """
  CAST(d.doc_id AS BIGINT) AS i, CAST(d.doc_id AS STRING) AS id, d.text AS text, concat(d.source, ':', d.lang) AS scope, d.source AS scope_root, d.lang AS language,
  CASE d.doc_id % 6 WHEN 0 THEN 'profile' WHEN 1 THEN 'preferences' WHEN 2 THEN 'entities' WHEN 3 THEN 'events' WHEN 4 THEN 'cases' ELSE 'patterns' END AS category,
  CAST(0.3 AS DOUBLE) + CAST(0.7 AS DOUBLE) * ((d.doc_id * 37) % 100) / CAST(100 AS DOUBLE) AS importance,
  1704067200000 + ((d.doc_id * 7919) % 2592000) * 1000 AS ts,
  CAST((d.doc_id * 13) % 12 AS INT) AS access_count, CAST((d.doc_id * 7) % 9 AS INT) AS evo_access_count,
  CASE WHEN d.doc_id % 3 <> 0 THEN 1704067200000 + ((d.doc_id * 7919) % 2592000) * 1000 + (d.doc_id * 31 % 20) * 86400000 END AS last_accessed_at,
  CASE WHEN d.doc_id % 10 = 0 THEN 'archived' WHEN d.doc_id % 10 = 1 THEN 'pending_review' ELSE 'active' END AS status,
  CASE d.doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'working' WHEN 2 THEN 'peripheral' END AS tier,
  ((d.doc_id * 29) % 100) / CAST(100 AS DOUBLE) AS confidence,
  CASE WHEN d.doc_id % 5 = 0 THEN 1704067200000 + (d.doc_id * 977 % 40) * 86400000 END AS valid_from,
  CASE WHEN d.doc_id % 7 = 0 THEN 1704067200000 + (d.doc_id * 577 % 50) * 86400000 END AS valid_until,
  ((d.doc_id * 17) % 21 - 10) / CAST(10 AS DOUBLE) AS valence, ((d.doc_id * 11) % 11) / CAST(10 AS DOUBLE) AS arousal,
  CASE d.doc_id % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'evidence' END AS layer,
  CASE d.doc_id % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'transcript' WHEN 2 THEN 'manual' END AS authority,
  substring(d.text, 1, 60) AS anchor, substring(d.text, 1, 80) AS l0_abstract, substring(d.text, 1, 200) AS l1_overview,
  CASE WHEN d.doc_id % 8 = 0 THEN concat('g', CAST(d.doc_id % 40 AS STRING)) END AS version_group,
  CASE WHEN d.doc_id % 9 = 0 THEN CAST(d.doc_id + 9 AS STRING) END AS superseded_by,
  CASE WHEN d.doc_id % 11 = 0 THEN CAST((d.doc_id * 3) % 1500 AS STRING) END AS consolidated_into,
  lower(concat(d.lang, '/', substring(d.text, 1, 12))) AS canonical_key
"""
MEMORIES_SQL = f"SELECT {MEMORY_SELECT}, e.embedding AS vector, e.label AS topic FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"
NOTES_SQL = f"SELECT {MEMORY_SELECT} FROM documents d"
TRIPLES_SQL = """
  SELECT concat('s', CAST(s_suppkey AS STRING)) AS subject, 'located_in' AS predicate, concat('n', CAST(s_nationkey AS STRING)) AS object, ((s_suppkey * 31) % 60 + 40) / CAST(100 AS DOUBLE) AS confidence, CAST(s_suppkey % 200 AS STRING) AS source_memory_id FROM supplier
  UNION ALL
  SELECT concat('n', CAST(n_nationkey AS STRING)), 'part_of', concat('r', CAST(n_regionkey AS STRING)), ((n_nationkey * 7) % 50 + 50) / CAST(100 AS DOUBLE), CAST(n_nationkey AS STRING) FROM nation
  UNION ALL
  SELECT concat('c', CAST(c_custkey AS STRING)), 'lives_in', concat('n', CAST(c_nationkey AS STRING)), ((c_custkey * 13) % 70 + 30) / CAST(100 AS DOUBLE), CAST(c_custkey % 300 AS STRING) FROM customer
"""
OBSERVATIONS_SQL = """
  SELECT event_id AS observation_id, concat('w', CAST(user_id % 40 AS STRING)) AS workflow_id,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'corrected' ELSE 'success' END AS outcome,
    concat('s', CAST(user_id % 5 AS STRING)) AS scope, event_type AS source, CASE event_type WHEN 'error' THEN concat('sig', CAST(event_id % 7 AS STRING)) END AS signal,
    ts AS recorded_at, value FROM events
"""


def _views(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A DataFrame of `sql` over the named tables, without leaving views behind."""
    return spark.sql(_braced(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _braced(sql: str, names: tuple[str, ...]) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 {\2}", sql)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, MEMORIES_SQL, "documents", "embeddings")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories without vectors: every document."""
    return _views(spark, sf_dir, NOTES_SQL, "documents")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, TRIPLES_SQL, "supplier", "nation", "customer")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, OBSERVATIONS_SQL, "events")
