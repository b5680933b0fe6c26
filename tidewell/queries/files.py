"""Queries of the file readers: the test tables are written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.operators.graph import shared_path
from tidewell.queries import query
from tidewell.queries.memory import _conversation
from tidewell.sources import readers

Spark = SparkSession


def _written(values: DataFrame) -> str:
    """Lines of text, as files in the shared folder."""
    path = f"{shared_path(values.sparkSession)}/files/{uuid.uuid4().hex}"
    values.write.text(path)
    return path


@query("S14_transcripts", "SELECT CAST(conv_id AS VARCHAR) AS session_id, role, md5(trim(text)) AS digest, 1704067200 + turn AS at_s FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0")
def s14(spark: Spark, d: str) -> DataFrame:
    """Each conversation in one of the four kinds; some messages as lists of typed parts; a line that is no JSON after each kind."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.to_json(F.array(part("tool_use", F.lit("x")), part("text", F.col("text"))))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    said = _conversation(spark, d).withColumn("content", F.when(F.col("turn") % 3 == 0, parts).otherwise(F.col("text"))).withColumn("timestamp", at).withColumn("sessionId", F.col("conv_id").cast("string"))
    message = F.struct("role", "content")
    lines = {
        "nested": F.struct("sessionId", "timestamp", message.alias("message")),
        "payload": F.struct("sessionId", "timestamp", message.alias("payload")),
        "flat": F.struct(F.col("sessionId").alias("session_id"), "timestamp", "role", "content"),
        "typed": F.struct("sessionId", "timestamp", F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")).alias("type"), "content"),
    }
    out = None
    for k, (kind, line) in enumerate(lines.items()):
        values = said.where(F.col("conv_id") % 4 == k).select(F.to_json(line).alias("value"))
        rows = readers.transcripts(readers.lines(spark, _written(values.union(spark.range(1).select(F.lit('{"role": "user", "text": "cut o'))))), kind)
        out = rows if out is None else out.unionByName(rows)
    return out.select("session_id", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.unix_seconds("at").alias("at_s"))


@query(
    "S15_sections",
    """WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || '## Part' || chr(10)), chr(10) || '## Part' || chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
    SELECT doc_id, CAST(k - 1 AS INT) AS position, CASE WHEN k = 1 THEN 'Top' ELSE 'Part' END AS heading, md5(trim(CASE WHEN k = 1 THEN '# Top' ELSE '## Part' END || chr(10) || t, ' ')) AS digest FROM p""",
)
def s15(spark: Spark, d: str) -> DataFrame:
    """Documents with a heading before each line."""
    docs = model.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("# Top\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n"))).alias("text"))
    return readers.markdown_sections(docs).select(F.col("file").alias("doc_id"), (F.col("position") - 1).alias("position"), "heading", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("S18_vault", "SELECT doc_id, lang AS language, CAST(doc_id % 7 AS VARCHAR) AS level, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Other,' END, 'Note ', doc_id) AS links, source AS folder, sha256(trim(concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[[Other|x]] ' END, text, ' [[Note ', doc_id, '#part]] [[Note ', doc_id, ']]'), ' ')) AS content_hash FROM documents")
def s18(spark: Spark, d: str) -> DataFrame:
    """Documents as notes with frontmatter and links."""
    t = model.table(spark, d, "documents")
    text = F.expr("concat('---\nlang: ', lang, '\nlevel:  ', doc_id % 7, '\n---\n', if(doc_id % 3 = 0, '', '[[Other|x]] '), text, ' [[Note ', doc_id, '#part]] [[Note ', doc_id, ']]')")
    read = readers.vault_notes(t.select(F.expr("concat('file:/vault/', source, '/', doc_id, '.md')").alias("file"), text.alias("text")))
    front = F.col("frontmatter")
    return read.select(F.regexp_extract("file", r"(\d+)\.md$", 1).cast("long").alias("doc_id"), front["lang"].alias("language"), front["level"].alias("level"), F.array_join("links", ",").alias("links"), F.col("folder_tags")[0].alias("folder"), "content_hash")


@query("S24_audit", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS action, concat('u', user_id) AS actor FROM events WHERE event_type IS NOT NULL")
def s24(spark: Spark, d: str) -> DataFrame:
    """Events appended to a log in two goes, and read back; a line that is no JSON in between."""
    entries = model.table(spark, d, "events").select(F.col("ts").cast("string").alias("at"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("id"), F.expr("concat('u', user_id)").alias("actor"))
    path = _written(spark.range(1).select(F.lit("{").alias("value")))
    readers.append_audit(entries.where("action <> 'error'"), path)
    readers.append_audit(entries.where("NOT coalesce(action <> 'error', false)"), path)
    return readers.audit_entries(readers.lines(spark, path)).select("id", "action", "actor")
