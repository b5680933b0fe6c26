"""Mail, log lines and feed items as connector records; S22: memories as files for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a connector record, as `readers.connector_records` returns them.
RECORD = ["source", "scope", "id", "text", "title", "categoryHint", "importanceHint", "tags", "timestamp", "contentHash"]


def _records(df: DataFrame, source: str, scope: Column, **columns: Column) -> DataFrame:
    out = df.select(F.lit(source).alias("source"), scope.alias("scope"), *(c.alias(n) for n, c in columns.items()))
    return out.where(F.length(F.trim("text")) > 0).select(*RECORD)


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def mail_records(mails: DataFrame, scope: str = "inbox:personal", category: str = "events", importance: float = 0.6) -> DataFrame:
    """Mails (message_id, subject, body, sender, sent_at) as records; without a text there is none."""
    return _records(
        mails, "email", F.lit(scope),
        id=F.concat(F.lit("email:"), "message_id"), text=F.col("body"), title=F.col("subject"), categoryHint=F.lit(category), importanceHint=F.lit(importance),
        tags=F.array(F.lit("email"), F.concat(F.lit("from:"), "sender")), timestamp=F.col("sent_at"), contentHash=_sha(F.col("body")),
    )


# The form of a log line (time, level, module, message) and the importance of its level.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}T[\d:.]+Z?)\s+\[(\w+)\]\s+(?:(\w+):\s+)?(.+)$"
LEVELS = {"error": 0.9, "warn": 0.7, "info": 0.5}


def log_records(lines: DataFrame, scope: str = "ops:app", skip: tuple[str, ...] = ("debug",)) -> DataFrame:
    """Log lines (value) as records; lines of another form and of skipped levels are left out."""
    part = lambda k: F.regexp_extract("value", LOG_LINE, k)
    rows = lines.where(F.col("value").rlike(LOG_LINE)).select("value", part(1).alias("at"), F.lower(part(2)).alias("level"), F.nullif(part(3), F.lit("")).alias("module"), part(4).alias("message"))
    weight = F.lit(0.3)
    for level, importance in LEVELS.items():
        weight = F.when(F.col("level") == level, importance).otherwise(weight)
    return _records(
        rows.where(~F.col("level").isin(*skip)), "logs", F.lit(scope),
        id=F.concat(F.lit("log:"), F.md5(F.col("value").cast("binary"))), text=F.col("message"),
        title=F.concat(F.lit("["), F.upper("level"), F.lit("] "), "module"), categoryHint=F.when(F.col("level") == "error", "cases").otherwise("events"), importanceHint=weight,
        tags=F.array_compact(F.array(F.lit("log"), "level", F.concat(F.lit("module:"), "module"))), timestamp=F.col("at"), contentHash=_sha(F.col("value")),
    )


def feed_records(items: DataFrame, category: str = "knowledge", importance: float = 0.6) -> DataFrame:
    """Feed items (scope, guid, title, content, link, published, categories) as records; the link stands in for a missing guid."""
    key = F.coalesce(F.nullif(F.col("guid"), F.lit("")), F.col("link"))
    return _records(
        items, "rss", F.col("scope"),
        id=F.concat(F.lit("rss:"), F.md5(key.cast("binary"))), text=F.col("content"), title=F.col("title"), categoryHint=F.lit(category), importanceHint=F.lit(importance),
        tags=F.concat(F.array(F.lit("rss")), F.coalesce("categories", F.array().cast("array<string>")), F.array(F.concat(F.lit("link:"), "link"))),
        timestamp=F.col("published"), contentHash=_sha(F.col("content")),
    )


# --- S22 ---------------------------------------------------------------------------------------------

DUMPED = ["id", "text", "category", "scope", "importance", "timestamp"]


def recent(notes: DataFrame, now: int, days: int = 7, most: int = 200) -> DataFrame:
    """The newest `most` memories of the last `days` days (id, text, category, scope, importance, timestamp in ms)."""
    return notes.where(F.col("timestamp") >= now - days * 86_400_000).orderBy(F.desc("timestamp"), "id").limit(most).select(*DUMPED)


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document for each row, in `value`."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_markdown(rows: DataFrame) -> DataFrame:
    """(scope, timestamp, id, value): a section for each memory; sorted by the first three columns this is a document by scope and time."""
    scope = F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("<missing>"))
    head = F.concat(F.lit("### ["), F.coalesce("category", F.lit("other")), F.lit("] "), F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd"))
    return rows.select(scope.alias("scope"), "timestamp", "id", F.concat_ws("\n\n", head, "text", F.lit("---\n")).alias("value"))


def brief(hits: DataFrame, query: str, profile: str, created: str, summary: str) -> DataFrame:
    """(n, value): the parts of a Markdown brief of a search's hits (rank, id, scope, score, timestamp, text), the head as part 0."""
    n = hits.count()
    head = f"# Memory Export\n\n- Query: {query}\n- Profile: {profile}\n- Created: {created}\n- Hits: {n}\n\n## Distilled Brief\n\n{summary}\n\n## Evidence\n"
    title = F.substring(F.regexp_replace(F.col("text"), r"\s+", " "), 1, 72)
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), title), F.lit(""), F.concat(F.lit("- Memory ID: "), "id"), F.concat(F.lit("- Scope: "), "scope"),
        F.concat(F.lit("- Score: "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%")), F.concat(F.lit("- Date: "), F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(""), "text", F.lit(""),
    )
    first = hits.sparkSession.createDataFrame([(0, head)], "n int, value string")
    return first.unionByName(hits.select(F.col("rank").cast("int").alias("n"), lines.alias("value")))


def write_lines(parts: DataFrame, path: str, by: list[str]) -> None:
    """Write `value` as text files; read in the order of their names they are sorted by `by`."""
    parts.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("errorifexists").text(path)
