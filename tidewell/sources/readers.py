"""Sources: transcripts, markdown, notes, connector batches and chat exports, all to rows of (source, session_id, role, text, at).

Files are read by Spark's readers, so a path may be anything that Spark can open; parsing
is expressions over lines or whole documents.  Malformed lines give no row, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PART = "struct<type:string,text:string>"
_LINE = "struct<type:string,role:string,sessionId:string,session_id:string,timestamp:string,content:string,text:string,message:struct<role:string,content:string>,payload:struct<type:string,role:string,content:string>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def content_text(content: Column) -> Column:
    """The text of a message's content, given as a string or as a JSON list of typed parts."""
    parts = F.from_json(content, f"array<{_PART}>")
    texts = F.transform(F.filter(parts, lambda p: p["text"].isNotNull() & p["type"].isin("text", "input_text", "output_text")), lambda p: p["text"])
    return F.when(content.startswith("["), F.array_join(texts, "\n")).otherwise(content)


def transcripts(raw: DataFrame, kind: str) -> DataFrame:
    """User and assistant turns of JSON-lines transcripts.

    Kinds: `nested` (the message is an object), `payload` (it is in a payload), `flat`
    (role and content on the line) and `typed` (the line's type is the role).
    """
    j = raw.withColumn("j", F.from_json("value", _LINE, {"mode": "PERMISSIVE"}))
    role, content = {
        "nested": (F.coalesce("j.message.role", "j.type"), F.col("j.message.content")),
        "payload": (F.col("j.payload.role"), F.col("j.payload.content")),
        "flat": (F.col("j.role"), F.coalesce("j.content", "j.text")),
        "typed": (F.when(F.col("j.type") == "gemini", "assistant").otherwise(F.col("j.type")), F.coalesce("j.content", "j.text")),
    }[kind]
    out = j.select("file", F.coalesce("j.sessionId", "j.session_id", "file").alias("session_id"), role.alias("role"), F.trim(content_text(content)).alias("text"), F.try_to_timestamp("j.timestamp").alias("at"))
    return out.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """A document's parts between headings of level 1 to 3, in order; each keeps its heading."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,3} )")
    out = docs.select("file", F.posexplode(parts).alias("position", "text"))
    return out.withColumn("text", F.trim("text")).withColumn("heading", F.nullif(F.regexp_extract("text", r"^#{1,3} ([^\n]*)", 1), F.lit(""))).where(F.length("text") > 0)


def connector_records(raw: DataFrame) -> DataFrame:
    """Records of connector batches (version, source, scope, records[]), one JSON document for each row of `text`."""
    record = "struct<id:string,text:string,title:string,categoryHint:string,importanceHint:double,tags:array<string>,timestamp:string,contentHash:string>"
    j = F.from_json("text", f"struct<version:string,source:string,scope:string,batchId:string,producedAt:string,records:array<{record}>>")
    rows = raw.select(j.alias("j")).where(F.col("j.source").isNotNull() & F.col("j.scope").isNotNull())
    return rows.select("j.source", "j.scope", F.explode("j.records").alias("r")).select("source", "scope", "r.*").where(F.length(F.trim("text")) > 0)


def vault_notes(docs: DataFrame) -> DataFrame:
    """Notes with frontmatter, wiki links, folder tags and a content hash."""
    front = F.regexp_extract("text", r"^---\n([\s\S]*?)\n---", 1)
    body = F.trim(F.regexp_replace("text", r"^---\n[\s\S]*?\n---\n?", ""))
    pairs = F.regexp_extract_all(front, F.lit(r"(?m)^(\w[\w-]*:\s*.*)$"), F.lit(1))
    front_map = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w-]+):", 1), F.trim(F.regexp_replace(p, r"^[\w-]+:\s*", "")))))
    links = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))
    folders = F.slice(F.split(F.regexp_replace("file", r"^[a-z]+:/*", ""), "/"), -2, 1)
    return docs.select("file", front_map.alias("frontmatter"), body.alias("text"), links.alias("links"), folders.alias("folder_tags"), F.sha2(body.cast("binary"), 256).alias("content_hash"))


def detect_format(text: Column) -> Column:
    """Which export a document is."""
    head = F.substring(F.ltrim(text), 1, 4000)
    return (
        F.when(head.contains('"records"') & head.contains('"version"'), "connector")
        .when(head.contains('"mapping"') & head.contains('"message"'), "message_tree")
        .when(head.contains('"chat_messages"'), "chat_messages")
        .when(head.rlike(r'^\[\s*\{') & head.contains('"user"') & head.contains('"ts"'), "channel")
        .when(head.rlike(r'^\{.*"type"') & head.contains('"message"'), "transcript")
        .otherwise("plaintext")
    )


def chat_messages(raw: DataFrame) -> DataFrame:
    """Exports whose conversations hold a list of messages."""
    one = "struct<uuid:string,chat_messages:array<struct<sender:string,text:string,created_at:string>>>"
    rows = raw.select("file", F.explode(F.from_json("text", f"array<{one}>")).alias("c")).select("file", F.col("c.uuid").alias("session_id"), F.posexplode("c.chat_messages").alias("position", "m"))
    return rows.select("file", "session_id", "position", F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"), F.col("m.text").alias("text"), F.try_to_timestamp("m.created_at").alias("at")).where(F.length(F.trim("text")) > 0)


def message_tree(raw: DataFrame) -> DataFrame:
    """Exports whose messages are nodes of a tree; messages are put in order of time."""
    node = "struct<parent:string,message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>"
    rows = raw.select("file", F.explode(F.from_json("text", f"array<struct<id:string,mapping:map<string,{node}>>>")).alias("c"))
    nodes = rows.select("file", F.col("c.id").alias("session_id"), F.explode("c.mapping").alias("key", "n")).where(F.col("n.message").isNotNull())
    out = nodes.select("file", "session_id", F.col("n.message.author.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text"), F.timestamp_seconds("n.message.create_time").alias("at"))
    w = W.partitionBy("file", "session_id").orderBy("at", "text")
    return out.where(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) > 0)).withColumn("position", F.row_number().over(w) - 1)


def channel_messages(raw: DataFrame) -> DataFrame:
    """Channel exports, a list of (user, text, ts)."""
    rows = raw.select("file", F.explode(F.from_json("text", "array<struct<user:string,text:string,ts:string>>")).alias("m"))
    return rows.select("file", F.col("file").alias("session_id"), F.lit("user").alias("role"), F.concat_ws(": ", "m.user", "m.text").alias("text"), F.timestamp_seconds(F.col("m.ts").try_cast("double")).alias("at")).where(F.length(F.trim("m.text")) > 0)


def plain_dialogue(raw: DataFrame) -> DataFrame:
    """Plain text in which a line that starts with a speaker opens a turn and the lines after it continue it."""
    rows = raw.select("file", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    mark = r"(?i)^(user|human|me|assistant|ai|bot)\s*[:：]\s*"
    opens = F.col("value").rlike(mark)
    turn = F.sum(opens.cast("int")).over(W.partitionBy("file").orderBy("line"))
    speaker = F.lower(F.regexp_extract("value", mark, 1))
    numbered = rows.withColumn("position", turn).where("position > 0").withColumn("speaker", F.when(opens, speaker)).withColumn("value", F.regexp_replace("value", mark, ""))
    g = numbered.groupBy("file", "position").agg(F.max("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    return g.select("file", "position", F.when(F.col("speaker").isin("assistant", "ai", "bot"), "assistant").otherwise("user").alias("role"), F.trim(F.array_join(F.transform("l", lambda x: x["value"]), "\n")).alias("text"))


def audit_entries(raw: DataFrame) -> DataFrame:
    """The entries of an append-only log of JSON lines; lines that do not parse are left out."""
    j = F.from_json("value", "struct<at:string,action:string,id:string,actor:string>")
    return raw.select(j.alias("j")).select("j.*").where(F.col("action").isNotNull())


def append_audit(entries: DataFrame, path: str) -> None:
    entries.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
