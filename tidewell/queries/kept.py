"""What is kept between batches: the inverted index, and a table that a stream brings up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.operators.graph import shared_path
from tidewell.operators.text_index import TextIndex
from tidewell.queries import query
from tidewell.queries.memory import _TOKENS
from tidewell.streaming import ingest

Spark = SparkSession


def bm25_sql(docs: str, queries: str) -> str:
    """CTEs up to rk (query_id, id, raw, rank): BM25 of docs (id, text) for queries (query_id, query)."""
    return f"""tok AS (SELECT id, {_TOKENS} AS t FROM ({docs}) d), ix AS (SELECT id, len(t) AS len, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) u GROUP BY id, len(t), term), st AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT id, len FROM ix) l),
    df AS (SELECT term, count(*) AS df FROM ix GROUP BY term), qq AS (SELECT DISTINCT query_id, unnest({_TOKENS.replace('text', 'query')}) AS term FROM ({queries}) q),
    sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS raw FROM ix JOIN qq USING (term) JOIN df USING (term), st GROUP BY query_id, id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM sc)"""


_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"
QUERIES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS query_id, substring(text, 1, 60) AS query FROM documents WHERE doc_id % 100 = 0"
_OUT = "SELECT query_id, id, rank, round(raw, 6) AS raw, round(1 / (1 + exp(-raw / 5)), 6) AS score FROM rk WHERE rank <= 20"


def text_queries(spark: Spark, d: str) -> DataFrame:
    """The queries of a text search: the beginning of every document whose id is divisible by 100."""
    return model.table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.substring("text", 1, 60).alias("query"))


def documents_index(spark: Spark, d: str) -> TextIndex:
    index = TextIndex(spark, f"{shared_path(spark)}/index/{uuid.uuid4().hex}")
    index.apply(0, model.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    return index


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "rank", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query("K2_bm25", f"WITH {bm25_sql(_DOCS, QUERIES_SQL)} {_OUT}")
def k2(spark: Spark, d: str) -> DataFrame:
    return _rounded(documents_index(spark, d).search(text_queries(spark, d)))


_CHANGED = "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 3 THEN concat('replaced license words ', substring(text, 30, 200)) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5"


@query("S1_kept_index", f"WITH {bm25_sql(_CHANGED, QUERIES_SQL)} {_OUT}")
def s1(spark: Spark, d: str) -> DataFrame:
    """An index in four batches: half the documents, the others, upserts of some, deletions of some; merged, with a batch that comes twice."""
    docs = model.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    index = TextIndex(spark, f"{shared_path(spark)}/index/{uuid.uuid4().hex}", most_segments=3)
    index.apply(0, docs.where("doc_id % 2 = 0").select("id", "text"))
    index.apply(1, docs.where("doc_id % 2 = 1").select("id", "text"))
    new = F.concat(F.lit("replaced license words "), F.substring("text", 30, 200))
    index.apply(2, docs.where("doc_id % 7 = 3").select("id", new.alias("text")))
    index.apply(2, docs.select("id", F.lit("never seen").alias("text")))
    index.apply(3, None, docs.where("doc_id % 11 = 5").select("id"))
    return _rounded(index.search(text_queries(spark, d)))


_BATCHES = 3


@query("R8_ingest", "SELECT id, max(seq) AS seq, arg_max(text, seq) AS text FROM (SELECT CAST(doc_id % 400 AS VARCHAR) AS id, doc_id * 3 + 1 AS seq, md5(text) AS text FROM documents) x GROUP BY id")
def r8(spark: Spark, d: str) -> DataFrame:
    """Documents as versions of 400 rows, in three batches of files; the stream fails after the second batch and starts again."""
    where = f"{shared_path(spark)}/ingest/{uuid.uuid4().hex}"
    rows = model.table(spark, d, "documents").select((F.col("doc_id") % 400).cast("string").alias("id"), (F.col("doc_id") * 3 + 1).alias("seq"), F.md5(F.col("text").cast("binary")).alias("text"), "doc_id")
    table = ingest.KeptTable(spark, f"{where}/table", "id string, seq long, text string", most_segments=2)
    stream = lambda: spark.readStream.schema("id string, seq long, text string").parquet(f"{where}/in")

    def fail(number: int) -> None:
        if number == 1:
            raise RuntimeError("lost after the commit")

    for k in range(_BATCHES):  # what is new since the last run is one batch
        rows.where(F.col("doc_id") % _BATCHES == k).drop("doc_id").write.mode("append").parquet(f"{where}/in")
        try:
            ingest.ingest(stream(), table, f"{where}/state", before_commit=fail)
        except Exception as e:  # the stream's own, with ours as its cause
            if "lost after the commit" not in str(e):
                raise
            ingest.ingest(stream(), table, f"{where}/state")
    return table.current()
