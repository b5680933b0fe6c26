"""Search: exact nearest neighbours, BM25, weighted fusion, graph retrieval; all for a batch of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import scoring as S
from tidewell.functions import vector as V
from tidewell.functions.text import tokens

MOST = 20  # results of one search
QUERY_BLOCK_BYTES = 16_000_000
WORK_CELLS = 4_000_000  # query-row products that a task holds at once


def knn(df: DataFrame, vector: list[float], k: int = MOST, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
    """K1: (id, cos, score) of the exact cosine top k for one query vector; filters come before ranking.

    A filtered scan, a product in Arrow batches and a top k: no join, and no shuffle beyond k rows of each task.
    """
    if where is not None:
        df = df.where(where)
    block = df.sparkSession.sparkContext.broadcast(([""], _unit(np.array([vector], dtype=np.float64))))
    near = df.select("id", "vector").mapInArrow(_nearest(block, k, False), "query_id string, id string, cos double")
    return near.withColumn("score", S.clamp01(V.score_of_cosine(F.col("cos")))).where(F.col("score") >= min_score).orderBy(F.col("score").desc(), "id").limit(k).drop("query_id")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _blocks(queries: DataFrame) -> Iterator[object]:
    """Broadcasts of (ids, unit vectors) of the queries (query_id, query_vector), each of at most QUERY_BLOCK_BYTES."""
    first = queries.select("query_vector").first()
    if first is None or not first[0]:
        return
    blocks = -(-queries.count() * 8 * len(first[0]) // QUERY_BLOCK_BYTES)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = part.select(F.col("query_id").cast("string"), "query_vector").toArrow()
        ids = table.column(0).to_pylist()
        yield queries.sparkSession.sparkContext.broadcast((ids, _unit(np.array(table.column(1).to_pylist(), dtype=np.float64).reshape(len(ids), len(first[0])))))


def _per_block(df: DataFrame, queries: DataFrame, f: Callable[[object], object], schema: str, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    rows, out = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")), None
    for block in _blocks(queries):
        found = rows.mapInArrow(f(block), schema)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def knn_batch(df: DataFrame, queries: DataFrame, k: int = MOST, id_col: str = "id", vector_col: str = "vector", not_itself: bool = True) -> DataFrame:
    """(query_id, id, cos, rank) of the k nearest rows of every query.

    Queries (query_id, query_vector) are collected in blocks of at most
    QUERY_BLOCK_BYTES and each block is broadcast: a task multiplies its rows with the
    block as matrices and keeps k rows for each query, so the shuffle carries at most
    tasks x queries x k rows, whatever the table's size.
    """
    out = _per_block(df, queries, lambda block: _nearest(block, k, not_itself), "query_id string, id string, cos double", id_col, vector_col)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cos").desc(), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def within(df: DataFrame, queries: DataFrame, least_cos: float) -> DataFrame:
    """(query_id, id, cos) of every row at least that near to a query; a row is not near to itself.  No k cuts the list."""

    def f(block: object) -> object:
        def pick(ids: list[str], names: list[str], cos: np.ndarray) -> tuple:
            i, j = np.nonzero(cos >= least_cos)
            return [ids[x] for x in i], [names[x] for x in j], cos[i, j]

        return _products(block, pick)

    return _per_block(df, queries, f, "query_id string, id string, cos double")


def nearest_query(df: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, cos): for every row how near the nearest query is, itself left out."""

    def f(block: object) -> object:
        def pick(ids: list[str], names: list[str], cos: np.ndarray) -> tuple:
            best = cos.max(axis=0)
            at = np.flatnonzero(np.isfinite(best))
            return [""] * len(at), [names[x] for x in at], best[at]

        return _products(block, pick)

    return _per_block(df, queries, f, "query_id string, id string, cos double").groupBy("id").agg(F.max("cos").alias("cos"))


def _parts(batches: Iterator[pa.RecordBatch], ids: list[str], q: np.ndarray, not_itself: bool) -> Iterator[tuple[list[str], np.ndarray]]:
    """(row ids, cosines by query and row) of as many rows at a time as WORK_CELLS allows."""
    same = {x: i for i, x in enumerate(ids)} if not_itself else {}
    step = max(16, WORK_CELLS // max(len(ids), 1))
    for batch in batches:
        names, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = [i for i, v in enumerate(vectors) if v is not None and len(v) == q.shape[1]]
        for a in range(0, len(good), step):
            part = good[a : a + step]
            cos = q @ _unit(np.array([vectors[i] for i in part], dtype=np.float64)).T
            for j, i in enumerate(part):
                if names[i] in same:
                    cos[same[names[i]], j] = -np.inf
            yield [names[i] for i in part], cos


def _products(block: object, pick: Callable) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        for names, cos in _parts(batches, ids, q, True):
            a, b, c = pick(ids, names, cos)
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=["query_id", "id", "cos"])

    return run


def _nearest(block: object, k: int, not_itself: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        best_cos, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), None, dtype=object)
        for names, cos in _parts(batches, ids, q, not_itself):
            every = np.concatenate([best_cos, cos], axis=1)
            label = np.array([None] * k + names, dtype=object)
            edge = np.partition(every, -k, axis=1)[:, -k][:, None]
            inside = every >= edge
            count = inside.sum(axis=1)
            for i in np.flatnonzero((count > k) | ((cos >= edge) & np.isfinite(cos)).any(axis=1)):  # others keep what they have
                at = np.flatnonzero(inside[i] & np.isfinite(every[i]))
                tags = [best_id[i, x] if x < k else label[x] for x in at]
                if len(at) > k:  # ties at the edge go to the smaller id
                    order = sorted(range(len(at)), key=lambda x: (-every[i, at[x]], tags[x]))[:k]
                    at, tags = at[order], [tags[x] for x in order]
                best_cos[i], best_id[i] = -np.inf, None
                best_cos[i, : len(at)], best_id[i, : len(at)] = every[i, at], tags
        i, j = np.nonzero(np.isfinite(best_cos))
        yield pa.record_batch([pa.array([ids[x] for x in i], pa.string()), pa.array(best_id[i, j].tolist(), pa.string()), pa.array(best_cos[i, j])], names=["query_id", "id", "cos"])

    return run


def postings(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, length): the inverted index, to be written once, sorted by term.  A row without a term carries each text's length."""
    t = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    terms = F.concat(F.array(F.lit(None).cast("string")), "t")
    return t.select("id", F.size("t").alias("length"), F.explode(terms).alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, k: int = MOST, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """K2: (query_id, id, raw, score, rank) by BM25 over written `postings`; `queries` is (query_id, query).

    The queries' terms come first: only their postings are counted and scored.  score is the raw sum through a sigmoid.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    n = index.where("term is null").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    some = index.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    df = some.groupBy("term").agg(F.count("*").alias("df"))
    hit = some.join(df, "term").join(terms, "term").crossJoin(F.broadcast(n))  # n is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hit.withColumn("part", part).groupBy("query_id", "id").agg(F.sum("part").alias("raw"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", S.bm25_normalised(F.col("raw")))


def fuse(vector: DataFrame, keyword: DataFrame, graph: DataFrame, short: bool | DataFrame = False, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Weighted average of the channels (query_id, id, score) with bonuses where they agree; no reciprocal ranks.

    `short` is for all queries, or a table (query_id, short): short queries lean on keywords.
    """
    named = lambda df, c: df.select("query_id", "id", F.col("score").alias(c))
    all_ = named(vector, "v").join(named(keyword, "b"), ["query_id", "id"], "full_outer").join(named(graph, "g"), ["query_id", "id"], "full_outer")
    if isinstance(short, bool):
        brief = F.lit(short)
    else:
        all_, brief = all_.join(short.select("query_id", F.col("short").alias("__short")), "query_id", "left"), F.coalesce("__short", F.lit(False))
    vw = F.when(brief, vector_weight * 0.7).otherwise(vector_weight)
    bw = F.when(brief, min(keyword_weight * 1.5, 0.6)).otherwise(keyword_weight)
    v, b, g = F.col("v"), F.col("b"), F.col("g")
    bonus = F.coalesce(g, F.lit(0.0)) * 0.15
    fused = (
        F.when(v.isNotNull() & b.isNotNull(), S.clamp01((vw * v + bw * b) / (vw + bw) * 1.05 + bonus))
        .when(v.isNotNull(), S.clamp01(v + bonus))
        .when(g.isNotNull(), S.clamp01(g + F.when(F.coalesce(b, F.lit(0.0)) > 0, 0.10).otherwise(0.0)))
        .otherwise(S.clamp01(b * F.when(brief, 1.15).otherwise(1.0)))
    )
    return all_.withColumn("score", fused).drop("__short")


def supplement(main: DataFrame, keyword: DataFrame, most: int = 3) -> DataFrame:
    """K5: up to `most` keyword hits of each query that the main list lacks, put before it."""
    new = keyword.join(main.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    new = new.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", "score", F.lit(0).alias("part"))
    every = new.unionByName(main.select("query_id", "id", "score", F.lit(1).alias("part")))
    return every.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("part", F.col("score").desc(), "id")))


def merge_by_max(*parts: DataFrame) -> DataFrame:
    """Union of result lists, the best score of each (query, id)."""
    out = parts[0].select("query_id", "id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "id", "score"))
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def graph_scores(triples: DataFrame, ranks: DataFrame, k: int = MOST) -> DataFrame:
    """A triple scores the better rank of its two entities times its confidence, a memory its best triple."""
    r = ranks.select(F.col("entity").alias("e"), F.col("rank_score"))
    two = triples.join(r.withColumnsRenamed({"e": "subject", "rank_score": "rs"}), "subject", "left").join(r.withColumnsRenamed({"e": "object", "rank_score": "ro"}), "object", "left")
    best = F.greatest(F.coalesce("rs", F.lit(0.0)), F.coalesce("ro", F.lit(0.0))) * F.col("confidence")
    return two.withColumn("s", best).where("s > 0").groupBy(F.col("source_memory_id").alias("id")).agg(F.max("s").alias("score")).orderBy(F.round("score", 9).desc(), "id").limit(k)


def graph_scores_batch(triples: DataFrame, ranks: DataFrame, k: int = MOST) -> DataFrame:
    """K3 for many queries: (query_id, id, score) of the k best memories of each by `ranks` (query_id, entity, rank_score)."""
    entities = F.explode(F.array("subject", "object")).alias("entity")
    hit = triples.select("source_memory_id", "confidence", entities).join(ranks, "entity")
    best = hit.withColumn("s", F.col("rank_score") * F.col("confidence")).where("s > 0").groupBy("query_id", F.col("source_memory_id").alias("id")).agg(F.max("s").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score")


# Least score by category, and profiles that scale them.
CATEGORY_MIN = {"profile": 0.25, "preferences": 0.25, "entities": 0.30, "events": 0.35, "cases": 0.40, "patterns": 0.45}


def min_score(category: Column, base: float = 0.35, short: bool = False) -> Column:
    """the category's least score; queries of up to 4 tokens ask for 0.6 of it."""
    out = F.lit(base)
    for c, s in CATEGORY_MIN.items():
        out = F.when(category == c, s).otherwise(out)
    return out * (0.6 if short else 1.0)
