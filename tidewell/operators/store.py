"""Reading and writing the memory table: scans, lookups, upserts, patches, deletes, triples.

Writers are functions from the old rows and a batch to the new rows; the caller writes
them to a new path (`replace_table`).  Each touches the old rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import scope_predicate

LISTED = ("id", "text", "category", "scope", "importance", "ts")


def scan(df: DataFrame, scopes: list[str] | None = None, category: str | None = None, columns: tuple[str, ...] = LISTED, family: bool = True) -> DataFrame:
    """S3: scope and category predicates and the needed columns, all pushed to the reader."""
    if scopes:
        df = df.where(scope_predicate(F.col("scope"), scopes, family))
    if category:
        df = df.where(F.col("category") == category)
    return df.select(*columns)


def listed(df: DataFrame, scopes: list[str] | None = None, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; only offset + limit rows of each task are kept."""
    return scan(df, scopes, category).orderBy(F.col("ts").desc(), "id").offset(offset).limit(limit)


class AmbiguousId(ValueError):
    """A prefix that several ids share."""


def lookup(df: DataFrame, wanted: str, scopes: list[str] | None = None) -> DataFrame:
    """The row of an id, or of a prefix of 8 characters or more; raises if the prefix is ambiguous or its scope foreign."""
    exact = df.where(F.col("id") == wanted)
    found = exact if exact.limit(1).count() or len(wanted) < 8 else df.where(F.col("id").startswith(wanted))
    rows = found.limit(2).select("id", "scope").collect()
    if len(rows) > 1:
        raise AmbiguousId(wanted)
    if rows and scopes and not found.where(scope_predicate(F.col("scope"), scopes)).limit(1).count():
        raise PermissionError(f"{wanted} is outside of the given scopes")
    return found


def lookup_or_none(df: DataFrame, wanted: str) -> DataFrame:
    """Like lookup(), but no row where that raises."""
    try:
        return lookup(df, wanted)
    except AmbiguousId:
        return df.where(F.lit(False))


def vectors_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the ids; which side is broadcast is left to the optimizer and its size limit."""
    return df.select("id", "vector").join(ids.select("id").distinct(), "id", "left_semi")


def last_of_each(batch: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key, without a window: one pass with partial aggregation."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch replace old ones of the same key."""
    return old.join(batch.select(key), key, "left_anti").unionByName(batch.select(*old.columns))


def append_import(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids and timestamps as they come."""
    return old.unionByName(batch.select(*old.columns))


def patch(old: DataFrame, patches: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """For each key the patch's values where it has any; one row of `patches` for each key."""
    renamed = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    changed = {c: F.coalesce(f"__{c}", c) for c in columns}
    return old.join(renamed, key, "left").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in old.columns))


def delete(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")  # S11


def bulk_delete(old: DataFrame, scopes: list[str] | None = None, before: int | None = None) -> DataFrame:
    """What stays after deleting by scope, time or both; an empty predicate is refused."""
    if not scopes and before is None:
        raise ValueError("give scopes, a time or both")
    gone: Column = scope_predicate(F.col("scope"), scopes) if scopes else F.lit(True)
    if before is not None:
        gone = gone & (F.col("ts") < before)
    return old.where(~F.coalesce(gone, F.lit(False)))


def replace_table(spark: object, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write `change` of the table at `path` beside it, then swap the two directories.

    The old one is moved aside before the new one takes its place and deleted last, so a
    crash leaves one of the two whole; a table found only aside is moved back first.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(path.rstrip("/") + end) for end in ("", ".next", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path.rstrip('/')}.next")
    fs.delete(old, True)
    fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
    return spark.read.parquet(path)


# --- Triples -----------------------------------------------------------------------------------------


def with_triple_id(df: DataFrame) -> DataFrame:
    return df.withColumn("triple_id", F.substring(F.sha2(F.concat_ws("\u0000", "subject", "predicate", "object").cast("binary"), 256), 1, 32))


def collapse_triples(batch: DataFrame, most_sources: int = 200) -> DataFrame:
    """One row for each triple: highest confidence, distinct sources (the first `most_sources` of them) and how many there are.

    Sources are made distinct and numbered before they are gathered, so a triple that half the
    table is a source of is no row without a bound; only the first of each task leave it.
    """
    rows, key = with_triple_id(batch), ["triple_id", "subject", "predicate", "object"]
    every = rows.groupBy(*key, "source_memory_id").agg(F.max("confidence").alias("confidence"))
    totals = every.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.count("source_memory_id").alias("mention_count"))
    place = F.row_number().over(W.partitionBy("triple_id").orderBy("source_memory_id"))
    first = every.where("source_memory_id is not null").select("triple_id", "source_memory_id").withColumn("__n", place).where(F.col("__n") <= most_sources)
    sources = first.groupBy("triple_id").agg(F.sort_array(F.collect_list("source_memory_id")).alias("sources"))
    return totals.join(sources, "triple_id", "left").select(*key, "confidence", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "mention_count")


def merge_triples(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Old and new collapsed triples by id: highest confidence, union of sources."""
    o, b = old.alias("o"), batch.alias("b")
    sources = F.array_union(F.coalesce("o.sources", F.array().cast("array<string>")), F.coalesce("b.sources", F.array().cast("array<string>")))
    return o.join(b, "triple_id", "full_outer").select("triple_id", *(F.coalesce(f"b.{c}", f"o.{c}").alias(c) for c in ("subject", "predicate", "object")), F.greatest("o.confidence", "b.confidence").alias("confidence"), F.sort_array(sources).alias("sources"), F.size(sources).cast("long").alias("mention_count"))


def triples_of_entity(triples: DataFrame, entity: str) -> DataFrame:
    return triples.where((F.col("subject") == entity) | (F.col("object") == entity))


def entities(triples: DataFrame) -> DataFrame:
    """Distinct subjects and objects in one pass."""
    return triples.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


def triples_of_memories(collapsed: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples to which any of the memories contributed."""
    by_source = collapsed.select("triple_id", F.explode("sources").alias("id"))
    return by_source.join(ids.select("id"), "id", "left_semi").select("triple_id").distinct()


def forget_source(collapsed: DataFrame, source: str) -> DataFrame:
    """A source leaves all triples; those that had no other go."""
    left = F.array_remove("sources", source)
    return collapsed.withColumn("sources", left).withColumn("mention_count", F.size("sources").cast("long")).where(F.size("sources") > 0)


# --- Record stores -----------------------------------------------------------------------------------


def latest_record(records: DataFrame, group: str, time: str, rich: Column, newest: int = 5) -> DataFrame:
    """Of each group's newest records a rich one if there is any, else the newest."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col(time).desc(), "id"))
    kept = records.withColumn("__rank", rank).where(F.col("__rank") <= newest)
    pick = F.row_number().over(W.partitionBy(group).orderBy(rich.desc(), "__rank"))
    return kept.withColumn("__pick", pick).where("__pick = 1").drop("__pick", "__rank")


def stale_sources(beats: DataFrame, now: int, days: int = 7) -> DataFrame:
    """The last beat of each source and whole days since, where that is over the limit."""
    last = beats.groupBy("source").agg(F.max("at_ms").alias("last_ms"))
    return last.withColumn("days", F.floor((F.lit(now) - F.col("last_ms")) / 86_400_000)).where(F.col("days") > days)


def repair_versions(rows: DataFrame, group: str = "version_group", fields: tuple[str, ...] = ("version_rank",)) -> DataFrame:
    """`rows` (id, group, ...) with version groups of a single row dissolved: group and `fields` become null; `repaired` says where."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n")).where("__n = 1").select(group, F.lit(True).alias("__alone"))
    marked = rows.join(sizes, group, "left").withColumn("repaired", F.coalesce("__alone", F.lit(False))).drop("__alone")
    cleared = {c: F.when(~F.col("repaired"), F.col(c)) for c in (group, *fields) if c in rows.columns}
    return marked.select(*(cleared[c].alias(c) if c in cleared else F.col(c) for c in rows.columns), "repaired")
