"""Pieces shared by the text operators.

Every operator takes a DataFrame and the *names* of the columns it needs, selects
just those under private names, and returns a new DataFrame: further columns of
the input, whatever they are called, can neither clash nor be shuffled along.
Ids are read as 64-bit integers; an id that is none fails the query, as Spark's
ANSI casts do.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID, TEXT = "__id", "__text"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only the columns an operator needs, under private names."""
    return df.select(
        F.col(id_col).cast("long").alias(ID),
        F.col(text_col).cast("string").alias(TEXT),
        *(F.col(src).alias(dst) for dst, src in more.items()),
    )


def column_at(df: DataFrame, name: str) -> int:
    """Where a column stands, found as Spark finds it: by its exact name, or else without regard to case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1 or df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        raise ValueError(f"no column {name} among {df.columns}")
    return alike[0]


def text_batches(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000, name: str = TEXT) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that their texts stay under `most_chars` bytes (a longer text is alone in its batch)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        lengths = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)) if batch.num_rows else np.zeros(0)
        part = np.floor(np.cumsum(lengths) / most_chars).astype(int)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, [t or "" for t in piece.column(piece.schema.get_field_index(name)).to_pylist()]


def map_text(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow: one pass, no shuffle; a task that is lost is simply run again."""
    return df.mapInArrow(f, schema)


def keep_rows(df: DataFrame, text_col: str, start: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of `df`, as they are, for whose text the function that `start` makes in each task says True; no shuffle."""

    text_name = df.columns[column_at(df, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = start()
        for batch, texts in text_batches(batches, name=text_name):
            yield batch.filter(pa.array(good(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """For results of a known bound; by Arrow whatever the session's settings are."""
    return df.toArrow().to_pandas()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where a session on a single machine has none (as in tests) one is set here.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"/tmp/tidewell-checkpoints/{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and every reader sees the same rows.

    Parquet rather than checkpoint(): it is compressed, and a reader takes only the columns
    it uses.  An application has one folder, which goes when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidewell-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    file = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(file)
    return spark.read.schema(df.schema).parquet(file)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has one row for each key and, in `count`, how many of left's `total` rows have it.

    Keys with more than a ten-thousandth of the rows (and more than 1,000) are at most
    10,000 in number, so they are broadcast and no task gets all their rows; the others
    are dealt by key.  Both sides must be cheap to read again.  Keys are not null in `right`.
    """
    limit = max(1_000, total // 10_000)
    hot, rest = right.where(F.col(count) > limit), right.where(F.col(count) <= limit)
    if not hot.limit(1).count():
        return left.join(rest, keys, how)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


ROW = "__row"


def first_rows(rows: DataFrame, keys: list[str], wanted: str, levels: list[str], total: int) -> DataFrame:
    """`rows` with `chosen`: of each group of `keys` the first `wanted` rows in the order of `levels`.

    Levels go from coarse to fine and the last one is unique.  Rows are counted by group and
    level; a running sum over the counts decides all rows of a level but those in which the
    group's cut falls, and only these go on to the next level.  So no task ranks a group,
    however large it is.  `rows` must be cheap to read again; keys and levels are not null.
    """
    names, open_, out, group = rows.columns, rows.withColumn("__left", F.col(wanted)), None, list(keys)
    for level in levels:
        counted = open_.groupBy(*group, level).agg(F.count("*").alias("__n"), F.first("__left").alias("__of"))
        before = F.sum("__n").over(W.partitionBy(*group).orderBy(level).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
        cuts = cut(counted.withColumn("__rest", F.col("__of") - before).drop("__of"))
        group.append(level)
        joined = join_counted(open_, cuts, group, "__n", total)
        inside = (F.col("__rest") > 0) & (F.col("__rest") < F.col("__n"))
        done = joined.where(~inside).select(*names, (F.col("__rest") > 0).alias("chosen"))
        out = done if out is None else out.unionByName(done)
        if not cuts.where(inside).limit(1).count():
            return out
        open_ = cut(joined.where(inside).select(*names, F.col("__rest").alias("__left")))
    return out


def crc_fold(id_col: Column) -> Column:
    """crc32 of the decimal id, modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def held_out(id_col: Column) -> Column:
    """Is a row outside of what may be learned from?  A row without an id is not held out, but has no label either."""
    return F.coalesce(crc_fold(id_col) == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHash(dict):
    """word -> 64-bit hash; remembers words of up to `longest` characters and at most `most` of them, which bounds its memory."""

    def __init__(self, most: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.most, self.longest = most, longest

    def hash(self, word: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: str) -> int:
        h = self.hash(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class LowerHash(WordHash):
    """word -> hash of its lower case, so that a text need not be lowered as a whole, which may change its length."""

    def hash(self, word: str) -> int:
        return super().hash(word.lower())


_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; a text of 1 to k-1 words has one run, all of it."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ (words[j : j + n] + np.uint64(j + 1))) * _ROLL
        h ^= h >> np.uint64(29)
    return h


WORDS = r"[^\W\d_]+"


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, per_class: int, seed: int, where: Column | None = None) -> DataFrame:
    """(ID, label): of each label the ids with the smallest seeded hash, about `per_class` of them (all, if there are fewer).

    An id with several labels has the largest of them.  The cut is a hash threshold from
    the label's count, so no label's rows meet in one task.  At most 1.2 * per_class + 100
    rows of a label pass, but for a chance below 1e-9 at the defaults.
    """
    rows = labels.select(F.col(id_col).cast("long").alias(ID), F.col(label_col).alias("label")).where(F.col(ID).isNotNull() & F.col("label").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(ID).agg(F.max("label").alias("label"))
    return rows.where(_sampled(rows, per_class, F.xxhash64(ID, F.lit(seed))))


def _sampled(rows: DataFrame, per_class: int, h: Column, most_rows: int | None = None) -> Column:
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if most_rows and counts:
        per_class = min(per_class, max(1, most_rows // len(counts)))
    passes = F.lit(False)
    for label, n in counts.items():
        passes = passes | ((F.col("label") == F.lit(label)) & (F.pmod(h, F.lit(1 << 40)) < F.lit(int(min(1.0, per_class / n) * (1 << 40)))))
    return passes


def labelled_texts(rows: DataFrame, per_class: int, seed: int, most_rows: int) -> DataFrame:
    """Of `rows` (ID, TEXT, label) about `per_class` of each label, fewer if that were over `most_rows` in all; rows equal in all three once."""
    passes = _sampled(rows, per_class, F.xxhash64(ID, TEXT, F.lit(seed)), most_rows)
    return rows.where(passes).dropDuplicates([ID, TEXT, "label"])
