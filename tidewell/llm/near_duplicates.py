"""4. N-gram Jaccard join by MinHash banding.

Documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more are
linked.  `choose_bands` picks bands and rows for a target recall at the threshold.

1. One pass numbers the rows and makes each text's 128-bit set fingerprint and band
   hashes; equal sets are one class, so copies of a text are compared once however many
   there are.  Rows, not ids, are what everything after goes by: ids may repeat or be null.
2. A shuffle on band hashes finds the buckets with two classes or more.  Buckets with the
   same members (as a near pair has in most bands) are kept once.
3. A bucket of more than `block` classes or `block_grams` n-grams is cut into blocks by
   hash; each pair of blocks is one unit of work, so no task grows with a bucket, and none
   is capped.
4. Within a unit all pairs are verified on their full n-gram sets.  A pair that shares
   several buckets counts only in the first.  A unit returns one row for each linked
   class (its number of links and its local root), never a row for each pair.
5. Local roots are joined to components by repeated contraction; each round is written to
   the shared folder, and the driver sees only counts.  Hot buckets, classes and
   components are joined by `join_counted`.

The result has a row for each row: class_id is the smallest id of its component,
text_class the smallest id with the same n-gram set, n_text_links the number of different
sets it is linked to, n_links the number of other rows linked to it, copies included.
Where that smallest id is null, or is the smallest of several different sets, it names no
class; then the class is a negative number made from the set's fingerprint.

A text of 1 to 4 words is one n-gram.  Null texts and texts without words have none: each
is a class of its own without links, also when rows repeat.  Rows that repeat an id each
get a row; they share a class only if their texts do.  Very long texts are one set each.
Empty tables give an empty result; further columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import ID, ROW, TEXT, WordHash, column_at, cut, join_counted, mix64, pick, shingle_hashes, text_batches

find_words = re.compile(r"\w+").findall


def choose_bands(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within `most_hashes` hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        chance = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def gram_set(text: str, n: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    return np.unique(shingle_hashes(known.of(find_words(text.lower())), n))


def fingerprint(grams: bytes) -> np.ndarray:
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(grams), np.int64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash for each set (none empty) and band; equal where all rows of the band agree."""
    rng = np.random.default_rng(4)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b + 1, np.uint64)
        for _ in range(rows):
            salt, factor = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat(((flat ^ salt) * (factor | np.uint64(1))) >> np.uint64(32), starts)
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = h
    return out


def signed(df: DataFrame, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """`df` with row numbers, set fingerprints, set sizes and band hashes, written once: the numbers hold for all that follows."""
    df = df.withColumn(ROW, F.monotonically_increasing_id())
    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    names = [*df.columns, *(f"__{f.name}" for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch, texts in text_batches(batches, name=text_col):
            sets = [gram_set(t, n, known) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            of = np.full(len(sets), -1)
            of[some] = range(len(some))
            hashes = band_hashes([sets[i] for i in some], bands, rows).view(np.int64) if some else np.zeros((0, bands), np.int64)
            marks = np.array([fingerprint(s.tobytes()) for s in sets], np.int64).reshape(-1, 2)
            new = [pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashes[j] if j >= 0 else None for j in of], pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns, *new], names=names)

    return cut(df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(f"__{f.name}", f.dataType) for f in fields)])))


def pairs_above(grams: list[np.ndarray], side: np.ndarray, one_block: bool, buckets: list[np.ndarray], own: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a < b in the unit) of linked pairs whose first common bucket is `own`."""
    m = len(grams)
    size = np.array([len(g) for g in grams])
    if m <= 24:
        a, b = np.triu_indices(m, 1)
        if not one_block:
            cross = side[a] != side[b]
            a, b = a[cross], b[cross]
        near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[near], b[near]
        inter = np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
        good = inter >= threshold * (size[a] + size[b] - inter) - 1e-9
        a, b = a[good], b[good]
        first = np.array([min(np.intersect1d(buckets[i], buckets[j], assume_unique=True)) == own for i, j in zip(a, b, strict=True)], dtype=bool)
        return a[first], b[first]
    left, right = (np.arange(m), np.arange(m)) if one_block else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def common(lists: list[np.ndarray]) -> np.ndarray:
        """How many values each left and right list share, by products of slices of their incidence matrix."""
        values, back, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(x) for x in lists])
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[back]  # a value of one list is shared by none
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        out = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, [c, c + 2048])
            part = np.zeros((m, 2048), np.float32)
            part[row[a:b], column[a:b] - c] = 1
            out += part[left] @ part[right].T
        return out

    inter = common(grams)
    good = inter >= threshold * (size[left][:, None] + size[right][None, :] - inter) - 1e-6
    before = [x[x < own] for x in buckets]
    if any(len(x) for x in before):
        good &= common(before) == 0
    if one_block:
        good = np.triu(good, 1)
    a, b = np.nonzero(good)
    return left[a], right[b]


def verified(units: DataFrame, threshold: float) -> DataFrame:
    """(id, root, texts, docs) of each linked class in each unit.  `units` is sorted by unit within its partitions."""

    def unit(rows: dict[str, list]) -> list[tuple[int, int, int, int]]:
        own, one_block = rows["g"][0], rows["i"][0] == rows["j"][0]
        ids = rows["id"]
        if len(ids) < 2:
            return []
        grams = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        buckets = [np.frombuffer(x, np.int64) for x in rows["buckets"]]
        a, b = pairs_above(grams, np.array(rows["side"]), one_block, buckets, own, threshold)
        if not len(a):
            return []
        copies = np.array(rows["copies"])
        texts = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        docs = np.bincount(a, copies[b], minlength=len(ids)) + np.bincount(b, copies[a], minlength=len(ids))
        root = np.array(ids)  # smallest id of the local component
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == root).all():
                break
            root = new
        return [(ids[i], int(root[i]), int(texts[i]), int(docs[i])) for i in np.flatnonzero(texts)]

    def out(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["id", "root", "texts", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        for batch in batches:
            data = batch.to_pydict()
            keys = list(zip(data["g"], data["i"], data["j"], strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            found: list[tuple[int, int, int, int]] = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if rows and (rows["g"][0], rows["i"][0], rows["j"][0]) != keys[x]:
                    found += unit(rows)
                    rows = {}
                for k, v in data.items():
                    rows.setdefault(k, []).extend(v[x:y])
            yield out(found)
        yield out(unit(rows) if rows else [])

    return units.mapInArrow(run, "id long, root long, texts long, docs long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): `edges` (id, root with root <= id) contracted until every id points to its component's smallest id."""
    edges = cut(edges.where("root < id").distinct())
    while True:
        low = cut(edges.groupBy("id").agg(F.min("root").alias("low")))
        up = low.select(F.col("id").alias("root"), F.col("low").alias("above"))
        n, open_ = low.count(), low.join(up, F.col("low") == up["root"], "left_semi").limit(1).count()
        if n == edges.count() and not open_:
            return low.withColumnRenamed("low", "root")
        # An id's roots all go under the smallest of them, and every edge skips to the root above its own.
        under = edges.join(low, "id").select(F.explode(F.array(F.struct("id", F.col("low").alias("root")), F.struct(F.col("root").alias("id"), F.col("low").alias("root")))).alias("e")).select("e.id", "e.root").where("root < id")
        edges = cut(under.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root")).unionByName(under.join(up, "root").select(F.col("root").alias("id"), F.col("above").alias("root"))).distinct())


def linked_classes(docs: DataFrame, text_col: str, n: int, bands: int, threshold: float, block: int, block_grams: int) -> DataFrame:
    """(h1, h2, least, first, copies, root, texts, docs) of each class of `docs`, which is from signed().

    least and first: the smallest id and the row that has it; root names the component.
    """
    rows = docs.select(ROW, ID, *(F.col(f"__{c}").alias(c) for c in ("h1", "h2", "n", "bands"))).where("n > 0")
    best = F.min(F.struct(F.col(ID).isNull().alias("none"), F.col(ID).alias("id"), F.col(ROW).alias("row")))
    classes = cut(rows.groupBy("h1", "h2").agg(F.min(ROW).alias("id"), best.alias("best"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    total = classes.count()

    entries = classes.select("id", "copies", "n", F.explode("bands").alias("g"))
    mark = F.xxhash64("id")
    buckets = entries.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("grams"), F.sum(F.shiftright(mark, 33)).alias("s1"), F.bit_xor(mark).alias("s2")).where("c > 1")
    parts = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("grams") / block_grams)).cast("int")
    kept = cut(buckets.groupBy("c", "grams", "s1", "s2").agg(F.min("g").alias("g")).select("g", "c", parts.alias("parts")))
    # At most one entry for each band.
    members = join_counted(entries, kept, ["g"], "c", total * bands).groupBy("id").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("g", "parts")).alias("in"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        names = ["g", "i", "j", "side", "id", "copies", "buckets", "grams"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        made = lambda out: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch, texts in text_batches(batches):
            data = batch.select(["id", "copies", "in"]).to_pydict()
            out: list[tuple] = []
            held = 0
            for id_, copies, inside, text in zip(data["id"], data["copies"], data["in"], texts, strict=True):
                grams = gram_set(text, n, known).tobytes()
                own = np.sort(np.array([x["g"] for x in inside], np.int64)).tobytes()
                at_all = int(mix64(np.array([id_], np.int64).view(np.uint64) + np.uint64(1))[0])
                for x in inside:
                    at = at_all % x["parts"]
                    for other in range(x["parts"]):
                        out.append((x["g"], min(at, other), max(at, other), int(at > other), id_, copies, own, grams))
                        held += len(grams)
                        if held >= 16_000_000 or len(out) >= 2_000:
                            yield made(out)
                            out, held = [], 0
            if out:
                yield made(out)

    texts = docs.select(F.col(ROW).alias("id"), F.col(text_col).alias(TEXT))
    units = texts.join(members, "id").mapInArrow(spread, "g long, i int, j int, side int, id long, copies long, buckets binary, grams binary")
    links = cut(verified(units.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j"), threshold))
    roots = components(links.select("id", "root"))
    counted = links.groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    out = classes.drop("bands", "n").join(roots, "id", "left").join(counted, "id", "left")
    nought = F.lit(0).cast("long")
    return cut(out.select("h1", "h2", F.col("best.id").alias("least"), F.col("best.row").alias("first"), "copies", F.coalesce("root", "id").alias("root"), F.coalesce("texts", nought).alias("texts"), F.coalesce("docs", nought).alias("docs")))


def with_representative(classes: DataFrame, total: int) -> DataFrame:
    """`classes` with the class that stands for each one's component (`rep`: that with the smallest id) and how many it has (`c`)."""
    rep = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "h1", "h2", F.col("first").alias("row")))
    groups = cut(classes.groupBy("root").agg(F.count("*").alias("c"), rep.alias("rep")).where("c > 1"))
    alone = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "h1", "h2", F.col("first").alias("row"))
    return join_counted(classes, groups, ["root"], "c", total, "left").withColumns({"c": F.coalesce("c", F.lit(1).cast("long")), "rep": F.coalesce("rep", alone)})


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    block: int = 1024,
    block_grams: int = 2_000_000,
) -> DataFrame:
    """(doc_id, class_id, text_class, n_copies, n_text_links, n_links) of each row."""
    bands, rows_ = choose_bands(threshold, recall)
    docs = signed(pick(df, id_col, text_col), TEXT, n, bands, rows_)
    classes = linked_classes(docs, TEXT, n, bands, threshold, block, block_grams)
    total = docs.count()
    known = cut(with_representative(classes, total))

    wordless = docs.where("__n = 0").select(ROW, ID)
    names = known.select(F.col("least").alias("id")).unionByName(wordless.select(F.col(ID).alias("id"))).where("id is not null")
    shared = cut(names.groupBy("id").agg(F.count("*").alias("times")).where("times > 1"))  # ids that name several classes
    clash = bool(shared.limit(1).count())

    def with_times(x: DataFrame, id_: str, name: str) -> DataFrame:
        """`x` with `name`: does its id name one class only?"""
        good = F.col(id_).isNotNull()
        if not clash:
            return x.withColumn(name, good)
        keyed = join_counted(x.withColumn("id", F.col(id_)), shared, ["id"], "times", total, "left")
        return cut(keyed.withColumn(name, good & F.col("times").isNull()).drop("times", "id"))

    key = lambda good, id_, h: F.when(F.col(good), F.col(id_)).otherwise(-F.shiftrightunsigned(h, 1) - 1)
    known = with_times(with_times(known.withColumn("rep_id", F.col("rep.id")), "least", "own"), "rep_id", "of_rep")
    known = known.select("h1", "h2", "copies", key("of_rep", "rep_id", F.col("rep.h1")).alias("class_id"), key("own", "least", F.col("h1")).alias("text_class"), F.col("copies").alias("n_copies"), F.col("texts").alias("n_text_links"), (F.col("docs") + F.col("copies") - 1).alias("n_links"))
    columns = ["class_id", "text_class", "n_copies", "n_text_links", "n_links"]
    rows = docs.where("__n > 0").select(ID, F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    with_words = join_counted(rows, cut(known), ["h1", "h2"], "copies", total).select(F.col(ID).alias("doc_id"), *columns)
    alone = key("own", ID, F.xxhash64(ROW))
    zero = F.lit(0).cast("long")
    without = with_times(wordless, ID, "own").select(F.col(ID).alias("doc_id"), alone.alias("class_id"), alone.alias("text_class"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_text_links"), zero.alias("n_links"))
    return with_words.unionByName(without)


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    block: int = 1024,
    block_grams: int = 2_000_000,
) -> DataFrame:
    """`df` with one row of each component, one that has its smallest id; the row's columns stay as they are.

    Equal rows leave one; a text that no other is near to stays whatever its id; rows
    without words all stay.  Nulls among the ids come last.
    """
    bands, rows_ = choose_bands(threshold, recall)
    # The input's columns go by their places, so no name of theirs can be one of the operator's own.
    own = [f"c{i}" for i in range(len(df.columns))]
    text, id_ = own[column_at(df, text_col)], own[column_at(df, id_col)]
    docs = signed(df.toDF(*own).withColumn(ID, F.col(id_).cast("long")), text, n, bands, rows_)
    classes = linked_classes(docs, text, n, bands, threshold, block, block_grams)
    total = docs.count()
    many = cut(with_representative(classes, total).where("c > 1 or copies > 1").select("h1", "h2", "copies", F.col("rep.row").alias("stays")))
    rows = docs.select(ROW, F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    gone = cut(join_counted(rows, many, ["h1", "h2"], "copies", total).where(F.col(ROW) != F.col("stays")).select(ROW))
    return docs.join(gone, ROW, "left_anti").select(*own).toDF(*df.columns)
