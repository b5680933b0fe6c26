"""Near pairs of vectors by random hyperplanes, and what a fixed order makes of them.

`near_pairs` hashes every vector by bands of signs against random hyperplanes: a pair at
the threshold shares a band with the chance asked for (`recall`), a pair of unrelated
vectors hardly ever.  Only rows of one bucket are compared, exactly; a bucket larger than a
block is cut into blocks and each pair of blocks is a unit of work, so no task grows with a
bucket.  Equal vectors should be one row (`vector_classes`), or they fill buckets for nothing.
At thresholds whose bands would be many and short, a row would travel once for each of them;
there all pairs of a group are compared in blocks (`_block_pairs`), a row travelling only as
often as its group has blocks, and none is missed.

`first_centers` takes the lexicographically first independent set of such a graph: what a
loop over the rows in their order would take, worked out in rounds over the edges left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import materialise


def choose_bands(least_cos: float, recall: float = 0.9999, most_bits: int = 2048) -> tuple[int, int]:
    """(bands, bits of each): the most bits whose bands reach the recall at the threshold within `most_bits` bits in all."""
    same = 1 - math.acos(max(-1.0, min(1.0, least_cos))) / math.pi
    best = None
    for bits in range(1, 63):
        chance = same**bits
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance > 1e-12 else most_bits + 1
        if bands * bits > most_bits:
            break
        best = (bands, bits)
    if best is None:
        raise ValueError("no number of bands reaches this recall; allow more bits")
    return best


def vector_classes(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`df` (id, vector, ...) with `first`: the id that comes first of those with the same vector in its group; zero and null vectors stand alone."""
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    alone = F.col("vector").isNull() | F.coalesce(length == 0, F.lit(True))
    # Two hashes of 64 bits stand for the vector, so that groups travel without it.
    key = [F.when(alone, F.col("id")), F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")]
    rows = df.withColumns({f"__k{i}": k for i, k in enumerate(key)}).withColumn("__o", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("id").alias("own")))
    keys = [*group, "__k0", "__k1", "__k2"]
    firsts = rows.groupBy(*keys).agg(F.min("__o")["own"].alias("first")).withColumnsRenamed({c: f"__of_{c}" for c in keys})
    return rows.join(firsts, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]).select(*df.columns, "first")


def _banded(bands: int, bits: int, seed: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            ids, group, vectors = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v:
                    by_length.setdefault(len(v), []).append(i)
            for d, rows in by_length.items():
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).normal(size=(d, bands * bits))
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    m = np.array([vectors[i] for i in part], np.float64)
                    signs = (m @ planes[d] > 0).reshape(len(part), bands, bits) @ weights
                    flat = pa.array(np.repeat(part, bands))
                    yield pa.record_batch([ids.take(flat), group.take(flat), pa.array(np.tile(np.arange(bands), len(part))), pa.array(signs.ravel())], names=["id", "gr", "band", "signs"])

    return run


def near_pairs(df: DataFrame, least_cos: float, group: list[str] | None = None, recall: float = 0.9999, block: int = 512, most_bits: int = 2048, seed: int = 11, least_bits: int = 16) -> DataFrame:
    """(a, b, cos), a < b: pairs of one group whose cosine is at least that; each pair is found with the chance `recall` or a higher one.

    `df` is (id, vector and the group's columns), ids unique.  Every pair is checked exactly
    and comes once: from the first bucket that both are in.  Bands of fewer than `least_bits`
    bits tell too little apart: then all pairs of a group are compared, and all near ones found.
    """
    bands, bits = choose_bands(least_cos, recall, most_bits)
    if bits < least_bits:
        return _block_pairs(df, least_cos, group or [])
    rows = materialise(df.select(F.col("id").cast("string").alias("id"), F.xxhash64(F.lit(0), *(group or [])).alias("gr"), "vector").where("vector is not null"))
    entries = rows.mapInArrow(_banded(bands, bits, seed), "id string, gr long, band long, signs long").select("id", F.xxhash64("gr", "band", "signs").alias("bucket"))
    entries = materialise(entries)
    mark = F.xxhash64("id")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.shiftright(mark, 33)).alias("s1"), F.bit_xor(mark).alias("s2")).where("c > 1")
    kept = buckets.groupBy("c", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("c") / block).cast("int").alias("parts"))
    members = entries.join(materialise(kept), "bucket")
    every = members.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "parts"))).alias("own"))  # one for each band at most
    at = lambda parts: F.pmod(F.xxhash64(F.lit(2), "id"), parts).cast("int")
    placed = rows.join(every, "id").withColumn("buckets", F.transform("own", lambda x: x["bucket"])).select("id", "gr", "vector", "buckets", F.explode("own").alias("o"))
    placed = placed.select("id", "gr", "vector", "buckets", F.col("o.bucket").alias("bucket"), at(F.col("o.parts")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)).alias("other"))
    units = placed.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "gr", "vector", "buckets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come whole and one after the other, as rows are sorted by them."""
        held, now = [], None
        found: list[tuple[list, list, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b, cos = (sum((f[k] for f in found), []) if k < 2 else np.concatenate([f[2] for f in found]) if found else np.zeros(0) for k in range(3))
            found.clear()
            return pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(cos)], names=["a", "b", "cos"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if len(held) > 1:
                        found.append(_unit_pairs(held, least_cos))
                    held, now = [], row[:3]
                held.append(row)
            yield out()
        if len(held) > 1:
            found.append(_unit_pairs(held, least_cos))
        yield out()

    dealt = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(verify, "a string, b string, cos double")


def _unit_pairs(rows: list[tuple], least_cos: float) -> tuple[list[str], list[str], np.ndarray]:
    """Near pairs of one unit, (bucket, i, j, at, id, group, vector, buckets) in each row, whose first common bucket it is."""
    bucket, one, two = rows[0][:3]
    size = max(len(r[6]) for r in rows)
    rows = [r for r in rows if len(r[6]) == size]  # another length is in the bucket only by a clash of hashes
    m = np.array([r[6] for r in rows], np.float64)
    norm = np.linalg.norm(m, axis=1)
    m /= np.where(norm > 0, norm, 1)[:, None]
    at, group = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
    left, right = (np.arange(len(rows)),) * 2 if one == two else (np.flatnonzero(at == one), np.flatnonzero(at == two))
    cos = m[left] @ m[right].T
    i, j = np.nonzero(cos >= least_cos - 1e-12)
    cos, i, j = cos[i, j], left[i], right[j]
    good = (group[i] == group[j]) & ((i < j) if one == two else True)
    cos, i, j = cos[good], i[good].tolist(), j[good].tolist()
    sets: dict[int, set[int]] = {}
    own = lambda k: sets[k] if k in sets else sets.setdefault(k, set(rows[k][7]))
    first = [min(own(x) & own(y)) == bucket for x, y in zip(i, j)]
    pairs = [tuple(sorted((rows[x][4], rows[y][4]))) for x, y, f in zip(i, j, first) if f]
    return [p[0] for p in pairs], [p[1] for p in pairs], cos[np.array(first, bool)] if first else cos[:0]


BLOCK_ROWS = 32_768  # rows of one block at most
CELLS = 2_000_000  # products that a task holds at once


def _block_pairs(df: DataFrame, least_cos: float, group: list[str], spread: int = 8, small: int = 2048, most: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cos), a < b: all pairs of one group whose cosine is at least that.

    A group is cut into up to `spread` blocks of `small` rows or more, and into more only where
    a block would have over `most` rows; a pair of blocks is one unit.  Products are taken in
    single precision first, and what may be near is worked out again in double precision.
    """
    rows = df.where("size(vector) > 0").select(F.col("id").cast("string").alias("id"), F.xxhash64(F.lit(0), F.size("vector"), *group).alias("gr"), F.col("vector").cast("array<double>").alias("vector"))
    rows = materialise(rows)
    parts = F.greatest(F.least(F.ceil(F.col("c") / small), F.lit(spread)), F.ceil(F.col("c") / most)).cast("int")
    sizes = materialise(rows.groupBy("gr").agg(F.count("*").alias("c")).where("c > 1").select("gr", parts.alias("parts")))
    placed = rows.join(sizes, "gr").withColumn("at", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = placed.select("gr", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "vector")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come whole and one after the other, as rows are sorted by them."""
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if (unit := tuple(keys[:, a].tolist())) != now:
                    yield from _near_in_unit(now, held, least_cos)
                    held, now = [], unit
                held.append(batch.slice(a, b - a))
        yield from _near_in_unit(now, held, least_cos)

    dealt = units.repartition("gr", "i", "j").sortWithinPartitions("gr", "i", "j")
    return dealt.mapInArrow(verify, "a string, b string, cos double")


def _near_in_unit(unit: tuple[int, int, int] | None, held: list[pa.RecordBatch], least_cos: float) -> Iterator[pa.RecordBatch]:
    """(a, b, cos) of the near pairs of one unit, whose rows are (group, i, j, at, id, vector), all vectors of one length."""
    if sum(b.num_rows for b in held) < 2:
        return
    ids, at = pa.concat_arrays([b.column(4) for b in held]), np.concatenate([b.column(3).to_numpy() for b in held])
    m = np.concatenate([b.column(5).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(len(ids), -1).astype(np.float64)
    norm = np.linalg.norm(m, axis=1)
    m /= np.where(norm > 0, norm, 1)[:, None]
    short = m.astype(np.float32)
    _, one, two = unit
    left, right = (np.arange(len(ids)),) * 2 if one == two else (np.flatnonzero(at == one), np.flatnonzero(at == two))
    place = np.empty(len(ids), np.int64)
    place[np.argsort(np.array(ids.to_pylist(), dtype=object))] = np.arange(len(ids))
    least = np.float32(least_cos - (m.shape[1] + 8) * 1.2e-7)  # more than what single precision may be off by
    other, step = short[right].T, max(1, CELLS // max(len(right), 1))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        i, j = np.divmod(np.flatnonzero(short[part] @ other >= least), max(len(right), 1))
        i, j = part[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        cos = np.concatenate([np.zeros(0), *(np.einsum("rd,rd->r", m[i[x : x + 65_536]], m[j[x : x + 65_536]]) for x in range(0, len(i), 65_536))])
        near = cos >= least_cos - 1e-12
        i, j, cos = i[near], j[near], cos[near]
        if len(i):
            a, b = np.where(place[i] < place[j], i, j), np.where(place[i] < place[j], j, i)
            yield pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cos)], names=["a", "b", "cos"])


def first_centers(edges: DataFrame) -> DataFrame:
    """(id, center) of the rows that a loop over all in their order would pass over, and the first center that each is near to.

    `edges` is (early, late, o): near rows with the earlier one's place in the order, `o`.  A
    row is a center if no earlier center is near; all others are passed over.  In each round
    the rows with no undecided earlier neighbour become centers and what they are near to is
    settled; the rounds are as many as the longest chain of such decisions, which in a random
    order is about the logarithm of the number of rows.
    """
    edges = materialise(edges.select("early", "late", "o"))
    left, passed = edges, None
    while left.limit(1).count():
        centers = left.select(F.col("early").alias("id")).distinct().join(left.select(F.col("late").alias("id")).distinct(), "id", "left_anti")
        now = materialise(left.join(centers, left["early"] == centers["id"]).select(F.col("late").alias("id")).distinct())
        passed = now if passed is None else passed.unionByName(now)
        rest = left.join(centers.withColumnRenamed("id", "early"), "early", "left_anti")
        for end in ("early", "late"):
            rest = rest.join(now.withColumnRenamed("id", end), end, "left_anti")
        left = materialise(rest.select("early", "late", "o"))
    if passed is None:
        return edges.select(F.col("late").alias("id"), F.col("early").alias("center"))
    centers = edges.join(passed.withColumnRenamed("id", "early"), "early", "left_anti")
    return centers.groupBy(F.col("late").alias("id")).agg(F.min(F.struct("o", "early"))["early"].alias("center"))


def oriented(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) as edges (early, late, o) by the column `o` of `rows` (id, o), which orders all rows strictly."""
    one, two = rows.select(F.col("id").alias("a"), F.col("o").alias("oa")), rows.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    both = pairs.join(one, "a").join(two, "b")
    early = F.col("oa") < F.col("ob")
    return both.select(F.when(early, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("late"), F.when(early, F.col("oa")).otherwise(F.col("ob")).alias("o"))


def batch_dedup(df: DataFrame, threshold: float = 0.93, group: list[str] | None = None, recall: float = 0.9999) -> DataFrame:
    """(id, kept, like): which rows of a batch stay; one goes if a row that stays is more important, or as important and earlier, and its cosine is over the threshold.

    `df` is (id, vector, importance, position and the group's columns); a missing importance is
    0.5.  Rows without a vector, or with a zero one, stay.
    """
    group = group or []
    order = F.struct((-F.coalesce("importance", F.lit(0.5))).alias("importance"), "position", "id")
    rows = materialise(vector_classes(df.select("id", "vector", "importance", "position", *group), group, [-F.coalesce("importance", F.lit(0.5)), F.col("position")]).withColumn("o", order))
    own = rows.where("id = first")
    # "over": the least double that is larger
    pairs = near_pairs(own, float(np.nextafter(threshold, 2)) + 1e-12, group, recall)
    like = first_centers(oriented(pairs, own))
    return rows.join(like.withColumnsRenamed({"id": "first", "center": "by"}), "first", "left").select("id", (F.col("by").isNull() & (F.col("id") == F.col("first"))).alias("kept"), F.coalesce("by", F.when(F.col("id") != F.col("first"), F.col("first"))).alias("like"))
