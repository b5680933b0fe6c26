"""12. Source divergence audit: how far the words of each source of a language are from those of its others.

Mergeable radix tries over bytes.  Every partition counts the terms of a language in a trie
whose root branches by the first `DEPTH` bytes at once and whose nodes hold the terms that
begin so, each with counters of occurrences and documents by source (a burst trie: a node's
terms stay a flat container).  The nodes, not the terms, are what is shuffled: they are dealt
out by ranges of (language, prefix), and each range merges the containers of a node and keeps
the terms of enough documents, in UTF-8 order.  Counters leave a task when there are too many
of them, and a node's containers are merged as they come, so memory depends on the terms of
one prefix and neither on the input nor on how often a term occurs; a hot source is counted
where it lies before anything is shuffled.

A second walk in UTF-8 order streams the kept terms once more, now with the totals of their
sources, which come by a join: it adds up what pairs of sources share and holds, for each
source, the ten terms that stand out most.  As terms come in order, the first of equal values
stays, which settles ties.

What two sources differ by is summed over all kept terms, also over those that one of them or
both lack.  With c the count of a term, p(c) its share and f the difference, over all V terms

    sum f(pa, pb) = V * f(pa(0), pb(0))
                  + sum over a's terms of f(pa(c), pb(0)) - f(pa(0), pb(0)), and the same for b's terms
                  + sum over common terms of f(pa, pb) - f(pa, pb(0)) - f(pa(0), pb) + f(pa(0), pb(0)),

so only common terms look at pairs; the others are taken by how many terms of a source have
the same count.  All is integer arithmetic: arbitrary precision in Python, and in Spark
38-digit decimals for shares and 64 bits for f (shares are at most 10^9 + 1).

Nulls in text, lang and source count as ''.  A text without terms still makes its group occur.
Repeated rows count again.  Very long texts are read whole, in slices cut between terms.  Ids are not read; further
columns are neither read nor returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import cut

SCALE = 1_000_000_000

#: Bytes of terms (A-Z lowered, a-z, and all of non-ASCII characters) to themselves, all others to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes, slice_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists for slices of about `slice_bytes`; no term is cut."""
    at = 0
    while at < len(text):
        piece = text[at : at + slice_bytes].translate(FOLD)
        end = at + len(piece)
        if end < len(text) and piece[-1] != 32:
            # The slice may end inside of a term: go on after its last blank, or take more if it has none.
            blank = piece.rfind(b" ")
            if blank < 0:
                slice_bytes *= 2
                continue
            piece, end = piece[:blank], at + blank + 1
        yield piece.split()
        at = end


DEPTH = 3  # bytes by which the root branches; terms hold no byte 0 and no blank
NODES = "lang binary, prefix binary, terms binary, names array<binary>, sources binary, n binary, docs binary"
KEPT = "lang binary, term binary, source binary, n long"


def prefixes(terms: pa.Array) -> np.ndarray:
    """The first DEPTH bytes of each term as a number, in the order of the bytes; shorter terms end in zeros."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.append(np.frombuffer(terms.buffers()[2], np.uint8)[: offsets[-1]], np.zeros(DEPTH, np.uint8)).astype(np.int64)
    start, length = offsets[:-1], np.diff(offsets)
    code = np.zeros(len(terms), np.int64)
    for k in range(DEPTH):
        code = code << 8 | np.where(length > k, data[start + k], 0)
    return code


def nodes(lang: bytes, counters: dict[bytes, tuple[Counter, Counter]], batch: int = 5_000) -> Iterator[pa.RecordBatch]:
    """The trie of one language's counters (by source: occurrences and documents of each term), a row for each node below the root.

    A row without terms names the sources, so that those without any are known too.
    """
    names = list(counters)
    rows = [(b"", b"", names, b"", b"", b"")]
    sizes = [len(n) for n, _ in counters.values()]
    if sum(sizes):
        terms = pa.array((t for n, _ in counters.values() for t in n), pa.binary(), size=sum(sizes))
        code = prefixes(terms)
        order = np.argsort(code, kind="stable")
        code, listed = code[order], terms.take(pa.array(order)).to_pylist()
        source = np.repeat(np.arange(len(names), dtype=np.int32), sizes)[order]
        n = np.fromiter((k for n, _ in counters.values() for k in n.values()), np.int64, len(order))[order]
        docs = np.fromiter((k for n, d in counters.values() for k in map(d.__getitem__, n)), np.int64, len(order))[order]
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for a, b in pairwise(cuts):
            own, at = names, source[a:b]
            if len(names) > 64:  # only those of the node
                used, at = np.unique(at, return_inverse=True)
                own, at = [names[i] for i in used], at.astype(np.int32)
            rows.append((int(code[a]).to_bytes(DEPTH, "big"), b" ".join(listed[a:b]), own, at.tobytes(), n[a:b].tobytes(), docs[a:b].tobytes()))
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
    for i in range(0, len(rows), batch):
        part = list(zip(*rows[i : i + batch]))
        yield pa.record_batch([pa.array([lang] * len(part[0]), pa.binary()), *map(pa.array, part, kinds)], names=["lang", "prefix", "terms", "names", "sources", "n", "docs"])


def count_terms(docs: DataFrame, most_counters: int = 500_000) -> DataFrame:
    """NODES of every partition's tries; `docs` is (text, lang, source), all binary.

    The tries are sent off and emptied when they hold over `most_counters` counters, and at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, dict[bytes, tuple[Counter, Counter]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counters in seen.items():
                yield from nodes(lang, counters)
            seen.clear()

        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3))):
                n, docs = seen.setdefault(lang.as_py(), {}).setdefault(source.as_py(), (Counter(), Counter()))
                held -= len(n)
                own: set[bytes] = set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                held += len(n) + 1
                if held > most_counters:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(run, NODES)


class Container:
    """The terms below one node, merged from the containers of many tries."""

    def __init__(self, most: int) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.names: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, terms: bytes, names: list[bytes], sources: bytes, n: bytes, docs: bytes) -> None:
        listed = terms.split(b" ")
        place = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
        ids = np.fromiter(map(self.ids.__getitem__, listed), np.int64, len(listed))
        self.parts.append((ids << 24 | place[np.frombuffer(sources, np.int32)], np.frombuffer(n, np.int64), np.frombuffer(docs, np.int64)))
        self.held += len(listed)
        if self.held > self.most:
            self.parts = [self.merged()]
            self.held = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id and source, occurrences, documents), each id and source once, in order of ids."""
        key, n, docs = map(np.concatenate, zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[starts], np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)

    def walk(self, lang: bytes, least_docs: int) -> Iterator[pa.RecordBatch]:
        """The terms of enough documents, in the order of their bytes, which is that of UTF-8."""
        if not self.parts:
            return
        key, n, docs = self.merged()
        ids = key >> 24
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        good = np.add.reduceat(docs, starts) >= least_docs
        if not good.any():
            return
        terms, names = list(self.ids), pa.array(list(self.names), pa.binary())
        ends = np.append(starts[1:], len(ids))
        kept = sorted((terms[ids[a]], a, b) for a, b in zip(starts[good].tolist(), ends[good].tolist()))
        rows = np.concatenate([np.arange(a, b) for _, a, b in kept])
        term = pa.array([t for t, _, _ in kept], pa.binary()).take(pa.array(np.repeat(np.arange(len(kept)), [b - a for _, a, b in kept])))
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.record_batch([pa.array([lang] * len(part), pa.binary()), term.slice(i, len(part)), names.take(pa.array(key[part] & 0xFFFFFF)), pa.array(n[part])], names=["lang", "term", "source", "n"])


def merge_ranges(counted: DataFrame, least_docs: int, most_counters: int = 1_000_000) -> DataFrame:
    """KEPT rows of the terms of at least `least_docs` documents of a language; in UTF-8 order in each partition.

    A row with an empty term says that a source occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, now = None, None
        for batch in batches:
            for lang, prefix, terms, names, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, prefix) != now:
                    if node:
                        yield from node.walk(now[0], least_docs)
                    node, now = Container(most_counters), (lang, prefix)
                if terms:
                    node.add(terms, names, *columns)
                else:
                    yield pa.record_batch([pa.array([lang] * len(names), pa.binary()), pa.array([b""] * len(names), pa.binary()), pa.array(names, pa.binary()), pa.array([0] * len(names), pa.int64())], names=["lang", "term", "source", "n"])
        if node:
            yield from node.walk(now[0], least_docs)

    return counted.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(run, KEPT)


def share(n: int, total: int, terms: int, scale: int = SCALE) -> int:
    return 1 + (n + 2) * scale // (total + 2 * terms)


def gap(p, q):  # noqa: ANN001, ANN201
    """What two shares differ by, for whole numbers and arrays of them."""
    return (p - q) * (p - q) // (p + q)


FOUND = "lang binary, source binary, part string, item binary, value long"


def walk_pairs(kept: DataFrame, top: int, most_sources: int = 1024, most_heaps: int = 50_000) -> DataFrame:
    """FOUND rows of one UTF-8 walk of the kept terms: for 'common' what a source (smaller) and an item (another) share, in parts; for 'term' the candidates of each source.

    `kept` is (lang, term, source, n, total, lang_total, terms).  The rows of a term are together
    and terms in order; sums and heaps leave the task when there are too many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        sums = np.zeros((0, 0), np.int64)
        heaps: dict[tuple[bytes, bytes], list] = {}
        ready: list[tuple] = []
        order = 0

        def flush_sums(lang: bytes) -> None:
            names = sorted(place, key=place.get)
            for a, b in zip(*np.nonzero(sums)):
                ready.append((lang, names[a], "common", names[b], int(sums[a, b])))
            place.clear()

        def flush_heaps() -> None:
            for (lang, source), heap in heaps.items():
                ready.extend((lang, source, "term", term, value) for value, _, term in heap)
            heaps.clear()

        def term_done(lang: bytes, term: bytes, rows: list[tuple]) -> None:
            nonlocal sums, order
            order -= 1
            _, _, lang_total, terms = rows[0][1:]
            q = share(sum(r[1] for r in rows), lang_total, terms)
            p = [share(r[1], r[2], terms) for r in rows]
            for r, mine in zip(rows, p):
                if mine > q:
                    heap, entry = heaps.setdefault((lang, r[0]), []), (gap(mine, q), order, term)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            if len(heaps) > most_heaps:
                flush_heaps()
            if len(rows) < 2:
                return
            if len(place) + len(rows) > most_sources:
                flush_sums(lang)
                sums = np.zeros((0, 0), np.int64)
            at = np.array([place.setdefault(r[0], len(place)) for r in rows])
            if len(place) > len(sums):
                grown = np.zeros((2 * len(place), 2 * len(place)), np.int64)
                grown[: len(sums), : len(sums)] = sums
                sums = grown
            p_, z = np.array(p, np.int64), np.array([share(0, r[2], terms) for r in rows], np.int64)
            pc, zc = p_[:, None], z[:, None]
            delta = gap(pc, p_) - gap(pc, z) - gap(zc, p_) + gap(zc, z)
            i, j = np.triu_indices(len(rows), 1)
            sums[at[i], at[j]] += delta[i, j]

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            while len(ready) >= max(least, 1):
                part, ready[:] = ready[:50_000], ready[50_000:]
                c = list(zip(*part))
                yield pa.record_batch([pa.array(c[0], pa.binary()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.string()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.int64())], names=["lang", "source", "part", "item", "value"])

        now, rows = None, []
        for batch in batches:
            for lang, term, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, term) != now:
                    if now is not None:
                        term_done(*now, rows)
                        if lang != now[0]:
                            flush_sums(now[0])
                            sums = np.zeros((0, 0), np.int64)
                    now, rows = (lang, term), []
                rows.append(tuple(row))
            yield from emit(50_000)
        if now is not None:
            term_done(*now, rows)
            flush_sums(now[0])
        flush_heaps()
        yield from emit(0)

    return kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, FOUND)


def _share(n: Column | int, total: str, terms: str = "terms") -> Column:
    """`share` as a column; null where the language keeps no term."""
    n = F.lit(n) if isinstance(n, int) else n
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = F.nullif(F.col(total).cast("decimal(20,0)") + 2 * F.col(terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return F.call_function("div", top, under) + 1


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): by source, the distance to each other source of its language ('pair') and the terms that stand out ('term')."""
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    counted = cut(count_terms(df.select(raw(text_col).alias("text"), raw(lang_col).alias("lang"), raw(source_col).alias("source"))))
    merged = cut(merge_ranges(counted, least_docs))

    kept = merged.where(F.length("term") > 0).select("lang", "term", "source", "n")
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = merged.groupBy("lang", "source").agg(F.sum(F.when(F.length("term") > 0, F.col("n")).otherwise(0)).alias("total"))
    groups = totals.join(terms, "lang", "left").na.fill(0, ["terms", "lang_total"]).withColumn("zero", _share(0, "total"))
    groups = cut(groups)

    walked = cut(walk_pairs(kept.join(groups.drop("zero"), ["lang", "source"]).select("lang", "term", "source", "n", "total", "lang_total", "terms"), top))
    common = walked.where("part = 'common'")
    both = common.select("lang", "source", "item", "value").unionByName(common.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    # What a source's own terms add to its distance from each other source, by how many of them have the same count.
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
    alike = alike.select("lang", "source", "times", F.col("zero").alias("z"), _share(F.col("n"), "total").alias("p"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zi"), "terms")
    own = alike.join(others, "lang").where(F.col("source") != F.col("item"))
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (_gap("p", "zi") - _gap("z", "zi"))).alias("value"))
    none = groups.select("lang", "source", F.col("zero").alias("z")).join(others, "lang").where(F.col("source") != F.col("item"))
    none = none.select("lang", "source", "item", F.coalesce(F.col("terms") * _gap("z", "zi"), F.lit(0)).alias("value"))
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(own).unionByName(turned).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    said = ranked(pairs, "pair").unionByName(ranked(walked.where("part = 'term'"), "term").where(F.col("rank") <= top))
    return said.select(F.col("lang").cast("string"), F.col("source").cast("string"), "part", F.col("item").cast("string"), "value", "rank")
