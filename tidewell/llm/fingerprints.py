"""2. Document fingerprints by consistent weighted sampling.  DataFrame functions only.

A text's terms are its pairs of neighbouring words (the last word also alone), weighted by
how often they occur.  For each of SAMPLES samples, every term draws r and c from
Gamma(2, 1) and b from Uniform(0, 1), all from its hash, so any text draws the same; with

    t = floor(ln(weight) / r + b)        ln a = ln c - r (t - b + 1)

the term with the smallest a is sampled, together with t.  Two texts sample alike with a
chance equal to the generalised Jaccard similarity of their weighted terms.  A sample is
one long, ln a in its high and a hash of (term, t) in its low half, so "the term with the
smallest a" is a plain minimum that the hash aggregate keeps in place.

The next document, in descending id order, is found over ids alone: they are dealt by
range, each range looks ahead within itself, and one row for each range closes the gaps.
Texts are shuffled once, by document; what a document lends to the one before it is at
most a third of that one.  Terms are counted and sampled where their document already is,
and a term that a text and its edited one have as often is drawn once for the two.

Null texts count as empty; an empty text has one term of its own, so it is like another
empty text and unlike all others.  A very long text is counted whole.  Every row gets a row:
rows that repeat an id and text are one document in the order, worked out once; rows that
repeat an id with different texts are ordered by text hash.  Null ids come last.  A table
of one document is its own next one; an empty table gives an empty result.  Of terms that
draw equally small numbers the one with the smaller hash is sampled.  Further columns are
neither read nor returned.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import ID, TEXT, cut, join_counted, pick

SAMPLES = 32
NO_ID = -(1 << 63)
#: Characters of text in a partition when terms are counted.
PART_CHARS = 4_000_000


def _uniform(h: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) * (2.0**-bits)


def samples() -> list[Column]:
    """The minimum of each sample over rows (term, log_weight)."""
    out = []
    for k in range(SAMPLES):
        h = F.xxhash64("term", F.lit(k))
        g = F.xxhash64(h)
        r = -F.log(_uniform(h, 0, 32) * _uniform(h, 32, 32))
        c = -F.log(_uniform(g, 0, 22) * _uniform(g, 22, 21))
        b = _uniform(g, 43, 21)
        t = F.floor(F.col("log_weight") / r + b)
        log_a = F.log(c) - r * (t - b + 1)
        mark = F.xxhash64(h, t).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(F.min(F.shiftleft(((log_a + 96) * float(1 << 24)).cast("long"), 32).bitwiseOR(mark)).alias(f"s{k}"))
    return out


def with_next(ids: DataFrame, ranges: int) -> DataFrame:
    """`ids` (k, h, n; unique) with the key of the next document in descending order, the first after the last."""
    dealt = cut(ids.repartitionByRange(ranges, F.col("k").desc(), F.col("h").desc()).withColumn("part", F.spark_partition_id()))
    key = F.struct("k", "h")
    firsts = dealt.groupBy("part").agg(F.max(key).alias("first"))  # one row for each range
    over_all = firsts.agg(F.max("first").alias("start"))
    after = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("after")).crossJoin(F.broadcast(over_all)).select("part", F.coalesce("after", "start").alias("after"))
    ahead = F.lead(key).over(W.partitionBy("part").orderBy(F.col("k").desc(), F.col("h").desc()))
    return dealt.withColumn("ahead", ahead).join(F.broadcast(after), "part").select("k", "h", "n", F.coalesce("ahead", "after").alias("next")).select("k", "h", "n", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text is the document's with its last third replaced by the beginning of the next one's.
    """
    text = F.coalesce(TEXT, F.lit(""))
    docs = pick(df, id_col, text_col).select(F.coalesce(ID, F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    all_ids = cut(docs.select("k", "h", F.char_length("text").cast("long").alias("n")))
    rows, chars = all_ids.agg(F.count("*"), F.sum("n")).first()
    ids = cut(all_ids.groupBy("k", "h", "n").agg(F.count("*").alias("times")))
    repeated = ids.count() < rows
    if repeated:
        docs = docs.dropDuplicates(["k", "h"])

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (chars or 0) // PART_CHARS)
    order = cut(with_next(ids.select("k", "h", "n"), min(parts, 2 + rows // 100_000)))
    placed = docs.repartition(parts, "k", "h")
    third = F.floor(F.col("n") / 3).cast("int")
    wanted = order.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "n")
    lent = placed.join(wanted, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "n", F.substring("text", F.lit(1), third).alias("lent"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - third).cast("int")), F.col("lent"))
    both = placed.join(lent.repartition(parts, "k", "h"), ["k", "h"]).select("k", "h", "n", "text", edited.alias("edited"))

    # Three rows for each document: its own text, the edited one, and the edited one's digest alone.
    row = lambda side, t, sha: F.struct(F.lit(side).alias("side"), t.cast("string").alias("t"), sha.cast("string").alias("sha"))
    none = F.lit(None)
    sides = both.select("k", "h", F.explode(F.array(row(0, F.col("text"), none), row(1, F.col("edited"), none), row(2, F.lit(""), F.sha2(F.col("edited").cast("binary"), 256)))).alias("x"))
    sides = sides.select("k", "h", "x.side", "x.sha", F.split(F.lower("x.t"), r"[^\p{L}\p{N}]+").alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(1))).alias("b"))
    terms = sides.select("k", "h", "side", "sha", F.inline(pairs).alias("a", "b")).select("k", "h", "side", "sha", F.xxhash64("a", "b").alias("term"))
    # A term that both texts have as often is drawn once, for both: sides is 1 (own), 2 (edited), 3 (both) or 0 (the digest's row).
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    counted = terms.groupBy("k", "h", "sha", "term").agg(count(0).alias("n0"), count(1).alias("n1"))
    draw = lambda sides, n: F.struct(F.lit(sides).alias("sides"), F.log(n.cast("double")).alias("w"))
    once = F.array(F.struct(F.when(F.col("n0") == 0, 0).otherwise(3).alias("sides"), F.log(F.greatest("n0", F.lit(1)).cast("double")).alias("w")))
    one, other = F.array(draw(1, F.col("n0"))), F.array(draw(2, F.col("n1")))
    apart = F.when(F.col("n1") == 0, one).when(F.col("n0") == 0, other).otherwise(F.array(draw(1, F.col("n0")), draw(2, F.col("n1"))))
    draws = counted.select("k", "h", "sha", "term", F.inline(F.when(F.col("n0") == F.col("n1"), once).otherwise(apart)).alias("sides", "log_weight"))
    drawn = draws.groupBy("k", "h", "sides", "sha").agg(*samples())
    least = lambda side: [F.min(F.when(F.col("sides").bitwiseAND(F.lit(side)) > 0, F.col(f"s{k}"))).alias(f"s{side}_{k}") for k in range(SAMPLES)]
    joined = drawn.groupBy("k", "h").agg(*least(1), *least(2), F.first("sha", ignorenulls=True).alias("sha"))
    marks = lambda side: F.array(*(F.col(f"s{side}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(SAMPLES)))
    done = cut(joined.select("k", "h", marks(1).alias("own"), marks(2).alias("edited"), "sha"))

    after = done.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("own").alias("next_own"))
    found = order.join(done, ["k", "h"]).join(after, ["next_k", "next_h"])
    written = lambda c: F.concat(*(F.lpad(F.lower(F.hex(F.col(c)[k])), 8, "0") for k in range(SAMPLES)))
    alike = lambda a, b: reduce(add, ((F.col(a)[k] == F.col(b)[k]).cast("int") for k in range(SAMPLES))) / float(SAMPLES)
    found = found.select(
        "k",
        "h",
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        written("own").alias("fingerprint"),
        written("edited").alias("edited_fingerprint"),
        alike("own", "edited").alias("near_edited"),
        alike("own", "next_own").alias("near_next"),
    )
    if repeated:
        found = join_counted(all_ids.select("k", "h"), cut(found.join(ids.select("k", "h", "times"), ["k", "h"])), ["k", "h"], "times", rows).drop("times")
    return found.drop("k", "h")
