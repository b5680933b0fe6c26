"""5. Mixing sources to target weights by subset-sum budget fitting.

1. Words per document are counted once and kept (id, source, size).
2. Sources, in code point order with null last, weigh 5, 2, 1, 5, ... and share
   all words; a source's target stops at three times its size and what is over
   is shared again by weight.  Sources stay a table: each round of sharing brings
   two sums to the driver, however many sources there are.
3. A source is repeated floor(target / size) times; what is left of its target
   is a budget.  Documents are counted by exact length.  The budget first takes the
   same share of every length and fills up from the longest down; then a
   bounded-knapsack dynamic program over reachable sums mends that start, by taking
   documents back and putting others in, until the budget is met as nearly as any
   choice can (`fit` says why).
4. Of each (source, length) the documents with the smallest seeded hash of id and text
   are taken.  A third of all rows may have one source and length, so counts by the
   hash's top bits decide whole parts at once, and only the part in which the cut falls
   is looked at more closely (`first_rows`).

Nulls and texts without words have size 0 and are taken 0 times; a very long text is one
number.  Rows that repeat an id and text are separate documents; which of two equal rows
is taken cannot be told apart.  An empty table gives an empty result, and a source of
size 0 has target 0.  The same rows in any order and partitioning give the same result.
Further columns are neither read nor returned.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import ID, ROW, TEXT, cut, first_rows, join_counted, pick

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` (source, ...) with their place in code point order, null last; no task sees all of them."""
    order = (F.col("source").isNull(), F.col("source"))
    dealt = cut(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    before = ends.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "part").withColumn("place", place).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """`sources` (source, source_size, ...) with `target`: its weight's share of all words, none above `most` times its size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = cut(numbered(sources).withColumn("weight", weight))
    total, share, full = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, F.col("source_size") * most
    while total:
        over = F.col("weight") * F.lit(share) > full
        capped, shares = s.agg(F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        new = (total - capped) / shares if shares else share
        if new <= share:
            break
        share = new
    return s.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), full.cast("double"))).drop("place", "weight")


def best_sum(lengths: dict[int, int], most: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to `most` of at most the given number of each length, and how many of each make it.

    A bounded-knapsack program over reachable sums: a length's number is split into powers
    of two, and each sum keeps the first step that reached it.
    """
    by = np.full(most + 1, -1, np.int32)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for n in sorted(lengths):
        spare, k = min(lengths[n], most // n), 1
        while spare > 0 and not reached[most]:
            k = min(k, spare)
            new = np.flatnonzero(reached[: most + 1 - n * k] & ~reached[n * k :]) + n * k
            by[new], reached[new] = len(steps), True
            steps.append((n, k))
            spare, k = spare - k, 2 * k
    at = top = int(np.flatnonzero(reached)[-1])
    take = dict.fromkeys(lengths, 0)
    while at:
        n, k = steps[by[at]]
        take[n] += k
        at -= n * k
    return top, take


def fit(lengths: dict[int, int], budget: float) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near under `budget` as any choice can.

    The start takes the same share of each length, then fills from the longest down, so it
    is within L, the longest length, of the budget.  It is mended by giving back up to `per`
    documents of each of the `kinds` shortest lengths and taking as many that were left out,
    and the program finds the best sum of these; both numbers grow until the budget is met.
    With 2L documents of every length no better choice exists: the changes to the nearest
    best choice, ordered so that their sum stays within L of nought, number at most 2L, for
    among more some would cancel out.
    """
    whole, total = int(budget + 1e-9), sum(n * c for n, c in lengths.items())
    if whole >= total:
        return dict(lengths)
    unit = gcd(*lengths)
    goal, count = whole // unit, {n // unit: c for n, c in lengths.items()}
    take = {n: c * whole // total for n, c in count.items()}
    left = goal - sum(n * k for n, k in take.items())
    for n in sorted(count, reverse=True):
        k = min(count[n] - take[n], left // n)
        take[n] += k
        left -= n * k
    kinds, per, enough = 64, 4, 2 * max(count)
    order = sorted(count)
    while left:
        back = {n: min(take[n], per) for n in order[:kinds]}
        pool = {n: k + min(count[n] - take[n], per) for n, k in back.items()}
        most = left + sum(n * k for n, k in back.items())
        top, found = best_sum(pool, most)
        left = most - top
        take |= {n: take[n] - back[n] + found[n] for n in pool}
        if not left or (kinds >= len(order) and per >= min(enough, max(count.values()))):
            break
        kinds, per = kinds * 4, per * 4
    return {n * unit: k for n, k in take.items()}


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    h = F.xxhash64(F.col(ID), F.col(TEXT), F.lit(seed))
    sized = cut(
        pick(df, id_col, text_col, __source=source_col).select(
            F.monotonically_increasing_id().alias(ROW),
            F.col(ID),
            F.when(F.col("__source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("__source").cast("string"))).alias("key"),
            F.coalesce(F.regexp_count(F.col(TEXT), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            h.alias("h"),
        )
    )
    total = sized.count()
    counted = cut(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    by_source = counted.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    source = F.when(F.col("key") == "-", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30)).alias("source")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = cut(targets(by_source.select("key", source, "source_size", "rows"), weights).withColumn("copies", copies).select("key", "source_size", "target", "copies", "rows"))

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The lengths of one source; there are at most as many as words in its longest text."""
        take = fit(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), rows["budget"].iloc[0])
        return pd.DataFrame({"key": key[0], "size": list(take), "wanted": list(take.values())})

    budgets = counted.where("size > 0").join(plan, "key").select("key", "size", "n", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    wanted = budgets.groupBy("key").applyInPandas(fitted, "key string, size long, wanted long")
    groups = cut(counted.join(wanted, ["key", "size"], "left").join(plan.drop("rows"), "key").withColumn("wanted", F.coalesce("wanted", F.lit(0).cast("long"))))

    bits = min(16, max(6, (total // 50_000).bit_length()))
    rows = cut(join_counted(sized, groups, ["key", "size"], "n", total).withColumns({"part": F.shiftrightunsigned("h", 64 - bits), "task": F.shiftrightunsigned(ROW, 33)}).drop("n"))
    chosen = first_rows(rows, ["key", "size"], "wanted", ["part", "h", "task", ROW], total)
    return chosen.select(F.col(ID).alias("doc_id"), "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("chosen").cast("long"))).alias("taken"))
