"""Likeness of sets (of facts, of words) by prefix filtering, exactly.

Items are put in order of rarity.  Two sets of a Jaccard similarity t or more must share an
item among the first n - ceil(t n) + 1 of each, so only those prefixes are joined: what half
of all sets hold stands last in them and joins nothing.  Equal sets are one class, so
copies make no pairs.  Candidates of fitting sizes are then checked on their whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.graph import materialise


def set_classes(items: DataFrame, least: int = 1) -> DataFrame:
    """(id, class, items, n) of each id with `least` items or more: its items, rarest first, and the smallest id with the same ones.

    `items` is (id, item); a set is a row, so sets should be of what one thing holds.
    """
    rows = items.select("id", "item").distinct()
    rarity = rows.groupBy("item").agg(F.count("*").alias("df"))
    ordered = rows.join(rarity, "item").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("items")).withColumn("n", F.size("items"))
    ordered = ordered.where(F.col("n") >= least).withColumns({"h1": F.xxhash64("items"), "h2": F.xxhash64(F.lit(1), "items")})
    firsts = ordered.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    return ordered.join(firsts, ["h1", "h2"]).select("id", "class", "items", "n")


def jaccard(a: Column, b: Column, na: Column, nb: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (na + nb - common)


def similar_sets(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of different sets of at least that similarity, each set by its class; `classes` is of set_classes().

    A threshold of 0 asks for every pair with a common item.
    """
    own = materialise(classes.where("id = class").select("id", "items", "n"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    heads = own.select("id", "n", F.explode(F.slice("items", F.lit(1), prefix)).alias("item"))
    left, right = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "item"), heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "item")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    pairs = left.join(right, "item").where(fits).select("a", "b").distinct()
    side = lambda x: own.select(F.col("id").alias(x), F.col("items").alias(f"i{x}"), F.col("n").alias(f"n{x}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    return whole.withColumn("jaccard", jaccard(F.col("ia"), F.col("ib"), F.col("na"), F.col("nb"))).where(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "jaccard")


def jaccard_by_band(pairs: DataFrame, items: DataFrame, bands: list[tuple[str, float, float]], least: int = 2, marks: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """(band, seen, thin, measured, mean, p50, p90, most, over_...) of pairs (a, b, score): how alike the fact sets of pairs of a score are.

    A pair is thin if a side has fewer than `least` items.  Percentiles are exact: pairs are
    counted by their similarity first, of which there are few, and only the counts are ordered.
    """
    sets = items.select("id", "item").distinct().groupBy("id").agg(F.collect_list("item").alias("items")).withColumn("n", F.size("items"))
    side = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"i{x}"), F.col("n").alias(f"n{x}"))
    band = F.lit(None).cast("string")
    for name, low, high in bands:
        band = F.when((F.col("score") >= low) & (F.col("score") < high), name).otherwise(band)
    named = pairs.withColumn("band", band).where("band is not null").join(side("a"), "a", "left").join(side("b"), "b", "left")
    thin = (F.coalesce("na", F.lit(0)) < least) | (F.coalesce("nb", F.lit(0)) < least)
    measured = named.withColumn("j", F.when(~thin, F.round(jaccard(F.col("ia"), F.col("ib"), F.col("na"), F.col("nb")), 9)))
    counted = measured.groupBy("band", "j").agg(F.count("*").alias("c"))
    w = W.partitionBy("band").orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = W.partitionBy("band")
    ranked = counted.where("j is not null").withColumns({"to": F.sum("c").over(w), "all": F.sum("c").over(total)})
    at = lambda p: F.min(F.when(F.col("to") > F.least(F.col("all") - 1, F.floor(F.lit(p) * F.col("all"))), F.col("j")))
    over = [F.sum(F.when(F.col("j") >= m, F.col("c")).otherwise(0)).alias(f"over_{str(m).replace('.', '_')}") for m in marks]
    stats = ranked.groupBy("band").agg(F.sum("c").alias("measured"), (F.sum(F.col("j") * F.col("c")) / F.sum("c")).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("j").alias("most"), *over)
    seen = counted.groupBy("band").agg(F.sum("c").alias("seen"), F.sum(F.when(F.col("j").isNull(), F.col("c")).otherwise(0)).alias("thin"))
    return seen.join(stats, "band", "left").na.fill(0, ["measured", *(f"over_{str(m).replace('.', '_')}" for m in marks)])
