"""Clusters as mergeable sums, and what is worth promoting.

The reference rule, a running mean that each row joins or not, depends on the order of all
rows and so on one task.  Here clusters come from an order-independent rule: the first rows
that are not near to an earlier one are centers and the others go to the nearest center
(`similar.first_centers` gives the centers); a cluster is then carried as (n, sum of vectors,
sums of what is asked), which partial aggregation merges, so no task sees a whole topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scoring as S
from tidewell.functions import vector as V
from tidewell.operators.graph import materialise
from tidewell.operators.similar import first_centers, near_pairs, oriented, vector_classes


SUMMED = 32  # elements of a vector that one row of sums has


def clusters(df: DataFrame, least_cos: float, group: list[str], order: list[Column], recall: float = 0.9999) -> DataFrame:
    """(group, id, center, cos): every row with a vector and the center that it belongs to, the nearest of those near enough, ties by order.

    Rows come in `order` and then by id.
    """
    keys = {f"__s{i}": c for i, c in enumerate(order)}
    rows = materialise(vector_classes(df.select("id", *group, "vector", *(c.alias(k) for k, c in keys.items())), group, [F.col(k) for k in keys]).withColumn("o", F.struct(*keys, "id")).where("vector is not null"))
    own = rows.where("id = first")
    edges = materialise(oriented_with_cos(near_pairs(own, least_cos, group, recall), own))
    passed = first_centers(edges.select("early", "late", "o")).select("id")
    both = edges.select("early", "late", "cos", "o").unionByName(edges.select(F.col("late").alias("early"), F.col("early").alias("late"), "cos", F.col("o2").alias("o")))
    links = both.join(passed.withColumnRenamed("id", "late"), "late", "left_semi").join(passed.withColumnRenamed("id", "early"), "early", "left_anti")
    best = links.groupBy("late").agg(F.min(F.struct((-F.round("cos", 9)).alias("c"), "o", "early")).alias("b"))
    of = best.select(F.col("late").alias("first"), F.col("b.early").alias("center"), (-F.col("b.c")).alias("cos"))
    return rows.join(of, "first", "left").select(*group, "id", F.coalesce("center", "first").alias("center"), F.coalesce("cos", F.lit(1.0)).alias("cos"))


def oriented_with_cos(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """`similar.oriented` with the pair's cosine and the later row's place `o2`."""
    one, two = rows.select(F.col("id").alias("a"), F.col("o").alias("oa")), rows.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    early = F.col("oa") < F.col("ob")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    return pairs.join(one, "a").join(two, "b").select(pick("a", "b").alias("early"), pick("b", "a").alias("late"), pick("oa", "ob").alias("o"), pick("ob", "oa").alias("o2"), "cos")


def cluster_sums(df: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """(group, center, n, tightness, importance, reads, readers) of each cluster, from sums that merge.

    `tightness` is the mean cosine over the pairs of its members, by the square of the sum of
    their unit vectors, whose elements are summed `SUMMED` to a row.
    """
    rows = members.select("id", "center", *group).join(df.select("id", V.unit("vector").alias("u"), "importance", "reads", "readers"), "id")
    pieces = rows.where("size(u) > 0").select(*group, "center", F.explode(F.sequence(F.lit(0), F.size("u") - 1, F.lit(SUMMED))).alias("pos"), "u")
    summed = pieces.groupBy(*group, "center", "pos").agg(*(F.sum(F.get("u", F.col("pos") + k)).alias(f"s{k}") for k in range(SUMMED)))
    squares = sum((F.coalesce(F.col(f"s{k}") * F.col(f"s{k}"), F.lit(0.0)) for k in range(SUMMED)), F.lit(0.0))
    square = summed.groupBy(*group, "center").agg(F.sum(squares).alias("square"))
    sums = rows.groupBy(*group, "center").agg(F.count("*").alias("n"), F.avg("importance").alias("importance"), F.sum("reads").alias("reads"), F.max("readers").alias("readers"))
    tight = F.when(F.col("n") > 1, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return sums.join(square, [*group, "center"]).withColumn("tightness", tight).drop("square")


def case_candidates(sums: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of cases that make a pattern, with the confidence that their number and readers give."""
    return sums.where(F.col("n") >= least).withColumn("confidence", S.read_boost(S.smoothed_confidence(F.col("n")), F.col("readers")))


def support_of(patterns: DataFrame, cases: DataFrame, least_cos: float, group: list[str], recall: float = 0.9999) -> DataFrame:
    """(id, case_id): the cases of its group that each pattern is near to; both sides are (id, vector, group) and share no id.

    Equal vectors of a group are one while candidates are found.
    """
    tag = lambda df, kind: df.select("id", "vector", *group, F.lit(kind).alias("kind"))
    rows = materialise(vector_classes(tag(patterns, "p").unionByName(tag(cases, "c")), group, [F.col("id")]))
    firsts = rows.where("id = first and vector is not null")
    near = near_pairs(firsts, least_cos, group, recall).select("a", "b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(firsts.select(F.col("id").alias("a"), F.col("id").alias("b")))
    p, c = rows.where("kind = 'p'").select("id", F.col("first").alias("a")), rows.where("kind = 'c'").select(F.col("id").alias("case_id"), F.col("first").alias("b"))
    return both.join(p, "a").join(c, "b").select("id", "case_id")


# Words that say nothing about a draft.
EMPTY_WORDS = (
    "the and for with that this from will then into when what where your user agent null true "
    "false none let new old use used have has its not any can does only just like please step "
    "steps body title summary task tasks run see end our their them being make made thing things"
).split()


def draft_tokens(text: Column) -> Column:
    """Latin tokens of 4 characters or more and pairs of neighbouring Han or kana characters, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9_][a-z0-9_./-]{3,})"), F.lit(1)), lambda w: ~w.isin(EMPTY_WORDS))
    runs = F.regexp_extract_all(low, F.lit("([一-鿿぀-ヿ㐀-䶿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def tools_of(text: Column) -> Column:
    """Names on a text's first line `Tools: a, b`, in lower case."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|\n)Tools:\s*([^\n]+)", 1)
    return F.array_distinct(F.filter(F.transform(F.split(line, ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def verify_patterns(patterns: DataFrame, cases: DataFrame, support: DataFrame, least_support: int = 2, least_coverage: float = 0.5, least_resonance: float = 0.5) -> DataFrame:
    """(id, cases, coverage, resonance, ok, confidence) of each pattern with enough cases near to it.

    `patterns` and `cases` are (id, text, readers), `support` (id, case_id).  coverage is the
    share of a pattern's tools that its cases name (1 without tools), resonance that of its
    cases that share two tokens with it.  What fails is marked, not left out.
    """
    draft = patterns.select("id", tools_of(F.col("text")).alias("tools"), draft_tokens(F.col("text")).alias("tokens"), "readers")
    case = cases.select(F.col("id").alias("case_id"), tools_of(F.col("text")).alias("case_tools"), draft_tokens(F.col("text")).alias("case_tokens"), F.col("readers").alias("case_readers"))
    pairs = materialise(support.join(draft, "id").join(case, "case_id"))
    hits = pairs.withColumn("hit", (F.size(F.array_intersect("tokens", "case_tokens")) >= 2).cast("int"))
    g = hits.groupBy("id").agg(F.count("*").alias("cases"), F.avg("hit").alias("resonance"), F.greatest(F.max("readers"), F.max("case_readers")).alias("readers"), F.first(F.size("tools")).alias("claimed")).where(F.col("cases") >= least_support)
    named = pairs.select("id", "tools", F.explode("case_tools").alias("tool")).where(F.array_contains("tools", F.col("tool"))).groupBy("id").agg(F.count_distinct("tool").alias("named"))
    coverage = F.when(F.col("claimed") == 0, 1.0).otherwise(F.coalesce("named", F.lit(0)) / F.col("claimed"))
    out = g.join(named, "id", "left").withColumn("coverage", coverage)
    ok = (F.col("coverage") >= least_coverage) & (F.col("resonance") >= least_resonance)
    return out.select("id", "cases", "coverage", "resonance", ok.alias("ok"), S.read_boost(S.smoothed_confidence(F.col("cases")), F.col("readers")).alias("confidence"))
