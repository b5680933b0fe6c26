"""What surrounds a language model natively: candidates for an answer, the gate that checks its citations, and compaction of tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text as T

#: In order of priority.
ORIGINS = ("direct", "kg_neighbor", "evolution_chain", "cluster_member", "narrative_sibling")


def expand_candidates(parts: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """(query_id, id, origin, place): direct results and what they lead to, (query_id, id, score) by origin, each id once, up to `most`."""
    every = None
    for n, origin in enumerate(ORIGINS):
        if origin in parts:
            rows = parts[origin].select("query_id", "id", "score", F.lit(n).alias("n"))
            every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("query_id", "id").agg(F.min(F.struct("n", (-F.col("score")).alias("s"))).alias("b"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("b.n", "b.s", "id"))
    origin = F.element_at(F.array(*map(F.lit, ORIGINS)), F.col("b.n") + 1)
    return best.withColumn("place", place).where(F.col("place") <= most).select("query_id", "id", origin.alias("origin"), "place")


def contradictions(candidates: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, a, b): the first `most` pairs of a query's candidates (query_id, id, place) whose texts contradict each other; `rows` is (id, text).

    A query has a bounded list of candidates, so its pairs are few.
    """
    said = candidates.join(rows.select("id", T.stance(F.col("text")).alias("s"), T.long_words(F.col("text")).alias("w")), "id").select("query_id", "id", "place", "s", "w")
    other = said.select("query_id", F.col("id").alias("b"), F.col("place").alias("pb"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    hit = said.join(other, "query_id").where((F.col("place") < F.col("pb")) & T.opposed(F.col("s"), F.col("sb")) & F.arrays_overlap("w", "wb"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("place", "pb"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", F.col("id").alias("a"), "b")


def cited(text: Column) -> Column:
    """Ids in [src:...] marks, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[src:([^\]]+)\]"), F.lit(1)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def grounded(answers: DataFrame, least_coverage: float = 0.5, penalty: float = 0.2) -> DataFrame:
    """(query_id, answer, coverage, confidence, unknown, sources, fallback) of answers (query_id, answer, valid), `valid` being the ids that may be cited.

    Sentences that cite an unknown id go, and each such id costs confidence; what is left must
    cite a valid id in at least `least_coverage` of its sentences of over 5 characters, or the
    answer is given up.  `sources` are (id, contribution): the first sentence that cites it,
    without marks, up to 120 characters.
    """
    step = answers.withColumn("unknown", F.array_except(cited(F.col("answer")), F.col("valid")))
    # Taken out one by one, as each removal joins what is left anew.
    without = lambda t, x: F.array_join(F.filter(sentences(t), lambda s: ~s.contains(F.concat(F.lit("[src:"), x, F.lit("]")))), " ")
    step = step.withColumn("kept", F.aggregate("unknown", F.col("answer"), without))
    step = step.withColumn("s", F.filter(sentences(F.col("kept")), lambda s: F.length(s) > 5))
    backed = F.size(F.filter("s", lambda s: F.size(F.array_intersect(cited(s), F.col("valid"))) > 0))
    step = step.withColumn("coverage", F.when(F.size("s") == 0, 0.0).otherwise(backed / F.size("s")))
    ok = F.col("coverage") >= least_coverage
    trust = F.least(F.greatest(F.lit(0.0), 1 - penalty * F.size("unknown")), F.col("coverage"))
    part = lambda x: F.substring(F.trim(F.regexp_replace(F.element_at(F.filter(sentences(F.col("kept")), lambda s: s.contains(F.concat(F.lit("[src:"), x, F.lit("]")))), 1), r"\[src:[^\]]+\]", "")), 1, 120)
    sources = F.transform(F.array_intersect(cited(F.col("kept")), "valid"), lambda x: F.struct(x.alias("id"), part(x).alias("contribution")))
    empty = F.coalesce(F.trim("answer") == "", F.lit(True))
    return step.select(
        "query_id",
        F.when(ok & ~empty, F.col("kept")).alias("answer"),
        F.when(empty, 0.0).otherwise(F.col("coverage")).alias("coverage"),
        F.when(ok & ~empty, trust).otherwise(0.0).alias("confidence"),
        F.coalesce(F.size("unknown"), F.lit(0)).alias("unknown"),
        F.when(ok & ~empty, sources).otherwise(F.array().cast("array<struct<id:string,contribution:string>>")).alias("sources"),
        F.when(empty, "llm_empty").when(~ok, "low_grounding").alias("fallback"),
    )


# Tools whose output may be cleared.
CLEARABLE = ("read_file", "bash", "grep", "glob", "web_search", "web_fetch", "edit_file", "write_file", "Read", "Write", "Edit", "Bash", "Grep", "Glob", "WebSearch", "WebFetch")


def compact_tools(messages: DataFrame, session: str = "session_id", position: str = "position", preserve: int = 6, keep: int = 5) -> DataFrame:
    """`messages` (role, tool_name, text) with old tool output replaced by a note, and `freed`, the tokens that it took.

    A session's last `preserve` messages stay, and of the tool output before them the last `keep`.
    Places are counted from the end with a bound (WindowGroupLimit), so what stays is found
    without ranking a whole session: all else that may be cleared is.
    """
    back = W.partitionBy(session).orderBy(F.col(position).desc())
    places = messages.select(session, position, (F.col("role") == "tool").alias("t"), F.col("tool_name").isin(*CLEARABLE).alias("c"))
    last = places.withColumn("n", F.row_number().over(back)).where(F.col("n") <= preserve).select(session, position)
    older = places.where("t and c").join(last, [session, position], "left_anti")
    spared = older.withColumn("n", F.row_number().over(back)).where(F.col("n") <= keep).select(session, position)
    gone = older.join(spared, [session, position], "left_anti").select(session, position, F.lit(True).alias("__gone"))
    tokens = F.ceil(F.length("text") / 4).cast("long")
    note = F.concat(F.lit("[Cleared: "), "tool_name", F.lit(", ~"), tokens.cast("string"), F.lit(" tokens]"))
    out = messages.join(gone, [session, position], "left")
    cleared = F.coalesce("__gone", F.lit(False))
    return out.withColumn("freed", F.when(cleared, tokens).otherwise(0)).withColumn("text", F.when(cleared, note).otherwise(F.col("text"))).drop("__gone")
