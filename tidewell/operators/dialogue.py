"""Turns of a dialogue as chunks of text, and a small bank of noise that was rejected before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vector as V
from tidewell.functions.chunking import ASSISTANT, USER, chunk_column, event_segments


def paired_turns(turns: DataFrame, session: str = "session_id", position: str = "position", own_prompts: list[str] = ()) -> DataFrame:
    """Turns without noise; one of the user and the assistant's answer right after it are one text.

    Keeps the columns of the turn that opens a text.  Ties in `position` are broken by role and text.
    """
    w = W.partitionBy(session).orderBy(position, F.desc("role"), "text")
    said = turns.where(~T.is_noise(F.col("text"), own_prompts))
    beside = said.withColumns({"__before": F.lag("role").over(w), "__after": F.lead("role").over(w), "__answer": F.lead("text").over(w)})
    opens = beside.where((F.col("role") == "user") | ~F.coalesce(F.col("__before") == "user", F.lit(False)))
    mark = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    one = F.concat(mark, F.lit(" "), "text")
    answered = (F.col("role") == "user") & F.coalesce(F.col("__after") == "assistant", F.lit(False))
    return opens.withColumn("text", F.when(answered, F.concat(one, F.lit(f"\n\n{ASSISTANT} "), "__answer")).otherwise(one)).drop("__before", "__after", "__answer")


def dialogue_chunks(turns: DataFrame, session: str = "session_id", position: str = "position", most: int = 2000) -> DataFrame:
    """The paired turns without tool noise, cut where they are longer than `most`, without what is noise by itself and with secrets redacted.

    A long text is cut into event segments (`part`), and a segment that is still too long into chunks (`piece`).
    """
    whole = paired_turns(turns, session, position).withColumn("text", T.compress_output(F.col("text")))
    others, long = [c for c in whole.columns if c != "text"], F.length("text") > most
    short = whole.where(~long).select(*others, F.lit(0).alias("part"), "text")
    cut = event_segments(whole.where(long), "text", most).select(*others, F.col("segment_no").alias("part"), F.col("segment").alias("text"))
    pieces = F.when(long, chunk_column(F.when(long, F.col("text")))).otherwise(F.array("text"))
    every = short.unionByName(cut).select(*others, "part", F.posexplode(pieces).alias("piece", "text"))
    return every.where(~T.is_noise(F.col("text"))).withColumn("text", T.redact(F.col("text")))


# What is never taken for noise.
PROTECTED = ["记住", "记一下", "记下来", "别忘了", "帮我记", "存一下", "我决定", "定了", "拍板", "纠正", "不对", "错了", "我是", "我叫", "我的名字", "我喜欢", "我不喜欢", "我偏好", "偏好", "我的生日", "我的电话", "我的地址"]
PROTECTED_EN = ["remember this", "note this", "my name", "i am", "i'm", "i prefer", "my preferences?", "i decided", "correction"]


def protected(text: Column) -> Column:
    return text.rlike("|".join(PROTECTED)) | F.lower(text).rlike(rf"(?<![\w-])(?:{'|'.join(PROTECTED_EN)})(?![\w-])")


def noise_key(text: Column) -> Column:
    """The hash under which texts count as the same: case, blanks and punctuation do not matter."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(text), r"[\s。，,.!！?？~～〜…、;；:：'\"()（）\-_]", "").cast("binary"), 256), 1, 16)


def noise_prototypes(rejected: DataFrame, at: str = "ts", id_col: str = "id", sightings: int = 2, most: int = 32) -> DataFrame:
    """(prototype_id, rank, learned_at, vector): rejected texts seen `sightings` times, the first `most` in the order of the deciding sighting.

    `rejected` has text and vector.  Only the first sightings of a text leave a task (a
    limit within the window), so a text that is most of the table is no hot key.
    """
    rows = rejected.where(~protected(F.col("text"))).withColumn("__key", noise_key(F.col("text")))
    seen = rows.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(at, id_col))).where(F.col("__n") <= sightings)
    first = seen.where(F.col("__n") == sightings).orderBy(at, "__key").limit(most)
    rank = F.row_number().over(W.orderBy(at, "__key"))  # of at most `most` rows
    return first.select(F.concat(F.lit("proto-"), F.substring("__key", 1, 8)).alias("prototype_id"), rank.alias("rank"), F.col(at).alias("learned_at"), "vector")


def match_prototypes(rows: DataFrame, prototypes: DataFrame, threshold: float = 0.93) -> DataFrame:
    """`rows` (text, vector) with prototype_id and similarity of the nearest prototype at or over the threshold; null for others and for protected texts.

    All prototypes are one row, of at most 32 vectors, that is broadcast.
    """
    bank = prototypes.agg(F.sort_array(F.collect_list(F.struct("rank", "prototype_id", "vector"))).alias("__bank"))
    scored = F.transform("__bank", lambda p: F.struct(V.cosine(F.col("vector"), p["vector"]).alias("similarity"), (-p["rank"]).alias("order"), p["prototype_id"].alias("prototype_id")))
    best = rows.join(F.broadcast(bank)).withColumn("__best", F.array_max(scored)).drop("__bank")
    hit = (F.col("__best.similarity") >= threshold) & ~protected(F.col("text"))
    return best.withColumns({"prototype_id": F.when(hit, F.col("__best.prototype_id")), "similarity": F.when(hit, F.col("__best.similarity"))}).drop("__best")
