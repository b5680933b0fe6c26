"""Queries of what is done to a request before it is searched for: scope, time, expansion, names, terms.

Every message is taken as a request, whole; the test texts are random words, so what the
rules look for is written before them, by row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import gates as G
from tidewell.queries import query
from tidewell.queries.capture import _quoted, _said, _said_sql
from tidewell.queries.memory import _conversation

Spark = SparkSession
NOW = model.NOW

# --- F2 ----------------------------------------------------------------------------------------------

_REQUEST = [
    "event_id",
    "event_id % 11 = 0 AS everywhere",
    "CASE WHEN event_id % 3 = 0 THEN concat(' ', event_type, ' ') WHEN event_id % 3 = 1 THEN '  ' END AS scope",
    "CASE WHEN event_id % 5 < 2 THEN concat(user_id, ' ') WHEN event_id % 5 = 2 THEN ' ' END AS session",
    "CASE WHEN event_id % 7 < 4 THEN 'main' END AS home",
]


@query(
    "F2_scope",
    f"""WITH r AS (SELECT {", ".join(_REQUEST)} FROM events)
    SELECT event_id, 'all_scopes' AS source, NULL AS scope FROM r WHERE everywhere
    UNION ALL SELECT event_id, 'scope', trim(scope) FROM r WHERE NOT everywhere AND length(trim(scope)) > 0
    UNION ALL SELECT event_id, 'session', 'session:' || trim(session) FROM r WHERE NOT everywhere AND length(trim(coalesce(scope, ''))) = 0 AND length(trim(session)) > 0
    UNION ALL SELECT event_id, CASE WHEN home IS NULL THEN 'none' ELSE 'default' END, home FROM r WHERE NOT everywhere AND length(trim(coalesce(scope, ''))) = 0 AND length(trim(coalesce(session, ''))) = 0""",
)
def f2(spark: Spark, d: str) -> DataFrame:
    asked = model.table(spark, d, "events").selectExpr(*_REQUEST)
    return asked.select("event_id", G.scope_of("everywhere", "scope", "session", "home").alias("s")).select("event_id", "s.source", "s.scope")


# --- F7 ----------------------------------------------------------------------------------------------

_PHRASES = ["after:2024-03 ", "before:2023-12 ", "2023年5月 ", "January 2024 ", "in 2022 ", "last 2 weeks ", "yesterday ", "today ", "last month ", ""]
_DAY = f"date_trunc('day', make_timestamp({NOW} * 1000))"
_BOUNDS = [
    ("DATE '2024-03-01'", None), (None, "DATE '2023-12-01'"), ("DATE '2023-05-01'", "DATE '2023-06-01'"), ("DATE '2024-01-01'", "DATE '2024-02-01'"), ("DATE '2022-01-01'", "DATE '2023-01-01'"),
    (f"{_DAY} - INTERVAL 14 DAY", "now"), (f"{_DAY} - INTERVAL 1 DAY", _DAY), (_DAY, "now"), (f"{_DAY} - INTERVAL 30 DAY", "now"), (None, None),
]


def _bound(k: int, shift: str) -> str:
    value = lambda b: "NULL" if b is None else str(NOW) if b == "now" else f"epoch_ms(CAST({b} AS TIMESTAMP)){shift}"
    return "CASE (conv_id + turn) % 10 " + " ".join(f"WHEN {i} THEN {value(b[k])}" for i, b in enumerate(_BOUNDS)) + " END"


@query(
    "F7_temporal",
    f"""SELECT conv_id, turn, CAST({_bound(0, "")} AS BIGINT) AS first_ms, CAST({_bound(1, " - 1")} AS BIGINT) AS last_ms,
    md5(CASE WHEN (conv_id + turn) % 10 = 9 THEN text ELSE regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') END) AS digest FROM conversations""",
)
def f7(spark: Spark, d: str) -> DataFrame:
    @F.pandas_udf("first_ms long, last_ms long, rest string")
    def parse(text: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([G.parse_temporal(t, NOW) for t in text], columns=["first_ms", "last_ms", "rest"])
        return found.astype({"first_ms": "Int64", "last_ms": "Int64"})

    asked = _said(spark, d, _PHRASES).select("conv_id", "turn", parse("text").alias("p"))
    return asked.select("conv_id", "turn", "p.first_ms", "p.last_ms", F.md5(F.col("p.rest").cast("binary")).alias("digest"))


# --- T5, T7 ------------------------------------------------------------------------------------------

_ALIASES = {"wh": ["whole", "Which"], "ion": ["union"]}
_SYNONYMS = {"the": ["that one"], "and": ["plus", "also"], "of": ["from which"], "to": ["towards"]}
_MORE = ", ".join(
    [f"CASE WHEN contains(low, {_quoted(t)}) THEN {_quoted(e)} END" for t, es in _ALIASES.items() for e in es]
    + [f"CASE WHEN regexp_matches(low, {_quoted(rf'\b{t}\b')}) THEN {_quoted(e)} END" for t, es in _SYNONYMS.items() for e in es]
)


@query(
    "T5_expand",
    f"""WITH l AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations),
    f AS (SELECT *, list_filter([{_MORE}], lambda x: x IS NOT NULL AND NOT contains(low, lower(x)))[1:3] AS more FROM l)
    SELECT conv_id, turn, md5(CASE WHEN len(more) = 0 THEN text ELSE concat(text, ' ', array_to_string(more, ' ')) END) AS digest, len(more) AS added FROM f""",
)
def t5(spark: Spark, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def expand(text: pd.Series) -> pd.Series:
        return text.map(lambda t: G.expand_query(t, _ALIASES, _SYNONYMS, 3))

    asked = _conversation(spark, d).withColumn("longer", expand("text"))
    terms = [e for m in (_ALIASES, _SYNONYMS) for es in m.values() for e in es]
    tail = F.expr("substring(longer, length(text) + 1)")
    added = sum((F.contains(tail, F.lit(e)).cast("long") for e in terms), F.lit(0).cast("long"))
    return asked.select("conv_id", "turn", F.md5(F.col("longer").cast("binary")).alias("digest"), added.alias("added"))


_NAMES = {"wh": "Which", "the wh": "The Which", "be": "bee$1", "小李": "李明", "李": "黎"}
_FIRST = ["小李 said the wh ", "李 and The WH. ", "Be be-be "]


@query(
    "T7_entities",
    f"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '\\bthe wh\\b', 'The @', 'gi') AS t FROM ({_said_sql(_FIRST)}) s),
    b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\\bbe\\b', 'bee$1', 'gi'), '\\bwh\\b', 'Which', 'gi') AS t FROM a)
    SELECT conv_id, turn, md5(replace(replace(replace(t, '小李', '李明'), '李', '黎'), '@', 'Which')) AS digest FROM b""",
)
def t7(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d, _FIRST).select("conv_id", "turn", F.md5(G.resolve_entities(F.col("text"), _NAMES).cast("binary")).alias("digest"))


# --- X8 ----------------------------------------------------------------------------------------------

_TOPICS = ["检索系统的设计文档 ", "记忆 和 recall.md ", "a/b-c 数据库 ", ""]
_EDGE = _quoted(G.EDGE)
_GRAMS = f"list_filter(flatten(list_transform([2, 3], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)))), lambda g: NOT contains({_EDGE}, g[1]) AND NOT contains({_EDGE}, g[-1]))"


@query(
    "X8_terms",
    f"""WITH m AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[一-鿿㐀-䶿]{{2,}}|[a-z0-9._/-]{{3,}}') AS a FROM ({_said_sql(_TOPICS)}) s),
    g AS (SELECT conv_id, turn, flatten(list_transform(a, lambda t: CASE WHEN regexp_matches(t, '^[^a-z0-9._/-]') AND length(t) > 4 THEN list_concat([t], {_GRAMS}) ELSE [t] END)) AS a FROM m)
    SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:40], ' ') AS terms FROM g""",
)
def x8(spark: Spark, d: str) -> DataFrame:
    return _said(spark, d, _TOPICS).select("conv_id", "turn", F.array_join(G.terms(F.col("text")), " ").alias("terms"))
