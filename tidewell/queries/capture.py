"""Queries of what is captured from texts, dialogue chunks, adapters and exports.

The test texts are random words, so what the operators look for is written before them;
which row gets what follows from its ids, and every row takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import model
from tidewell.functions import capture as C
from tidewell.operators import dialogue
from tidewell.queries import query
from tidewell.queries.memory import N, _conversation, _noise_sql, memories, notes
from tidewell.sources import adapters, readers

Spark = SparkSession
NOW = model.NOW


def _leads(leads: list[str], by: str) -> Column:
    return F.get(F.array(*map(F.lit, leads)), (F.expr(by) % len(leads)).cast("int"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _leads_sql(leads: list[str], by: str) -> str:
    return f"list_extract([{', '.join(map(_quoted, leads))}], CAST(({by}) % {len(leads)} AS INT) + 1)"


def _said(spark: Spark, d: str, leads: list[str]) -> DataFrame:
    return _conversation(spark, d).withColumn("text", F.concat(_leads(leads, "conv_id + turn"), "text"))


def _said_sql(leads: list[str]) -> str:
    return f"SELECT conv_id, turn, role, concat({_leads_sql(leads, 'conv_id + turn')}, text) AS text FROM conversations"


# --- T19, T27 ----------------------------------------------------------------------------------------

_SIGNALS = [
    "I prefer short texts here. ", "Actually, that is wrong now. ", "Actually, that is wrong now. Actually, it is not so. ", "We decided to go on with it? ", "Remember that we go on! ",
    "以后记得这个地方的规则。", "My name is not known.\n", "", "Actually, no. Correction: the limit is two. Actually, it is three. I like it that way. I love it all. I hate it now. I need it here. I want it too. ",
]
_CASE = " ".join(f"WHEN regexp_matches(s, {_quoted('(?i)' + p)}) THEN {k}" for k, (_, p, *_r) in enumerate(C.SIGNALS))


@query(
    "T19_capture",
    f"""WITH m AS ({_said_sql(_SIGNALS)}),
    l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > CASE WHEN regexp_matches(text, '[一-鿿぀-ゟ゠-ヿ가-힯]') THEN 6 ELSE 15 END) AS a FROM m),
    s AS (SELECT conv_id, turn, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS s FROM l),
    g AS (SELECT *, CASE {_CASE} END AS g, lead(s) OVER w AS after FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
    r AS (SELECT *, k - 1 - coalesce(max(CASE WHEN g IS DISTINCT FROM 3 THEN k END) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS position FROM r WHERE g IS NOT NULL AND run % 2 = 0)
    SELECT conv_id, turn, position, {_leads_sql([x[0] for x in C.SIGNALS], 'g')} AS signal, CASE WHEN g = 3 AND after IS NOT NULL THEN concat(s, '. ', after) ELSE s END AS text FROM n WHERE position <= {C.MOST_ITEMS}""",
)
def t19(spark: Spark, d: str) -> DataFrame:
    items = _said(spark, d, _SIGNALS).select("conv_id", "turn", F.posexplode(C.captured_items(F.col("text"))).alias("p", "i"))
    return items.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("position"), "i.signal", "i.text")


_SLOT_NAMES = ["bun", "nodejs", "ripgrep", "nvim"]


@query(
    "T27_slots",
    """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, lower(replace(p_name, ' ', '')) AS item, concat('maker', CAST(p_partkey % 25 AS VARCHAR)) AS maker FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 'brand-item' WHEN 1 THEN 'tool-choice' WHEN 2 THEN 'reply-style' WHEN 3 THEN 'implicit-usage' WHEN 4 THEN 'brand-item' END AS type,
    CASE WHEN k IN (0, 4) THEN maker END AS brand, CASE k WHEN 0 THEN item WHEN 4 THEN '茶' END AS item,
    CASE k WHEN 2 THEN 'concise|direct' END AS traits, CASE k WHEN 1 THEN list_extract(['bun', 'node', 'rg', 'neovim'], CAST(p_partkey % 4 AS INT) + 1) END AS preferred_tool,
    CASE k WHEN 1 THEN 'npm' END AS avoided_tool, CASE k WHEN 3 THEN substring(item, 1, 12) END AS subject FROM p""",
)
def t27(spark: Spark, d: str) -> DataFrame:
    p = model.table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 6).alias("k"), F.concat(F.lit("maker"), (F.col("p_partkey") % 25).cast("string")).alias("maker"))
    word = F.substring(F.lower(F.regexp_replace("p_name", " ", "")), 1, 12)
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit("I really like the "), "p_name", F.lit(" from "), F.regexp_replace("maker", "maker", "Maker "), F.lit("!")))
        .when(F.col("k") == 1, F.concat(F.lit("[用户] I prefer "), _leads(_SLOT_NAMES, "p_partkey"), F.lit("  over NPM.")))
        .when(F.col("k") == 2, F.lit("Please be brief and to the point"))
        .when(F.col("k") == 3, F.concat(F.lit("These days I am using "), word, F.lit(" for work")))
        .when(F.col("k") == 4, F.concat(F.lit("我喜欢"), "maker", F.lit("的茶")))
        .otherwise(F.concat(F.lit("Nothing is said about the "), "p_name"))
    )
    s = p.withColumn("s", C.preference_slot(text))
    return s.select("p_partkey", "s.type", "s.brand", "s.item", F.when(F.col("s.traits").isNotNull(), F.array_join("s.traits", "|")).alias("traits"), "s.preferred_tool", "s.avoided_tool", "s.subject")


# --- T28, T26, T31 -----------------------------------------------------------------------------------

_CUT = "string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _citing() -> Column:
    cite = F.concat(F.lit("See [src:"), F.col("i").cast("string"), F.lit("] and [src:"), (F.col("i") % 10).cast("string"), F.lit("]. No. As [src:x"), F.col("i").cast("string"), F.lit("] has it, all is said! "))
    return F.concat(cite, "text")


_CITING = "concat('See [src:', i, '] and [src:', i % 10, ']. No. As [src:x', i, '] has it, all is said! ', text)"


@query(
    "T28_citations",
    f"""{N}, c AS (SELECT id, i, {_CITING} AS t FROM notes), s AS (SELECT id, i, t, list_filter({_CUT}, lambda x: length(x) > 5) AS s FROM c)
    SELECT id, array_to_string(list_distinct(list_sort(regexp_extract_all(t, '\\[src:([^\\]]+)\\]', 1))), '|') AS cited,
    round(len(list_filter(s, lambda x: contains(x, concat('[src:', i, ']')))) / len(s)::DOUBLE, 6) AS coverage,
    md5(array_to_string(list_filter({_CUT}, lambda x: NOT contains(x, concat('[src:x', i, ']'))), ' ')) AS rest FROM s""".replace(
        "array_to_string(list_distinct(list_sort(", "array_to_string(list_sort(list_distinct("
    ),
)
def t28(spark: Spark, d: str) -> DataFrame:
    c = notes(spark, d).withColumn("t", _citing())
    return c.select(
        "id",
        F.array_join(F.array_sort(C.cited_ids(F.col("t"))), "|").alias("cited"),
        F.round(C.source_coverage(F.col("t"), F.array(F.col("i").cast("string"))), 6).alias("coverage"),
        F.md5(C.without_citation(F.col("t"), F.concat(F.lit("x"), F.col("i").cast("string"))).cast("binary")).alias("rest"),
    )


@query(
    "T28_lexical_coverage",
    f"""{N}, s AS (SELECT id, list_filter({_CUT.replace("(t,", "(text,")}, lambda x: length(x) > 5) AS s, list_filter(regexp_split_to_array(lower(substring(text, 1, 300)), '\\s+'), lambda w: length(w) > 2) AS k FROM notes),
    u AS (SELECT id, k, len(s) AS n, unnest(s) AS x FROM s), w AS (SELECT id, k, n, list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: length(w) > 2) AS w FROM u)
    SELECT id, round(count(*) FILTER (len(w) > 0 AND len(list_filter(w, lambda y: list_contains(k, y))) / len(w)::DOUBLE > 0.3) / max(n)::DOUBLE, 6) AS coverage FROM w GROUP BY id""",
)
def t28b(spark: Spark, d: str) -> DataFrame:
    """Each note against its own beginning as the source; notes without a sentence have no row."""
    rows = notes(spark, d).where(F.exists(F.split("text", C._ENDS), lambda s: F.length(s) > 5))
    return rows.select("id", F.round(C.lexical_coverage(F.col("text"), F.array(F.substring("text", 1, 300))), 6).alias("coverage"))


_OPENINGS = ["[用户] ", "OK, this is understood by all! ", "好的。", "Thanks for all of this work. ", "No. ", ""]


@query(
    "T26_abstract",
    f"""WITH m AS ({_said_sql(_OPENINGS)}), c AS (SELECT *, regexp_replace(regexp_replace(text, '(?m)^\\[(用户|助手)\\]\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM m),
    s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([。！？.!?\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 15 AND NOT regexp_matches(x, '^(好的|OK|是的|嗯|谢谢|Thanks)')) AS s FROM c)
    SELECT conv_id, turn, substring(coalesce(list_extract(s, 1), t), 1, 150) AS abstract, CASE WHEN turn % 2 = 0 THEN 'stored' ELSE substring(text, 1, 200) END AS excerpt FROM s""",
)
def t26(spark: Spark, d: str) -> DataFrame:
    stored = F.when(F.col("turn") % 2 == 0, F.lit("stored")).otherwise(F.lit(""))
    return _said(spark, d, _OPENINGS).select("conv_id", "turn", C.abstract(F.col("text")).alias("abstract"), C.excerpt(stored, F.col("text")).alias("excerpt"))


_PLANS = ["Steps:\n1. go\n2. come\nTools: git, bun,, rg \n", "1. go there\n 2. come back\n", "Step 1 is to go.\n", "## Steps\n- go\n- come\n", ""]


@query(
    "T31_steps",
    f"""WITH m AS ({_said_sql(_PLANS)}), s AS (SELECT *, regexp_extract(text, '(?i)(?:^|\\n)\\s*(?:Steps?:|##?\\s*Steps?)\\s*\\n([\\s\\S]+)', 1) AS headed,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*[1-9]\\d*\\.\\s+\\S')), chr(10)) AS numbered FROM m)
    SELECT conv_id, turn, regexp_matches(text, '(?i)(^|\\n)\\s*(Steps?:|##?\\s*Steps?)') OR regexp_matches(text, '(^|\\n)\\s*[1-9]\\.\\s+\\S') AS has_steps,
    md5(CASE WHEN headed <> '' THEN regexp_replace(headed, '^\\s+|\\s+$', '', 'g') WHEN numbered <> '' THEN numbered ELSE text END) AS steps,
    CASE WHEN turn % 3 = 0 THEN 'make|sh' ELSE array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '(?:^|\\n)Tools:\\s*(.+)', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS tools FROM s""",
)
def t31(spark: Spark, d: str) -> DataFrame:
    record = F.when(F.col("turn") % 3 == 0, F.lit('{"workflowPattern": {"tools": ["make", "", "sh"]}}')).otherwise(F.lit("{}"))
    return _said(spark, d, _PLANS).select(
        "conv_id", "turn", C.has_steps(F.col("text")).alias("has_steps"), F.md5(C.steps(F.col("text")).cast("binary")).alias("steps"), F.array_join(C.tools(record, F.col("text")), "|").alias("tools")
    )


# --- T6, K8, T22 -------------------------------------------------------------------------------------

_RULES = [(r"(?i)bot\s*(?:down|lost)", "doctor restart docker"), (r"(?i)how many", "count docker"), (r"(?i)window", "session checkpoint")]
_ASKS = ["Bot down again? ", "How many docker windows? ", "Window: ", "List all of it: ", "一共多少个？", "no cue "]
_ASKED = f"SELECT conv_id, turn, concat({_leads_sql(_ASKS, 'conv_id + turn')}, substring(text, 1, CAST(conv_id % 3 * 60 + 10 AS INT))) AS q FROM conversations"


def _asked(spark: Spark, d: str) -> DataFrame:
    return _conversation(spark, d).select("conv_id", "turn", F.concat(_leads(_ASKS, "conv_id + turn"), F.expr("substring(text, 1, int(conv_id % 3 * 60 + 10))")).alias("q"))


_FOUND = " || ".join(f"CASE WHEN regexp_matches(q, {_quoted(p)}) THEN {w.split()!r} ELSE [] END" for p, w in _RULES)


@query(
    "T6_aliases",
    f"""WITH q AS ({_ASKED}), f AS (SELECT *, list_filter({_FOUND}, lambda x: NOT contains(q, x)) AS f FROM q),
    g AS (SELECT *, list_filter(f, lambda x, k: list_position(f, x) = k) AS g FROM f)
    SELECT conv_id, turn, CASE WHEN length(q) > 100 OR len(g) = 0 THEN q ELSE concat(q, ' ', array_to_string(g, ' ')) END AS expanded FROM g""",
)
def t6(spark: Spark, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", C.expand_aliases(F.col("q"), _RULES).alias("expanded"))


@query(
    "K8_pool",
    f"WITH q AS ({_ASKED}) SELECT conv_id, turn, greatest(CAST(ceil(20 * CASE WHEN regexp_matches(q, {_quoted(C.COUNTING[0])}) OR regexp_matches(q, {_quoted(C.COUNTING[1])}) THEN 2.5 ELSE 1 END) AS BIGINT), 2 * (turn + 10)) AS pool FROM q",
)
def k8(spark: Spark, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", C.pool_size(F.col("q"), F.col("turn") + 10, 20, 2.5).alias("pool"))


@query("T22_merge")
def t22(spark: Spark, d: str) -> DataFrame:
    """Every message merged with itself after another beginning; tests hold the fold against plain Python."""
    rows = _conversation(spark, d)
    return rows.select("conv_id", "turn", C.merged_text(F.col("text"), F.concat(_leads(_ASKS, "conv_id + turn"), "text")).alias("merged"))


# --- F24 ---------------------------------------------------------------------------------------------

_DEPENDS = "SELECT n_nationkey, concat('f', CAST(n_nationkey AS STRING)) AS ref, md5(n_name) AS rev FROM nation WHERE n_nationkey % 5 <> 4"


@query(
    "F24_freshness",
    f"""{N}, now AS ({_DEPENDS.replace('STRING', 'VARCHAR')}),
    dep AS (SELECT id, i, concat('f', i % 25) AS ref, 'git-rev' AS kind FROM notes WHERE i % 7 <> 0 UNION ALL SELECT id, i, concat('f', (i * 3) % 25), 'file' FROM notes WHERE i % 7 <> 0),
    s AS (SELECT id, i, kind, rev, CASE WHEN rev IS NULL THEN 3
      WHEN kind = 'file' THEN CASE WHEN i % 2 = 0 THEN 0 WHEN i % 11 = 0 THEN 2 ELSE 1 END
      ELSE CASE WHEN i % 3 = 0 THEN 0 WHEN i % 13 = 0 THEN 2 ELSE 1 END END AS s FROM dep LEFT JOIN now USING (ref))
    SELECT id, list_extract(['exact', 'compatible', 'uncertain', 'invalid'], max(s) + 1) AS freshness FROM s GROUP BY id""",
)
def f24(spark: Spark, d: str) -> DataFrame:
    """Every note depends on a file and a revision named after nations; what these are now is a table."""
    now = model._views(spark, d, _DEPENDS, "nation")
    state = now.select(F.explode(F.array(*map(F.lit, C.DEPENDENCY_KINDS))).alias("kind"), "ref", F.col("rev").alias("current"))
    i = F.col("i")
    key = {"git-rev": F.concat(F.lit("f"), (i % 25).cast("string")), "file": F.concat(F.lit("f"), (i * 3 % 25).cast("string"))}
    rows = notes(spark, d).select("id", "i", *(v.alias(k) for k, v in key.items()))
    for kind in key:
        rows = rows.join(now.select(F.col("ref").alias(kind), F.col("rev").alias(f"{kind} rev")), kind, "left")
    rev, full = F.upper(F.substring(F.coalesce("git-rev rev", F.lit("0")), 1, 8)), F.coalesce("file rev", F.lit("0"))
    git = F.when(i % 3 == 0, F.array(rev, F.lit("zz"))).when(i % 13 == 0, F.array(F.lit("zz"), F.lit("yy"))).otherwise(F.array(F.lit("zz"), rev))
    file = F.when(i % 2 == 0, F.lit(None).cast("array<string>")).when(i % 11 == 0, F.array(F.lit("zz"))).otherwise(F.array(F.lit("zz"), full))
    one = lambda kind, expected: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("ref"), expected.alias("expected"))
    entries = rows.select("id", F.when(i % 7 != 0, F.array(one("git-rev", git), one("file", file))).alias("depends_on"))
    return C.entry_freshness(entries, state)


# --- T10, T32 ----------------------------------------------------------------------------------------

_IS_NOISE = _noise_sql().split("SELECT conv_id, turn, CASE ", 1)[1].split(" END AS family", 1)[0]
_TURNS = ["", "ok", "", "", "Hello there, "]


def _turns(spark: Spark, d: str) -> DataFrame:
    lead = _leads(_TURNS, "conv_id * 3 + turn")
    return _conversation(spark, d).withColumn("text", F.when(lead == "ok", lead).otherwise(F.concat(lead, "text")))


@query(
    "T10_turns",
    f"""WITH l AS (SELECT *, {_leads_sql(_TURNS, 'conv_id * 3 + turn')} AS l FROM conversations), m AS (SELECT conv_id, turn, role, CASE WHEN l = 'ok' THEN l ELSE concat(l, text) END AS text FROM l),
    k AS (SELECT * FROM (SELECT *, trim(text) AS t FROM m) y WHERE (CASE {_IS_NOISE} END) IS NULL),
    b AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, lead(text) OVER w AS answer FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, md5(concat(CASE role WHEN 'user' THEN '[用户] ' ELSE '[助手] ' END, text, CASE WHEN role = 'user' AND after = 'assistant' THEN concat(chr(10), chr(10), '[助手] ', answer) ELSE '' END)) AS digest
    FROM b WHERE NOT (role = 'assistant' AND coalesce(before, '') = 'user')""",
)
def t10(spark: Spark, d: str) -> DataFrame:
    return dialogue.paired_turns(_turns(spark, d), "conv_id", "turn").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("T10_chunks")
def t10b(spark: Spark, d: str) -> DataFrame:
    return dialogue.dialogue_chunks(_turns(spark, d), "conv_id", "turn").select("conv_id", "turn", "part", F.length("text").alias("n"))


@query(
    "T32_prototypes",
    f"""WITH notes AS (SELECT * REPLACE (CAST(vector AS DOUBLE[]) AS vector) FROM ({model.MEMORIES_SQL}) mm),
    r AS (SELECT *, substring(sha256(regexp_replace(lower(concat(scope, '! ', category)), '[^a-z0-9]', '', 'g')), 1, 16) AS key FROM notes),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM r),
    p AS (SELECT concat('proto-', substring(key, 1, 8)) AS prototype_id, row_number() OVER (ORDER BY ts, key) AS rank, vector FROM n WHERE n = 2 QUALIFY rank <= 32),
    s AS (SELECT notes.id, p.prototype_id, list_cosine_similarity(notes.vector, p.vector) AS s, row_number() OVER (PARTITION BY notes.id ORDER BY round(list_cosine_similarity(notes.vector, p.vector), 12) DESC, rank) AS b FROM notes, p)
    SELECT id, prototype_id, round(s, 5) AS similarity FROM s WHERE b = 1 AND s >= 0.2""",
)
def t32(spark: Spark, d: str) -> DataFrame:
    rows = memories(spark, d)
    bank = dialogue.noise_prototypes(rows.select("id", "ts", F.concat("scope", F.lit("! "), "category").alias("text"), "vector"))
    return dialogue.match_prototypes(rows.select("id", "text", "vector"), bank, 0.2).where("prototype_id is not null").select("id", "prototype_id", F.round("similarity", 5).alias("similarity"))


# --- S20, S22 ----------------------------------------------------------------------------------------

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'Info' WHEN 'view' THEN 'DEBUG' ELSE 'warn' END"


@query(
    "S20_logs",
    f"""WITH e AS (SELECT event_id, user_id, lower({_LEVEL}) AS level FROM events)
    SELECT event_id, concat('user ', user_id, ' did it') AS text, CASE WHEN user_id % 2 = 0 THEN concat('[', upper(level), '] web', user_id % 3) END AS title, CASE level WHEN 'error' THEN 'cases' ELSE 'events' END AS category,
    CASE level WHEN 'error' THEN 0.9 WHEN 'warn' THEN 0.7 ELSE 0.5 END::DOUBLE AS importance, concat('log|', level, CASE WHEN user_id % 2 = 0 THEN concat('|module:web', user_id % 3) ELSE '' END) AS tags
    FROM (SELECT event_id, user_id, level FROM e) x WHERE level <> 'debug'""",
)
def s20(spark: Spark, d: str) -> DataFrame:
    """Every event as a log line; its number is in the time, so that it can be read back."""
    module = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("web"), (F.col("user_id") % 3).cast("string"), F.lit(": "))).otherwise("")
    at = F.concat(F.lit("2024-01-01T00:00:"), F.col("event_id").cast("string"), F.lit("Z"))
    line = F.concat(at, F.lit(" ["), F.expr(_LEVEL), F.lit("] "), module, F.lit("user "), F.col("user_id").cast("string"), F.lit(" did it"))
    r = adapters.log_records(model.table(spark, d, "events").select(line.alias("value")))
    return r.select(F.regexp_extract("timestamp", r":(\d+)Z$", 1).cast("long").alias("event_id"), "text", "title", F.col("categoryHint").alias("category"), F.col("importanceHint").alias("importance"), F.array_join("tags", "|").alias("tags"))


@query("S20_mail", "SELECT concat('email:', conv_id, '-', turn) AS id, concat('Re: ', conv_id) AS title, concat('email|from:', role) AS tags, sha256(text) AS hash FROM conversations WHERE length(trim(text)) > 0")
def s20b(spark: Spark, d: str) -> DataFrame:
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    mails = _conversation(spark, d).select(key.alias("message_id"), F.concat(F.lit("Re: "), F.col("conv_id").cast("string")).alias("subject"), F.col("text").alias("body"), F.col("role").alias("sender"), F.lit("2024-01-01").alias("sent_at"))
    return adapters.mail_records(mails).select("id", "title", F.array_join("tags", "|").alias("tags"), F.col("contentHash").alias("hash"))


@query("S20_feed", "SELECT page_id, concat('rss:', md5(CASE WHEN page_id % 2 = 0 THEN url ELSE concat('g', page_id) END)) AS id, concat('rss|link:', url) AS tags, sha256(html) AS hash FROM pages WHERE length(trim(html)) > 0")
def s20c(spark: Spark, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    items = model.table(spark, d, "pages").select(
        F.lit("feeds:pages").alias("scope"), F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("g"), n)).alias("guid"), n.alias("title"), F.col("html").alias("content"),
        F.col("url").alias("link"), F.lit("2024-01-01").alias("published"), F.lit(None).cast("array<string>").alias("categories"),
    )
    return adapters.feed_records(items).select(F.col("title").cast("long").alias("page_id"), "id", F.array_join("tags", "|").alias("tags"), F.col("contentHash").alias("hash"))


@query("S22_dump", f"{N} SELECT id, scope, ts AS timestamp, length(text) AS n FROM notes WHERE ts >= {NOW} - 7 * 86400000 ORDER BY ts DESC, id LIMIT 200")
def s22(spark: Spark, d: str) -> DataFrame:
    """The dump as JSON lines, read back."""
    lines = adapters.as_json_lines(adapters.recent(notes(spark, d).withColumnRenamed("ts", "timestamp"), NOW))
    j = F.from_json("value", "struct<id:string,scope:string,timestamp:long,text:string>")
    return lines.select(j.alias("j")).select("j.id", "j.scope", "j.timestamp", F.length("j.text").alias("n"))


@query("S22_markdown", f"{N} SELECT id, scope, md5(concat('### [', category, '] ', strftime(make_timestamp(ts * 1000), '%Y-%m-%d'), chr(10), chr(10), text, chr(10), chr(10), '---', chr(10))) AS digest FROM notes")
def s22b(spark: Spark, d: str) -> DataFrame:
    parts = adapters.as_markdown(notes(spark, d).withColumnRenamed("ts", "timestamp"))
    return parts.select("id", "scope", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("S17_connector", "SELECT concat('rss:', md5(url)) AS id, 'feeds:pages' AS scope, length(html) AS n FROM pages WHERE length(trim(html)) > 0")
def s17(spark: Spark, d: str) -> DataFrame:
    """Records written as one JSON batch each and read back."""
    items = model.table(spark, d, "pages").select(F.lit("feeds:pages").alias("scope"), F.lit("").alias("guid"), F.lit("t").alias("title"), F.col("html").alias("content"), F.col("url").alias("link"), F.lit("2024-01-01").alias("published"), F.lit(None).cast("array<string>").alias("categories"))
    r = adapters.feed_records(items)
    record = F.struct(*(c for c in adapters.RECORD if c not in ("source", "scope")))
    batch = r.select(F.to_json(F.struct(F.lit("connector-v1").alias("version"), "source", "scope", F.array(record).alias("records"))).alias("text"))
    return readers.connector_records(batch).select("id", "scope", F.length("text").alias("n"))
