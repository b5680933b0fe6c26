"""What is captured from texts, dialogue chunks, merged clauses, adapters and exports, on literals and against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import capture as C
from tidewell.operators import dialogue
from tidewell.sources import adapters


def over(spark, texts, column, *more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, t string").select("n", column(F.col("t"), *more).alias("r"))
    return [r["r"] for r in df.orderBy("n").collect()]


def test_captured_items(spark):
    found = over(
        spark,
        [
            "Actually, that's not so at all. The limit is two hundred now. I prefer short replies here.",
            "I like this one very much. " * 7,
            "记住这个地方的规则。不重要",
            "short. no. ok",
            "",
            None,
        ],
        C.captured_items,
    )
    assert [(i["signal"], i["text"]) for i in found[0]] == [
        ("correction signal", "Actually, that's not so at all. The limit is two hundred now"),
        ("preference signal", "I prefer short replies here"),
    ]
    assert len(found[1]) == 5 and {i["category"] for i in found[1]} == {"preferences"}
    assert [(i["signal"], i["importance"], i["replay_priority"]) for i in found[2]] == [("explicit memory instruction", 0.85, 0.9)]
    assert found[3:] == [[], [], []]


def test_preference_slots(spark):
    cases = {
        "I love the Big Mac from McDonald's.": ("brand-item", "mcdonald's", "bigmac", None, None, None, None),
        "我喜欢麦当劳的巨无霸": ("brand-item", "麦当劳", "巨无霸", None, None, None, None),
        "我喜欢麦当劳的巨无霸、薯条": None,
        "Replies should be short and technical": ("reply-style", None, None, ["concise", "technical"], None, None, None),
        "be brief": None,
        "I prefer bunjs over npm": ("tool-choice", None, None, None, "bun", "npm", None),
        "use pnpm instead of pnpm": None,
        "I'm learning Rust.": ("implicit-usage", None, None, None, None, None, "rust"),
        "我在用 Obsidian 做笔记": ("implicit-usage", None, None, None, None, None, "obsidian"),
        "": None,
    }
    found = over(spark, list(cases), C.preference_slot)
    assert [None if r is None else tuple(r) for r in found] == list(cases.values())
    assert over(spark, [None], C.preference_slot) == [None]


def test_citations(spark):
    text = "It is so [src:a]. It is not [src:b] so. No."
    assert over(spark, [text, "none", ""], C.cited_ids) == [["a", "b"], [], []]
    assert over(spark, [text], C.without_citation, F.lit("b")) == ["It is so [src:a]. No."]
    assert over(spark, [text, "No.", ""], C.source_coverage, F.array(F.lit("a"))) == [0.5, 0.0, 0.0]
    assert over(spark, ["The green house stands. Other words only."], C.lexical_coverage, F.array(F.lit("a green house stands"))) == [0.5]


def test_abstract_steps_tools(spark):
    assert over(spark, ["[用户] Thanks for all you did there. This is what it is about! More.", "short", ""], C.abstract) == ["This is what it is about!", "short", ""]
    assert over(spark, ["Plan\nSteps:\n1. a\n2. b ", "x\n1. a\ny\n12. b", "no steps"], C.steps) == ["1. a\n2. b", "1. a\n12. b", "no steps"]
    assert over(spark, ["Steps: a", "x\n 3. b", "at 3. b"], C.has_steps) == [True, True, False]
    assert over(spark, ["x\nTools: git, rg,, ", "x"], lambda t: C.tools(F.lit("not json"), t)) == [["git", "rg"], []]
    assert over(spark, ["Tools: git"], lambda t: C.tools(F.lit('{"caseMemory": {"tools": ["make"]}}'), t)) == [["make"]]


def test_requests(spark):
    rules = [("(?i)bot", "doctor docker"), ("docker", "docker hermes")]
    assert over(spark, ["my bot", "docker bot", "other", "bot " * 30], C.expand_aliases, rules) == ["my bot doctor docker", "docker bot doctor hermes", "other", "bot " * 30]
    assert over(spark, ["how many are there", "counter", "一共几个"], C.pool_size, F.lit(15), 20, 3.0) == [60, 30, 60]


def merged(old, new):
    """T22 in plain Python."""

    def clauses(text):
        tidy = lambda x: re.sub("[。！？!?；;，,]+$", "", x.strip()).strip()
        first = [c for c in map(tidy, re.split(r"[。！？!?；;\n]+", text)) if c]
        return first if len(first) > 1 else [c for c in map(tidy, re.split("[，,]+", text)) if c]

    out = []
    for c in clauses(old) + clauses(new):
        core = "".join(x for x in c.lower() if x.isalnum())
        near = [k for k, (_, other) in enumerate(out) if core in other or other in core]
        if not core:
            continue
        if not near:
            out.append((c, core))
        elif len(c) > len(out[near[0]][0]):
            out[near[0]] = (c, core)
    texts = [c for c, _ in out]
    if len(texts) < 2:
        return texts[0] if texts else None
    return "；".join(texts) + "。" if re.search(r"[㐀-鿿]", old + new) else ". ".join(texts) + "."


def test_merged_text(spark):
    import random

    rng = random.Random(1)
    words = ["a b", "a b c", "B!", "c, d", "。", "a", "x y z;", "茶", "", "\n", "Q?"]
    pairs = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 6))) + rng.choice(["", "!", "; q w"]) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, a string, b string")
    found = [r["m"] for r in df.select("n", C.merged_text(F.col("a"), F.col("b")).alias("m")).orderBy("n").collect()]
    assert found == [merged(a, b) for a, b in pairs]


def test_freshness(spark):
    now = spark.createDataFrame([("file", "f", "10"), ("git-rev", "r", "ABCDEF0123")], "kind string, ref string, current string")
    cases = {
        "same": ([("file", "f", ["10"])], "exact"),
        "exists": ([("file", "f", None)], "exact"),
        "older": ([("file", "f", ["9", "10"])], "compatible"),
        "short": ([("git-rev", "r", ["abcdef0"])], "exact"),
        "changed": ([("git-rev", "r", ["ffff"]), ("file", "f", None)], "uncertain"),
        "gone": ([("file", "f", ["10"]), ("file", "g", None)], "invalid"),
        "none": ([], None),
        "null": (None, None),
        "bad kind": ([("url", "f", None)], None),
        "many": ([("file", "f", None)] * 9, None),
    }
    entries = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], f"id string, depends_on {C.DEPENDS_ON}")
    found = {r["id"]: r["freshness"] for r in C.entry_freshness(entries, now).collect()}
    assert found == {k: v[1] for k, v in cases.items() if v[1]}
    assert C.entry_freshness(entries.limit(0), now).count() == 0


def test_dialogue_chunks(spark):
    long = "\n".join(f"Line {i} of a long answer, which goes on and on for a while." for i in range(120))
    turns = [("a", 1, "user", "What is the plan for the week?"), ("a", 2, "user", "hi"), ("a", 3, "assistant", long), ("a", 4, "assistant", "Another thing to say here."), ("b", 1, "assistant", "Orphan answer stands alone.")]
    df = spark.createDataFrame(turns, "session_id string, position int, role string, text string")
    whole = {(r["session_id"], r["position"]): r["text"] for r in dialogue.paired_turns(df).collect()}
    assert set(whole) == {("a", 1), ("a", 4), ("b", 1)}  # the greeting is noise, so the answer follows the question
    assert whole["a", 1] == f"[用户] What is the plan for the week?\n\n[助手] {long}"
    parts = dialogue.dialogue_chunks(df).where("session_id = 'a' and position = 1").orderBy("part").collect()
    assert len(parts) > 3 and all(len(p["text"]) <= 2000 for p in parts)
    joined = " ".join(p["text"] for p in parts)
    assert all(f"Line {i} of" in joined for i in range(120))
    assert dialogue.dialogue_chunks(df.limit(0)).count() == 0


def test_noise_prototypes(spark):
    rows = [("1", 1, "All  done!", [1.0, 0.0]), ("2", 2, "all done", [0.0, 1.0]), ("3", 3, "ALL DONE.", [1.0, 1.0]), ("4", 4, "once only", [1.0, 0.0]), ("5", 5, "I prefer tea", [1.0, 0.0]), ("6", 6, "I prefer tea", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, ts int, text string, vector array<double>")
    bank = dialogue.noise_prototypes(df)
    assert [(r["learned_at"], r["vector"]) for r in bank.collect()] == [(2, [0.0, 1.0])]
    found = {r["id"]: r["similarity"] for r in dialogue.match_prototypes(df, bank).collect()}
    assert found["2"] == pytest.approx(1.0) and [k for k, v in found.items() if v is not None] == ["2"]
    empty = dialogue.match_prototypes(df, bank.limit(0)).collect()
    assert len(empty) == 6 and all(r["prototype_id"] is None for r in empty)


def test_log_records(spark):
    lines = ["2026-04-14T10:00:00Z [ERROR] auth: login failed", "2026-04-14T10:00:00Z [debug] x: y", "2026-04-14T10:00:01Z [note] plain words", "no log line", "", None]
    r = adapters.log_records(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("timestamp").collect()
    assert [(x["text"], x["title"], x["categoryHint"], x["importanceHint"], x["tags"]) for x in r] == [
        ("login failed", "[ERROR] auth", "cases", 0.9, ["log", "error", "module:auth"]),
        ("plain words", None, "events", 0.3, ["log", "note"]),
    ]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one\ntwo", "cases", "s2", 0.5, 2_000), ("b", "three", None, None, 0.5, 1_000), ("c", "old", "cases", "s1", 0.5, -8 * 86_400_000)], "id string, text string, category string, scope string, importance double, timestamp long")
    dump = adapters.recent(rows, 3_000)
    assert [r["id"] for r in dump.collect()] == ["a", "b"]
    adapters.as_json_lines(dump).write.text(str(tmp_path / "dump"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert sorted(r["text"] for r in back) == ["one\ntwo", "three"]
    adapters.write_lines(adapters.as_markdown(rows), str(tmp_path / "md"), ["scope", "timestamp", "id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert re.findall(r"### \[(\w+)\]", text) == ["other", "cases", "cases"]  # <missing>, s1, s2
    hits = rows.where("id = 'a'").withColumns({"rank": F.lit(1), "score": F.lit(0.5)})
    parts = [r["value"] for r in adapters.brief(hits, "q", "default", "2024-02-01", "All is said.").orderBy("n").collect()]
    assert "- Hits: 1" in parts[0] and "### 1. one two" in parts[1] and "- Score: 50%" in parts[1]
