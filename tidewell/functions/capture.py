"""What is kept from what was said: signals, preference slots, steps and tools, citations; and how fresh it still is.

All are column expressions over one text.  A null text gives null, or an empty array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import HAN, any_of
from tidewell.functions.text import ascii_edges as _ascii

def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _with(c: Column, f) -> Column:
    """f(c) with c worked out once."""
    return F.transform(F.array(c), f)[0]


# --- T19: signals ------------------------------------------------------------------------------------

# The signals in the order in which they are tried: name, pattern, category, importance, replay priority.
SIGNALS = [
    ("preference signal", r"\b(?:i prefer|i like|i don't like|i hate|i love|i want|i need|i always use|i never use)\b|我喜欢|我不喜欢|我偏好|我想要|我习惯|我一般用|我从不用|我讨厌|以后都用|以后不要", "preferences", 0.8, 0.5),
    ("identity signal", r"\b(?:my name is|i am a|i'm a|i work at|i live in|my role is|i'm responsible for)\b|我叫|我是|我在|我的角色|我负责|我的工作是|我住在", "profile", 0.9, 0.6),
    ("decision signal", r"\b(?:i decided|we decided|let's go with|the decision is|we agreed|final call)\b|决定了|我们选择|最终方案|确定用|就这么定了|敲定", "events", 0.7, 0.7),
    ("correction signal", r"\b(?:actually|no,? not|that's wrong|correction:|you're wrong|that's incorrect)\b|更正|其实不是|不对|搞错了|纠正一下|你说错了|应该是", "cases", 0.85, 0.9),
    ("explicit memory instruction", r"\b(?:remember that|don't forget|keep in mind|note that|important:)\b|记住|别忘了|注意|以后记得|帮我记|你要记住", "events", 0.85, 0.9),
    ("pattern signal", r"\b(?:the pattern is|the workflow is|the process is|step 1|the rule is|always do)\b|流程是|步骤是|规则是|每次都要|固定做法|标准流程", "patterns", 0.75, 0.6),
]
CORRECTION = "correction signal"
MOST_ITEMS = 5
_ITEM = "array<struct<text:string,category:string,importance:double,signal:string,replay_priority:double>>"


def captured_items(text: Column, most: int = MOST_ITEMS) -> Column:
    """Up to `most` sentences with a signal; the first signal that fits counts.

    A correction takes the sentence after it along, which then is not looked at itself.
    """
    least = F.when(text.rlike(r"[一-鿿぀-ゟ゠-ヿ가-힯]"), 6).otherwise(15)

    def signal(s: Column) -> Column:
        tried = F.lit(None).cast("int")
        for k in reversed(range(len(SIGNALS))):
            tried = F.when(s.rlike("(?i)" + _ascii(SIGNALS[k][1])), k).otherwise(tried)
        return tried

    sentences = F.filter(F.transform(F.split(text, r"[.!?。！？\n]+"), _strip), lambda s: F.length(s) > least)
    kinds = F.array(*(F.struct(F.lit(n).alias("signal"), F.lit(c).alias("category"), F.lit(i).alias("importance"), F.lit(p).alias("replay_priority")) for n, _, c, i, p in SIGNALS))

    def items(said: Column) -> Column:
        seen = F.transform(said, lambda s, i: F.struct(s.alias("s"), F.get(said, i + 1).alias("after"), signal(s).alias("k")))

        def step(state: Column, x: Column) -> Column:
            kind = F.get(kinds, x["k"])
            takes = (kind["signal"] == CORRECTION) & x["after"].isNotNull()
            item = F.struct(
                F.when(takes, F.concat(x["s"], F.lit(". "), x["after"])).otherwise(x["s"]).alias("text"),
                kind["category"].alias("category"), kind["importance"].alias("importance"), kind["signal"].alias("signal"), kind["replay_priority"].alias("replay_priority"),
            )
            new = ~state["skip"] & x["k"].isNotNull() & (F.size(state["items"]) < most)
            return F.struct(F.coalesce(new & takes, F.lit(False)).alias("skip"), F.when(new, F.concat(state["items"], F.array(item))).otherwise(state["items"]).cast(_ITEM).alias("items"))

        start = F.struct(F.lit(False).alias("skip"), F.array().cast(_ITEM).alias("items"))
        return F.aggregate(seen, start, step, lambda state: state["items"])

    return F.coalesce(_with(sentences, items), F.array().cast(_ITEM))


# --- T27: preference slots ---------------------------------------------------------------------------

# What separates items, what ends the clause that lists them, and the traits of a reply style.
ITEM_SPLIT = r"(?iu)(?:、|,|，|/|以及|及|与|和| and | & )"
CLAUSE_STOP = r"(?iu)(?:因为|所以|但是|不过|if |when |because |but )"
STYLE_CONTEXT = r"\brepl(?:y|ies)\b|\bresponse(?:s)?\b|\brespond(?:ing)?\b|\bwriting\b|\btone\b|\bvoice\b|\bstyle\b|回复|回答|语气|写作|表达|风格|措辞|说话"
STYLE_CUE = r"\bprefer(?:s|red)?\b|\bwants?\b|\bplease\b|\bavoid\b|\bkeep\b|\bneed(?:s|ed)?\b|偏好|喜欢|希望|请|要|不要|不接受|避免|尽量|最好"
STYLE_TRAITS = {
    "concise": r"\bconcise\b|\bbrief\b|\bshort\b|简洁|简短|短句|少废话|少空话|精炼",
    "direct": r"\bdirect\b|\bstraight(?:forward)?\b|to the point|直说|直接|不绕弯|别绕弯|开门见山",
    "colloquial": r"\bcolloquial\b|\bconversational\b|\bcasual\b|口语化|像聊天|像朋友聊天",
    "grounded": r"\bgrounded\b|non[-\s]?salesy|non[-\s]?hype|avoid sales language|avoid hype|不浮夸|不鸡血|不说教|不营销(?:腔)?|别太飘|不端着|别太端着",
    "technical": r"\btechnical\b|逻辑清晰|讲清楚|讲明白|技术向",
}
# Patterns with the numbers of their groups: (pattern, brand, items) and (pattern, preferred, avoided).
BRAND_ITEM = [
    (r"(?:^|[\s，,。；;！!？?])(?:我|用户)?(?:很|更|还)?(?:喜欢|爱吃|偏爱|常吃|想吃)(?:吃|喝|用|买)?([\p{IsHan}A-Za-z0-9&·'\-]{1,24})的([\p{IsHan}A-Za-z0-9&·'\-\s、,，和及与/]{1,80})", 1, 2),
    (r"(?i)\b(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:like|love|prefer|enjoy)\s+([a-z0-9'&\-\s]{1,80})\s+from\s+([a-z0-9'&\-\s]{1,40})", 2, 1),
]
TOOL_CHOICE = [
    r"(?i)^(?:\s*)(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:use|uses|using|prefer|prefers|preferred|pick|picks|picked)\s+([a-z0-9.+#/_\-\s]{1,24})\s+(?:over|instead of|rather than)\s+([a-z0-9.+#/_\-\s]{1,24})(?:\s*[.!?。！？])?\s*$",
    r"(?:更喜欢|喜欢|偏好|倾向|优先)(?:使用|用)?([A-Za-z0-9.+#/_\-\s]{1,24})(?:\s*)(?:而不是|而非|不用|不选|代替|替代|优先于|胜过)(?:\s*)([A-Za-z0-9.+#/_\-\s]{1,24})",
    r"(?:使用|用)([A-Za-z0-9.+#/_\-\s]{1,24})(?:\s*)(?:不用|代替|替代)([A-Za-z0-9.+#/_\-\s]{1,24})",
]
# Names of tools and what they are filed under.
TOOLS = {
    "bun": "bun", "bunjs": "bun", "bunx": "bunx", "node": "node", "node.js": "node", "nodejs": "node", "npm": "npm", "pnpm": "pnpm", "yarn": "yarn", "npx": "npx",
    "uv": "uv", "pip": "pip", "python": "python", "docker": "docker", "podman": "podman", "rg": "rg", "ripgrep": "rg", "grep": "grep", "git": "git",
    "claude": "claude-code", "claudecode": "claude-code", "claude-code": "claude-code", "codex": "codex", "gemini": "gemini", "cursor": "cursor",
    "vscode": "vscode", "vs-code": "vscode", "vscodeinsiders": "vscode", "vim": "vim", "neovim": "neovim", "nvim": "neovim",
}
# What a text says to use or own, in the order of trial; the group is the subject.
USAGE = [
    r"(?i)\b(?:i|user)\s+(?:use[sd]?|using|am\s+using|have\s+been\s+using|work[s]?\s+with)\s+([A-Za-z][A-Za-z0-9\s.+#\-']{1,40}?)\s*(?=\s+(?:for|to|in|at|on|as|which|because|since)\b|[,.:;!?]|$)",
    r"(?i)\b(?:i|user)\s+(?:have|has|own[s]?|bought|got)\s+(?:a |an |the )?([A-Za-z][A-Za-z0-9\s.+#\-']{1,40}?)\s*(?=\s+(?:camera|phone|laptop|computer|tablet|watch|car|bike|guitar|piano|keyboard|headphones|monitor|setup|kit|device)\b|[,.:;!?]|$)",
    r"(?i)\b(?:i|user)\s+(?:enjoy[s]?|love[s]?|really\s+like[s]?)\s+(?:to\s+(?:use\s+)?)?([A-Za-z][A-Za-z0-9\s.+#\-']{1,40}?)\s*(?=[,.:;!?]|$)",
    r"(?i)\b(?:i'm|i\s+am|user\s+is)\s+(?:learning|studying|interested\s+in|passionate\s+about)\s+([A-Za-z][A-Za-z0-9\s.+#\-']{1,40}?)\s*(?=[,.:;!?]|$)",
    r"(?:我|用户)(?:在)?(?:用|使用)\s*([\p{IsHan}A-Za-z0-9][\p{IsHan}A-Za-z0-9\s.+#\-]{0,30}?)(?=\s*(?:来|做|进行|处理|开发|编辑)|[，。！？,.:;!?]|$)",
    r"(?:我|用户)(?:有|买了|入了)\s*(?:一[个台部套])?([\p{IsHan}A-Za-z0-9][\p{IsHan}A-Za-z0-9\s.+#\-]{0,30}?)(?=[，。！？,.:;!?]|$)",
    r"(?:我|用户)(?:很)?(?:喜欢|爱|享受)\s*(?:做|玩|学|用)\s*([\p{IsHan}A-Za-z0-9][\p{IsHan}A-Za-z0-9\s.+#\-]{0,30}?)(?=[，。！？,.:;!?]|$)",
    r"(?:我|用户)(?:在学|正在学|在研究)\s*([\p{IsHan}A-Za-z0-9][\p{IsHan}A-Za-z0-9\s.+#\-]{0,30}?)(?=[，。！？,.:;!?]|$)",
]
SLOT = "struct<type:string,brand:string,item:string,traits:array<string>,preferred_tool:string,avoided_tool:string,subject:string>"


def plain(text: Column) -> Column:
    """Without marks of speakers; white space made one blank."""
    return _strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^\[(用户|助手)\]\s*", ""), r"\s+", " "))


def preference_token(value: Column, articles: bool = False) -> Column:
    """A name in the form in which slots compare it: no quotes or punctuation around, no blanks, lower case."""
    t = _strip(F.regexp_replace(plain(value), "^[“\"'`‘’.]+|[”\"'`‘’.。！!？?，,；;:：]+$", ""))
    t = F.regexp_replace(t, r"(?i)^(?:the|a|an)\s+", "") if articles else t
    return F.lower(F.regexp_replace(t, r"\s+", ""))


def _slot(kind: str, **fields: Column) -> Column:
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(SLOT).fields}
    return F.struct(*(F.lit(kind).alias("type") if n == "type" else fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def brand_items(text: Column) -> Column:
    """struct(brand, items) of the first pattern that names both, else null."""

    def parsed(t: Column, pattern: str, brand: int, items: int, articles: bool) -> Column:
        raw = F.regexp_extract(t, _ascii(pattern), items)
        head = F.split(raw, CLAUSE_STOP, 2)[0]
        parts = F.transform(F.split(F.when(head == "", raw).otherwise(head), ITEM_SPLIT), lambda p: preference_token(p, articles))
        got = F.struct(preference_token(F.regexp_extract(t, _ascii(pattern), brand)).alias("brand"), F.filter(parts, lambda p: p != "").alias("items"))
        return _with(got, lambda g: F.when((g["brand"] != "") & (F.size(g["items"]) > 0), g))

    return _with(plain(text), lambda t: F.coalesce(*(parsed(t, p, b, i, k == 1) for k, (p, b, i) in enumerate(BRAND_ITEM))))


def reply_style(text: Column) -> Column:
    """The traits asked for, in order, or null: a word about replies is needed, or a wish and two traits."""

    def of(t: Column) -> Column:
        found = F.array_sort(F.array_compact(F.array(*(F.when(t.rlike("(?i)" + _ascii(p)), k) for k, p in STYLE_TRAITS.items()))))
        wished = t.rlike("(?i)" + _ascii(STYLE_CUE))
        return _with(found, lambda f: F.when((F.size(f) > 0) & (t.rlike("(?i)" + _ascii(STYLE_CONTEXT)) | (wished & (F.size(f) > 1))), f))

    return _with(plain(text), of)


def tool_choice(text: Column) -> Column:
    """struct(preferred, avoided) of the first pattern that names two different known tools, else null."""
    names = F.create_map(*(F.lit(x) for pair in (TOOLS | {v: v for v in TOOLS.values()}).items() for x in pair))

    def of(t: Column) -> Column:
        tried = []
        for p in TOOL_CHOICE:
            got = F.struct(*(F.try_element_at(names, preference_token(F.regexp_extract(t, p, g))).alias(n) for g, n in ((1, "preferred"), (2, "avoided"))))
            tried.append(_with(got, lambda g: F.when(g["preferred"] != g["avoided"], g)))
        return F.coalesce(*tried)

    return _with(plain(text), of)


def used_subject(text: Column) -> Column:
    """What the speaker says to use, own or learn: the first pattern with a subject of two characters or more, else null."""

    def of(t: Column) -> Column:
        return F.coalesce(*(_with(preference_token(F.regexp_extract(t, _ascii(p), 1)), lambda s: F.when(F.length(s) >= 2, s)) for p in USAGE))

    return _with(plain(text), of)


def preference_slot(text: Column) -> Column:
    """The slot a stated preference fills: one item of a brand, a reply style, a tool over another, or a use; null if none."""
    brand = _with(brand_items(text), lambda b: F.when(F.size(b["items"]) == 1, _slot("brand-item", brand=b["brand"], item=b["items"][0])))
    style = _with(reply_style(text), lambda s: F.when(s.isNotNull(), _slot("reply-style", traits=s)))
    tool = _with(tool_choice(text), lambda c: F.when(c.isNotNull(), _slot("tool-choice", preferred_tool=c["preferred"], avoided_tool=c["avoided"])))
    use = _with(used_subject(text), lambda s: F.when(s.isNotNull(), _slot("implicit-usage", subject=s)))
    return F.coalesce(brand, style, tool, use)


# --- T28: citations ----------------------------------------------------------------------------------

_ENDS = r"(?<=[.!?])\s+"


def cited_ids(text: Column) -> Column:
    """Ids cited as [src:ID], each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[src:([^\]]+)\]"), F.lit(1)))


def without_citation(text: Column, cited: Column) -> Column:
    """The text without the sentences that cite one id."""
    return F.array_join(F.filter(F.split(text, _ENDS), lambda s: ~s.contains(F.concat(F.lit("[src:"), cited, F.lit("]")))), " ")


def _share(text: Column, good) -> Column:
    sentences = F.filter(F.split(text, _ENDS), lambda s: F.length(s) > 5)
    return _with(sentences, lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(a, good)) / F.size(a)))


def source_coverage(text: Column, valid_ids: Column) -> Column:
    """Share of sentences that cite a valid id."""
    return _share(text, lambda s: F.arrays_overlap(cited_ids(s), valid_ids))


def lexical_coverage(text: Column, sources: Column) -> Column:
    """Share of sentences of whose longer words over 0.3 stand in the sources."""

    def words(s: Column) -> Column:
        return F.filter(F.split(F.lower(s), r"\s+"), lambda w: F.length(w) > 2)

    known = F.array_distinct(F.flatten(F.transform(sources, words)))
    # The known words and a sentence's own are worked out once each, not once for every word.
    share = lambda own, k: F.coalesce(F.size(F.filter(own, lambda w: F.array_contains(k, w))) / F.nullif(F.size(own), F.lit(0)) > 0.3, F.lit(False))
    return _with(known, lambda k: _share(text, lambda s: _with(words(s), lambda own: share(own, k))))


# --- T26, T31: abstracts, steps, tools ---------------------------------------------------------------


def abstract(text: Column, most: int = 150) -> Column:
    """The first sentence that says something, else the beginning."""
    t = _strip(F.regexp_replace(text, r"(?m)^\[(用户|助手)\]\s*", ""))
    parts = F.transform(F.split(t, r"(?<=[。！？.!?\n])\s*"), _strip)
    # Beginnings of sentences that say nothing.
    says = F.filter(parts, lambda s: (F.length(s) >= 15) & ~s.rlike("^(好的|OK|是的|嗯|谢谢|Thanks)"))
    return F.substring(F.coalesce(F.get(says, F.lit(0)), t), 1, most)


def excerpt(stored_abstract: Column, text: Column, most: int = 200) -> Column:
    """The stored abstract where there is one, else the text's beginning."""
    return F.substring(F.coalesce(F.nullif(stored_abstract, F.lit("")), text), 1, most)


_HEADED = r"(?i)(?:^|\n)\s*(?:Steps?:|##?\s*Steps?)"


def has_steps(text: Column) -> Column:
    """Whether a text has a list of steps: a heading or a numbered line."""
    return text.rlike(_HEADED) | text.rlike(r"(?:^|\n)\s*[1-9]\.\s+\S")


def steps(text: Column) -> Column:
    """What follows the heading, else the numbered lines, else the text."""
    headed = F.regexp_extract(text, _HEADED + r"\s*\n([\s\S]+)", 1)
    numbered = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[1-9]\d*\.\s+\S")), "\n")
    return F.when(headed != "", _strip(headed)).when(numbered != "", numbered).otherwise(text)


def tools(metadata: Column, text: Column) -> Column:
    """Tools listed in the record, of a case or a pattern, else in the text's line of tools."""
    listed = [F.from_json(F.get_json_object(metadata, f"$.{k}.tools"), "array<string>") for k in ("caseMemory", "workflowPattern")]
    line = F.transform(F.split(F.regexp_extract(text, r"(?:^|\n)Tools:\s*(.+)", 1), ","), _strip)
    return F.filter(F.coalesce(*listed, line), lambda t: t.isNotNull() & (t != ""))


# --- T6, K8: the request -----------------------------------------------------------------------------


def expand_aliases(query: Column, rules: Sequence[tuple[str, str]], longest: int = 100) -> Column:
    """The query and the words of every rule (pattern, words) that fits it and that it lacks.  Long queries stay as they are."""
    if not rules:
        return query
    found = F.flatten(F.array(*(F.when(query.rlike(p), F.array(*map(F.lit, w.split()))).otherwise(F.array().cast("array<string>")) for p, w in rules)))
    more = F.array_distinct(F.filter(found, lambda w: ~query.contains(w)))
    return F.when((F.length(query) > longest) | (F.size(more) == 0), query).otherwise(F.concat_ws(" ", query, F.array_join(more, " ")))


# What asks for a number or for all of something.
COUNTING = [r"(?i)\b(?:how many|how much|all the|every|list all|total number|count)\b", r"多少[个件条只]?|一共|总共|所有的?|列举|有几[个件条只]"]


def counts_things(query: Column) -> Column:
    return any_of(query, COUNTING)


def pool_size(query: Column, limit: Column, size: int = 20, multiplier: float = 1.0) -> Column:
    """K8: how many candidates a search looks at: more where the request counts, and at least twice the limit."""
    wider = F.when(counts_things(query), F.lit(float(max(multiplier, 1.0)))).otherwise(1.0)
    return F.greatest(F.ceil(wider * size), limit * 2).cast("long")


# --- T22: merging two texts --------------------------------------------------------------------------


def merged_clauses(old: Column, new: Column) -> Column:
    """The clauses of both texts; of those that contain one another the longest stays, where the first stood."""

    def clauses(text: Column) -> Column:
        def cut(by: str) -> Column:
            return F.filter(F.transform(F.split(text, by), lambda c: _strip(F.regexp_replace(_strip(c), "[。！？!?；;，,]+$", ""))), lambda c: c != "")

        return _with(cut(r"[。！？!?；;\n]+"), lambda a: F.when(F.size(a) > 1, a).otherwise(cut("[，,]+")))

    item = "array<struct<raw:string,core:string>>"

    def add(kept: Column, c: Column) -> Column:
        core = F.regexp_replace(F.lower(c), r"[\p{P}\p{S}\s]+", "")
        one = F.struct(c.alias("raw"), core.alias("core"))
        first = F.array_position(F.transform(kept, lambda k: k["core"].contains(core) | core.contains(k["core"])), True)
        longer = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (F.length(c) > F.length(k["raw"])), one).otherwise(k))
        return F.when(core == "", kept).when(first > 0, longer).otherwise(F.concat(kept, F.array(one))).cast(item)

    both = F.concat(F.coalesce(clauses(old), F.array().cast("array<string>")), F.coalesce(clauses(new), F.array().cast("array<string>")))
    return F.aggregate(both, F.array().cast(item), add, lambda kept: F.transform(kept, lambda k: k["raw"]))


def merged_text(old: Column, new: Column) -> Column:
    """Both texts as one, or null where neither has a clause."""
    han = F.concat_ws("", old, new).rlike(f"[{HAN}]")
    return _with(
        merged_clauses(old, new),
        lambda m: F.when(F.size(m) == 0, F.lit(None)).when(F.size(m) == 1, m[0]).when(han, F.concat(F.array_join(m, "；"), F.lit("。"))).otherwise(F.concat(F.array_join(m, ". "), F.lit("."))),
    )


# --- F24: freshness ----------------------------------------------------------------------------------

# The states of a dependency from best to worst, and the kinds of dependency.
FRESHNESS = ["exact", "compatible", "uncertain", "invalid"]
DEPENDENCY_KINDS = ["file", "git-rev"]
DEPENDS_ON = "array<struct<kind:string,ref:string,expected:array<string>>>"


def dependency_state(kind: Column, current: Column, expected: Column) -> Column:
    """the severity (0 to 3) of one dependency: what it is now against what was expected; the first expected value is the best."""

    def same(e: Column) -> Column:
        return F.when(kind == "git-rev", (e != "") & F.lower(current).startswith(F.lower(e))).otherwise(current == e)

    return F.when(current.isNull(), 3).when(F.coalesce(F.size(expected), F.lit(0)) < 1, 0).when(same(F.get(expected, F.lit(0))), 0).when(F.exists(expected, same), 1).otherwise(2)


def valid_dependencies(depends_on: Column) -> Column:
    """1 to 8 dependencies, each of a known kind, with a ref and at most 8 expected values; else an entry counts as having none."""
    sound = F.forall(
        depends_on,
        lambda x: x["kind"].isin(DEPENDENCY_KINDS) & F.length(x["ref"]).between(1, 500) & (x["expected"].isNull() | (F.size(x["expected"]).between(1, 8) & F.forall(x["expected"], lambda e: F.length(e).between(1, 200)))),
    )
    return F.coalesce(F.size(depends_on).between(1, 8) & sound, F.lit(False))


def entry_freshness(entries: DataFrame, current: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, freshness), the worst state of each entry's dependencies; entries without any are left out.

    `entries` has `depends_on`; `current` has one row (kind, ref, current) for each thing
    that exists.  What files and repositories are now is read outside and comes as a table.
    """
    deps = entries.where(valid_dependencies(F.col("depends_on"))).select(id_col, F.explode("depends_on").alias("d")).select(id_col, "d.kind", "d.ref", "d.expected")
    worst = deps.join(current, ["kind", "ref"], "left").groupBy(id_col).agg(F.max(dependency_state(F.col("kind"), F.col("current"), F.col("expected"))).alias("worst"))
    return worst.select(id_col, reduce(lambda out, k: out.when(F.col("worst") == k, FRESHNESS[k]), range(1, 4), F.when(F.col("worst") == 0, FRESHNESS[0])).alias("freshness"))
