"""Error signatures of a text and the entities a query names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import HAN, normal_entity

# How errors are written, in order of priority.
ERRORS = [
    r"\b[A-Z][A-Za-z0-9]*(?:Error|Exception):\s*[^\n]{4,160}",
    r"\b(?:error|Error|fatal|FATAL|ERROR)\s*:\s*[^\n]{4,160}",
    r"\b[A-Za-z0-9_\-./]+:\s*[^\n]{0,40}\b(?:not found|no such (?:file|directory)|permission denied|undefined reference|command not found)\b[^\n]*",
    r"(?i)\b[A-Za-z0-9_.\-/]{2,60}\s+(?:command )?not found\b",
    r"(?i)\bno such file or directory\b",
    r"\b[A-Za-z0-9_]{3,40}\s+(?:is required|must be|cannot|could not|failed to)\s+[^\n]{3,120}",
    r"\bexit (?:code|status)\s*[:=]?\s*\d{1,4}\b[^\n]{0,80}",
    r"\b(?:4\d\d|5\d\d)\s+(?:Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Request Timeout|Conflict|Gone|Payload Too Large|Unprocessable Entity|Too Many Requests|Internal Server Error|Internal|Not Implemented|Bad Gateway|Service Unavailable|Gateway Timeout)\b",
    "(?:找不到|没有找到|不存在|无法|没有权限|权限被拒|拒绝访问|命令不存在|没有那个文件|连接失败|连接超时|超时|崩溃|段错误|空指针|未定义|报错|异常|失败)[^\\n]{0,24}",
    r"(?:退出码|状态码|错误码|返回码)\s*[:=：]?\s*\d{1,4}",
]
# Words that say nothing alone, error words that are too general alone, and what makes a fragment specific.
EMPTY_WORDS = ["the", "for", "this", "that", "your", "from", "with", "have", "has", "not", "a", "an", "of", "to", "is", "in", "on", "by", "was", "were"]
GENERAL = r"^(?:报错|出错|错误|异常|失败|超时|崩溃|无法|未定义|不能)[了的过着吧呢啊啦哦呀嘛。，！？!?,\s]*$"
SPECIFIC = [(r"\b[A-Z][a-zA-Z]*Error\b", 3), (r"\b[A-Z][a-zA-Z]*Exception\b", 3), (r"(\b|_)E[A-Z]{3,}\b", 2), (r"/[a-zA-Z0-9._\-/]+", 2), (r"\bcode\s*=\s*\d+", 1), (r"\b\d{3}\b", 1), (r"_", 1), (f"[{HAN}]", 1)]


def _worth(x: Column) -> Column:
    """Is a fragment long enough, and more than empty or general words?"""
    han, letters = F.regexp_count(x, F.lit("[\\u4e00-\\u9fff]")), F.regexp_count(x, F.lit("[A-Za-z]"))
    words = F.filter(F.split(F.lower(x), "[^a-z0-9_]+"), lambda w: w != "")
    empty = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(EMPTY_WORDS))
    general = x.rlike(GENERAL) & ~x.rlike(r"[A-Za-z]{3,}|\d{2,}|/")
    return ((F.length(x) >= 6) | (han >= 3)) & ((letters >= 4) | (han >= 2)) & ~empty & ~general


def error_signatures(text: Column, most: int = 4) -> Column:
    """Up to `most` distinct error fragments of at most 160 characters, the most specific first, then by place."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in ERRORS)))
    tidy = F.filter(F.transform(found, lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 160)), _worth)

    def ranked(all_: Column) -> Column:
        def score(key: Column, at: Column) -> Column:
            same = F.filter(all_, lambda y: F.lower(y) == key)
            frag = same[0]
            specific = reduce(lambda a, b: a + b, (frag.rlike(p).cast("int") * n for p, n in SPECIFIC))
            points = specific + F.least(F.lit(2), F.size(same) - 1) - (F.length(frag) > 120).cast("int")
            return F.struct((-points).alias("points"), at.alias("at"), frag.alias("frag"))

        keys = F.array_distinct(F.transform(all_, F.lower))
        return F.transform(F.slice(F.array_sort(F.transform(keys, score)), 1, most), lambda s: s["frag"])

    return F.transform(F.array(tidy), ranked)[0]


# Fixed value: what says that an outcome or a step is of a failure.
FAILURE_HINT = r"(?i)(error|fail|failed|failure|exception|not found|cannot|denied|timeout|拒绝|失败|报错|错误|异常|不能|无法|超时|崩溃)"


def case_signatures(problem: Column, context: Column, outcome: Column, steps: Column, most: int = 4) -> Column:
    """T17 of a case: its problem and context, and its outcome and steps only if they speak of a failure, as outcomes mostly tell of success."""
    tail = F.array_join(F.concat(F.array(F.coalesce(outcome, F.lit(""))), F.coalesce(steps, F.array().cast("array<string>"))), "\n")
    said = F.when((F.trim(tail) != "") & tail.rlike(FAILURE_HINT), tail)
    corpus = F.array_join(F.filter(F.array(problem, context, said), lambda x: F.length(F.trim(x)) > 0), "\n")
    return error_signatures(corpus, most)


# Words that are no entities, and questions that follow a relation, with its predicate.
NO_ENTITIES = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "do", "does", "did", "have", "has", "had", "will", "would",
    "can", "could", "should", "may", "might", "must", "shall",
    "what", "who", "where", "when", "why", "how", "which",
    "this", "that", "these", "those", "it", "its",
    "not", "no", "nor", "but", "and", "or", "if", "then",
    "use", "uses", "used", "using",
    "important", "search", "find", "get", "set", "let", "new",
    "all", "any", "some", "each", "every", "many", "much",
    "my", "your", "his", "her", "our", "their",
    "i", "you", "he", "she", "we", "they", "me", "him", "us", "them",
]
HOPS = [
    (r"(?i)(\w+)'s\s+friends?", "friend_of"),
    (r"(?i)friends?\s+of\s+(\w+)", "friend_of"),
    (r"(?i)who\s+(?:does|did)\s+(\w+)\s+(?:work|collaborate)\s+with", "works_with"),
    (r"(?i)what\s+does\s+(\w+)\s+use", "uses"),
    (r"(?i)what\s+(?:tools?|tech|technologies?)\s+does\s+(\w+)\s+use", "uses"),
    (r"(?i)who\s+(?:uses?|works?\s+with)\s+(\w+)", "uses"),
    (r"(?i)who\s+(?:created|built|wrote|made)\s+(\w+)", "created_by"),
    (r"(?i)who\s+(?:knows?|is\s+familiar\s+with)\s+(\w+)", "knows"),
    (r"(?i)what\s+depends\s+on\s+(\w+)", "depends_on"),
    (r"(?i)(\w+)\s+depend(?:s|encies)", "depends_on"),
    (r"(?i)who\s+manages?\s+(\w+)", "manages"),
    (r"(?i)(\w+)'s\s+team", "member_of"),
    ("(.+?)的朋友", "friend_of"),
    ("谁和(.+?)一起", "works_with"),
    ("(.+?)用(?:了|什么)", "uses"),
    ("谁(?:创建|开发|写)了(.+)", "created_by"),
    ("(.+?)(?:依赖|需要)什么", "depends_on"),
    ("谁(?:认识|了解)(.+)", "knows"),
    ("(.+?)的(?:团队|成员)", "member_of"),
    ("谁管理(.+)", "manages"),
]


def hop_predicate(query: Column) -> Column:
    """The predicate that a query asks to follow, null if it asks for none."""
    out = F.lit(None).cast("string")
    for pattern, predicate in reversed(HOPS):
        out = F.when(query.rlike(pattern), predicate).otherwise(out)
    return out


def query_entities(query: Column, known: list[str] | None = None) -> Column:
    """Names in a query: quoted, capitalised or in camel case, each once.

    Where any of them is among the `known` entities, only those count, as they are written there.
    """
    every = lambda p: F.regexp_extract_all(query, F.lit(p), F.lit(1))
    quoted = F.filter(F.transform(every("[\"'`]([^\"'`]+)[\"'`]"), F.trim), lambda x: F.length(x) >= 2)
    capital = F.filter(every(r"\b([A-Z][a-zA-Z]*(?:[\s-][A-Z][a-zA-Z]*)*)\b"), lambda x: ~F.lower(x).isin(NO_ENTITIES) & (F.length(x) >= 2))
    names = F.transform(F.concat(quoted, capital, every(r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)+)\b")), normal_entity)
    once = F.transform(F.array(F.filter(names, lambda x: F.length(x) >= 2)), lambda a: F.transform(F.array_distinct(F.transform(a, F.lower)), lambda k: F.filter(a, lambda x: F.lower(x) == k)[0]))[0]
    if not known:
        return once
    written = F.create_map(*(F.lit(x) for e in known for x in (e.lower(), e)))
    valid = F.filter(F.transform(once, lambda x: written[F.lower(x)]), lambda x: x.isNotNull())
    return F.when(F.size(valid) > 0, valid).otherwise(once)
