"""Cutting texts: semantic chunks with overlap, event segments, and merging of dialogue turns.  Per text, so Arrow-batched UDFs fit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
# Role tags, and how a line says that something new begins.
USER, ASSISTANT = "[用户]", "[助手]"
TOPIC_SHIFTS = (
    r"^(?:\[用户\]|\[助手\])?\s*(?:另外|顺便|对了|换个话题|说到|关于另一个)",
    r"(?i)^(?:\[用户\]|\[助手\])?\s*(?:by the way|speaking of|on another note|moving on|anyway|also,? I wanted)",
    r"^(?:\[用户\])\s*.{0,20}[？?]\s*$",
)
TIME_JUMP = r"(?i)^(?:\[用户\]|\[助手\])?\s*(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:今天|昨天|前天|上周|上个月|today|yesterday|last week))"
LIST_ITEM = r"^\s*(?:\d+[.)]\s|[-*+]\s)"
_SHIFTS, _JUMP, _ITEM = [re.compile(x, re.ASCII) for x in TOPIC_SHIFTS], re.compile(TIME_JUMP, re.ASCII), re.compile(LIST_ITEM, re.ASCII)


def chunks(text: str | None, most: int = 1000, overlap: int = 100) -> list[str]:
    """Runs of whole sentences of up to `most` characters, each starting with the end of the one before.

    A sentence longer than that is cut.  Nothing of a text is lost.
    """
    if not text or not text.strip():
        return []
    parts: list[str] = []
    for s in filter(None, (x.strip() for x in _SENTENCE.split(text))):
        parts += [s[i : i + most] for i in range(0, len(s), most)]
    out: list[str] = []
    at = ""
    for s in parts:
        if at and len(at) + 1 + len(s) > most:
            out.append(at)
            tail = at[-overlap:].partition(" ")[2] if overlap else ""
            at = f"{tail} {s}".strip() if len(tail) + 1 + len(s) <= most else s
        else:
            at = f"{at} {s}".strip()
    return [*out, at] if at else out


class Segmenter:
    """A text's lines to event segments (kind, text), in one pass; kind says why a segment ended.

    A new topic, a new question after an answer, a jump in time and the end of a list end a
    segment of at least `least` characters, and so does a line that would make it longer than
    `most`; code blocks and lists stay whole, but for a block of over twice `most` characters.
    The last segment is `initial` if it is the only one, else `max_size`; if it is shorter
    than `least`, it joins the one before.
    """

    def __init__(self, most: int = 2000, least: int = 200) -> None:
        self.most, self.least = most, least

    def kind_of(self, line: str, before: str, list_ended: bool) -> str | None:
        if any(p.search(line) for p in _SHIFTS):
            return "topic_shift"
        if line.startswith(USER) and before.lstrip().startswith(ASSISTANT):
            return "qa_boundary"
        if _JUMP.search(line):
            return "time_jump"
        return "list_end" if list_ended else None

    def pieces(self, text: str) -> Iterator[tuple[str, list[str]]]:
        held: list[str] = []
        size, code, listed = 0, False, False
        for line in text.split("\n"):
            grown = size + len(line) + 1
            if line.strip().startswith("```"):
                code = not code
            elif code:
                if grown > 2 * self.most:
                    yield "code_block", [*held, line]
                    held, size, code = [], 0, False
                    continue
            elif _ITEM.search(line):
                listed = True
            else:
                ended = listed and bool(line.strip())
                listed = listed and not ended
                kind = None
                if size >= self.least:
                    kind = self.kind_of(line, held[-1] if held else "", ended) or ("max_size" if grown > self.most else None)
                if kind:
                    yield kind, held
                    held, grown = [], len(line) + 1
            held.append(line)
            size = grown
        if held:
            yield "", held

    def segments(self, text: str | None) -> list[tuple[str, str]]:
        if not text or not text.strip():
            return []
        if len(text) <= self.least:
            return [("initial", text.strip())]
        out: list[tuple[str, str]] = []
        for kind, lines in self.pieces(text):
            segment = "\n".join(lines).strip()
            if segment:
                out.append((kind or ("max_size" if out else "initial"), segment))
        if len(out) > 1 and len(out[-1][1]) < self.least:
            _, last = out.pop()
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{last}")
        return out


@F.udtf(returnType="segment_no int, segment_kind string, segment string")
class EventSegments:
    """T8 as a table function of (text, most, least): a row for each segment of a text."""

    def eval(self, text: str, most: int, least: int) -> Iterator[tuple[int, str, str]]:
        for n, (kind, segment) in enumerate(Segmenter(most, least).segments(text)):
            yield n, kind, segment


def event_segments(df: DataFrame, text_col: str = "text", most: int = 2000, least: int = 200) -> DataFrame:
    """`df` with segment_no, segment_kind and segment, a row for each segment of its text; texts without any give no row."""
    return df.lateralJoin(EventSegments(F.col(text_col).outer(), F.lit(most), F.lit(least)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_column(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)
