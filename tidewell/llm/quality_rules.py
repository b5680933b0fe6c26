"""11. Quality rules: a table of thresholds compiled into one Spark projection.

A rule bounds a ratio of two counts of a text: `low` <= 100 * part / whole <= `high`.
Ratios are compared in integers (100 * part against bound * whole), so nothing is rounded
and nothing divides by zero.  Every count is an expression of the text alone: one pass, no
shuffle, no user function, and a lost task is simply run again.

Words are runs of anything but the space and the characters 9 to 13.  A run of three words
repeats if the same three words, in order, stand elsewhere in the text.  The runs of a text
are sorted with their places, which finds equal ones as neighbours; so a text of n words
costs n log n, however often it repeats itself.

Null and empty texts have no words: all counts are 0, base_failed is true and kept false.
Very long texts are read whole.  Repeated rows and ids, and null ids, give one row each.
Columns other than the two that are named are neither read nor returned.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ID, TEXT, pick

BLANK = r"\x20\x09-\x0D"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind über um und von vor war wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre era es esta este ha la las lo los más no o para pero por que se sin sobre son su sus también un una y ya"
).split()


class Rule(NamedTuple):
    """`low` <= 100 * part / whole <= `high`, both bounds whole numbers or None; a whole of 0 breaks no rule."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("words_with_letters", "n_letter_words", "n_words", 70, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once, however often the body and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words stand in a run of three that the text has more than once.

    Words hold no blanks, so three joined by a blank are equal only if the words are.
    """
    place = lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))
    runs = F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), place))

    def covered(s: Column) -> Column:
        twin = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
        places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"]

    return let(runs, covered)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    words_of = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    lines_of = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    long = lambda c, name: c.cast("long").alias(name)
    by_words = lambda w: F.struct(
        long(F.size(w), "n_words"),
        long(F.length(F.array_join(w, "")), "word_chars"),
        long(_repeated_words(w), "n_repeat_words"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))), "n_stop_words"),
        long(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), "n_letter_words"),
    )
    by_lines = lambda x: F.struct(
        long(F.size(x), "n_lines"),
        long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"),
        long(F.size(F.filter(x, lambda y: y.rlike(f"^[{BLANK}]*[-*•]"))), "n_bullet_lines"),
        long(F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…)[{BLANK}]*\z"))), "n_ellipsis_lines"),
    )
    symbols = long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), "n_symbols")
    return F.struct(let(words_of, by_words).alias("w"), let(lines_of, by_lines).alias("l"), symbols)


def broken(rules: Sequence[Rule], count: Callable[[str], Column]) -> Column:
    """The names of the rules that a text breaks, in the table's order."""

    def breaks(r: Rule) -> Column:
        part, whole = 100 * count(r.part), count(r.whole)
        out = F.lit(False)
        if r.low is not None:
            out = out | (part < r.low * whole)
        if r.high is not None:
            out = out | (part > r.high * whole)
        return F.when(out & (whole > 0), F.lit(r.name))

    return F.array_compact(F.array(*map(breaks, rules))) if rules else F.array().cast("array<string>")


FIELDS = {
    "w": ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_letter_words"),
    "l": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"),
}


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, broken) of each row; `broken` names the rules that the text breaks.

    base_failed: under `least_words` words, or over `most_repeated` per cent of them in repeated
    runs.  kept: not base_failed, and no rule broken.
    """

    def verdict(c: Column) -> Column:
        count = lambda name: next((c[part][name] for part, names in FIELDS.items() if name in names), c["n_symbols"])
        n, repeats = count("n_words"), count("n_repeat_words")
        failed = (n < least_words) | (100 * repeats > most_repeated * n)
        names = [*FIELDS["w"], *FIELDS["l"], "n_symbols"]
        return let(broken(rules, count), lambda b: F.struct(*(count(x).alias(x) for x in names), failed.alias("base_failed"), (~failed & (F.size(b) == 0)).alias("kept"), b.alias("broken")))

    judged = pick(df, id_col, text_col).select(F.col(ID).alias("doc_id"), let(let(F.coalesce(F.col(TEXT), F.lit("")), _counts), verdict).alias("r"))
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    more = ("n_stop_words", "n_letter_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "broken")
    return judged.select("doc_id", *(f"r.{x}" for x in first + more))
