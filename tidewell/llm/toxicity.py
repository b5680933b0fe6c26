"""6. Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words, one of toxic and
one of ordinary texts.  Only the highest order has counts of its own for each
class; what it lacks comes from continuation counts that both share and that are
gathered over *all* documents, so a rare expression is smoothed alike in both and
only evidence separates them.  What makes a text toxic may be a few words of thousands,
so a toxic text is one that has a toxic passage of `passage` words anywhere, all places
alike likely, and is ordinary beside it.  A text's evidence is the log-likelihood of
being so less that of being ordinary throughout, normalised by the passage's length: the
logarithm of the mean, over the passages at every word, of their likelihood ratios.  It
does not grow with the length of an ordinary text, as a maximum would.  A text shorter
than a passage is one.  Logistic calibration on labelled rows that the counts have not
seen turns evidence into a score.

All counts are exact: each gram and each context has its own 64-bit key and no two
share a count, so the tables grow with what the corpus holds.  The class counts come
from a bounded sample of labelled rows (`per_class`); the shared counts cover all
documents.  Where neither class has seen a context, both models give the shared chance
and the ratio is 0, so only shared counts below contexts of the sample are gathered:
every document's grams count, and none that can matter is left out.

Nulls count as empty texts.  Texts without words have evidence 0; very long texts are
read whole.  Repeated rows each get a row, and equal texts equal scores, so there are no
ties to break; an id with both labels counts as toxic, a row without an id has no label.
An empty table gives an empty result; without labels of both kinds every score is 0.
Further columns are neither read nor returned (drop_toxic returns them as they are).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ID, TEXT, WORDS, crc_fold, held_out, keep_rows, labelled_sample, map_text, mix64, pick, text_batches, to_pandas

ORDER, DISCOUNT, PASSAGE = 5, 0.75, 4
UNSEEN = 1 / 256  # chance of a character below order 1
find_words = re.compile(WORDS).findall


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, position in the word) of the words, each between a start and an end mark."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.arange(len(codes))
    return codes, at - np.maximum.accumulate(np.where(codes == 2, at, 0))


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rolling keys of the 0- to ORDER-grams that end at each character, and the characters' positions."""
    codes, pos = characters(words)
    keys = [np.zeros(len(codes), dtype=np.uint64)]
    for _ in range(ORDER):
        before = np.concatenate([[np.uint64(0)], keys[-1][:-1]])
        keys.append(before * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1))
    return keys, pos


def place(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys under which grams of an order, or their contexts, stand in the tables."""
    return mix64(keys + np.uint64(order * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted table, or -1.  Distinct keys are looked up once and in order, so the search walks the table instead of jumping about in it."""
    if not len(table):
        return np.full(len(keys), -1)
    keys, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)[back]


def top(keys: list[np.ndarray], pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each character but start marks: (index, key of the longest gram within the word, key of its context)."""
    at = np.flatnonzero(pos > 0)
    order = np.minimum(pos[at] + 1, ORDER)
    gram, context = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for k in range(2, ORDER + 1):
        own = order == k
        gram[own] = place(keys[k][at[own]], k)
        context[own] = place(keys[k - 1][at[own] - 1], k)
    return at, gram, context


class Evidence(dict):
    """word -> log-likelihood ratio in nats; remembers words worth at most `most` characters and works out new ones many at a time."""

    def __init__(self, model: dict[str, np.ndarray], most: int = 5_000_000) -> None:
        super().__init__()
        self.model, self.most, self.held = model, most, 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if self.held > self.most:
            self.clear()
            self.held, new = 0, list(words)
        self.held += sum(map(len, new))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.update(zip(part, self.ratio(part).tolist(), strict=True))

    def ratio(self, words: list[str]) -> np.ndarray:
        m = self.model
        keys, pos = grams(words)
        at, g, h = top(keys, pos)
        h = find(m["contexts"], h)
        at, g, h = at[h >= 0], find(m["grams"], g[h >= 0]), h[h >= 0]
        shared = np.full(len(at), UNSEEN)
        for k in range(1, ORDER):
            own = np.flatnonzero(pos[at] >= k)  # a start mark is in no shared gram
            here = at[own]
            below = find(m["shared_contexts"], place(keys[k - 1][here - 1], k))
            own, here, below = own[below >= 0], here[below >= 0], below[below >= 0]
            gram = find(m["shared_grams"], place(keys[k][here], k))
            count = np.where(gram >= 0, m["shared"][gram], 0) if len(m["shared"]) else 0
            shared[own] = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * m["shared_kinds"][below] * shared[own]) / m["shared_total"][below]
        logs = []
        for c in (0, 1):
            total = m["total"][c][h]
            p = (np.maximum(np.where(g >= 0, m["count"][c][g], 0) - DISCOUNT, 0) + DISCOUNT * m["kinds"][c][h] * shared) / np.maximum(total, 1) if len(h) else shared
            logs.append(np.log(np.where(total > 0, p, shared)))
        return np.bincount(np.cumsum(pos == 0)[at] - 1, logs[1] - logs[0], minlength=len(words))


def tables(g: np.ndarray, h: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(gram keys in order, their counts; context keys in order, their totals and numbers of grams) from one row for each gram."""
    g, h = g.view(np.uint64), h.view(np.uint64)
    order = np.argsort(g)
    contexts, back = np.unique(h, return_inverse=True)
    n = len(contexts)
    return g[order], [c[order] for c in counts], contexts, [np.bincount(back, c, minlength=n) for c in counts], [np.bincount(back, c > 0, minlength=n) for c in counts]


def gather_shared(docs: DataFrame, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Continuation counts, over all documents, of the orders below the highest: of all grams whose context is `wanted`."""
    held_contexts = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros((0, 3), np.uint64)
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]].view(np.int64)
            held.clear()
            return pa.record_batch([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["gram", "g", "h"])

        for _, texts in text_batches(batches):
            words = {w for t in texts for w in find_words(t.lower())} - done
            if len(done) > 400_000:
                done.clear()
            done |= words
            listed = list(words)
            for i in range(0, len(listed), 20_000):
                keys, pos = grams(listed[i : i + 20_000])
                for k in range(1, ORDER):  # a gram of k + 1 continues the gram of k at its end
                    at = np.flatnonzero(pos >= k)
                    at = at[np.unique(keys[k + 1][at], return_index=True)[1]]
                    h = place(keys[k - 1][at - 1], k)
                    own = find(held_contexts.value, h) >= 0
                    at, h = at[own], h[own]
                    held.append(np.stack([place(keys[k + 1][at], k + 1), place(keys[k][at], k), h], axis=1))
            if sum(map(len, held)) > 2_000_000:
                yield out()
        yield out()

    distinct = map_text(docs, run, "gram long, g long, h long").groupBy("gram").agg(F.first("g").alias("g"), F.first("h").alias("h"))
    rows = to_pandas(distinct.groupBy("g").agg(F.count("*").alias("n"), F.first("h").alias("h")))
    g, (n,), h, (total,), (kinds,) = tables(rows["g"].to_numpy(np.int64), rows["h"].to_numpy(np.int64), [rows["n"].to_numpy(np.float64)])
    return {"shared_grams": g, "shared": n.astype(np.float32), "shared_contexts": h, "shared_total": total, "shared_kinds": kinds}


def gather_classes(docs: DataFrame, sample: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of the highest order in each class, over the sampled rows, and the shared contexts below its contexts.

    `sample` has a known bound, so it is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch, texts in text_batches(batches):
            for t, c in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
                counts[int(c)].update(find_words(t.lower()))
        words = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            keys, pos = grams(part)
            at, g, h = top(keys, pos)
            word = np.cumsum(pos == 0)[at] - 1
            weight = [np.array([counts[c][w] for w in part], np.float64)[word] for c in (0, 1)]
            g, first, back = np.unique(g, return_index=True, return_inverse=True)
            below = np.unique(np.concatenate([place(keys[k - 1][np.flatnonzero(pos >= k) - 1], k) for k in range(1, ORDER)]))
            none = np.zeros(len(below))  # a shared context is a row without counts
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([g, below]).view(np.int64)),
                    pa.array(np.concatenate([h[first], below]).view(np.int64)),
                    *(pa.array(np.concatenate([np.bincount(back, w, minlength=len(g)), none])) for w in weight),
                ],
                names=["g", "h", "n0", "n1"],
            )

    picked = docs.join(F.broadcast(sample), ID).select(ID, TEXT, F.col("label").cast("int").alias("label"))
    rows = to_pandas(map_text(picked, run, "g long, h long, n0 double, n1 double").groupBy("g").agg(F.first("h").alias("h"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    counted = (rows["n0"] + rows["n1"] > 0).to_numpy(bool)
    wanted = np.sort(rows["g"].to_numpy(np.int64)[~counted].view(np.uint64))
    rows = rows[counted]
    g, count, h, total, kinds = tables(rows["g"].to_numpy(np.int64), rows["h"].to_numpy(np.int64), [rows[c].to_numpy(np.float64) for c in ("n0", "n1")])
    return {"grams": g, "count": count, "contexts": h, "total": total, "kinds": kinds}, wanted


def text_evidence(ratios: np.ndarray, passage: int = PASSAGE) -> float:
    """Log of the mean likelihood ratio of the passages, by word of a passage; `ratios` are the words' log ratios."""
    if len(ratios) <= passage:
        return float(ratios.mean()) if len(ratios) else 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = sums[passage:] - sums[:-passage]
    top = sums.max()
    return float((top + np.log(np.exp(sums - top).mean())) / passage)


def passages(texts: list[str], known: Evidence, passage: int) -> list[float]:
    """Evidence of each text."""
    words = [find_words(t.lower()) for t in texts]
    known.learn(set().union(*words))
    return [text_evidence(np.fromiter(map(known.__getitem__, w), np.float64, len(w)), passage) for w in words]


def evidence(docs: DataFrame, model: object, passage: int = PASSAGE, keep: str = "") -> DataFrame:
    """(ID, evidence, and a column of `docs` named in `keep`) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(model.value)
        for batch, texts in text_batches(batches):
            yield pa.record_batch([batch.column(0), pa.array(passages(texts, known, passage), pa.float64()), *([batch.column(batch.schema.get_field_index(keep))] if keep else [])], names=[ID, "evidence", *([keep] if keep else [])])

    return map_text(docs, run, f"{ID} long, evidence double" + (f", {keep} int" if keep else ""))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a slight pull to zero, on standardised evidence."""
    weight = np.ones_like(x) if weight is None else weight
    mean = np.average(x, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, weights=weight)) or 1.0
    a = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (weight * (p - y)) + 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 1e-6) / scale
    return float(slope), float(w[1] - slope * mean)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, label_id_col: str, per_class: int, seed: int, passage: int = PASSAGE) -> tuple[object, tuple[float, float] | None]:
    """(broadcast model, logistic slope and offset or None without labels of both kinds) from `docs` (ID, TEXT).

    Learns from labels of ids whose crc32 modulo 4 is 0 or 1 (counts) or 3
    (calibration), at most about `per_class` rows of each label and purpose.
    """
    labels = labels.select(F.col(label_id_col), F.col(label_col).cast("int").alias(label_col)).where(F.col(label_col).isin(0, 1))
    fold = crc_fold(F.col(ID))
    train = labelled_sample(labels, label_id_col, label_col, per_class, seed, fold.isin(0, 1))
    check = labelled_sample(labels, label_id_col, label_col, per_class, seed + 1, fold == 3)
    classes, wanted = gather_classes(docs, train)
    model = docs.sparkSession.sparkContext.broadcast(gather_shared(docs, wanted) | classes)
    seen = evidence(docs.join(F.broadcast(check), ID).select(ID, TEXT, F.col("label").cast("int").alias("label")), model, passage, "label")
    seen = to_pandas(seen.groupBy("label", F.round("evidence", 3).alias("x")).agg(F.count("*").alias("n")))  # an id may repeat: counts, not rows
    if seen["label"].nunique() < 2:
        return model, None
    return model, calibrate(seen["x"].to_numpy(float), seen["label"].to_numpy(float), seen["n"].to_numpy(float))


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
    per_class: int = 15_000,
    threshold: float = 0.3,
    seed: int = 6,
    passage: int = PASSAGE,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    docs = pick(df, id_col, text_col)
    model, curve = fit(docs, labels, label_col, label_id_col, per_class, seed, passage)
    score = 1 / (1 + F.exp(-(F.lit(curve[0]) * F.col("evidence") + F.lit(curve[1])))) if curve else F.lit(0.0)
    out = evidence(docs, model, passage).select(F.col(ID).alias("doc_id"), held_out(F.col(ID)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
    per_class: int = 15_000,
    threshold: float = 0.3,
    seed: int = 6,
    passage: int = PASSAGE,
) -> DataFrame:
    """`df` without the rows that score_toxicity() predicts to be toxic; its columns and other rows stay as they are.

    Rows that repeat, or have no id or text, are kept or dropped by their text alone; without
    labels of both kinds all rows stay.
    """
    model, curve = fit(pick(df, id_col, text_col), labels, label_col, label_id_col, per_class, seed, passage)
    if not curve:
        return df
    most = (np.log(threshold / (1 - threshold)) - curve[1]) / curve[0]  # evidence at the threshold

    def start() -> object:
        known = Evidence(model.value)
        return lambda texts: [x < most for x in passages(texts, known, passage)]

    return keep_rows(df, text_col, start)
