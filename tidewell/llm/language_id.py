"""8. Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are its character 1- to 4-grams, marks for its start and end
included; each is hashed to a row of an embedding table.  A text is the average of
its subwords' embeddings, and a linear softmax over that gives the languages.  Both
are trained together by stochastic gradient descent in numpy on a bounded sample:
about `per_language` rows of each language (fewer if that were over `most_rows` in all),
of each up to `each` windows of `window` words drawn from all over the text, however
long it is.  The windows are cut on the executors; no whole text comes to the driver.
A temperature fitted on documents outside the training rows calibrates the scores,
and `accepted` rejects predictions below the lowest score at which those documents
are right at least `precision` of the time.

As the model is linear, a word has one sum of logits however long its text is: words
are looked up, new ones are worked out many at a time, and every whole text is read
once without a shuffle.

Texts that are null or have no letter are `und` with score 0.  Repeated rows each get
a row and count once in the sample; a row without an id is not learned from.  Of languages
equally likely the first in order is predicted.  An empty table gives an empty result;
with no languages to learn all are `und`.  Further columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ID, TEXT, WORDS, crc_fold, held_out, labelled_texts, map_text, mix64, pick, text_batches, to_pandas

BITS, WIDTH, LONGEST = 16, 16, 4
find_words = re.compile(WORDS).findall
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter (a run may also be of number signs)."""
    words = find_words(text.lower())
    return words if any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w) else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every subword of the words."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.arange(len(codes))
    start = codes == 2
    word, pos = np.cumsum(start) - 1, at - np.maximum.accumulate(np.where(start, at, 0))
    key, buckets, owners = np.zeros(len(codes), np.uint64), [], []
    for k in range(1, LONGEST + 1):
        key = np.concatenate([[np.uint64(0)], key[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1)
        whole = np.flatnonzero((pos >= k - 1) & ((k > 1) | ((codes != 2) & (codes != 3))))
        buckets.append((mix64(key[whole] + np.uint64(k << 56)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


LETTERS = 30  # a longer run of letters is several words to a window


def windows_of(text: str, window: int, each: int, seed: int) -> list[str]:
    """Up to `each` windows of `window` words, drawn from the whole text; none of over window * (LETTERS + 1) characters."""
    words = [w[i : i + LETTERS] for w in words_of(text) for i in range(0, len(w), LETTERS)]
    n = max(1, len(words) // window) if words else 0
    drawn = range(n) if n <= each else sorted(np.random.default_rng(seed + len(words)).choice(n, each, replace=False))
    return [" ".join(words[i * window : (i + 1) * window]) for i in drawn]


def sampled_windows(rows: DataFrame, window: int, each: int, seed: int) -> tuple[list[str], list[str]]:
    """Windows of the sampled texts and their labels, in an order that no partitioning changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            pairs = [(w, c) for t, c in zip(texts, labels, strict=True) for w in windows_of(t, window, each, seed)]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["text", "label"])

    found = to_pandas(map_text(rows.select(TEXT, "label"), run, "text string, label string")).sort_values(["label", "text"])
    return found["text"].tolist(), found["label"].tolist()


def train(xs: list[np.ndarray], y: np.ndarray, classes: int, epochs: int = 4, batch: int = 64, rate: float = 0.5, seed: int = 8) -> np.ndarray:
    """Logits of each bucket: the embedding table times the softmax weights, after gradient descent on both."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    weights = rng.normal(0, 0.1, (WIDTH, classes))
    steps, done = epochs * max(1, -(-len(xs) // batch)), 0
    for _ in range(epochs if len(xs) else 0):
        order = rng.permutation(len(xs))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            flat, lengths = np.concatenate([xs[j] for j in own]), np.array([len(xs[j]) for j in own])
            used, back = np.unique(flat, return_inverse=True)
            row = np.repeat(np.arange(len(own)), lengths)
            share = np.bincount(row * len(used) + back, minlength=len(own) * len(used)).reshape(len(own), -1) / lengths[:, None]
            mean = share @ table[used]
            error = softmax(mean @ weights)
            error[np.arange(len(own)), y[own]] -= 1
            step = rate * (1 - done / steps)
            # The mean over a batch for the weights; for an embedding row the sum over the texts that use it.
            to_table = share.T @ (error @ weights.T)
            weights -= step * (mean.T @ error) / len(own)
            table[used] -= step * 10 * to_table
            done += 1
    return (table @ weights).astype(np.float32)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the right classes likeliest."""
    grid = np.geomspace(0.02, 20, 61)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class WordLogits(dict):
    """word -> (sum of its subwords' logits, number of subwords) as a row of `rows`."""

    def __init__(self, logits: np.ndarray, most: int = 500_000) -> None:
        super().__init__()
        self.logits, self.most = logits, most
        self.rows = np.zeros((1 << 14, logits.shape[1] + 1), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            bucket, word = subwords(part)
            at = len(self)
            while at + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for c in range(self.logits.shape[1]):
                self.rows[at : at + len(part), c] = np.bincount(word, self.logits[bucket, c], minlength=len(part))
            self.rows[at : at + len(part), -1] = np.bincount(word, minlength=len(part))
            self.update(zip(part, range(at, at + len(part)), strict=True))

    def mean(self, words: list[str]) -> np.ndarray:
        sums = self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return sums[:-1] / max(sums[-1], 1)


def document_logits(texts: list[str], known: WordLogits) -> np.ndarray:
    words = [words_of(t) for t in texts]
    known.learn(set().union(*words))
    return np.array([known.mean(w) if w else np.full(known.logits.shape[1], np.nan) for w in words])


def label_logits(rows: DataFrame, model: object) -> tuple[np.ndarray, np.ndarray]:
    """(logits, label) of the sampled rows' whole texts, worked out where they are; texts without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordLogits(model.value)
        for batch, texts in text_batches(batches):
            z = document_logits(texts, known)
            some = np.flatnonzero(~np.isnan(z[:, 0]))
            yield pa.record_batch([pa.array([z[i].tolist() for i in some], pa.list_(pa.float64())), batch.column(batch.schema.get_field_index("label")).take(pa.array(some))], names=["z", "label"])

    found = to_pandas(map_text(rows.select(TEXT, "label"), run, "z array<double>, label string"))
    return np.array(found["z"].tolist(), dtype=float), found["label"].to_numpy(dtype=object)


def identify_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1_500,
    window: int = 25,
    each: int = 8,
    precision: float = 0.99,
    most_rows: int = 60_000,
    seed: int = 8,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row.

    Learns from at most about `per_language` rows of each language among ids whose crc32
    modulo 4 is 0 or 1; a third as many with 3 calibrate.
    """
    spark, docs = df.sparkSession, pick(df, id_col, text_col)
    labelled = pick(df, id_col, text_col, label=lang_col).withColumn("label", F.col("label").cast("string")).where(F.col(ID).isNotNull() & F.col("label").isNotNull() & (F.length(TEXT) > 0))
    fold = crc_fold(F.col(ID))
    texts, langs = sampled_windows(labelled_texts(labelled.where(fold.isin(0, 1)), per_language, seed, most_rows), window, each, seed)
    names = sorted(set(langs))
    if not names:
        return docs.select(F.col(ID).alias("doc_id"), held_out(F.col(ID)).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    logits = train([subwords(t.split(" "))[0] for t in texts], np.searchsorted(names, np.array(langs, dtype=object)), len(names), seed=seed)
    z, truth = label_logits(labelled_texts(labelled.where((fold == 3) & F.col("label").isin(names)), per_language // 3, seed + 1, most_rows), spark.sparkContext.broadcast(logits))
    t, least = 1.0, 0.0
    if len(z):
        truth = np.searchsorted(names, truth)
        t = temperature(z, truth)
        p = softmax(z / t)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    model = spark.sparkContext.broadcast((logits, names, t, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, names, t, least = model.value
        known = WordLogits(logits)
        for batch, texts in text_batches(batches):
            z = document_logits(texts, known)
            none = np.isnan(z[:, 0])
            p = softmax(np.where(none[:, None], 0, z) / t)
            score = np.where(none, 0.0, p.max(axis=1))
            langs = [UNKNOWN if n else names[i] for n, i in zip(none, p.argmax(axis=1), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(~none & (score >= least))], names=["doc_id", "lang_pred", "score", "accepted"])

    out = map_text(docs, run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
