"""10. Quality classifier by importance resampling.

Words and punctuation runs, and pairs of neighbours, are hashed into a fixed number
of buckets.  Two smoothed multinomial models over the buckets, one of target texts
(labelled good; a bounded sample) and one of raw texts (all documents), give every
document its importance weight, the ratio of its chances under the two; log_weight is
its logarithm, the sum of the n-grams' log ratios.  Adding Gumbel noise and keeping the
k largest keys samples k documents without replacement in proportion to their weights.

The k-th largest key is found by narrowing: keys are counted in bins, the bin with
the cut is counted in finer bins, and only the rows of the last bin are ordered, by
counts of equal keys; no task or driver holds all keys.

Nulls count as empty texts; a text without n-grams says nothing for itself and is drawn
last.  Very long texts are read whole.  Noise comes from id and text: rows that repeat both
have equal keys, and which of them is drawn cannot be told apart.  An empty table gives
an empty result; without target rows all weights are 1.  Further columns are neither read
nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ID, ROW, TEXT, WordHash, cut, first_rows, labelled_sample, map_text, mix64, pick, text_batches, to_pandas

BITS = 16
TOKENS = re.compile(r"\w+|[^\w\s]+").findall
EMPTY = -1e15


def buckets(text: str, known: WordHash) -> np.ndarray:
    """Buckets of a text's tokens and of its pairs of neighbouring tokens."""
    h = known.of(TOKENS(text))
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs; a task sends one row for each bucket it saw, whatever it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(1 << BITS, np.int64), WordHash()
        for _, texts in text_batches(batches):
            for t in texts:
                counts += np.bincount(buckets(t, known), minlength=1 << BITS) if len(t) > 20_000 else 0
            rest = [buckets(t, known) for t in texts if len(t) <= 20_000]
            if rest:
                counts += np.bincount(np.concatenate(rest), minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["b", "n"])

    rows = to_pandas(map_text(docs, run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")))
    out = np.zeros(1 << BITS)
    out[rows["b"].to_numpy(np.int64)] = rows["n"]
    return out


def select_top(keys: DataFrame, key: str, tie: str, k: int, bins: int = 4096) -> DataFrame:
    """`keys` with `selected`: the k rows with the largest key, ties by the smaller `tie` (not null), then by ROW.  `keys` must be cheap to read again."""
    n, low, high = keys.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= n or not n:
        return keys.withColumn("selected", F.lit(True))
    if k <= 0:
        return keys.withColumn("selected", F.lit(False))
    above = 0  # rows over `high`, all selected
    inside = F.lit(True)
    for _ in range(8):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)))
        counts = dict(keys.where(inside).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        low, high = keys.where(inside & (bin_ == b)).agg(F.min(key), F.max(key)).first()
        inside = F.col(key).between(low, high)
        if counts[b] <= 50_000 or low == high:
            break
    last = keys.where(inside).withColumns({"__all": F.lit(0), "__k": F.lit(k - above), "__down": -F.col(key), "__task": F.shiftrightunsigned(ROW, 33)})
    chosen = first_rows(cut(last), ["__all"], "__k", ["__down", tie, "__task", ROW], n)
    return keys.where(~inside).withColumn("selected", F.col(key) > high).unionByName(chosen.withColumnRenamed("chosen", "selected").select(*keys.columns, "selected"))


def resample(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    label_id_col: str = "doc_id",
    share: float = 0.5,
    mean_scale: float | None = None,
    target_rows: int = 20_000,
    smoothing: float = 1.0,
    seed: int = 10,
) -> DataFrame:
    """(doc_id, log_weight, key, selected) of each row; `selected` marks the sampled `share` of all rows.

    Targets are about `target_rows` rows labelled 1.  With `mean_scale` (off by default)
    log_weight is that many times the *mean* log ratio instead of the sum, which keeps a
    text's length out of its weight but is no longer the ratio of the two models.
    """
    spark, docs = df.sparkSession, pick(df, id_col, text_col)
    good = labelled_sample(labels.where(F.col(label_col) == 1), label_id_col, label_col, target_rows, seed)
    target, raw = bucket_counts(docs.join(F.broadcast(good), ID).select(ID, TEXT)), bucket_counts(docs)
    smooth = lambda c: np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c))
    ratio = spark.sparkContext.broadcast((smooth(target) - smooth(raw) if target.sum() else np.zeros(1 << BITS)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, r = WordHash(), ratio.value
        for batch, texts in text_batches(batches):
            found = (buckets(t, known) for t in texts)
            sums = [(float(r[b].sum(dtype=np.float64)) if mean_scale is None else mean_scale * float(r[b].mean(dtype=np.float64))) if len(b) else EMPTY for b in found]
            h = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed=seed) >> 1 for t in texts]
            yield pa.record_batch([*batch.columns[:2], pa.array(sums, pa.float64()), pa.array(h, pa.int64())], names=[ID, ROW, "log_weight", "h"])

    uniform = (F.pmod(F.xxhash64(F.col(ID), "h", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    numbered = docs.select(ID, F.monotonically_increasing_id().alias(ROW), TEXT)
    keys = cut(map_text(numbered, run, f"{ID} long, {ROW} long, log_weight double, h long").withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    keys = keys.withColumn("tie", F.coalesce(F.col(ID), F.lit((1 << 63) - 1)))
    return select_top(keys, "key", "tie", round(share * keys.count())).select(F.col(ID).alias("doc_id"), "log_weight", "key", "selected")
