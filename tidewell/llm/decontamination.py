"""3. Benchmark decontamination by a BM25 inverted index with block-max WAND.

The index is of the *test items*; every passage of every training text is a query.  A
passage is 128 words, a new one starts every 64, and an item longer than 64 words is
indexed in equal segments of at most that length, so each segment lies whole in some passage.  Scores
are BM25 as a share of the item's score against itself, so one threshold fits items of
any length.

* Upper bounds first: an item's terms are split into essential ones and a rest whose
  weights sum to less than half the threshold.  A passage can reach the threshold only
  if its essential terms alone bring what the rest cannot; this is summed for all
  passages of a batch at once and drops no passage that could pass.
* Block-max WAND then runs each passage that is left against the whole index and
  retrieves every item at or above the threshold.
* A retrieved item counts only if the text really overlaps both its question and its
  answer: of each, the share of the words covered by common word trigrams (or by shorter
  n-grams of a part that has fewer words) in any passage, over all segments of the item.
  A segment's part also counts if at most one of its words is missing where the rest of
  the segment puts it, so one changed word clears no copy; of a part of one word, the
  rest of the item then decides.  A long question without its answer is no leak.
* An item of fewer than 7 words (`SHORT`) counts only where all its words follow each other
  in the text, question and answer alike.  One without a question or without an answer, such
  as a lone word or a bare short question, has nothing to verify and is never a leak.

The index goes to the executors in shards of at most `shard_chars` characters of items
(about 30 bytes of index for each); a larger benchmark takes one pass over the texts for
each shard, and a shard's broadcast is released before the next is made.  Texts, however
long, stream through without a shuffle.  Null or empty texts and items match nothing;
repeated rows of the texts each give their own matches, repeated items count once; items
that score alike all count.  Empty tables give an empty result.  Further columns are
neither read nor returned (drop_leaks returns them as they are).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, keep_rows, map_text, pick, text_batches, to_pandas

K1, B, BLOCK, STRIDE, NGRAM = 1.2, 0.75, 32, 64, 3
SHORT = 7  # words under which an item must stand in the text as one run
SLACK = 3  # words by which a part may be moved against the rest of its item
find_words = re.compile(r"\w+").findall


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the answer follows the last question mark, or else is the last sentence, or else the last quarter."""
    text = text.lower()
    head, mark, tail = text.rpartition("?")
    if mark and find_words(tail) and find_words(head):
        return find_words(head), find_words(tail)
    sentences = [w for w in map(find_words, re.split(r"[.!?\n]+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


class ItemIndex:
    """Inverted index of item segments with block maxima.  Weights are shares of a segment's score against itself."""

    def __init__(self, items: list[tuple[int, str]], threshold: float) -> None:
        self.threshold = threshold
        self.whole, self.words, self.question = [], [], []  # by segment: its item's number, its words, how many of them are of the question
        self.ids, self.segments = [i for i, _ in items], [[] for _ in items]  # by item
        for number, (_, text) in enumerate(items):
            q, a = split_item(text or "")
            parts = -(-(len(q) + len(a)) // STRIDE)
            ends = [len(q + a) * i // parts for i in range(parts + 1)] if parts else []  # parts of equal length: no short last one
            for i, end in pairwise(ends):
                self.segments[number].append(len(self.whole))
                self.whole.append(number)
                self.words.append((q + a)[i:end])
                self.question.append(min(max(len(q) - i, 0), end - i))
        n = len(self.words)
        df = Counter(t for w in self.words for t in set(w))
        mean = sum(map(len, self.words)) / max(n, 1)
        self.vocabulary = {t: i for i, t in enumerate(df)}
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        essential: list[list[tuple[int, float]]] = [[] for _ in df]
        self.need = np.zeros(n)
        for s, words in enumerate(self.words):
            tf = Counter(words)
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for t, f in tf.items()}
            own = sum(weight.values())
            weight = {t: w / own for t, w in weight.items()}
            for t, w in weight.items():
                self.postings[self.vocabulary[t]].append((s, w))
            rest = 0.0
            for t in sorted(weight, key=lambda t: (-df[t], len(t), t)):  # frequent and short words first
                if rest + weight[t] < threshold / 2:
                    rest += weight[t]
                else:
                    essential[self.vocabulary[t]].append((s, weight[t]))
            self.need[s] = threshold - rest - 1e-9
        self.most = [max(w for _, w in p) for p in self.postings]
        self.blocks = [[max(w for _, w in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.postings]
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in essential])]).astype(np.int64)
        flat = [x for p in essential for x in p]
        self.segment, self.share = np.array([s for s, _ in flat], np.int64), np.array([w for _, w in flat])

    def possible(self, terms: np.ndarray, text: np.ndarray, word: np.ndarray) -> set[tuple[int, int]]:
        """(text, passage) that may reach the threshold for some segment.  `terms`: -1 where a word is in no item."""
        n_ess = np.where(terms >= 0, self.offset[terms + 1] - self.offset[terms], 0)
        at = np.flatnonzero(n_ess)
        if not len(at):
            return set()
        count = n_ess[at]
        src = np.repeat(at, count)
        p = np.repeat(self.offset[terms[at]], count) + np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
        half = word[src] // STRIDE  # a word lies in the passages that start in its half and in the one before
        passage = np.concatenate([half, half - 1])
        keep = passage >= 0
        src, p, passage = np.tile(src, 2)[keep], np.tile(p, 2)[keep], passage[keep]
        most = int(passage.max()) + 1
        key = (text[src].astype(np.int64) * most + passage) * len(self.need) + self.segment[p]
        _, first = np.unique(key * len(self.postings) + terms[src], return_index=True)  # a term counts once
        key, share = key[first], self.share[p[first]]
        keys, back = np.unique(key, return_inverse=True)
        good = keys[np.bincount(back, share) >= self.need[keys % len(self.need)]] // len(self.need)
        return {(int(k // most), int(k % most)) for k in good}

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every (segment, score) of at least the threshold, for a passage's distinct terms."""
        theta = self.threshold - 1e-9
        lists = [[self.postings[t][0][0], 0, t] for t in terms]  # segment at the cursor, cursor, term
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= theta:
                    pivot = i
                    break
            if pivot < 0:
                return found
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            upper, end = 0.0, None
            for x in lists[: pivot + 1]:  # the blocks in which the target would be
                p, b = self.postings[x[2]], x[1] // BLOCK
                while b + 1 < len(self.blocks[x[2]]) and p[min((b + 1) * BLOCK, len(p)) - 1][0] < target:
                    b += 1
                last = p[min((b + 1) * BLOCK, len(p)) - 1][0]
                if last >= target:
                    upper += self.blocks[x[2]][b]
                    end = last if end is None else min(end, last)
            if upper < theta:  # no segment up to the first of these blocks' ends can pass
                after = (target if end is None else end) + 1
                if pivot + 1 < len(lists):
                    after = min(after, max(lists[pivot + 1][0], target + 1))
                move = lists[: pivot + 1]
            elif lists[0][0] == target:
                score = sum(self.postings[t][c][1] for s, c, t in lists[: pivot + 1] if s == target)
                if score >= theta:
                    found.append((target, score))
                after, move = target + 1, lists[: pivot + 1]
            else:
                after, move = target, [x for x in lists[:pivot] if x[0] < target]
            for x in move:
                p = self.postings[x[2]]
                while x[1] < len(p) and p[x[1]][0] < after:
                    x[1] += 1
                x[0] = p[x[1]][0] if x[1] < len(p) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def covered(self, segment: int, passage: list[str], least: float) -> np.ndarray:
        """Which of the segment's words the passage covers."""
        words, q = self.words[segment], self.question[segment]
        covered = np.zeros(len(words), bool)
        if len(words) < SHORT and len(self.segments[self.whole[segment]]) == 1:
            covered[:] = any(passage[i : i + len(words)] == words for i in range(len(passage) - len(words) + 1))
            return covered
        for a, b in ((0, len(words)), (0, q), (q, len(words))):  # each part has n-grams of its own too
            n = min(NGRAM, b - a)
            if n:
                there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                for i in range(a, b - n + 1):
                    if tuple(words[i : i + n]) in there:
                        covered[i : i + n] = True
        weak = [x for x in (slice(0, q), slice(q, None)) if len(covered[x]) and covered[x].mean() < least]
        if weak:
            placed = np.array(self.in_place(words, passage))
            for x in weak:
                if (~placed[x]).sum() <= 1:
                    covered[x] = True
            if (~placed).sum() > 1 and covered.mean() < least:  # a part of one word says nothing by itself
                covered[:] = False
        return covered

    def shares(self, item: list[int], found: dict[int, np.ndarray]) -> tuple[float, float]:
        """Shares of the item's question and answer words that are covered, 0 for a part that it lacks."""
        both = []
        for part in (0, 1):
            every = sum(self.question[s] if part == 0 else len(self.words[s]) - self.question[s] for s in item)
            hits = sum(int(c[: self.question[s]].sum() if part == 0 else c[self.question[s] :].sum()) for s, c in found.items())
            both.append(hits / every if every else 0.0)
        return both[0], both[1]

    @staticmethod
    def in_place(words: list[str], passage: list[str]) -> list[bool]:
        """Which words stand in the passage where common pairs of words put the segment, give or take SLACK."""
        at: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(pairwise(passage)):
            at.setdefault(pair, []).append(i)
        shifts = {j - i + e for i, pair in enumerate(pairwise(words)) for j in at.get(pair, ()) for e in range(-SLACK, SLACK + 1)}
        return [any(0 <= i + d < len(passage) and passage[i + d] == w for d in shifts) for i, w in enumerate(words)]


def search(texts: list[str], index: ItemIndex, least: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, best score, question overlap, answer overlap) of every confirmed pair."""
    words = [find_words(t.lower()) for t in texts]
    get, lengths = index.vocabulary.get, [len(w) for w in words]
    total = sum(lengths)
    if not total or not index.whole:
        return []
    terms = np.fromiter((get(x, -1) for w in words for x in w), np.int64, total)
    start = np.concatenate([[0], np.cumsum(lengths)])
    text = np.repeat(np.arange(len(texts)), lengths)
    parts: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    best: dict[tuple[int, int], float] = {}
    for i, passage in index.possible(terms, text, np.arange(total) - start[text]):
        a = passage * STRIDE
        own = set(terms[start[i] + a : min(start[i] + a + 2 * STRIDE, start[i + 1])].tolist()) - {-1}
        for segment, score in index.retrieve(own):
            key = (i, index.whole[segment])
            covered, seen = index.covered(segment, words[i][a : a + 2 * STRIDE], least), parts.setdefault(key, {})
            seen[segment] = covered | seen[segment] if segment in seen else covered
            best[key] = max(best.get(key, 0.0), score)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for (i, whole), found in parts.items():
        q, a = index.shares(index.segments[whole], found)
        if q >= least and a >= least:
            key = (i, index.ids[whole])
            out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (best[i, whole], q, a))
    return [(*k, *v) for k, v in sorted(out.items())]


def indexes(items: DataFrame, id_col: str, text_col: str, threshold: float, shard_chars: int) -> Iterator[tuple[object, int]]:
    """A broadcast index of each shard of the items and how many shards there are; a shard has about `shard_chars` characters at most."""
    spark = items.sparkSession
    tests = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    shards = -(-(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars)
    for shard in range(shards):
        rows = to_pandas(tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)).sort_values(["item", "text"])
        yield spark.sparkContext.broadcast(ItemIndex(list(zip(rows["item"].tolist(), rows["text"].tolist(), strict=True)), threshold)), shards


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    overlap: float = 0.7,
    shard_chars: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each row's text and each test item that it contains."""
    docs = pick(df, id_col, text_col)

    def one(index: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches):
                found = search(texts, index.value, overlap)
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.record_batch([batch.column(0).take(at), *(pa.array([x[i] for x in found], kind) for i, kind in zip(range(1, 5), (pa.int64(), *[pa.float64()] * 3), strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return map_text(docs, run, SCHEMA)

    out = None
    for index, shards in indexes(items, item_id_col, item_text_col, threshold, shard_chars):
        found = one(index)
        if shards > 1:
            found = cut(found)
            index.unpersist()
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def drop_leaks(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    overlap: float = 0.7,
    shard_chars: int = 2_000_000,
) -> DataFrame:
    """`df` without the rows whose text contains a test item; its columns and other rows stay as they are."""
    for index, shards in indexes(items, item_id_col, item_text_col, threshold, shard_chars):

        def start(index: object = index) -> object:
            def clean(texts: list[str]) -> list[bool]:
                leaks = {x[0] for x in search(texts, index.value, overlap)}
                return [i not in leaks for i in range(len(texts))]

            return clean

        df = keep_rows(df, text_col, start)
        if shards > 1:
            df = cut(df)
            index.unpersist()
    return df
