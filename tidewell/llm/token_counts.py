"""1. Token counts by heap-and-linked-list byte-pair merging.

A piece's bytes are a doubly linked list of symbols; a heap holds its adjacent
pairs by rank.  The lowest-ranked pair is popped and merged, its two new
neighbours are pushed, and pairs whose symbols have changed since are skipped.
The count is the number of bytes minus the number of merges: no identifiers are
made.  Texts stream through one pass without a shuffle.

Nulls count as empty texts (0 bytes, 0 tokens), repeated rows each get a row, an
empty table gives an empty result, and a text's length is not limited: a piece
of n bytes takes O(n log n).  Of pairs of one rank the leftmost is merged first.
Further columns are neither read nor returned.  A vocabulary whose file asks for another
way to cut texts into pieces than the byte-level one is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_text, pick, text_batches

#: Fixed pattern of the byte-level vocabulary's pieces; white space is the Unicode property, as in the library.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for texts up to U+024F.
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+".replace("L", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f").replace("N", r"0-9\xb2\xb3\xb9\xbc-\xbe").replace("S", r"\t-\r \x85\xa0")


def byte_symbols() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(spare)) for b in range(256)}


class PairMerger(dict):
    """piece -> number of tokens; remembers at most `most` pieces of up to 64 characters, which bounds its memory."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec.get("pre_tokenizer") or {}
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: its texts are not cut in the byte-level way")
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for _, s in sorted(byte_symbols().items())]
        #: Two symbols, the left one shifted, -> rank; by rank: both symbols and what they become.
        self.rank: dict[int, int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.by_rank.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.any_pieces = regex.compile(PIECES).findall
        self.latin_pieces, self.beyond_latin = re.compile(LATIN_PIECES).findall, re.compile("[^\x00-\u024f]").search
        self.most = most

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def merge(self, data: bytes) -> int:
        """Tokens of one piece.  A heap entry is rank << 40 | position: the lowest rank first, then the leftmost."""
        left = len(data)
        if left < 2:
            return left
        first, rank, by_rank = self.first, self.rank.get, self.by_rank
        symbol = [first[b] for b in data]
        heap = [r << 40 | i for i, (a, b) in enumerate(pairwise(symbol)) if (r := rank(a << 32 | b)) is not None]
        if not heap:
            return left
        heapify(heap)
        after, before = [*range(1, left), -1], [*range(-1, left - 1)]
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            a, b, made = by_rank[top >> 40]
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged away since
            symbol[i], symbol[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(made << 32 | symbol[k])) is not None:
                    heappush(heap, r << 40 | i)
            p = before[i]
            if p >= 0 and (r := rank(symbol[p] << 32 | made)) is not None:
                heappush(heap, r << 40 | p)
        return left

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; Latin text takes the same pattern with its classes spelled out, which is faster."""
        return self.any_pieces(text) if self.beyond_latin(text) else self.latin_pieces(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string counts as that one token, as by the library's default."""
        if self.split_special is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.pieces(text)))
        total = len(self.split_special.findall(text))
        return total + sum(sum(map(self.__getitem__, self.pieces(part))) for part in self.split_special.split(text) if part)


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> PairMerger:
    return PairMerger(vocabulary)


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies of this machine."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.  `vocabulary` is resolved on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary_path(vocabulary))
        for batch, texts in text_batches(batches):
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array([m.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = map_text(pick(df, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
