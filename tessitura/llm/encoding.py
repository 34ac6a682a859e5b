"""Byte-level BPE encoding of whole text columns with a public vocabulary.

Each word is merged on a contiguous rank array: the part boundaries of the word
and the rank of every adjacent pair lie side by side; the scan for the smallest
rank, the deletion of its boundary and the refresh of the two neighbouring
ranks repeat until no pair has a rank.  Words repeat, so each task keeps the
words it has merged.  Words longer than ``LONG_WORD`` bytes, on which repeated
scans would be quadratic, take the same merges from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter of every function below.
TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value of the vocabulary: its published rule for splitting text into words.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_WORD = 96
#: Words kept per task; beyond it the store starts anew, so memory is bounded.
MAX_WORDS = 400_000
NO_RANK = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge by repeated scans over the rank array."""
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NO_RANK:
            break
        at = adjacent.index(least)
        del bounds[at + 1], adjacent[at]
        if at < len(adjacent):
            adjacent[at] = ranks.get(word[bounds[at] : bounds[at + 2]], NO_RANK)
        if at:
            adjacent[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, smallest rank first and leftmost on ties, from a heap."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray([1]) * size
    while heap:
        _, at, end = heapq.heappop(heap)
        right = after[at] if alive[at] else size
        if right >= size or after[right] != end:
            continue
        alive[right] = 0
        after[at] = end
        if end < size:
            before[end] = at
            if (r := ranks.get(word[at : after[end]])) is not None:
                heapq.heappush(heap, (r, at, after[end]))
        if (left := before[at]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    return [ranks[word[i : after[i]]] for i in range(size) if alive[i]]


class WordStore(dict):
    """Ids by word, merged when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        if one is not None:
            ids = (one,)
        else:
            ids = tuple((merge_short if len(raw) <= LONG_WORD else merge_long)(raw, self.ranks))
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(raw) <= LONG_WORD:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Kept per worker process, so later tasks find its words merged."""
    return WordStore(load_ranks(path)), regex.compile(WORD_PATTERN).findall


def _vocabulary(name: str, tokenizer_dir: str) -> str:
    return f"{tokenizer_dir.rstrip('/')}/{name}.tiktoken"


def _shipped(df: DataFrame, vocabulary: str, tokenizer_dir: str) -> str:
    """Name of the vocabulary's file, which Spark brings to every executor."""
    path = _vocabulary(vocabulary, tokenizer_dir)
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_texts(
    df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """One row per input row: ``id_col`` and ``ids array<int>``, the ids of the
    unchanged text without special tokens.

    A null and an empty text give an empty list; repeated rows stay repeated;
    a null id stays null; an empty table gives no rows.  Other columns are not
    read, whatever their names.
    """
    name = _shipped(df, vocabulary, tokenizer_dir)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _encoder(SparkFiles.get(name))
        get = words.__getitem__
        for batch in batches:
            sizes = np.zeros(batch.num_rows + 1, np.int64)
            flat: list[np.ndarray] = []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    ids = np.fromiter(chain.from_iterable(map(get, split(text))), np.int32)
                    sizes[row + 1] = len(ids)
                    flat.append(ids)
            ends = np.cumsum(sizes)
            if ends[-1] > 2**31 - 1:
                raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch: a batch has over 2^31 tokens")
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """``id_col`` and ``n_tokens int`` of each row; null and empty texts have 0."""
    name = _shipped(df, vocabulary, tokenizer_dir)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _encoder(SparkFiles.get(name))
        get = words.__getitem__
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    n[row] = sum(map(len, map(get, split(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["id", "n_tokens"])

    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens int")
    return out.withColumnRenamed("id", id_col)
