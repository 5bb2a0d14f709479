"""Problem 8: encode the corpus with a public byte-level BPE tokenizer.

Method: contiguous rank array. A word's part boundaries and the ranks of adjacent pairs stand in two small arrays; the
minimum rank is searched by a scan, its boundary deleted and the neighbouring ranks refreshed. A word of more than
``SHORT`` bytes is merged through a heap over a linked list instead, with the same result, since scans would be
quadratic. Words repeat, so each worker keeps the ids of words it has met as packed bytes.

Cases: null and empty texts give the empty list; strings that look like special tokens are ordinary text; lone
surrogates cannot occur in Spark strings; repeated rows are each encoded; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published word pattern of this family of tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96
#: Words whose ids a worker keeps; beyond it the memory starts anew (results are the same).
MEMORY = 300_000


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    """The rank file. About 1 MB whatever the data, so it travels with the tasks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: scan for the least rank, delete its boundary, refresh both neighbours."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    none = 1 << 60
    cuts = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        del cuts[i + 1]
        del near[i]
        if i < len(near):
            near[i] = ranks.get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            near[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: candidate merges in a heap by (rank, place), parts in a linked list."""
    n = len(word)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[i] - i != left or end[j] - j != right:
            continue
        end[i], alive[j], after[i] = end[j], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(word[a : end[b]])) is not None:
                heappush(heap, (r, a, end[a] - a, end[b] - b))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Words of the pattern to their ids, packed as 32-bit integers."""

    def __init__(self, vocab: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines()) if a}
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for piece, r in self.ranks.items():
            self.lengths[r] = len(piece)
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        packed = np.array(ids, np.int32).tobytes()
        if len(raw) <= SHORT:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text))) if text else b""

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4


@lru_cache(maxsize=2)
def encoder(vocab: bytes) -> Encoder:
    return Encoder(vocab)


def _encode(it: Iterator[pa.RecordBatch], vocab: bytes, key: str, column: str, step: int = 512) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocab)
    for batch in it:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            packed = [enc.packed(t) for t in part.column(column).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, "ids"])


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): one row per row of ``df``; no shuffle, no sampling, no truncation."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(lambda it: _encode(it, vocab.value, key, column), f"{key} {kind}, ids array<int>")


def _count(it: Iterator[pa.RecordBatch], vocab: bytes, column: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocab)
    for batch in it:
        n = pa.array([enc.count(t) for t in batch.column(column).to_pylist()], pa.int64())
        rest = [c for c in batch.schema.names if c != column]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), n], names=[*rest, "n_tokens"])


def count_tokens(df: DataFrame, column: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` without ``column``, with ``n_tokens``; a column of that name is replaced."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))
    df = df.drop("n_tokens")
    rest = df.drop(column).schema
    return df.mapInArrow(lambda it: _count(it, vocab.value, column), rest.add("n_tokens", T.LongType()))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source."""
    docs = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text"))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
