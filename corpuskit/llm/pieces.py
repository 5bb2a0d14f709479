"""Problem 10: cut oversized texts at natural boundaries, with an overlap.

Method: every token end has a boundary strength (inside a word 1, word 2, clause 3, sentence 4, line 5, paragraph 6;
inside a character none); a sparse-table range-maximum index gives the strongest cut of a permissible window, ties to
the right; the next piece starts ``overlap`` tokens before the cut, or a token or two more where that is no character's start.

Cases: null, empty and short texts are one piece or none (``min_tokens``); texts without boundaries are cut between
characters; a piece that encodes alone to more than the limit is cut shorter; repeated rows are each cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm.bpe import TOKENIZER_DIR, Encoder, encoder, vocabulary

_LEVELS = ((2, r"(?<=\S)(?=\s)"), (3, r"[,;:،](?=\s)"), (4, r"[.!?।॥]+[\"')\]]*(?=\s|$)"), (5, r"\n"), (6, r"\n[^\S\n]*\n\s*"))
_LEVELS = tuple((k, regex.compile(p)) for k, p in _LEVELS)


class RangeMax:
    """Sparse table of the place of the maximum over at most ``span`` values; of equal values the rightmost."""

    def __init__(self, values: np.ndarray, span: int | None = None):
        self.v = values
        self.rows = [np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)]
        step = 1
        while 2 * step <= min(len(values), span or len(values)):
            a, b = self.rows[-1][:-step], self.rows[-1][step:]
            self.rows.append(np.where(values[b] >= values[a], b, a))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """Over lo..hi, both inside."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]
        return int(b if self.v[b] >= self.v[a] else a)


def pieces(text: str, enc: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, places in code points."""
    ids = enc.ids(text)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n)] if n else []
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    ends = np.concatenate([[0], np.cumsum(enc.lengths[ids])])
    chars = np.concatenate([[0], np.cumsum(starts[:-1])])[ends]
    safe = starts[ends]
    by_char = np.ones(len(text) + 1, np.int8)
    for k, p in _LEVELS:
        for m in p.finditer(text):
            by_char[m.end()] = max(by_char[m.end()], k)
    strength = np.where(safe, by_char[chars], 0)
    index = RangeMax(strength, limit + 1)
    out, s = [], 0
    while True:
        top = min(n, s + limit)
        while True:
            if top == n:
                e = n
            else:
                e = index.best(min(max(s + overlap + 1, s + limit // 2), top), top)
                if not safe[e]:
                    e = s + int(np.flatnonzero(safe[s + 1 : top + 1])[-1]) + 1
            size = enc.count(text[chars[s] : chars[e]])
            if size <= limit:
                break
            top = e - 1
        out.append((int(chars[s]), int(chars[e]), size))
        if e == n:
            return out
        back = max(e - overlap, s + 1)
        while back > s + 1 and not safe[back]:
            back -= 1
        s = back if safe[back] else e


#: Characters of cut texts after which a batch is handed on.
FLUSH = 8_000_000
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], names=["doc_id", "piece_no", "pieces", "start_at", "end_at", "n_tokens", "text"])


def _cut(it: Iterator[pa.RecordBatch], vocab: bytes, limit: int, overlap: int, least: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocab)
    for batch in it:
        rows: list[tuple] = []
        size = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if size > FLUSH:
                yield _batch(rows)
                rows, size = [], 0
            if not text or (least > limit and len(text) * 4 <= limit):
                continue
            got = pieces(text, enc, limit, overlap)
            if len(got) > 1 or (got and least <= limit):
                rows += [(key, k, len(got), a, b, n, text[a:b]) for k, (a, b, n) in enumerate(got)]
                size += len(text)
        yield _batch(rows)


def split(docs: DataFrame, limit: int, overlap: int, tokenizer: str, only_cut: bool = True, folder: str = TOKENIZER_DIR) -> DataFrame:
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))
    least = limit + 1 if only_cut else 0
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, vocab.value, limit, overlap, least), "doc_id bigint, piece_no int, pieces int, start_at int, end_at int, n_tokens int, text string")


def p10_pieces(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/piece_limits.parquet").first()
    return split(s.read.parquet(f"{d}/documents.parquet"), p.max_tokens, p.overlap_tokens, p.tokenizer)


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return p10_pieces(s, d).select("doc_id").distinct()
