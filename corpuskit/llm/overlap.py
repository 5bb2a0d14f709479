"""Problem 1: the same or nearly the same record in train and in an evaluation split.

Method: winnowing fingerprints. Rolling hashes of three words are winnowed in train (the least of each two neighbours is
selected) and met with all rolling hashes of the evaluation wordings; seeds are fingerprints with their places. In one
order for all records (seldom in evaluation first, by a table of ``BUCKETS`` counts) a train wording shows only so many of
its selected fingerprints that a partner which shares ``SHARED`` of them must meet one (prefix filter). The join on a
seed also tests, before any text moves, what coverage implies: like lengths, like places, and words in common (128-bit
word sets). A fingerprint that very many share, as an opening in a third of all records, is no key by itself: it is split
by the wordings' seldom words, so many of each that two with enough words in common meet at one. Wordings of up to
``SHORT`` words show pairs of words in the same way too. Of the candidates, shared seeds are chained collinearly, extended
by equal words and the gaps between them aligned; coverage is the share of the longer wording that is so explained, moved
words included. Wordings of up to ``BRIEF`` words, of which one edit may leave no seed, also meet by all their forms with
one word left out, which is exact for one word added, dropped, moved, misspelt or replaced. Exact copies meet as one
wording.

Cases: null texts and texts without words match nothing; wordings under four words match only as exact copies or where a
longer one is theirs with one word more; repeated rows count once; an empty table gives no pairs; a record in several
splits is on each side it is in; platform and split may be null (p1_rates shows them so).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.session import cut
from corpuskit.llm.canon import skeleton
from corpuskit.operators.counts import count_table

GRAM, SHARED, COVERED = 3, 0.25, 0.75
#: Of a covered wording, so many of its words may be misspelt: the rest of the covered ones are equal.
MISSPELT = 0.1
#: A fingerprint in more evaluation wordings than this (about) is split by words; any bound gives the same pairs.
HOT = 1024
BRIEF, SHORT = 9, 16
#: Size of the table of counts by hash of a fingerprint (two bytes each), whatever the corpus.
BUCKETS = 1 << 21
_B = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


_hash = WordHash()


def rolling(words: list[str], gram: int = GRAM) -> np.ndarray:
    """The rolling hash of each ``gram`` words; none for shorter wordings."""
    if len(words) < gram:
        return np.zeros(0, np.int64)
    h = np.fromiter((_hash[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        r = h[: len(h) - gram + 1] + np.uint64(gram)
        for k in range(1, gram):
            r = r * _B + h[k : len(h) - gram + 1 + k]
        return (r * _MIX).view(np.int64)


def families(words: list[str]) -> list[np.ndarray]:
    return [rolling(words), rolling(words, 2)] if len(words) <= SHORT else [rolling(words)]


def word_keys(words: list[str]) -> np.ndarray:
    """The distinct words as hashes."""
    h = np.unique(np.fromiter((_hash[w] for w in words), np.uint64, len(words)))
    with np.errstate(over="ignore"):
        return (h * _MIX).view(np.int64)


def splitting_words(words: list[str], often: np.ndarray, train: bool) -> np.ndarray:
    """The seldom words of which two wordings with enough equal words share one: in one order for all wordings, as many as
    may be lacking and one. In train, those that stand in no evaluation wording need no place."""
    v = word_keys(words)
    seen = often[v & (BUCKETS - 1)]
    lacking = len(words) - int(np.ceil((COVERED - MISSPELT) * len(words) - 1e-9))
    order = np.lexsort((v, seen))[: lacking + 1]
    return v[order[seen[order] > 0]] if train else v[order]


def first_places(roll: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``roll[at]``, each with its first place."""
    v, i = np.unique(roll[at], return_index=True)
    return v, at[i]


def selected(roll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the least rolling hash of each window, with its place."""
    n = len(roll)
    if n <= 1:
        return roll, np.arange(n)
    left = np.arange(n - 1)
    return first_places(roll, np.unique(np.where(roll[1:] < roll[:-1], left + 1, left)))


def seeds(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of fingerprints of the first wording that the second has too; of repeated ones the first place."""
    va, pa_ = selected(rolling(a))
    rb = rolling(b)
    vb, pb = first_places(rb, np.arange(len(rb)))
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return sorted(zip(pa_[i].tolist(), pb[j].tolist()))


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain: both places rise."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(ends, y)
        back[k] = at[i - 1] if i else -1
        if i == len(ends):
            ends.append(y)
            at.append(k)
        else:
            ends[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _alike(w: str, x: str) -> bool:
    return len(w) > 3 and abs(len(w) - len(x)) < 3 and SequenceMatcher(None, w, x).ratio() >= 0.75


def coverage(a: list[str], b: list[str]) -> float:
    """Share of the longer wording that is explained by the other: the chain of seeds, extended while words are equal,
    the gaps between aligned (equal, then misspelt words), and words that stand elsewhere."""
    hit, rest_a, rest_b = 0, [], []

    def gap(i: int, j: int, k: int, m: int) -> int:
        n = 0
        for op, x, y, u, v in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_opcodes() if i < j and k < m else [("", 0, j - i, 0, m - k)]:
            if op == "equal":
                n += y - x
                continue
            over = b[k + u : k + v]
            for w in a[i + x : i + y]:
                near = next((t for t in over if _alike(w, t)), None) if len(over) <= 64 else None
                if near is None:
                    rest_a.append(w)
                else:
                    over.remove(near)
                    n += 1
            rest_b.extend(over)
        return n

    x = y = 0
    for p, q in chain(seeds(a, b)):
        if p < x or q < y:
            continue
        i, k = p, q
        while i > x and k > y and a[i - 1] == b[k - 1]:
            i, k = i - 1, k - 1
        hit += gap(x, i, y, k)
        j, m = p + GRAM, q + GRAM
        while j < len(a) and m < len(b) and a[j] == b[m]:
            j, m = j + 1, m + 1
        hit += j - i
        x, y = j, m
    hit += gap(x, len(a), y, len(b))
    hit += (Counter(rest_a) & Counter(rest_b)).total()
    return hit / max(len(a), len(b), 1)


def _wordings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in it:
        text = [" ".join(skeleton(t)) for t in b.column("text").to_pylist()]
        key = [xxhash.xxh3_128_digest(t) if t else None for t in text]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("side"), pa.array(key, pa.binary()), pa.array(text, pa.string())], names=["id", "side", "key", "wording"])


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rolls = [np.unique(r) for t in b.column("wording").to_pylist() for r in (*families(t.split()), word_keys(t.split()))]
        v, n = np.unique(np.concatenate([np.zeros(0, np.int64), *rolls]) & (BUCKETS - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(n)], names=["bucket", "n"])


def _wordset(words: list[str]) -> tuple[int, int]:
    bits = 0
    for w in words:
        bits |= 1 << (_hash[w] >> 57)
    lo, hi = bits & (1 << 64) - 1, bits >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


_PRINTS = "fp bigint, w bigint, length int, at int, need int, lo bigint, hi bigint"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def _prints(it: Iterator[pa.RecordBatch], often: np.ndarray, train: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Train: the prefix of the selected fingerprints, ``need`` the number to be shared. Evaluation: all, ``need`` the
    number that follow it in the order, and it."""
    for b in it:
        cols: list[list] = [[] for _ in range(7)]
        for w, text in zip(b.column("w").to_pylist(), b.column("wording").to_pylist()):
            words = text.split()
            lo, hi = _wordset(words)
            for roll in families(words):
                v, at = selected(roll) if train else first_places(roll, np.arange(len(roll)))
                n = len(v)
                seen = often[v & (BUCKETS - 1)]
                order = np.lexsort((v, seen))
                need = n - np.arange(n)
                if train:
                    share = max(1, int(np.ceil(SHARED * n - 1e-9)))
                    order = order[: n - share + 1]
                    order = order[seen[order] > 0]
                    need = np.full(len(order), share)
                key = v[order]
                hot = seen[order] > most
                if hot.any():
                    by = splitting_words(words, often, train)
                    with np.errstate(over="ignore"):
                        split = ((key[hot, None].view(np.uint64) + by[None, :].view(np.uint64)) * _MIX).view(np.int64)
                    times = np.where(hot, len(by), 1)
                    order, need = np.repeat(order, times), np.repeat(need, times)
                    key = np.repeat(key, times)
                    key[np.repeat(hot, times)] = split.ravel()
                for c, x in zip(cols, (key.tolist(), [w] * len(order), [len(words)] * len(order), at[order].tolist(), need.tolist(), [lo] * len(order), [hi] * len(order))):
                    c += x
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=["fp", "w", "length", "at", "need", "lo", "hi"])


def _left_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in it:
        sig, owner = [], []
        for w, text in zip(b.column("w").to_pylist(), b.column("wording").to_pylist()):
            words = text.split()
            forms = {text, *(" ".join(words[:i] + words[i + 1 :]) for i in range(len(words) if len(words) > 3 else 0))}
            sig += [xxhash.xxh3_128_digest(f) for f in forms]
            owner += [w] * len(forms)
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(owner, pa.int64())], names=["sig", "w"])


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        share = np.zeros(b.num_rows)
        for k, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
            p, q = x.split(), y.split()
            longer = max(len(p), len(q))
            if min(len(p), len(q)) >= COVERED * longer and sum((Counter(p) & Counter(q)).values()) >= (COVERED - MISSPELT) * longer:
                share[k] = coverage(p, q)
        part = pa.table({"w_train": b.column("w_train"), "w_eval": b.column("w_eval"), "coverage": share})
        yield from part.filter(pa.array(share >= COVERED)).to_batches()


def often_in(words: DataFrame) -> np.ndarray:
    """Fingerprints of the wordings by hash bucket, at most 65 535: ``BUCKETS`` numbers, however many wordings."""
    return count_table(words.select("wording").mapInArrow(_buckets, "bucket int, n bigint"), BUCKETS)


def candidates(words: DataFrame) -> DataFrame:
    """(w_train, w_eval) of wordings (w, wording, sides: 1 train, 2 evaluation, 3 both) that may be the same post."""
    train, evaluation = words.where("sides in (1, 3)").select("w", "wording"), words.where("sides in (2, 3)").select("w", "wording")
    often, most = words.sparkSession.sparkContext.broadcast(often_in(evaluation)), HOT
    a = train.mapInArrow(lambda it: _prints(it, often.value, True, most), _PRINTS).select("fp", F.col("w").alias("w_train"), *(F.col(c).alias(f"{c}_a") for c in ("length", "at", "need", "lo", "hi")))
    b = evaluation.mapInArrow(lambda it: _prints(it, often.value, False, most), _PRINTS).select("fp", F.col("w").alias("w_eval"), *(F.col(c).alias(f"{c}_b") for c in ("length", "at", "need", "lo", "hi")))
    longer = F.greatest("length_a", "length_b")
    alien = F.bit_count(F.col("lo_a").bitwiseAND(F.bitwise_not("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseAND(F.bitwise_not("hi_b")))
    back = F.bit_count(F.col("lo_b").bitwiseAND(F.bitwise_not("lo_a"))) + F.bit_count(F.col("hi_b").bitwiseAND(F.bitwise_not("hi_a")))
    equal = F.ceil(longer * (COVERED - MISSPELT) - 1e-9)
    near = a.join(b, "fp").where((F.col("w_train") != F.col("w_eval")) & (F.col("need_b") >= F.col("need_a")) & (F.least("length_a", "length_b") >= COVERED * longer) & (F.abs(F.col("at_a") - F.col("at_b")) <= (1 - COVERED) * longer))
    near = near.where((alien <= F.col("length_a") - equal) & (back <= F.col("length_b") - equal)).select("w_train", "w_eval")
    brief = [x.where(F.size(F.split("wording", " ")) <= BRIEF + 1).mapInArrow(_left_out, "sig binary, w bigint").withColumnRenamed("w", n) for x, n in ((train, "w_train"), (evaluation, "w_eval"))]
    brief = brief[0].join(brief[1], "sig").where("w_train <> w_eval").select("w_train", "w_eval")
    return near.unionByName(brief).distinct()


def wordings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, side, key) of the records, and the distinct wordings (w, key, wording, sides), both written once."""
    r = rows.where("text is not null and split in ('train', 'validation', 'test')")
    r = r.select(F.col("sentence_id").alias("id"), F.when(F.col("split") == "train", 1).otherwise(2).alias("side"), "text")
    m = cut(r.mapInArrow(_wordings, "id string, side int, key binary, wording string").where("key is not null"))
    words = m.groupBy("key").agg(F.first("wording").alias("wording"), F.bit_or("side").alias("sides"))
    return m.select("id", "side", "key").distinct(), cut(words.withColumn("w", F.monotonically_increasing_id()))


def linked_wordings(words: DataFrame) -> DataFrame:
    """(w_train, w_eval, coverage): wordings of the same post; a wording that stands on both sides is linked to itself."""
    text = words.select("w", "wording")
    near = candidates(words).join(text.select(F.col("w").alias("w_train"), F.col("wording").alias("x")), "w_train")
    near = near.join(text.select(F.col("w").alias("w_eval"), F.col("wording").alias("y")), "w_eval")
    near = near.select("w_train", "w_eval", "x", "y").mapInArrow(_verify, "w_train bigint, w_eval bigint, coverage double")
    return near.unionByName(words.where("sides = 3").select(F.col("w").alias("w_train"), F.col("w").alias("w_eval"), F.lit(1.0).alias("coverage")))


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """(id_train, id_eval, coverage) of the same post; ``rows`` has sentence_id, text, split."""
    members, words = wordings(rows)
    links = linked_wordings(words)
    key = words.select("w", "key")
    links = links.join(key.select(F.col("w").alias("w_train"), F.col("key").alias("key_train")), "w_train").join(key.select(F.col("w").alias("w_eval"), F.col("key").alias("key_eval")), "w_eval")
    left = members.where("side = 1").select(F.col("key").alias("key_train"), F.col("id").alias("id_train"))
    right = members.where("side = 2").select(F.col("key").alias("key_eval"), F.col("id").alias("id_eval"))
    return links.join(left, "key_train").join(right, "key_eval").where("id_train <> id_eval").select("id_train", "id_eval", "coverage")


def record_coverage(rows: DataFrame) -> DataFrame:
    """(sentence_id, side, partners, coverage): of each record with a partner across the splits, how many wordings of the
    other side are the same post, and the best coverage. Copies are not expanded into pairs."""
    members, words = wordings(rows)
    links = cut(linked_wordings(words))
    sides = links.select(F.lit(1).alias("side"), F.col("w_train").alias("w"), F.col("w_eval").alias("other"), "coverage").unionByName(links.select(F.lit(2).alias("side"), F.col("w_eval").alias("w"), F.col("w_train").alias("other"), "coverage"))
    best = sides.groupBy("side", "w").agg(F.count("*").alias("partners"), F.max("coverage").alias("coverage")).join(words.select("w", "key"), "w")
    return members.join(best, ["key", "side"]).groupBy(F.col("id").alias("sentence_id"), "side").agg(F.sum("partners").alias("partners"), F.max("coverage").alias("coverage"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    p = cross_split_pairs(s.read.parquet(f"{d}/annotated_sentences.parquet"))
    return p.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def p1_coverage(s: SparkSession, d: str) -> DataFrame:
    return record_coverage(s.read.parquet(f"{d}/annotated_sentences.parquet"))


def p1_rates(s: SparkSession, d: str) -> DataFrame:
    """Records of each split and platform, those with a partner across the splits, and their mean coverage."""
    a = s.read.parquet(f"{d}/annotated_sentences.parquet")
    r = a.select("sentence_id", F.lower(F.trim("platform")).alias("platform"), "split").distinct().withColumn("side", F.when(F.col("split") == "train", 1).otherwise(2))
    r = r.join(record_coverage(a), ["sentence_id", "side"], "left")
    return r.groupBy("split", "platform").agg(F.count("*").alias("records"), F.count("partners").alias("overlapping"), (F.count("partners") / F.count("*")).alias("rate"), F.round(F.avg("coverage"), 6).alias("coverage"))
