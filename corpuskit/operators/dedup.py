"""Exact and near duplicates. Null texts are dropped; empty texts are one text; copies of any number are one group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.session import cut
from corpuskit.functions.text import nfc, shingles
from corpuskit.operators.counts import count_table
from corpuskit.operators.ranks import first_per_key


def exact_dedup(df: DataFrame, text: str = "text", order: str | list[str] = "seq") -> DataFrame:
    """The first row by ``order`` of each canonically composed text, with the text as it stands."""
    d = df.withColumn("_key", F.sha2(nfc(text), 256))
    return first_per_key(d, "_key", order).drop("_key")


def merge_first(frames: list[DataFrame], key: str = "sentence_id", order: str = "seq") -> DataFrame:
    """Several deliveries as one: of each key the first row, earlier frames before later ones, then by ``order``."""
    parts = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(frames)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return first_per_key(df, key, ["_file", order]).drop("_file")


def queue_once(events: DataFrame, key: str = "sentence_id", at: str = "ts") -> DataFrame:
    """A queue without repeats: each key at its first time."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(at))


#: Size of the table of counts by hash of a gram, whatever the corpus.
BUCKETS = 1 << 20


def grams(text: str, k: int = 3) -> np.ndarray:
    """The distinct groups of ``k`` characters as sorted integers. Up to three characters are packed, so that different
    groups are different integers; longer ones are hashed to 64 bits."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = g * np.uint64(1 << 21 if k <= 3 else 0x9E3779B97F4A7C15) + c[i : i + n]
    return np.unique(g.view(np.int64))


def _mixed(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (g.view(np.uint64) >> np.uint64(29))


def _keys(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = [grams(t, k) for t in b.column("text").to_pylist()]
        key = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None for g in sets]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(key, pa.binary()), b.column("text")], names=["row", "key", "text"])


def _counted(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        v, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_mixed(grams(t, k)) for t in b.column("text").to_pylist())]) & np.uint64(BUCKETS - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(n)], names=["bucket", "n"])


_PREFIX = "g bigint, class bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _prefixes(it: Iterator[pa.RecordBatch], often: np.ndarray, percent: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        cols: list[list] = [[] for _ in range(7)]
        for c, t in zip(b.column("class").to_pylist(), b.column("text").to_pylist()):
            g = grams(t, k)
            n, m = len(g), _mixed(g)
            order = np.lexsort((g, often[m & np.uint64(BUCKETS - 1)]))[: n - -(-n * percent // 100) + 1]
            bits = np.zeros(256, np.uint8)
            bits[m >> np.uint64(56)] = 1
            words = np.packbits(bits).view(np.int64).tolist()
            for x, v in zip(cols, (g[order].tolist(), *([y] * len(order) for y in (c, n, *words)))):
                x += v
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(cols)], names=["g", "class", "n", "s0", "s1", "s2", "s3"])


#: Bands and rows of the banded search: of pairs at 0.85, 0.90 and 0.95 it meets about 46, 81 and 99 %.
BANDS, DEPTH = 8, 16


def _banded(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(g, class): a key for each band of the minima of ``BANDS * DEPTH`` hashes of the grams."""
    rng = np.random.default_rng(42)
    a, c = (rng.integers(1, 1 << 63, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    for b in it:
        keys, own = [], []
        for i, t in zip(b.column("class").to_pylist(), b.column("text").to_pylist()):
            m = _mixed(grams(t, k))
            with np.errstate(over="ignore"):
                least = np.minimum.reduce([(a * x + c) ^ ((a * x + c) >> np.uint64(32)) for x in m])
            for j in range(BANDS):
                keys.append(int.from_bytes(hashlib.blake2b(bytes([j]) + least[j * DEPTH : (j + 1) * DEPTH].tobytes(), digest_size=8).digest(), "big", signed=True))
                own.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64())], names=["g", "class"])


def _alike(it: Iterator[pa.RecordBatch], percent: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for ca, cb, ta, tb in zip(*(b.column(c).to_pylist() for c in ("ca", "cb", "ta", "tb"))):
            x, y = grams(ta, k), grams(tb, k)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * 100 >= percent * (len(x) + len(y) - common):
                rows.append((ca, cb, common, len(x), len(y)))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["ca", "cb", "common", "na", "nb"])


def gram_classes(df: DataFrame, order: str = "seq", text: str = "text", k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(row, key) of the rows with grams, and the classes (class, key, text, first, rows) of rows with the same grams, both
    written once."""
    kind = df.schema[order].dataType.simpleString()
    rows = cut(df.where(F.col(text).isNotNull()).select(F.col(order).alias("row"), nfc(text).alias("text")).mapInArrow(lambda it: _keys(it, k), f"row {kind}, key binary, text string").where("key is not null"))
    c = rows.groupBy("key").agg(F.min_by("text", "row").alias("text"), F.min("row").alias("first"), F.count("*").alias("rows"))
    return rows.select("row", "key"), cut(c.withColumn("class", F.monotonically_increasing_id()))


def class_pairs(classes: DataFrame, percent: int = 85, k: int = 3, banded: bool = False) -> DataFrame:
    """(ca, cb, common, na, nb), ca < cb: the classes whose sets of grams have a Jaccard index of at least ``percent`` %,
    tested as integers.

    Prefix filter: grams are ordered by a table of ``BUCKETS`` counts, seldom first; two sets that are alike enough share
    a gram of their first ``n - ceil(percent n) + 1``. The join on it also compares sizes and 256-bit sets of the grams,
    which tell how many grams one has that the other lacks, so that few other pairs leave it. There are few different
    grams of three letters, so the join's comparisons (not its rows) grow with the square of a corpus; ``banded`` is for
    corpora for which that is too many: candidates then share a band of minimum hashes, which is linear but misses pairs
    near the bound. What it gives is tested as exactly.
    """
    own = classes.select("class", "text")
    if banded:
        p = cut(own.mapInArrow(lambda it: _banded(it, k), "g bigint, class bigint"))
        maybe = p.select("g", F.col("class").alias("ca")).join(p.select("g", F.col("class").alias("cb")), "g").where("ca < cb").select("ca", "cb").distinct()
        return _verified(maybe, own, percent, k)
    often = classes.sparkSession.sparkContext.broadcast(count_table(classes.select("text").mapInArrow(lambda it: _counted(it, k), "bucket int, n bigint"), BUCKETS))
    p = cut(classes.select("class", "text").mapInArrow(lambda it: _prefixes(it, often.value, percent, k), _PREFIX))
    side = lambda x: p.select("g", *(F.col(c).alias(f"{c}{x}") for c in ("class", "n", "s0", "s1", "s2", "s3")))
    lacks = lambda x, y: sum(F.bit_count(F.col(f"s{i}{x}").bitwiseAND(F.bitwise_not(f"s{i}{y}"))) for i in range(4))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-6)
    maybe = side("a").join(side("b"), "g").where((F.col("classa") < F.col("classb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (lacks("a", "b") <= F.col("na") - need) & (lacks("b", "a") <= F.col("nb") - need))
    maybe = maybe.select(F.col("classa").alias("ca"), F.col("classb").alias("cb")).distinct()
    return _verified(maybe, own, percent, k)


def _verified(maybe: DataFrame, own: DataFrame, percent: int, k: int) -> DataFrame:
    both = maybe.join(own.select(F.col("class").alias("ca"), F.col("text").alias("ta")), "ca").join(own.select(F.col("class").alias("cb"), F.col("text").alias("tb")), "cb")
    return both.mapInArrow(lambda it: _alike(it, percent, k), "ca bigint, cb bigint, common int, na int, nb int")


def near_pairs(df: DataFrame, order: str = "seq", text: str = "text", percent: int = 85, k: int = 3) -> DataFrame:
    """(a, b, common, size_a, size_b), a before b: all pairs of rows whose sets of character ``k``-grams are alike enough.
    ``order`` must be unique; texts shorter than ``k`` have no pair. Rows with the same grams are one class in the join
    and are expanded at the end; ``near_classes`` gives them unexpanded."""
    rows, classes = gram_classes(df, order, text, k)
    both = cut(class_pairs(classes, percent, k))
    size = F.size(F.array_distinct(shingles("text", k)))
    same = classes.where("rows > 1").select(F.col("class").alias("ca"), F.col("class").alias("cb"), size.alias("common"), size.alias("na"), size.alias("nb"))
    links = both.unionByName(both.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "common", F.col("nb").alias("na"), F.col("na").alias("nb"))).unionByName(same)
    members = rows.join(classes.select("key", "class"), "key")
    left, right = members.select(F.col("class").alias("ca"), F.col("row").alias("a")), members.select(F.col("class").alias("cb"), F.col("row").alias("b"))
    return links.join(left, "ca").join(right, "cb").where("a < b").select("a", "b", "common", F.col("na").alias("size_a"), F.col("nb").alias("size_b"))


def near_classes(df: DataFrame, order: str = "seq", text: str = "text", percent: int = 85, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(row, class) of every row with grams, and the pairs of alike classes: each row once, no copies expanded."""
    rows, classes = gram_classes(df, order, text, k)
    return rows.join(classes.select("key", "class"), "key").select("row", "class"), class_pairs(classes, percent, k)


def greedy_keep(df: DataFrame, order: str = "seq", text: str = "text", percent: int = 85, k: int = 3) -> DataFrame:
    """The rows that stay when each row in order is dropped if it is a near duplicate of an earlier row that stayed.

    Copies of a class stand behind its first row and fall with it or by it, so the rounds run over first rows only: a row
    whose earlier neighbours are all dropped stays, a row with an earlier neighbour that stayed is dropped, until all are
    decided. The number of rounds is the longest chain of decisions. Null texts are dropped; texts without grams stay.
    """
    _, classes = gram_classes(df, order, text, k)
    first = classes.select("class", F.col("first").alias("row"))
    both = class_pairs(classes, percent, k).join(first.select(F.col("class").alias("ca"), F.col("row").alias("x")), "ca").join(first.select(F.col("class").alias("cb"), F.col("row").alias("y")), "cb")
    pairs = cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    state = cut(pairs.select(F.col("b").alias("row")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    open_ = state.count()
    while open_:
        known = state.select(F.col("row").alias("a"), F.col("kept").alias("by"), F.lit(True).alias("listed"))
        seen = pairs.join(known, "a", "left").withColumn("by", F.when(F.col("listed"), F.col("by")).otherwise(F.lit(True)))
        verdict = seen.groupBy(F.col("b").alias("row")).agg(F.bool_or(F.coalesce("by", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("by"), F.lit(False))).alias("clear"))
        state = cut(state.join(verdict, "row").select("row", F.coalesce("kept", F.when(F.col("hit"), F.lit(False)).when(F.col("clear"), F.lit(True))).alias("kept")))
        left = state.where("kept is null").count()
        if left == open_:
            raise RuntimeError("no row could be decided")
        open_ = left
    gone = state.where("not kept").select(F.col("row").alias(order))
    short = df.where(F.col(text).isNotNull() & (F.length(nfc(text)) < k)).select(order)
    stay = first.select(F.col("row").alias(order)).join(gone, order, "left_anti").unionByName(short)
    return df.join(stay, order, "left_semi")
