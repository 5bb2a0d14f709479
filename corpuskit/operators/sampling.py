"""Exact stratified draws. All draws order rows by a hash of seed and key, so they repeat whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.ranks import hashed, ranked


class InsufficientData(ValueError):
    """More rows are wanted than there are."""


def allocation(df: DataFrame, n: int, by: str = "platform") -> DataFrame:
    """(by, rows, quota): shares of ``n`` rounded down, what is left one by one to the largest strata (ties by name).
    A row a stratum."""
    c = df.groupBy(by).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    c = c.withColumn("quota", F.expr(f"cast({n} as bigint) * rows").cast("decimal(38,0)") / total)
    c = c.withColumn("quota", F.floor("quota").cast("long"))
    rest = F.lit(n) - F.sum("quota").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rows"), by))
    return c.select(by, "rows", (F.col("quota") + F.when(place <= rest, 1).otherwise(0)).alias("quota"))


def stratified_sample(df: DataFrame, n: int, key: str = "sentence_id", by: str = "platform", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, each stratum with its share; ``InsufficientData`` if there are fewer rows. ``key`` is unique."""
    if n < 0:
        raise ValueError("the size of a sample is not negative")
    have = df.count()
    if have < n:
        raise InsufficientData(f"{n} rows wanted, {have} there: {n - have} short")
    q = allocation(df, n, by).select(F.col(by).alias("_by"), "quota")
    r = ranked(df, by, hashed(key, seed), key, "_rank", "_rows")
    return r.join(F.broadcast(q), F.col(by).eqNullSafe(F.col("_by"))).where("_rank <= quota").drop("_by", "quota", "_rank", "_rows")


def sample_or_all(df: DataFrame, n: int = 50_000, **how) -> DataFrame:
    """A sample of ``n`` rows where there are as many, else all rows."""
    try:
        return stratified_sample(df, n, **how)
    except InsufficientData:
        return df


def stratified_split(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), key: str = "sentence_id", by: str = "platform", seed: int = 42) -> DataFrame:
    """``df`` with ``split``: in each stratum floor(ratio * rows) rows for validation and for test, the rest for train."""
    if len(ratios) != 3 or abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("the ratios must be three and sum to 1")
    r = ranked(df.drop("split"), by, hashed(key, seed), key, "_rank", "_rows")
    n_val, n_test = (F.floor(F.lit(x) * F.col("_rows") + F.lit(1e-9)) for x in ratios[1:])
    train = F.col("_rows") - n_val - n_test
    return r.withColumn("split", F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + n_val, "validation").otherwise("test")).drop("_rank", "_rows")


def in_several_splits(df: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, splits) of keys that stand in more than one split; empty if the splits are disjoint."""
    n = df.groupBy(key).agg(F.count_distinct("split").alias("splits"))
    return n.where("splits > 1")


def last_tenth(df: DataFrame, order: str = "seq", parts: int = 10) -> DataFrame:
    """``df`` with ``held_out``: the last max(1, rows div ``parts``) rows in order; ``order`` is unique. No sort of all
    rows in one task: the limit comes from an exact percentile of the order column's range counts."""
    n = df.count()
    if not n:
        return df.withColumn("held_out", F.lit(False))
    wanted = max(1, n // parts)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    while lo < hi:  # the greatest value that at least ``wanted`` rows reach, by 1 024 range counts a round
        width = max(1, (hi - lo + 1023) // 1024)
        bins = df.where(F.col(order).between(lo, hi)).groupBy(((F.col(order) - lo) / width).cast("long").alias("b")).agg(F.count("*").alias("n")).collect()
        above = df.where(F.col(order) > hi).count()
        for b in sorted(bins, key=lambda r: -r.b):
            above += b.n
            if above >= wanted:
                lo, hi = lo + b.b * width, min(hi, lo + (b.b + 1) * width - 1)
                break
    return df.withColumn("held_out", F.col(order) >= lo)


def oversample(df: DataFrame, minority: F.Column, key: str = "sentence_id", ratio: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with rows of the minority repeated until they are a ``ratio``-th of the others, as evenly as can be, those
    first by hash once more; ``copy`` numbers the copies. No change without a minority or with enough of it."""
    d = df.withColumn("_minor", F.coalesce(minority, F.lit(False)))
    r = ranked(d, "_minor", hashed(key, seed), key, "_rank", "_rows")
    other = d.agg(F.count_if(~F.col("_minor")).alias("_others"))
    target = F.floor(F.col("_others") / ratio)
    times = F.when(~F.col("_minor") | (target <= F.col("_rows")), F.lit(1)).otherwise(F.floor(target / F.col("_rows")) + F.when(F.col("_rank") <= target % F.col("_rows"), 1).otherwise(0))
    r = r.crossJoin(F.broadcast(other)).withColumn("_times", times.cast("int"))
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_times"))))).drop("_minor", "_rank", "_rows", "_others", "_times")
