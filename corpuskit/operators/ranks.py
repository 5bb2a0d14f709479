"""Ranks and draws inside groups that may hold a third of all rows.

A window over such a group would be one task. Here rows fall by the leading digits of their hash into bins; the bins'
counts give the rank of each bin's first row, and a window ranks only inside a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(key: str | Column, seed: int = 42) -> Column:
    """The order of a draw: md5 of seed and key, as text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def ranked(df: DataFrame, group: str | list[str], order: Column, tie: str, rank: str = "rank", total: str = "group_rows", digits: int = 3) -> DataFrame:
    """``df`` with the rank from 1 of each row in its group by ``order`` (a hash in hex digits), then ``tie``, and the
    rows of the group. Groups that are null are one group."""
    group = [group] if isinstance(group, str) else group
    d = df.withColumn("_order", order).withColumn("_bin", F.substring("_order", 1, digits))
    per = d.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_bin")
    per = per.select(*group, "_bin", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(total))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    cond = F.col("a._bin") == F.col("b._bin")
    for c in same:
        cond = cond & c
    d = d.drop(total).alias("a").join(per.alias("b"), cond).select("a.*", "b._before", f"b.{total}")
    r = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_bin").orderBy("_order", tie))
    return d.withColumn(rank, r).drop("_order", "_bin", "_before")


def first_per_key(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key are dropped. One partial maximum a key and task goes
    through the shuffle, however often the key stands."""
    key = [key] if isinstance(key, str) else key
    order = [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in key]
    here = df.where(" and ".join(f"`{k}` is not null" for k in key))
    by = F.struct(*(F.col(o).isNull().alias(f"n{i}") if j == 0 else F.col(o).alias(f"o{i}") for i, o in enumerate(order) for j in (0, 1)))
    best = here.groupBy(*key).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return best.select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns))
