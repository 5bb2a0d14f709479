"""Precision, recall and F1, class weights. One aggregation a metric; a ratio without a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import CATEGORIES, ENTITIES, LANGUAGES, SENTIMENTS


def prf(df: DataFrame, by: list[str] = []) -> DataFrame:
    """``df`` (by.., label, tp, fp, fn) with precision, recall and f1."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return df.select(*by, "label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def _counts(df: DataFrame, by: list[str], tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """tp, fp, fn of each label from (in gold, in prediction) tests: one row a group through the shuffle, then unpivoted."""
    aggs = [F.count_if(F.coalesce(t, F.lit(False))).alias(f"{k}_{i}") for i, (g, p) in enumerate(tests.values()) for k, t in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p))]
    wide = df.groupBy(*by).agg(*aggs)
    each = F.array(*(F.struct(F.lit(l).alias("label"), *(F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn"))) for i, l in enumerate(tests)))
    return wide.select(*by, F.inline(each))


def single_label(df: DataFrame, gold: str, predicted: str, by: list[str] = [], labels: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """A row a label of the fixed set; records without gold are left out, a null prediction is a miss."""
    d = df.where(F.col(gold).isNotNull())
    return prf(_counts(d, by, {l: (F.col(gold) == l, F.coalesce(F.col(predicted) == l, F.lit(False))) for l in labels}), by)


def multi_label(df: DataFrame, gold: str, predicted: str, by: list[str] = [], labels: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """A row a category; null sets are empty."""
    has = lambda c, l: F.coalesce(F.array_contains(c, l), F.lit(False))
    return prf(_counts(df, by, {l: (has(gold, l), has(predicted, l)) for l in labels}), by)


def spans(df: DataFrame, gold: str, predicted: str, by: list[str] = []) -> DataFrame:
    """A row an entity type that gold or prediction has; spans (start, end, entity_type) must be equal to count. Sets are
    compared in the row."""
    kind = "array<struct<start:int,end:int,entity_type:string>>"
    plain = lambda c: F.array_distinct(F.coalesce(F.transform(c, lambda p: F.struct(p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end"), p["entity_type"].alias("entity_type"))), F.array().cast(kind)))
    d = df.withColumn("_g", plain(gold)).withColumn("_p", plain(predicted))
    hit, over, miss = F.array_intersect("_g", "_p"), F.array_except("_p", "_g"), F.array_except("_g", "_p")
    size = lambda c, t: F.size(F.filter(c, lambda p: p["entity_type"] == t))
    sums = [F.coalesce(F.sum(size(c, t)), F.lit(0)).alias(f"{k}_{i}") for i, t in enumerate(ENTITIES) for k, c in (("tp", hit), ("fp", over), ("fn", miss))]
    wide = d.groupBy(*by).agg(*sums)
    each = F.array(*(F.struct(F.lit(t).alias("label"), *(F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn"))) for i, t in enumerate(ENTITIES)))
    return prf(wide.select(*by, F.inline(each)).where("tp + fp + fn > 0"), by)


def token_labels(df: DataFrame, gold: str, predicted: str, by: list[str] = [], labels: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """A row a language, and ``accuracy`` over all tokens in each; arrays of structs with ``label`` are compared place by
    place as far as both reach; tokens without a gold label are left out."""
    n = F.least(F.size(gold), F.size(predicted))
    both = F.when(n > 0, F.arrays_zip(F.slice(F.transform(gold, lambda x: x["label"]), F.lit(1), F.greatest(n, F.lit(0))).alias("g"), F.slice(F.transform(predicted, lambda x: x["label"]), F.lit(1), F.greatest(n, F.lit(0))).alias("p")))
    t = df.select(*by, F.inline(both).alias("g", "p")).where("g is not null")
    acc = t.groupBy(*by).agg(F.count_if(F.col("g") == F.col("p")).alias("_ok"), F.count("*").alias("_n"))
    m = prf(_counts(t, by, {l: (F.col("g") == l, F.coalesce(F.col("p") == l, F.lit(False))) for l in labels}), by)
    acc = acc.select(*by, F.coalesce(F.try_divide("_ok", "_n"), F.lit(0.0)).alias("accuracy"))
    return m.join(F.broadcast(acc), by) if by else m.crossJoin(F.broadcast(acc))


def macro(scores: DataFrame, by: list[str] = []) -> DataFrame:
    """(by.., macro_f1): the mean of the labels' f1; without labels 0."""
    return scores.groupBy(*by).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def sentiment_weights(df: DataFrame, column: str = "sentiment", labels: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """(label, weight) = rows / (distinct labels there, unknown ones too * rows of the label); 1 for absent labels."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    tot = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    fixed = df.sparkSession.createDataFrame([(l,) for l in labels], "label string")
    return fixed.join(n, "label", "left").crossJoin(F.broadcast(tot)).select("label", F.coalesce(F.col("t") / (F.col("k") * F.col("n")), F.lit(1.0)).alias("weight"))


def toxicity_weights(df: DataFrame, column: str = "toxicity_labels", labels: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(label, weight) = records / (2 * records with it); 1 for absent ones."""
    wide = df.agg(F.count("*").alias("t"), *(F.count_if(F.array_contains(column, l)).alias(f"n_{i}") for i, l in enumerate(labels)))
    each = F.array(*(F.struct(F.lit(l).alias("label"), F.coalesce(F.try_divide(F.col("t"), 2 * F.col(f"n_{i}")), F.lit(1.0)).alias("weight")) for i, l in enumerate(labels)))
    return wide.select(F.inline(each))


def should_oversample(scores: DataFrame, below: float = 0.60) -> DataFrame:
    """(oversample): whether any label's f1 is below; false without labels."""
    return scores.agg(F.coalesce(F.bool_or(F.col("f1") < below), F.lit(False)).alias("oversample"))
