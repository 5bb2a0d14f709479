"""Cohen's kappa of annotators, by batch and task.

Votes are long tables (batch_id, item_id, annotator, ...). Of an item the few annotators' answers are paired in the row;
only counts by (batch, pair, answer, answer) go through a shuffle, so an annotator who judged a third of all items is no
hot key. Repeated rows count once, null labels are no votes, spelling is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import CATEGORIES, SENTIMENTS

# A batch is flagged below these.
THRESHOLDS = {"sentiment": 0.72, "ner": 0.78, "toxicity": 0.65}


def paired(votes: DataFrame, unit: list[str], answer: str = "answer") -> DataFrame:
    """(unit.., a, b, answer_a, answer_b) of all two annotators (a < b) of each unit. A unit is one item's question, so
    its votes are as few as its annotators."""
    v = votes.groupBy(*unit).agg(F.array_sort(F.collect_set(F.struct("annotator", answer))).alias("_v"))
    v = v.withColumn("_a", F.explode("_v")).withColumn("_b", F.explode(F.filter("_v", lambda x: x["annotator"] > F.col("_a.annotator"))))
    return v.select(*unit, F.col("_a.annotator").alias("a"), F.col("_b.annotator").alias("b"), F.col(f"_a.{answer}").alias("answer_a"), F.col(f"_b.{answer}").alias("answer_b"))


def kappas(pairs: DataFrame, by: list[str], answers: tuple, all_equal: float | None) -> DataFrame:
    """(by.., a, b, units, same, kappa). Where the two agree throughout kappa is ``all_equal`` if given; it is null where
    it is undefined (both gave one answer only)."""
    counts = [F.count_if(F.col(c) == v).alias(f"{c}_{i}") for c in ("answer_a", "answer_b") for i, v in enumerate(answers)]
    g = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("units"), F.count_if(F.col("answer_a") == F.col("answer_b")).alias("same"), *counts)
    return with_kappa(g, sum(F.col(f"answer_a_{i}").cast("double") * F.col(f"answer_b_{i}") for i in range(len(answers))), all_equal).select(*by, "a", "b", "units", "same", "kappa")


def with_kappa(g: DataFrame, products: Column, all_equal: float | None) -> DataFrame:
    po, pe = F.col("same") / F.col("units"), products / (F.col("units").cast("double") * F.col("units"))
    k = F.try_divide(po - pe, 1 - pe)
    return g.withColumn("kappa", k if all_equal is None else F.when(F.col("same") == F.col("units"), F.lit(float(all_equal))).otherwise(k))


def sentiment_kappa(votes: DataFrame, by: list[str] = ["batch_id"]) -> DataFrame:
    v = votes.withColumn("answer", F.lower(F.trim("label"))).where(F.col("answer").isin(*SENTIMENTS))
    return kappas(paired(v, [*by, "item_id"]), by, SENTIMENTS, None)


def toxicity_kappa(votes: DataFrame, by: list[str] = ["batch_id"], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """A row for each pair and category; equal answers throughout are agreement 1."""
    v = votes.where("labels is not null").groupBy(*by, "item_id", "annotator").agg(F.flatten(F.collect_set("labels")).alias("_l"))
    v = v.withColumn("category", F.explode(F.array(*map(F.lit, categories)))).withColumn("answer", F.array_contains("_l", F.col("category")))
    return kappas(paired(v, [*by, "category", "item_id"]), [*by, "category"], (True, False), 1.0)


def span_kappa(spans: DataFrame, judged: DataFrame, by: list[str] = ["batch_id"], flat: bool = True) -> DataFrame:
    """Spans marked or not, over all spans of the batch. ``judged`` (by.., item_id, annotator) tells who took part.

    ``flat``: as the batch's spans are pooled by (start, end, type), whatever their item; else a span of one item is
    another than that of the next, and two annotators are compared on the spans of items both judged."""
    span = ["start", "end", "entity_type"]
    people = judged.select(*by, "annotator").distinct()
    s = spans.select(*by, "item_id", "annotator", *span).distinct()
    if not flat:
        marks = s.select(*by, "item_id", *span).distinct().join(judged.select(*by, "item_id", "annotator").distinct(), [*by, "item_id"])
        marks = marks.join(s.withColumn("_y", F.lit(True)), [*by, "item_id", *span, "annotator"], "left").withColumn("answer", F.coalesce("_y", F.lit(False)))
        return kappas(paired(marks, [*by, "item_id", *span]), by, (True, False), 1.0)
    s = s.select(*by, "annotator", *span).distinct()
    universe = s.select(*by, *span).distinct().groupBy(*by).agg(F.count("*").alias("units"))
    own = s.groupBy(*by, "annotator").agg(F.count("*").alias("own"))
    people = people.join(own, [*by, "annotator"], "left").fillna(0, ["own"])
    a, b = people.select(*by, F.col("annotator").alias("a"), F.col("own").alias("own_a")), people.select(*by, F.col("annotator").alias("b"), F.col("own").alias("own_b"))
    both = s.groupBy(*by, *span).agg(F.array_sort(F.collect_set("annotator")).alias("_v")).withColumn("a", F.explode("_v")).withColumn("b", F.explode(F.filter("_v", lambda x: x > F.col("a"))))
    both = both.groupBy(*by, "a", "b").agg(F.count("*").alias("both"))
    g = a.join(b, by).where("a < b").join(universe, by, "left").join(both, [*by, "a", "b"], "left").fillna(0, ["units", "both"])
    g = g.withColumn("same", F.col("units") - F.col("own_a") - F.col("own_b") + 2 * F.col("both"))
    g = g.withColumn("products", F.col("own_a").cast("double") * F.col("own_b") + (F.col("units") - F.col("own_a")).cast("double") * (F.col("units") - F.col("own_b")))
    k = F.when(F.col("same") == F.col("units"), 1.0).otherwise(F.try_divide(F.col("same") / F.nullif("units", F.lit(0)) - F.col("products") / (F.col("units").cast("double") * F.col("units")), 1 - F.col("products") / (F.col("units").cast("double") * F.col("units"))))
    return g.select(*by, "a", "b", "units", "same", F.when(F.col("units") == 0, 1.0).otherwise(k).alias("kappa"))


def batch_kappa(kappa: DataFrame, task: str, by: list[str] = ["batch_id"]) -> DataFrame:
    """(by.., task, kappa, pairs, degenerate): the mean over pairs; null if any pair has none, as a mean with an undefined
    part is undefined, and then ``degenerate``."""
    if task not in THRESHOLDS:
        raise ValueError(f"unknown task {task}")
    g = kappa.groupBy(*by).agg(F.avg("kappa").alias("kappa"), F.count("*").alias("pairs"), (F.count("kappa") < F.count("*")).alias("degenerate"))
    return g.select(*by, F.lit(task).alias("task"), F.when(~F.col("degenerate"), F.col("kappa")).alias("kappa"), "pairs", "degenerate")


def flagged(batches: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """``batches`` with the threshold of their task and whether kappa is below; an undefined kappa is not flagged."""
    t = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    d = batches.withColumn("threshold", F.try_element_at(t, F.col("task")))
    return d.withColumn("flagged", F.coalesce(F.col("kappa") < F.col("threshold"), F.lit(False)))


def check_annotators(lists: list[list]) -> None:
    """At least two annotators with answers to the same number of items."""
    if len(lists) < 2:
        raise ValueError(f"at least 2 annotators are needed, not {len(lists)}")
    if len({len(x) for x in lists}) > 1:
        raise ValueError("the annotators' lists differ in length")
