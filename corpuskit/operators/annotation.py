"""Majority votes and the import of an annotation tool's exports.

Votes inside a record are arrays, one element an annotator; they are counted in the row, without a shuffle. Null arrays
are empty, null labels are no votes, and a label counts once an annotator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import CATEGORIES, ENTITIES, SENTIMENTS, SPAN
from corpuskit.functions.text import cut_text, export_platform, nfc, parse_time

LEAST = 2


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def majority_label(labels: str | Column, least: int = LEAST) -> Column:
    """The label most annotators gave, of equal ones the last by name; null if none has ``least``."""
    labels = F.filter(F.col(labels) if isinstance(labels, str) else labels, lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    best = F.array_max(F.filter(counted, lambda c: c["n"] >= least))
    return best["label"]


def majority_set(sets: str | Column, valid: tuple[str, ...], least: int = LEAST) -> Column:
    """The valid labels that at least ``least`` annotators gave, sorted."""
    sets = F.coalesce(F.col(sets) if isinstance(sets, str) else sets, _empty("array<string>"))
    flat = F.flatten(F.transform(sets, lambda s: F.array_distinct(F.coalesce(s, _empty("string")))))
    kept = F.filter(F.array_distinct(flat), lambda x: x.isin(*valid) & (F.size(F.filter(flat, lambda y: y == x)) >= least))
    return F.array_sort(kept)


def majority_spans(sets: str | Column, least: int = LEAST) -> Column:
    """array<struct<start, end, entity_type>> that at least ``least`` annotators marked, by place and type."""
    sets = F.coalesce(F.col(sets) if isinstance(sets, str) else sets, _empty(f"array<{SPAN}>"))
    plain = F.transform(sets, lambda s: F.array_distinct(F.transform(F.coalesce(s, _empty(SPAN)), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type")))))
    flat = F.flatten(plain)
    return F.array_sort(F.filter(F.array_distinct(flat), lambda x: F.size(F.filter(flat, lambda y: y == x)) >= least))


def spans_with_text(text: str | Column, spans: Column) -> Column:
    return F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type"), cut_text(text, p["start"], p["end"]).alias("text")))


def long_majority(votes: DataFrame, unit: list[str], least: int = LEAST, annotator: str = "annotator") -> DataFrame:
    """(unit.., n): units that at least ``least`` annotators chose, of a long table of votes. Repeated rows count once."""
    n = votes.dropna(subset=unit).groupBy(*unit).agg(F.count_distinct(annotator).alias("n"))
    return n.where(F.col("n") >= least)


def _choices(annotation: Column) -> Column:
    """The choices of the first result of type choices; null if there is none."""
    return F.try_element_at(F.filter(annotation["result"], lambda r: r["type"] == "choices"), F.lit(1))["value"]["choices"]


def sentiment_of(annotation: Column) -> Column:
    """The first choice of the first choices result that has any; null if it is no sentiment."""
    some = F.filter(annotation["result"], lambda r: (r["type"] == "choices") & (F.coalesce(F.size(r["value"]["choices"]), F.lit(0)) > 0))
    c = F.try_element_at(F.try_element_at(some, F.lit(1))["value"]["choices"], F.lit(1))
    return F.when(c.isin(*SENTIMENTS), c)


def categories_of(annotation: Column) -> Column:
    """The valid categories of the first choices result; others ("none") are left out."""
    return F.filter(F.coalesce(_choices(annotation), _empty("string")), lambda c: c.isin(*CATEGORIES))


def spans_of(annotation: Column, text: Column) -> Column:
    """Spans of results of type labels with a valid first label and start before end, with the text at their place."""
    good = F.filter(annotation["result"], lambda r: (r["type"] == "labels") & F.try_element_at(r["value"]["labels"], F.lit(1)).isin(*ENTITIES) & (r["value"]["start"] < r["value"]["end"]))
    spans = F.transform(F.coalesce(good, F.array()), lambda r: F.struct(r["value"]["start"].alias("start"), r["value"]["end"].alias("end"), r["value"]["labels"][0].alias("entity_type")))
    return spans_with_text(text, spans)


def _converted(tasks: DataFrame, split: str, annotated_at: str | None) -> DataFrame:
    """The columns all exports share; the labels are empty."""
    d, kinds = F.col("data"), {"ner_spans": SPAN, "ner_annotator_spans": f"array<{SPAN}>", "toxicity_labels": "string", "toxicity_annotator_labels": "array<string>", "sentiment_annotator_labels": "string", "token_language_labels": "struct<token:string,label:string,confidence:double>"}
    t = tasks.select(
        F.coalesce(d["sentence_id"], F.col("id").cast("string")).alias("sentence_id"), nfc(F.coalesce(d["text"], F.lit(""))).alias("text"), export_platform(d["platform"]).alias("platform"), F.lit(split).alias("split"),
        F.lit("neutral").alias("sentiment"), F.coalesce(d["source_url"], F.lit("")).alias("source_url"), parse_time(d["collected_at"]).alias("collected_at"), (F.to_timestamp(F.lit(annotated_at)) if annotated_at else F.current_timestamp()).alias("annotated_at"),
        F.coalesce("annotations", F.array()).alias("_a"),
    )
    return t.withColumns({c: _empty(k) for c, k in kinds.items()})


def sentiment_export(tasks: DataFrame, split: str = "train", annotated_at: str | None = None) -> DataFrame:
    """Records with the sentiment of most annotators, neutral where no two agree; tasks without annotations are kept."""
    t = _converted(tasks, split, annotated_at)
    t = t.withColumn("sentiment_annotator_labels", F.filter(F.transform("_a", sentiment_of), lambda x: x.isNotNull()))
    return t.withColumn("sentiment", F.coalesce(majority_label("sentiment_annotator_labels"), F.lit("neutral"))).drop("_a")


def ner_export(tasks: DataFrame, split: str = "train", annotated_at: str | None = None) -> DataFrame:
    """Records with the spans at least two annotators marked; each annotator gives a list, which may be empty."""
    t = _converted(tasks, split, annotated_at)
    t = t.withColumn("ner_annotator_spans", F.transform("_a", lambda a: spans_of(a, F.col("text"))))
    return t.withColumn("ner_spans", spans_with_text("text", majority_spans("ner_annotator_spans"))).drop("_a")


def toxicity_export(tasks: DataFrame, split: str = "train", annotated_at: str | None = None) -> DataFrame:
    """Records with the categories at least two annotators gave, sorted."""
    t = _converted(tasks, split, annotated_at)
    t = t.withColumn("toxicity_annotator_labels", F.transform("_a", categories_of))
    return t.withColumn("toxicity_labels", majority_set("toxicity_annotator_labels", CATEGORIES)).drop("_a")


def adjudicated(df: DataFrame, expert: DataFrame) -> DataFrame:
    """An expert's decisions (sentence_id, sentiment, toxicity_labels, ner_spans) in place of the labels of ``df``; null
    decisions change nothing. An expert's repeated rows count once, the first by value."""
    e = expert.groupBy("sentence_id").agg(F.min(F.struct("sentiment", "toxicity_labels", "ner_spans")).alias("_e"))
    j = df.join(e, "sentence_id", "left")
    return j.withColumns({c: F.coalesce(F.col(f"_e.{c}"), F.col(c)) for c in ("sentiment", "toxicity_labels", "ner_spans")}).drop("_e")
