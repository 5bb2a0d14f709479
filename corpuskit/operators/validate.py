"""Validators: each gives a row an error, none for a clean table; rows are checked where they are, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import CATEGORIES, ENTITIES, SENTIMENTS, SPAN, SPLITS
from corpuskit.functions.text import PLATFORMS, cut_text

BIO = tuple(f"{b}-{t}" for t in ENTITIES for b in "BI") + ("O",)


def span_errors(df: DataFrame) -> DataFrame:
    """(sentence_id, span_set, span_no, start, end, span_text, text_there, message) of gold and annotators' spans whose
    text is not the text at their place; places may be negative, as in a slice."""
    none = F.array().cast(f"array<{SPAN}>")
    sets = F.array(F.struct(F.lit("ner_spans").alias("span_set"), F.coalesce("ner_spans", none).alias("spans")))
    more = F.transform(F.coalesce("ner_annotator_spans", F.array().cast(f"array<array<{SPAN}>>")), lambda s, i: F.struct(F.concat(F.lit("ner_annotator_spans["), i.cast("string"), F.lit("]")).alias("span_set"), F.coalesce(s, none).alias("spans")))
    e = df.select("sentence_id", "text", F.inline(F.concat(sets, more))).select("sentence_id", "text", "span_set", F.posexplode("spans").alias("span_no", "p"))
    there = cut_text("text", F.col("p.start"), F.col("p.end"))
    e = e.withColumn("text_there", there).where(~F.col("text_there").eqNullSafe(F.col("p.text")))
    message = F.format_string("%s: %s[%d] has '%s', the text at %d to %d is '%s'", "sentence_id", "span_set", "span_no", "p.text", "p.start", "p.end", "text_there")
    return e.select("sentence_id", "span_set", "span_no", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("span_text"), "text_there", message.alias("message"))


def category_errors(df: DataFrame, column: str = "toxicity_labels", valid: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(sentence_id, error, labels): ``invalid`` with the labels outside the valid ones, ``duplicate`` with every later
    occurrence; a record may have both."""
    c = F.coalesce(F.col(column), F.array().cast("array<string>"))
    bad = F.filter(c, lambda x: ~F.coalesce(x.isin(*valid), F.lit(False)))
    again = F.filter(F.transform(c, lambda x, i: F.when(F.array_position(c, x) <= i, x)), lambda x: x.isNotNull())
    both = F.filter(F.array(F.struct(F.lit("invalid").alias("error"), bad.alias("labels")), F.struct(F.lit("duplicate").alias("error"), again.alias("labels"))), lambda e: F.size(e["labels"]) > 0)
    return df.select("sentence_id", F.inline(both))


def schema_errors(df: DataFrame, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """(sentence_id, field, value) of values outside their sets and of nulls where a value is due. Types are the frame's."""
    one = lambda c, ok: F.when(~F.coalesce(F.col(c).isin(*ok), F.lit(False)), F.array(F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))))
    due = lambda c: F.when(F.col(c).isNull(), F.array(F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("value"))))
    inner = lambda c, items, ok: F.transform(F.filter(items, lambda x: ~F.coalesce(x.isin(*ok), F.lit(False))), lambda x: F.struct(F.lit(c).alias("field"), x.alias("value")))
    parts = [one("platform", platforms), one("split", SPLITS), one("sentiment", SENTIMENTS), inner("toxicity_labels", F.col("toxicity_labels"), CATEGORIES), inner("ner_spans", F.transform("ner_spans", lambda p: p["entity_type"]), ENTITIES)]
    parts += [due(c) for c in ("sentence_id", "text", "sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels", "token_language_labels", "collected_at", "annotated_at")]
    none = F.array().cast("array<struct<field:string,value:string>>")
    return df.select("sentence_id", F.inline(F.concat(*(F.coalesce(p.cast("array<struct<field:string,value:string>>"), none) for p in parts))))


def bio_valid(tags: str | Column) -> Column:
    """Whether all tags are known and each I- follows a B- or I- of its type."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    before = F.concat(F.array(F.lit("O")), tags)
    ok = F.zip_with(tags, F.slice(before, F.lit(1), F.size(tags)), lambda t, p: F.coalesce(t.isin(*BIO), F.lit(False)) & (~F.startswith(t, F.lit("I-")) | (F.substring(p, 3, 3) == F.substring(t, 3, 3))))
    return F.forall(ok, lambda x: x)


#: How fields are compared: as they are, at seconds, or token by token with confidences that may differ by this.
SCALARS = ("text", "platform", "split", "sentiment", "source_url")
TIMES = ("collected_at", "annotated_at")
NESTED = ("sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels")
NEAR = 1e-9


def round_trip(original: DataFrame, back: DataFrame, order: str | None = None) -> DataFrame:
    """(sentence_id, fields) of the original's records that come back with other values, ``missing`` where none comes
    back. Of records that come back twice the last by ``order`` counts; what else comes back is ignored."""
    cols = [*SCALARS, *TIMES, *NESTED, "token_language_labels"]
    b = back.groupBy("sentence_id").agg((F.max_by(F.struct(*cols), order) if order else F.first(F.struct(*cols))).alias("_b"))
    j = original.select("sentence_id", F.struct(*cols).alias("_a")).join(b, "sentence_id", "left")
    a_, b_ = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    differs = {c: ~a_(c).eqNullSafe(b_(c)) for c in (*SCALARS, *NESTED)}
    differs |= {c: ~F.date_trunc("second", a_(c)).eqNullSafe(F.date_trunc("second", b_(c))) for c in TIMES}
    t = "token_language_labels"
    same = F.forall(F.zip_with(a_(t), b_(t), lambda x, y: x["token"].eqNullSafe(y["token"]) & x["label"].eqNullSafe(y["label"]) & F.coalesce(F.abs(x["confidence"] - y["confidence"]) < NEAR, x["confidence"].eqNullSafe(y["confidence"]))), lambda x: x)
    differs[t] = ~F.coalesce((F.size(a_(t)) == F.size(b_(t))) & same, a_(t).isNull() & b_(t).isNull())
    fields = F.array_compact(F.array(*(F.when(d, F.lit(c)) for c, d in differs.items())))
    out = j.select("sentence_id", F.when(F.col("_b").isNull(), F.array(F.lit("missing"))).otherwise(fields).alias("fields"))
    return out.where(F.size("fields") > 0)


def round_trip_report(original: DataFrame, failures: DataFrame) -> DataFrame:
    """(records, passed, failed)."""
    n, f = original.agg(F.count("*").alias("records")), failures.agg(F.count("*").alias("failed"))
    return n.crossJoin(F.broadcast(f)).select("records", (F.col("records") - F.col("failed")).alias("passed"), "failed")


class RoundTripError(ValueError):
    """Records came back changed; the message names the first few and their fields."""


def assert_round_trip(original: DataFrame, back: DataFrame, order: str | None = None) -> None:
    bad = round_trip(original, back, order)
    first = bad.orderBy("sentence_id").limit(5).collect()
    if first:
        raise RoundTripError("; ".join(f"{r.sentence_id}: {', '.join(r.fields)}" for r in first))
