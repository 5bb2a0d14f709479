"""Queries of the core operators with the SQL each is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.functions.labels import CATEGORIES
from corpuskit.functions.session import shared_folder
from corpuskit.operators import agreement, annotation, dedup, filters, metrics, ranks, reports, sampling, taggers, training, validate, welfare
from corpuskit.plans.sql import sql
from corpuskit.sources import files, web

#: Words the registered queries are given; every operator takes its own.
LEXICON = ("रो", "री", "रै", "नै", "सूं", "तांई", "खातर", "माथै", "घणो", "कनै", "सागै", "मांय")
ENGLISH = ("she", "his", "our", "nobody", "we", "your", "someone", "everyone", "my", "they", "their", "behind", "although", "but", "and", "the", "is", "near", "because")
POSITIVE = ("good", "victory", "beautiful", "अच्छा", "जीत", "achha", "happy", "pakka", "घणो")
NEGATIVE = ("bad", "dirty", "problem", "बुरा", "हार", "bura", "sad", "खराब", "haar")
KEYWORDS = {"caste_slur": ("zorvaite", "neech"), "religious": ("bhagao", "isko"), "gender": ("lugai", "chhori"), "general": ("bewakoof", "हरामखोर", "nikamma")}
ENTITIES = ((("लूणपुरा",), "LOC"), (("लूणपुरा", "डेयरी"), "ORG"), (("सोनेलाव", "कॉलेज"), "ORG"), (("झालोरपुर",), "LOC"), (("Maru", "Ekta", "Morcha"), "ORG"), (("Maru", "Ekta"), "PER"), (("Sonelav", "College"), "ORG"), (("धोरा", "विकास", "दल"), "ORG"), (("बेसन", "मिल्स"), "ORG"))
REQUIRED = ["mBERT zero-shot", "MuRIL zero-shot", "GPT-4o 5-shot", "lexicon", "lexicon + language tags", "fine-tuned"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "raw_sentences")


def _annotated(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The annotated sentences, each once."""
    return ranks.first_per_key(_t(s, d, "annotated_sentences").select("sentence_id", *columns), "sentence_id", [columns[0]])


def _votes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(_t(s, d, f"{n}_votes") for n in ("sentiment", "tox", "span"))


# --- text -----------------------------------------------------------------------------------------------------------


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(T.tokens("text")), F.lit(0))
    return _raw(s, d).groupBy(T.platform_of().alias("platform")).agg(F.count("*").alias("records"), F.sum(n).alias("tokens"))


def nfc_changes(s: SparkSession, d: str) -> DataFrame:
    """Raw records whose text is not canonically composed."""
    return _raw(s, d).where(T.nfc("text") != F.col("text")).select("seq", T.nfc("text").alias("text"))


def token_scripts(s: SparkSession, d: str) -> DataFrame:
    t = _raw(s, d).select(F.explode(T.tokens("text")).alias("t"))
    return t.groupBy(T.script("t").alias("script")).agg(F.count("*").alias("n"))


def token_offsets(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("seq", F.posexplode(T.token_places("text")).alias("token_no", "t")).select("seq", "token_no", "t.token", F.col("t.start").alias("start"), F.col("t.end").alias("end"))


def shingle_stats(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).groupBy(T.platform_of().alias("platform")).agg(F.sum(F.coalesce(F.size(T.shingles("text")), F.lit(0))).alias("shingles"))


def times_as_text(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("seq", T.iso(F.coalesce("collected_at", F.timestamp_seconds(F.lit(0)))).alias("collected_at"))


# --- filters, duplicates --------------------------------------------------------------------------------------------


def manual_import(s: SparkSession, d: str) -> DataFrame:
    """Raw records as manual records: stripped, composed, ten characters at least, platform and address mapped."""
    return filters.manual_records(_raw(s, d)).select("seq", "text", "source_url", "platform")


def min_length_filter(s: SparkSession, d: str) -> DataFrame:
    """Records of at least ten characters after stripping and composing, by platform."""
    r = _raw(s, d).where(F.length(T.nfc(T.strip("text"))) >= 10)
    return r.groupBy(T.platform_of().alias("platform")).agg(F.count("*").alias("n"))


def lexicon_filter(s: SparkSession, d: str) -> DataFrame:
    return filters.lexicon_filter(_raw(s, d), LEXICON).select("seq", "sentence_id")


def lexicon_filter_joined(s: SparkSession, d: str) -> DataFrame:
    """The same with the lexicon as a frame, as it is done for large ones."""
    lines = s.createDataFrame([(w,) for w in ("# words", "", *LEXICON, *LEXICON)], "value string")
    return filters.lexicon_filter(_raw(s, d), filters.lexicon_frame(lines)).select("seq", "sentence_id")


def lexicon_hits_by_platform(s: SparkSession, d: str) -> DataFrame:
    r = _raw(s, d)
    return r.groupBy(T.platform_of().alias("platform")).agg(F.sum(filters.lexicon_hits(r, LEXICON)).cast("long").alias("hits"))


def exact_dedup(s: SparkSession, d: str) -> DataFrame:
    """The first record (by seq) of each composed text."""
    return dedup.exact_dedup(_raw(s, d).select("seq", "sentence_id", "text")).select("seq", "sentence_id")


def dedup_split_counts(s: SparkSession, d: str) -> DataFrame:
    """Records by platform and split; of the records of one composed text, only the first by sentence_id counts."""
    a = dedup.exact_dedup(_t(s, d, "annotated_sentences").select("sentence_id", "platform", "split", "text"), order=["sentence_id", "platform", "split"])
    return a.groupBy(T.platform_of().alias("platform"), "split").agg(F.count("*").alias("n"))


def merge_first_by_id(s: SparkSession, d: str) -> DataFrame:
    """Deliveries merged: whole rows, the first of each sentence; odd platforms' rows come as a second file."""
    r = _raw(s, d)
    common = F.coalesce(F.col("platform").isin("twitter", "sharechat"), F.lit(False))
    return dedup.merge_first([r.where(common), r.where(~common)]).select("seq", "sentence_id", "text", "source_url", "platform")


def near_dup_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of first records of exact texts whose 3-gram sets have a Jaccard index of 0.85 or more."""
    return dedup.near_pairs(dedup.exact_dedup(_raw(s, d).select("seq", "text")))


def near_dup_keep(s: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_keep(dedup.exact_dedup(_raw(s, d).select("seq", "sentence_id", "text"))).select("seq", "sentence_id")


# --- draws ----------------------------------------------------------------------------------------------------------


def _pool(s: SparkSession, d: str) -> DataFrame:
    r = ranks.first_per_key(_raw(s, d).select("sentence_id", "seq", "platform"), "sentence_id", "seq")
    return r.select("sentence_id", "seq", F.coalesce(T.platform_of(), F.lit("none")).alias("platform"))


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """150 records, each platform with its share."""
    return sampling.stratified_sample(_pool(s, d), 150).select("sentence_id", "platform")


def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(_pool(s, d)).select("sentence_id", "platform", "split")


def split_overlap(s: SparkSession, d: str) -> DataFrame:
    """Sentence ids in more than one split."""
    return sampling.in_several_splits(_t(s, d, "annotated_sentences").select("sentence_id", "split"))


def holdout_counts(s: SparkSession, d: str) -> DataFrame:
    """The last tenth of the input, by platform."""
    h = sampling.last_tenth(_raw(s, d).select("seq", "platform"))
    return h.groupBy(T.platform_of().alias("platform"), "held_out").agg(F.count("*").alias("n"))


def oversampled(s: SparkSession, d: str) -> DataFrame:
    """Toxic sentences repeated until they are a third of the others."""
    a = _annotated(s, d, "toxicity_labels")
    return sampling.oversample(a, F.size("toxicity_labels") > 0).groupBy("sentence_id").agg(F.count("*").alias("copies"))


# --- annotation -----------------------------------------------------------------------------------------------------


def majority_sentiment(s: SparkSession, d: str) -> DataFrame:
    return _annotated(s, d, "sentiment_annotator_labels").select("sentence_id", annotation.majority_label("sentiment_annotator_labels").alias("label"))


def majority_toxicity(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "toxicity_annotator_labels")
    return a.select("sentence_id", F.array_join(annotation.majority_set("toxicity_annotator_labels", CATEGORIES), ",").alias("labels"))


def majority_spans(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "text", "ner_annotator_spans")
    return a.select("sentence_id", F.posexplode(annotation.spans_with_text("text", annotation.majority_spans("ner_annotator_spans"))).alias("span_no", "p")).select("sentence_id", "span_no", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "p.entity_type", F.col("p.text").alias("span_text"))


def toxicity_vote(s: SparkSession, d: str) -> DataFrame:
    """Valid categories that at least two annotators gave, of the vote table."""
    v = _votes(s, d)[1].select("item_id", "annotator", F.explode("labels").alias("category")).where(F.col("category").isin(*CATEGORIES))
    return annotation.long_majority(v, ["item_id", "category"]).select("item_id", "category")


def span_vote(s: SparkSession, d: str) -> DataFrame:
    return annotation.long_majority(_votes(s, d)[2], ["item_id", "start", "end", "entity_type"])


def _tasks(s: SparkSession, d: str) -> DataFrame:
    """The annotated sentences as an annotation tool exports them, the three tasks' results in one list."""
    a = _annotated(s, d, "text", "platform", "source_url", "collected_at", "sentiment_annotator_labels", "toxicity_annotator_labels", "ner_annotator_spans")
    value = "struct<choices:array<string>,labels:array<string>,start:int,end:int>"
    choice = lambda c: F.struct(F.lit("choices").alias("type"), F.struct(c.alias("choices"), F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).cast(value).alias("value"))
    spot = lambda p: F.struct(F.lit("labels").alias("type"), F.struct(F.lit(None).cast("array<string>").alias("choices"), F.array(p["entity_type"]).alias("labels"), p["start"].alias("start"), p["end"].alias("end")).cast(value).alias("value"))
    data = F.struct("sentence_id", "text", "platform", "source_url", T.iso("collected_at").alias("collected_at")).alias("data")
    res = lambda c: F.struct(c.alias("result"))
    return a.select(
        F.xxhash64("sentence_id").alias("id"), data, F.transform("sentiment_annotator_labels", lambda x: res(F.array(choice(F.array_compact(F.array(x)))))).alias("by_sentiment"),
        F.transform("toxicity_annotator_labels", lambda x: res(F.array(choice(x)))).alias("by_toxicity"), F.transform("ner_annotator_spans", lambda x: res(F.transform(x, spot))).alias("by_ner"),
    )


AT = "2024-02-01T14:00:00Z"


def sentiment_export(s: SparkSession, d: str) -> DataFrame:
    r = annotation.sentiment_export(_tasks(s, d).withColumnRenamed("by_sentiment", "annotations"), annotated_at=AT)
    return r.select("sentence_id", "platform", "sentiment", F.size("sentiment_annotator_labels").alias("annotators"), T.iso("collected_at").alias("collected_at"))


def toxicity_export(s: SparkSession, d: str) -> DataFrame:
    r = annotation.toxicity_export(_tasks(s, d).withColumnRenamed("by_toxicity", "annotations"), annotated_at=AT)
    return r.select("sentence_id", F.array_join("toxicity_labels", ",").alias("labels"), F.size("toxicity_annotator_labels").alias("annotators"))


def ner_export(s: SparkSession, d: str) -> DataFrame:
    r = annotation.ner_export(_tasks(s, d).withColumnRenamed("by_ner", "annotations"), annotated_at=AT)
    return r.select("sentence_id", F.size("ner_annotator_spans").alias("annotators"), F.explode_outer("ner_spans").alias("p")).select("sentence_id", "annotators", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "p.entity_type")


def adjudicated(s: SparkSession, d: str) -> DataFrame:
    """The expert's sentiment and categories in place of the majority's."""
    a = _annotated(s, d, "sentiment", "toxicity_labels", "ner_spans")
    r = annotation.adjudicated(a, _t(s, d, "adjudicated_items"))
    return r.select("sentence_id", "sentiment", F.array_join("toxicity_labels", ",").alias("labels"), F.size("ner_spans").alias("spans"))


# --- agreement ------------------------------------------------------------------------------------------------------


def _judged(sv: DataFrame) -> DataFrame:
    return sv.select("batch_id", "item_id", "annotator").distinct()


def _rounded(k: DataFrame) -> DataFrame:
    return k.withColumn("kappa", F.round("kappa", 6))


def kappa_sentiment(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.sentiment_kappa(_votes(s, d)[0]))


def kappa_toxicity(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.toxicity_kappa(_votes(s, d)[1]))


def kappa_ner(s: SparkSession, d: str) -> DataFrame:
    sv, _, sp = _votes(s, d)
    return _rounded(agreement.span_kappa(sp, _judged(sv)))


def kappa_ner_per_sentence(s: SparkSession, d: str) -> DataFrame:
    sv, _, sp = _votes(s, d)
    return _rounded(agreement.span_kappa(sp, _judged(sv), flat=False))


def iaa_flags(s: SparkSession, d: str) -> DataFrame:
    """Batches by task with mean kappa and whether it is below the task's threshold."""
    sv, tv, sp = _votes(s, d)
    k = agreement.batch_kappa(agreement.sentiment_kappa(sv), "sentiment").unionByName(agreement.batch_kappa(agreement.toxicity_kappa(tv), "toxicity")).unionByName(agreement.batch_kappa(agreement.span_kappa(sp, _judged(sv)), "ner"))
    return _rounded(agreement.flagged(k)).select("batch_id", "task", "kappa", "pairs", "degenerate", "flagged")


# --- taggers and metrics --------------------------------------------------------------------------------------------


def langid_tokens(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "text")
    return a.select("sentence_id", F.posexplode(taggers.languages("text", LEXICON, ENGLISH)).alias("token_no", "t")).select("sentence_id", "token_no", "t.token", "t.label", "t.confidence")


def langid_distribution(s: SparkSession, d: str) -> DataFrame:
    a = _t(s, d, "annotated_sentences").select(F.explode("token_language_labels").alias("t"))
    return a.groupBy(F.col("t.label").alias("label")).agg(F.count("*").alias("n"))


def langid_metrics(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "text", "token_language_labels").withColumn("p", taggers.languages("text", LEXICON, ENGLISH))
    m = metrics.token_labels(a, "token_language_labels", "p")
    return m.select("label", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def _sentiments(s: SparkSession, d: str) -> DataFrame:
    return _annotated(s, d, "text", "platform", "sentiment").withColumn("p", taggers.sentiment("text", POSITIVE, NEGATIVE))


def sentiment_predict(s: SparkSession, d: str) -> DataFrame:
    return _sentiments(s, d).select("sentence_id", "p.label", F.round("p.confidence", 6).alias("confidence"))


def sentiment_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.single_label(_sentiments(s, d).withColumn("l", F.col("p.label")), "sentiment", "l")
    return m.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def sentiment_ablation(s: SparkSession, d: str) -> DataFrame:
    """Macro F1 with and without language tags in the text."""
    a = _sentiments(s, d).withColumns({"l": F.col("p.label"), "t": taggers.sentiment_with_languages("text", POSITIVE, NEGATIVE, LEXICON, ENGLISH)["label"]})
    m = [metrics.macro(metrics.single_label(a, "sentiment", c)) for c in ("l", "t")]
    r = reports.ablation(*m)
    return r.select(*(F.round(c, 6).alias(c) for c in ("without_f1", "with_f1", "improvement")), "meets")


def langid_augmented(s: SparkSession, d: str) -> DataFrame:
    return _annotated(s, d, "text").select("sentence_id", taggers.with_languages("text", taggers.languages("text", LEXICON, ENGLISH)).alias("augmented"))


def _toxicities(s: SparkSession, d: str) -> DataFrame:
    return _annotated(s, d, "text", "platform", "toxicity_labels").withColumn("p", taggers.toxicity("text", KEYWORDS))


def toxicity_predict(s: SparkSession, d: str) -> DataFrame:
    return _toxicities(s, d).select("sentence_id", F.array_join("p.labels", ",").alias("labels"), *(F.round(F.try_element_at("p.scores", F.lit(c)), 6).alias(c) for c in CATEGORIES))


def toxicity_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.multi_label(_toxicities(s, d).withColumn("l", F.col("p.labels")), "toxicity_labels", "l")
    return m.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def should_oversample(s: SparkSession, d: str) -> DataFrame:
    return metrics.should_oversample(metrics.multi_label(_toxicities(s, d).withColumn("l", F.col("p.labels")), "toxicity_labels", "l"))


def class_weights(s: SparkSession, d: str) -> DataFrame:
    return metrics.sentiment_weights(_annotated(s, d, "sentiment")).select("label", F.round("weight", 6).alias("weight"))


def toxicity_weights(s: SparkSession, d: str) -> DataFrame:
    return metrics.toxicity_weights(_annotated(s, d, "toxicity_labels")).select("label", F.round("weight", 6).alias("weight"))


def ner_tag(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "text")
    return a.select("sentence_id", F.explode(taggers.entities("text", ENTITIES)).alias("p")).select("sentence_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "p.entity_type", F.col("p.text").alias("span_text"))


def ner_bio(s: SparkSession, d: str) -> DataFrame:
    """The tag of each token by the gold spans."""
    a = _annotated(s, d, "text", "ner_spans")
    return a.select("sentence_id", F.posexplode(taggers.bio_tags("text", "ner_spans")).alias("token_no", "tag"))


def bio_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Spans read back from the tags of the gold spans, and whether the tags are valid."""
    a = _annotated(s, d, "text", "ner_spans").withColumn("tags", taggers.bio_tags("text", "ner_spans"))
    a = a.select("sentence_id", validate.bio_valid("tags").alias("valid"), F.explode(taggers.bio_spans("text", "tags")).alias("p"))
    return a.select("sentence_id", "valid", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "p.entity_type")


def ner_metrics(s: SparkSession, d: str) -> DataFrame:
    a = _annotated(s, d, "text", "ner_spans").withColumn("p", taggers.entities("text", ENTITIES))
    m = metrics.spans(a, "ner_spans", "p")
    return m.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# --- validators -----------------------------------------------------------------------------------------------------


def span_invariant_errors(s: SparkSession, d: str) -> DataFrame:
    """Gold and annotators' spans whose text is not at their place; the raw texts stand for the annotated ones, so that
    records written in other characters there show."""
    a = _annotated(s, d, "ner_spans", "ner_annotator_spans")
    r = ranks.first_per_key(_raw(s, d).select("sentence_id", "seq", "text"), "sentence_id", "seq").select("sentence_id", "text")
    return validate.span_errors(a.join(r, "sentence_id")).select("sentence_id", "span_set", "span_no", "start", "end", "text_there")


def toxicity_label_errors(s: SparkSession, d: str) -> DataFrame:
    """Invalid and repeated labels of the vote table's sets."""
    v = _votes(s, d)[1].select(F.concat_ws("/", "item_id", "annotator").alias("sentence_id"), F.concat("labels", F.slice("labels", 1, 1)).alias("toxicity_labels")).distinct()
    e = validate.category_errors(v)
    return e.select("sentence_id", "error", F.array_join("labels", ",").alias("labels"))


def schema_errors(s: SparkSession, d: str) -> DataFrame:
    return validate.schema_errors(_t(s, d, "annotated_sentences").distinct())


def round_trip_failures(s: SparkSession, d: str) -> DataFrame:
    """Annotated sentences written as JSON lines and read again; those that come back changed (texts are composed on the
    way, so those that were not fail) and their fields."""
    a = ranks.first_per_key(_t(s, d, "annotated_sentences"), "sentence_id", ["text", "platform", "split"])
    back = files.read_annotated(s, _written(s, a))
    f = validate.round_trip(files.read_annotated_like(a), back)
    return f.select("sentence_id", F.array_join("fields", ",").alias("fields"))


def _path(s: SparkSession, ending: str) -> str:
    return f"{shared_folder(s)}/corpuskit-{s.sparkContext.applicationId}/{uuid.uuid4().hex}.{ending}"


def _written(s: SparkSession, a: DataFrame) -> str:
    files.write_annotated(a, path := _path(s, "jsonl"))
    return path


def round_trip_report(s: SparkSession, d: str) -> DataFrame:
    """Records, those that came back as they were, and the others."""
    a = ranks.first_per_key(_t(s, d, "annotated_sentences"), "sentence_id", ["text", "platform", "split"])
    return validate.round_trip_report(a, validate.round_trip(files.read_annotated_like(a), files.read_annotated(s, _written(s, a))))


# --- files ----------------------------------------------------------------------------------------------------------


def csv_import(s: SparkSession, d: str) -> DataFrame:
    """Raw records written as CSV and imported as manual records."""
    files.write_csv(_raw(s, d), path := _path(s, "csv"))
    return files.read_csv(s, path).select("text", "source_url", "platform")


def csv_import_counts(s: SparkSession, d: str) -> DataFrame:
    return files.import_counts(_raw(s, d), filters.manual_records(_raw(s, d)))


def text_import(s: SparkSession, d: str) -> DataFrame:
    """Texts of raw records as lines of a text file and imported as manual records of one platform."""
    _raw(s, d).select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")).write.text(path := _path(s, "txt"))
    return files.read_text(s, path, "sharechat").select("text", "source_url", "platform")


def jsonl_merge(s: SparkSession, d: str) -> DataFrame:
    """Raw records written as two JSON-lines files and merged, those of sharechat first; a third file is missing."""
    r = ranks.first_per_key(_raw(s, d).select("sentence_id", "seq", "text", "source_url", "platform", "collected_at"), ["sentence_id", "platform"], "seq")
    parts = [(r.where("platform = 'sharechat'"), _path(s, "jsonl")), (r.where("platform = 'twitter'"), _path(s, "jsonl"))]
    for df, path in parts:
        files.write_raw(df, path)
    return files.merge_raw(s, [*(p for _, p in parts), _path(s, "jsonl")]).select("sentence_id", "text", "platform", T.iso("collected_at").alias("collected_at"))


def parquet_test_split(s: SparkSession, d: str) -> DataFrame:
    """The test split of annotated sentences stored by split as Parquet: only its folder is read."""
    files.write_annotated(_annotated(s, d, "text", "platform", "split", "sentiment", "sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels", "token_language_labels", "source_url", "collected_at", "annotated_at"), path := _path(s, "parquet"), "parquet", by_split=True)
    return filters.in_split(files.read_annotated(s, path, "parquet"), "test").select("sentence_id", "sentiment", F.size("ner_spans").alias("spans"))


def annotation_tasks(s: SparkSession, d: str) -> DataFrame:
    """Raw records as an annotation tool imports them."""
    r = ranks.first_per_key(_raw(s, d), "sentence_id", "seq")
    t = files.annotation_tasks(r)
    return t.select(F.get_json_object("value", "$.data.sentence_id").alias("sentence_id"), F.get_json_object("value", "$.data.text").alias("text"), F.get_json_object("value", "$.data.collected_at").alias("collected_at"))


# --- reports --------------------------------------------------------------------------------------------------------


def platform_proportions(s: SparkSession, d: str) -> DataFrame:
    return reports.proportions(_raw(s, d).select(T.platform_of().alias("platform"))).select("platform", "n", F.round("share", 6).alias("share"))


def corpus_statistics(s: SparkSession, d: str) -> DataFrame:
    return reports.corpus_statistics(_t(s, d, "annotated_sentences"))


def entity_statistics(s: SparkSession, d: str) -> DataFrame:
    return reports.entity_statistics(_t(s, d, "annotated_sentences"))


def language_statistics(s: SparkSession, d: str) -> DataFrame:
    return reports.language_statistics(_t(s, d, "annotated_sentences"))


def _macro_by_platform(s: SparkSession, d: str) -> DataFrame:
    p = T.export_platform(T.platform_of())
    a = _sentiments(s, d).select(p.alias("platform"), "sentiment", F.col("p.label").alias("l"))
    x = _toxicities(s, d).select(p.alias("platform"), "toxicity_labels", F.col("p.labels").alias("l"))
    n = _annotated(s, d, "text", "platform", "ner_spans").select(p.alias("platform"), "ner_spans", taggers.entities("text", ENTITIES).alias("l"))
    parts = {"sentiment": metrics.single_label(a, "sentiment", "l", ["platform"]), "toxicity": metrics.multi_label(x, "toxicity_labels", "l", ["platform"]), "ner": metrics.spans(n, "ner_spans", "l", ["platform"])}
    out = [metrics.macro(m, ["platform"]).select(F.lit(t).alias("task"), "platform", "macro_f1") for t, m in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def platform_split_eval(s: SparkSession, d: str) -> DataFrame:
    return reports.platform_split(_macro_by_platform(s, d)).withColumn("macro_f1", F.round("macro_f1", 6))


def comparison_pivot(s: SparkSession, d: str) -> DataFrame:
    """The models' figures by task: constants of the stubs, and the lexicon models' macro F1 on all sentences."""
    a, x = _sentiments(s, d).withColumn("l", F.col("p.label")), _toxicities(s, d).withColumn("l", F.col("p.labels"))
    own = metrics.macro(metrics.single_label(a, "sentiment", "l")).select(F.lit(20).alias("seq"), F.lit("lexicon").alias("model_name"), F.lit("sentiment").alias("task"), "macro_f1")
    tox = metrics.macro(metrics.multi_label(x, "toxicity_labels", "l")).select(F.lit(21).alias("seq"), F.lit("lexicon").alias("model_name"), F.lit("toxicity").alias("task"), "macro_f1")
    c = reports.comparison(reports.stub_results(s).unionByName(own).unionByName(tox), REQUIRED)
    return c.select("place", "model_name", *(F.when(F.isnan(t), "N/A").otherwise(F.format_string("%.4f", t)).alias(t) for t in ("sentiment", "ner", "toxicity")))


def release_gate(s: SparkSession, d: str) -> DataFrame:
    scores = _macro_by_platform(s, d).groupBy("task").agg(F.min("macro_f1").alias("macro_f1"))
    return filters.release_gate(scores, {"sentiment": 0.3, "ner": 0.82, "toxicity": 0.79}).withColumn("actual", F.round("actual", 6))


def training_log(s: SparkSession, d: str) -> DataFrame:
    """Epochs run and the best of them for models whose score stays the same, by task and platform."""
    m = _macro_by_platform(s, d).select(F.concat_ws("/", "task", "platform").alias("task"), "macro_f1")
    return training.training_log(m).withColumn("best_f1", F.round("best_f1", 6))


def few_shot_prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts of the test sentences with five train sentences as examples, of all three tasks."""
    a = _annotated(s, d, "text", "split", "sentiment", "toxicity_labels", "ner_spans").where("text is not null")
    shots = a.where("split = 'train' and sentiment is not null and toxicity_labels is not null")
    out = [reports.prompts(a.where("split = 'test'"), shots, t).select("sentence_id", F.lit(t).alias("task"), F.md5("prompt").alias("digest")) for t in ("sentiment", "ner", "toxicity")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- welfare, pages, search -----------------------------------------------------------------------------------------


def _log(s: SparkSession, d: str) -> DataFrame:
    """The events as a welfare log: sign-ups assign, errors opt out now and then, purchases reassign, clicks expose."""
    e = _t(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "assign").when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "opt_out").when(F.col("event_type") == "purchase", "reassign").when(F.col("event_type") == "click", "expose")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("annotator_id"), kind.alias("kind"), F.concat(F.lit("s"), (F.col("event_id") % 97).cast("string")).alias("sentence_id"), F.floor("value").cast("int").alias("n")).where("kind is not null")


def daily_exposure(s: SparkSession, d: str) -> DataFrame:
    """Exposure a day and annotator (the amounts of click events), and whether more is allowed."""
    return welfare.daily_exposure(_log(s, d))


def open_assignments(s: SparkSession, d: str) -> DataFrame:
    return welfare.open_assignments(_log(s, d))


def replacement_queue(s: SparkSession, d: str) -> DataFrame:
    return welfare.replacement_queue(_log(s, d)).select("sentence_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def page_posts(s: SparkSession, d: str) -> DataFrame:
    """Texts read back from pages made of the documents; a tenth of the pages carry an error title."""
    doc = _t(s, d, "documents").where("text is not null")
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.when(F.col("doc_id") % 10 == 0, "404 Not Found").otherwise("post")
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title><script>var x = '</p>';</script></head><body><div>menu</div><p>"), esc, F.lit("</p></body></html>"))
    pages = doc.select(F.col("doc_id").alias("page_id"), F.coalesce("source_url", F.lit("")).alias("url"), html.alias("html"))
    return web.page_texts(pages).select("page_id", "place", F.length(F.regexp_replace("text", rf"(?U){T.SPACE}+", "")).alias("characters"))


def search_query(s: SparkSession, d: str) -> DataFrame:
    return web.search_query(s.createDataFrame([(0, "Maru Ekta"), (1, "#rajasthan"), (2, "  "), (3, '"a b"'), (4, " म्हारो ")], "ord int, term string"))


QUERIES = {
    f.__name__: f
    for f in (
        dedup_split_counts, tokenize_counts, nfc_changes, token_scripts, token_offsets, shingle_stats, times_as_text, manual_import, min_length_filter, lexicon_filter, lexicon_filter_joined, lexicon_hits_by_platform,
        exact_dedup, merge_first_by_id, near_dup_pairs, near_dup_keep, stratified_sample, stratified_split, split_overlap, holdout_counts, oversampled,
        majority_sentiment, majority_toxicity, majority_spans, toxicity_vote, span_vote, sentiment_export, toxicity_export, ner_export, adjudicated,
        kappa_sentiment, kappa_toxicity, kappa_ner, kappa_ner_per_sentence, iaa_flags,
        langid_tokens, langid_distribution, langid_metrics, langid_augmented, sentiment_predict, sentiment_metrics, sentiment_ablation, toxicity_predict, toxicity_metrics, should_oversample, class_weights, toxicity_weights,
        ner_tag, ner_bio, bio_round_trip, ner_metrics, span_invariant_errors, toxicity_label_errors, schema_errors, round_trip_failures, round_trip_report,
        csv_import, csv_import_counts, text_import, jsonl_merge, parquet_test_split, annotation_tasks,
        platform_proportions, corpus_statistics, entity_statistics, language_statistics, platform_split_eval, comparison_pivot, release_gate, training_log, few_shot_prompts,
        daily_exposure, open_assignments, replacement_queue, page_posts, search_query,
    )
}

SQL = sql(LEXICON, ENGLISH, POSITIVE, NEGATIVE, KEYWORDS, ENTITIES)
