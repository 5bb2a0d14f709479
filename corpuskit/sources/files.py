"""Reading and writing corpus files. Frames come lazily; only checks of headers look at files at once.

Records read from files have ``seq``, their order: the file's place in the list and in the file, so that "first" is
defined. Time stamps are text in files (UTC, seconds, Z) and timestamps in frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.labels import ANNOTATED, EXPORT, RAW
from corpuskit.functions.text import iso, nfc, parse_time, strip
from corpuskit.operators.dedup import merge_first
from corpuskit.operators.filters import lexicon_frame, manual_records

FORMATS = ("jsonl", "parquet")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.monotonically_increasing_id())


def _identified(df: DataFrame) -> DataFrame:
    """A record's id from its address, text and place, the same each time it is read; its time is that of the reading."""
    return df.withColumns({"sentence_id": F.md5(F.concat_ws("|", "source_url", "text", F.col("seq").cast("string"))), "collected_at": F.current_timestamp()})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manual records of a CSV file with a header; text is required, source_url and platform may be missing, others are
    ignored; short rows have empty values; a byte order mark is no part of the header."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8", mode="PERMISSIVE", enforceSchema=False, ignoreLeadingWhiteSpace=False)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if "text" not in df.columns:
        raise ValueError(f"a CSV file of records needs a column text; it has {df.columns}")
    for c in ("source_url", "platform"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return _identified(manual_records(_numbered(df.select("text", "source_url", "platform"))))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Manual records of a JSON file with a list of objects; items that are no objects are left out, values become text."""
    whole = spark.read.text(path, wholetext=True)
    if not whole.where(~F.startswith(strip("value"), F.lit("["))).isEmpty():
        raise ValueError("the file must hold a list of objects")
    items = whole.select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    fields = ("text", "source_url", "platform")
    df = _numbered(items.where(F.startswith(F.ltrim("item"), F.lit("{")))).select("seq", *(F.get_json_object("item", f"$.{c}").alias(c) for c in fields))
    return _identified(manual_records(df))


def read_text(spark: SparkSession, path: str, platform: str = "other") -> DataFrame:
    """Manual records of a text file, one a line; blank lines and those that begin with # are left out."""
    df = _numbered(spark.read.text(path)).where(~F.startswith(strip("value"), F.lit("#")))
    return _identified(manual_records(df.select("seq", F.col("value").alias("text"), F.lit("").alias("source_url"), F.lit(platform).alias("platform"))))


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw records of JSON lines; a missing source_url is empty."""
    df = _numbered(spark.read.schema(RAW).json(path))
    return df.withColumns({"source_url": F.coalesce("source_url", F.lit("")), "collected_at": parse_time("collected_at")})


def write_raw(df: DataFrame, path: str) -> None:
    df.select("text", "source_url", iso("collected_at").alias("collected_at"), "platform", "sentence_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def merge_raw(spark: SparkSession, paths: list[str], out: str | None = None) -> DataFrame:
    """The records of several files, the first of each sentence_id in the order of ``paths``; missing files are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)]
    if not there:
        return read_raw_empty(spark)
    merged = merge_first([read_raw(spark, p) for p in there])
    if out:
        write_raw(merged, out)
    return merged


def read_raw_empty(spark: SparkSession) -> DataFrame:
    return _numbered(spark.createDataFrame([], RAW)).withColumn("collected_at", parse_time("collected_at"))


def _known(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; it must be one of {', '.join(FORMATS)}")


_TEXTS = ("sentence_id", "text", "platform", "split", "sentiment", "source_url")
_SETS = ("sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels", "token_language_labels")


def stored(df: DataFrame) -> DataFrame:
    """Annotated records as files hold them: columns in order, texts composed, times as text, no null arrays."""
    names = [f.split(" ")[0] for f in ("sentence_id", "text", "platform", "split", "sentiment", "sentiment_annotator_labels", "ner_spans", "ner_annotator_spans", "toxicity_labels", "toxicity_annotator_labels", "token_language_labels", "source_url", "collected_at", "annotated_at")]
    kinds = dict(df.dtypes)
    span = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type"), nfc_in(p["text"]).alias("text"))
    nfc_in = lambda c: c  # noqa: E731  texts inside arrays keep their places and so their form
    made = {c: nfc(c) for c in _TEXTS} | {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in _SETS} | {c: iso(c) for c in ("collected_at", "annotated_at")}
    made["ner_spans"] = F.transform(made["ner_spans"], span)
    return df.select(*(made[c].alias(c) for c in names))


def write_annotated(df: DataFrame, path: str, fmt: str = "jsonl", by_split: bool = False) -> None:
    """Annotated records as JSON lines or Parquet; ``by_split`` lays Parquet out by split, so that reading one prunes."""
    _known(fmt)
    w = stored(df).write.mode("overwrite")
    if fmt == "jsonl":
        w.option("ignoreNullFields", "false").json(path)
    else:
        (w.partitionBy("split") if by_split else w).parquet(path)


def read_annotated(spark: SparkSession, path: str | list[str], fmt: str = "jsonl") -> DataFrame:
    """Annotated records; null arrays are empty, times are timestamps."""
    _known(fmt)
    df = spark.read.schema(ANNOTATED).json(path) if fmt == "jsonl" else spark.read.parquet(*([path] if isinstance(path, str) else path))
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in _SETS} | {c: parse_time(c) for c in ("collected_at", "annotated_at")})


def read_annotated_like(df: DataFrame) -> DataFrame:
    """Annotated records in memory as reading a file gives them: no null arrays, times at seconds, no null times."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in _SETS} | {c: F.coalesce(F.date_trunc("second", F.col(c)), F.timestamp_seconds(F.lit(0))) for c in ("collected_at", "annotated_at")})


def load_corpus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three splits of ``folder``/corpus.jsonl; FileNotFoundError without it."""
    path = f"{folder}/corpus.jsonl"
    x = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not x.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(x):
        raise FileNotFoundError(path)
    df = read_annotated(spark, path)
    return {s: df.where(F.col("split") == s) for s in ("train", "validation", "test")}


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_frame(spark.read.text(path))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of an annotation tool's JSON export (a list)."""
    return spark.read.schema(EXPORT).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Records (text, source_url, platform) as the CSV that ``read_csv`` reads, quoted, with blanks kept."""
    df.select("text", "source_url", "platform").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def import_counts(source: DataFrame, kept: DataFrame) -> DataFrame:
    """(read, kept, skipped) of an import."""
    return source.agg(F.count("*").alias("read")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept")))).select("read", "kept", (F.col("read") - F.col("kept")).alias("skipped"))


def annotation_tasks(df: DataFrame) -> DataFrame:
    """(value): records as the JSON an annotation tool imports, one object with ``data`` a line."""
    data = F.struct("sentence_id", "text", "platform", "source_url", iso("collected_at").alias("collected_at"))
    return df.select(F.to_json(F.struct(data.alias("data"))).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    """(sentence_id, json): each annotated record as one JSON object, times as text."""
    return df.select("sentence_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("json"))


def template_records(spark: SparkSession, n: int, templates: list[str], words: list[str], step: int = 3) -> DataFrame:
    """``n`` records from templates with {w1} and {w2}: template i mod t, words i mod w and (i + step) mod w, platforms in
    turn; for dry runs and tests."""
    t, w = F.array(*map(F.lit, templates)), F.array(*map(F.lit, words))
    pick = lambda a, i: F.get(a, i.cast("int"))
    i = F.col("id")
    text = F.replace(F.replace(pick(t, i % len(templates)), F.lit("{w1}"), pick(w, i % len(words))), F.lit("{w2}"), pick(w, (i + step) % len(words)))
    return spark.range(n).select(i.alias("seq"), F.format_string("fixture-%05d", i).alias("sentence_id"), text.alias("text"), F.lit("").alias("source_url"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("collected_at"), F.when(i % 2 == 0, "twitter").otherwise("sharechat").alias("platform"))


def publish(paths: list[str], gate: DataFrame, upload, attempts: int = 3, sleep=None) -> list[str]:
    """Hand each path to ``upload`` (retried) if every task of ``gate`` passed; returns what was uploaded."""
    from corpuskit.operators.training import retried

    if gate.isEmpty() or not gate.where("not passed").isEmpty():
        return []
    for p in paths:
        retried(lambda p=p: upload(p), attempts, **({"sleep": sleep} if sleep else {}))
    return list(paths)
