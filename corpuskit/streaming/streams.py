"""Stream forms of core operators (an addition: collectors of posts are batch jobs). Filters, taggers and predictors are
expressions and run on streams as they are; here are the stateful ones, all with bounded state by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import nfc
from corpuskit.operators.welfare import HOURS


def exact_dedup(stream: DataFrame, at: str = "collected_at", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """The first record of each composed text within the watermark; the state holds digests, not texts."""
    d = stream.where(F.col(text).isNotNull()).withColumn("_key", F.sha2(nfc(text), 256)).withWatermark(at, delay)
    return d.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def daily_exposure(events: DataFrame, per_hour: int = 100, delay: str = "1 hour") -> DataFrame:
    """(annotator_id, day, exposure, allowed) in one-day windows of event time."""
    e = events.where("kind = 'expose'").withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", "1 day"), "annotator_id").agg(F.sum("n").cast("long").alias("exposure"))
    return g.select("annotator_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "exposure", (F.col("exposure") < HOURS * per_hour).alias("allowed"))


def platform_counts(stream: DataFrame, at: str = "collected_at", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Records by window and platform."""
    d = stream.withWatermark(at, delay)
    return d.groupBy(F.window(at, width), F.lower(F.trim("platform")).alias("platform")).agg(F.count("*").alias("n"))
