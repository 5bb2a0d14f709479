"""Filters over records. All keep the columns of the frame they are given."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import export_platform, kept_platform, named_platform, nfc, platform_of, strip, tokens

#: Lexicons up to this many words are part of the expression, larger ones are joined.
INLINE = 1_000


def lexicon_tokens(text: str = "text") -> Column:
    return tokens(nfc(F.lower(F.col(text))))


def lexicon_frame(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word): the lines of a lexicon file, stripped, in lower case, composed and each once; blank lines and those that
    begin with # are left out."""
    w = lines.select(strip(column).alias("word")).where("word <> '' and not startswith(word, '#')")
    return w.select(nfc(F.lower("word")).alias("word")).distinct()


def lexicon_hits(df: DataFrame, lexicon: Iterable[str], text: str = "text") -> Column:
    """Tokens of the text, repeated ones too, that are words of a lexicon of at most ``INLINE`` words."""
    words = sorted(set(lexicon))
    if not words:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(lexicon_tokens(text), lambda t: t.isin(*words))), F.lit(0))


def lexicon_filter(df: DataFrame, lexicon: Iterable[str] | DataFrame, least: int = 2, text: str = "text", key: str = "seq") -> DataFrame:
    """Rows with at least ``least`` tokens in the lexicon; null texts have none. A lexicon given as a frame (word) is
    joined to the tokens, which takes a unique ``key``."""
    if not isinstance(lexicon, DataFrame):
        words = set(lexicon)
        if len(words) <= INLINE:
            return df.where(lexicon_hits(df, words, text) >= least)
        lexicon = df.sparkSession.createDataFrame([(w,) for w in sorted(words)], "word string")
    if least < 1:
        return df
    hit = df.select(key, F.explode(lexicon_tokens(text)).alias("word")).join(lexicon, "word", "left_semi")
    enough = hit.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(enough, key, "left_semi")


def manual_records(df: DataFrame, least: int = 10) -> DataFrame:
    """Manual records as they are kept: text stripped and composed, shorter ones dropped, platform mapped to the kept
    two, a missing address written ``manual://platform``. Columns text, source_url and platform may be null."""
    named = named_platform("platform")
    d = df.withColumn("text", nfc(strip("text"))).where(F.length("text") >= least)
    d = d.withColumn("_named", named).withColumn("source_url", F.coalesce(F.nullif(strip("source_url"), F.lit("")), F.concat(F.lit("manual://"), F.col("_named"))))
    return d.withColumn("platform", kept_platform(F.col("_named"))).drop("_named")


def on_platform(df: DataFrame, platform: str) -> DataFrame:
    return df.where(platform_of() == platform)


def in_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def with_export_platform(df: DataFrame) -> DataFrame:
    return df.withColumn("platform", export_platform("platform"))


def split_or_start(df: DataFrame, split: str, order: str = "seq") -> DataFrame:
    """The rows of a split; where it is empty, the first max(1, rows div 10) rows in order."""
    own = in_split(df, split)
    if not own.isEmpty():
        return own
    return df.orderBy(order).limit(max(1, df.count() // 10))


def release_gate(scores: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(task, actual, target, passed) of ``scores`` (task, macro_f1); a task without a score, or with NaN, fails."""
    t = scores.sparkSession.createDataFrame(sorted(targets.items()), "task string, target double")
    a = scores.groupBy("task").agg(F.max("macro_f1").alias("actual"))
    ok = F.coalesce((F.col("actual") >= F.col("target")) & ~F.isnan("actual"), F.lit(False))
    return t.join(a, "task", "left").select("task", "actual", "target", ok.alias("passed"))
