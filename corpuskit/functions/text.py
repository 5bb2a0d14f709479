"""Text expressions, all columns to columns. Null gives null unless stated; texts are never shortened.

White space is what Unicode calls white space and U+001C to U+001F; places count code points from 0.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f]"


@F.arrow_udf(StringType())
def _nfc(x: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in x.to_pylist()], pa.string())


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once a row; inside lambdas an expression would be computed at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def nfc(c: str | Column) -> Column:
    """Canonical composition. Spark has no such function; batches go through Arrow."""
    return _nfc(F.col(c) if isinstance(c, str) else c)


def strip(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def tokens(c: str | Column) -> Column:
    """White-space tokens, none for a blank text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda t: t != "")


def token_places(text: str | Column) -> Column:
    """array<struct<token, start, end>>: each token found from the end of the one before."""
    text = F.col(text) if isinstance(text, str) else text
    kind = "array<struct<token:string,start:int,end:int>>"

    # one pass: the parts between tokens are as long as the white space there
    gaps = F.split(text, rf"(?U)[^\s\x1c-\x1f]+")
    toks = tokens(text)
    pairs = F.zip_with(toks, F.slice(gaps, F.lit(1), F.size(toks)), lambda t, g: F.struct(t.alias("t"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    return F.aggregate(
        pairs,
        start,
        lambda acc, p: F.struct(
            (acc["pos"] + p["g"] + F.length(p["t"])).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(p["t"].alias("token"), (acc["pos"] + p["g"]).alias("start"), (acc["pos"] + p["g"] + F.length(p["t"])).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def cut_text(text: str | Column, start: Column, end: Column) -> Column:
    """``text[start:end]``; a negative place counts from the end, as in a Python slice."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)

    def place(x: Column) -> Column:
        return F.when(x < 0, F.greatest(F.lit(0), n + x)).otherwise(F.least(x, n))

    a, b = place(start), place(end)
    return F.when(b > a, F.substring(text, a + 1, b - a)).otherwise(F.when(text.isNotNull() & start.isNotNull() & end.isNotNull(), ""))


def shingles(c: str | Column, k: int = 3) -> Column:
    """Distinct groups of ``k`` characters; none for shorter texts."""
    c = F.col(c) if isinstance(c, str) else c
    chars = F.split(c, "")
    groups = chars
    for i in range(1, k):
        rest = F.slice(chars, F.lit(i + 1), F.greatest(F.length(c) - i, F.lit(0)))
        groups = F.zip_with(groups, rest, lambda a, b: F.concat(a, b))
    return F.when(c.isNull(), None).when(F.length(c) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(groups, lambda g: g.isNotNull())))


def script(c: str | Column) -> Column:
    """devanagari, latin or other by the greater number of letters; devanagari if equal, other if none."""
    c = F.col(c) if isinstance(c, str) else c
    dev, lat = F.regexp_count(c, F.lit("[ऀ-ॿ]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(c.isNull(), None).when((dev == 0) & (lat == 0), "other").when(dev >= lat, "devanagari").otherwise("latin")


def iso(ts: str | Column) -> Column:
    """UTC with seconds, as text; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(c: str | Column) -> Column:
    """ISO text to a timestamp, any offset; null and empty give 1970. Text without an offset is UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_timestamp(F.nullif(c, F.lit(""))), F.timestamp_seconds(F.lit(0)))


#: The platforms that manual files may name, and the platforms records are kept under.
MANUAL_PLATFORMS = ("twitter", "facebook", "whatsapp", "sharechat", "news", "other")
PLATFORMS = ("twitter", "sharechat")


def named_platform(c: str | Column) -> Column:
    """Stripped and in lower case; null, empty and unknown names give other."""
    p = F.lower(strip(c))
    return F.when(p.isin(*MANUAL_PLATFORMS), p).otherwise("other")


def kept_platform(named: Column) -> Column:
    return F.when(named == "sharechat", "sharechat").otherwise("twitter")


def export_platform(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*PLATFORMS), c).otherwise("twitter")


def platform_of(c: str | Column = "platform") -> Column:
    """The platform as the tables spell it: trimmed, in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
