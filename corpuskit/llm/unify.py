"""Problem 7: bring text that looks alike to one consistent form.

Method: DuckDB runs inside Arrow partitions (``mapInArrow``); one embedded SQL statement per batch maps full-width
forms and special spaces (``translate``), drops invisible characters outside emoji sequences and writes split vowels as
one letter (regular expressions and ``replace``), writes ligatures as letters, turns look-alike letters of Latin words
into Latin ones, and composes with ``nfc_normalize``. Emoji sequences, fractions and powers stay as they are. A word that
has no Latin letter is Latin only if all its letters are close look-alikes and nothing else in the text is of their
script; a word of another script stays.

Cases: null text gives null and is no finding; empty text stays empty; repeated rows are kept by ``unify`` and count
once in ``p7_found``; an empty table gives an empty result; other columns pass through untouched, also one that is
already called ``plain_text`` (the new column then takes its place).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.canon import INVISIBLE, LIGATURES, LOOKALIKES, LOOSE, SPACES, VOWELS


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def form_sql(column: str = "text") -> str:
    """The SQL expression of the consistent form, in nested steps over ``src(i, column)``."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    thin = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)).replace("'", "''")
    look, like = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
    joined = r"(\p{So}[\x{fe0f}\x{1f3fb}-\x{1f3ff}]*)\x{200d}(\p{So})"
    styled = r"(\p{So}|[0-9#*])\x{fe0f}"
    vowels = "s3"
    for k, v in VOWELS.items():
        vowels = f"replace({vowels}, '{k}', '{v}')"
    fused = f"translate(replace(replace(t, chr(64976), ''), chr(64977), ''), '{wide + SPACES}', '{thin + ' ' * len(SPACES)}')"
    for k, v in LIGATURES.items():
        fused = f"replace({fused}, '{k}', '{v}')"
    close = rf"regexp_matches(w, '\p{{Latin}}') OR (NOT regexp_matches(w, '[{_class(LOOSE)}]') AND NOT alien)"
    suspect = "[" + _class(SPACES + INVISIBLE + look + "".join(LIGATURES)) + r"\x{200d}\x{fe00}-\x{fe0f}\x{ff01}-\x{ff5e}]|[अआएउ]\p{M}"
    return f"""
WITH a AS (SELECT i, {column} AS t, regexp_matches({column}, '{suspect}') AS odd FROM src),
b AS (SELECT i, t, odd, CASE WHEN odd THEN {fused} ELSE t END AS s1 FROM a),
c AS (SELECT i, t, odd, CASE WHEN odd AND regexp_matches(s1, '[\\x{{200d}}\\x{{fe00}}-\\x{{fe0f}}]') THEN
  replace(replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(s1, '{joined}', '\\1' || chr(64976) || '\\2', 'g'), '{joined}', '\\1' || chr(64976) || '\\2', 'g'),
    '{styled}', '\\1' || chr(64977), 'g'),
    '[\\x{{200d}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g'), chr(64976), chr(8205)), chr(64977), chr(65039)) ELSE s1 END AS s2 FROM b),
d AS (SELECT i, t, odd, CASE WHEN odd THEN regexp_replace(s2, '[{_class(INVISIBLE)}]', '', 'g') ELSE s2 END AS s3 FROM c),
e AS (SELECT i, t, CASE WHEN odd THEN {vowels} ELSE s3 END AS s4, regexp_matches(regexp_replace(t, '[{_class(look)}]', '', 'g'), '[\\p{{Cyrillic}}\\p{{Greek}}]') AS alien FROM d),
f AS (SELECT i, t, CASE WHEN regexp_matches(s4, '[{_class(look)}]') THEN
  array_to_string(list_transform(regexp_extract_all(s4, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
    lambda w: CASE WHEN regexp_full_match(w, '[\\p{{Latin}}\\p{{M}}{_class(look)}]+') AND ({close}) THEN translate(w, '{look}', '{like}') ELSE w END), '') ELSE s4 END AS s5 FROM e)
SELECT i, nfc_normalize(s5) AS plain_text FROM f ORDER BY i"""


def _batches(it: Iterator[pa.RecordBatch], column: str, only_changed: bool) -> Iterator[pa.RecordBatch]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
        yield from _formed(con, it, column, only_changed)


def _formed(con, it: Iterator[pa.RecordBatch], column: str, only_changed: bool) -> Iterator[pa.RecordBatch]:
    sql = form_sql()
    for batch in it:
        if not batch.num_rows:
            continue
        src = pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column(column).cast(pa.string())})
        con.register("src", src)
        out = con.sql(sql).to_arrow_table().column("plain_text").combine_chunks()
        con.unregister("src")
        out = (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out).cast(pa.string())
        names = batch.schema.names
        if only_changed:
            import pyarrow.compute as pc

            keep = pc.fill_null(pc.not_equal(src.column("text"), out), False)
            cut = pa.table(dict(zip(names, batch.columns))).drop_columns([column]).filter(keep)
            yield from cut.to_batches()
        else:
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, "plain_text"])


def unify(df: DataFrame, column: str = "text") -> DataFrame:
    """All rows and columns, with ``plain_text``, the consistent form of ``column``."""
    df = df.drop("plain_text")
    schema = T.StructType([*df.schema.fields, T.StructField("plain_text", T.StringType())])
    return df.mapInArrow(lambda it: _batches(it, column, False), schema)


def odd_records(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The keys of records whose text is not in its consistent form, each once; texts never leave the map stage."""
    narrow = df.select(F.col(key).alias("key"), F.col(column).alias("text")).where(F.col("text").isNotNull())
    return narrow.mapInArrow(lambda it: _batches(it, "text", True), "key string").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tbl in ("raw_sentences", "annotated_sentences"):
        found = odd_records(spark.read.parquet(f"{sf_dir}/{tbl}.parquet"), "sentence_id")
        parts.append(found.select(F.lit(tbl).alias("tbl"), F.col("key").alias("sentence_id")))
    return parts[0].unionByName(parts[1])


def oracle_sql(only_changed: bool) -> str:
    """The same form over whole tables."""
    src = " UNION ALL ".join(f"SELECT '{t}' AS tbl, sentence_id, text FROM {t}" for t in ("raw_sentences", "annotated_sentences"))
    head = f"WITH s AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM ({src})), src AS (SELECT i, text FROM s), p AS ({form_sql()}) "
    if only_changed:
        return head + "SELECT DISTINCT tbl, sentence_id FROM s JOIN p USING (i) WHERE plain_text <> text"
    return head + "SELECT tbl, sentence_id, plain_text FROM s JOIN p USING (i)"


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in its consistent form."""
    parts = []
    for tbl in ("raw_sentences", "annotated_sentences"):
        src = spark.read.parquet(f"{sf_dir}/{tbl}.parquet").select("sentence_id", "text")
        parts.append(unify(src).select(F.lit(tbl).alias("tbl"), "sentence_id", "plain_text"))
    return parts[0].unionByName(parts[1])


SQL = {"p7_found": oracle_sql(True), "p7_forms": oracle_sql(False)}
