"""Problem 5: a sample whose shares by category follow targets.

Method: mergeable per-category reservoirs in one pass. Each task keeps, of every category, the rows of least priority (a
keyed hash of the row's key), at most as many as the category could be asked for, and counts what it saw; reservoirs of
tasks merge by union and counts by sum, and are written once. After the final counts the quotas are made feasible: each
category within its minimum and its rows, what exhausted categories leave handed on in proportion to the targets. Then
every category is trimmed uniformly, that is to its least priorities: whole bins of priority below the threshold bin
stay, and only rows of the threshold bin are ranked, so no task ever holds a category.

The most a category can be asked for is the sample's size by the table's row count, which the files' footers tell.

Cases: null platform or sentiment belongs to no cell; a repeated key counts once, with the least (platform, sentiment) if
its rows differ; ties of priority break by the key; cells outside the targets count for the total and are not drawn; an
empty table gives an empty sample and a report of zeros; other columns are ignored; a target cell named twice is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.session import cut
from corpuskit.llm.quota import feasible

#: Bins of priority; a hundred rows or so of a category of half a million are ranked at its edge.
BINS = 4096
#: A table of targets is small: one row a cell.
MOST_CELLS = 10_000

_RESERVOIR = "platform string, sentiment string, sentence_id string, priority bigint, seen bigint"


def members(rows: DataFrame) -> DataFrame:
    """(sentence_id, platform, sentiment), each key once."""
    m = rows.select("sentence_id", F.lower(F.trim("platform")).alias("platform"), "sentiment")
    m = m.where("sentence_id is not null and platform is not null and sentiment is not null")
    m = m.groupBy("sentence_id").agg(F.min(F.struct("platform", "sentiment")).alias("c"))
    return m.select("sentence_id", "c.platform", "c.sentiment")


def _keep(it: Iterator[pa.RecordBatch], most: dict[tuple[str, str], int], seed: int) -> Iterator[pa.RecordBatch]:
    """The task's reservoirs: rows of least priority of each target cell, and a row without a key with the count."""
    kept: dict[tuple[str, str], tuple[list, list]] = {}
    seen: dict[tuple[str, str], int] = {}

    def trim(cell: tuple[str, str]) -> None:
        p, k = kept[cell]
        if len(p) > most[cell]:
            order = sorted(range(len(p)), key=lambda i: (p[i], k[i]))[: most[cell]]
            kept[cell] = [p[i] for i in order], [k[i] for i in order]

    for b in it:
        for key, platform, sentiment in zip(*(b.column(c).to_pylist() for c in ("sentence_id", "platform", "sentiment"))):
            cell = platform, sentiment
            seen[cell] = seen.get(cell, 0) + 1
            if cell in most:
                p, k = kept.setdefault(cell, ([], []))
                p.append(int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:15], 16))
                k.append(key)
                if len(p) > 2 * most[cell] + 1024:
                    trim(cell)
    rows: list[tuple] = [(*cell, None, None, n) for cell, n in seen.items()]
    for cell in list(kept):
        trim(cell)
        rows += [(*cell, k, p, None) for p, k in zip(*kept[cell])]
    for at in range(0, len(rows), 50_000):
        cols = list(zip(*rows[at : at + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["platform", "sentiment", "sentence_id", "priority", "seen"])


def reservoirs(rows: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sample (sentence_id, platform, sentiment) and the report (platform, sentiment, target_share, rows, wanted,
    quota, taken, actual_share, unmet, exhausted)."""
    spark = rows.sparkSession
    cells = {(t.platform, t.sentiment): t for t in targets.limit(MOST_CELLS + 1).collect()}
    if len(cells) > MOST_CELLS:
        raise ValueError("too many target cells")
    part = max((t.sample_fraction for t in cells.values()), default=0.0)
    size = rows.count()
    most = {c: max(t.min_rows, ceil(part * size)) for c, t in cells.items()}
    kept = cut(members(rows).mapInArrow(lambda it: _keep(it, most, seed), _RESERVOIR))
    seen = {(r.platform, r.sentiment): r.n for r in kept.where("seen is not null").groupBy("platform", "sentiment").agg(F.sum("seen").alias("n")).collect()}
    total, order = sum(seen.values()), sorted(cells)
    have = [seen.get(c, 0) for c in order]
    wanted = [cells[c].target_share * cells[c].sample_fraction * total for c in order]
    quota = feasible(round(sum(wanted)), wanted, [cells[c].min_rows for c in order], have)
    q = spark.createDataFrame([(*c, cells[c].target_share, h, w, n, w > h) for c, h, w, n in zip(order, have, wanted, quota)], "platform string, sentiment string, target_share double, rows long, wanted double, quota long, exhausted boolean")
    sample = trimmed(kept.where("seen is null").drop("seen"), q.select("platform", "sentiment", "quota"))
    taken = sample.groupBy("platform", "sentiment").agg(F.count("*").alias("taken"))
    all_ = F.sum("taken").over(Window.partitionBy())
    report = q.join(F.broadcast(taken), ["platform", "sentiment"], "left").fillna(0, ["taken"])
    report = report.select("platform", "sentiment", "target_share", "rows", "wanted", "quota", "taken", F.coalesce(F.try_divide("taken", all_), F.lit(0.0)).alias("actual_share"), F.greatest(F.lit(0.0), F.col("wanted") - F.col("taken")).alias("unmet"), "exhausted")
    return sample, report


def trimmed(kept: DataFrame, quota: DataFrame) -> DataFrame:
    """The rows of least priority of each cell, ``quota`` of them."""
    cell = ["platform", "sentiment"]
    width = (1 << 60) // BINS
    k = kept.withColumn("bin", F.expr(f"priority div {width}"))
    hist = k.groupBy(*cell, "bin").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*cell).orderBy("bin")) - F.col("n")
    edge = hist.withColumn("below", below).join(F.broadcast(quota), cell).where("below < quota and below + n >= quota").select(*cell, F.col("bin").alias("edge"), (F.col("quota") - F.col("below")).alias("take"))
    whole = quota.where("quota > 0").join(F.broadcast(edge), cell, "left").withColumn("edge", F.coalesce("edge", F.lit(BINS + 1))).drop("quota")
    got = k.join(F.broadcast(whole), cell).where("bin <= edge")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("priority", "sentence_id"))
    last = got.where("bin = edge").withColumn("r", rank).where("r <= take").drop("r")
    return got.where("bin < edge").unionByName(last).select("sentence_id", *cell)


def _tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return s.read.parquet(f"{d}/annotated_sentences.parquet"), s.read.parquet(f"{d}/sample_targets.parquet")


def p5_sample(s: SparkSession, d: str) -> DataFrame:
    return reservoirs(*_tables(s, d))[0]


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return reservoirs(*_tables(s, d))[1]


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return p5_report(s, d).where("exhausted").select("platform", "sentiment")


_A = "a AS (SELECT DISTINCT sentence_id, lower(trim(platform)) AS platform, sentiment FROM annotated_sentences WHERE platform IS NOT NULL AND sentiment IS NOT NULL)"
#: Quotas in closed form: between two neighbouring values of x at which a cell meets its floor or capacity, the sum of
#: the cells is a line in x.
_QUOTAS = f"""{_A}, c AS (SELECT platform, sentiment, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT row_number() OVER (ORDER BY t.platform, t.sentiment) AS i, t.platform, t.sentiment, target_share, coalesce(n, 0) AS cap, least(min_rows, coalesce(n, 0)) AS flo, target_share * sample_fraction * (SELECT count(*) FROM a) AS w FROM sample_targets t LEFT JOIN c USING (platform, sentiment)),
g AS (SELECT least(greatest(round(sum(w)), sum(flo)), sum(cap)) AS goal FROM t),
x AS (SELECT 0.0::DOUBLE AS x UNION SELECT cap / w FROM t WHERE w > 0 UNION SELECT flo / w FROM t WHERE w > 0),
f AS (SELECT x, sum(least(greatest(x * w, flo), cap)) AS s FROM x, t GROUP BY x),
b AS (SELECT x AS x0, s AS s0, lead(x) OVER (ORDER BY x) AS x1, lead(s) OVER (ORDER BY x) AS s1 FROM f),
l AS (SELECT coalesce((SELECT min(x0 + CASE WHEN s1 > s0 THEN (goal - s0) / (s1 - s0) * (x1 - x0) ELSE 0 END) FROM b, g WHERE s0 <= goal AND s1 >= goal), (SELECT max(x) FROM x)) AS x),
r AS (SELECT t.*, least(greatest(l.x * w, flo), cap) AS real FROM t, l), o AS (SELECT *, least(greatest(floor(real + 1e-9), flo), cap) AS base FROM r),
q AS (SELECT *, base + CASE WHEN base < cap AND w > 0 AND row_number() OVER (PARTITION BY base < cap AND w > 0 ORDER BY round(base - real, 9), i) <= (SELECT goal FROM g) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM o)"""

SQL = {
    "p5_sample": f"WITH {_QUOTAS} SELECT sentence_id, platform, sentiment FROM a JOIN q USING (platform, sentiment) QUALIFY row_number() OVER (PARTITION BY platform, sentiment ORDER BY substr(md5('42|' || sentence_id), 1, 15), sentence_id) <= quota",
    "p5_report": f"WITH {_QUOTAS} SELECT platform, sentiment, target_share, cap AS rows, w AS wanted, quota::BIGINT AS quota, quota::BIGINT AS taken, (quota / sum(quota) OVER ())::DOUBLE AS actual_share, greatest(0.0, w - quota)::DOUBLE AS unmet, w > cap AS exhausted FROM q",
    "p5_found": "WITH a AS (SELECT DISTINCT sentence_id, lower(trim(platform)) p, sentiment s FROM annotated_sentences WHERE platform IS NOT NULL AND sentiment IS NOT NULL), c AS (SELECT p, s, count(*) n FROM a GROUP BY ALL) SELECT t.platform, t.sentiment FROM sample_targets t LEFT JOIN c ON t.platform = p AND t.sentiment = s WHERE target_share * sample_fraction * (SELECT count(*) FROM a) > coalesce(n, 0)",
}
