"""Problem 9: mix sources to target shares of the tokens.

Method: low-discrepancy source schedule. Slot i draws the golden-ratio point frac((i + 1/2) phi), which the cumulative
weights of the sources' feasible shares map to a source by binary search; slots are ranked within their source. A
source's documents, shuffled by a keyed hash, are one stream of tokens that is cut into blocks of ``BLOCK`` tokens; a
document may go on in the next block. The k-th slot of a source takes block k modulo its blocks, at most ``max_repeats``
times round, so every slot but the last block of a source adds the same number of tokens.

A source gives its target share of the tokens of all, or what it has with its repeats; what exhausted sources leave is
handed on in proportion to the targets as far as others have it, and reported as unmet by source.

Ranks and running sums are made in two levels (totals of chunks, then within a chunk of about ``CHUNK`` documents), so a
source that holds a third of all documents is never one task. The table of targets is small, one row a source.

Cases: null or empty texts have no tokens and are in no block; sources without documents report zero; documents of other
sources take no part; repeated doc_ids are separate documents; a source named twice in the targets is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.session import cut
from corpuskit.llm.bpe import count_tokens
from corpuskit.llm.quota import feasible

PHI = 0.6180339887498949
BLOCK, CHUNK = 1024, 50_000
MOST_SOURCES = 10_000


def counted(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the sources, written once."""
    own = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return cut(count_tokens(own.select("doc_id", "source", "text")))


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """A dict a source: own tokens, wanted tokens, blocks, slots by feasible quotas, and whether it is exhausted."""
    rows = targets.orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError("the targets must name each source once, and few")
    own = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(own.values())
    out = [{"source": r.source, "target_share": r.target_share, "max_repeats": r.max_repeats, "own": own.get(r.source, 0), "wanted": r.target_share * total} for r in rows]
    for p in out:
        p["exhausted"] = p["wanted"] > p["max_repeats"] * p["own"]
        p["blocks"] = -(-p["own"] // BLOCK)
        p["most"] = p["max_repeats"] * p["own"]
    quota = feasible(round(sum(p["wanted"] for p in out)), [p["wanted"] for p in out], [0] * len(out), [p["most"] for p in out])
    for p, q in zip(out, quota):
        p["quota"] = q
        rounds, rest = divmod(q, p["own"]) if p["own"] else (0, 0)
        p["slots"] = rounds * p["blocks"] + min(p["blocks"], round(rest / BLOCK))
    return out


def _schedule(it: Iterator[pa.RecordBatch], upper: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in it:
        i = b.column("id").to_numpy()
        at = np.searchsorted(upper, (i + 0.5) * PHI % 1.0, side="right")
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.minimum(at, len(upper) - 1).astype(np.int32))], names=["id", "place"])


def slots(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(source, slot, block, repeat): the schedule of all sources."""
    live = [p for p in sources if p["slots"] > 0]
    schema = "source string, slot bigint, block bigint, repeat int"
    if not live:
        return spark.createDataFrame([], schema)
    total = sum(p["slots"] for p in live)
    weights = np.array([p["slots"] / total for p in live])
    upper = np.cumsum(weights)
    # enough points for the rarest source too: counts differ from their share by a multiple of log n at most
    n = total + ceil(8 * (log(total + 2) + 1) / weights.min())
    s = spark.range(n).mapInArrow(lambda it: _schedule(it, upper), "id bigint, place int").withColumn("part", F.expr("id div 65536"))
    tops = s.groupBy("place", "part").agg(F.count("*").alias("c"))
    tops = tops.withColumn("first", F.sum("c").over(Window.partitionBy("place").orderBy("part")) - F.col("c")).drop("c")
    k = F.col("first") + F.row_number().over(Window.partitionBy("place", "part").orderBy("id")) - 1
    s = s.join(tops, ["place", "part"]).withColumn("k", k)
    own = spark.createDataFrame([(i, p["source"], p["slots"], p["blocks"]) for i, p in enumerate(live)], "place int, source string, slots bigint, blocks bigint")
    s = s.join(F.broadcast(own), "place").where("k < slots")
    return s.select("source", F.col("id").alias("slot"), (F.col("k") % F.col("blocks")).alias("block"), F.expr("cast(k div blocks as int)").alias("repeat"))


def block_pieces(sizes: DataFrame) -> DataFrame:
    """(source, block, doc_id, from_token, tokens): the stream of each source's shuffled documents, cut into blocks."""
    chunks = max(1, sizes.count() // CHUNK)
    h = F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string")))
    d = sizes.where("n_tokens > 0").withColumn("h", h).withColumn("chunk", F.expr(f"cast(conv(substring(h, 1, 12), 16, 10) as bigint) * {chunks} div {1 << 48}"))
    per = d.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("t"))
    per = per.select("source", "chunk", (F.sum("t").over(Window.partitionBy("source").orderBy("chunk")) - F.col("t")).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    d = d.join(per, ["source", "chunk"]).withColumn("start", F.col("base") + before).withColumn("end", F.col("start") + F.col("n_tokens"))
    d = d.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))))
    a = F.greatest(F.col("start"), F.col("block") * BLOCK)
    return d.select("source", "block", "doc_id", (a - F.col("start")).alias("from_token"), (F.least(F.col("end"), (F.col("block") + 1) * BLOCK) - a).alias("tokens"))


def mixture(sizes: DataFrame, sources: list[dict]) -> DataFrame:
    """(source, slot, repeat, doc_id, from_token, tokens): in slot order the parts of documents of the mixture. Both sides
    are spread by (source, block), so a large source is many keys."""
    return slots(sizes.sparkSession, sources).join(block_pieces(sizes), ["source", "block"]).select("source", "slot", "repeat", "doc_id", "from_token", "tokens")


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    targets = s.read.parquet(f"{d}/mix_targets.parquet")
    sizes = counted(s.read.parquet(f"{d}/documents.parquet"), targets)
    return sizes, plan(sizes, targets)


def report(sizes: DataFrame, sources: list[dict]) -> DataFrame:
    """(source, target_share, actual_share, own, wanted, used, repeats, unmet, exhausted)."""
    spark = sizes.sparkSession
    used = mixture(sizes, sources).groupBy("source").agg(F.sum("tokens").alias("used"), (F.max("repeat") + 1).alias("repeats"))
    q = spark.createDataFrame([(p["source"], p["target_share"], p["own"], p["wanted"], p["exhausted"]) for p in sources], "source string, target_share double, own long, wanted double, exhausted boolean")
    r = q.join(F.broadcast(used), "source", "left").fillna(0, ["used", "repeats"])
    share = F.coalesce(F.try_divide("used", F.sum("used").over(Window.partitionBy())), F.lit(0.0))
    return r.select("source", "target_share", share.alias("actual_share"), "own", "wanted", "used", "repeats", F.greatest(F.lit(0.0), F.col("wanted") - F.col("used")).alias("unmet"), "exhausted")


def p9_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixture(*_parts(s, d))


def p9_report(s: SparkSession, d: str) -> DataFrame:
    return report(*_parts(s, d))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return p9_report(s, d).where("exhausted").select("source")
