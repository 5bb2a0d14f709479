"""Counts by hash bucket as one array of fixed size: what reaches the driver is the same for every corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def _dense(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        blobs = []
        at, n = b.column("at"), b.column("n")
        for i in range(b.num_rows):
            x = np.zeros(CHUNK, np.uint16)
            x[at[i].values.to_numpy()] = np.minimum(n[i].values.to_numpy(), most)
            blobs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(blobs, pa.binary())], names=["chunk", "blob"])


def count_table(parts: DataFrame, size: int, most: int = 65535) -> np.ndarray:
    """``parts`` (bucket int, n bigint: partial counts, buckets below ``size``) added up: ``size`` numbers of two bytes,
    none above ``most``. They come to the driver in dense chunks, one a ``CHUNK`` buckets, empty ones too."""
    every = parts.sparkSession.range(-(-size // CHUNK)).select((F.col("id") * CHUNK).cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    c = parts.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("chunk", F.expr(f"bucket div {CHUNK}"))
    c = c.groupBy("chunk").agg(F.collect_list(F.struct((F.col("bucket") % CHUNK).cast("int").alias("at"), "n")).alias("c")).select("chunk", F.col("c.at").alias("at"), F.col("c.n").alias("n"))
    got = c.mapInArrow(lambda it: _dense(it, most), "chunk bigint, blob binary").toArrow()
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.uint16)
    for k, blob in zip(got.column("chunk").to_pylist(), got.column("blob").to_pylist()):
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(blob, np.uint16)
    return out[:size]
