"""Control around training: early stopping as a fold, retries, and seeds."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def early_stopping(scores: str | Column, patience: int = 3) -> Column:
    """struct<best_epoch, best, epochs>: training over an array of scores by epoch stops when ``patience`` epochs in a row
    bring no better one. Epochs count from 1; without scores all are 0. Nulls are no improvement."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    zero = F.struct(F.lit(0).alias("epoch"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        better = F.coalesce(x > acc["best"], F.lit(False))
        go = F.struct((acc["epoch"] + 1).alias("epoch"), F.when(better, x).otherwise(acc["best"]).alias("best"), F.when(better, acc["epoch"] + 1).otherwise(acc["best_epoch"]).alias("best_epoch"), F.when(better, 0).otherwise(acc["bad"] + 1).alias("bad"))
        return F.when(acc["bad"] >= patience, acc).otherwise(go)

    return F.aggregate(scores, zero, step, lambda a: F.struct(a["best_epoch"].alias("best_epoch"), F.when(a["best_epoch"] > 0, a["best"]).otherwise(0.0).alias("best"), a["epoch"].alias("epochs")))


def training_log(scores: DataFrame, patience: int = 3, most: int = 10) -> DataFrame:
    """(task, best_epoch, best_f1, epochs) for models whose score is the same each epoch: ``scores`` has task, macro_f1."""
    log = early_stopping(F.array_repeat("macro_f1", most), patience)
    return scores.select("task", log.alias("l")).select("task", "l.best_epoch", F.col("l.best").alias("best_f1"), "l.epochs")


def retried(call: Callable[[], object], attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The value of ``call``, tried again after base, 2 base, 4 base ... seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base * 2**k)
    raise ValueError("at least one attempt is needed")


def set_seeds(seed: int = 42) -> int:
    """Seed Python's and numpy's generators on the driver. Draws over frames take their seed as an argument."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)
    return seed
