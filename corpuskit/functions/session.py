"""Session helpers: lineage cuts in the shared folder, and the package path for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers on hosts that share this path import the package (elsewhere: spark-submit --py-files)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a folder of our own, removed at the end, serves a
    driver that runs its tasks itself; executors on other machines could not read that, so there it is an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there, so that the plan before it never runs
    again and a lost executor takes nothing along. Tables of an application lie in one folder, see ``release``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpuskit-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote in this application; frames that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/corpuskit-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
