"""What operators need from the session: worker import path, shared scratch folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 2048


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of long texts small.

    A cluster that installs the package, or gets it by ``--py-files``, is unaffected by the path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="stemmata-")
    atexit.register(shutil.rmtree, at, True)
    spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Tables of one operator run, written in the shared folder so that they outlive any executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back: the lineage ends here."""
        at = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when ``rows * row_bytes`` is within ``limit``, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def without_ids(docs: DataFrame, ids: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """``docs`` but those whose key is in ``ids``; a null key stays."""
    return docs.join(small(ids.select(key), rows, 40), key, "left_anti").select(*docs.columns)
