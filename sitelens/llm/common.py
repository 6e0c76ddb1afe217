"""Shared pieces: the shared scratch folder, materialising, table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none (tests on one machine) is a local one set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder, and executors on other machines need a shared one")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sitelens/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table, which survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and a Python worker; texts are wide, and the default is for narrow rows.
BATCH_BYTES = 4 << 20


def wide(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, "64m") not in ("4m", str(BATCH_BYTES), f"{BATCH_BYTES}b"):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df
