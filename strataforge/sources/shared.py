"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.strataforge.folder"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``).

    Where that is not set, a temporary folder is taken if all tasks run on this
    machine; on a cluster executors would not find it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as a table and read back; a lost executor is recovered from the table."""
    spark = df.sparkSession
    path = folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
