"""Streams routed into folders exactly once: a ledger names the batches that count."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _entry(path: str, batch_id: int) -> str:
    return f"{path}/_ledger/{batch_id:019d}.json"


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in the ledger, in order."""
    where, store = _store(spark, f"{path}/_ledger")
    if not store.exists(where):
        return []
    return sorted(int(s.getPath().getName().split(".")[0]) for s in store.listStatus(where) if s.getPath().getName().endswith(".json"))


def commit_routed(batch: DataFrame, batch_id: int, path: str, route: Column) -> bool:
    """Write a batch's rows into a folder for each route, and the batch into the ledger; whether it was new.

    A batch that the ledger has changes nothing.  One that was cut off before its
    entry was made is written again over what it left: its folder bears its
    number.  The entry is made under another name and renamed, and holds the
    number of rows of each route.
    """
    spark = batch.sparkSession
    entry, store = _store(spark, _entry(path, batch_id))
    if store.exists(entry):
        return False
    folder = f"{path}/batch={batch_id}"
    batch.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(folder)
    counts = {r["route"]: r["n"] for r in spark.read.schema(f"{batch.schema.toDDL()}, route string").parquet(folder).groupBy("route").agg(F.count("*").alias("n")).collect()}
    half, _ = _store(spark, _entry(path, batch_id) + ".part")
    out = store.create(half, True)
    out.write(bytearray(json.dumps(counts, sort_keys=True).encode()))
    out.close()
    if not store.rename(half, entry):
        raise OSError(f"{entry} can't be made")
    return True


def route_stream(stream: DataFrame, path: str, checkpoint: str, route: Column):
    """A writer (``start()`` it) that routes each batch of a stream once, also if the stream restarts and repeats a batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: commit_routed(batch, batch_id, path, route) and None)


def routed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches in the ledger, with ``batch`` and ``route``; others are not read."""
    found = [f"{path}/batch={n}" for n in committed(spark, path)]
    full = f"{schema}, route string, batch long"
    if not found:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*found)
