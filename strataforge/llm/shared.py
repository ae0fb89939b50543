"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent and all tasks run on this machine, as in
    local tests, a temporary folder is chosen and recorded on the session; on a
    cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.strataforge.shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.strataforge.shared", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Recovery from a lost executor then starts from the table, never from a
    block that only one executor holds.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataforge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it."""
    path = getattr(df, "_strataforge_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches hold few whole texts, unless the user has chosen a size: they are held in memory at both ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that may be broadcast; a hashed table of so many takes about 64 MB.
BROADCAST_IDS = 2_000_000


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is (or, for ``left_anti``, is not) in ``ids``.

    The ids are counted first.  Up to ``most`` of them go to every executor, and
    the texts stay where they are; beyond that both sides are shuffled.
    """
    ids = materialize(ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", how)


def text_key() -> Column:
    """What tells texts apart, besides their ids."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without_rows(docs: DataFrame, rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the rows whose id (null is one, too) and text are in ``rows`` (``doc_id``, ``text_key``).

    Other rows that only share an id stay.  The rows are broadcast up to ``most``.
    """
    gone = materialize(rows.select(F.col("doc_id").alias("strataforge_doc"), F.col("text_key").alias("strataforge_key")).distinct(), "rows")
    small = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(small, F.col("doc_id").cast("long").eqNullSafe(F.col("strataforge_doc")) & (text_key() == F.col("strataforge_key")), "left_anti")
