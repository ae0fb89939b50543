"""Sinks: JSON lines, CSV and TSV, routed outputs, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tab-separated; tabs inside texts become spaces."""
    flat = [F.regexp_replace(c, "\t", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(flat).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def routed(df: DataFrame, path: str, route: Column) -> None:
    """One pass, one folder for each route."""
    df.withColumn("route", route).write.mode("overwrite").partitionBy("route").json(path)


def manifest(df: DataFrame, counts: dict[str, Column]) -> str:
    """Counts of one pass as JSON text."""
    row = df.agg(*(c.alias(n) for n, c in counts.items())).first()
    return json.dumps(row.asDict(), sort_keys=True)


def markdown(report: DataFrame, order: list[str], most: int = 10_000) -> str:
    """A report as a Markdown table, rows in order.  A table of more than ``most`` rows is no report and raises."""
    rows = report.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [report.columns, ["---"] * len(report.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file, by way of a second name that takes the place of the first in one step: readers find the old text or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end, half = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = half.getFileSystem(conf).create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(half.getFileSystem(conf).getUri(), conf)
    files.rename(half, end, over)
