"""A corpus cleaned in stages; each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm import near_dup, packing, quality, secret_scan, suffix_dedup
from strataforge.llm.shared import materialize

STAGES = [
    ("quality_rules", quality.keep_good),
    ("near_dedup", near_dup.keep_one_of_each),
    ("suffix_dedup", suffix_dedup.cut_repeats),
    ("secret_scan", secret_scan.redact),
    ("packing", packing.pack_corpus),
]

#: Learned rules, MinHash and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
