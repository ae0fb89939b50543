"""Text and JSON files as tables, with the ways to treat lines that are broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataforge.functions.canonical import is_json, strict_variant


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """Records of JSON lines; a broken line fails the read; a missing path may count as empty."""
    if missing_ok and not any(_exists(spark, p) for p in ([path] if isinstance(path, str) else path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every non-blank line with its file, whether it is exactly one JSON value, and its value (null if not, and if a key repeats)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    return lines.withColumn("valid", is_json(F.col("line"))).withColumn("record", F.when(F.col("valid"), F.try_parse_json("line")))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def without_torn_tail(lines: DataFrame, order: str) -> DataFrame:
    """``lines`` (``file``, ``valid``) without the last line of each file if that is broken; broken lines before it stay."""
    last = lines.groupBy("file").agg(F.max_by("valid", order).alias("tail_"), F.max(order).alias("at_"))
    return lines.join(last, "file").where(f"tail_ or {order} <> at_").drop("tail_", "at_")


def numbered_lines(text: DataFrame, file: str, column: str) -> DataFrame:
    """``(file, line, record, valid)`` of the non-blank lines of whole files."""
    lines = text.select(F.col(file).alias("file"), F.posexplode(F.split(column, "\n")).alias("line", "raw")).where("trim(raw) <> ''")
    return lines.withColumn("valid", is_json(F.col("raw"))).withColumn("record", F.when(F.col("valid"), F.try_parse_json("raw"))).select("file", "line", "record", "valid")


def env_rows(text: DataFrame, file: str, column: str) -> DataFrame:
    """``(file, key, value)`` of ``KEY=VALUE`` lines: comments and lines without a key are left out, one pair of quotes is taken off, the last of a key counts."""
    lines = text.select(F.col(file).alias("file"), F.posexplode(F.split(column, "\r?\n")).alias("line", "raw"))
    key, value = F.trim(F.regexp_extract("raw", r"^([^#=]+)=(.*)$", 1)), F.trim(F.regexp_extract("raw", r"^([^#=]+)=(.*)$", 2))
    plain = F.regexp_replace(F.regexp_replace(value, r'^"(.*)"$', "$1"), r"^'(.*)'$", "$1")
    rows = lines.where(~F.trim("raw").startswith("#")).withColumn("key", F.regexp_replace(key, r"^export\s+", "")).withColumn("value", plain).where("key <> ''")
    return rows.groupBy("file", "key").agg(F.max_by("value", "line").alias("value"))


def settings_or_null(text: DataFrame, file: str, column: str) -> DataFrame:
    """``(file, settings)``: a configuration document each, null where it is no JSON object."""
    v = strict_variant(F.col(column))
    return text.select(F.col(file).alias("file"), F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v).alias("settings"))


def documents(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """Whole JSON files below a folder; files that don't parse are rows with a null record."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), strict_variant(F.col("value")).alias("record"))


def code_statistics(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files, lines and characters by folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
    rows = files.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.size(F.split("value", "\n")).alias("lines"), F.length("value").alias("chars"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))


def markdown_rows(text: DataFrame, key: str, column: str) -> DataFrame:
    """Cells of Markdown table rows, each with the last heading above it."""
    lines = text.select(key, F.posexplode(F.split(column, "\n")).alias("line", "raw"))
    above = Window.partitionBy(key).orderBy("line")
    heading = F.last(F.when(F.col("raw").rlike("^#+ "), F.regexp_replace("raw", "^#+ +", "")), ignorenulls=True).over(above)
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("heading", heading).where(F.col("raw").rlike(r"^\s*\|.*\|\s*$") & ~F.col("raw").rlike(r"^[\s|:-]+$"))
    return rows.select(key, "line", "heading", cells.alias("cells"))


def fenced_blocks(text: DataFrame, key: str, column: str) -> DataFrame:
    """Insides of fenced blocks, in order."""
    blocks = F.regexp_extract_all(column, F.lit(r"(?s)```[A-Za-z]*\n(.*?)\n?```"), F.lit(1))
    return text.select(key, F.posexplode(blocks).alias("block", "content"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
