"""Token counts that are kept up to date by signed deltas.

A batch turns document events into one row of sums for each source, language
and tokenizer version.  A commit writes the batch's sums and the new running
totals into fresh folders and then publishes a manifest that names both, by one
rename; readers follow the newest manifest and never see half a commit, and a
writer that is lost leaves folders that no manifest names.  A batch that is
committed again takes its old sums back out of the totals, so retries change
nothing.  :meth:`Rollup.compact` folds old batches into the totals for good.
"""

from __future__ import annotations

import base64
import json
import uuid
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, table
from .textvec import Words, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokenizer versions: white-space words, and the byte-level vocabulary above.
WORDS, BYTES = "words-1", "byte-bpe-50k-1"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
#: Rows of one key are first added up in this many parts.
PARTS = 16


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches):
    encoding = _encoding(public_tokenizers.path(VOCABULARY))
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        n_words = words.first[1:] - words.first[:-1]
        ids = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(ids, pa.int64()), pa.array(words.at[1:] - words.at[:-1], pa.int64())], names=[*keep, "n_words", "n_ids", "n_bytes"])


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, lang, text_key, n_words, n_ids, n_bytes)`` of every whole text; null counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha1(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return rows.mapInArrow(_count, "doc_id long, source string, lang string, text_key string, n_words long, n_ids long, n_bytes long")


def events(counts: DataFrame, sign: int, docs: int = 1) -> DataFrame:
    """Signed events of counted documents, one for each tokenizer version: 1 inserts, -1 deletes; ``docs`` 0 revises tokens only."""
    versions = F.explode(F.array(F.struct(F.lit(WORDS).alias("tokenizer"), F.col("n_words").alias("n")), F.struct(F.lit(BYTES).alias("tokenizer"), F.col("n_ids").alias("n"))))
    rows = counts.select("source", "lang", "n_bytes", versions.alias("v"))
    return rows.select("source", "lang", "v.tokenizer", F.lit(sign * docs).cast("long").alias("n_docs"), (F.lit(sign) * F.col("v.n")).alias("n_tokens"), (F.lit(sign) * F.col("n_bytes")).alias("n_bytes"))


_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


class Rollup:
    """Additive totals in a folder that one writer at a time commits to and any number reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(conf)

    def manifest(self) -> dict:
        """``version``; ``batches``, the folder of each; ``totals``, the folder of the running totals; ``folded``, the batches that compaction closed."""
        versions = self._path(self.folder, "manifests")
        if not self._store.exists(versions):
            return {"version": 0, "batches": {}, "totals": None, "folded": []}
        newest = max(x.getPath().getName() for x in self._store.listStatus(versions) if x.getPath().getName().endswith(".json"))
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{newest}").collect()))

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['version']:012d}.json"
        hidden, shown = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{name}")
        out = self._store.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._store.mkdirs(shown.getParent())
        if self._store.exists(shown) or not self._store.rename(hidden, shown):
            raise RuntimeError(f"another writer has committed version {manifest['version']}")

    def _written(self, rows: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
        # a row per source, language and tokenizer version; Spark merges small partitions, and many sources stay apart
        rows.write.parquet(path)
        return path

    def _read(self, path: str | None) -> DataFrame:
        return self.spark.createDataFrame([], _TOTALS) if path is None else self.spark.read.schema(_TOTALS).parquet(path)

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Commit ``deltas`` (``KEYS`` and ``SUMS``) as ``batch``; the same batch again replaces what it wrote.

        Sums are made in two steps, so that a source with a third of all rows is not one task's work.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        old = self.manifest()
        if batch in old["folded"]:
            raise ValueError(f"batch {batch!r} is compacted and cannot be sent again")
        parts = deltas.groupBy(*KEYS, F.spark_partition_id().__mod__(PARTS).alias("part")).agg(*(F.sum(c).alias(c) for c in SUMS))
        path = self._written(parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)), "batches")
        taken = self._read(old["batches"].get(batch)).select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))
        both = self._read(old["totals"]).unionByName(self._read(path)).unionByName(taken)
        totals = self._written(both.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)), "totals")
        self._publish(old | {"version": old["version"] + 1, "batches": old["batches"] | {batch: path}, "totals": totals})

    def compact(self) -> None:
        """Fold all batches into the running totals for good, and delete what no manifest needs any more.

        The totals stay as they are; batches that are folded are refused if they are sent again.
        """
        old = self.manifest()
        new = old | {"version": old["version"] + 1, "batches": {}, "folded": sorted({*old["folded"], *old["batches"]})}
        self._publish(new)
        for kind in ("batches", "totals"):
            where = self._path(f"{self.folder}/{kind}")
            for x in self._store.listStatus(where) if self._store.exists(where) else []:
                if new["totals"] is None or x.getPath().getName() != new["totals"].rsplit("/", 1)[1]:
                    self._store.delete(x.getPath(), True)

    def totals(self) -> DataFrame:
        """Totals of all committed batches; keys whose sums are all zero are gone."""
        return self._read(self.manifest()["totals"]).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")


def later_copies(counts: DataFrame) -> DataFrame:
    """Counted documents whose text an earlier document has: all but the smallest id of each text.

    Rows that repeat an id and a text are no copies of each other, and rows without an id are none at all.
    """
    first = materialize(counts.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("text_key", "first"), "first-copies")
    return counts.join(first, "text_key").where(F.col("doc_id") > F.col("first")).drop("first")


def op9_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents are inserted; the first batch is
    sent again and changes nothing; later copies of a text are deleted; texts
    labelled toxic that are left are withheld, which revises their counts to
    zero while the documents stay.  Null sources and languages are keys like others.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = materialize(counted(docs), "counts")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    rollup.commit("insert", events(counts, 1))
    rollup.commit("insert", events(counts, 1))
    copies = materialize(later_copies(counts), "later-copies")
    rollup.commit("delete-copies", events(copies, -1))
    toxic = materialize(labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "toxic")
    withheld = counts.join(toxic, "doc_id", "left_semi").join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    rollup.commit("withhold-toxic", events(withheld, -1, docs=0))
    return rollup.totals()
