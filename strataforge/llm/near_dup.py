"""Near-duplicate documents by an LSH forest of MinHash signatures.

Each of ``TREES`` sorted orders lists the documents by a label of ``DEPTH``
MinHash values.  Neighbours that share a prefix of at least ``SHALLOW`` values
become candidates.  Regions where that prefix is shared by more documents than
the neighbour window holds are compared whole: their members form clusters, a
cluster is cut into small blocks.  Documents outside its largest component first
meet a block of that component; those that are still apart then meet all blocks
of the cluster, and each pair of blocks is one group that compares the documents
which are not yet in one component.  Every link is confirmed on full shingle sets.

The chance that a pair shares no prefix of four values in 20 orders is 4e-7 at
a similarity of 0.85 and 3e-5 at 0.80, in crowded regions as elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Forest, components
from .shared import materialize, small_batches, table, text_key, with_ids, without_rows
from .textvec import Words, slices, strings

TREES, DEPTH, SHALLOW, WINDOW = 20, 6, 4, 4
#: Documents in a block of a crowded cluster, on average; a group holds two blocks.
BLOCK = 64
#: Labels in one stretch of a sorted order, which a task holds.
STRETCH = 200_000
_RNG = np.random.Generator(np.random.PCG64(977))
_A = _RNG.integers(0, 2**63, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, size=TREES * DEPTH, dtype=np.uint64)
_SIGNED = "doc_id long, text_key long, n_shingles long, set_key binary, signature binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, in the order of trees and depths."""
    mixed = shingles ^ (shingles >> np.uint64(31))
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    low = np.full(len(_A), np.uint64(2**64 - 1))
    for i in range(0, len(mixed), 2048):
        part = _A[:, None] * mixed[None, i : i + 2048] + _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(">u2")


def _set_key(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _sign(shingle: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sizes, keys, signatures = [], [], []
            for s in Words(batch.column("text"), lower=True).shingles(shingle):
                sizes.append(len(s))
                keys.append(_set_key(s.tobytes()))
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return run


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: a key of the text, set size, a 128-bit key of the set, and its MinHash values (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(_sign(shingle), _SIGNED)


def _neighbours(batches):
    """Candidates of one sorted stretch; also the members of runs of one ``SHALLOW`` prefix that exceed the window, or touch an end."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    all_rows = pa.Table.from_batches(rows)
    tree, doc = all_rows.column("tree").to_numpy(), all_rows.column("doc_id").to_numpy()
    label = strings(all_rows.column("label"))[0].view(">u2").reshape(-1, DEPTH).astype(np.uint16)
    n, left, right = len(doc), [], []
    for d in range(1, min(WINDOW, n - 1) + 1):
        same = (tree[d:] == tree[:-d]) & (label[d:, :SHALLOW] == label[:-d, :SHALLOW]).all(axis=1)
        at = np.flatnonzero(same)
        left.append(doc[at])
        right.append(doc[at + d])
    new = np.ones(n, dtype=bool)
    new[1:] = (tree[1:] != tree[:-1]) | (label[1:, :SHALLOW] != label[:-1, :SHALLOW]).any(axis=1)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    crowded = size > WINDOW + 1
    crowded[[0, -1]] = True  # a run may go on beyond either end
    full = np.flatnonzero(crowded[run])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    m, k = len(pairs), len(full)
    region = np.array([int.from_bytes(hashlib.blake2b(bytes([tree[i]]) + label[i, :SHALLOW].tobytes(), digest_size=8).digest(), "little", signed=True) for i in full], dtype=np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([pairs[:, 0], doc[full]])), pa.array(np.concatenate([pairs[:, 1], region])), pa.array(np.concatenate([np.zeros(m, bool), np.ones(k, bool)]))],
        names=["a", "b", "crowded"],
    )


def _sets(shingle: int):
    def run(batches):
        for batch in slices(batches, "text"):
            packed = [s.tobytes() for s in Words(batch.column("text"), lower=True).shingles(shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(_set_key, packed)), pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "set_key", "words"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` for sorted distinct arrays."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("xs"), batch.column("ys"), strict=True):
                if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between documents of two blocks that are not in one component yet: a spanning forest of them."""
        node, comp, side = (group.column(c).to_numpy() for c in ("node", "component", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("words").combine_chunks()]
        forest, out = Forest(), []
        second = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            for j in second:
                if node[i] != node[j] and forest.find(int(comp[i])) != forest.find(int(comp[j])) and linked(sets[i], sets[j], percent):
                    forest.join(int(comp[i]), int(comp[j]))
                    out.append((node[i], node[j]))
        got = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    return run


def verdicts(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """:func:`near_duplicates`, with the ``text_key`` of each row."""
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, shingle), "signatures")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    # sets that are equal: the smallest document stands for all of them
    classes = materialize(live.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    own = live.select("doc_id", F.col("set_key").alias("own"), "signature").join(classes.withColumnRenamed("rep", "doc_id"), "doc_id").where("own = set_key").dropDuplicates(["doc_id", "set_key"])
    # a node is the smallest document; where one id stands for several sets, the further ones get numbers below zero
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_key"))
    node = F.when(nth == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "set_key").bitwiseOR(F.lit(-(2**63))))
    reps = materialize(own.select(node.alias("node"), "doc_id", "set_key", "signature"), "representatives")
    label = [F.struct(F.lit(t).cast("byte").alias("tree"), F.substring("signature", 1 + 2 * t * DEPTH, 2 * DEPTH).alias("label")) for t in range(TREES)]
    rows = reps.select(F.col("node").alias("doc_id"), F.explode(F.array(*label)).alias("x")).select("x.tree", "x.label", "doc_id")
    stretches = max(1, -(-reps.count() * TREES // STRETCH))
    found = rows.repartitionByRange(stretches, "tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id").mapInArrow(_neighbours, "a long, b long, crowded boolean")
    found = materialize(found, "candidates")
    crowd = found.where("crowded").select(F.col("a").alias("node"), F.col("b").alias("region"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def full(of: DataFrame) -> DataFrame:
        """``(node, words)``: shingle sets of nodes, from the whole texts."""
        wanted = materialize(of.select("node").distinct().join(reps.select("node", "doc_id", "set_key"), "node"), "wanted")
        sets = with_ids(texts, wanted).mapInArrow(_sets(shingle), "doc_id long, set_key binary, words binary").dropDuplicates(["doc_id", "set_key"])
        return sets.join(wanted, ["doc_id", "set_key"]).select("node", "words")

    pairs = materialize(found.where("not crowded").select("a", "b").distinct(), "pairs")
    words = materialize(full(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "sets")
    xs = words.select(F.col("node").alias("a"), F.col("words").alias("xs"))
    ys = words.select(F.col("node").alias("b"), F.col("words").alias("ys"))
    links = materialize(pairs.join(xs, "a").join(ys, "b").select("a", "b", "xs", "ys").mapInArrow(_confirm(percent), "a long, b long"), "links")
    labels = _crowded(crowd, links, full, percent)
    rep = reps.select("node", "set_key", F.col("doc_id").alias("rep")).join(labels, "node", "left").select("set_key", "rep", F.coalesce("component", "node").alias("component"))
    if not reps.where("node <> doc_id").isEmpty():
        rep = materialize(rep, "classes")
        low = rep.groupBy("component").agg(F.min("rep").alias("low"))
        rep = rep.join(low, "component").select("set_key", F.col("low").alias("component"))
    member = live.select("doc_id", "text_key", "n_shingles", "set_key").join(rep, "set_key").select("doc_id", "text_key", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A document's set
    holds its distinct ``shingle``-word runs; a shorter text counts as one run,
    and a null or blank text has an empty set, links with nothing and is kept.
    Documents link when 100 * intersection >= percent * union.  ``component_id``
    is the smallest ``doc_id`` that links reach, and that document is kept.
    Equal sets always link.  Rows that repeat an id are judged each by its own
    text, and kept if their id is the smallest.  Rows without an id link with
    nothing, have no component and are kept.
    """
    return verdicts(docs, shingle, percent).drop("text_key")


def _crowded(crowd: DataFrame, links: DataFrame, full, percent: int) -> DataFrame:
    """Components, after the rest of the crowded regions is compared: nodes of one cluster that are in different components."""
    labels = components(links, "a", "b")
    sizes = crowd.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    crowd = materialize(crowd.join(sizes, "region", "left_semi"), "crowd")
    if crowd.isEmpty():
        return labels
    # regions that share a document belong to one cluster: its smallest document names it
    anchor = materialize(crowd.groupBy("region").agg(F.min("node").alias("low")), "anchors")
    cluster = components(crowd.join(anchor, "region").where("node <> low").select("node", "low").distinct(), "node", "low")
    cluster = materialize(cluster.select("node", F.col("component").alias("cluster")), "clusters")
    words = None
    for first in (True, False):
        member = materialize(cluster.join(labels, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component")), "members")
        parts = materialize(member.groupBy("cluster", "component").agg(F.count("*").alias("n")), "parts")
        # clusters of several components: the largest one, and what is outside of it, in blocks
        total = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("k")).where("k > 1")
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        total = materialize(total.select("cluster", "main", blocks(F.col("all") - F.col("most")).alias("outside"), blocks(F.col("most")).alias("mains"), blocks(F.col("all")).alias("alls")), "open")
        if total.isEmpty():
            return labels
        member = member.join(total, "cluster")
        if words is None:
            words = materialize(full(member.select("node")), "crowd-sets")
        hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        apart = F.col("component") != F.col("main")
        other = F.lit(0) if first else every("alls")
        left = member.where(apart).select("cluster", hashed("outside").alias("i"), other.alias("j"), F.lit(0).alias("side"), "node", "component")
        # at first one block of the largest component, then all of the cluster
        right = member.where(~apart & (hashed("mains") == 0)) if first else member
        right = right.select("cluster", every("outside").alias("i"), (F.lit(0) if first else hashed("alls")).alias("j"), F.lit(1).alias("side"), "node", "component")
        more = left.unionByName(right).join(words, "node").groupBy("cluster", "i", "j").applyInArrow(_blocks(percent), "a long, b long")
        links = materialize(links.select("a", "b").unionByName(more), "links")
        labels = components(links, "a", "b")
    return labels


def op2_minhash_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 0.8) one document stays, each row by its own text."""
    verdict = materialize(verdicts(docs, shingle=5, percent=80), "verdicts")
    return without_rows(docs, verdict.where("not kept")).select(docs.columns)
