"""Near-duplicate embeddings: spherical k-means cells, and cosine products of blocks within them.

A vector belongs to the cell of its nearest centre.  It also visits each cell
whose border is so near that a neighbour may lie beyond.  A neighbour with a
cosine of at least ``t`` differs by ``sqrt(1 - t^2)`` at most; along the line
between two centres a difference of random direction in ``d`` dimensions has
that size over ``sqrt(d)`` as its standard deviation, and ``GUARD`` of these are
allowed for (the full size where that is less).  Centres are an index: they are
fitted on a bounded sample, every vector is assigned, and recall against brute
force is measured in tests/llm.

The vectors at home in a cell meet all that are in it, in blocks; a pair of
blocks is one group, so no group grows with a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .shared import materialize, table

#: Vectors that k-means is fitted on at most, on the driver; and its most centres.
FIT_ROWS, MOST_CELLS = 16_384, 1024
#: Standard deviations of a neighbour's place that a border is guarded by.
GUARD = 3.0
#: Vectors of the two sides of a group at most, on average: at home, and all.
HOME_BLOCK, ALL_BLOCK = 512, 2048


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors; empty cells keep their centres."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        ok = size > 0
        centres[ok] = sums[ok] / size[ok, None]
    return centres


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    if not len(column):
        return np.zeros((0, 1))
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from overflowing
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centres: np.ndarray, reach: float):
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _unit(part)
                near = x @ centres.T
                own = near.argmax(axis=1)
                visits = near[np.arange(len(x)), own][:, None] - near <= reach * apart[own] + 1e-9
                visits[np.arange(len(x)), own] = True
                row, cell = np.nonzero(visits)
                packed = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(cell == own[row]), part.column("rep").take(pa.array(row)), part.column("copies").take(pa.array(row)), pa.array([packed[i] for i in row], pa.binary())],
                    names=["cell", "native", "rep", "copies", "unit"],
                )

    return run


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """Links of the native vectors of one block with all of another: numbers, and a spanning forest."""
        left = np.array(group.column("side").to_pylist()) == 0
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(left), -1)
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        close = unit[a] @ unit[b].T >= threshold
        close &= rep[a][:, None] != rep[b][None, :]
        n = close @ copies[b]
        forest = Forest()
        i, j = np.nonzero(close)
        edges = [(x, y) for x, y in zip(rep[a][i].tolist(), rep[b][j].tolist(), strict=True) if forest.join(x, y)]
        some = n > 0
        got = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([rep[a][some], got[:, 0]]), "b": pa.array([None] * int(some.sum()) + got[:, 1].tolist(), pa.int64()), "n": np.concatenate([n[some], np.zeros(len(got), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, guard: float | None = GUARD, most_cells: int = MOST_CELLS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Cosines are in double precision.  Vectors that are null, empty, zero or hold
    a null or a non-finite component link with nothing and are kept; so do
    vectors of unlike lengths with each other.  Equal vectors count as links of
    each other.  Rows that repeat a ``vec_id`` are vectors of their own; rows
    without one link with nothing.  With ``guard`` None every border is guarded
    in full: each link is found, at the price of more visits.  ``most_cells``
    bounds the index; beyond its square the work of a cell grows with the input.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.coalesce(F.expr("size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(vector, v -> v <> 0)"), F.lit(False))
    rows = materialize(rows.withColumn("fine", fine).withColumn("key", F.when(F.col("fine") & F.col("vec_id").isNotNull(), F.sha1(F.to_json("vector")))), "vectors")
    distinct = rows.where("fine and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    distinct = materialize(distinct, "distinct-vectors")
    # where unlike vectors share an id, they are numbered in the order of their ids
    shared = not distinct.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if shared:
        distinct = materialize(distinct.orderBy("rep", "key").select("key", F.monotonically_increasing_id().alias("rep"), "copies", "vector", F.col("rep").alias("low")), "numbered-vectors")
    total = distinct.count()
    found = None
    for (width,) in distinct.select(F.size("vector").alias("w")).distinct().collect():
        one = distinct.where(F.size("vector") == width)
        pairs = _links_of(one, one.count() if total else 0, threshold, guard, most_cells)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "vector-links")
    labels = components(found.where("b is not null"), "a", "b")
    numbers = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reps = distinct.select("key", "rep", "copies").join(numbers, F.col("rep") == F.col("node"), "left").drop("node").join(labels, F.col("rep") == F.col("node"), "left")
    reps = reps.select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    if shared:
        names = distinct.select(F.col("rep").alias("component_id"), "low")
        reps = reps.join(names, "component_id").select("key", "rep", "n_links", F.col("low").alias("component_id"))
    reps = materialize(reps, "vector-classes")
    out = rows.join(reps, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of(distinct: DataFrame, total: int, threshold: float, guard: float | None, most_cells: int) -> DataFrame:
    """``(a, b, n)``: numbers of links by vector (``b`` null) and linking pairs (``n`` 0), for vectors of one length."""
    share = min(1.0, FIT_ROWS / max(total, 1))
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).toArrow().sort_by("rep").combine_chunks()
    batch = sample.to_batches()[0] if sample.num_rows else None
    cells = min(most_cells, max(1, round(math.sqrt(total))), sample.num_rows)
    centres = fit_centres(_unit(batch), cells)
    width = len(sample.column("vector")[0])
    reach = math.sqrt(1 - threshold**2) * (1.0 if guard is None else min(1.0, guard / math.sqrt(width)))
    placed = materialize(distinct.select("rep", "copies", "vector").mapInArrow(_assign(centres, reach), "cell int, native boolean, rep long, copies long, unit binary"), "cells")
    # at most MOST_CELLS rows
    size = F.count("*"), F.count_if("native")
    blocks = placed.groupBy("cell").agg(F.ceil(size[1] / HOME_BLOCK).cast("int").alias("homes"), F.ceil(size[0] / ALL_BLOCK).cast("int").alias("alls")).where("homes > 0")
    sized = placed.join(F.broadcast(blocks), "cell").withColumn("home", F.pmod(F.xxhash64("rep"), "homes").cast("int")).withColumn("all", F.pmod(F.xxhash64("rep"), "alls").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("native").select("cell", F.col("home").alias("i"), every("alls").alias("j"), F.lit(0).alias("side"), "rep", "copies", "unit")
    right = sized.select("cell", every("homes").alias("i"), F.col("all").alias("j"), F.lit(1).alias("side"), "rep", "copies", "unit")
    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long")


def op3_embedding_cells(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT e.vec_id,
       (SELECT count(*) FROM link WHERE link.a = e.vec_id)::BIGINT AS n_links,
       r.low AS component_id,
       e.vec_id = r.low AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
