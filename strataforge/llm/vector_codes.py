"""Vector compression: one codebook entry for each part of a vector, found through memoised grid cells.

Components become integers, so every distance, sum and tie is exact and no order
of tasks shows in a result.  A part lies in a cell of a coarse grid.  For a cell
the least and the largest distance of its box to each entry are known; an entry
whose least distance exceeds the smallest largest distance is nearest nowhere in
the box.  The other entries are remembered by the cell, and only they are
evaluated for its parts.

Codebooks are trained by rounds over all vectors: tasks add up their parts by
entry, Spark adds up the tasks' sums, and the driver holds the codebooks alone
(``entries`` times the length of a vector, for each length).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, materialize, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are held to this size, so that squares and their sums fit into 64 bits.
LARGEST = 1 << 26
#: Cells along the widest axis of a codebook, and remembered cells at most.
SPLITS, REMEMBERED = 8, 1 << 15
#: Differences that one step of an evaluation holds at most, about.
STEP = 1 << 20


class Cells:
    """The entries of one part, and the entries that count in each grid cell seen so far."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = int((entries.max(axis=0) - entries.min(axis=0)).max()) if entries.size else 0
        self.side = max(1, spread // SPLITS)
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        low = (cells * self.side)[:, None]
        high = low + (self.side - 1)
        least = (np.maximum(np.maximum(low - self.entries, self.entries - high), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(self.entries - low), np.abs(self.entries - high)) ** 2).sum(axis=2)
        return [np.flatnonzero(row) for row in least <= most.min(axis=1)[:, None]]

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        new = [n for n, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(range(len(keys)))
        width = max(1, STEP // max(1, self.entries.size))
        for at in range(0, len(new), width):
            some = new[at : at + width]
            self.known.update(zip((keys[n] for n in some), self._undominated(cells[some]), strict=True))
        return [self.known[k] for k in keys]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and its squared distance."""
        own, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if parts.shape[1] == 0:
            return own, error
        width = max(1, STEP // max(1, self.entries.size))
        for at in range(0, len(parts), width):
            x = parts[at : at + width]
            cells, cell_of = np.unique(x // self.side, axis=0, return_inverse=True)
            lists = self._candidates(cells)
            cell_of = cell_of.reshape(-1)
            counts = np.array([len(c) for c in lists])
            begins = np.cumsum(counts) - counts
            n = counts[cell_of]
            starts = np.cumsum(n) - n
            row = np.repeat(np.arange(len(x)), n)
            which = np.concatenate(lists)[np.repeat(begins[cell_of] - starts, n) + np.arange(n.sum())]
            away = ((x[row] - self.entries[which]) ** 2).sum(axis=1)
            self.evaluated += len(away)
            low = np.minimum.reduceat(away, starts)
            hits = np.flatnonzero(away == low[row])
            first = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
            own[at : at + width], error[at : at + width] = which[first], low
        return own, error


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; equal parts where ``parts`` divides the length."""
    return [p * width // parts for p in range(parts + 1)]


def _by_length(batch: pa.RecordBatch):
    """``(length, row numbers, integers)`` for each length of vector in a batch."""
    column = batch.column("whole")
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(width), rows, np.asarray(values, np.int64).reshape(len(rows), int(width))


def _parts_of(books: dict, parts: int):
    cells = {w: [Cells(book[:, a:b]) for a, b in zip(cut, cut[1:], strict=False)] for w, book in books.items() for cut in [bounds(w, parts)]}

    def assign(width: int, x: np.ndarray):
        cut = bounds(width, parts)
        return [one.nearest(x[:, a:b]) for one, a, b in zip(cells[width], cut, cut[1:], strict=False)]

    return assign


def _sums(books: dict, parts: int):
    def run(batches):
        assign, totals = _parts_of(books, parts), {w: (np.zeros(b.shape, np.int64), np.zeros((len(b), parts), np.int64)) for w, b in books.items()}
        for batch in batches:
            for width, _, x in _by_length(batch):
                cut, (sums, counts) = bounds(width, parts), totals[width]
                for p, (own, _) in enumerate(assign(width, x)):
                    np.add.at(sums[:, cut[p] : cut[p + 1]], own, x[:, cut[p] : cut[p + 1]])
                    counts[:, p] += np.bincount(own, minlength=len(counts))
        for width, (sums, counts) in totals.items():
            part = np.searchsorted(bounds(width, parts), np.arange(width), side="right") - 1
            entry, place = np.nonzero(counts[:, part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), width, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[entry, place]), pa.array(counts[:, part][entry, place])],
                names=["width", "entry", "place", "total", "n"],
            )

    return run


def _codes(books: dict, parts: int):
    shas = {w: codebooks_sha256(b, parts) for w, b in books.items()}

    def run(batches):
        assign = _parts_of(books, parts)
        for batch in batches:
            code, error, sha = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for width, rows, x in _by_length(batch):
                found = assign(width, x)
                digits = np.stack([own for own, _ in found], axis=1).astype(np.uint8)
                error[rows] = sum(e for _, e in found)
                for row, d in zip(rows.tolist(), digits, strict=True):
                    code[row], sha[row] = d.tobytes().hex(), shas[width]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"],
            )

    return run


def codebooks_sha256(book: np.ndarray, parts: int) -> str:
    """Of the entries' decimal components by part, entry and place within the part."""
    cut = bounds(book.shape[1], parts)
    return hashlib.sha256(",".join(str(v) for a, b in zip(cut, cut[1:], strict=False) for entry in book[:, a:b].tolist() for v in entry).encode()).hexdigest()


def integers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, whole)``: components as ``floor(256 * x)``; rows without a finite vector go."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.coalesce(F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"), F.lit(False))
    whole = F.transform("vector", lambda v: F.floor(F.greatest(F.least(v * 256.0, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return rows.where(fine).select("vec_id", "label", whole.alias("whole"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(vec_id, label, code, error, codebooks_sha256)`` by row, and the codebooks by length of vector.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``.  Rows whose vector is
    null or holds a null or a non-finite component are left out.  A codebook
    starts as the vectors of the smallest ``vec_id`` (of one id, of the smallest
    vector), ``entries`` at most; rows without an id are coded, but start no
    entry.  Rows that repeat an id are vectors of their own.  Vectors of unlike
    lengths have codebooks of their own, an empty vector has the code of zeros;
    where ``parts`` does not divide the length, parts differ by one component.
    Components beyond ``LARGEST`` count as that.  ``entries`` is 256 at most.
    """
    rows = materialize(integers(vectors), "vector-integers")
    order = Window.partitionBy(F.size("whole")).orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    first = rows.where("vec_id is not null").select("vec_id", "whole", F.row_number().over(order).alias("rank")).where(F.col("rank") <= entries)
    books: dict[int, list] = {}
    for r in sorted(first.collect(), key=lambda r: r["rank"]):
        books.setdefault(len(r["whole"]), []).append(r["whole"])
    books = {w: np.array(b, np.int64).reshape(len(b), w) for w, b in books.items()}
    # a length that only rows without an id have starts at zero
    books |= {r["w"]: np.zeros((1, r["w"]), np.int64) for r in rows.where("vec_id is null").select(F.size("whole").alias("w")).distinct().collect() if r["w"] not in books}
    for _ in range(rounds):
        found = rows.select("whole").mapInArrow(_sums(books, parts), "width int, entry int, place int, total long, n long")
        books = {w: b.copy() for w, b in books.items()}
        for r in found.groupBy("width", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toLocalIterator():
            books[r["width"]][r["entry"], r["place"]] = r["total"] // r["n"]
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_codes(books, parts), f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"), books


def op13_grid_codes(spark, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "vector-codes")
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "its_label"), "label-errors")
    small = F.broadcast(sums) if sums.count() <= BROADCAST_IDS else sums
    return codes.join(small, F.col("label").eqNullSafe(F.col("its_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(book: str) -> str:
    """The nearest entry of every part: its index and distance packed as ``distance * 64 + entry``."""
    return f"""
  SELECT vec_id, part, min(away * 64 + entry) AS best FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS away
    FROM x JOIN {book} b ON b.part = x.part AND b.place = x.place
    GROUP BY x.vec_id, x.part, b.entry
  ) GROUP BY vec_id, part"""


def _replaced(book: str, assigned: str) -> str:
    return f"""
  SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v
  FROM {book} b LEFT JOIN (
    SELECT x.part, a.best % 64 AS entry, x.place, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v
    FROM x JOIN {assigned} a ON a.vec_id = x.vec_id AND a.part = x.part
    GROUP BY x.part, a.best % 64, x.place
  ) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, ((i - 1) * 16) // len(e) AS part, (i - 1) % (len(e) // 16) AS place, e[i] AS v
  FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT x.part, s.entry, x.place, x.v
  FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) s ON s.vec_id = x.vec_id
), near0 AS MATERIALIZED ({_assigned("book0")}
), book1 AS MATERIALIZED ({_replaced("book0", "near0")}
), near1 AS MATERIALIZED ({_assigned("book1")}
), book2 AS MATERIALIZED ({_replaced("book1", "near1")}
), near2 AS MATERIALIZED ({_assigned("book2")}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id)
"""
