"""Language identification with a string kernel.

Two texts are compared by the share of character n-grams, of one to ``LENGTHS``
letters, that occur in both (presence, not number), over the root of the product
of their numbers of n-grams: the blended-spectrum presence kernel.  A text is
described by its kernel with ``LANDMARKS`` landmark texts (Nyström), and one
ridge regression for each language against the rest is solved on these.

The score of a text is (presence row) times (presence of the landmarks) times
(weights).  The two factors on the right do not depend on the text; they are
multiplied once, and each batch of texts is one sparse matrix times that.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table

LENGTHS = 3
#: n-grams are told apart by so many bits of a hash.
BITS = 22
#: Labelled texts that the regression is fitted on, about (as many of each language as there are, up to an equal share);
#: landmark texts (an equal share for each language, one at least), and the length up to which texts are preferred as landmarks.
FIT_ROWS, LANDMARKS, LANDMARK_CHARS = 8_192, 128, 50_000
#: Weight of the ridge, by row.
RIDGE = 1e-4
#: Characters of a text whose n-grams are listed at a time.
STRETCH = 1 << 20


@cache
def _folded() -> np.ndarray:
    """Lower-case letters of the first plane; all other characters are a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low[0])
        elif unicodedata.category(chr(c)) in ("Mn", "Mc"):
            out[c] = c
    return out


class Grams:
    """Lists the distinct n-grams of texts, one text after the other."""

    def __init__(self):
        self.slot = np.zeros(1 << BITS, np.int32)
        self.text = np.zeros(1 << BITS, np.int32)
        self.serial = 0

    def of(self, text: str) -> np.ndarray:
        """Hashes of all n-grams of the letters of ``text``, words padded by a space; runs of other characters count as one."""
        self.serial += 1
        found, tail = [], np.array([32], np.uint32)
        for at in range(0, len(text), STRETCH):
            raw = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
            letters = _folded()[np.minimum(raw, 0xFFFF)]
            if raw.max() > 0xFFFF:
                letters = np.where(raw > 0xFFFF, raw, letters)
            letters = np.concatenate([tail, letters] + ([np.array([32], np.uint32)] if at + STRETCH >= len(text) else []))
            letters = letters[np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32)]]
            wide = letters.astype(np.uint64)
            code = np.zeros(len(wide), np.uint64)
            for n in range(LENGTHS):
                if len(wide) <= n:
                    break
                code = code[: len(wide) - n] * np.uint64(0x100000001B3) + wide[n:] + np.uint64(1)
                cells = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
                places = np.arange(len(cells), dtype=np.int32)
                self.slot[cells] = places
                cells = cells[self.slot[cells] == places]
                cells = cells[self.text[cells] != self.serial]
                self.text[cells] = self.serial
                found.append(cells)
            tail = letters[-(LENGTHS - 1) :] if LENGTHS > 1 else letters[:0]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Landmarks:
    """n-grams of the landmark texts, and kernels with them."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists
        every = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[every] = np.arange(len(every), dtype=np.int32)
        self.size = len(every)

    def presence(self) -> np.ndarray:
        """n-grams by landmarks, divided by the root of the landmark's number of n-grams."""
        out = np.zeros((self.size, len(self.lists)), np.float64)
        for m, cells in enumerate(self.lists):
            out[self.place[cells], m] = 1 / np.sqrt(max(1, len(cells)))
        return out


def product(rows: list[np.ndarray], sizes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Presence rows (column numbers of each), divided by the roots of ``sizes``, times ``right``."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), right.shape[1]))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = np.cumsum(lengths[some]) - lengths[some]
        out[some] = np.add.reduceat(right[np.concatenate([rows[i] for i in some])], starts, axis=0)
    return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def kernel_rows(grams: Grams, marks: Landmarks, texts: list[str], right: np.ndarray) -> np.ndarray:
    rows, sizes = [], []
    for text in texts:
        cells = grams.of(text)
        sizes.append(len(cells))
        own = marks.place[cells]
        rows.append(own[own >= 0])
    return product(rows, np.array(sizes), right)


def _lists(batches):
    grams = Grams()
    for batch in batches:
        for lang, order, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "order", "text")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([order], pa.int64()), pa.array([grams.of(text).astype(np.int32).tobytes()], pa.binary())], names=["lang", "order", "cells"])


def _equations(lists: list[np.ndarray], langs: list[str]):
    """Each task's share of the normal equations, added up over its rows."""

    def run(batches):
        grams, marks = Grams(), Landmarks(lists)
        right, number = marks.presence(), {lang: n for n, lang in enumerate(langs)}
        m = len(lists) + 1
        square, target, n = np.zeros((m, m)), np.zeros((m, len(langs))), 0
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at in range(0, len(texts), 32):
                k = np.hstack([kernel_rows(grams, marks, texts[at : at + 32], right), np.ones((len(texts[at : at + 32]), 1))])
                y = np.full((len(k), len(langs)), -1.0)
                y[np.arange(len(k)), [number[x] for x in own[at : at + 32]]] = 1
                square += k.T @ k
                target += k.T @ y
                n += len(k)
        yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["square", "target", "n"])

    return run


def learnable() -> Column:
    """Rows that may be learned from: with an id, a language, a letter, and outside the held-out quarter."""
    return F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & has_letter()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


class Model:
    """Languages in order, the landmarks' n-grams, and weights by language, the last for the constant."""

    def __init__(self, langs: list[str], lists: list[np.ndarray], weights: np.ndarray):
        self.langs, self.lists, self.weights = langs, lists, weights


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Learn from ``text`` and ``lang`` of all rows given.

    Of each language about an equal share of ``fit_rows`` is taken, those whose
    text has the smallest hashes; no other bound is set.  With ``landmarks`` for
    all languages, each has one at least.
    """
    rows = docs.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("hash"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], [], np.zeros((1, 0)))
    most = -(-fit_rows // len(langs))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, most / n) * (1 << 40))) for lang, n in counts.items()], "its_lang string, share long")
    sample = rows.join(F.broadcast(shares), (F.col("lang") == F.col("its_lang")) & (F.col("hash") < F.col("share")))
    # copies of a text are one row, merged before they are shuffled, however many there are
    sample = materialize(sample.select("text", "lang", "hash").dropDuplicates(["lang", "hash"]).repartition(16, "hash").sortWithinPartitions("hash", "lang"), "language-sample")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text") > LANDMARK_CHARS, "hash", "text"))
    chosen = sample.withColumn("order", order.cast("long")).where(F.col("order") <= max(1, landmarks // len(langs)))
    found = sorted(chosen.mapInArrow(_lists, "lang string, order long, cells binary").collect(), key=lambda r: (r["lang"], r["order"]))
    lists = [np.sort(np.frombuffer(bytes(r["cells"]), np.int32)).astype(np.int64) for r in found]
    m = len(lists) + 1
    shared = sample.mapInArrow(_equations(lists, langs), "square binary, target binary, n long").collect()
    shared = sorted(shared, key=lambda r: bytes(r["square"]))
    square = sum(np.frombuffer(bytes(r["square"]), np.float64).reshape(m, m) for r in shared)
    target = sum(np.frombuffer(bytes(r["target"]), np.float64).reshape(m, len(langs)) for r in shared)
    n = sum(r["n"] for r in shared)
    own = np.zeros((m, m))
    marks = Landmarks(lists)
    own[:-1, :-1] = product([marks.place[c] for c in lists], np.array([len(c) for c in lists]), marks.presence())
    weights = np.linalg.lstsq(square + RIDGE * n * (own + 1e-6 * np.eye(m)), target, rcond=None)[0]
    return Model(langs, lists, weights)


def _predict(model: Model):
    def run(batches):
        grams, marks = Grams(), Landmarks(model.lists)
        right = marks.presence() @ model.weights[:-1]
        for batch in batches:
            names: list[str | None] = ["und"] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            lettered = np.asarray(batch.column("lettered").to_numpy(zero_copy_only=False), bool)
            at = np.flatnonzero(lettered) if model.langs else []
            for a in range(0, len(at), 256):
                some = at[a : a + 256]
                got = kernel_rows(grams, marks, batch.column("text").take(pa.array(some)).to_pylist(), right) + model.weights[-1]
                best = got.argmax(axis=1)
                scores[some] = (np.clip(got[np.arange(len(some)), best], -1, 1) + 1) / 2
                for i, b in zip(some.tolist(), best.tolist(), strict=True):
                    names[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(batch.num_columns - 2)), pa.array(names), pa.array(scores)], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1), for every row of ``docs``.

    Only ``text`` is looked at.  A text that is null, empty or without a letter
    is ``und`` with score 0, and so is every text if the model knows no language.
    Equal scores go to the language first in order.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"), has_letter().alias("lettered"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(_predict(model), ", ".join([*kinds, "lang_pred string", "score double"]))


def op12_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(learnable()))
    return predict(docs, model, ["doc_id", "held_out"])
