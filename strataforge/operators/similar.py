"""Texts that resemble held-out ones: every pair whose matching-blocks ratio reaches a threshold.

The ratio is twice the number of matched characters over the characters of both
texts, where the longest common block is matched first, then those to its left
and right.  It is bounded from above, exactly and ever more closely, by

- the lengths: a match has no more characters than the shorter text,
- common characters, each counted as often as both texts have it,
- common pairs of characters: ``m`` matched characters of texts of ``t``
  characters lie in at most ``t - 2 m + 1`` blocks, so at least ``3 m - t - 1``
  pairs are common,
- the longest common subsequence.

The held-out texts are the stated queries: blocks of them go to the tasks, and a
row meets only those whose length allows a match.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Held-out texts of one pass over the rows.
BLOCK = 2_000
#: Pairs of characters are counted in so many cells; two that share one only loosen the bound.
CELLS = 1_021


def common_subsequence(a: str, masks: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``n`` characters, given as the bits of its characters' places."""
    full = (1 << n) - 1
    row = full
    for ch in a:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class HeldOut:
    """A block of held-out texts in order of length, with what the bounds ask of each."""

    def __init__(self, rows: list[tuple], least: float):
        self.least = least
        self.rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))
        self.lengths = [len(t) for _, t in self.rows]
        self.alphabet = {c: n for n, c in enumerate(sorted({c for _, t in self.rows for c in t}))}
        self.chars = np.stack([self._chars(t) for _, t in self.rows])
        self.pairs = np.stack([self._pairs(t) for _, t in self.rows])
        self.masks = [_masks(t) for _, t in self.rows]

    def _chars(self, text: str) -> np.ndarray:
        return np.bincount([self.alphabet[c] for c in text if c in self.alphabet] or [0], minlength=max(1, len(self.alphabet)))

    def _pairs(self, text: str) -> np.ndarray:
        c = _codes(text)
        return np.bincount((c[:-1] * 31 + c[1:]) % CELLS, minlength=CELLS) if len(c) > 1 else np.zeros(CELLS, np.int64)

    def near(self, text: str):
        """``(key, ratio)`` of each held-out text that ``text`` resembles."""
        n, t = len(text), self.least
        low, high = bisect_left(self.lengths, math.ceil(n * t / (2 - t) - 1e-9)), bisect_right(self.lengths, math.floor(n * (2 - t) / t + 1e-9))
        if low >= high:
            return
        total = np.array(self.lengths[low:high]) + n
        need = np.ceil(total * t / 2 - 1e-9)
        open_ = np.minimum(self.chars[low:high], self._chars(text)).sum(axis=1) >= need
        at = np.flatnonzero(open_)
        if len(at):
            at = at[np.minimum(self.pairs[low:high][at], self._pairs(text)).sum(axis=1) >= 3 * need[at] - total[at] - 1]
        for i in at.tolist():
            key, other = self.rows[low + i]
            if common_subsequence(text, self.masks[low + i], len(other)) >= need[i]:
                ratio = SequenceMatcher(None, other, text, autojunk=False).ratio()
                if ratio >= t:
                    yield key, ratio


def _compare(block: list[tuple], least: float):
    def run(batches):
        held = HeldOut(block, least)
        for batch in batches:
            out = [(k, row, copies, ratio) for row, copies, text in zip(*(batch.column(c).to_pylist() for c in ("row", "copies", "text")), strict=True) for k, ratio in held.near(text)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["held", "row", "copies", "ratio"])

    return run


def resembling(rows: DataFrame, row: str, held: DataFrame, key: str, text: str, least: float = 0.7, block: int = BLOCK) -> DataFrame:
    """``(held, row, copies, ratio)``: each held-out text and each distinct text of ``rows`` whose ratio is at least ``least``.

    ``row`` is the smallest id of the rows that have this very text, ``copies``
    their number.  Null texts resemble nothing; two empty texts are equal.
    ``held`` is read in blocks of about ``block`` texts, which bounds what a task
    and the driver hold; the rows are read once a block.
    """
    if not 0 < least <= 1:
        raise ValueError("the least ratio must be above 0 and at most 1")
    mine = held.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    size = mine.agg(F.count("*").alias("n"), F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high")).first()
    blocks = math.ceil(size["n"] / block)
    long_enough = F.length(text).between(math.ceil((size["low"] or 0) * least / (2 - least) - 1e-9), math.floor((size["high"] or 0) * (2 - least) / least + 1e-9))
    distinct = rows.where(long_enough).groupBy(text).agg(F.min(F.col(row).cast("long")).alias("row"), F.count("*").alias("copies")).select("row", "copies", F.col(text).alias("text"))
    found = None
    for b in range(blocks):
        own = [(r["key"], r["text"]) for r in mine.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()]
        if own:
            one = distinct.mapInArrow(_compare(own, least), "held long, row long, copies long, ratio double")
            found = one if found is None else found.unionByName(one)
    return found if found is not None else rows.sparkSession.createDataFrame([], "held long, row long, copies long, ratio double")
