"""Byte-level BPE by replaying the merges over the distinct words of blocks of the corpus.

Spark deals the corpus out; a task takes its part in blocks of ``BLOCK_BYTES``
of text and collects the distinct words that it has not met yet.  An inverted
index lists for each pair of neighbouring tokens the places where it stands in
all these words.  Merges are applied in the order of their ranks over the whole
block: each looks up its own places and touches only these and their
neighbours.  Words met once are remembered, so that a task replays no word
twice as long as its memory of ``MEMORY`` words holds.

One index over the distinct words of the whole corpus was built and measured;
bringing its ids back to the texts costs more disk than the check allows (README).

Null and empty texts have no ids.  Rows that repeat an id, and rows without
one, are encoded each by itself.  A task holds one text whole at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textvec import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a block, and distinct words that a task remembers before it starts anew.
BLOCK_BYTES, MEMORY = 16 << 20, 600_000
#: Unicode's white space, as the merges' library understands ``\\s``.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
#: Cuts a text where the pattern surely cuts it too; chunks are then looked up, and split finely only when new.
_COARSE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """Merges of one vocabulary, replayed over all words of a block together."""

    NONE = np.int64(1 << 40)

    def __init__(self, path: str):
        rank = ranks(path)
        self.token = [b""] * (max(rank.values()) + 1)
        for t, i in rank.items():
            self.token[i] = t
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        # tokens after which a pair of a lower rank may come up
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.early = {*a[self.ranks < a].tolist(), *b[self.ranks < b].tolist()}

    def lookup(self, a, b) -> np.ndarray:
        """Rank of the token that each two tokens make, or NONE."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the place in them where each word begins (n + 1)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n, end = len(ids), np.cumsum(size)
        who = np.repeat(np.arange(len(words)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end[size > 0] - 1] = -1
        before[(end - size)[size > 0]] = -1
        live = np.ones(n, dtype=bool)
        rank_at = np.full(n, self.NONE)
        inner = np.flatnonzero(after >= 0)
        rank_at[inner] = self.lookup(ids[inner], ids[inner + 1])
        # the inverted index: the places of each pair, by the rank of its merge
        inner = inner[rank_at[inner] < self.NONE]
        inner = inner[np.argsort(rank_at[inner], kind="stable")]
        first = np.flatnonzero(np.diff(rank_at[inner], prepend=-1))
        index = dict(zip(rank_at[inner[first]].tolist(), np.split(inner, first[1:]), strict=True)) if len(first) else {}
        added: dict[int, list[int]] = {}
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            at, more = index.pop(r, None), added.pop(r, None)
            if more is not None:
                at = np.unique(np.array(more) if at is None else np.concatenate([at, more]))
            if at is None:
                continue
            at = at[rank_at[at] == r]
            if r in self.early and len(at) > 1:
                # one merge in each word, as a pair of a lower rank may have to come before the next one
                one = np.concatenate([[True], who[at[1:]] != who[at[:-1]]])
                if not one.all():
                    added[r] = at[~one].tolist()
                    heappush(heap, r)
                    at = at[one]
            elif len(at) > 1:
                # places that overlap, as in "aaa", merge from left to right
                over = np.flatnonzero(after[at[:-1]] == at[1:]) + 1
                if len(over):
                    keep = np.ones(len(at), dtype=bool)
                    for p in over.tolist():
                        keep[p] = not keep[p - 1]
                    at = at[keep]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            ids[at] = r
            live[gone], rank_at[gone], rank_at[at] = False, self.NONE, self.NONE
            after[at] = right
            inside = right >= 0
            right, own = right[inside], at[inside]
            before[right] = own
            rank_at[own] = self.lookup(np.int64(r), ids[right])
            left = before[at]
            left = left[left >= 0]
            rank_at[left] = self.lookup(ids[left], np.int64(r))
            touched = np.concatenate([own, left])
            for new, p in zip(rank_at[touched].tolist(), touched.tolist(), strict=True):
                if new < self.NONE:
                    if new in added:
                        added[new].append(p)
                    else:
                        added[new] = [p]
                        heappush(heap, new)
        return ids[live], np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], end])]


@cache
def replay(path: str) -> Replay:
    return Replay(path)


def block_ids(words: list[str], merges: Replay):
    """Ids of each word as little-endian bytes; the finer words that the pattern cuts are encoded once."""
    parts = [[w.encode()] if w.isascii() and (w.isalpha() or w[0] == " " and w[1:].isalpha()) else [x.encode() for x in _PATTERN.findall(w)] for w in words]
    number: dict[bytes, int] = {}
    for ws in parts:
        for w in ws:
            number.setdefault(w, len(number))
    ids, at = merges.encode(list(number))
    raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
    for ws in parts:
        yield b"".join([raw[at[i] : at[i + 1]] for i in map(number.__getitem__, ws)])


class Encoder:
    """Words of texts to their ids; new ones go through :class:`Replay` a block at a time."""

    def __init__(self, path: str):
        self.merges = replay(path)
        self.decimal = list(map(str, range(len(self.merges.token))))
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        token, decimal, listed = self.merges.token, self.decimal, list(words)
        for w, raw in zip(listed, block_ids(listed, self.merges), strict=True):
            ids = np.frombuffer(raw, "<u4").tolist()
            self.known[w] = ",".join([decimal[i] for i in ids]), len(ids), b"".join([token[i] for i in ids])

    def encode(self, texts: list[str]):
        """For each text its words' entries: ids as decimal text, their number, and the bytes they decode to."""
        cut = [_COARSE.findall(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*cut)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for words in cut:
            yield list(map(get, words))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _digests(name: str):
    def run(batches):
        enc = encoder(public_tokenizers.path(name))
        for batch in slices(batches, "text", BLOCK_BYTES):
            n, ids, decoded = [], [], []
            for parts in enc.encode([t or "" for t in batch.column("text").to_pylist()]):
                n.append(sum([p[1] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(name: str):
    def run(batches):
        enc = encoder(public_tokenizers.path(name))
        for batch in slices(batches, "text", BLOCK_BYTES):
            ids = [[int(x) for p in parts for x in p[0].split(",")] for parts in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(name: str):
    def run(batches):
        token = replay(public_tokenizers.path(name)).token
        for batch in batches:
            texts = [None if ids is None else b"".join([token[i] for i in ids]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` for every row; a null or empty text has no ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, decoded)``: the bytes of the ids; null ids give null."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decoded(vocabulary), "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ids of every whole text and the bytes they decode to, as digests."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
