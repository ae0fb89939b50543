"""Best-fit packing of documents into sequences of a fixed number of tokens.

Texts become token counts in one pass.  Pieces and gaps are then handled by
size, of which there are ``CAPACITY`` at most, however many documents there
are: pieces are range-sorted by length, every piece gets its rank among those
of its length, and each superstep sweeps one length, longest first, over the
successors among the open gaps, the tightest gap first.  Pieces of one length
that want the same gaps take them by rank; the gaps that remain go on to the
next superstep.  The supersteps need only the number of pieces of each length,
and leave a table of rank ranges from which each task reads the places of its
own pieces.  This is best-fit decreasing, the same as if one machine had placed
the pieces one by one.  Conflicts over gaps are thus settled by rank within a length only,
and the sweep itself is no Spark job; README says why, with figures.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table
from .textvec import slices

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Distinct chunks that a worker remembers before it starts anew.
MEMORY = 500_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The vocabulary's own split of lower-case text; used on chunks of plain letters, digits and marks only.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SIMPLE = re.compile("[!-~¡-¬®-ÿ]+")


class WordTokenizer:
    """Ids of whole texts as little-endian bytes.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its chunks between white space, which are remembered.  Chunks
    other than plain letters, digits and marks, and those that may hold a
    special token (``<|``), are left to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _model(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], many: int = 512) -> list[bytes]:
        """Ids of single words, many to a call: each word's last token, and no other, is one that ends a word."""
        out: list[bytes] = []
        cut = [words[i : i + many] for i in range(0, len(words), many)]
        for part, e in zip(cut, self.model.encode_batch_fast([" ".join(p) for p in cut], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):
                out += self._model(part)
                continue
            raw, a = ids.tobytes(), 0
            for b in stops.tolist():
                out.append(raw[a:b])
                a = b
        return out

    def learn(self, chunks: set[bytes]) -> None:
        split, other, words = {}, [], set()
        for c in chunks:
            text = c.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(text) and "<|" not in text:
                low = text.lower()
                split[c] = ws = [low] if low.isalpha() else _SPLIT.findall(low)
                words.update(ws)
            else:
                other.append((c, text))
        if len(self.words) + len(words) > MEMORY:
            self.words.clear()
        words = list(words.difference(self.words))
        self.words.update(zip(words, self._words(words), strict=True))
        get = self.words.__getitem__
        for c, ws in split.items():
            self.chunks[c] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))
        self.chunks.update(zip((c for c, _ in other), self._model([t for _, t in other]), strict=True))

    def encode(self, texts: list[bytes]):
        cut = [t.split() for t in texts]
        new = set().union(*cut).difference(self.chunks)
        if len(self.chunks) + len(new) > MEMORY:
            self.chunks.clear()
            self.words.clear()
            new = set().union(*cut)
        if new:
            self.learn(new)
        get = self.chunks.__getitem__
        for chunks in cut:
            yield b"".join(map(get, chunks))


@cache
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def _cut(vocabulary: str, capacity: int):
    def run(batches):
        model = tokenizer(public_tokenizers.path(vocabulary))
        for batch in slices(batches, "text", 4 << 20):
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for i, ids in zip(batch.column("doc_id").to_pylist(), model.encode(texts), strict=True):
                ids += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces; only those longer than ``capacity`` are cut.

    Null and empty texts are one end token.  Rows that repeat an id, and rows
    without one, are documents of their own, each with pieces from 0 on.  A text
    is encoded whole, so a task holds the ids of its longest text.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(vocabulary, capacity), _PIECES)


@dataclass
class Plan:
    """Rank ranges: pieces ``first .. first + count`` of a length go ``fill`` to a sequence, from ``sequence`` on, at ``offset``."""

    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("length", "first", "count", "fill", "sequence", "offset")
        return dict(zip(names, np.array(sorted(self.rows), np.int64).reshape(-1, 6).T, strict=True))


def supersteps(counts: dict[int, int], capacity: int) -> Plan:
    """One superstep for each length, longest first; ``counts`` holds the number of pieces by length."""
    plan = Plan()
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, number)
    sizes: list[int] = []  # sizes in gaps, ascending

    def release(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left, freed = 0, counts[length], []
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first = capacity, plan.sequences
                number = -(-left // (gap // length))
                plan.sequences += number
            fill = gap // length
            full = min(number, left // fill)
            if full:
                plan.rows.append((length, rank, full * fill, fill, first, capacity - gap))
                rank += full * fill
                left -= full * fill
                freed.append((gap - fill * length, first, full))
            if full < number and left:
                plan.rows.append((length, rank, left, left, first + full, capacity - gap))
                freed.append((gap - left * length, first + full, 1))
                left, full = 0, full + 1
            if full < number:
                release(gap, first + full, number - full)
        for x in freed:
            release(*x)
    return plan


def _ranked(batches):
    """Rank of each piece among those of its length in one sorted range."""
    seen: dict[int, int] = {}
    block = TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        new = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
        rank = np.arange(len(length)) - np.repeat(new, np.diff(np.concatenate([new, [len(length)]])))
        rank += np.repeat([seen.get(int(x), 0) for x in length[new]], np.diff(np.concatenate([new, [len(length)]])))
        for i in [*(new[1:] - 1), len(length) - 1]:
            seen[int(length[i])] = int(rank[i]) + 1
        yield batch.append_column("block", pa.array(np.full(len(length), block, np.int32))).append_column("rank", pa.array(rank.astype(np.int64)))


def _placed(plan: dict[str, np.ndarray]):
    key = (plan["length"] << 44) + plan["first"]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth = rank - plan["first"][at]
            fill = plan["fill"][at]
            out = batch.drop_columns(["block", "rank", "before"])
            yield out.append_column("sequence_id", pa.array(plan["sequence"][at] + nth // fill)).append_column("offset", pa.array(plan["offset"][at] + nth % fill * length))

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (at least ``doc_id``, ``piece``, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    An empty table gives an empty one.  Pieces of one length are interchangeable; ties go by ``doc_id`` and ``piece``.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    order = ["length", "doc_id", "piece"]
    ranked = cut.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ranked, schema + ", block int, rank long")
    ranked = materialize(ranked, "ranked")
    blocks = ranked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    blocks = materialize(blocks.withColumn("before", before), "blocks")
    # at most ``capacity`` rows, whatever the input
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = supersteps(counts, capacity)
    placed = ranked.join(blocks.drop("n"), ["length", "block"]).select(*cut.columns, "block", "rank", "before")
    return placed.mapInArrow(_placed(plan.arrays()), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def op5_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_corpus(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents with their places."""
    return pack_documents(docs)
