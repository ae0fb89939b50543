"""Removal of passages that repeat, by a sparse suffix array over range partitions.

A byte goes when a string of ``MATCH`` bytes that covers it also starts
earlier.  Only suffixes at *anchors* are sorted: an anchor is the smallest
hashed ``GRAM``-byte string of some window of ``MATCH`` bytes, so equal windows
hold the same anchor at the same place, and about three suffixes in a hundred
bytes represent all of them.

1. Each text lists its anchors with hashes of their surroundings (128 bits);
   buckets by the anchor's string find those whose whole surroundings occur
   earlier (all their bytes go) and those that share only a part with another
   one.  Copies inside one batch are told apart before the shuffle, and only the
   first of them goes on to the bucket.
2. The suffixes of the latter, with the text before them, are dealt into ranges
   by their leading bytes with sampled splitters.  A range sorts them locally by
   multikey quicksort on eight-byte keys, forwards and backwards, and reads runs
   of equal windows from the common prefixes of neighbours.
3. Windows in the runs at either end of a range may go on in the next range.
   The first ones of such runs are compared across the boundaries: their anchors
   are dealt once more, by the text before them, and what still touches an end
   is compared by hashes of the windows.
4. The intervals meet the texts again, by document.

A document is a row's id and text: rows with one id and unlike texts are
documents of their own, in an order fixed by their texts; rows that repeat both
are one document.  Rows without an id come after all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, small_batches, table
from .textvec import release, slices, strings

MATCH, GRAM = 100, 32
#: Starts of windows that can hold one anchor; bytes before an anchor that matter.
SPAN = MATCH - GRAM + 1
BEFORE = SPAN - 1
#: A window keeps HALF bytes before its anchor at most, or HALF at least.
HALF = BEFORE // 2
#: Buckets for each shuffle partition.
BUCKETS = 8
#: Columns beside those of the documents, named so that they clash with none.
SPANS, CUT, DOC, KEY = "strataforge_spans", "strataforge_cut", "strataforge_doc", "strataforge_key"
#: Bytes of texts that a task lists anchors of at a time; longer texts are cut, with an overlap that no anchor can see beyond.
PART, OVERLAP = 1 << 19, 2 * MATCH
_RNG = np.random.Generator(np.random.PCG64(31337))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CHARS = _RNG.integers(0, 2**64, size=(len(_BASES), 256), dtype=np.uint64)
#: ``text`` and ``more`` are two hashes of the surroundings; ``gone`` entries have an earlier copy in their own batch.
_ENTRY = np.dtype([("text", "<u8"), ("more", "<u8"), ("right", "<u4"), ("left", "<u4"), ("doc", "<i8"), ("key", "<u8"), ("pos", "<u4"), ("gone", "u1")])


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in self.bases)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` over each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = reduce(x[:-step], x[step:])
        done += step
    return x


def _sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums that give hashes of any substring."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CHARS[which][data] * _POWERS[which].get(n + 1)[0][:n], out=sums[1:])
    return sums


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in ``data``, the hash of each anchor's string, and the running sums."""
    n, sums = len(data), _sums(data)
    down = _POWERS[0].get(n + 1)[1]
    if n < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = _sliding(gram, SPAN, np.minimum)
    stop = np.repeat(at[1:], np.diff(at))[: len(low)]
    low[np.arange(len(low)) + MATCH > stop] = 0
    # an anchor equals the minimum of one of the windows that hold it
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)])
    high = _sliding(padded, SPAN, np.maximum)
    where = np.flatnonzero((high == gram) & (gram != 0))
    return where, gram[where], sums


def _substring(sums: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    return (sums[b] - sums[a]) * _POWERS[which].get(len(sums))[1][a]


def _parts(batch: pa.RecordBatch):
    """Stretches of texts of about ``PART`` bytes: their bytes, offsets, and by stretch the row, the place in its text, and the range of anchors that count."""
    data, at = strings(batch.column("text"))
    held, size = [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for lo in range(a, b, PART):
            hi = min(lo + PART, b)
            held.append((row, max(a, lo - OVERLAP), min(b, hi + OVERLAP), lo, hi, a))
            size += hi - lo
            if size >= PART:
                yield _stretch(data, held)
                held, size = [], 0
    if held:
        yield _stretch(data, held)


def _stretch(data: np.ndarray, held: list):
    row, begin, end, lo, hi, first = np.array(held, np.int64).T
    size = end - begin
    whole = np.array_equal(begin[1:], end[:-1])
    cut = data[begin[0] : end[-1]] if whole else np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return cut, np.concatenate([[0], np.cumsum(size)]), row, begin - first, lo - begin, hi - begin


def _order(entries: np.ndarray) -> np.ndarray:
    """Order by surroundings, document and place."""
    return np.lexsort((entries["pos"], entries["key"], entries["doc"], entries["more"], entries["text"]))


def _starts(entries: np.ndarray) -> np.ndarray:
    """Where new surroundings begin among ordered entries."""
    new = np.ones(len(entries), dtype=bool)
    new[1:] = (entries["text"][1:] != entries["text"][:-1]) | (entries["more"][1:] != entries["more"][:-1])
    return new


def _later(entries: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Entries other than the first place of their surroundings."""
    first = entries[new][np.cumsum(new) - 1]
    return (entries["doc"] != first["doc"]) | (entries["key"] != first["key"]) | (entries["pos"] != first["pos"])


def _list(buckets: int):
    def run(batches):
        for batch in slices(batches, "text", PART):
            ids, keys = batch.column(DOC).to_numpy(), batch.column(KEY).to_numpy().view(np.uint64)
            for data, at, row, place, lo, hi in _parts(batch):
                where, gram, sums = anchors(data, at)
                part = np.searchsorted(at, where, "right") - 1
                own = (where - at[part] >= lo[part]) & (where - at[part] < hi[part])
                where, gram, part = where[own], gram[own], part[own]
                if not len(where):
                    continue
                begin, end = at[part], at[part + 1]
                a, b = np.maximum(begin, where - BEFORE), np.minimum(end, where + MATCH)
                shape = ((where - a) * 1009 + (b - where)).astype(np.uint64)
                out = np.zeros(len(where), _ENTRY)
                out["text"] = _mixed(_substring(sums, a, b) + shape)
                out["more"] = _mixed(_substring(_sums(data, 1), a, b, 1) + shape)
                far, near = where + MATCH - HALF, where - HALF
                out["right"] = np.where(far <= end, _mixed(_substring(sums, where, np.minimum(far, end))) >> np.uint64(32) | np.uint64(1), 0)
                out["left"] = np.where(near >= begin, _mixed(_substring(sums, np.maximum(near, begin), where + GRAM)) >> np.uint64(32) | np.uint64(1), 0)
                out["doc"], out["key"], out["pos"] = ids[row[part]], keys[row[part]], where - begin + place[part]
                order = _order(out)
                out, gram = out[order], gram[order]
                out["gone"] = _later(out, _starts(out))
                # copies are spread, and wait for nothing in their bucket
                spread = _mixed(out["text"] ^ out["key"] ^ out["pos"])
                bucket = (np.where(out["gone"], spread, gram) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                out, bucket = out[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                edges = np.concatenate([[0], cuts, [len(out)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[:-1]]), pa.array([out[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["bucket", "entries"]
                )

    return run


def _shared(key: np.ndarray) -> np.ndarray:
    """Whether another entry has the same key; key 0 stands for none."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = (s[1:] == s[:-1]) & (s[1:] != 0)
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def resolve(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: entries whose surroundings occur earlier, and first ones that share a part with others."""
    gone, entries = entries[entries["gone"] == 1], entries[entries["gone"] == 0]
    entries = entries[_order(entries)]
    new = _starts(entries)
    one = entries[new]
    return np.concatenate([gone, entries[_later(entries, new)]]), one[_shared(one["right"]) | _shared(one["left"])]


def _resolve(batches):
    def made(parts):
        gone, open_ones = resolve(np.concatenate(parts))
        both = np.concatenate([gone, open_ones])
        kind = np.concatenate([np.zeros(len(gone), bool), np.ones(len(open_ones), bool)])
        return pa.RecordBatch.from_arrays([pa.array(both["doc"]), pa.array(both["key"].astype(np.int64)), pa.array(both["pos"].astype(np.int32)), pa.array(kind)], names=[DOC, KEY, "pos", "open"])

    now, parts = None, []
    for batch in batches:
        for bucket, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries"), strict=True):
            if bucket != now and parts:
                yield made(parts)
                parts = []
            now = bucket
            parts.append(np.frombuffer(entries.as_buffer(), _ENTRY).copy())
    if parts:
        yield made(parts)
    del parts
    release()


def _surroundings(batches):
    for batch in slices(batches, "text"):
        doc, key, pos, after, before = [], [], [], [], []
        for i, j, text, places in zip(batch.column(DOC).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), strict=True):
            for p in places:
                doc.append(i)
                key.append(j)
                pos.append(p)
                after.append(text[p : p + MATCH])
                before.append(text[max(0, p - BEFORE) : p][::-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(pos, pa.int32()), pa.array(after, pa.binary()), pa.array(before, pa.binary())], names=[DOC, KEY, "pos", "after", "before"])


def _padded(values: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as a matrix of big-endian eight-byte keys, and their lengths."""
    data, at = strings(values)
    size = np.diff(at)
    out = np.zeros((len(size), -(-width // 8) * 8), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - at[row]] = data
    return out.view(">u8").astype(np.uint64), size


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and for each but the first the bytes it shares with the one before.

    Rows are parted by one eight-byte key at a time; only runs that are still
    equal go on to the next key.
    """
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    common = np.zeros(max(n - 1, 0), np.int64)
    tied = np.ones(max(n - 1, 0), dtype=bool)
    for c in range(width):
        if c:
            inside = np.zeros(n, dtype=bool)
            inside[1:] |= tied
            inside[:-1] |= tied
            at = np.flatnonzero(inside)
            if not len(at):
                break
            run = np.cumsum(np.concatenate([[True], ~tied]))[at]
            order[at] = order[at][np.lexsort((keys[order[at], c], run))]
        a, b = keys[order[:-1][tied], c], keys[order[1:][tied], c]
        differ = (a ^ b)[:, None].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        common[tied] += np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        tied[tied] = a == b
    return order, common


def _runs(order: np.ndarray, common: np.ndarray, need: int) -> tuple[np.ndarray, int]:
    """Number of the run with ``need`` equal bytes that each row is in, and the last number."""
    number = np.concatenate([[0], np.cumsum(common < need)])
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out, int(number[-1])


def _window(after: np.ndarray, before: np.ndarray, off: int) -> bytes:
    return hashlib.blake2b(before[:off][::-1].tobytes() + after[: MATCH - off].tobytes(), digest_size=16).digest()


_FOUND = f"{DOC} long, {KEY} long, begin long, end long, window binary, pos int, after binary, before binary, offs binary"


def _sorted_range(forwards: bool):
    """Equal windows of one range, sorted by the text from the anchor on, or before it.

    Yields intervals of windows that occur earlier in the range.  The first
    window of a run that touches an end of the range may still have an equal in
    another range: forwards such anchors are passed on whole, with the places of
    their open windows (``offs``), to be sorted by the text before them;
    backwards the few that are left become hashes (``window``).
    """

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([(DOC, "ascending"), (KEY, "ascending"), ("pos", "ascending")]).combine_chunks()
        del rows
        doc, key, pos = (t.column(c).to_numpy() for c in (DOC, KEY, "pos"))
        # rows that repeat an id and a text have equal suffixes, which meet in one range: they count once
        one = np.ones(len(doc), dtype=bool)
        one[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        if not one.all():
            t = t.filter(pa.array(one)).combine_chunks()
            doc, key, pos = doc[one], key[one], pos[one]
        pos = pos.astype(np.int64)
        after, n_after = _padded(t.column("after"), MATCH)
        before, n_before = _padded(t.column("before"), BEFORE)
        (ahead, common_ahead), (back, common_back) = multikey_sort(after), multikey_sort(before)
        m = len(doc)
        asked = np.ones((m, SPAN), dtype=bool)
        if not forwards:
            asked = np.unpackbits(strings(t.column("offs"))[0].reshape(m, -1), axis=1)[:, :SPAN].astype(bool)
        gone, held = np.zeros((m, SPAN + 2), dtype=bool), np.zeros((m, SPAN), dtype=bool)
        for off in range(SPAN):
            live = np.flatnonzero((n_after >= MATCH - off) & (n_before >= off) & asked[:, off])
            if not len(live):
                continue
            runs = _runs(ahead, common_ahead, MATCH - off), _runs(back, common_back, off)
            both = runs[0][0][live] * m + runs[1][0][live]
            order = np.argsort(both, kind="stable")
            again = np.zeros(len(live), dtype=bool)
            again[1:] = np.diff(both[order]) == 0
            who = live[order]
            gone[who[again], off + 1] = True
            number, last = runs[0] if forwards else runs[1]
            first = who[~again]
            held[first[(number[first] == 0) | (number[first] == last)], off] = True
        change = np.diff(gone.astype(np.int8), axis=1)
        (r0, o0), (_, o1) = np.nonzero(change == 1), np.nonzero(change == -1)
        none = lambda n, kind: pa.nulls(n, kind)
        names = [DOC, KEY, "begin", "end", "window", "pos", "after", "before", "offs"]
        k = len(r0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[r0]), pa.array(key[r0]), pa.array(pos[r0] - (o1 - 1)), pa.array(pos[r0] - o0 + MATCH), none(k, pa.binary()), none(k, pa.int32()), none(k, pa.binary()), none(k, pa.binary()), none(k, pa.binary())], names=names)
        if forwards:
            on = np.flatnonzero(held.any(axis=1))
            k = len(on)
            part = t.take(pa.array(on)).combine_chunks()
            column = lambda n: part.column(n).combine_chunks() if k else none(0, part.schema.field(n).type)
            packed = [x.tobytes() for x in np.packbits(held[on], axis=1)]
            yield pa.RecordBatch.from_arrays([column(DOC), column(KEY), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), column("pos"), column("after"), column("before"), pa.array(packed, pa.binary())], names=names)
            return
        oi, oo = np.nonzero(held)
        k = len(oi)
        bytes_after, bytes_before = (x.astype(">u8").view(np.uint8).reshape(m, -1) for x in (after, before))
        windows = [_window(bytes_after[i], bytes_before[i], o) for i, o in zip(oi.tolist(), oo.tolist(), strict=True)]
        begin = pos[oi] - oo
        yield pa.RecordBatch.from_arrays([pa.array(doc[oi]), pa.array(key[oi]), pa.array(begin), pa.array(begin + MATCH), pa.array(windows, pa.binary()), none(k, pa.int32()), none(k, pa.binary()), none(k, pa.binary()), none(k, pa.binary())], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells its documents apart: the id (rows without one last) and a hash of the text."""
    return docs.withColumn(DOC, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit(""))))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """``(DOC, KEY, begin, end)``: byte intervals whose every byte is in a window that also starts earlier; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _keyed(docs).select(DOC, KEY, F.coalesce("text", F.lit("")).alias("text"))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = docs.mapInArrow(_list(buckets), "bucket int, entries binary")
    anchored = materialize(listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, f"{DOC} long, {KEY} long, pos int, open boolean"), "anchors")
    whole = anchored.where("not open").select(DOC, KEY, (F.col("pos") - BEFORE).cast("long").alias("begin"), (F.col("pos") + MATCH).cast("long").alias("end"))
    places = anchored.where("open").groupBy(DOC, KEY).agg(F.collect_set("pos").alias("places"))
    suffixes = materialize(docs.join(places, [DOC, KEY]).mapInArrow(_surroundings, f"{DOC} long, {KEY} long, pos int, after binary, before binary"), "suffixes")
    place = [DOC, KEY, "pos"]
    found = materialize(suffixes.repartitionByRange("after", "before", *place).mapInArrow(_sorted_range(True), _FOUND), "windows")
    discard(suffixes)
    onward = found.where("offs is not null").select(*place, "after", "before", "offs")
    across = materialize(onward.repartitionByRange("before", "after", *place).mapInArrow(_sorted_range(False), _FOUND), "windows-across")
    found = found.where("offs is null").unionByName(across)
    edges = found.where("window is not null")
    first = materialize(edges.groupBy("window").agg(F.min(F.struct(DOC, KEY, "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
    interval = [DOC, KEY, "begin", "end"]
    crossing = edges.join(first, "window").where(F.struct(DOC, KEY, "begin") != F.col("first")).select(*interval)
    return whole.unionByName(found.where("window is null").select(*interval)).unionByName(crossing)


def _merged(size: int, spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals, cut to the text."""
    spans = np.clip(spans, 0, size)
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(spans[1:, 0] > reach[:-1]) + 1
    begins = spans[np.concatenate([[0], new]), 0]
    ends = reach[np.concatenate([new - 1, [len(spans) - 1]])]
    return list(zip(begins.tolist(), ends.tolist(), strict=True))


def _spans(batch: pa.RecordBatch):
    at = batch.column(SPANS)
    for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        text = text or b""
        spans = at[i].values if at[i].is_valid else None
        if spans is None or not len(spans):
            yield text, []
        else:
            yield text, _merged(len(text), np.stack([spans.field("begin").to_numpy(), spans.field("end").to_numpy()], axis=1))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    begins = [0, *(b for _, b in spans)]
    ends = [*(a for a, _ in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(begins, ends, strict=True))


def _digest(batches):
    for batch in slices(batches, "text"):
        rows = [(len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_without(text, spans)).hexdigest()) for text, spans in _spans(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(batches):
    for batch in slices(batches, "text"):
        rows = [(_without(text, spans).decode("utf-8", "ignore"), bool(spans)) for text, spans in _spans(batch)]
        out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([r[0] for r in rows], pa.string()))
        yield out.drop_columns([SPANS]).append_column(CUT, pa.array([r[1] for r in rows], pa.bool_()))


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = repeated_intervals(docs).groupBy(DOC, KEY).agg(F.collect_list(F.struct("begin", "end")).alias(SPANS))
    return _keyed(docs).join(spans, [DOC, KEY], "left").drop(DOC, KEY)


def removed(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have no bytes; texts under 100 bytes stay whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_array(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts; documents of which nothing stays go too.

    A character that a cut divides goes whole.  ``n_chars`` follows the text.
    Rows without an id, and rows with one id and unlike texts, are documents
    like others; rows that repeat an id and a text are one, and all stay.
    """
    joined = _with_spans(docs).select(*docs.columns, SPANS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {CUT} boolean"
    cut = joined.mapInArrow(_cut, schema).where(f"not {CUT} or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(CUT), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)
