"""WARC archives in Zstandard, written and read by tasks.

An archive begins with a skippable frame that holds its dictionary; each record
is one frame of its own.  Tasks write to the shared folder, each attempt to a
folder of its own, and only attempts that Spark committed to the manifest are
read.  Archives are closed at ``ARCHIVE_BYTES``, so one fits in a task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, table
from .textvec import slices

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: Payload bytes of a task that its dictionary learns from.
TRAIN_BYTES = 2 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, error string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers and leaves the payload to the record it names."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to learn from, the samples' own beginning."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\r\n\r\n" * 8


class Archive:
    """Frames of one archive, from the dictionary's on."""

    def __init__(self, words: bytes):
        packed = zstd.ZstdCompressor(level=9).compress(words)
        self.parts = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
        self.size = 8 + len(packed)
        self.packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(words), write_checksum=True)

    def add(self, raw: bytes) -> None:
        self.parts.append(self.packer.compress(raw))
        self.size += len(self.parts[-1])


def _write(folder: str):
    def run(batches):
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        own = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        archive, words, held, number = None, None, [], 0

        def close():
            nonlocal archive, number
            store.create_dir(f"{base}/{own}", recursive=True)
            with store.open_output_stream(f"{base}/{own}/{number:06d}.warc.zst", compression=None) as out:
                for part in archive.parts:
                    out.write(part)
            number += 1
            archive = None

        def put(raw):
            nonlocal archive
            if archive is None:
                archive = Archive(words)
            archive.add(raw)
            if archive.size >= ARCHIVE_BYTES:
                close()

        def learn():
            nonlocal words, held
            words = dictionary(held)
            for raw in held:
                put(raw)
            held = []

        learned = 0
        for batch in slices(batches, "payload"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True)
            for page_id, url, payload, refers_to in rows:
                raw = record(page_id, url, payload or b"", refers_to)
                if words is not None:
                    put(raw)
                    continue
                held.append(raw)
                learned += len(raw)
                if learned >= TRAIN_BYTES:
                    learn()
        if held:
            learn()
        if archive is not None:
            close()
        if number:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([number], pa.int32())], names=["part", "archives"])

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages as records: of equal payloads of ``REVISIT_BYTES`` or more, that of the largest page is the response."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    long = F.octet_length("payload") >= REVISIT_BYTES
    equal = pages.where(long).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    # pages that have no copy are spread by their own number, so that they don't share one key
    key = F.when(long, F.sha1("payload")).otherwise(F.concat(F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.sha1("payload")))
    joined = pages.withColumn("digest", key).join(equal, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Archives of a record per row of ``pages`` (``page_id``, ``url``, ``html``); the folders that hold them."""
    manifest = materialize(plan_records(pages).mapInArrow(_write(folder), "part string, archives int"), "manifest")
    return [f"{folder}/{r['part']}" for r in manifest.select("part").distinct().collect()]


class BadRecord(ValueError):
    pass


#: Record types of WARC 1.1; others are errors.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)


def _page_of(urn: str | None) -> int | None:
    """The page that a record's id names; null for ids of other kinds, such as ``urn:uuid``."""
    prefix = "<urn:x-page:"
    number = urn[len(prefix) : -1] if urn and urn.startswith(prefix) and urn.endswith(">") else ""
    return int(number) if number.isascii() and number.lstrip("-").isdigit() else None


def _digest_of(value: str | None) -> bytes | None:
    """SHA-1 of a digest header, in base 32 or hexadecimal; null for none or another algorithm."""
    if value is None:
        return None
    name, _, text = value.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        digest = bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError as e:
        raise BadRecord("digest is not SHA-1") from e
    if len(digest) != 20:
        raise BadRecord("digest is not SHA-1")
    return digest


def frames(data: bytes):
    """Records of an archive, one frame each, decoded with the dictionary of its leading frame; later skippable frames are passed over."""
    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    at = 8 + size
    if at > len(data):
        raise BadRecord("dictionary frame is cut short")
    words = bytes(view[8:at])
    if words[:4] == FRAME_MAGIC:
        words = zstd.ZstdDecompressor().decompress(words)
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words))
    while at < len(data):
        if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] in _SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise BadRecord("skippable frame is cut short")
            continue
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise BadRecord("frame is cut short")
            step = view[at : at + (1 << 16)]
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of one record, its headers, lengths and digests validated.

    All record types of WARC 1.1 are read, with record ids of any kind: ``page_id``
    and ``refers_to`` are null where no page is named.  Digests that are absent or
    of another algorithm than SHA-1 are not compared.  Whatever else is wrong is a
    :class:`BadRecord`.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("header without a colon")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("content-length differs")
    block = rest[:-4]
    kind = fields["warc-type"].lower()
    if kind not in TYPES:
        raise BadRecord("unknown record type")
    if _digest_of(fields.get("warc-block-digest")) not in (None, hashlib.sha1(block).digest()):
        raise BadRecord("block digest differs")
    out = {"page_id": _page_of(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": _page_of(fields.get("warc-refers-to"))}
    digest, payload, size = _digest_of(fields.get("warc-payload-digest")), block, len(block)
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not gap or len(sizes) > 1 or sizes and not sizes[0].isdigit():
            raise BadRecord("no HTTP header")
        size = int(sizes[0]) if sizes else len(payload)
    if kind == "revisit":
        # its payload is that of another record; what the block holds of it is not the whole
        if digest is None:
            raise BadRecord("revisit without a payload digest")
        return out | {"payload_bytes": size, "payload_digest": digest.hex(), "error": None, "payload": None}
    own = hashlib.sha1(payload).digest()
    if size != len(payload) or digest not in (None, own):
        raise BadRecord("payload differs from its length or digest")
    return out | {"payload_bytes": size, "payload_digest": own.hex(), "error": None, "payload": payload}


def _read(with_payload: bool):
    names = ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "error"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                try:
                    for raw in frames(content.as_py()):
                        try:
                            rows.append(parse(raw))
                        except (ValueError, KeyError) as e:
                            rows.append({"error": str(e)})
                        if not with_payload:
                            rows[-1].pop("payload", None)
                        held += len(raw)
                        if held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (ValueError, zstd.ZstdError) as e:
                    rows.append({"error": str(e)})
                yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, folders: list[str], with_payload: bool = False) -> DataFrame:
    """A row per record of the ``*.warc.zst`` files; a bad record or archive is a row with ``error`` set, and the rest is read on."""
    if not folders:
        return spark.createDataFrame([], RECORDS + ", payload binary" * with_payload)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folders)
    return files.select("content").mapInArrow(_read(with_payload), RECORDS + ", payload binary" * with_payload)


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Rows that repeat a page are records of their own; a null ``html`` is an empty payload, a null ``url`` no target."""
    folder = _qualified(spark, fresh_path(spark, "warc"))
    records = read_archives(spark, write_archives(table(spark, sf_dir, "pages"), folder))
    checked = records.select("*", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "error"))).alias("stop"))
    return checked.where("stop is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id,
       strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
       sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM pages)
"""
