"""WARC in seekable Zstandard bundles.

Every task writes one bundle: its records stand in independent Zstandard frames of
about ``FRAME_BYTES``, and a skippable frame at the end holds the seek table of the
public seekable format (sizes and checksum of each frame).  An index maps record ids
to a file, a frame and the place in that frame, so one record costs one frame.
Equal payloads are stored once: the other records are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt, fresh_path, materialise, reading, store

FRAME_BYTES = 256 * 1024
#: Fixed values of the seekable format: skippable frame, footer, and the flag for checksums.
SKIPPABLE, FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed values of WARC 1.1.
VERSION, REVISIT = b"WARC/1.1\r\n", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, file string, frame int, offset long, length long"
RECORD = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record around an HTTP response; with ``refers_to`` a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = [VERSION, b"WARC-Type: ", b"revisit" if refers_to else b"response", b"\r\nWARC-Record-ID: <", record_id.encode(), b">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:", digest, b"\r\n"]
    if url:
        head += [b"WARC-Target-URI: ", url.replace("\r", "%0D").replace("\n", "%0A").encode(), b"\r\n"]
    if refers_to:
        head += [b"WARC-Refers-To: <", refers_to.encode(), b">\r\nWARC-Profile: ", REVISIT, b"\r\n"]
    block = http if refers_to else http + payload
    return b"".join([*head, b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def parse(data: memoryview | bytes, at: int = 0) -> tuple[dict[bytes, bytes], dict[bytes, bytes], bytes, int]:
    """WARC fields, HTTP fields and payload of the record at ``at``, and where the next one begins."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.index(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at):
        raise ValueError("no WARC record here")
    fields = dict(line.split(b": ", 1) for line in data[at + len(VERSION) : end].split(b"\r\n"))
    begin, size = end + 4, int(fields[b"Content-Length"])
    body = data.index(b"\r\n\r\n", begin) + 4
    http = dict(line.split(b": ", 1) for line in data[begin : body - 4].split(b"\r\n")[1:])
    return fields, http, data[body : begin + size], begin + size + 4


def seek_table(f) -> list[tuple[int, int, int, int]]:
    """``(position, compressed, decompressed, checksum)`` of every frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != FOOTER or flags & 0x7C:
        raise ValueError("no seek table at the end")
    width = 12 if flags & CHECKSUMS else 8
    f.seek(size - 9 - n * width - 8)
    if struct.unpack("<II", f.read(8)) != (SKIPPABLE, n * width + 9):
        raise ValueError("damaged seek table")
    at, out = 0, []
    for i, entry in enumerate(struct.iter_unpack(f"<{width // 4}I", f.read(n * width))):
        out.append((at, *entry) if width == 12 else (at, *entry, -1))
        at += entry[0]
    return out


def _frame(f, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = entry
    f.seek(at)
    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=max(size, 1))
    if len(data) != size or check >= 0 and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum is wrong")
    return data


def write(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Write ``records(record_id, url, payload, refers_to)`` to bundles in ``folder``; the stored index is returned.

    Null urls are left out, a null payload is empty, repeated ids are records of their own.
    No rows give no bundle and an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        index: list[tuple] = []
        table: list[bytes] = []
        press = zstandard.ZstdCompressor(level=level)

        def packed(frame: list[bytes]) -> bytes:
            raw = b"".join(frame)
            out = press.compress(raw)
            table.append(struct.pack("<III", len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            return out

        def chunks(first: pa.RecordBatch) -> Iterator[bytes]:
            frame, size = [], 0
            for batch in chain([first], batches):
                for i, url, payload, refers in zip(*(batch.column(n) for n in ("record_id", "url", "payload", "refers_to")), strict=True):
                    made = record(i.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py())
                    index.append((i.as_py(), uri, len(table), size, len(made)))
                    frame.append(made)
                    size += len(made)
                    if size >= frame_bytes:
                        yield packed(frame)
                        frame, size = [], 0
            if frame:
                yield packed(frame)
            seek = b"".join(table)
            yield struct.pack("<II", SKIPPABLE, len(seek) + 9) + seek + struct.pack("<IBI", len(table), CHECKSUMS, FOOTER)

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            store(uri, chunks(first))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "file", "frame", "offset", "length"])

    return materialise(records.select("record_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def _as_rows(found: list[tuple], payloads: bool) -> pa.RecordBatch:
    """Rows of RECORD from parsed records; every stored payload is held against its digest."""
    rows = []
    for fields, http, payload, _ in found:
        digest = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:"))
        kind = fields[b"WARC-Type"]
        if kind == b"response" and hashlib.sha1(payload).digest() != digest:
            raise ValueError("a payload's digest is wrong")
        refers, url = fields.get(b"WARC-Refers-To"), fields.get(b"WARC-Target-URI")
        rows.append((fields[b"WARC-Record-ID"][1:-1].decode(), kind.decode(), refers and refers[1:-1].decode(), url and url.decode(), int(http[b"Content-Length"]), digest.hex(), *([payload] if payloads else [])))
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (6 + payloads)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the bundles that ``files(file)`` names: rows of RECORD, with ``payloads`` a further column ``payload``.

    Seek tables deal the frames out over tasks, so a large bundle is read by many.
    A revisit has an empty payload; its ``payload_bytes`` are those of the full one.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with reading(uri) as f:
                    table = seek_table(f)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(table), pa.string()), *(pa.array(c, pa.int64()) for c in (list(zip(*table, strict=True)) or [[]] * 4))], names=["file", "at", "packed", "size", "check"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, *entry in sorted(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                with reading(uri) as f:
                    data = _frame(f, tuple(entry))
                found, at = [], 0
                while at < len(data):
                    found.append(parse(data, at))
                    at = found[-1][3]
                yield _as_rows(found, payloads)

    entries = materialise(files.select("file").distinct().mapInArrow(frames, "file string, at long, packed long, size long, check long"), "frames")
    n, total = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return dealt(entries, n, total, "file", "at").mapInArrow(records, RECORD + ", payload binary" * payloads)


def fetch(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of a stored index name: rows of RECORD, with ``payloads`` a further column ``payload``.

    Every record is cut from its own frame at the place that the index says; rows of a frame are
    dealt to one task, which decompresses it once.  A record under another id than the index's fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data, table = (None, None), b"", []
        for batch in batches:
            found = []
            for name, uri, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (uri, frame):
                    with reading(uri) as f:
                        table = table if last[0] == uri else seek_table(f)
                        data, last = _frame(f, table[frame]), (uri, frame)
                one = parse(data[offset : offset + length])
                if one[0][b"WARC-Record-ID"] != f"<{name}>".encode():
                    raise ValueError(f"the index names {name} where another record stands")
                found.append(one)
                if len(found) >= 256:
                    yield _as_rows(found, payloads)
                    found = []
            yield _as_rows(found, payloads)

    rows = index.select("record_id", "file", "frame", "offset", "length")
    n, total = rows.agg(F.count_distinct("file", "frame"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return dealt(rows, n, total, "file", "frame").sortWithinPartitions("file", "frame", "offset").mapInArrow(run, RECORD + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, least: int = 1000, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Write a record per page; the index and the folder of the bundles.

    Of pages with equal payloads of at least ``least`` bytes, the largest id is stored
    (every row that has it, if rows repeat); the others, null ids too, revisit it.  A null
    payload is empty.  Where no row of equal payloads has an id, all are stored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    shared = materialise(rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    found = rows.join(shared, ["digest", "bytes"], "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), uri("kept"))
    return write(found.select(uri("id").alias("record_id"), "url", "payload", refers.alias("refers_to")), folder), folder
