"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle: records are grouped into frames that are compressed on their own, and a
seek table of the frames' sizes stands in a skippable frame at the end, so that one record is read
by its frame alone, and a plain Zstandard reader still reads the whole. The index maps a record's
identifier to bundle, frame and offset in the frame. A payload that another record holds is not
written again: such a record is a revisit, with the payload's digest and length in its head.

A bundle's name has the task attempt in it, and the index, which Spark commits, names the bundles
that count: what a lost executor or a repeated attempt has left is never read.

Defined cases. A null payload is empty. Payloads under `least_revisit` bytes are always written. Of
equal larger ones that with the largest page_id is the response; if rows share that id, each of them
is. A null page_id is below all others; among null ids alone, each is a response. A null URL gives a
record without target; control characters in a URL are percent-encoded. An empty table gives no bundle. Only page_id, url and html are read."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FRAME_BYTES = 1 << 18
LEAST_REVISIT = 1000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CONTROLS = re.compile(r"[\x00-\x1f\x7f]")
INDEX = "page_id long, record_type string, bundle string, frame long, offset long, length long"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with record_type and refers_to. The payloads that are equal are found
    on slim rows; a payload with very many copies only meets in a combinable maximum."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = F.octet_length("html") >= least_revisit
    held = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").select("digest", "holder")
    of = large & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.join(held, "digest", "left").select("page_id", "url", "html", "digest", F.when(of, "revisit").otherwise("response").alias("record_type"), F.when(of, F.col("holder")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    own = record.strip("<>").removeprefix("urn:page:") if record else "none"
    return None if own == "none" else int(own)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """One seekable bundle; add() gives the frame and the offset in it of each record."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.open, self.frames = bytearray(), []

    def add(self, record: bytes) -> tuple[int, int]:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.frames), len(self.open)
        self.open += record
        return at

    def flush(self) -> None:
        packed = self.compressor.compress(bytes(self.open))
        self.sink.write(packed)
        self.frames.append((len(packed), len(self.open)))
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Reads frames of a bundle by their number."""

    def __init__(self, source):
        import zstandard
        self.source, self.plain = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("the bundle has no seek table")
        table = self._read(size - 9 - 8 * n, 8 * n)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        return self.plain.decompress(self._read(self.starts[k], self.sizes[k][0]), max_output_size=self.sizes[k][1])

    def __len__(self) -> int:
        return len(self.sizes)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at `at`: its head, its payload, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    block = data[start:stop]
    http, _, payload = block.partition(b"\r\n\r\n")
    head["payload-length"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
    return head, payload, stop + 4


def _files(uri: str):
    """pyarrow's file system of a URI, and the path in it: shared folders need not be local."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, date: str = "2000-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) to bundles in `folder`; returns the
    index: (page_id, record_type, bundle, frame, offset, length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        out = name = None
        for rows in batches:
            places = []
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in rows.columns)):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    out = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                record = record_bytes(page_id, url, html.encode(), digest, kind, refers_to, date)
                places.append((page_id, kind, name, *out.add(record), len(record)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in places], f.type) for i, f in enumerate(INDEX_ARROW)], schema=INDEX_ARROW)
        if out is not None:
            out.close()

    planned = plan_records(pages, least_revisit).select("page_id", "url", "html", "digest", "record_type", "refers_to")
    return scratch.save(planned.mapInArrow(run, INDEX), "index")


def _rows(found: list[tuple[dict, bytes]]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for head, payload in found:
        revisit = head["WARC-Type"] == "revisit"
        url = head.get("WARC-Target-URI")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
        for column, x in zip(columns, (page_of(head["WARC-Record-ID"]), url, None if revisit else payload, int(head["payload-length"]) if revisit else len(payload), digest, head["WARC-Type"], page_of(head.get("WARC-Refers-To")))):
            column.append(x)
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in READ.split(", ")])


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names, frame by frame: READ, the payload of a revisit
    being null and its length and digest those in its head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        for rows in batches:
            for name in rows.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as source:
                    reader = BundleReader(source)
                    for k in range(len(reader)):
                        data, at, found = reader.frame(k), 0, []
                        while at < len(data):
                            head, payload, at = parse(data, at)
                            found.append((head, payload))
                        yield _rows(found)

    bundles = index.select("bundle").distinct()
    spread = bundles.repartition(max(1, bundles.count()))  # a task for each bundle
    return spread.mapInArrow(run, READ)


def fetch(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """The records of page_ids(page_id) alone, each from its frame by the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        last, data, source, reader = (None, None), b"", None, None
        for rows in batches:
            for name, frame, offset in zip(*(c.to_pylist() for c in rows.columns)):
                if (name, frame) != last:
                    if name != last[0]:
                        source = system.open_input_file(f"{path}/{name}")
                        reader = BundleReader(source)
                    data, last = reader.frame(frame), (name, frame)
                yield _rows([parse(data, offset)[:2]])

    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    return wanted.select("bundle", "frame", "offset").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, READ)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads all of them back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.new_path("bundles")
    return read_warc(write_warc(pages, folder, scratch), folder)
