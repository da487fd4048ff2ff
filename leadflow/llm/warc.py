"""WARC archives in Zstandard: one frame per record, and a dictionary in a skippable frame at the head of every file.

Tasks write archives of bounded size into a mounted folder; names and contents follow from the partition, and a file appears
whole, so a repeated task replaces its own archives. Reading loads the dictionary, decodes frame after frame and checks version, required
headers, lengths and digests.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes only those with the largest id carry the payload (several, if
that id is repeated); the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import mounted_folder, written

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20  # a new archive is begun after this many compressed bytes
SAMPLE_RECORDS = 200  # the dictionary of an archive is trained on its first payloads, up to this many
SAMPLE_BYTES = 8 << 10  # of each
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
READ_BYTES = 1 << 14

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"


class ArchiveError(ValueError):
    """An archive that does not keep to the format."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head of a response; nothing for other records."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers["WARC-Type"] == "response" else b""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(record_id: int | None) -> str:
    return f"<{ID_PREFIX}{'' if record_id is None else record_id}>"


def _from_uri(value: str) -> int | None:
    if not (value.startswith(f"<{ID_PREFIX}") and value.endswith(">")):
        raise ArchiveError(f"record id {value!r}")
    return int(value[len(ID_PREFIX) + 1 : -1] or 0) if value != f"<{ID_PREFIX}>" else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; the HTTP head of a revisit stands without its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date),
               ("WARC-Target-URI", quote(url or ID_PREFIX, safe=":/?#[]@!$&'()*+,;=%")), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first sample as plain content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (samples or [b""])[0][:DICTIONARY_BYTES] or VERSION.encode()


class ArchiveWriter:
    """Collects the records of one archive: first as samples for the dictionary, then compressed."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.frames: list[bytes] = []
        self.size = self.records = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._compress(record)
            return
        self.waiting.append(record)
        if len(self.waiting) >= SAMPLE_RECORDS or sum(map(len, self.waiting)) >= ARCHIVE_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        content = dictionary_of([r[:SAMPLE_BYTES] for r in self.waiting])
        stored = zstandard.ZstdCompressor(level=LEVEL).compress(content)
        self.frames.append(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored)
        self.size += len(self.frames[-1])
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True, write_checksum=True)
        for record in self.waiting:
            self._compress(record)
        self.waiting = []

    def _compress(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])

    def close(self) -> list[bytes]:
        if not self.compressor:
            self._begin()
        return self.frames


def _parsed(record: bytes, at: int) -> Record:
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", VERSION):
        raise ArchiveError(f"no record head in the frame at byte {at}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"header {line!r} in the frame at byte {at}")
        headers[name] = value.strip()
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise ArchiveError(f"no {', '.join(missing)} in the frame at byte {at}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"length of the record in the frame at byte {at}")
    out = Record(headers, rest[:-4])
    if headers.get("WARC-Block-Digest", _sha1(out.block)) != _sha1(out.block):
        raise ArchiveError(f"block digest in the frame at byte {at}")
    if headers["WARC-Type"] == "response" and headers.get("WARC-Payload-Digest", _sha1(out.payload)) != _sha1(out.payload):
        raise ArchiveError(f"payload digest in the frame at byte {at}")
    return out


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of an archive, one per frame; anything that does not keep to the format is an ``ArchiveError``."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        stored = bytes(view[8 : 8 + size])
        if len(stored) != size:
            raise ArchiveError("dictionary cut off")
        if stored[:4] == FRAME_MAGIC.to_bytes(4, "little"):
            stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
        dictionary, at = zstandard.ZstdCompressionDict(stored), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        begin, frame, parts = at, reader.decompressobj(), []
        try:
            while not frame.eof and at < len(data):
                chunk = view[at : at + READ_BYTES]
                parts.append(frame.decompress(chunk))
                at += len(chunk)
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame at byte {begin}: {error}") from None
        if not frame.eof:
            raise ArchiveError(f"frame at byte {begin} is cut off")
        at -= len(frame.unused_data)
        yield _parsed(b"".join(parts), begin)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, refers_to, revisit`` of every row; a null html is empty. Only digests are grouped, not pages."""
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("n"))
    first = (rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
             .filter((F.col("copies") > 1) & F.col("refers_to").isNotNull()).drop("copies"))
    joined = rows.join(written(first, "payloads"), ["digest", "n"], "left")
    return joined.select("page_id", "url", "html", "refers_to", (F.col("refers_to").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))).alias("revisit"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the planned records; ``name, records, bytes`` of every archive. Runs when called."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, archive, done = TaskContext.get().partitionId(), 0, ArchiveWriter(), []

        def close(archive: ArchiveWriter) -> dict:
            name = f"{part:06d}-{number:04d}.warc.zst"
            temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
            with open(temporary, "wb") as out:
                out.writelines(archive.close())
            os.replace(temporary, os.path.join(folder, name))
            return {"name": name, "records": archive.records, "bytes": archive.size}

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                archive.add(record_bytes(page_id, url, html.encode(), refers_to, revisit, date))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(close(archive))
                    archive, number = ArchiveWriter(), number + 1
        if archive.records:
            done.append(close(archive))
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    ordered = records.select("page_id", "url", "html", "refers_to", "revisit").sortWithinPartitions("page_id", "url")
    return written(ordered.mapInArrow(write, "name string, records long, bytes long"), "archives")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("target", pa.string())])


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record of all archives in the folder, read by Spark as whole files of bounded size."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in read_archive(content.as_py()):
                    headers, kind = record.headers, record.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append({"page_id": _from_uri(headers["WARC-Record-ID"]), "record_type": kind, "refers_to": _from_uri(headers["WARC-Refers-To"]) if kind == "revisit" else None,
                                 "payload_digest": digest, "payload_bytes": len(record.payload) if kind == "response" else None, "target": headers.get("WARC-Target-URI")})
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(f"file://{folder}")
    return files.select("content").mapInArrow(read, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, target string")


def resolve(records: DataFrame) -> DataFrame:
    """Gives revisit records the payload size of the response they refer to."""
    responses = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("referred"))
    whole = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(responses, ["refers_to", "payload_digest"], "left").withColumnRenamed("referred", "payload_bytes")
    return whole.unionByName(revisits)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every row as a record and reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    An empty table gives no archives and no rows. Rows without id are records without a number; they are never referred to."""
    spark = pages.sparkSession
    folder = mounted_folder(spark, "warc")
    write_archives(plan_records(pages, page_id, url, html), folder)
    return resolve(written(read_archives(spark, folder), "records")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
