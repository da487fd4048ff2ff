import gzip
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from leadflow.llm import warc

from .conftest import CLASHING

DATE = "2024-01-01T00:00:00Z"


def archive(payloads):
    out = warc.ArchiveWriter()
    for i, p in enumerate(payloads):
        out.add(warc.record_bytes(i, f"http://x/{i}", p, None, False, DATE))
    return b"".join(out.close())


def test_archives_hold_a_dictionary_and_one_frame_per_record(monkeypatch):
    payloads = [f"<html><body>page {i} {'text ' * (i % 40)}</body></html>".encode() for i in range(500)] + [b"", b"\r\n\r\n" * 5, bytes(range(256)) * 400]
    data = archive(payloads)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    records = list(warc.read_archive(data))
    assert [r.payload for r in records] == payloads
    size = int.from_bytes(data[4:8], "little")
    frames, at = 0, 8 + size
    content = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]))
    while at < len(data):
        frame = zstandard.ZstdDecompressor(dict_data=content).decompressobj()
        frame.decompress(data[at:])
        at, frames = len(data) - len(frame.unused_data), frames + 1
    assert frames == len(payloads)


def test_plain_dictionaries_and_archives_without_one():
    record = warc.record_bytes(4, "http://x", b"abc" * 50, None, False, DATE)
    raw = b"HTTP/1.1 200 OK WARC-Type response"
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    head = warc.SKIPPABLE_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    assert next(warc.read_archive(head + frame)).payload == b"abc" * 50
    assert next(warc.read_archive(zstandard.compress(record))).headers["WARC-Record-ID"] == "<urn:page:4>"
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Date", b"WARC-Data"), lambda r: r + b"x", lambda r: r[:-1],
                                    lambda r: r.replace(b"payload", b"paYload"), lambda r: r.replace(b"Content-Length: 9", b"Content-Length: -"), lambda r: b"", lambda r: r + r])
def test_bad_records_are_errors(change):
    record = warc.record_bytes(1, "http://x", b"the payload", None, False, DATE)
    bad = change(record)
    assert bad != record
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(zstandard.compress(bad)))


def test_cut_or_foreign_files_are_errors():
    data = archive([b"x" * 5000] * 20)
    for bad in (data[:-3], data[: len(data) // 2], data[:6] + data[7:], gzip.compress(b"no"), data + b"junk"):
        with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


def test_round_trip_of_tables(llm, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 3)
    rows = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, "u", "x" * 1500), (3, "u", "x" * 1500), (4, "u\r\nX: y é", "y" * 999), (5, "u", "y" * 999), (6, None, None), (7, "u", ""), (None, "u", "x" * 1500),
            (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "long " * 200_000)] + [(100 + i, "u", f"page {i} " * 40) for i in range(200)]
    df = llm.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and largest[h or ""] != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h or ""] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
