"""Shared by the operators: session settings, registered queries, shared folders, word hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.session import pin, shared_folder

# Texts go to Python in batches of bounded size, whatever the length of a row.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    pin(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin if there is one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, and is read by column."""
    path = f"{shared_folder(df.sparkSession)}/leadflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that tasks open as files; the shared folder must be mounted on all machines."""
    parsed = urlparse(shared_folder(spark))
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"files are mapped or written in place, so spark.checkpoint.dir must be a mounted folder, not {parsed.scheme}://")
    path = os.path.join(unquote(parsed.path), "leadflow", f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def saved(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array so that a second attempt of the task replaces it as a whole."""
    temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(temporary, "wb") as out:
        np.save(out, array)
    os.replace(temporary, os.path.join(folder, f"{name}.npy"))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Number of the range of 64-bit hashes, by their high bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def uniform(*columns) -> F.Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def row_key(*names: str) -> F.Column:
    """One number for the values of a row; a null differs from every value."""
    return F.xxhash64(*[part for n in names for part in (F.isnull(n), F.col(n))])


# ---------------------------------------------------------------- words of a batch, as hashes

WINDOW_BYTES = 1 << 20  # texts are hashed in windows of this size, cut between words
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _BASE_INVERSE):
        out = np.full(length, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows and the places where rows begin and end; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[int, int]]:
    """Cut the bytes into windows of about ``size`` that end at the end of a row or, in longer rows, after a break byte."""
    at, end = 0, int(offsets[-1])
    while at < end:
        row_end = int(offsets[np.searchsorted(offsets, at + size, side="right") - 1])
        if row_end <= at:  # the row goes on
            row_end = int(offsets[np.searchsorted(offsets, at, side="right")])
            cut, step = at + size, size
            while cut < row_end:
                found = np.flatnonzero(breaks[data[cut : cut + step]])
                if len(found):
                    row_end = min(row_end, cut + int(found[0]) + 1)
                    break
                cut += step
        yield at, row_end
        at = row_end


def word_spans(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end place of every word in ``data[lo:hi]``, counted from ``lo``."""
    inside = ~breaks[data[lo:hi]]
    border = np.zeros(hi - lo + 1, dtype=bool)
    rows = offsets[np.searchsorted(offsets, lo, side="left") : np.searchsorted(offsets, hi, side="right")] - lo
    border[rows] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, lo: int, hi: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``data[lo:hi]``, places counted from ``lo``; equal bytes have equal hashes."""
    size = WINDOW_BYTES
    while size < hi - lo + 1:
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(hi - lo + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data[lo:hi]] * power[: hi - lo], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * inverse[begins])


def word_windows(texts: pa.Array, fold: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window of the rows: hashes of its words, the rows they are in, and the places in ``text_buffer`` where they begin and end."""
    data, offsets = text_buffer(texts)
    codes = _BYTE_CODES
    if fold:
        codes = codes.copy()
        codes[0x41:0x5B] = codes[0x61:0x7B]
    for lo, hi in windows(data, offsets, WHITE):
        size = WINDOW_BYTES
        while size < hi - lo + 1:
            size *= 2
        power, inverse = _powers(size)
        begins, ends = word_spans(data, offsets, lo, hi, WHITE)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(codes[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        yield mixed((sums[ends] - sums[begins]) * inverse[begins]), np.searchsorted(offsets, begins + lo, side="right") - 1, begins + lo, ends + lo


def hashed_words(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of every row, in order, and the number of words of each row.

    Memory is bounded by the window and eight bytes a word, also for very long rows. ``fold`` lower-cases A-Z."""
    counts, parts = np.zeros(len(texts), dtype=np.int64), []
    for hashes, rows, _, _ in word_windows(texts, fold):
        parts.append(hashes)
        counts += np.bincount(rows, minlength=len(texts))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts
