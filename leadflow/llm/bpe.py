"""Byte-level BPE as a monoid: ids of a text are joined from the ids of its halves, and decoded up the same tree.

A text longer than a leaf is halved; each half is encoded by itself. Only tokens around the cut may differ from those of the whole,
so the join takes a window around the cut, grows it on both sides until both its ends provably stay token borders, encodes it anew
and keeps the tokens outside. The proof is in the split pattern: no match holds a space character after another character, so
the place between a character that is no space and an ASCII space is a border whatever stands around it, and matches are encoded
one by one. Without such a place the window grows to the whole text, so the result is always that of the undivided text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

LEAF_CHARS = 4096
LEAF_IDS = 4096
FIRST_WINDOW = 32
SPACES = " \t\n\r\x0b\x0c"


class TreeCodec:
    """Encodes and decodes with the merge ranks of a file and a split pattern that never matches a space after another character."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_ids: int = LEAF_IDS):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.token_sizes = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.leaf_chars, self.leaf_ids = leaf_chars, leaf_ids

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.uint32)

    @staticmethod
    def _border_before(text: str, lo: int, cut: int) -> int:
        """Last place up to ``cut`` that is a token border in any context, or ``lo``; looked for in growing windows."""
        size, right = FIRST_WINDOW, cut
        while right > lo:
            left = max(lo, cut - size)
            for p in range(right, left, -1):
                if p < len(text) and text[p] in SPACES and not text[p - 1].isspace():
                    return p
            right, size = left, size * 2
        return lo

    @staticmethod
    def _border_after(text: str, cut: int, hi: int) -> int:
        size, left = FIRST_WINDOW, cut + 1
        while left < hi:
            right = min(hi, cut + size)
            for p in range(left, right):
                if text[p] in SPACES and not text[p - 1].isspace():
                    return p
            left, size = max(left, right), size * 2
        return hi

    def _outside(self, ids: np.ndarray, size: int, from_end: bool) -> int:
        """How many ids at one end cover exactly ``size`` bytes."""
        count, step = 0, 16
        while size > 0:
            part = ids[max(0, len(ids) - count - step) : len(ids) - count][::-1] if from_end else ids[count : count + step]
            sums = np.cumsum(self.token_sizes[part])
            if len(sums) and sums[-1] < size:
                count, size, step = count + len(part), size - int(sums[-1]), step * 2
                continue
            at = int(np.searchsorted(sums, size))
            if at >= len(sums) or sums[at] != size:
                raise AssertionError("a border is not between two tokens")
            return count + at + 1
        return count

    def join(self, text: str, lo: int, cut: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``text[lo:hi]`` from those of ``text[lo:cut]`` and ``text[cut:hi]``."""
        begin = self._border_before(text, lo, cut)
        if begin == cut:
            return np.concatenate([left, right])
        end = self._border_after(text, cut, hi)
        kept = len(left) - self._outside(left, len(text[begin:cut].encode()), True)
        skipped = self._outside(right, len(text[cut:end].encode()), False)
        return np.concatenate([left[:kept], self._leaf(text[begin:end]), right[skipped:]])

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        cut = (lo + hi) // 2
        return self.join(text, lo, cut, hi, self.encode(text, lo, cut), self.encode(text, cut, hi))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_ids:
            return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple, TreeCodec] = {}  # one per worker process, vocabulary and pattern


def _codec(ranks_path: str, pattern: str) -> TreeCodec:
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = TreeCodec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encoded(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of a text column; a null text is empty."""

    @arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks_path, pattern)
        return pa.array([codec.encode(t.as_py() or "").astype(np.int32) for t in texts], pa.list_(pa.int32()))

    return encode(text)


def decoded(ids: Column, ranks_path: str, pattern: str) -> Column:
    """Bytes of an array of ids; a null array is empty, a null or unknown id is an error."""

    @arrow_udf(BinaryType())
    def decode(rows: pa.Array) -> pa.Array:
        codec = _codec(ranks_path, pattern)
        return pa.array([codec.decode(np.array(r.as_py() or [], dtype=np.int64)) for r in rows], pa.binary())

    return decode(ids)


def digests(text: Column, ranks_path: str, pattern: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>``: encodes and decodes each text without sending ids through the JVM.

    A null text is empty; an empty text has no ids."""

    @arrow_udf(StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks_path, pattern)
        for texts in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in texts:
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return round_trip(text)
