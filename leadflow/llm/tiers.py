"""Hierarchical packing of documents into windows of several lengths.

A document is routed to the smallest context size that holds it; longer ones give whole windows of the largest size, and their rest
is routed. Windows of the largest size are filled first: a document of that tier, then the longest documents of shorter tiers that fit
its gap. Only where none fits is one cut. The sizes are powers of two and the last tokens of all are split into powers of two,
so no sequence is padded.

Packing is local: a task packs pools of bounded size as it encodes, so neither texts nor ids are shuffled. What does not fill the
smallest window of a task, less than ``TIERS[0]`` tokens, goes up in groups of ``FAN`` tasks until one group is left. Windows of a
size that cost attention about the same (the sum of squared piece lengths) then form the groups of a training step.

The pattern of byte-level vocabularies never matches across the border between a character and white space, so a text is encoded in
units (white space and what follows it) and each distinct unit once, as long as the worker process remembers it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadflow.llm.support import WHITE, WINDOW_BYTES, span_hashes, text_buffer, written

TIERS = (512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 1 << 23  # ids that a task packs together
CARRIED = 1 << 20  # ids that wait for the next pool, so that its windows find documents that fit
HELD_UNITS = 2_000_000  # units whose ids a worker process remembers
STEP_TOKENS = 32_768
COST_CLASSES = 32  # per doubling of the cost
ROWS_PER_SLICE = 10_000
FAN = 1024

# ---------------------------------------------------------------- units and their ids

_STARTS = np.zeros(256, dtype=bool)
_STARTS[[0x20, 0x09, 0x0A, 0x0D]] = True
_NOT_AFTER = WHITE.copy()
_NOT_AFTER[0x1C:0x20] = True


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space (or is of no width) beyond ASCII."""
    last, mid = data[at - 1], data[np.maximum(at - 2, 0)]
    first = data[np.maximum(at - 3, 0)]
    wide = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (first == 0xE2) & (mid == 0x80) & ((last <= 0x8F) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    for a, b in ((0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x81), (0xE3, 0x80), (0xEF, 0xBB)):
        wide |= (first == a) & (mid == b)
    return wide


def unit_starts(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places in ``[lo, hi)`` where a row begins or a text may be cut without changing its ids."""
    here = _STARTS[data[lo:hi]]
    before = np.empty(hi - lo, dtype=bool)
    before[1:] = ~_NOT_AFTER[data[lo : hi - 1]]
    before[0] = lo > 0 and not _NOT_AFTER[data[lo - 1]]
    at = np.flatnonzero(here & before) + lo
    wide = data[at - 1] >= 0x80
    if wide.any():
        wide[wide] = _after_wide_space(data, at[wide])
        at = at[~wide]
    rows = offsets[np.searchsorted(offsets, lo, side="left") : np.searchsorted(offsets, hi, side="left")]
    at = np.sort(np.concatenate([at, rows]))
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def unit_windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """``lo, hi`` and the starts of the units between them, for windows of about ``size`` bytes."""
    at, end = 0, int(offsets[-1])
    while at < end:
        hi = end
        for look in range(at + size, end, size):
            found = unit_starts(data, offsets, look, min(end, look + size))
            if len(found):
                hi = int(found[0])
                break
        starts = unit_starts(data, offsets, at, hi)
        yield at, hi, starts if len(starts) and starts[0] == at else np.r_[at, starts]
        at = hi


class UnitIds:
    """Ids of texts by a byte-level vocabulary; remembers those of ``held`` units."""

    def __init__(self, path: str, held: int = HELD_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held = Tokenizer.from_file(path), held
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        first = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def _window(self, data: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids between ``lo`` and ``hi`` and the number of ids of each unit."""
        begins, ends = starts - lo, np.r_[starts[1:], hi] - lo
        hashes = span_hashes(data, lo, hi, begins, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        fresh = np.r_[True, hashes[1:] != hashes[:-1]]
        keys, sample, place = hashes[fresh], order[fresh], np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        for attempt in (0, 1):
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), dtype=bool)
            inside = at < len(self.keys)
            new[inside] = self.keys[at[inside]] != keys[inside]
            if not new.any():
                break
            if attempt == 0 and len(self.keys) and len(self.keys) + int(new.sum()) > self.held:
                self._forget()
                new[:] = True
            which = sample[new]
            self._learn(keys[new], [data[lo + b : lo + e].tobytes().decode() for b, e in zip(begins[which].tolist(), ends[which].tolist())])
        size = self.size[at][place]
        first = self.first[at][place]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.ids[np.repeat(first, size) + within], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, ``END_ID`` after each, and the places where rows begin and end; a null row is empty."""
        data, offsets = text_buffer(texts)
        counts, parts = np.zeros(len(texts), dtype=np.int64), []
        for lo, hi, starts in unit_windows(data, offsets):
            ids, size = self._window(data, lo, hi, starts)
            parts.append(ids)
            counts += np.bincount(np.searchsorted(offsets, starts, side="right") - 1, weights=size, minlength=len(texts)).astype(np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return np.insert(flat, np.cumsum(counts), END_ID).astype("<u4", copy=False), np.r_[0, np.cumsum(counts + 1)]


_ENCODERS: dict[str, UnitIds] = {}  # one per worker process and vocabulary file


def encoder(path: str) -> UnitIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitIds(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- pools


@dataclass
class Piece:
    doc: object
    start: int
    total: int  # ids of the whole document
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.total, self.ids[:at]), Piece(self.doc, self.start + at, self.total, self.ids[at:])


@dataclass
class Pool:
    """Pieces that wait for a window, by length."""

    tiers: tuple[int, ...] = TIERS
    waiting: dict[int, list[Piece]] = field(default_factory=dict)
    lengths: int = 0  # bit n: a piece of n ids waits
    total: int = 0

    def add(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.waiting.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.total += n

    def take(self, n: int) -> Piece:
        pieces = self.waiting[n]
        piece = pieces.pop()
        if not pieces:
            self.lengths ^= 1 << n
        self.total -= n
        return piece

    def longest(self, most: int) -> int:
        """The longest length waiting of at most ``most``; 0 if there is none."""
        return max(0, (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def document(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Windows that a document fills alone; its rest waits."""
        top, whole = self.tiers[-1], Piece(doc, 0, len(ids), ids)
        while len(whole.ids) >= top:
            front, whole = whole.cut(top)
            yield [front]
        if len(whole.ids):
            self.add(whole)

    def window(self, size: int, seed: int = 0) -> list[Piece]:
        """Pieces of together ``size`` ids, that of length ``seed`` first; at least as many must wait."""
        out = [self.take(seed)] if seed else []
        gap = size - seed
        while gap:
            n = self.longest(gap)
            if not n:  # all are longer: the shortest is cut
                longer = self.lengths >> (gap + 1)
                piece, rest = self.take(gap + (longer & -longer).bit_length()).cut(gap)
                self.add(rest)
            else:
                piece = self.take(n)
            out.append(piece)
            gap -= len(piece.ids)
        return out

    def windows(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Full windows, the largest tier first, until at most ``keep`` ids or no full window of the smallest tier is left."""
        for size, shorter in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.total > keep:
                seed = self.longest(size)
                if seed <= shorter:
                    break
                if self.total >= size:
                    yield self.window(size, seed)
                elif not shorter:
                    return
                else:  # too little is left for a window of this size
                    for part in self.take(seed).cut(shorter):
                        self.add(part)

    def halves(self) -> Iterator[list[Piece]]:
        """Everything that waits, in windows of falling powers of two."""
        while self.total:
            yield self.window(1 << (self.total.bit_length() - 1))

    def rest(self) -> list[Piece]:
        return [p for n in sorted(self.waiting, reverse=True) for p in self.waiting[n]]


# ---------------------------------------------------------------- sequences


def _schema(doc_type: T.DataType) -> T.StructType:
    piece = T.StructType([T.StructField("doc_id", doc_type)]).add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("offset", "long")
    return T.StructType().add("block", "long").add("sequence_id", "long").add("size", "integer").add("cost", "long").add("pieces", T.ArrayType(piece)).add("ids", "binary")


class _Rows:
    """Collects sequences as Arrow batches; ``size`` is null for what goes up to the next round."""

    def __init__(self, doc_type: pa.DataType, level: int, block: int, with_ids: bool):
        self.doc_type, self.block, self.base, self.with_ids, self.made = doc_type, block, (level << 58) | (block << 30), with_ids, 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.sizes, self.costs, self.blobs, self.edges = [], [], [], [], [0]
        self.columns = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")}

    def add(self, pieces: list[Piece], rest: bool = False) -> None:
        c, offset = self.columns, 0
        for p in pieces:
            n = len(p.ids)
            for name, value in zip(c, (p.doc, p.start, n, zlib.crc32(p.ids), p.total, offset)):
                c[name].append(value)
            offset += n
        self.edges.append(len(c["start"]))
        self.ids.append(self.base + self.made)
        self.sizes.append(None if rest else offset)
        self.costs.append(sum(len(p.ids) ** 2 for p in pieces))
        self.blobs.append(b"".join(p.ids.tobytes() for p in pieces) if rest or self.with_ids else None)
        self.made += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [self.doc_type] + [pa.int64()] * 5
        pieces = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(self.columns.values(), kinds)], names=list(self.columns))
        out = pa.RecordBatch.from_arrays([pa.array([self.block] * len(self.ids), pa.int64()), pa.array(self.ids, pa.int64()), pa.array(self.sizes, pa.int32()), pa.array(self.costs, pa.int64()),
                                          pa.ListArray.from_arrays(pa.array(self.edges, pa.int32()), pieces), pa.array(self.blobs, pa.binary())],
                                         names=["block", "sequence_id", "size", "cost", "pieces", "ids"])
        self._clear()
        return out


def sequences(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS,
              with_ids: bool = False) -> DataFrame:
    """``sequence_id, size, cost, pieces`` (and ``ids``, little-endian): every id of every row in exactly one piece, no padding.

    A row's ids are those of the library's plain ``encode`` without added special tokens, then ``END_ID``. A null or empty text is the
    end id alone; repeated rows are documents of their own; an empty table gives no rows; other columns are not read. A document
    is held by one task, however long; what a task packs at once is bounded by ``pool_tokens``."""
    if any(b != 2 * a for a, b in zip(tiers, tiers[1:])) or tiers[0] & (tiers[0] - 1):
        raise ValueError("context sizes are powers of two, each twice the one before")
    kind = docs.schema[doc_id].dataType
    schema, arrow = _schema(kind), to_arrow_type(kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pool, ids_of = _Rows(arrow, 0, TaskContext.get().partitionId(), with_ids), Pool(tiers), encoder(vocabulary)
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, edges = ids_of.encode(batch.column(1))
            for name, begin, end in zip(names, edges[:-1].tolist(), edges[1:].tolist()):
                for window in pool.document(name, ids[begin:end]):
                    rows.add(window)
            if pool.total >= pool_tokens:
                for window in pool.windows(min(CARRIED, pool_tokens // 8)):
                    rows.add(window)
            if rows.ids:
                yield rows.batch()
        for window in pool.windows():
            rows.add(window)
        if pool.total:
            rows.add(pool.rest(), rest=True)
        if rows.ids:
            yield rows.batch()

    done = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(first, schema), "tiers")
    out, level = [done.filter("size IS NOT NULL")], 0
    rest = done.filter("size IS NULL")
    last = rest.agg(F.max("block")).first()[0]
    while last is not None:
        level, last = level + 1, last // FAN
        up = written(rest.groupBy(F.expr(f"block div {FAN}").alias("up")).applyInArrow(_upwards(arrow, level, tiers, last == 0, with_ids), schema), "tiers")
        out.append(up.filter("size IS NOT NULL"))
        rest = up.filter("size IS NULL")
        last = None if last == 0 else rest.agg(F.max("block")).first()[0]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.drop("block", *([] if with_ids else ["ids"]))


def _upwards(doc_type: pa.DataType, level: int, tiers: tuple[int, ...], last: bool, with_ids: bool):
    """Packs the rests of a group of blocks; the last group leaves nothing."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows, pool = _Rows(doc_type, level, key[0].as_py(), with_ids), Pool(tiers)
        for row in table.sort_by("block").select(["pieces", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], "<u4")
            for p in row["pieces"]:
                pool.add(Piece(p["doc_id"], p["start"], p["doc_tokens"], ids[p["offset"] : p["offset"] + p["length"]]))
        for window in pool.windows():
            rows.add(window)
        for window in pool.halves() if last else ():
            rows.add(window)
        if pool.total:
            rows.add(pool.rest(), rest=True)
        return pa.Table.from_batches([rows.batch()])

    return merge


def step_groups(found: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``sequences`` rows with ``step`` and ``slot``: steps of ``step_tokens`` ids of one size whose windows cost about the same.

    Windows are ranked by class of cost, in slices that are shifted by counts, so no size or class is sorted in one task; one step of
    each size may be short."""
    slices = 1 + found.count() // ROWS_PER_SLICE
    sliced = found.withColumns({"heavy": F.floor(F.log2("cost") * -COST_CLASSES).cast("int"), "slice": F.pmod(F.xxhash64("sequence_id"), F.lit(slices)).cast("int")})
    counts = sliced.groupBy("size", "heavy", "slice").agg(F.count("*").alias("n"))
    classes = counts.groupBy("size", "heavy").agg(F.sum("n").alias("n")).selectExpr("size", "heavy", "sum(n) OVER (PARTITION BY size ORDER BY heavy) - n AS above")
    before = counts.selectExpr("size", "heavy", "slice", "sum(n) OVER (PARTITION BY size, heavy ORDER BY slice) - n AS earlier").join(classes, ["size", "heavy"])
    ranked = (sliced.selectExpr("*", "row_number() OVER (PARTITION BY size, heavy, slice ORDER BY sequence_id) - 1 AS r").join(before, ["size", "heavy", "slice"])
              .withColumns({"rank": F.expr("r + earlier + above"), "per": F.greatest(F.lit(1), F.expr(f"{step_tokens} div size"))}))
    return ranked.withColumns({"step": F.expr("rank div per"), "slot": F.expr("rank % per")}).drop("heavy", "slice", "r", "earlier", "above", "rank", "per")


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: its document, place and checksum, its sequence and offset there, and the sequence's size, step and slot."""
    grouped = step_groups(sequences(docs, vocabulary, doc_id, text, tiers), step_tokens)
    return (grouped.select("sequence_id", F.col("size").alias("sequence_tokens"), "step", "slot", F.explode("pieces").alias("p"))
            .select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset", "sequence_tokens", "step", "slot"))
