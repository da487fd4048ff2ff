"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Tokens are the words of a text with A-Z in lower case, then one end. Every map task reduces its tokens or bigrams to sorted hashes with
counts and sends them as a few compressed blocks, one per range of the hash; one task per range merges the blocks and writes a
sorted array of hashes and an array of counts into the shared folder. A word's id is its place in the sorted word hashes; a bigram is
the pair of ids, hashed one to one, so counts and contexts are exact up to collisions of 64-bit word hashes. Workers map the
arrays into memory and find a batch's sorted hashes in them; no worker loads a model.

Frequent words need no special care: a word is one entry per task and block, and the statistics of a context are summed from
blocks too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from leadflow.llm.support import bucket_of, hashed_words, mixed, mounted_folder, saved, written

BUCKET_BYTES = 8 << 20  # text per range of hashes: what a merging task holds is in proportion
PENDING = 1_500_000  # entries a task holds before it sends them on
PATIENCE = 300_000  # entries gathered before they are reduced
END_HASH = np.uint64(0x5EED0F5EED0F5EED)
_FACTOR_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)

BLOCK = "kind string, bucket long, size long, keys binary, counts binary"
_BLOCK = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def unmixed(values: np.ndarray) -> np.ndarray:
    """Inverse of ``mixed``."""
    for _ in range(2):
        values = (values ^ (values >> np.uint64(32))) * _FACTOR_INVERSE
    return values ^ (values >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, all first bytes together and so on, which the shuffle's codec compresses well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (by column, if there are several)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(keys) else counts[:0]


def blocks(kind: str, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[dict]:
    """A row per bucket of sorted ``keys``; ``bucket`` does not fall along them. Keys are sent as differences."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)]):
        part = keys[lo:hi]
        yield {"kind": kind, "bucket": int(bucket[lo]), "size": int(hi - lo), "keys": planes(np.r_[part[:1], np.diff(part)]), "counts": planes(counts[lo:hi].ravel())}


def unblocked(table: pa.Table, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of all blocks of one bucket, merged."""
    keys = [np.cumsum(unplaned(k.as_py()), dtype=np.uint64) for k in table["keys"]]
    counts = [unplaned(c.as_py()).reshape(-1, columns) for c in table["counts"]]
    return summed(np.concatenate(keys), np.concatenate(counts))


@dataclass(frozen=True)
class Arrays:
    """Sorted hashes with counts in ``2 ** bits`` files by the high bits; ``offsets`` is the place of each file's first entry."""

    folder: str
    name: str
    bits: int
    offsets: np.ndarray

    def _mapped(self, part: str, bucket: int) -> np.ndarray | None:
        key = (self.folder, self.name, part, bucket)
        if key not in _MAPS:
            _MAPS[key] = np.load(os.path.join(self.folder, f"{self.name}-{part}-{bucket}.npy"), mmap_mode="r")
        return _MAPS[key]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (or -1) and count (or 0) of every hash; looked up in order, so that neighbours share pages."""
        order = np.argsort(hashes)
        ordered = hashes[order]
        places, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        edges = np.searchsorted(bucket_of(ordered, self.bits), np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero((edges[1:] > edges[:-1]) & (np.diff(self.offsets) > 0)):
            lo, hi = edges[b], edges[b + 1]
            keys = self._mapped("keys", b)
            at = np.minimum(np.searchsorted(keys, ordered[lo:hi]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == ordered[lo:hi])
            target = order[lo:hi][hit]
            places[target] = self.offsets[b] + at[hit]
            counts[target] = self._mapped("counts", b)[at[hit]]
        return places, counts


_MAPS: dict[tuple, np.ndarray] = {}  # arrays a worker has mapped


@dataclass(frozen=True)
class Model:
    """Numbers of the model and where its arrays are. Word ids run from 0 to ``distinct - 1``; the start of a text is ``distinct``."""

    words: Arrays
    pairs: Arrays | None
    folder: str
    range_size: int
    tokens: int
    distinct: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_types: int
    word_rest: float  # discounted mass of the continuation counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Per id: continuation count; as a context: total and numbers of words seen once, twice, more often. Zero for -1."""
        out = np.zeros((len(ids), 5), dtype=np.int64)
        if not self.pair_types:
            return out
        where = ids // self.range_size
        for r in np.unique(where[ids >= 0]):
            key = (self.folder, "stats", int(r))
            if key not in _MAPS:
                _MAPS[key] = np.load(os.path.join(self.folder, f"stats-{r}.npy"), mmap_mode="r")
            mine = np.flatnonzero((where == r) & (ids >= 0))
            out[mine] = _MAPS[key][ids[mine] - r * self.range_size]
        return out

    def word_probability(self, continuations: np.ndarray) -> np.ndarray:
        """Lower order: discounted continuation counts, interpolated with the uniform distribution over the words and one unknown."""
        if not self.pair_types:
            return np.full(len(continuations), 1.0 / (self.distinct + 1))
        return (np.maximum(continuations - discount(continuations, self.word_discounts), 0) + self.word_rest / (self.distinct + 1)) / self.pair_types

    def probability(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        lower = self.word_probability(self.stats(ids)[:, 0])
        known = np.flatnonzero((contexts >= 0) & (ids >= 0)) if self.pairs else np.zeros(0, np.int64)
        counts = np.zeros(len(ids), dtype=np.int64)
        if len(known):
            counts[known] = self.pairs.find(pair_hash(contexts[known], ids[known]))[1]
        total, *seen = self.stats(contexts)[:, 1:].T
        rest = sum(d * n for d, n in zip(self.pair_discounts, seen))
        return np.where(total > 0, (np.maximum(counts - discount(counts, self.pair_discounts), 0) + rest * lower) / np.maximum(total, 1), lower)


def discount(counts: np.ndarray, values: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *values])[np.minimum(counts, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once to four times; 0.75 (at most) where one of them is missing."""
    out = []
    for k in (1, 2, 3):
        value = k - (k + 1) * (n[0] / (n[0] + 2 * n[1])) * n[k] / n[k - 1] if n[0] and n[k - 1] else 0.75
        out.append(float(min(max(value, 0.0), k)))
    return tuple(out)


def pair_hash(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed((contexts.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the place of every row's first token (and the end of the last)."""
    words, counts = hashed_words(texts, fold=True)
    edges = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(edges[-1], END_HASH, dtype=np.uint64)
    inside = np.ones(edges[-1], dtype=bool)
    inside[edges[1:] - 1] = False
    out[inside] = words
    return out, edges


def pairs_of(ids: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """Context of every token: the id before it, ``start`` at the start of a row."""
    before = np.r_[start, ids[:-1]] if len(ids) else ids
    before[edges[:-1][edges[:-1] < len(ids)]] = start
    return before


def _reduced(parts: Iterator[np.ndarray], kind: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Count hashes in bounded memory and send them as blocks."""
    def sent(keys, counts):
        rows = list(blocks(kind, keys, counts, bucket_of(keys, bits)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    held, fresh = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for part in parts:
        fresh.append(part)
        if sum(map(len, fresh)) >= PATIENCE:
            new = np.concatenate(fresh)
            held = summed(np.concatenate([held[0], new]), np.concatenate([held[1], np.ones(len(new), np.int64)]))
            fresh = []
        if len(held[0]) >= PENDING:
            yield from sent(*held)
            held = (held[0][:0], held[1][:0])
    new = np.concatenate([*fresh, np.zeros(0, np.uint64)])
    yield from sent(*summed(np.concatenate([held[0], new]), np.concatenate([held[1], np.ones(len(new), np.int64)])))


def train(texts: DataFrame, text: str = "text") -> Model:
    """Count and write the model of a text column; null texts are empty and still have an end."""
    spark = texts.sparkSession
    texts = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // BUCKET_BYTES).bit_length())
    folder = mounted_folder(spark, "ngrams")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _reduced((token_hashes(b.column(0))[0] for b in batches), "word", bits)

    def merge_words(table: pa.Table) -> pa.Table:
        keys, counts = unblocked(table)
        bucket, counts = table["bucket"][0].as_py(), counts[:, 0]
        saved(folder, f"word-keys-{bucket}", keys)
        saved(folder, f"word-counts-{bucket}", counts)
        return pa.table({"bucket": [bucket], "n": [len(keys)], "tokens": [int(counts.sum())]})

    merged = texts.mapInArrow(count_words, BLOCK).groupBy("bucket").applyInArrow(merge_words, "bucket long, n long, tokens long")
    found = written(merged, "words").collect()  # a row per range of hashes
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in found:
        sizes[r["bucket"]] = r["n"]
    words = Arrays(folder, "word", bits, np.r_[0, np.cumsum(sizes)])
    distinct, tokens = int(sizes.sum()), sum(r["tokens"] for r in found)
    if distinct >= 1 << 32:
        raise ValueError("a pair of ids holds up to 2 ** 32 distinct words")
    range_size = max(1, -(-(distinct + 1) >> bits)) if bits else distinct + 1

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(batch):
            hashes, edges = token_hashes(batch.column(0))
            ids = words.find(hashes)[0]
            return pair_hash(pairs_of(ids, edges, distinct), ids)

        return _reduced((keys(b) for b in batches), "pair", bits)

    def merge_pairs(table: pa.Table) -> pa.Table:
        keys, counts = unblocked(table)
        bucket, counts = table["bucket"][0].as_py(), counts[:, 0]
        saved(folder, f"pair-keys-{bucket}", keys)
        saved(folder, f"pair-counts-{bucket}", counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
        size = planes(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(np.uint64))
        rows = [{"kind": "size", "bucket": bucket, "size": len(keys), "keys": b"", "counts": size}]
        plain = unmixed(keys)
        seen = np.column_stack([counts, counts == 1, counts == 2, counts > 2]).astype(np.uint64)
        for kind, ids, columns in (("context", plain >> np.uint64(32), seen), ("follow", plain & _LOW, np.ones((len(keys), 1), np.uint64))):
            every, totals = summed(ids, columns)
            rows += blocks(kind, every, totals, (every // np.uint64(range_size)).astype(np.int64))
        return pa.Table.from_pylist(rows, schema=_BLOCK)

    counted = written(texts.mapInArrow(count_pairs, BLOCK).groupBy("bucket").applyInArrow(merge_pairs, BLOCK), "pairs")
    sizes, once = np.zeros(1 << bits, dtype=np.int64), np.zeros(4, dtype=np.int64)
    for r in counted.filter("kind = 'size'").select("bucket", "size", "counts").collect():  # a row per range of hashes
        sizes[r["bucket"]] = r["size"]
        once += unplaned(bytes(r["counts"])).astype(np.int64)

    def merge_stats(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        dense = np.zeros((min(range_size, distinct + 1 - bucket * range_size), 5), dtype=np.int64)
        for kind, columns in (("follow", slice(0, 1)), ("context", slice(1, 5))):
            mine = table.filter(pc.equal(table["kind"], kind))
            if mine.num_rows:
                ids, totals = unblocked(mine, columns.stop - columns.start)
                dense[(ids - np.uint64(bucket * range_size)).astype(np.int64), columns] = totals
        saved(folder, f"stats-{bucket}", dense.astype(np.uint32) if dense.max(initial=0) < 1 << 32 else dense)
        seen = np.bincount(np.minimum(dense[:, 0], 5), minlength=6)
        return pa.table({f"n{k}": [int(seen[k])] for k in range(1, 6)})

    parts = counted.filter("kind <> 'size'").groupBy("bucket").applyInArrow(merge_stats, ", ".join(f"n{k} long" for k in range(1, 6)))
    n = [int(x or 0) for x in written(parts, "stats").agg(*[F.sum(f"n{k}") for k in range(1, 6)]).first()]
    word_discounts = discounts(n[:4])
    rest = word_discounts[0] * n[0] + word_discounts[1] * n[1] + word_discounts[2] * sum(n[2:])
    return Model(words, Arrays(folder, "pair", bits, np.r_[0, np.cumsum(sizes)]) if sizes.any() else None, folder, range_size, int(tokens), distinct,
                 discounts(once.tolist()), word_discounts, int(sizes.sum()), rest)


def scored(model: Model, text: Column) -> Column:
    """``struct<n_tokens, n_known, base_score, score>`` of a text column; a null text is an empty one, whose only token is the end.

    Scores are sums of log10; perplexity is ``10 ** (-score / n_tokens)``."""

    @arrow_udf(StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double"))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hashes, edges = token_hashes(texts)
            ids, counts = model.words.find(hashes) if model.distinct else (np.full(len(hashes), -1), np.zeros(len(hashes), np.int64))
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
            found = np.log10(model.probability(pairs_of(ids, edges, model.distinct), ids))
            first = edges[:-1]
            sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in ((counts > 0).astype(np.int64), base, found)]
            yield pa.StructArray.from_arrays([pa.array(np.diff(edges), pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())],
                                             names=["n_tokens", "n_known", "base_score", "score"])

    return score(text)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    """True for rows kept out of training: remainder of the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``, scored by the model of the rows that are not held out."""
    model = train(docs.filter(~held_out(doc_id)), text)
    return (docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), scored(model, F.col(text)).alias("s"))
            .select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score"))
