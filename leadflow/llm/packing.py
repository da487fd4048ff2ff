"""Best-fit packing by minimum bin slack: each bin takes the fullest combination of the lengths that are left.

Only the histogram of piece lengths goes to the driver, at most ``capacity`` numbers whatever the size of the corpus. There,
bin after bin is seeded with the longest length left and filled by a subset-sum over the available lengths on a bitset (bit t:
some combination is t long); the combination is then taken out as often as the counts allow, so there are about as many patterns
as lengths. Pieces find their place by their rank among the pieces of their length, counted in slices, without sorting all pieces of a
common length in one task.

Tokenizing a word costs far more than finding it, so the distinct words of the corpus are encoded once, in Spark, and kept in
sorted files that workers map into memory; a text's ids are looked up by the hashes of its words.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from leadflow.llm.support import bucket_of, hashed_words, mounted_folder, saved, text_buffer, word_windows, written

CAPACITY = 2048
END_ID = 0
BUCKET_BYTES = 24 << 20  # text per range of word hashes
HELD_WORDS = 2_000_000  # word hashes by which a task knows what it has sent
WORDS_AT_ONCE = 20_000
ROWS_AT_ONCE = 200
ROWS_PER_SLICE = 10_000


def _tokenizer(path: str):
    """One per worker process and vocabulary file, kept between tasks."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


_TOKENIZERS: dict = {}
_MAPS: dict[tuple, np.ndarray] = {}  # arrays a worker has mapped

_WORDS = pa.schema([("bucket", pa.int64()), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])


def _new_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Every distinct word of a task once (again after ``HELD_WORDS`` others), by range of its hash."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        texts = batch.column(0)
        data, _ = text_buffer(texts)
        for hashes, _, begins, ends in word_windows(texts):
            found, first = np.unique(hashes, return_index=True)
            if len(seen):
                at = np.minimum(np.searchsorted(seen, found), len(seen) - 1)
                fresh = seen[at] != found
                found, first = found[fresh], first[fresh]
            if not len(found):
                continue
            words = [data[lo:hi].tobytes() for lo, hi in zip(begins[first].tolist(), ends[first].tolist())]
            buckets = bucket_of(found, bits)
            cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True])
            rows = [{"bucket": int(buckets[lo]), "hashes": found[lo:hi].view(np.int64), "words": [w.decode() for w in words[lo:hi]]} for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pylist(rows, schema=_WORDS)
            seen = np.sort(np.concatenate([seen, found])) if len(seen) < HELD_WORDS else found


@dataclass(frozen=True)
class WordIds:
    """Ids of every distinct word of a corpus in mapped files: sorted hashes, where each word's ids begin, and the ids.

    For tokenizers whose matches never hold white space: the ids of a text are those of its words in order."""

    folder: str
    bits: int

    def _mapped(self, part: str, bucket: int) -> np.ndarray:
        key = (self.folder, part, bucket)
        if key not in _MAPS:
            _MAPS[key] = np.load(os.path.join(self.folder, f"{part}-{bucket}.npy"), mmap_mode="r")
        return _MAPS[key]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, ``END_ID`` after each, and the places where rows begin and end."""
        hashes, counts = hashed_words(texts)
        order = np.argsort(hashes)
        ordered = hashes[order]
        edges = np.searchsorted(bucket_of(ordered, self.bits), np.arange((1 << self.bits) + 1))
        lengths, first, parts = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), []
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            keys, starts = self._mapped("keys", b), self._mapped("starts", b)
            mine = slice(edges[b], edges[b + 1])
            at = np.minimum(np.searchsorted(keys, ordered[mine]), len(keys) - 1)
            if (keys[at] != ordered[mine]).any():
                raise LookupError("a word was not in the corpus when its words were encoded")
            first[mine], lengths[mine] = starts[at], starts[at + 1] - starts[at]
            parts.append((b, mine))
        size = np.empty_like(lengths)
        size[order] = lengths
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.cumsum(size) - size + row  # one end id for every row before
        per_row = np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), END_ID, dtype="<u4")
        for b, mine in parts:
            n = lengths[mine]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place[order[mine]], n) + within] = self._mapped("ids", b)[np.repeat(first[mine], n) + within]
        return out, np.r_[0, np.cumsum(per_row)]


def encode_words(docs: DataFrame, vocabulary: str, text: str = "text") -> WordIds:
    """Encodes each distinct word of the corpus once, and writes the files into the shared folder."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // BUCKET_BYTES).bit_length())
    folder = mounted_folder(docs.sparkSession, "word-ids")

    def merge(table: pa.Table) -> pa.Table:
        hashes = np.asarray(table["hashes"].combine_chunks().flatten(), dtype=np.int64).view(np.uint64)
        words = table["words"].combine_chunks().flatten()
        keys, first = np.unique(hashes, return_index=True)
        starts, ids, tokenizer = [0], [], _tokenizer(vocabulary)
        for lo in range(0, len(first), WORDS_AT_ONCE):
            for found in tokenizer.encode_batch(words.take(pa.array(first[lo : lo + WORDS_AT_ONCE])).to_pylist(), add_special_tokens=False):
                ids += found.ids
                starts.append(len(ids))
        bucket = table["bucket"][0].as_py()
        for name, array in (("keys", keys), ("starts", np.array(starts, np.int64)), ("ids", np.array(ids, np.uint32))):
            saved(folder, f"{name}-{bucket}", array)
        return pa.table({"bucket": [bucket], "words": [len(keys)]})

    found = texts.mapInArrow(lambda batches: _new_words(batches, bits), "bucket long, hashes array<long>, words array<string>")
    written(found.groupBy("bucket").applyInArrow(merge, "bucket long, words long"), "word-ids")
    return WordIds(folder, bits)


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row: its ids, then ``END_ID``, cut only if longer than ``capacity``.

    A null text is empty: one piece with the end id alone. Each row is a document, repeated rows too."""
    fields = [StructField("length", IntegerType()), StructField("ids_crc32", LongType())] + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    words = encode_words(docs, vocabulary, text)

    @arrow_udf(ArrayType(StructType(fields)))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, lengths, sums, flat = [0], [], [], []
            for lo in range(0, len(texts), ROWS_AT_ONCE):
                ids, edges = words.encode(texts.slice(lo, ROWS_AT_ONCE))
                flat.append(ids)
                for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    for at in range(begin, end, capacity):
                        part = ids[at : min(end, at + capacity)]
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part))
                    sizes.append(len(lengths))
            values, names = [pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], ["length", "ids_crc32"]
            if with_ids:
                every = np.concatenate([*flat, np.zeros(0, np.uint32)]).view(np.int32)
                values.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(every, pa.int32())))
                names.append("ids")
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(values, names=names))

    found = docs.select(F.col(doc_id).alias("doc_id"), cut(F.col(text)).alias("p")).select("doc_id", F.posexplode("p").alias("piece", "p"))
    return found.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("p.length").cast("long").alias("length"), "p.ids_crc32", *["p.ids"] * with_ids)


# ---------------------------------------------------------------- patterns


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths with multiplicities whose sum is the largest possible up to ``room``; longer lengths are tried first."""
    reach, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach & goal:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins have each; together they hold every piece exactly once."""
    counts, out = {n: c for n, c in histogram.items() if c}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fullest(counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[n] // m for n, m in chosen.items())
        for n, m in chosen.items():
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
        out.append((chosen, times))
    return out


def _places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """For runs of ranks within a length: length, first rank, rank past the run, pieces per bin, offset in the bin, first bin."""
    used, rows, bins = dict.fromkeys(histogram, 0), [], 0
    for chosen, times in patterns(histogram, capacity):
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used[n], used[n] + chosen[n] * times, chosen[n], offset, bins))
            used[n] += chosen[n] * times
            offset += n * chosen[n]
        bins += times
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` rows with ``sequence_id`` and ``offset``: sequences without gaps of at most ``capacity`` ids.

    Equal pieces take different places; which of two equal rows takes which does not matter."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most one row for each length up to the capacity
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    slices = 1 + max(counts.values(), default=0) // ROWS_PER_SLICE
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    before = (sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
              .selectExpr("length", "slice", "sum(n) OVER (PARTITION BY length ORDER BY slice) - n AS before"))
    ranked = (sliced.selectExpr("*", "row_number() OVER (PARTITION BY length, slice ORDER BY doc_id, piece) - 1 AS r").join(before, ["length", "slice"])
              .withColumn("rank", F.col("r") + F.col("before")).drop("r", "before", "slice"))
    # The number of runs depends on the capacity, not on the corpus: some thousands.
    places = found.sparkSession.createDataFrame(_places(counts, capacity), "length long, first long, past long, per_bin long, at long, bin long")
    return (ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
            .drop(places["length"])
            .withColumn("sequence_id", F.col("bin") + F.expr("(rank - first) div per_bin"))
            .withColumn("offset", F.col("at") + F.expr("((rank - first) % per_bin) * length"))
            .drop("rank", "first", "past", "per_bin", "at", "bin"))


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row with their places. An empty table gives no rows."""
    return pack(written(pieces(docs, vocabulary, doc_id, text, capacity), "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
