"""Near duplicates by order MinHash: minimum occurrence-labelled word k-mers that keep their order in the text.

A text's k-mers are its runs of two words; equal k-mers of one text are told apart by their occurrence number. Each of ``TABLES``
hash functions picks the ``MEMBERS`` smallest k-mers, and the sketch is the hash of these in text order, so that two texts share
it only if they hold the same k-mers in the same order. Texts that share a sketch are candidates, and so are texts of up to ``SHORT``
words that share a rare word (pass 3 below), which holds for all similar ones. A candidate pair is a link if its word edit similarity
``1 - distance / longer length`` is at least ``SIMILARITY``, decided by banded alignment. Classes are the connected components of the links.

Texts of equal words are one node from the start. Links are then found in passes that leave no candidate pair undecided:

1. The texts of a bucket (of one sketch) are compared with one of them, its hub: a star, however large the bucket is. Texts that
   are linked to the hub settle there. By the triangle inequality a text that is far from the hub is similar to none that is
   linked to it; one that only just misses the hub is compared with those in other components.
2. What has not settled is compared pair by pair across components in buckets where up to ``SMALL`` texts are left. Larger ones get
   another star, around a text of their most frequent component, up to ``STARS`` times.
3. Texts still left in large buckets are compared where they share a rare word: similar texts have ``SIMILARITY`` of their words in
   common, so they share one of the rarest ``1 - SIMILARITY`` of each other's words, counted among all texts left.

A pair at Jaccard similarity J of the k-mers shares a sketch with probability of about ``1 - (1 - J ** MEMBERS) ** TABLES``. Edits of a fifth of
the words leave J = 0.47 if they are scattered at random and 0.43 if no two touch: 0.999 and 0.995 of such pairs are found.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from leadflow.llm.support import hashed_words, mixed, uniform, written

K = 2  # a scattered edit destroys K k-mers: with longer ones, similar texts share too few
MEMBERS = 3
TABLES = 64
SIMILARITY = 0.8
SHORT = 100  # words up to which candidates are found without chance
SMALL = 64
STARS = 3
ORDER_TEXTS = 1_000  # texts by which rare words are told from common ones; any order finds all links
COMMON_WORDS = 50_000  # size of the table of common words
LEAST_LONGS, MOST_LONGS = 4, 128  # 64-bit numbers of parities of a text, powers of two; with fewer, more pairs are aligned
SECOND_LOOK = 20_000  # words of a pair up to which a failed star pair is measured again, to tell far from near
MAX_ROUNDS = 60  # rounds of the component search grow with the logarithm of the longest chain

_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(values: np.ndarray) -> np.ndarray:
    """64-bit values told apart by their occurrence number: the second copy of a value differs from the first."""
    order = np.argsort(values, kind="stable")
    same = np.r_[False, values[order][1:] == values[order][:-1]][: len(values)]
    if not same.any():
        return values
    place = np.arange(len(values))
    occurrence = np.zeros(len(values), dtype=np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
    return values + occurrence * _PLACES[40]


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every run of ``k`` words, labelled with its occurrence number; a shorter text is one k-mer."""
    if not len(words):
        return words
    size = min(k, len(words))
    runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        runs += words[j : j + len(runs)] * _PLACES[j]
    return mixed(labelled(runs))


def sketches(grams: np.ndarray, tables: int = TABLES, members: int = MEMBERS) -> np.ndarray:
    """One hash per table: the ``members`` smallest k-mers under the table's hash function, in text order."""
    if not len(grams):
        return grams
    if len(grams) <= members:
        chosen = np.tile(np.arange(len(grams)), (tables, 1))
    else:
        lines = np.arange(tables)
        best = np.zeros((tables, 0), dtype=np.int64)
        for lo in range(0, len(grams), 8192):  # blocks that stay in the cache
            block = grams[None, lo : lo + 8192] * _FACTORS[:tables, None]
            for _ in range(min(members, block.shape[1])):
                least = block.argmin(axis=1)
                best = np.column_stack([best, least + lo])
                block[lines, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
            if best.shape[1] > members:
                rank = np.argsort(grams[best] * _FACTORS[:tables, None], axis=1, kind="stable")[:, :members]
                best = np.take_along_axis(best, rank, axis=1)
        chosen = np.sort(best, axis=1)
    out = np.arange(tables, dtype=np.uint64) * _PLACES[41]
    for j in range(chosen.shape[1]):
        out = out + grams[chosen[:, j]] * _PLACES[20 + j]
    return mixed(out)


@arrow_udf(StructType().add("k1", LongType()).add("k2", LongType()).add("n", IntegerType()).add("sketches", ArrayType(LongType())))
def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Two hashes of the word sequence, the number of words, and the sketches of every text."""
    for texts in batches:
        words, counts = hashed_words(texts)
        ends = np.cumsum(counts)
        firsts, seconds, sizes, flat = [], [], [0], []
        for count, end in zip(counts, ends):
            own = words[end - count : end]
            place = np.arange(1, count + 1, dtype=np.uint64)
            firsts.append(mixed(own + place * _PLACES[42]).sum(dtype=np.uint64))
            seconds.append(mixed(own * _PLACES[43] + place * _PLACES[44]).sum(dtype=np.uint64))
            flat.append(sketches(kmers(own)))
            sizes.append(sizes[-1] + len(flat[-1]))
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.StructArray.from_arrays([pa.array(np.array(firsts, np.uint64).view(np.int64)), pa.array(np.array(seconds, np.uint64).view(np.int64)),
                                          pa.array(counts.astype(np.int32)), lists], names=["k1", "k2", "n", "sketches"])


def _bag(codes: np.ndarray) -> np.ndarray:
    """The words of a text as a set: 32-bit hashes with their occurrence numbers, hashed."""
    return mixed(labelled(codes.view(np.uint32).astype(np.uint64)))


def parities(codes: np.ndarray) -> np.ndarray:
    """The words of a text in numbers of 64 bits: each bit tells whether an odd number of the words fall on it.

    An edit of one word changes at most two bits, so the bits in which two texts differ bound their distance from below. A text has a
    power of two of numbers, some eight bits a word; the exclusive or of their halves gives the parities in half as many bits."""
    longs = LEAST_LONGS
    while longs * 16 < len(codes) and longs < MOST_LONGS:
        longs *= 2
    odd = np.bincount((_bag(codes) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


@arrow_udf(StructType().add("codes", ArrayType(IntegerType())).add("bits", ArrayType(LongType())).add("few", ArrayType(LongType())))
def word_codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The words of every text as 32-bit hashes, for alignment, and their parities, in all bits and in ``LEAST_LONGS`` numbers."""
    for texts in batches:
        words, counts = hashed_words(texts)
        codes, ends = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.r_[0, np.cumsum(counts)].astype(np.int32)
        bits = [parities(codes[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])]
        few = [np.bitwise_xor.reduce(row.reshape(-1, LEAST_LONGS), axis=0) for row in bits]
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)), _lists(bits), _lists(few)], names=["codes", "bits", "few"])


def _signed(codes: DataFrame, end: str) -> DataFrame:
    """The parities of every text, and the same in ``LEAST_LONGS`` columns, with the node named ``end``."""
    return codes.select(F.col("node").alias(end), F.col("bits").alias(f"{end}_bits"), *[F.col("few")[k].alias(f"{end}_bits{k}") for k in range(LEAST_LONGS)])


def _folded(bits: F.Column, other: F.Column) -> F.Column:
    """The parities in as many bits as those of a text of at least half the length."""
    half = F.shiftright(F.size(bits), 1)
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def _least_distance(left: str, right: str) -> tuple[F.Column, F.Column]:
    """Two numbers that are no more than the distance of the texts ``a`` and ``b``, the second of them for texts whose lengths differ by less than half.

    A word changed in place accounts for two parities, one that is added or missing for one. The first number takes few parities."""
    apart = F.abs(F.col(left) - F.col(right))
    few = reduce(operator.add, [F.bit_count(F.col(f"a_bits{k}").bitwiseXOR(F.col(f"b_bits{k}"))) for k in range(LEAST_LONGS)])
    a, b = F.col("a_bits"), F.col("b_bits")
    every = F.aggregate(F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    return F.greatest(apart, (few + apart) / 2), F.greatest(apart, (every + apart) / 2)


def _banded(x: list, y: list, limit: int) -> bool:
    """True if the edit distance is at most ``limit``, which is less than either length and no less than their difference.

    The cells of the table within ``limit`` of the diagonal, a column at a time as differences between neighbours in the bits of
    whole numbers (Myers' bit vectors, in Hyyro's form for a band that moves down the diagonal)."""
    width = 2 * limit + 2
    full = (1 << width) - 1
    places: dict = {}
    for p, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << p
    plus, minus, distance = (full << (width - limit - 1)) & full, 0, limit
    last, most = 1 << (width - 1), 2 * limit + len(y) - len(x)
    row = 1 << (width - 2)
    for i, word in enumerate(y):
        shift = limit + 1 - width + i
        match = places.get(word, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_plus, right_minus = minus | (full ^ (diagonal | plus)), diagonal & plus
        if i < len(x) - limit:
            if not diagonal & last:
                distance += 1
                if distance > most:
                    return False
        else:
            if right_plus & row:
                distance += 1
            elif right_minus & row:
                distance -= 1
            row >>= 1
        plus, minus = right_minus | (full ^ ((diagonal >> 1) | right_plus)), (diagonal >> 1) & right_plus
    return distance <= limit


def within(a: np.ndarray, b: np.ndarray, limit: int, most_words: int | None = None) -> bool:
    """True if the edit distance of two word sequences is at most ``limit``; also if that is open and they have over ``most_words``.

    The equal ends are cut off, and pairs with too few words in common are told apart, before the band is computed."""
    if abs(len(a) - len(b)) > limit:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if max(n, m) <= limit:
        return True
    if not n or not m:
        return False
    both = np.sort(np.concatenate([a, b]))
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    codes, total = both[first], np.diff(np.r_[first, n + m])
    in_a = np.bincount(np.searchsorted(codes, a), minlength=len(codes))
    if max(n, m) - int(np.minimum(in_a, total - in_a).sum()) > limit:
        return False
    if most_words is not None and n + m > most_words:
        return True
    x, y = a.tolist(), b.tolist()
    if limit < min(n, m):
        return _banded(x, y, limit)
    line = list(range(m + 1))  # one side is shorter than the limit
    for i, word in enumerate(x):
        before, line = line, [i + 1]
        for j in range(m):
            line.append(min(before[j] + (word != y[j]), before[j + 1] + 1, line[j] + 1))
    return line[-1] <= limit


LINKED, NEAR, FAR = 0, 1, 2


@arrow_udf(IntegerType())
def _compared(left: pa.Array, right: pa.Array) -> pa.Array:
    """LINKED, or FAR where the distance exceeds what two similar steps can bridge, or else NEAR."""
    out = []
    for k in range(len(left)):
        a, b = np.asarray(left[k].values), np.asarray(right[k].values)
        if within(a, b, int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)):
            out.append(LINKED)
        else:
            out.append(NEAR if within(a, b, int(_reach(len(a), len(b)) + 1e-9), SECOND_LOOK) else FAR)
    return pa.array(out, pa.int32())


def _reach(n, m):
    """If a - b is no longer than this, some text may be similar to both: its own length is at most n and m over SIMILARITY."""
    return (1 - SIMILARITY) / SIMILARITY * (n + m)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: the smallest node of the component of every node that is not itself the smallest.

    Alternating large and small stars until every node has one edge, to a node that has none upwards. Each round is written; hot
    nodes only meet their neighbours through a partially aggregated minimum and a join on one row."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 1 OR (ups = 1 AND n > 1)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "stars")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the links join components, so only the components' labels are searched again."""
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        ends = ends.join(known, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    if links.isEmpty():
        return labels
    joined = components(ends.filter("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")).union(joined), "labels")


def _verdicts(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """``a, b, verdict`` of the candidate pairs, by aligning their texts."""
    left = codes.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
    right = codes.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _compared("codes_a", "codes_b").alias("verdict"))


def _sized(left: str, right: str) -> F.Column:
    """Lengths alone leave the similarity possible."""
    return F.abs(F.col(left) - F.col(right)) <= (1 - SIMILARITY) * F.greatest(left, right) + 1e-9


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _across(members: DataFrame, codes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs of a bucket that are in different components and may be similar: each pair of ``members`` once, or each of a member and another."""
    if others is not None:  # the parities of texts that have nothing to meet do not travel
        others = others.join(members.select("bucket"), "bucket", "left_semi")
    right = (members if others is None else others).select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    once = F.col("a") < F.col("b") if others is None else F.col("a") != F.col("b")
    left, right = members.withColumnRenamed("node", "a").join(_signed(codes, "a"), "a"), right.join(_signed(codes, "b"), "b")
    limit = (1 - SIMILARITY) * F.greatest("n", "n_b") + 1e-9
    few, every = _least_distance("n", "n_b")
    found = left.join(right, "bucket").filter(once & (F.col("label") != F.col("label_b")) & _sized("n", "n_b") & (few <= limit) & (every <= limit))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@arrow_udf(ArrayType(LongType()))
def _bags(codes: pa.Array) -> pa.Array:
    parts = [_bag(np.asarray(row.values)) for row in codes]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _rare_words(members: DataFrame, codes: DataFrame) -> DataFrame:
    """``bucket, node, label, n`` with a bucket for each of the rarest words of a text, of which similar texts share one.

    That holds for the first words in any order that is the same for all texts, so the order may rest on a sample: the words of the most
    texts among about ``ORDER_TEXTS`` come last, the most common at the very end, and the others first. The table of the order has a
    fixed size, ``COMMON_WORDS`` at most."""
    nodes = written(members.select("node", "label", "n").distinct(), "rest").join(codes, "node")
    share = ORDER_TEXTS / max(1, nodes.select("node").count())
    counts = nodes.filter(uniform("node") < share).select(F.explode(_bags("codes")).alias("word")).groupBy("word").agg(F.count("*").alias("texts")).filter("texts > 1")
    common = [r["word"] for r in counts.orderBy(F.desc("texts"), "word").limit(COMMON_WORDS).collect()]
    words = np.array(common, dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    known, rank = words[order], (len(words) - order).astype(np.int64)  # the most common word has the highest rank

    @arrow_udf(ArrayType(LongType()))
    def first_words(rows: pa.Array) -> pa.Array:
        parts = []
        for row in rows:
            bag = _bag(np.asarray(row.values))
            place = np.zeros(len(bag), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, bag), len(known) - 1)
                place = np.where(known[at] == bag, rank[at], 0)
            parts.append(bag[np.lexsort((bag, place))][: len(bag) - math.ceil(SIMILARITY * len(bag) - 1e-9) + 1])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))

    return nodes.select(F.explode(first_words("codes")).alias("bucket"), "node", "label", "n")


def _star(left: DataFrame, hubs: DataFrame, codes: DataFrame) -> DataFrame:
    """``bucket, node, n, hub, verdict`` of the members against the hub of their bucket; the hub itself is linked."""
    rows = left.join(hubs, "bucket")
    pairs = rows.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n_hub").alias("n_a"), "n").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(_signed(codes, end), end)
    few, every = _least_distance("n", "n_a")
    pairs = written(pairs.select("a", "b", "n", "n_a", F.when(_sized("n", "n_a"), F.greatest(few, every)).otherwise(few).alias("least")), "star-pairs")
    possible = F.col("least") <= (1 - SIMILARITY) * F.greatest("n", "n_a") + 1e-9
    aligned = _verdicts(pairs.filter(possible).select("a", "b"), codes)
    # Of pairs that lengths or parities rule out, those that differ by more than two steps are far.
    apart = pairs.filter(~possible).select("a", "b", F.when(F.col("least") > _reach(F.col("n"), F.col("n_a")) + 1e-9, FAR).otherwise(NEAR).alias("verdict"))
    verdicts = written(aligned.unionByName(apart), "verdicts").select(F.col("a").alias("hub"), F.col("b").alias("node"), "verdict")
    return written(rows.join(verdicts, ["hub", "node"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(LINKED))).select("bucket", "node", "n", "hub", "verdict"), "star")


def _labels(posted: DataFrame, codes: DataFrame) -> DataFrame:
    """``node, label`` of all texts linked to others, among texts that share a bucket; ``posted`` holds ``bucket, node, n``."""
    spark = posted.sparkSession
    labels, pairs, left = spark.createDataFrame([], "node long, label long"), [], posted
    for number in range(STARS + 1):
        counted = _labelled(left, labels).groupBy("bucket", "label").agg(F.count("*").alias("texts"), F.min(F.struct("node", "n")).alias("first"))
        sizes = counted.groupBy("bucket").agg(F.sum("texts").alias("size"), F.count("*").alias("labels"), F.max_by("first", F.struct("texts", -F.col("label"))).alias("hub"))
        sizes = sizes.filter("labels > 1").select("bucket", "size", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub"))  # elsewhere nothing is left to find
        if number:
            sizes = written(sizes, "sizes")
            small = _labelled(left.join(sizes.filter(F.col("size") <= SMALL).select("bucket"), "bucket", "left_semi"), labels)
            pairs.append(written(_across(small, codes), "small"))
            sizes = sizes.filter(F.col("size") > SMALL)
            if sizes.isEmpty():
                break
        hubs = sizes.select("bucket", "hub", "n_hub")
        if number == STARS:
            pairs.append(written(_across(_rare_words(_labelled(left.join(hubs, "bucket", "left_semi"), labels), codes), codes), "rare"))
            break
        star = _star(left, hubs, codes)
        links = star.filter((F.col("verdict") == LINKED) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        labels = _relabelled(labels, links)
        # Two texts of a bucket have its hub in common, so they meet once for a hub and not for each of its buckets.
        placed = _labelled(star.select(F.col("hub").alias("bucket"), "node", "n", "verdict").distinct(), labels)
        pairs.append(written(_across(placed.filter(F.col("verdict") == NEAR), codes, placed.filter(F.col("verdict") == LINKED)), "near"))
        left = star.filter(F.col("verdict") != LINKED).select("bucket", "node", "n")
    more = _verdicts(reduce(DataFrame.union, pairs).distinct(), codes).filter(F.col("verdict") == LINKED).select("a", "b")
    return _relabelled(labels, written(more, "more-links"))


def _codes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, codes, bits, few`` of the texts of ``nodes``, written."""
    return written(rows.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").select("node", word_codes("text").alias("c")).dropDuplicates(["node"]).select("node", "c.*"), "codes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id)`` for every row: the smallest id of the row's class.

    A null text is in a class of its own; texts without words are equal. Rows with the same id are one document. A null id takes
    the class of its text, null if all ids of that text are null. Only ids and texts are read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = written(rows.select("doc_id", F.isnull("text").alias("missing"), sketched("text").alias("s")).select("doc_id", "missing", "s.*"), "sketches")
    copies = written(sketch.filter("NOT missing").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "copies")
    nodes = sketch.join(copies, (sketch.doc_id == copies.node) & (sketch.k1 == copies.k1) & (sketch.k2 == copies.k2), "left_semi")
    posted = nodes.select(F.explode("sketches").alias("bucket"), F.col("doc_id").alias("node"), "n").distinct()
    short = written(nodes.filter(F.col("n").between(1, SHORT)).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "n").distinct(), "short")
    posted = posted.union(_rare_words(short, _codes(rows, short)).select("bucket", "node", "n"))
    shared = posted.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    members = written(posted.join(shared, "bucket", "left_semi"), "members")
    labels = _labels(members, _codes(rows, members.select("node").distinct()))

    named = copies.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("class_id"))
    whole = sketch.filter("NOT missing").select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "class_id")
    return whole.union(sketch.filter("missing").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, the one with the smallest id, with the columns it came with.

    Of repeated rows one stays; rows without an id all stay."""
    classes = near_duplicates(docs.filter(F.col(doc_id).isNotNull()), doc_id, text)
    gone = written(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    return left.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).union(docs.filter(F.col(doc_id).isNull()))
