"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots around it, nearest first. Each shard of the index keeps one inverted file per
pivot: the position of that pivot for every member of the shard. A query adds up, over its own nearest pivots, how far their
positions differ (Spearman footrule); the members with the smallest sums are reranked by the exact inner product.

Inner products are made a question of angle by one more component, ``sqrt(longest ** 2 - length ** 2)`` for members and zero for
queries, so vectors need not have unit length. Queries and shards meet in blocks of bounded size; every query meets every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import written

PIVOTS = 128  # fitted on a bounded sample: this many vectors
POSTED = 128  # positions kept per vector; pivots further away share the last position
QUERY_PIVOTS = 128
CANDIDATES = 0.15  # share of a shard that is reranked, ties of the last sum included
LEAST_CANDIDATES = 256
SHARD_ROWS = 8192
QUERY_ROWS = 2048
MERGED_SHARDS = 64  # shards whose finds are merged at once


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the vectors that take part: not null, not zero, all components finite, of the most common length.

    Repeated rows count once; of different vectors with one id the smallest stays. Rows without id take no part."""
    found = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(
        "vec_id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    found = written(found.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    common = found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.filter(F.size("vector") == (common["d"] if common else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def positions(points: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Position of every pivot in the order around every point, nearest first, ties to the lower pivot."""
    order = np.argsort(-(points @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return np.minimum(out, posted)


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(0.0, longest**2 - (points**2).sum(axis=1))
    return np.column_stack([points, np.sqrt(rest)])


def build(vectors: DataFrame, pivots: np.ndarray, longest: float, shards: int, posted: int = POSTED) -> DataFrame:
    """Rows ``shard, pivot, positions`` (the inverted files, members in order of id) and, with pivot -1, ``ids`` and ``flat`` vectors."""
    schema = pa.schema([("shard", pa.int64()), ("pivot", pa.int32()), ("positions", pa.list_(pa.int16())), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(pa.float64()))])

    def post(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        points = _matrix(group["vector"])
        files = positions(_lifted(points, longest), pivots, posted).T
        shard = group["shard"][0].as_py()
        rows = [{"shard": shard, "pivot": -1, "positions": None, "ids": np.asarray(group["vec_id"]), "flat": points.ravel()}]
        rows += [{"shard": shard, "pivot": p, "positions": f, "ids": None, "flat": None} for p, f in enumerate(files)]
        return pa.Table.from_pylist(rows, schema=schema)

    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("long")))
    return placed.groupBy("shard").applyInArrow(post, "shard long, pivot int, positions array<smallint>, ids array<long>, flat array<double>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, candidates: float = CANDIDATES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query, itself left out, ties to the smaller id.

    Both sides are ``vec_id, vector`` from ``usable``. A table of one vector, or none, gives no rows."""
    spark = vectors.sparkSession
    size, longest = vectors.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    longest = math.sqrt(longest or 0.0)
    asked = queries.count()
    shards, blocks = max(1, -(-size // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))
    sample = [r["vector"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = _lifted(np.array(sample, dtype=np.float64), longest)
    centres /= max(longest, 1e-300)
    index = written(build(vectors, centres, longest, shards), "postings")

    def look(key, shard: pa.Table, block: pa.Table) -> pa.Table:
        empty = {"query_id": [], "vec_id": [], "score": [], "shard": []}
        if not shard.num_rows or not block.num_rows:
            return pa.table(empty, schema=_FOUND)
        head = shard.filter(pa.compute.equal(shard["pivot"], -1))
        ids = np.asarray(head["ids"][0].values)
        points = np.asarray(head["flat"][0].values).reshape(len(ids), -1)
        files = [None] * (shard.num_rows - 1)
        for p, row in zip(shard["pivot"].to_pylist(), shard["positions"]):
            if p >= 0:
                files[p] = np.asarray(row.values)
        block = block.sort_by("vec_id")
        asking = _matrix(block["vector"])
        own = positions(np.column_stack([asking, np.zeros(len(asking))]), centres, POSTED)
        wanted = min(len(ids), max(LEAST_CANDIDATES, math.ceil(candidates * len(ids))))
        out, step = {"query_id": [], "vec_id": [], "score": []}, np.empty(len(ids), dtype=np.int16)
        for row, query_id in enumerate(np.asarray(block["vec_id"])):
            footrule = np.zeros(len(ids), dtype=np.int32 if len(files) * POSTED > 32_000 else np.int16)
            for p in np.flatnonzero(own[row] < QUERY_PIVOTS):
                np.subtract(files[p], own[row, p], out=step)
                footrule += np.abs(step, out=step)
            near = np.flatnonzero(footrule <= np.partition(footrule, wanted - 1)[wanted - 1])
            near = near[ids[near] != query_id]
            score = points[near] @ asking[row]
            best = np.lexsort((ids[near], -score))[:k]
            out["query_id"].append(np.full(len(best), query_id))
            out["vec_id"].append(ids[near][best])
            out["score"].append(score[best])
        joined = {name: np.concatenate(parts) for name, parts in out.items()}
        return pa.table(joined | {"shard": np.full(len(joined["score"]), key[0].as_py())}, schema=_FOUND)

    def every(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = index.withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks).cast("long"))).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(look, "query_id long, vec_id long, score double, shard long")
    while True:  # merged in levels, so that no query gathers the finds of all shards at once
        shards = -(-shards // MERGED_SHARDS)
        found = found.withColumn("shard", F.expr(f"shard div {MERGED_SHARDS}"))
        found = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, vec_id) AS rank").filter(F.col("rank") <= k)
        if shards <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("shard", pa.int64())])
