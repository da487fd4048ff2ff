import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import ann


def vectors(llm, rows):
    return llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({k: F.lit(k) for k in ("vector", "shard", "block", "score", "rank")})


def found(llm, rows, k=20, **how):
    use = ann.usable(vectors(llm, rows))
    out = {}
    for r in ann.search(use, use.filter("vec_id % 20 = 0"), k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def exact(points, query, k=20):
    scores = points.astype(np.float64) @ points[query].astype(np.float64)
    order = [i for i in np.lexsort((np.arange(len(points)), -scores)) if i != query][:k]
    return order, scores


def test_recall_in_several_shards_and_blocks(llm, monkeypatch):
    """On random directions, the hardest case for an index, with vectors of different lengths."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    monkeypatch.setattr(ann, "QUERY_ROWS", 40)
    monkeypatch.setattr(ann, "MERGED_SHARDS", 2)
    monkeypatch.setattr(ann, "LEAST_CANDIDATES", 20)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 32)).astype(np.float32) * rng.uniform(0.8, 1.2, (3000, 1)).astype(np.float32)
    out = found(llm, [(i, p.tolist(), 0) for i, p in enumerate(points)])
    assert sorted(out) == list(range(0, 3000, 20))
    hits = 0
    for query, rows in out.items():
        order, scores = exact(points, query)
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(r[2] - scores[r[1]]) < 1e-12 for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hits += len({r[1] for r in rows} & set(order))
    assert hits / (20 * len(out)) >= 0.9


def test_small_table_is_exact_with_ties(llm):
    points = np.repeat(np.random.default_rng(2).normal(size=(30, 8)).astype(np.float32), 4, axis=0)
    out = found(llm, [(i, p.tolist(), 0) for i, p in enumerate(points)])
    for query, rows in out.items():
        order, _ = exact(points, query)
        assert [r[1] for r in rows] == [int(i) for i in order]


def test_unusable_vectors_take_no_part(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [1.0, inf], 0), (8, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0),
            (1, [0.5, 0.5], 0), (20, [0.0, 1.0], None), (40, None, 0)]
    out = found(llm, rows)
    assert {q: [r[1] for r in rs] for q, rs in out.items()} == {0: [1, 20], 20: [1, 0]}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 0)], [(1, [1.0], 0), (2, [2.0], 0)]])
def test_nothing_to_search(llm, rows):
    assert found(llm, rows) == {}


def test_positions_and_footrule():
    pivots = np.eye(3)
    got = ann.positions(np.array([[3.0, 2.0, 1.0], [1.0, 1.0, 2.0]]), pivots, 2)
    assert got.tolist() == [[0, 1, 2], [1, 2, 0]]
