import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import whitening
from leadflow.llm.whitening import Spectrum, rank_one

from .conftest import CLASHING


def close_spectrum(s, x, factor=1e-12):
    centred = x - whitening.SHIFT - (x - whitening.SHIFT).mean(axis=0)
    scatter = centred.T @ centred
    scale = max(1.0, np.abs(np.linalg.eigvalsh(scatter)).max())
    assert np.abs(s.values - np.linalg.eigvalsh(scatter)).max() <= factor * scale
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() <= 1e-11
    assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() <= factor * scale


@given(st.integers(1, 9), st.integers(0, 10**6), st.sampled_from(["normal", "few", "repeats", "axes", "wide"]))
@settings(max_examples=150, deadline=None)
def test_updates_and_joins_give_the_spectrum_of_all_rows(size, seed, kind):
    rng = np.random.default_rng(seed)
    x = {"normal": rng.standard_normal((40, size)) * 100, "few": rng.integers(0, 3, (40, size)), "repeats": np.repeat(rng.integers(-50, 50, (4, size)), 10, axis=0),
         "axes": np.eye(size)[rng.integers(0, size, 40)] * 7, "wide": rng.standard_normal((40, size)) * 10.0 ** rng.integers(0, 6, size)}[kind].astype(np.int64) + whitening.SHIFT
    one = Spectrum.empty(size)
    for row in x:
        one.add(row)
    close_spectrum(one, x)
    parts = [Spectrum.empty(size) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 7 % 3].add(row)
    parts[0].join(parts[1])
    parts[0].join(Spectrum.empty(size))
    empty = Spectrum.empty(size)
    empty.join(parts[0])
    empty.join(parts[2])
    close_spectrum(empty, x)
    assert (empty.sums == x.sum(axis=0)).all() and empty.n == 40


def test_a_rank_one_update_with_equal_and_untouched_eigenvalues():
    values = np.array([0.0, 1.0, 1.0, 1.0 + 1e-17, 2.0, 5.0])
    direction = np.array([0.3, 0.5, -0.5, 0.1, 0.0, 1e-18])
    got, vectors = rank_one(values, np.eye(6), direction, 2.0)
    full = np.diag(values) + 2.0 * np.outer(direction, direction)
    assert np.abs(got - np.linalg.eigvalsh(full)).max() < 1e-14 and np.abs(vectors @ np.diag(got) @ vectors.T - full).max() < 1e-14
    same, _ = rank_one(values, np.eye(6), np.zeros(6), 2.0)
    assert (same == values).all()


def table(llm, rows, parts=4):
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()} | {"vector": F.lit(1), "n": F.lit("n"), "block": F.lit(2)}).repartition(parts)


def expected(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    values, basis = np.linalg.eigh((away.T @ away) / n**3)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return (away**2).sum(axis=1), away / n @ basis / np.sqrt(values), values / (away.astype(float) ** 2).sum() * n**3


def test_whole_tables_match_a_direct_decomposition(llm, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((150, 12)) @ np.diag(1.3 ** -np.arange(12)) / 4).astype(np.float32)
    vectors[100:] = vectors[0]  # a third of all rows
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    unusable = [(500, None), (501, [None] + [0.1] * 11), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (504, [])]
    out = whitening.whiten(table(llm, rows + unusable, 7)).toPandas().sort_values(["vec_id", "component"])
    deviation, white, explained = expected(vectors)
    assert sorted(set(out["vec_id"])) == list(range(150)) and (out.groupby("vec_id")["component"].apply(list).map(lambda c: c == list(range(1, 9)))).all()
    assert (out["deviation"].to_numpy().reshape(150, 8) == deviation[:, None]).all() and (out["n"] == 150).all()
    got = out["whitened"].to_numpy().reshape(150, 8)
    got = got * np.sign((got * white).sum(axis=0))
    assert np.abs(got - white).max() < 1e-10
    assert np.abs(out["explained"].to_numpy().reshape(150, 8) / explained - 1).max() < 1e-12
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-12
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_components(llm):
    out = whitening.whiten(table(llm, [(k, [float(k % 3), 1.0, 2.0 * (k % 3)]) for k in range(30)]))
    assert {r["component"] for r in out.collect()} == {1} and out.count() == 30
    assert whitening.whiten(table(llm, [(1, [0.5, 0.5]), (1, [0.5, 0.5])])).collect() == []
    two = whitening.whiten(table(llm, [(7, [0.5]), (7, [0.25]), (None, [0.25])])).collect()
    assert len(two) == 3 and sum(r["vec_id"] is None for r in two) == 1


def test_empty_tables_and_bad_lengths(llm):
    nothing = whitening.whiten(table(llm, [(1, None)]))
    assert nothing.collect() == [] and nothing.columns[0] == "vec_id"
    with pytest.raises(ValueError):
        whitening.whiten(table(llm, [(1, [1.0]), (2, [1.0, 2.0])]))
