import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import lm, support

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t\x0b漢'", max_size=40)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_told_apart_and_counted(texts):
    hashes, counts = support.hashed_words(pa.array(texts, pa.string()))
    words = [WORD.findall(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for each in words for w in each]
    names = {}
    for word, value in zip(flat, hashes.tolist()):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_windows_cut_long_rows_between_words(monkeypatch):
    whole = support.hashed_words(pa.array(["aa bb " * 50, "", "c" * 300, None, " x"]))
    monkeypatch.setattr(support, "WINDOW_BYTES", 64)
    monkeypatch.setattr(support.windows, "__defaults__", (64,))
    cut = support.hashed_words(pa.array(["aa bb " * 50, "", "c" * 300, None, " x"]))
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist() == [100, 0, 1, 0, 1]


def test_folding_touches_ascii_only():
    upper, lower = (support.hashed_words(pa.array([t]), fold=True)[0].tolist() for t in ("ABC É", "abc É"))
    assert upper == lower
    assert support.hashed_words(pa.array(["É"]), True)[0][0] != support.hashed_words(pa.array(["é"]), True)[0][0]


def test_mixing_is_one_to_one_and_planes_return():
    values = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (lm.unmixed(support.mixed(values)) == values).all()
    assert (lm.unplaned(lm.planes(values)) == values).all()


def test_slices_of_arrow_arrays():
    texts = pa.array(["a b", "c", None, "d e f"]).slice(1, 3)
    assert support.hashed_words(texts)[1].tolist() == [1, 0, 3]
    random.seed(0)
