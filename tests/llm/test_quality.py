import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    runs = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if runs[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def sentence(r, n=60):
    return " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(n))


def test_counts_equal_brute_force(documents):
    r = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c d e f g h i j", "x y z u v x y z u v", "a " * 30, "l\nl\n \n \nl", "é漢 #$ <b>|&", "a b c d e\x0bf\x0cg\rh", "\xa0 nbsp sep"]
    texts += [" ".join(r.choices("abc", k=r.randrange(0, 40))) for _ in range(60)] + ["w1 w2 w3 w4 w5 w6 " * 3000]
    rows = {row["doc_id"]: row for row in quality.with_counts(documents(texts)).collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counted(text), text


def test_outliers_of_each_group_go(documents):
    r, rows = random.Random(2), []
    for lang, source in (("en", "a"), ("en", "b"), ("de", "a")):
        rows += [(len(rows) + k, sentence(r), lang, source) for k in range(120)]
    bad = {1000: " ".join("SHOUT%%%" + str(r.random()) for _ in range(60)), 1001: " ".join("&&&" + w for w in sentence(r).split())}
    rows += [(i, text, "en", "a") for i, text in bad.items()]
    out = {row["doc_id"]: row for row in quality.judge(documents(rows)).collect()}
    assert len(out) == len(rows)
    assert not any(out[i]["kept"] for i in bad) and not any(out[i]["base_failed"] for i in bad)
    assert all(out[row[0]]["kept"] for row in rows if row[0] not in bad)


def test_estimate_resists_a_quarter_of_outliers(llm):
    """The estimate of a contaminated sample is that of its clean part, as numpy gives it, up to sampling error."""
    rng = np.random.default_rng(3)
    clean = rng.multivariate_normal([1, 2, 3, 4], np.diag([1, 4, 9, 16.0]) + 0.5, 1500)
    dirty = rng.normal(60, 1, (300, 4))
    rows = [("g", *map(float, row)) for row in np.vstack([clean, dirty])]
    found = quality.estimate(llm.createDataFrame(rows, "g string, x_0 double, x_1 double, x_2 double, x_3 double"), 4).first()
    centre = np.array([found[f"m_{i}"] for i in range(4)])
    lower = np.array([[found[f"l_{i}_{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    scatter = lower @ lower.T - np.diag(np.square(quality.FLOORS))
    assert np.abs(centre - clean.mean(axis=0)).max() < 0.35
    assert np.abs(scatter / np.cov(clean.T) - 1)[np.diag_indices(4)].max() < 0.25


def test_chi_square_values():
    assert abs(quality.chi_square_quantile(0.95, 1) - 3.841459) < 1e-5
    assert abs(quality.chi_square_quantile(0.975, 4) - 11.143287) < 1e-5


def test_small_groups_nulls_and_repeated_rows(documents):
    r = random.Random(4)
    text = sentence(r)
    rows = [(0, text, None, None), (1, text, "en", None), (2, None, "en", "a"), (None, text, "en", "a"), (3, "short", "en", "a"), (4, text, "en", "a"), (4, text, "en", "a")]
    out = sorted(((row["doc_id"], row["base_failed"], row["kept"]) for row in quality.judge(documents(rows)).collect()), key=str)
    assert out == sorted([(0, False, True), (1, False, True), (2, True, False), (None, False, True), (3, True, False), (4, False, True), (4, False, True)], key=str)
    kept = quality.keep_sound(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == 5


def test_empty_table(documents):
    assert quality.judge(documents([])).count() == 0
    assert quality.keep_sound(documents([])).count() == 0


def test_main_path_is_native(documents):
    plan = quality.with_counts(documents(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert F is not None and pytest is not None
