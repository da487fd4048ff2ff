import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return WORD.findall((text or "").translate(LOW)) + ["\n"]


class Brute:
    """The model in dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = collections.Counter(), collections.Counter()
        for t in map(tokens, texts):
            self.words.update(t)
            self.pairs.update(zip([None] + t[:-1], t))
        self.n, self.v = sum(self.words.values()), len(self.words)
        types = collections.Counter(self.pairs.values())
        self.d2 = (0.0, *lm.discounts([types[k] for k in (1, 2, 3, 4)]))
        self.follows = collections.Counter(w for _, w in self.pairs)
        types = collections.Counter(self.follows.values())
        self.d1 = (0.0, *lm.discounts([types[k] for k in (1, 2, 3, 4)]))
        self.rest = sum(self.d1[min(a, 3)] for a in self.follows.values())
        self.total, self.gamma = collections.Counter(), collections.Counter()
        for (v, _), c in self.pairs.items():
            self.total[v] += c
            self.gamma[v] += self.d2[min(c, 3)]

    def p1(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        a = self.follows[w]
        return (max(a - self.d1[min(a, 3)], 0) + self.rest / (self.v + 1)) / len(self.pairs)

    def p(self, v, w):
        if not self.total[v]:
            return self.p1(w)
        c = self.pairs[v, w]
        return (max(c - self.d2[min(c, 3)], 0) + self.gamma[v] * self.p1(w)) / self.total[v]

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return len(t), sum(w in self.words for w in t), self.n, base, sum(math.log10(self.p(v, w)) for v, w in zip([None] + t[:-1], t))


def texts(seed, n=200):
    r = random.Random(seed)
    return [" ".join(r.choice(["The", "the", "cat", "É", "é"] + [f"w{r.randrange(60)}"]) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def check(documents, rows):
    model = Brute([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1])
    out = lm.score_documents(documents(rows)).collect()
    assert len(out) == len(rows)
    want = collections.Counter((i, *model.row(t)[:3]) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == want
    by_id = dict(rows)
    for r in out:
        _, _, _, base, score = model.row(by_id[r["doc_id"]])
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - score) < 1e-6 * max(1, abs(score))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    return model


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(documents, monkeypatch, small):
    if small:  # many ranges of hashes, and blocks sent before the end of a task
        monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 10)
        monkeypatch.setattr(lm, "PENDING", 40)
        monkeypatch.setattr(lm, "PATIENCE", 20)
    rows = list(enumerate(texts(1))) + [(1000, None), (1001, ""), (1002, " \n"), (None, "the cat"), (1003, "unknown words only"), (1004, "the cat " * 30_000), (3, texts(1)[3])]
    model = check(documents, rows)
    assert abs(sum(model.p("the", w) for w in model.words) + model.p("the", "never seen") - 1) < 1e-9


def test_held_out_texts_score_better_than_the_base(documents):
    r = random.Random(2)
    rows = []
    for i in range(400):
        word, out = "w0", []
        for _ in range(40):
            word = f"w{(int(word[1:]) * 7 + r.choice([1, 2])) % 100}"
            out.append(word)
        rows.append((i, " ".join(out)))
    scores = lm.score_documents(documents(rows)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > 0.5 * scores[1]


def test_nothing_to_learn(documents):
    assert lm.score_documents(documents([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    check(documents, [(held, "a b")])


def test_discounts():
    n = [50, 20, 10, 6]
    y = n[0] / (n[0] + 2 * n[1])
    assert np.allclose(lm.discounts(n), [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    assert lm.discounts([0, 0, 0, 0]) == (0.75, 0.75, 0.75)
