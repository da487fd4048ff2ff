import random

import numpy as np
import pytest

from leadflow.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def text(r, n=80):
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(100_000)}"
    return words


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}


def test_alignment_equals_the_full_table():
    r = random.Random(1)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() > 0.15] if r.random() < 0.7 else [r.randrange(4) for _ in range(r.randrange(14))]
        d = distance(a, b)
        for limit in range(15):
            assert neardup.within(np.array(a, np.int64), np.array(b, np.int64), limit) == (d <= limit)


def test_classes_equal_brute_force(documents):
    """Families with up to a tenth of the words edited, and texts that share a passage: the components of all similar pairs."""
    r, rows = random.Random(2), []
    passage = text(r, 60)
    for _ in range(6):
        base = text(r, 120)
        rows += [base] + [edited(r, base, r.randrange(1, 5)) for _ in range(6)]
    rows += [text(r, 60) + passage + text(r, 60) for _ in range(30)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if distance(rows[i], rows[j]) <= 0.2 * max(len(rows[i]), len(rows[j])):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert classes(documents([" ".join(w) for w in rows])) == dict(enumerate(label))


def test_pairs_of_every_band_are_found(documents):
    """Recall of pairs with edits scattered over the text, against the planted links: all of short texts, nearly all of long ones."""
    r, rows, bands = random.Random(7), [], []
    for n, edits in [(300, 60), (300, 45), (300, 30), (120, 24), (101, 20), (30, 5), (30, 3), (20, 2), (12, 1), (5, 1)]:
        for _ in range(40):
            base = text(r, n)
            other = list(base)
            for at in r.sample(range(n), edits):
                other[at] = f"e{r.randrange(10**9)}"
            rows += [base, other]
            bands.append((n, edits))
    found = classes(documents([" ".join(w) for w in rows]))
    for band in set(bands):
        hits = [found[2 * k + 1] == 2 * k for k, b in enumerate(bands) if b == band]
        assert sum(hits) >= (40 if band[0] <= neardup.SHORT else 38), (band, sum(hits))


def test_occurrences_and_order_matter():
    grams = neardup.kmers(np.array([1, 2, 3, 4, 5] * 4, np.uint64))
    assert len(set(grams.tolist())) == len(grams)
    one, two = np.arange(1, 200, dtype=np.uint64), np.r_[np.arange(100, 200), np.arange(1, 100)].astype(np.uint64)
    a, b = (neardup.sketches(neardup.kmers(x)) for x in (one, two))
    assert (a == neardup.sketches(neardup.kmers(one.copy()))).all() and (a != b).mean() > 0.5


def test_blocks_of_a_long_text_give_the_same_sketch():
    grams = neardup.kmers(np.random.default_rng(1).integers(1, 1 << 62, 30_000, dtype=np.uint64))
    product = grams[None, :] * neardup._FACTORS[:, None]
    want = np.sort(np.argsort(product, axis=1)[:, :3], axis=1)
    out = np.arange(neardup.TABLES, dtype=np.uint64) * neardup._PLACES[41]
    for j in range(3):
        out = out + grams[want[:, j]] * neardup._PLACES[20 + j]
    assert (neardup.mixed(out) == neardup.sketches(grams)).all()


def test_nulls_empty_short_repeated_and_long(documents):
    r = random.Random(3)
    long = " ".join(text(r, 30_000))
    rows = [(5, None), (6, None), (7, ""), (8, " \n"), (9, "one two"), (10, "one  two\n"), (11, long), (12, long + " end"), (13, "one"), (13, "one"), (None, "one two"), (None, "alone here")]
    out = neardup.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows)
    found = {row["doc_id"]: row["class_id"] for row in out if row["doc_id"] is not None}
    assert found == {5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 11, 13: 13}
    assert sorted((row["class_id"] for row in out if row["doc_id"] is None), key=str) == [9, None]
    kept = neardup.keep_first(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((row["doc_id"] for row in kept.collect()), key=str) == sorted([5, 6, 7, 9, 11, 13, None, None], key=str)


def test_large_buckets_lose_no_link(documents, monkeypatch):
    """Whether buckets are settled by stars, pairs or rare words, the classes are the same."""
    r, rows = random.Random(4), []
    passage = text(r, 80)
    rows += [passage + text(r, 12) for _ in range(12)]
    rows += [text(r, 40) + passage for _ in range(8)]
    base = text(r, 100)
    rows += [edited(r, base, 3) for _ in range(12)]
    docs = documents([" ".join(w) for w in rows])
    want = classes(docs)
    monkeypatch.setattr(neardup, "SMALL", 1)
    assert classes(docs) == want
    monkeypatch.setattr(neardup, "STARS", 0)
    assert classes(docs) == want
    assert len({want[k] for k in range(20, 32)}) == 1 and [want[k] for k in range(20)] == [0] * 12 + list(range(12, 20))


def test_components_of_chains_and_stars(llm):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2001, 2000), (2000, 2001)]
    r = random.Random(5)
    r.shuffle(edges)
    out = {row["node"]: row["label"] for row in neardup.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 50)} | {2001: 2000}
    more = llm.createDataFrame([(300, 1049), (5, 7), (2000, 9000)], "a long, b long")
    again = {row["node"]: row["label"] for row in neardup._relabelled(llm.createDataFrame(list(out.items()), "node long, label long"), more).collect()}
    assert again == {k: 0 for k in [*range(1, 301), *range(1000, 1050)]} | {2001: 2000, 9000: 2000}


def test_far_texts_are_similar_to_none_linked_to_the_hub():
    """The triangle inequality that spares comparisons, on random triples of short texts."""
    r = random.Random(6)
    for _ in range(2000):
        hub = [r.randrange(3) for _ in range(r.randrange(5, 12))]
        near, other = (([x for x in hub if r.random() > 0.2] + [r.randrange(3)])[: r.randrange(4, 14)] for _ in range(2))
        similar = lambda a, b: distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        if similar(hub, near) and distance(hub, other) > neardup._reach(len(hub), len(other)) + 1e-9:
            assert not similar(near, other)


def test_parities_bound_the_distance_from_below(llm):
    """For texts of many lengths, unrelated, edited or with one phrase repeated; an edit in place counts at most two parities."""
    r, texts = random.Random(8), []
    for n in (1, 3, 30, 63, 64, 65, 70, 130, 300):
        base = [r.randrange(1 << 30) for _ in range(n)]
        texts += [base, [x for x in base if r.random() > 0.1] or base, [r.randrange(1 << 30) if r.random() < 0.2 else x for x in base], [r.choice(base) for _ in range(n)], [7, 9] * n]
    rows = []
    for k, words in enumerate(texts):
        bits = neardup.parities(np.array(words, np.uint32).view(np.int32))
        rows.append((k, len(words), bits.tolist(), np.bitwise_xor.reduce(bits.reshape(-1, neardup.LEAST_LONGS), axis=0).tolist()))
    codes = llm.createDataFrame(rows, "node long, n int, bits array<long>, few array<long>")
    left = neardup._signed(codes, "a").join(codes.selectExpr("node a", "n n_a"), "a")
    pairs = left.crossJoin(neardup._signed(codes, "b").join(codes.selectExpr("node b", "n n_b"), "b")).filter("a < b AND least(n_a, n_b) > 0.5 * greatest(n_a, n_b)")
    found = pairs.select("a", "b", *neardup._least_distance("n_a", "n_b")).collect()
    assert len(found) > 200
    for a, b, few, every in found:
        assert few <= every <= distance(texts[a], texts[b])


def test_texts_with_a_passage_in_common_are_not_all_aligned(documents, monkeypatch):
    """Pairs that are aligned grow with the texts and not with their pairs: the passage puts all of them into the same buckets, and few are similar."""
    r, aligned, verdicts = random.Random(9), [], neardup._verdicts
    passage = text(r, 70)
    rows = [text(r, 30) + passage + text(r, 30) for _ in range(60)]
    rows += [edited(r, rows[0], 3), edited(r, rows[1], 3)]
    monkeypatch.setattr(neardup, "_verdicts", lambda pairs, codes: aligned.append(pairs.count()) or verdicts(pairs, codes))
    assert classes(documents([" ".join(w) for w in rows])) == {k: k for k in range(60)} | {60: 0, 61: 1}
    assert sum(aligned) < 2 * len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_compare(documents, rows):
    assert classes(documents(rows)) == {r[0]: r[0] for r in rows}
    assert neardup.keep_first(documents(rows)).count() == len(rows)
