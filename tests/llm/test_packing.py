import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from leadflow.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def checked(rows, capacity):
    """Sequences are gapless from 0 and not too long; returns their number."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def least(lengths, capacity):
    """No packing needs fewer sequences: pieces over half the capacity stand alone, and gaps beside them take only what fits."""
    best = -(-sum(lengths) // capacity)
    for k in range(capacity // 2 + 1):
        alone = [n for n in lengths if n > capacity - k]
        large = [n for n in lengths if capacity / 2 < n <= capacity - k]
        small = sum(n for n in lengths if k <= n <= capacity / 2)
        best = max(best, len(alone) + len(large) + max(0, -(-(small - len(large) * capacity + sum(large)) // capacity)))
    return best


@pytest.mark.parametrize("small", [False, True])
def test_word_by_word_equals_whole_texts(documents, tokenizer, monkeypatch, small):
    if small:  # many ranges of hashes, words sent again, texts cut into windows
        monkeypatch.setattr(packing, "BUCKET_BYTES", 1 << 10)
        monkeypatch.setattr(packing, "HELD_WORDS", 10)
    r = random.Random(1)
    alphabet = ["a", "The", "é", "é", " ", "  ", "\n", "\t", "\x0b", "\r", "　", "\x1c", "\x85", "'s", "'", "12", "漢", "<|endoftext|>", "</w>", "ΑΣ", "!?", "İ", "́"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(1500)] + ["word " * 50_000, None, ""]
    rows = packing.pieces(documents(texts), VOCABULARY, capacity=1 << 20, with_ids=True).collect()
    assert len(rows) == len(texts)
    encoded = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for row in rows:
        assert row["ids"] == [*encoded[row["doc_id"]].ids, 0], texts[row["doc_id"]]


def test_pieces_and_places(documents, tokenizer):
    r = random.Random(2)
    texts = [None, "", "a"] + [" ".join(r.choices(["cat", "dog", "Fish", "über"], k=r.randrange(1, 200))) for _ in range(150)] + ["dog " * 900]
    rows = packing.pack_documents(documents(texts + [texts[5]]), VOCABULARY, capacity=128).collect()
    want = collections.Counter()
    for i, text in enumerate(texts + [texts[5]]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 128):
            want[i, k // 128, k, len(ids[k : k + 128]), zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes())] += 1
    assert collections.Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == want
    assert checked(rows, 128) <= least([x["length"] for x in rows], 128) + 1


def test_ids_are_given_on_request(documents, tokenizer):
    row = packing.pieces(documents(["The cat"]), VOCABULARY, with_ids=True).first()
    assert row["ids"] == tokenizer.encode("The cat", add_special_tokens=False).ids + [0]


def test_fullest_equals_exhaustive_search():
    r = random.Random(3)
    for _ in range(300):
        counts = {n: r.randrange(1, 4) for n in r.sample(range(1, 15), r.randrange(1, 5))}
        room = r.randrange(0, 40)
        chosen = packing.fullest(counts, room)
        assert all(m <= counts[n] for n, m in chosen.items())
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * m for n, m in chosen.items()) == max(s for s in sums if s <= room)


def test_patterns_use_every_piece_once_and_pack_tightly():
    r = random.Random(4)
    histogram = collections.Counter(min(100, 1 + int(r.expovariate(1 / 25))) for _ in range(5000))
    used, bins = collections.Counter(), 0
    for chosen, times in packing.patterns(histogram, 100):
        assert sum(n * m for n, m in chosen.items()) <= 100
        bins += times
        for n, m in chosen.items():
            used[n] += m * times
    assert used == histogram
    assert bins <= -(-sum(n * c for n, c in histogram.items()) // 100) + 1


def test_one_common_length_in_many_slices(llm, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SLICE", 50)
    rows = [(i, 0, 0, 30 if i % 3 else 70, 0) for i in range(1000)] + [(5, 0, 0, 30, 0)] * 5
    df = llm.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, 100).collect()
    assert len(out) == len(rows) and len({(x["sequence_id"], x["offset"]) for x in out}) == len(rows)
    assert checked(out, 100) == 334 + -(-(671 - 334) // 3)


def test_empty_table_and_too_long_piece(documents, llm):
    assert packing.pack_documents(documents([]), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(llm.createDataFrame([(1, 0, 0, 200, 0)], "doc_id long, piece int, start long, length long, ids_crc32 long"), 100)
