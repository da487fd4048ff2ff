import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm import tiers

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", " ", "　", "﻿", "᠎", "word", "Über", "don't", "'s", "12", "3.5", "。", "”", "日本語", "🙂", "<|endoftext|>", "-", "é", "a"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [tiers.END_ID]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6), st.sampled_from([5, 40, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_units_give_the_ids_of_whole_texts(texts, window):
    ids_of = tiers.UnitIds.__new__(tiers.UnitIds)
    ids_of.tokenizer, ids_of.held = LIBRARY, 3
    ids_of._forget()
    data, offsets = tiers.text_buffer(pa.array(texts, pa.string()))
    found = [list(w) for w in tiers.unit_windows(data, offsets, window)]
    assert [w[0] for w in found[1:]] == [w[1] for w in found[:-1]]
    ids, edges = ids_of.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [library_ids(t) for t in texts]
    parts = defaultdict(list)
    for lo, hi, starts in found:
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), hi]):
            parts[int(np.searchsorted(offsets, begin, side="right")) - 1] += LIBRARY.encode(data[begin:end].tobytes().decode(), add_special_tokens=False).ids
    assert all(parts[k] == library_ids(t)[:-1] for k, t in enumerate(texts))


@given(st.lists(st.integers(1, 150), max_size=60), st.integers(0, 64))
@settings(max_examples=300, deadline=None)
def test_a_pool_loses_nothing_and_fills_every_window(lengths, keep):
    pool, windows = tiers.Pool((8, 16, 32)), []
    for k, n in enumerate(lengths):
        windows += pool.document(k, np.arange(n))
    windows += pool.windows(keep)
    windows += pool.windows()
    assert pool.total < 8 and all(sum(len(p.ids) for p in w) in (8, 16, 32) for w in windows)
    windows += pool.halves()
    assert pool.total == 0 and not pool.lengths
    got = Counter((p.doc, int(i)) for w in windows for p in w for i in p.ids)
    assert got == Counter((k, i) for k, n in enumerate(lengths) for i in range(n))
    assert all(p.ids[0] == p.start for w in windows for p in w)


def test_long_windows_take_documents_that_fit_before_cutting():
    pool = tiers.Pool((8, 16, 32))
    for k, n in enumerate([20, 7, 5, 9]):
        pool.add(tiers.Piece(k, 0, n, np.arange(n)))
    assert [[(p.doc, len(p.ids)) for p in w] for w in pool.windows()] == [[(0, 20), (3, 9), (2, 3)], [(1, 7), (2, 1)]]
    assert pool.total == 1


def checked(df, wanted):
    """Rows of packed documents hold every id once, in sequences without gaps or padding."""
    rows = df.collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([p["length"] for p in pieces]).tolist()
        assert [p["offset"] for p in pieces] == [0, *ends[:-1]]
        assert ends[-1] == pieces[0]["sequence_tokens"] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    assert set(by_doc) == set(wanted)
    for doc, texts in wanted.items():
        left = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc])
        if len(texts) == 1:  # pieces in order are the ids
            ids, at = np.array(library_ids(texts[0]), "<u4"), 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
                at += r["length"]
            assert at == len(ids)
        else:
            assert sum(n * c for (_, n, _, _), c in left.items()) == sum(len(library_ids(t)) for t in texts)
    return rows


def test_packs_whole_documents_with_nulls_repeats_and_long_texts(documents, monkeypatch):
    monkeypatch.setattr(tiers, "FAN", 2)
    long = "Ein sehr langer Text, mit vielen Wörtern. " * 3000
    rows = [(0, None), (1, ""), (2, "same words"), (2, "same words"), (3, long), (None, "no id"), (5, "   x"), (6, "x" * 30_000), *((10 + k, f"word {k} " * (k % 90)) for k in range(300))]
    docs = documents(rows).repartition(5)
    wanted = defaultdict(list)
    for k, t in rows:
        wanted[k].append(t)
    found = checked(tiers.pack_documents(docs, PATH), wanted)
    steps = defaultdict(set)
    for r in found:
        steps[r["sequence_tokens"], r["step"]].add((r["slot"], r["sequence_id"]))
    for (size, step), slots in steps.items():
        last = max(s for n, s in steps if n == size)
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert len(slots) == tiers.STEP_TOKENS // size or step == last


def test_an_empty_table_gives_no_rows(documents):
    out = tiers.pack_documents(documents([(0, "a")]).filter("false"), PATH)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and not out.collect()


def test_ids_of_sequences_and_other_tiers(documents):
    docs = documents([(k, "alpha beta gamma " * (1 + k)) for k in range(40)])
    rows = tiers.sequences(docs, PATH, tiers=(64, 128), with_ids=True).collect()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["size"] <= 128
        for p in r["pieces"]:
            part = np.array(library_ids("alpha beta gamma " * (1 + p["doc_id"])))[p["start"] : p["start"] + p["length"]]
            assert ids[p["offset"] : p["offset"] + p["length"]].tolist() == part.tolist()
        assert r["cost"] == sum(p["length"] ** 2 for p in r["pieces"])
    assert sum(r["size"] for r in rows) == sum(len(library_ids("alpha beta gamma " * (1 + k))) for k in range(40))
    with pytest.raises(ValueError):
        tiers.sequences(docs, PATH, tiers=(64, 100))


def test_steps_hold_windows_of_like_cost(llm):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(rng.choice([512, 1024, 2048])), int(c)) for k, c in enumerate(rng.integers(600, 4_000_000, 3000))]
    out = tiers.step_groups(llm.createDataFrame(rows, "sequence_id long, size int, cost long"), 32_768).collect()
    assert sorted(r["sequence_id"] for r in out) == list(range(3000))
    groups = defaultdict(list)
    for r in out:
        groups[r["size"], r["step"]].append(r)
    for size in (512, 1024, 2048):
        mine = sorted((s, g) for (n, s), g in groups.items() if n == size)
        assert [s for s, _ in mine] == list(range(len(mine))) and all(len(g) == 32_768 // size for _, g in mine[:-1])
        heaviest = [max(r["cost"] for r in g) for _, g in mine]
        lightest = [min(r["cost"] for r in g) for _, g in mine]
        assert all(after <= before * 2 ** (1 / tiers.COST_CLASSES) for before, after in zip(lightest, heaviest[1:]))
