import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def whole():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tiny():
    return bpe.TreeCodec(RANKS, PATTERN, leaf_chars=4, leaf_ids=2)


@given(st.lists(st.sampled_from(["a", "b", "th", "'s", "'r", "e", "'", " ", "  ", "\n", "\t", "1", "23", "!", "é", "漢", "　", "\x1c", " ", "'ll", ".", "\U0001f600"]), max_size=60).map("".join))
@settings(max_examples=600, deadline=None)
def test_tree_equals_the_undivided_text(whole, tiny, text):
    ids = tiny.encode(text)
    assert ids.tolist() == whole.encode_ordinary(text)
    assert tiny.decode(ids.astype(np.int64)) == text.encode()


def test_long_texts(whole):
    r = random.Random(1)
    codec = bpe.TreeCodec(RANKS, PATTERN)
    for text in ("word " * 20_000, "x" * 9_000, "漢字" * 4_000, "".join(r.choices("ab c\n1'", k=50_000)), " " * 10_000):
        assert codec.encode(text).tolist() == whole.encode_ordinary(text)


def test_columns(documents, whole):
    texts = [None, "", "Hello  world", "it's é", "Hello  world"]
    rows = documents(texts).select("doc_id", bpe.digests(F.col("text"), RANKS, PATTERN).alias("d"), bpe.encoded(F.col("text"), RANKS, PATTERN).alias("ids"),
                                   bpe.decoded(bpe.encoded(F.col("text"), RANKS, PATTERN), RANKS, PATTERN).alias("bytes")).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = whole.encode_ordinary(text)
        assert r["ids"] == ids and bytes(r["bytes"]) == text.encode()
        assert tuple(r["d"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert documents([]).select(bpe.digests(F.col("text"), RANKS, PATTERN)).count() == 0
