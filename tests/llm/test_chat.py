import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import chat

from .conftest import CLASHING

NASTY = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "\\", "<", "[", "/", "s>", "INST]", "|", "a", "\n", "é", " "]), max_size=12).map("".join)


@given(NASTY, NASTY)
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control(role, text):
    for value in (role, text):
        escaped = chat.escape(value)
        assert chat.unescape(escaped) == value
        assert not any(c in escaped for c in chat.CONTROLS)
    segment = chat.format_turn(role, [{"type": "text", "text": text}])["segment"]
    assert chat.parse_segment(segment) == (role, text)


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <s> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"text": " and "}, {"type": "audio", "ref": "b.wav", "seconds": 2.01},
             {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image"}]
    turn = chat.format_turn("assistant", parts)
    assert turn["segment"] == "<s>assistant[INST]see <\\s> <|image_1|> and <|audio_2|><|document_3|><|image_4|>[/INST]</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 2304), ("image", None, 1)]
    assert all(turn["segment"][a["at"] :].startswith(f"<|{a['kind']}_") for a in turn["attachments"])
    assert turn["expanded_tokens"] == 3 + 51 + 2304 + 1
    assert turn["segment"][turn["loss_start"] : turn["loss_end"]].endswith("<|image_4|>")
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def expected(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_conversations_read_back(llm):
    said = "</s>[INST] ok [/INST]"
    talks = {-1: [("user", said), ("assistant", said)], 5: [("system", None), ("user", ""), ("assistant", "x" * 200_000), (None, "é\\")], 7: [("user", "only")], None: [("assistant", "lost")]}
    talks[9] = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(3000)]
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rows += [(11, None, "user", "first"), (11, 0, "assistant", "b"), (11, 0, "assistant", "b")]
    df = llm.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items() if k != "text"})
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c, turns in talks.items():
        r = out[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)
    assert (out[11]["n_turns"], out[11]["loss_chars"]) == (3, 2)
    assert out[-1]["formatted_chars"] == sum(len(chat.format_turn(r, [{"text": t}])["segment"]) for r, t in talks[-1])


def test_empty_table_and_json_parts(llm):
    empty = llm.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
    given_parts = json.dumps([{"type": "image", "ref": "x", "width": 28, "height": 56}])
    df = llm.createDataFrame([(1, 0, "user", given_parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, body string")
    rows = chat.format_conversations(df, parts=F.from_json("body", f"array<{chat.PART.simpleString()}>")).orderBy("turn").collect()
    assert rows[0]["attachments"][0].asDict() == {"kind": "image", "ref": "x", "at": len("<s>user[INST]"), "tokens": 2}
    assert rows[1]["segment"] == "<s>assistant[INST][/INST]</s>" and rows[1]["attachments"] == []
