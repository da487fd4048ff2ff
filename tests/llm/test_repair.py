import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import repair
from leadflow.llm.repair import Costs

from .conftest import CLASHING

LEGAL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def all_edits(rows, costs, inserts=2):
    """Every way to edit ``(role, fault)`` rows with at most ``inserts`` inserts at a place: cost, audit and roles."""
    chains = [c for n in range(inserts + 1) for c in itertools.product("ua", repeat=n)]
    ways = [(0, "", "")]
    for role, fault in [*rows, (None, None)]:
        steps = []
        for chain in chains:
            before = (costs.insert * len(chain), "I" * len(chain), "".join(chain))
            if role is None:
                steps.append(before)
                continue
            extra = costs.truncated if fault == repair.TRUNCATED else 0
            steps.append((before[0] + costs.delete, before[1] + "D", before[2]))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                steps.append((before[0] + extra, before[1] + "K", before[2] + (role[:1] if role[:1] in "sua" and role else "x")))
                steps += [(before[0] + extra + costs.rerole, before[1] + "R", before[2] + new) for new in "ua"]
        ways = [(a + c, b + d, r + s) for a, b, r in ways for c, d, s in steps]
    return ways


def brute(rows, costs):
    return min((c, a, r) for c, a, r in all_edits(rows, costs) if LEGAL.fullmatch(r))


def solved(rows, costs, segment=10**6):
    codes = bytes(repair.row_code(role, fault) for role, fault in rows)
    if not codes:
        return 0, "", ""
    cuts = [codes[k : k + segment] for k in range(0, len(codes), segment)]
    tables = [repair.joined([repair.row_table(c, costs) for c in cut]) for cut in cuts]
    states = repair.crossings(tables, repair.START, repair.last_state(tables, costs))
    made = [m for cut, p, q in zip(cuts, [repair.START, *states], states) for m in repair.row_edits(cut, p, q, costs)] + [repair.endings(costs)[states[-1]][1:]]
    audit = "".join(m[0] for m in made)
    roles = "".join("-sua"[s] for m in made for s in m[1])
    spent = sum({"I": costs.insert, "D": costs.delete, "R": costs.rerole, "K": 0}[c] for c in audit)
    for (_, fault), m in zip(rows, made):
        spent += costs.truncated * (fault == repair.TRUNCATED and m[0][-1] != "D")
    return spent, audit, roles


ROWS = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.integers(0, 3))


@given(st.lists(ROWS, max_size=3), st.sampled_from([Costs(), Costs(insert=1), Costs(rerole=2, delete=2, insert=2, truncated=1), Costs(1, 4, 1, 2), Costs(3, 7, 1, 0)]), st.integers(1, 3))
@settings(max_examples=250, deadline=None)
def test_the_cheapest_and_ascii_least_edits(rows, costs, segment):
    assert solved(rows, costs) == solved(rows, costs, segment) == brute(rows, costs)


def by_layers(rows, costs):
    """Least (cost, audit) by whole strings for each state, row by row; for longer conversations."""
    best = {repair.START: (0, "")}
    for role, fault in rows:
        steps, after = repair.row_steps(repair.row_code(role, fault), costs), {}
        for p, (cost, audit) in best.items():
            for q, step in enumerate(steps[p]):
                if step:
                    after[q] = min(after.get(q, (10**9, "")), (cost + step[0], audit + step[1]))
        best = after
    return min((c + repair.endings(costs)[q][0], a + repair.endings(costs)[q][1]) for q, (c, a) in best.items())


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(2, 2, 2, 1)])
def test_long_conversations_in_any_segments(costs):
    rng = random.Random(5)
    for n in (7, 50, 400):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "x"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        want = by_layers(rows, costs)
        for segment in (1, 3, 64, n):
            got = solved(rows, costs, segment)
            assert got[:2] == want and LEGAL.fullmatch(got[2])


def contract(turns):
    """The rule of damage, faults and repair, conversation by conversation; ties by role and the digest of the text."""
    kept = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in turns:
        kept[conv]
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append(repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if body[-1] not in ".!?" else repair.SOUND)
            seen.add((role, text))
        cost, audit = by_layers([(r[1], f) for r, f in zip(rows, faults)], Costs()) if rows else (0, "")
        lines, at, before = [], 0, ""
        for letter in audit:
            nxt = "assistant" if before[:1] == "u" else "user"
            if letter == "I":
                lines.append((nxt, ""))
            elif letter == "D":
                at += 1
            else:
                lines.append((rows[at][1] if letter == "K" else nxt, rows[at][2]))
                at += 1
            before = lines[-1][0] if lines else ""
        turns_seen = {r[0] for r in rows if r[0] is not None}
        out[conv] = (max(turns_seen) - min(turns_seen) + 1 - len(turns_seen) if turns_seen else 0, *(faults.count(k) for k in (1, 2, 3)),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def table(llm, rows):
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()} | {"copies": F.lit(9), "fault": F.lit("f"), "seq": F.lit(1)})


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [2, 4096])
def test_whole_tables_match_the_rule(llm, segment):
    rng = random.Random(9)
    texts = ["Yes.", "No!", "", " \t", "cut off", "What?", "Long one. " * 3000, "é.", "a.\u0085", "b.\n", None]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(900, t % 50 or None, "user" if t % 2 else "assistant", "again." if t % 3 else f"{t}.") for t in range(300)]  # a long conversation of repeats
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "fine."), (None, None, "system", "first.")]
    rows += [(c, c, "user", "gone?") for c in range(1000, 1060)] + [(2000, 1, "user", "tie."), (2000, 1, "assistant", "tie."), (2000, 1, "user", "tie."), (2000, None, "system", "x.")]
    turns = table(llm, rows).repartition(4)
    out = repair.summaries(repair.repaired(repair.damage(turns), turns, segment=segment))
    assert out.columns == COLUMNS
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    want = contract(rows)
    assert got == want
    assert any(v[0] == 0 and v[5] == 0 and v[6] == "" and v[7] == EMPTY for v in want.values())  # dropped as a whole


def test_the_rows_of_a_repaired_conversation(llm):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "How are you?"), (1, 3, "user", " "), (1, 4, "user", "Fine.")]
    fixed = repair.repaired(table(llm, rows)).collect()
    assert "".join(r["audit"] for r in fixed) == "KRKDD"
    assert [(w["role"], w["text"]) for r in fixed for w in r["written"]] == [("system", "Be kind."), ("user", "Hello."), ("assistant", "How are you?")]
    assert [r["fault"] for r in fixed] == [0, 0, 0, repair.BLANK, 0, None]
    inserted = repair.repaired(table(llm, [(1, 0, "user", "Hi.")]), costs=Costs(delete=9)).collect()
    assert [(w["role"], w["text"]) for r in inserted for w in r["written"]] == [("user", "Hi."), ("assistant", "")]
    assert "".join(r["audit"] for r in inserted) == "KI" and repair.summaries(repair.repaired(table(llm, [(1, 0, "user", "Hi.")]), costs=Costs(delete=9)), Costs(delete=9)).first()["cost"] == 5


def test_an_empty_table_gives_no_rows(llm):
    turns = table(llm, [(1, 0, "user", "x")]).filter("false")
    assert repair.summaries(repair.repaired(repair.damage(turns), turns)).collect() == []
