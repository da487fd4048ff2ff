"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. What has been written so far is in one of four states
(nothing, after s, after u, after a), so an edit of a row is a step between states, and a stretch of rows is a 4 x 4 table of least
costs. Forward costs from the start and backward costs from the end meet in the middle; of the states where their sum is least, the one
with the ASCII-least audit is the crossing, and both halves are solved in the same way. Only vectors of four costs are kept.

The crossing is told by ranks: from a state, a letter leads to one state only, and a prefix ends with the edit of a row, so of two
different prefixes over the same rows neither begins the other. Their order never changes by what follows, and the order of four
states is all that a forward vector carries.

Rows are dealt out by ranges of their place, so a long conversation is cut into segments. Each gives its table; a conversation
joins the tables of its segments, finds the states at their borders by the same recursion, and segments are then solved on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import written

SEGMENT = 4096  # rows
NEVER = 1 << 40

# States by the initial written last, faults, and what ends a sentence.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL_PAIRS = {"su", "ua", "au"}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
WHITE = "\\x20\\x09-\\x0D"


@dataclass(frozen=True)
class Costs:
    """What edits cost; all but keeping must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Table:
    """Least cost from each state to each, and the order of the audits that leave one state."""

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...]


def row_code(role: str, fault: int) -> int:
    """A row as one small number: the state that its role leads to, and its fault. A role without initial s, u or a is never kept."""
    return INITIALS.get(role[:1], START) + 4 * fault


@lru_cache(maxsize=None)
def row_steps(code: int, costs: Costs) -> tuple[tuple[tuple[int, str, tuple[int, ...]] | None, ...], ...]:
    """For a row: cost, letters and states written, from each state to each; None where no edit leads."""
    kind, fault = code % 4, code // 4
    found: dict[tuple[int, int], tuple[int, str, tuple[int, ...]]] = {}
    for start in range(4):
        chains = {start: (0, "", ())}
        for _ in range(3):  # inserts before the row's own edit; longer chains come back to a state
            for state, (cost, letters, made) in list(chains.items()):
                for to in NEXT[state]:
                    if to != SYSTEM:
                        chains[to] = min(chains.get(to, (NEVER,)), (cost + costs.insert, letters + "I", made + (to,)))
        for state, (cost, letters, made) in chains.items():
            edits = [(cost + costs.delete, letters + "D", made, state)]
            if fault not in (BLANK, DUPLICATE):
                extra = costs.truncated if fault == TRUNCATED else 0
                for to in NEXT[state]:
                    if to == kind:
                        edits.append((cost + extra, letters + "K", made + (to,), to))
                    if to != SYSTEM:
                        edits.append((cost + extra + costs.rerole, letters + "R", made + (to,), to))
            for spent, audit, done, to in edits:
                found[start, to] = min(found.get((start, to), (NEVER,)), (spent, audit, done))
    return tuple(tuple(found.get((p, q)) for q in range(4)) for p in range(4))


def endings(costs: Costs) -> tuple[tuple[int, str, tuple[int, ...]], ...]:
    """For each state, the inserts that make it a legal end."""
    return ((0, "", ()), (2 * costs.insert, "II", (USER, ASSISTANT)), (costs.insert, "I", (ASSISTANT,)), (0, "", ()))


@lru_cache(maxsize=None)
def row_table(code: int, costs: Costs) -> Table:
    steps = row_steps(code, costs)
    order = []
    for row in steps:
        audits = sorted({s[1] for s in row if s})
        order.append(tuple(audits.index(s[1]) if s else 0 for s in row))
    return Table(tuple(tuple(s[0] if s else NEVER for s in row) for row in steps), tuple(order))


Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs of four states, and the order of their least audits


def entry(state: int) -> Vector:
    return tuple(0 if q == state else NEVER for q in range(4)), (0, 0, 0, 0)


@lru_cache(maxsize=1 << 16)
def _forward(vector: Vector, table: Table) -> Vector:
    costs, order = vector
    best = [min((costs[p] + table.cost[p][q], order[p], table.order[p][q]) if costs[p] < NEVER and table.cost[p][q] < NEVER else (NEVER, 0, 0) for p in range(4)) for q in range(4)]
    audits = sorted({b[1:] for b in best if b[0] < NEVER})
    return tuple(b[0] for b in best), tuple(audits.index(b[1:]) if b[0] < NEVER else 0 for b in best)


def forward(vector: Vector, tables: Sequence[Table], lo: int, hi: int) -> Vector:
    """The vector after ``tables[lo:hi]``. Costs are kept relative to the least, so that few different steps occur."""
    spent = 0
    for k in range(lo, hi):
        vector = _forward(vector, tables[k])
        least = min(vector[0])
        if least:
            spent += least
            vector = tuple(c - least if c < NEVER else NEVER for c in vector[0]), vector[1]
    return tuple(c + spent if c < NEVER else NEVER for c in vector[0]), vector[1]


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    return tuple(min(NEVER, *(table.cost[p][q] + costs[q] for q in range(4))) for p in range(4))


def backward(costs: tuple[int, ...], tables: Sequence[Table], lo: int, hi: int) -> tuple[int, ...]:
    """Costs from each state before ``tables[lo:hi]`` to the end."""
    spent = 0
    for k in range(hi - 1, lo - 1, -1):
        costs = _backward(costs, tables[k])
        least = min(costs)
        spent += least
        costs = tuple(c - least if c < NEVER else NEVER for c in costs)
    return tuple(c + spent if c < NEVER else NEVER for c in costs)


def crossings(tables: Sequence[Table], start: int, end: int) -> list[int]:
    """The states after each table on the audit-least of the cheapest ways from ``start`` to ``end``."""
    out = [end] * len(tables)

    def solve(lo: int, hi: int, start: int, end: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        there, order = forward(entry(start), tables, lo, mid)
        back = backward(tuple(0 if q == end else NEVER for q in range(4)), tables, mid, hi)
        state = min(range(4), key=lambda q: (there[q] + back[q], order[q]))
        out[mid - 1] = state
        solve(lo, mid, start, state)
        solve(mid, hi, state, end)

    solve(0, len(tables), start, end)
    return out


def joined(tables: Sequence[Table]) -> Table:
    """One table for a run of tables."""
    rows = [forward(entry(p), tables, 0, len(tables)) for p in range(4)]
    return Table(tuple(r[0] for r in rows), tuple(r[1] for r in rows))


def last_state(tables: Sequence[Table], costs: Costs) -> int:
    """The state after the last table on the audit-least of the cheapest ways from the start to a legal end."""
    there, order = forward(entry(START), tables, 0, len(tables))
    return min(range(4), key=lambda q: (there[q] + endings(costs)[q][0], order[q]))


def row_edits(codes: bytes, start: int, end: int, costs: Costs) -> list[tuple[str, tuple[int, ...]]]:
    """Letters and states written for each row, between two states."""
    states = crossings([row_table(c, costs) for c in codes], start, end)
    return [row_steps(code, costs)[p][q][1:] for code, p, q in zip(codes, [start, *states], states)]


# ---------------------------------------------------------------- damage and faults


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that ``crc32(conv_id:turn) % 20`` names; nulls in the key, roles and texts are one space.

    Rows that share id and turn suffer the same."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                                           F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    return hurt.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "again")


def faulty(turns: DataFrame) -> DataFrame:
    """Distinct rows with how often they occur (``copies``), and ``first_fault`` and ``later_fault`` of the first copy and the others.

    A row is a duplicate if an earlier one of its conversation has its role and text. Rows come by turn, nulls first, then by role
    and ``digest`` of the text; equal rows are one row here, so a hot row does not grow a group. A null role or text reads as empty."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
            .groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("text").alias("text")))
    key = [F.col("conv_id").eqNullSafe(F.col("c")), F.col("role") == F.col("r"), F.col("digest") == F.col("d")]
    firsts = (turns.select(F.col("conv_id").alias("c"), role.alias("r"), F.sha2(text, 256).alias("d"), "turn").groupBy("c", "r", "d")
              .agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("at")))
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    own = F.when(blank, BLANK).when(~F.col("text").rlike(f"[.!?][{WHITE}]*\\z"), TRUNCATED).otherwise(SOUND)
    joined_rows = rows.join(firsts, (key[0] & key[1] & key[2]), "left")
    first = F.col("turn").eqNullSafe(F.col("at.turn"))
    return joined_rows.select("conv_id", "turn", "role", "text", "digest", "copies", F.when(blank | first, own).otherwise(DUPLICATE).alias("first_fault"),
                              F.when(blank, BLANK).otherwise(DUPLICATE).alias("later_fault"))


def _initial(role: Column) -> Column:
    return F.when(role.startswith("s"), SYSTEM).when(role.startswith("u"), USER).when(role.startswith("a"), ASSISTANT).otherwise(START)


# ---------------------------------------------------------------- tables of segments


def _runs(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[tuple[object, bytes]]:
    """Conversation and codes of every segment of a partition that is sorted by conversation."""
    now, codes, begun = None, bytearray(), False
    for batch in batches:
        for conv, first, later, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "first", "later", "copies"))):
            if begun and (conv != now or len(codes) >= segment):
                yield now, bytes(codes)
                codes = bytearray()
            now, begun = conv, True
            codes.append(first)
            left = copies - 1
            while left:
                if len(codes) >= segment:
                    yield now, bytes(codes)
                    codes = bytearray()
                step = min(left, segment - len(codes))
                codes += bytes([later]) * step
                left -= step
    if begun:
        yield now, bytes(codes)


def _segments(rows: DataFrame, costs: Costs, segment: int) -> DataFrame:
    """``conv_id, part, seq, codes, table`` of the segments, in the order of ``part`` and ``seq``."""
    code = lambda fault: (_initial(F.col("role")) + F.col(fault) * 4).alias(fault.split("_")[0])
    compact = (rows.select("conv_id", "turn", "role", "digest", "copies", code("first_fault"), code("later_fault"))
               .repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
               .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
               .select("conv_id", "first", "later", "copies"))
    names = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64()))])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        for seq, (conv, codes) in enumerate(_runs(batches, segment)):
            table = joined([row_table(c, costs) for c in codes])
            out.append({"conv_id": conv, "part": part, "seq": seq, "codes": codes, "costs": sum(table.cost, ()), "orders": sum(table.order, ())})
            if len(out) == 500:
                yield pa.RecordBatch.from_pylist(out, schema=names)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=names)

    return compact.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(tables, "conv_id long, part long, seq long, codes binary, costs array<long>, orders array<long>")


def _borders(costs: Costs):
    """The states before and after each segment; rows come sorted by conversation, part and seq. Of a conversation only the tables
    are held, 32 numbers for ``SEGMENT`` rows."""
    names = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])
    four = lambda flat: tuple(tuple(flat[k : k + 4]) for k in (0, 4, 8, 12))

    def solved(rows: list[tuple]) -> list[tuple]:
        tables = [Table(four(r[3]), four(r[4])) for r in rows]
        states = crossings(tables, START, last_state(tables, costs))
        return [(*r[:3], p, q, k == len(rows) - 1) for k, (r, p, q) in enumerate(zip(rows, [START, *states], states))]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "seq", "costs", "orders"))):
                if rows and row[0] != rows[0][0]:
                    made += solved(rows)
                    rows = []
                rows.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), names)], schema=names)
                made = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*solved(rows)), names)], schema=names)

    return solve


def edits(rows: DataFrame, costs: Costs = Costs(), segment: int = SEGMENT) -> DataFrame:
    """``conv_id, part, seq, audits, roles``: for every row of a segment its letters (inserts before it included) and the roles written.

    Letters of one row end with its own edit; after the last row of a conversation there may be inserts alone."""
    found = written(_segments(rows, costs, segment), "segments")
    borders = (found.drop("codes").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
               .mapInArrow(_borders(costs), "conv_id long, part long, seq long, start int, end int, last boolean"))
    names = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = {START: "", SYSTEM: "s", USER: "u", ASSISTANT: "a"}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                made = row_edits(r["codes"], r["start"], r["end"], costs)
                if r["last"] and endings(costs)[r["end"]][1]:
                    made.append(endings(costs)[r["end"]][1:])
                out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "audits": [m[0] for m in made], "roles": ["".join(letter[s] for s in m[1]) for m in made]})
            yield pa.RecordBatch.from_pylist(out, schema=names)

    one = found.drop("costs", "orders").withColumnRenamed("conv_id", "c").alias("s")
    both = one.join(borders, F.col("c").eqNullSafe(F.col("conv_id")) & (one["part"] == borders["part"]) & (one["seq"] == borders["seq"]))
    return both.select("conv_id", one["part"], one["seq"], "codes", "start", "end", "last").mapInArrow(solve, "conv_id long, part long, seq long, audits array<string>, roles array<string>")


# ---------------------------------------------------------------- repaired rows

_REPAIRED = "conv_id long, turn long, role string, text string, digest string, fault int, audit string, written array<struct<role: string, text: string>>"


def repaired(turns: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs(), segment: int = SEGMENT) -> DataFrame:
    """Every row with its ``fault``, its ``audit`` letters and the rows ``written`` in its place, conversation by conversation in order.

    ``turns`` needs ``conv_id, turn, role, text`` (others are not read); conversations of ``ids`` without rows, and inserts after
    the last row, give a row with a null fault. Rows with null ids are one conversation, null turns come first, equal
    rows are taken one by one, and an empty table gives no rows. A conversation passes through one task as a stream, as its digest must; of
    it, one letter for each row is held there, texts are not."""
    rows = written(faulty(turns), "faults")
    made = edits(rows, costs, segment)
    named = turns.select("conv_id") if ids is None else turns.select("conv_id").unionAll(ids.select("conv_id"))
    marks = named.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    stream = (marks.select("conv_id", F.lit(0).alias("kind"), empty("part", "long"), empty("seq", "long"), empty("turn", "long"), empty("role", "string"), empty("text", "string"), empty("digest", "string"),
                           empty("copies", "long"), empty("first_fault", "int"), empty("later_fault", "int"), empty("audits", "array<string>"), empty("roles", "array<string>"))
              .unionByName(made.select("*", F.lit(1).alias("kind")), allowMissingColumns=True)
              .unionByName(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest", "copies", "first_fault", "later_fault", F.lit(2).alias("kind")), allowMissingColumns=True))
    asc = lambda c: F.col(c).asc_nulls_first()
    ordered = stream.repartition("conv_id").sortWithinPartitions(asc("conv_id"), "kind", "part", "seq", asc("turn"), "role", "digest")
    role_of = {"s": None, "u": NAMES[USER], "a": NAMES[ASSISTANT]}
    kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("fault", pa.int32()), ("audit", pa.string()),
                      ("written", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits, roles, at, conv = [], [], 0, None

        def row(turn, role, text, digest, fault) -> dict:
            nonlocal at
            audit, states = audits[at], roles[at]
            at += 1
            new = [{"role": role_of[s], "text": ""} for s in states]
            if audit[-1] in "KR":
                new[-1] = {"role": role if audit[-1] == "K" else new[-1]["role"], "text": text}
            return {"conv_id": conv, "turn": turn, "role": role, "text": text, "digest": digest, "fault": fault, "audit": audit, "written": new}

        def tail() -> list[dict]:
            extra = [{"role": role_of[s], "text": ""} for s in "".join(roles[at:])]
            return [{"conv_id": conv, "audit": "".join(audits[at:]), "written": extra}]

        begun = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if begun:
                        out += tail()
                    audits, roles, at, conv, begun = [], [], 0, r["conv_id"], True
                elif r["kind"] == 1:
                    audits += r["audits"]
                    roles += r["roles"]
                else:
                    for k in range(r["copies"]):
                        out.append(row(r["turn"], r["role"], r["text"], r["digest"], r["later_fault"] if k else r["first_fault"]))
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_pylist(out, schema=kind)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if begun:
            yield pa.RecordBatch.from_pylist(tail(), schema=kind)

    return ordered.mapInArrow(emit, _REPAIRED)


def summaries(fixed: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``repaired`` rows: gaps, faults, illegal neighbours, cost, audit and digest of what was written."""
    names = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def fresh(conv) -> dict:
            return {"conv_id": conv, "turns": [None, None, 0], "faults": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False, "before": None}

        def closed() -> dict:
            low, high, distinct = now["turns"]
            return {"conv_id": now["conv_id"], "gaps": high - low + 1 - distinct if distinct else 0, "blank": now["faults"][BLANK], "duplicate": now["faults"][DUPLICATE],
                    "truncated": now["faults"][TRUNCATED], "illegal": now["illegal"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None:
                    now = fresh(r["conv_id"])
                for new in r["written"]:
                    now["hash"].update(f"{chr(10) if now['any'] else ''}{new['role']}:{new['text']}".encode())
                    now["any"] = True
                now["audit"].append(r["audit"])
                now["cost"] += sum({"I": costs.insert, "D": costs.delete, "R": costs.rerole, "K": 0}[c] for c in r["audit"])
                if r["fault"] is None:  # the end of a conversation
                    out.append(closed())
                    now = None
                    continue
                now["cost"] += costs.truncated * (r["fault"] == TRUNCATED and r["audit"][-1] != "D")
                now["faults"][r["fault"]] += 1
                initial = r["role"][:1]
                now["illegal"] += now["before"] is not None and now["before"] + initial not in LEGAL_PAIRS
                now["before"] = initial
                turns = now["turns"]
                if r["turn"] is not None and r["turn"] != turns[1]:
                    now["turns"] = [r["turn"] if turns[0] is None else turns[0], r["turn"], turns[2] + 1]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=names)

    return fixed.mapInArrow(digest, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
