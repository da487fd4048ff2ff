"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, every other part
becomes a placeholder and leaves an attachment record (kind, reference, place in the segment) with the number of tokens that the
placeholder expands to. Each turn becomes one segment ``<s>role[INST]content[/INST]</s>``; a conversation is its segments in
the order of turns, so a long conversation is never gathered.

Escaping is reversible and leaves no control string: a backslash is doubled, and a backslash is put after the first character
of every control string in a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StructType

# Fixed values of the template. Placeholders begin with "<|", so that is a control string too.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
LOSS_ROLE = "assistant"

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)

PART = StructType().add("type", "string").add("text", "string").add("ref", "string").add("width", "integer").add("height", "integer").add("seconds", "double").add("pages", "integer")
ATTACHMENT = StructType().add("kind", "string").add("ref", "string").add("at", "integer").add("tokens", "integer")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor of content parts; builds the content of one turn.

    Expanded tokens: an image has one token per patch, audio a fixed rate per second, a document a fixed number per page; a part
    whose size is unknown counts as one patch, second or page."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 768
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        """Unknown types are an error; a missing type is text."""
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        rows, columns = (math.ceil(max(1, part.get(side) or 1) / self.patch) for side in ("height", "width"))
        self._attach("image", part, rows * columns)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 1.0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._add(f"<|{kind}_{len(self.attachments)}|>")


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    """Segment of a turn, the code points under the loss mask, and its attachments with places in the segment."""
    flat = Flattener()
    for part in parts or []:
        flat.visit(part)
    head = f"<s>{escape(role or '')}[INST]"
    body = "".join(flat.pieces)
    loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return {"segment": f"{head}{body}[/INST]</s>", "loss_start": loss[0], "loss_end": loss[1],
            "attachments": [a | {"at": a["at"] + len(head)} for a in flat.attachments], "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and content, unescaped."""
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError("not one formatted turn")
    return unescape(found[1]), unescape(found[2])


def text_part(text: Column) -> Column:
    """A content list of one text part; a null text is empty."""
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields]))


def formatted(role: Column, parts: Column) -> Column:
    """``struct<segment, loss_start, loss_end, attachments, expanded_tokens>`` of a turn; a null role or list is empty."""
    kind = StructType().add("segment", "string").add("loss_start", "integer").add("loss_end", "integer").add("attachments", ArrayType(ATTACHMENT)).add("expanded_tokens", "long")

    @arrow_udf(kind)
    def turns(roles: pa.Array, contents: pa.Array) -> pa.Array:
        rows = [format_turn(r.as_py(), c.as_py()) for r, c in zip(roles, contents)]
        record = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())])
        return pa.array(rows, pa.struct([("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", pa.list_(record)),
                                         ("expanded_tokens", pa.int64())]))

    return turns(role, parts)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn``, segment, loss span and attachments. ``parts`` defaults to the text column as one part."""
    content = text_part(F.col(text)) if parts is None else parts
    return (turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), formatted(F.col(role), content).alias("f")).select("conv_id", "turn", "f.*"))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from its segments in the order of turns.

    A conversation passes through one task as a stream with two running hashes, so its length is not held in memory. Equal turn
    numbers are ordered by their segment; null turns come first; rows without a conversation id are one conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def closed() -> dict:
            return {"conv_id": now["id"], "n_turns": now["turns"], "turns_sha256": now["all"].hexdigest(), "loss_chars": now["loss"], "loss_sha256": now["under"].hexdigest(), "formatted_chars": now["chars"]}

        for batch in batches:
            for conv, segment, start, end in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_end"))):
                if now is None or now["id"] != conv:
                    if now is not None:
                        rows.append(closed())
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "under": hashlib.sha256(), "loss": 0, "chars": 0}
                role, text = parse_segment(segment)
                now["all"].update(f"{role}\n{text}\n".encode())
                learned = unescape(segment[start:end])
                now["under"].update(learned.encode())
                now["turns"] += 1
                now["loss"] += len(learned)
                now["chars"] += len(segment)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=_READ)

    ordered = segments.select(F.col("conv_id").cast("long"), "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(stream, schema)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
