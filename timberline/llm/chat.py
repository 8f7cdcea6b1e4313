"""Chat formatting by event-sourced reconstruction.

A log of events (message starts, streamed deltas, edits, regenerations) is partitioned by conversation and
sorted by message and sequence number; one streaming pass folds the events of each message into its final
text and renders the messages into segments of bounded size with a loss mask. ``parse`` reads
segments back into messages.

Template: ``### role: text </turn>\\n``. Inside role and text the characters ``\\``, ``#`` and ``<`` (in
the role also ``:``) carry a backslash, so no control string can occur there, and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import map_arrow

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Code points after which a segment is closed; a longer single turn is a segment of its own.
SEGMENT = 65_536
#: Role whose texts are under the loss mask.
LEARNED_ROLE = "assistant"

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"([\\#<{also}])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role, ':')}{MIDDLE}"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a segment; raises if anything in it is not a turn."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at offset {at}")
    return out


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the events of an already finished log: a start and one delta a turn.

    Every row is a message of its own: of rows with equal conv_id and turn the order is by role and text.
    """
    parts = F.array(
        F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("payload")),
        F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("delta").alias("kind"), F.coalesce("text", F.lit("")).alias("payload")),
    )
    # The row's own number keeps equal rows apart; they are interchangeable, so it may differ between runs.
    tie = F.concat_ws("|", F.coalesce("role", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256), F.monotonically_increasing_id().cast("string"))
    numbered = turns.select("conv_id", F.col("turn").cast("bigint").alias("message"), F.coalesce("role", F.lit("")).alias("role"), "text", tie.alias("tie"))
    return numbered.select("conv_id", "message", "role", "tie", F.explode(parts).alias("e")).select("conv_id", "message", "role", "tie", "e.seq", "e.kind", "e.payload")


def turns_as_log(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of how their texts could have come about, which ends in the same texts.

    Each message streams in two deltas. Assistant messages break off after the first, are regenerated and
    stream again; of the others those with an even turn get a further delta, and are edited to their text at last.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda seq, kind, payload: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    none = F.lit(None)
    plain = [event(0, "start", none), event(1, "delta", first), event(5, "delta", rest)]
    again = [event(0, "start", none), event(1, "delta", first), event(2, "regenerate", none), event(3, "delta", first), event(5, "delta", rest)]
    edited = [*plain, event(6, "delta", F.lit(" (draft)")), event(7, "edit", text)]
    parts = F.when(F.col("role") == LEARNED_ROLE, F.array(*again)).when(F.col("turn") % 2 == 0, F.array(*edited)).otherwise(F.array(*plain))
    tie = F.concat_ws("|", F.coalesce("role", F.lit("")), F.sha2(text, 256), F.monotonically_increasing_id().cast("string"))
    numbered = turns.select("conv_id", F.col("turn").cast("bigint").alias("message"), F.coalesce("role", F.lit("")).alias("role"), tie.alias("tie"), parts.alias("parts"))
    return numbered.select("conv_id", "message", "role", "tie", F.explode("parts").alias("e")).select("conv_id", "message", "role", "tie", "e.seq", "e.kind", "e.payload")


@dataclass
class _Conversation:
    """What is open while one conversation streams past."""

    conv: object
    number: int = 0
    parts: list[str] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    size: int = 0

    def add(self, role: str, text: str) -> None:
        turn, start, end = render_turn(role, text)
        if role == LEARNED_ROLE:
            self.spans.append({"start": self.size + start, "end": self.size + end})
        self.parts.append(turn)
        self.size += len(turn)

    def flush(self) -> Iterator[dict]:
        if self.parts:
            yield {"conv_id": self.conv, "segment": self.number, "formatted": "".join(self.parts), "loss_spans": self.spans}
            self.number, self.parts, self.spans, self.size = self.number + 1, [], [], 0


class Fold:
    """The state of one message: ``start`` opens an attempt, ``delta`` appends, ``edit`` replaces, ``regenerate`` discards.

    The last non-null role given by any event is the message's role.
    """

    def __init__(self):
        self.role, self.deltas = "", []

    def apply(self, kind: str, role: str | None, payload: str | None) -> None:
        self.role = self.role if role is None else role
        if kind == "regenerate":
            self.deltas = []
        elif kind == "edit":
            self.deltas = [payload or ""]
        elif kind == "delta":
            self.deltas.append(payload or "")
        elif kind != "start":
            raise ValueError(f"unknown event kind {kind!r}")

    def text(self) -> str:
        return "".join(self.deltas)


def format_conversations(events: DataFrame) -> DataFrame:
    """Returns (conv_id, segment, formatted, loss_spans), segments of about ``SEGMENT`` code points of whole turns.

    ``events``: conv_id, message (its place in the conversation), seq (order in the log), kind, role,
    payload, and optionally tie (tells apart messages that share a place). ``loss_spans`` are
    code-point ranges of ``formatted`` that hold assistant texts. Null payloads count as empty, a role
    null in all events of a message as empty, null conv_ids as one conversation. Events with equal seq
    apply in the order of kind and payload. Only one message is held at a time, so a conversation of any
    length streams through its task; a conversation without events has no row. Other columns are dropped.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    tie = F.col("tie") if "tie" in events.columns else F.lit("")
    narrow = events.select("conv_id", F.col("message").cast("bigint"), "role", tie.alias("tie"), F.col("seq").cast("bigint"), "kind", "payload")
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "message", "tie", "seq", "kind", "payload")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conversation: _Conversation | None = None
        fold, key = Fold(), None
        for batch in batches:
            for e in batch.to_pylist():
                at = (e["conv_id"], e["message"], e["tie"])
                if conversation and at != key:
                    conversation.add(fold.role, fold.text())
                    if at[0] != conversation.conv or conversation.size >= SEGMENT:
                        yield from conversation.flush()
                if at != key or conversation is None:
                    fold, key = Fold(), at
                if conversation is None or at[0] != conversation.conv:
                    conversation = _Conversation(at[0])
                fold.apply(e["kind"], e["role"], e["payload"])
        if conversation:
            conversation.add(fold.role, fold.text())
            yield from conversation.flush()

    return map_arrow(narrow, rows, f"conv_id {kind}, segment bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>", 200)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads segments back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    ``turns_sha256`` is over role, newline, text, newline of each turn; the loss columns are over the
    unescaped texts under the mask. Segments of a conversation stream past in order.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row, turns, loss = None, None, None

        def done() -> Iterator[dict]:
            if row:
                yield row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            for s in batch.to_pylist():
                if row is None or s["conv_id"] != row["conv_id"]:
                    yield from done()
                    row = {"conv_id": s["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(s["formatted"]):
                    turns.update(f"{role}\n{text}\n".encode())
                    row["n_turns"] += 1
                for span in s["loss_spans"]:
                    text = unescape(s["formatted"][span["start"] : span["end"]])
                    loss.update(text.encode())
                    row["loss_chars"] += len(text)
                row["formatted_chars"] += len(s["formatted"])
        yield from done()

    return map_arrow(ordered, rows, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
