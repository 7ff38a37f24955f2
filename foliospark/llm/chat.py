"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import only

#: Open and close marks of the known roles; the assistant's turn needs no open mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
#: Marks of any other role, which is written in the open mark.
OTHER = ("<|role:", "|>", "<|end|>")
START = "<s>"
#: Every mark starts with < or [, so texts that hold neither hold no mark.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_TABLE, _BACK = str.maketrans(ESCAPES), {v[1]: k for k, v in ESCAPES.items()}


def escape(text: str) -> str:
    """Write a text without any character that starts a mark."""
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    if "\\" not in text:
        return text
    first, *rest = text.split("\\")
    out, at = [first], 0
    while at < len(rest):
        part = rest[at]
        if part:
            out.append(_BACK[part[0]] + part[1:])
        else:
            out.append("\\" + rest[at + 1])
            at += 1
        at += 1
    return "".join(out)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final messages (role, text) of one conversation's events (op, turn, role, text) in order.

    message: a new message. delta: append to the last message of the turn, or start it. edit: replace the text
    of the turn's last message. delete: drop the turn's messages. regenerate: drop the turn's messages of this role and all that came
    after them, then start anew. An op that is null or unknown is a message; null texts and roles are empty.
    """
    done: list[list] = []
    for op, turn, role, text in events:
        role, text = role or "", text or ""
        last = next((m for m in reversed(done) if m[0] == turn), None) if op in ("delta", "edit") else None
        if op == "delta" and last is not None:
            last[2].append(text)
        elif op == "edit" and last is not None:
            last[2] = [text]
        elif op == "edit":
            continue
        elif op == "delete":
            done = [m for m in done if m[0] != turn]
        else:
            if op == "regenerate":
                at = next((n for n, m in enumerate(done) if m[0] == turn and m[1] == role), len(done))
                done = done[:at]
            done.append([turn, role, [text]])
    return [(role, "".join(parts)) for _, role, parts in done]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the assistant's texts in it (code points)."""
    out, spans, at = [START], [], len(START)
    for role, text in messages:
        head, tail = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation."""
    at, found = len(START), []
    while at < len(text):
        role = "assistant"
        if text.startswith(OTHER[0], at):
            end = text.index(OTHER[1], at)
            role, at, close = unescape(text[at + len(OTHER[0]) : end]), end + len(OTHER[1]), OTHER[2]
        else:
            role = next((r for r in ("system", "user") if text.startswith(MARKS[r][0], at)), "assistant")
            at, close = at + len(MARKS[role][0]), MARKS[role][1]
        end = text.index(close, at)
        found.append((role, unescape(text[at:end])))
        at = end + len(close)
    return found


_RENDERED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold and render the conversations of one partition, whose rows are sorted by conversation."""
    rows: list[tuple] = []
    size = 0

    def done(conv: int | None, events: list[tuple]) -> None:
        text, spans = render(fold(iter(events)))
        rows.append((conv, text, [{"start": a, "end": b} for a, b in spans]))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RENDERED, strict=True)], schema=_RENDERED)

    now: int | None = None
    events: list[tuple] = []
    for part in batches:
        for conv, *event in zip(*(part.column(n).to_pylist() for n in ("conv_id", "op", "turn", "role", "text")), strict=True):
            if events and conv != now:
                done(now, events)
                size += len(rows[-1][1])
                events = []
                if size > 8 << 20:
                    yield batch()
                    rows.clear()
                    size = 0
            now = conv
            events.append(tuple(event))
    if events:
        done(now, events)
    if rows:
        yield batch()


def format_chats(events: DataFrame) -> DataFrame:
    """Rebuild and render conversations: conv_id, formatted, loss (spans of the assistant's text).

    ``events`` has conv_id, seq, op, turn, role, text. Logs are dealt by conversation and sorted by seq, ties by
    turn, role, text and op, nulls first; repeated rows are events each. Rows with null conv_id are one
    conversation. The sort spills; a task folds one conversation at a time and holds only that one, whose
    rendering is one row in any case. Extra columns are ignored; an empty table gives no rows.
    """
    rows = only(events, "conv_id", "seq", "op", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("string").alias("op"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "role", "text", "op")
    return dealt.mapInArrow(_conversations, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def as_events(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as message events in order of their turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), "turn", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        out: list[list] = [[] for _ in range(5)]
        for text, loss in zip(part.column("formatted"), part.column("loss").to_pylist(), strict=True):
            text = text.as_py()
            messages = parse(text)
            turns = "".join(f"{role}\n{body}\n" for role, body in messages)
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            values = (len(messages), turns, len(learned), learned, len(text))
            for column, value in zip(out, values, strict=True):
                column.append(hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest() if isinstance(value, str) else value)
        yield pa.RecordBatch.from_arrays([part.column("conv_id"), *map(pa.array, out)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations again and digest their turns and the text under the loss mask."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
