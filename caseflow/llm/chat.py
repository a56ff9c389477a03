"""Chat formatting with a template as a black box.

A template is any function from a list of (role, text) turns to a string. Nothing is
assumed about it: the prefixes of a conversation are rendered one after the other, and
comparing consecutive outputs shows where each turn lies. If an output does not begin
with the one before it, the template rewrote history, and the spans of earlier turns
are not to be trusted. Where a turn's text lies within its span is found by rendering
the prefix with two different probe texts: what both outputs share at either end is
the template's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm.common import only, received, share

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# FIXED: the control strings of the template below.
CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?(?:INST|SYS|BOT|ROLE|NAME)\])")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?(?:INST|SYS|BOT|ROLE|NAME)\])")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[BOT] ", " [/BOT]"), "system": ("[SYS] ", " [/SYS]")}


def escape(text: str) -> str:
    """No control string is left: each, even one escaped before, gets a backslash inside."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class _Rendered(dict):
    """Turns as rendered before, up to a number of characters in all: a conversation's
    every prefix asks for the same ones again."""

    most, held = 32_000_000, 0

    def __missing__(self, turn: Turn) -> str:
        piece = _marked(*turn)
        if self.held + len(piece) > self.most:
            self.clear()
            self.held = 0
        self.held += len(piece) + 100
        self[turn] = piece
        return piece


_PIECES = _Rendered()


def _marked(role: str, text: str) -> str:
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = f"[ROLE] {escape(role)} [NAME] ", " [/ROLE]"
    return f"<s>{before}{escape(text)}{after}</s>"


def marked(turns: list[Turn]) -> str:
    """The library's own template: every turn between marks, control strings in texts escaped."""
    return "".join(map(_PIECES.__getitem__, turns))


def read_turn(segment: str) -> Turn:
    """The role and text of one turn that ``marked`` wrote."""
    body = segment[3:-4]
    for role, (before, after) in MARKS.items():
        if body.startswith(before):
            return role, unescape(body[len(before) : len(body) - len(after)])
    role, _, text = body[7:-8].partition(" [NAME] ")
    return unescape(role), unescape(text)


def _shared(a: str, b: str, limit: int | None = None) -> int:
    """Length of the longest common prefix, by halving on string comparison."""
    low, high = 0, min(len(a), len(b)) if limit is None else limit
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def spans(turns: list[Turn], template: Template, loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """The full output, each turn's span, the spans under the loss mask, and the turns
    (from 0) at which history was rewritten."""
    before, found, loss, rewritten = template([]), [], [], []
    for k in range(1, len(turns) + 1):
        prefix, (role, text) = turns[: k - 1], turns[k - 1]
        after = template(turns[:k])
        kept = len(before)
        if not after.startswith(before):
            rewritten.append(k - 1)
            kept = _shared(before, after)
        found.append((kept, len(after)))
        if role in loss_roles:
            one, two = template([*prefix, (role, "0")]), template([*prefix, (role, "1")])
            head = _shared(one, two)
            tail = _shared(one[:head - 1 : -1] if head else one[::-1], two[:head - 1 : -1] if head else two[::-1])
            if head + tail < len(one) and len(after) >= head + tail:
                loss.append((head, len(after) - tail))
        before = after
    if rewritten:  # only what the last output was seen to write is sure
        sure = rewritten[-1]
        found = [(0, 0)] * sure + found[sure:]
        loss = [x for x in loss if x[0] >= found[sure][0]]
    return before, found, loss, rewritten


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Conversations of rows that come ordered by conversation and turn, one at a time."""
    now, turns = None, None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns is None or conv != now:
                if turns is not None:
                    yield now, turns
                now, turns = conv, []
            turns.append((role or "", text or ""))
    if turns is not None:
        yield now, turns


def format_chats(conversations: DataFrame, template: Template = marked, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format every conversation and locate its turns.

    ``conversations`` needs ``conv_id``, ``turn``, ``role`` and ``text``, a row per turn.
    The result has a row per conv_id: conv_id, n_turns, formatted, turn_spans and
    loss_spans (code points in ``formatted``, end exclusive), rewritten (the turns,
    counted from 0, whose addition changed what stood before). Null roles and texts
    count as empty; turns with equal or null numbers go by role, then text, nulls first;
    repeated rows are turns of their own; rows without conv_id form one conversation;
    an empty table gives an empty one.

    Rows are dealt by conversation and sorted within tasks, so a task holds one
    conversation at a time, as its single output string must be. Rendering all prefixes
    costs the sum of their lengths.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    sent = share(conversations.sparkSession, (template, frozenset(loss_roles)))
    names = ["conv_id", "n_turns", "formatted", "turn_spans", "loss_spans", "rewritten"]
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, loss_roles = received(sent)
        rows: list[tuple] = []
        size, held = 0, None

        def out() -> pa.RecordBatch:
            as_structs = lambda xs: [{"start": a, "end": b} for a, b in xs]
            types = [held, pa.int64(), pa.string(), pair, pair, pa.list_(pa.int32())]
            values = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [as_structs(r[3]) for r in rows], [as_structs(r[4]) for r in rows], [r[5] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        def peek() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for batch in batches:
                held = batch.schema.field(0).type
                yield batch

        for conv, turns in conversations_of(peek()):
            rows.append((conv, len(turns), *spans(turns, template, loss_roles)))
            size += len(rows[-1][2])
            if size > 4_000_000:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    ordered = only(conversations, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pairs = "array<struct<start: long, end: long>>"
    return ordered.select("conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind}, n_turns long, formatted string, turn_spans {pairs}, loss_spans {pairs}, rewritten array<int>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the output of ``marked`` says, read back from its text and spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, turns, loss in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                whole, masked, chars = hashlib.sha256(), hashlib.sha256(), 0
                for span in turns:
                    role, said = read_turn(text[span["start"] : span["end"]])
                    whole.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    masked.update(said.encode())
                    chars += len(said)
                rows.append((len(turns), whole.hexdigest(), chars, masked.hexdigest(), len(text)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return formatted.select("conv_id", "formatted", "turn_spans", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
