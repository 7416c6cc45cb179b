"""Chat formatting by incremental rendering of a template that is a black box.

A template turns a list of turns into text, and nothing else is known of it. Successive
prefixes of a conversation are rendered, and the outputs for one turn less and one turn
more are compared: their common beginning and end leave the span that the turn put in. If
the two do not cover the earlier output, the template has rewritten history, and the turn
is marked. The place of a turn's text inside its span is found by rendering a sign in its
place.

Conversations are read as a stream of sorted rows, and output is written turn by turn. Each
row of the output is an edit: keep so many characters of what is there, then append the
piece. No turn is left out of a rendering, whatever the template: every prefix is rendered
whole, from the first turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turns = list[tuple[str, str]]

#: Fixed values of the template used here: what ends a turn's text, and what a backslash comes before inside texts and roles.
END = "</turn>"
CONTROLS, ROLE_CONTROLS = ("\\", "###", END), ("\\", "###", END, ":")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+)</turn>\n")


def _escaped(text: str, controls: tuple[str, ...]) -> str:
    for control in controls:  # the backslash first
        text = text.replace(control, "\\" + control)
    return text


def render(turns: Turns) -> str:
    """The template used here: ``### role: text </turn>`` on a line each, control strings inside texts behind a backslash."""
    return "".join(f"### {_escaped(role, ROLE_CONTROLS)}: {_escaped(text, CONTROLS)} {END}\n" for role, text in turns)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> tuple[Turns, int]:
    """The whole turns at the start of a formatted text, and where they end."""
    turns, at = [], 0
    while found := _TURN.match(formatted, at):
        turns.append((unescape(found.group(1)), unescape(found.group(2)[:-1])))  # without the space before the end
        at = found.end()
    return turns, at


@dataclass(frozen=True)
class Edit:
    """What one turn does to the output: keep ``keep`` characters, append ``piece``. Text places count from the start of the output."""

    keep: int
    piece: str
    text_start: int | None
    text_end: int | None
    rewrites: bool


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _inserted(before: str, after: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end beside it."""
    head = _common(before, after)
    return head, _common(before[head:][::-1], after[head:][::-1])


def _sign(text: str) -> str:
    """A string that a text does not hold and that never overlaps itself: one character or, where all are taken, one and a longer run than any."""
    free = next((c for c in map(chr, range(0xE000, 0xF900)) if c not in text), None)
    return free or "\ue000" + "\ue001" * (1 + max(map(len, re.findall("\ue001+", text))))


class Incremental:
    """The state of one conversation: its turns, or the last ones for a caller that gives a ``lookback``, and how long the output is."""

    def __init__(self, template: Callable[[Turns], str], lookback: int | None = None):
        self.template, self.lookback = template, None if lookback is None else max(1, lookback)
        self.turns: Turns = []
        self.output, self.offset = "", 0  # the turns that are held, rendered; characters of the output before them

    def add(self, role: str, text: str) -> Edit:
        if self.lookback is not None and len(self.turns) >= 2 * self.lookback:
            self.turns = self.turns[-self.lookback:]
            shorter = self.template(self.turns)
            self.offset += len(self.output) - len(shorter)
            self.output = shorter
        after = self.template([*self.turns, (role, text)])
        head, tail = _inserted(self.output, after)
        rewrites = head + tail < len(self.output)
        start = end = None
        empty = self.template([*self.turns, (role, "")])
        sign = _sign(empty + after)
        marked = self.template([*self.turns, (role, sign)])
        at = marked.find(sign)
        if at >= 0:
            closing = marked[at + len(sign):]
            if after.startswith(marked[:at]) and after.endswith(closing) and at + len(closing) <= len(after):
                start, end = self.offset + at, self.offset + len(after) - len(closing)
        self.turns.append((role, text))
        self.output = after
        return Edit(self.offset + head, after[head:], start, end, rewrites)


SCHEMA = "conv_id long, number long, role string, keep long, piece string, text_start long, text_end long, loss boolean, rewrites boolean"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
#: Characters of pieces that are written at a time.
WRITTEN = 4_000_000


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = render, loss_roles: tuple[str, ...] = ("assistant",),
                         id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per turn, in the order of the output: conv_id, number (from 0), role, the edit, the text's place, and whether it bears loss.

    Turns go by turn number, then role and text, nulls first; a null role or text is empty.
    Repeated rows and repeated turn numbers are turns of their own. Rows without a conv_id
    are one conversation. ``text_start`` and ``text_end`` are the places of what stands for the
    text in the output after the turn, null if the template leaves the text out. ``rewrites`` marks a turn at which
    earlier output changed; from there on, earlier places do not hold any more. An empty
    table gives no rows; other columns are ignored.

    A conversation is a sequence, so its rows pass one task, as a stream. The template is
    given every turn so far each time, so time grows with the square of a conversation's
    turns, and one conversation is held in memory.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    table = rows.select(F.col(id_column).cast("bigint").alias("conv_id"), F.col(turn_column).alias("turn"), F.col(role_column).alias("role"),
                        F.col(text_column).alias("text"))

    def formatted(batches):
        state, current, number, out, size = None, object(), 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(n) for n in range(3))):
                conv, role, text = conv.as_py(), role.as_py() or "", text.as_py() or ""
                if state is None or conv != current:
                    state, current, number = Incremental(template), conv, 0
                edit = state.add(role, text)
                out.append((conv, number, role, edit.keep, edit.piece, edit.text_start, edit.text_end, role in loss_roles, edit.rewrites))
                number, size = number + 1, size + len(edit.piece)
                if size > WRITTEN:
                    yield _written(out)
                    out, size = [], 0
        yield _written(out)

    dealt = table.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(formatted, SCHEMA)


def _written(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], [f.split()[0] for f in SCHEMA.split(", ")])


class _Reading:
    """The digest of one conversation, from its edits in order."""

    def __init__(self):
        self.turns = self.length = self.loss = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.open, self.rewritten = "", False  # output after the last whole turn

    def take(self, keep: int, piece: str, start: int | None, end: int | None, loss: bool, rewrites: bool) -> None:
        self.rewritten |= rewrites or keep != self.length
        base, self.length = keep, keep + len(piece)
        self.open += piece
        turns, at = parse(self.open)
        self.open = self.open[at:]
        self.turns += len(turns)
        for role, text in turns:
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss and start is not None:
            text = unescape(piece[start - base:end - base])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        broken = self.rewritten or bool(self.open)
        return (conv, self.turns, None if broken else self.all.hexdigest(), self.loss, None if broken else self.masked.hexdigest(), self.length, broken)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, unreadable.

    Reads what ``format_conversations`` wrote with ``render``, as it stands or after it was
    stored and dealt out again in any way that keeps a conversation's rows in order in one
    partition. Where history was rewritten or a part is no whole turn, ``unreadable`` is true
    and the digests are null.
    """
    def read(batches):
        known, current, out = None, object(), []
        for batch in batches:
            for row in zip(*(batch.column(n) for n in (0, 3, 4, 5, 6, 7, 8))):
                conv, *edit = (value.as_py() for value in row)
                if known is None or conv != current:
                    if known is not None:
                        out.append(known.row(current))
                    known, current = _Reading(), conv
                known.take(*edit)
        if known is not None:
            out.append(known.row(current))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema(list(zip(names, kinds))))

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "unreadable")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                      "formatted_chars long, unreadable boolean")
