"""Conversations as training text, read back by a parser before anything is written.

The grammar. A turn is ``<s>[INST] text [/INST]`` for a user, ``<s>[ASST] text </s>`` for an assistant,
``<s>[SYS] text [/SYS]`` for a system turn and ``<s>[TURN role] text [/TURN]`` for any other role. A text that
holds a control string (a mark, or the start of one) is escaped: its turn's opening mark ends in ``+]``, a backslash is put after the
first character of each control string and each backslash is doubled. So no control string of a text stands in the
output, for a tokenizer to take for a mark, and a turn ends at the first closing mark. Text
between the turns is an error. The parser needs no knowledge of the source.

A turn is parsed as it is written, and compared with its source: if role, text or end differ, it is written
escaped and compared again. The loss mask covers what an assistant turn shows between its marks.

Turns are ordered by ``turn``, nulls first, ties by the formatted text. Null texts are empty, a null role is the
empty role, rows without a conversation form one of their own, repeated rows are repeated turns. A table
without rows gives none. Columns other than the four named are not read. A conversation is never held whole: its turns are sorted by Spark and
pass through the reader one after another, since SHA-256 needs them in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import ready

#: The marks of the three usual roles; other roles get a mark that holds their name.
MARKS = {"user": ("INST", "[/INST]"), "assistant": ("ASST", "</s>"), "system": ("SYS", "[/SYS]")}
CLOSING = {mark: (role, close) for role, (mark, close) in MARKS.items()}
_OPEN = re.compile(r"<s>\[(INST|ASST|SYS|TURN(?: [^\]+]*)?)(\+?)\] ")
_CONTROL = re.compile(r"</?s>|\[/?(?:INST|ASST|SYS|TURN)")
_ESCAPED = re.compile(r"(<)\\(?=/?s>)|(\[)\\(?=/?(?:INST|ASST|SYS|TURN))|(\\)\\")


def _named(role: str) -> str:
    """A role as it stands in a mark: everything but plain letters, digits and ``_-`` as ``%hex;``."""
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x};", role)


def _role(name: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), name)


def render(role: str, text: str, escaped: bool = False) -> str:
    """One turn by the grammar, whether or not it can be read back."""
    mark, close = MARKS.get(role) or (f"TURN {_named(role)}", "[/TURN]")
    body = _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\")) if escaped else text
    return f"<s>[{mark}{'+' * escaped}] {body} {close}"


@dataclass
class Turn:
    role: str
    text: str
    end: int


def parse_turn(text: str, at: int = 0) -> Turn:
    """The turn that starts at ``at``; its text as it was before rendering."""
    opened = _OPEN.match(text, at)
    if not opened:
        raise ValueError(f"no turn at {at}")
    role, close = CLOSING.get(opened[1]) or (_role(opened[1][5:]), "[/TURN]")
    start = opened.end()
    end = text.find(" " + close, start)
    if end < 0:
        raise ValueError(f"the turn at {at} has no end")
    body = text[start:end]
    if opened[2]:
        body = _ESCAPED.sub(lambda m: m[1] or m[2] or m[3], body)
    return Turn(role, body, end + 1 + len(close))


def turn_text(role: str, text: str) -> str:
    """A turn that reads back as it was, followed by anything; plain where it holds no control string and that suffices."""
    for escaped in (True,) if _CONTROL.search(text) else (False, True):
        shown = render(role, text, escaped)
        try:
            back = parse_turn(shown)
        except ValueError:
            continue
        if (back.role, back.text, back.end) == (role, text, len(shown)):
            return shown
    raise ValueError("a turn cannot be written")


def rendered(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv``, ``turn``, ``shown``): the formatted text of each turn; a conversation is its turns joined in order."""
    ready(df.sparkSession)
    rows = df.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}

    def show(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shown = [turn_text(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shown, pa.string())], ["conv", "turn", "shown"])

    return rows.mapInArrow(show, f"conv {kinds['conv']}, turn {kinds['turn']}, shown string")


@dataclass
class _Reading:
    """What is known of a conversation while its turns pass."""

    conv: object
    turns: int = 0
    chars: int = 0
    loss: int = 0
    all_: object = field(default_factory=hashlib.sha256)
    learned: object = field(default_factory=hashlib.sha256)

    def take(self, shown: str) -> None:
        at = 0
        while at < len(shown):
            turn = parse_turn(shown, at)
            at = turn.end
            self.turns += 1
            self.all_.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.role == "assistant":
                self.loss += len(turn.text)
                self.learned.update(turn.text.encode())
        self.chars += len(shown)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all_.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``rendered``, from its formatted text alone."""
    kind = turns.schema["conv"].dataType
    names = ["conv", *[c.split()[0] for c in _DIGEST.split(", ")]]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Reading | None = None
        type_ = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for part in parts:
            type_, done = part.column(0).type, []
            for conv, shown in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if held is None or held.conv != conv:
                    done += [held.row()] if held else []
                    held = _Reading(conv)
                held.take(shown)
            if done:
                yield out(done)
        if held:
            yield out([held.row()])

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "turn", "shown").select("conv", "shown")
    return dealt.mapInArrow(read, f"conv {kind.simpleString()}, {_DIGEST}")
