"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, with the template's marks as terminals:

    conversation := turn*
    turn         := START role "\\n" text END "\\n"

A role or text that the parser does not give back as it was is escaped: one backslash
more between the two characters that open a mark. The parser always takes one away, so
escaping is reversible, also for texts that hold escapes already.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile("|".join(map(re.escape, (START, END))))
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
# A role is one line, so a line feed in it is escaped too.
_ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE_BACK = {v[1]: k for k, v in _ROLE_ESCAPES.items()}

Turn = tuple[str, str]


class GrammarError(ValueError):
    """The text is not a formatted conversation."""


def escape_text(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE_ESCAPES.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: _ROLE_BACK.get(m[1], m[1]), role)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the text as written."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"a turn must start at {at}")
        line = formatted.find("\n", at)
        if line < 0:
            raise GrammarError(f"the turn at {at} has no role line")
        role = formatted[at + len(START):line]
        mark = _MARK.search(formatted, line + 1)
        if _MARK.search(role) or mark is None or mark[0] != END:
            raise GrammarError(f"the turn at {at} does not end")
        if not formatted.startswith("\n", mark.end()):
            raise GrammarError(f"the turn at {at} is followed by text")
        yield unescape_role(role), unescape_text(formatted[line + 1:mark.start()]), line + 1, mark.start()
        at = mark.end() + 1


def _written(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def recovered(formatted: str) -> list[Turn] | None:
    """The turns that the parser reads, None where the grammar is broken."""
    try:
        return [(role, text) for role, text, _, _ in parse(formatted)]
    except GrammarError:
        return None


def format_turn(role: str, text: str) -> str:
    """A turn, escaped only as far as its round trip needs."""
    for shown_role, shown_text in (
        (role, text), (role, escape_text(text)),
        (escape_role(role), text), (escape_role(role), escape_text(text)),
    ):
        written = _written(shown_role, shown_text)
        if recovered(written) == [(role, text)]:
            return written
    raise GrammarError(f"no escape makes the turn of {role!r} survive")


def format_chat(turns: Iterable[Turn]) -> str:
    """Rendered turns, reparsed and compared with their source.

    All turns are written as they are first; where the parser then reads anything else,
    each turn is escaped by its own round trip, and the whole is compared again.
    """
    turns = list(turns)
    written = "".join(_written(*t) for t in turns)
    if recovered(written) != turns:
        written = "".join(format_turn(*t) for t in turns)
        if recovered(written) != turns:
            raise GrammarError("the conversation does not survive its round trip")
    return written


_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()),
    ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())),
])


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from rows in order of conversation and turn; holds one at a time."""
    out: list[list] = [[], [], [], []]

    def close(key, turns: list[Turn]) -> None:
        written = format_chat(turns)
        spans = [(a, b) for role, _, a, b in parse(written) if role == "assistant"]
        for column, value in zip(out, (key, written, [a for a, _ in spans], [b for _, b in spans])):
            column.append(value)

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)
        for column in out:
            column.clear()
        return made

    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if begun and conv != key:
                close(key, turns)
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
        if out[0]:
            yield flush()
    if begun:
        close(key, turns)
        yield flush()


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end: one row per conversation.

    ``rows`` needs conv_id, turn, role and text; other columns are not read. Turns are
    ordered by turn, equal or missing turn numbers by role and text; repeated rows are
    repeated turns. Null roles and texts are empty; rows without a conv_id are one
    conversation. The loss lists give the code-point spans of ``formatted`` that hold
    assistant texts as written. Rows are brought together and sorted by Spark, and a task
    streams through them with one conversation in memory, which is also one result row.
    """
    wanted = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    return (
        wanted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(
            _format_partition,
            "conv_id bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>",
        )
    )
