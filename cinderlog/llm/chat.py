"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = START role "\\n" text END "\\n"

A deterministic parser reads rendered text back. A turn is first rendered as it stands; where
parsing doesn't give its role and text back, they are escaped and it is rendered again. Escaping
adds a backslash to every "<" (and run of backslashes) in front of "|" so that no control string is
left, and unescaping takes one away, so the second rendering always parses back to the source; the
parser checks that it does. Since every rendered turn parses to exactly one turn and ends where the
next begins, the concatenation parses to the conversation.

Turns are rendered row by row. A conversation of any length is written as a stream of segments in
order and read back with running digests, so no conversation is held in memory.

Defined results: null roles and texts are empty. Turns are ordered by turn (nulls first), then role
and text; repeated rows are repeated turns. A null conv_id is one conversation. Extra columns are
not read; working columns are prefixed ``f_``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_ROLE_END = re.compile(r"\n")
TRAINED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the span of the text as it stands in the rendering, of each turn.

    Raises ValueError where the grammar fits no further.
    """
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        begin = at + len(START)
        line = text.find("\n", begin)
        stop = text.find(END, begin)
        if line < 0 or stop < line or not text.startswith("\n", stop + len(END)):
            raise ValueError(f"no whole turn at {at}")
        role, body = text[begin:line], text[line + 1 : stop]
        if START in role or START in body:
            raise ValueError(f"a turn inside the turn at {at}")
        yield _role_back(unescape(role)), unescape(body), line + 1, stop
        at = stop + len(END) + 1


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n") if "\n" in role or "\\" in role else role


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render(role: str, text: str) -> str:
    """One turn, escaped only if it would not parse back to itself."""
    plain = f"{START}{role}\n{text}{END}\n"
    if _reads_back(plain, role, text):
        return plain
    escaped = f"{START}{escape(_role_out(role))}\n{escape(text)}{END}\n"
    if not _reads_back(escaped, role, text):
        raise ValueError("a turn does not survive the round trip")
    return escaped


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        found = [(r, t) for r, t, _, _ in parse(rendered)]
    except ValueError:
        return False
    return found == [(role, text)]


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            made = [
                render(r or "", t or "")
                for r, t in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b[0], b[1], b[2].fill_null(""), b[3].fill_null(""), pa.array(made, pa.string())],
                names=["f_conv", "f_turn", "f_role", "f_text", "f_segment"],
            )


def segments(
    df: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """The formatted conversations as segments: f_conv, f_turn, f_role, f_text, f_segment.

    A conversation's formatted text is its segments in order of turn, role and text.
    """
    rows = df.select(
        F.col(f"`{conv_id}`").cast("long").alias("f_conv"),
        F.col(f"`{turn}`").cast("long").alias("f_turn"),
        F.col(f"`{role}`").alias("f_role"),
        F.col(f"`{text}`").alias("f_text"),
    )
    return rows.mapInArrow(
        _render, "f_conv long, f_turn long, f_role string, f_text string, f_segment string"
    )


class _Reading:
    """Running digests of one conversation, read back from its formatted text."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        self.chars += len(segment)
        for role, text, begin, end in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == TRAINED:  # the mask covers begin to end of the rendering
                masked = unescape(segment[begin:end])
                self.loss += len(masked)
                self.under.update(masked.encode())

    def row(self) -> tuple:
        return (
            self.conv, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars,
        )


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    one, done = None, []
    for batch in batches:
        for conv, segment in zip(batch[0].to_pylist(), batch[1], strict=True):
            if one is None or conv != one.conv:
                done += [one.row()] if one else []
                one = _Reading(conv)
            one.add(segment.as_py())
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _ARROW)
            done = []
    done += [one.row()] if one else []
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _ARROW)


_ARROW = pa.schema(
    [(n, pa.string() if t == "string" else pa.int64()) for n, t in map(str.split, _DIGESTS.split(", "))]
)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from segments, one row per conversation.

    A digest runs over a conversation from start to end, so its segments stream through one task,
    in constant memory.
    """
    order = ["f_conv", "f_turn", "f_role", "f_text"]
    rows = formatted.repartition("f_conv").sortWithinPartitions(*order)
    return rows.select("f_conv", "f_segment").mapInArrow(_read, _DIGESTS)
