"""Chat formatting with a grammar round trip.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n`` and a conversation is
its turns in order.  A deterministic parser reads the output back.  Each turn is
first written as it is; where the parser's role and text differ from the source,
the conflicting field is escaped and the turn is written and read again, until the
two are identical.

Escapes: the parser removes one backslash from ``<\\|``, ``<\\\\|`` and so on, so a
``<|`` (or an already backslashed form) inside a text gains one.  In a role, a
backslash, a line feed and ``<`` become ``\\\\``, ``\\n`` and ``\\l``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, END = "<|im_start|>", "<|im_end|>"

_TEXT_CONFLICT = re.compile(r"<(\\*)\|")
_TEXT_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_BACK = {v: k for k, v in _ROLE_ESCAPES.items()}

SEGMENTS = (
    "conv_id bigint, turn bigint, role string, text string, "
    "segment string, text_start int, text_end int, in_loss boolean"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def escape_text(text: str) -> str:
    return _TEXT_CONFLICT.sub(r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return _TEXT_ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: _ROLE_ESCAPES[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\nl]", lambda m: _ROLE_BACK[m[0]], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the written text) of each turn; None outside the grammar.

    turn := START role LF text END LF, where role holds no LF and no ``<``, and text
    holds no START and no END.
    """
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        line = formatted.find("\n", at)
        if line < 0:
            return None
        role = formatted[at + len(START) : line]
        end = formatted.find(END, line + 1)
        if "<" in role or end < 0 or formatted.find(START, line + 1, end) >= 0 or not formatted.startswith("\n", end + len(END)):
            return None
        turns.append((unescape_role(role), unescape_text(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text lies in it; what is read back equals the source."""
    written_role, written_text = role, text
    while True:
        segment = f"{START}{written_role}\n{written_text}{END}\n"
        got = parse(segment)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return segment, got[0][2], got[0][3]
        if written_text == text and escape_text(text) != text:
            written_text = escape_text(text)
        elif written_role == role and escape_role(role) != role:
            written_role = escape_role(role)
        else:
            raise ValueError("a turn cannot be read back")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each turn as written in the template; a conversation's output is its segments in turn order.

    Reads conv_id, turn, role, text; returns them (null role or text: empty) with
    segment, text_start, text_end (code points of the written text inside the segment)
    and in_loss (the role is ``loss_role``: the loss mask covers the text's span).  One
    row for each input row, repeated rows included; null conv_id and turn are kept.
    No shuffle; a very long text is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            written = [write_turn(r, t) for r, t in zip(roles, texts)]
            segments, starts, ends = zip(*written) if written else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array(roles, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(segments, pa.string()),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array([r == loss_role for r in roles], pa.bool_()),
                ],
                names=["conv_id", "turn", "role", "text", "segment", "text_start", "text_end", "in_loss"],
            )

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class _Digest:
    """What is read back from one conversation, fed segment by segment."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int, in_loss: bool) -> None:
        for role, text, _, _ in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if in_loss:
            under_mask = unescape_text(segment[start:end])
            self.loss_chars += len(under_mask)
            self.loss.update(under_mask.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its written segments.

    Returns conv_id, n_turns, turns_sha256 (role, LF, text, LF of each turn),
    loss_chars, loss_sha256 (all text under the loss mask, unescaped) and
    formatted_chars, one row for each conv_id (null is one).  Turns are in the order of
    turn (null first), ties by role and text.  Segments of a conversation are streamed
    in order through running digests: memory does not grow with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = list(zip(*done)) if done else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        now: _Digest | None = None
        for batch in slices(batches):
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "text_start", "text_end", "in_loss")]
            for conv_id, *segment in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(*segment)
            yield rows(done)
        if now is not None:
            yield rows([now.row()])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select("conv_id", "segment", "text_start", "text_end", "in_loss")
    return ordered.mapInArrow(run, DIGESTS)
