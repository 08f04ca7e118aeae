"""Chat formatting with a grammar that is read back.

    conversation = turn*
    turn         = "### " role ": " body LF "</turn>" LF

``### `` and ``</turn>`` are control strings. In a body one that belongs to the text has a backslash before it, besides those
that the text has there; reading takes one away. A turn is rendered, parsed again and compared with its source, and
conflicting content is escaped until they are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import col

OPEN, CLOSE = "### ", "\n</turn>\n"
ASSISTANT = "assistant"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_BARE = re.compile(r"(?<!\\)(?:### |</turn>)")


def _role_out(role: str) -> str:
    return role.replace("%", "%25").replace(":", "%3A").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3A", ":").replace("%25", "%")


def parse_turn(data: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role and text of the turn that begins here, where its body begins and ends, and where the next turn begins."""
    if not data.startswith(OPEN, at):
        raise ValueError("no turn begins here")
    end = data.find(": ", at + len(OPEN))
    if end < 0:
        raise ValueError("a turn has no role")
    begin = end + 2
    control = _BARE.search(data, begin)
    close = control.start() - 1 if control else -1
    if close < begin or not data.startswith(CLOSE, close):
        raise ValueError("a turn does not end")
    text = _CONTROL.sub(lambda m: m[0][1:], data[begin:close])
    return _role_in(data[at + len(OPEN) : end]), text, begin, close, close + len(CLOSE)


def parse(data: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        role, text, _, _, at = parse_turn(data, at)
        out.append((role, text))
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its body begins and ends. Plain where that reads back; else with its conflicts escaped."""
    head = f"{OPEN}{_role_out(role)}: "
    body = text
    while True:
        whole = head + body + CLOSE
        try:
            same = parse(whole) == [(role, text)]
        except ValueError:
            same = False
        if same:
            return whole, len(head), len(head) + len(body)
        escaped = _CONTROL.sub(r"\\\g<0>", text)
        if escaped == body:
            raise ValueError("a turn cannot be read back")
        body = escaped


def formatted(role: Column, text: Column) -> Column:
    """A struct of one turn: ``text`` as formatted, and ``body_start`` and ``body_end`` in it (code points).

    Null roles and texts count as empty. Rows are formatted each alone, so one long conversation is no hot group.
    """
    kind = pa.struct([("text", pa.string()), ("body_start", pa.int64()), ("body_end", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            turns = [render_turn(r.as_py() or "", t.as_py() or "") for r, t in zip(roles, texts, strict=True)]
            yield pa.array([{"text": a, "body_start": b, "body_end": c} for a, b, c in turns], kind)

    return F.arrow_udf(run, "text string, body_start long, body_end long")(role, text)


def format_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, formatted, mask_start, mask_end)``, a row for each turn: the loss mask is the body of an assistant's
    turn, and null for other roles. A conversation's turns in order are its formatted text."""
    out = turns.select(col(conv_id).alias("conv_id"), col(turn).alias("turn"), col(role).alias("role"), formatted(col(role), col(text)).alias("f"))
    ours = F.col("role") == ASSISTANT
    return out.select("conv_id", "turn", F.col("f.text").alias("formatted"), F.when(ours, F.col("f.body_start")).alias("mask_start"), F.when(ours, F.col("f.body_end")).alias("mask_end"))


class _Reading:
    """What reading one conversation back has found so far."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, data: str, mask_start: int | None, mask_end: int | None) -> None:
        at = 0
        while at < len(data):
            role, text, _, _, at = parse_turn(data, at)
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        self.formatted_chars += len(data)
        if mask_start is not None:
            text = _CONTROL.sub(lambda m: m[0][1:], data[mask_start:mask_end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_FIELDS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_back(turns: DataFrame) -> DataFrame:
    """The digests of each conversation of ``format_turns``, parsed from its formatted text.

    Turns are taken by ``turn`` (null first), ties by their formatted text; repeated rows count each. Null ids are one
    conversation. Turns are sorted by Spark and streamed through a parser, so a conversation is never held whole; its digest
    is one sequence by definition, and so the work of one task. An empty table gives no rows.
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for conv_id, data, start, end in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Reading(conv_id)
                now.add(data, start, end)
            yield _rows(out)
        if now is not None:
            yield _rows([now.row()])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "mask_start", "mask_end").mapInArrow(run, ", ".join(f"{name} {kinds[kind]}" for name, kind in _FIELDS))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS)], [name for name, _ in _FIELDS])
