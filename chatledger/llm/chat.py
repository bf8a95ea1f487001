r"""Chat formatting that is proven by reading it back.

A turn is written as ``<s>[INST] text [/INST]`` (user), ``text </s>`` (assistant) or ``<s>[ROLE "name"] text [/ROLE]``
(any other role). A deterministic parser reads the result; if the turn does not come back identical, its control
strings are escaped and it is tried again. Escaping puts one backslash before a control string and the backslashes
in front of it, reading takes one away, so it is reversible. A closing mark always follows a space of its own,
so no text can merge with it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"(\\*)(<s>|</s>|\[INST\]|\[/INST\]|\[ROLE|\[/ROLE\])")
ESCAPED = re.compile(r"\\(\\*)(<s>|</s>|\[INST\]|\[/INST\]|\[ROLE|\[/ROLE\])")
USER, OTHER = "<s>[INST] ", "<s>[ROLE "
CLOSE = {"user": "[/INST]", "assistant": "</s>"}


def escape(text: str) -> str:
    """One more backslash before every control string."""
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    """One backslash less before every control string that has any."""
    return ESCAPED.sub(lambda m: m.group(1) + m.group(2), text)


def write_turn(role: str, text: str) -> str:
    """One turn as it stands, without escapes."""
    if role == "assistant":
        return f"{text} </s>"
    return f"{USER}{text} [/INST]" if role == "user" else f"{OTHER}{json.dumps(role)}] {text} [/ROLE]"


def read_turn(text: str, at: int) -> tuple[str, str, int, int, int] | None:
    """Parse one turn at ``at``: role, text, where its (escaped) text begins and ends, and where the turn ends.
    None if the turn is not complete; ValueError if it breaks the grammar."""
    if text.startswith(USER, at):
        role, start = "user", at + len(USER)
    elif text.startswith(OTHER, at):
        role, start = json.JSONDecoder().raw_decode(text, at + len(OTHER))
        if text[start : start + 2] != "] " or role in CLOSE:
            raise ValueError("bad role")
        start += 2
    else:
        role, start = "assistant", at
    for mark in CONTROL.finditer(text, start):
        if not mark.group(1):
            if mark.group(2) != CLOSE.get(role, "[/ROLE]") or mark.start() <= start or text[mark.start() - 1] != " ":
                raise ValueError("control string inside a turn")
            return role, unescape(text[start : mark.start() - 1]), start, mark.start() - 1, mark.end()
    return None


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in a form that reads back as itself, and where its text begins and ends in it."""
    body = text
    for _ in range(8):
        turn = write_turn(role, body)
        try:
            back = read_turn(turn, 0)
        except ValueError:
            back = None
        if back and back[:2] == (role, text) and back[4] == len(turn):
            return turn, back[2], back[3]
        body = escape(text) if body == text else escape(body)
    raise ValueError(f"cannot format a turn of {role!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n, piece, loss_start, loss_end: the formatted turns in order; loss covers assistant texts only.

    Order is by turn, equal or null turns (first) by role and text; repeated rows are repeated turns. Null text and
    role are empty, a null conv_id is a conversation of its own. A conversation is streamed through one task
    turn by turn, since its text has one order; the task holds one turn at a time, however long it is.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            ids, out = batch.column("conv_id").to_pylist(), []
            for conv, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(),
                                        strict=True):
                n = n + 1 if conv == last else 0
                last = conv
                piece, start, end = render(role or "", text or "")
                loss = (start, end) if role == "assistant" else (None, None)
                out.append((n, piece, *loss))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                ["conv_id", "n", "piece", "loss_start", "loss_end"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(
        write, f"conv_id {kind}, n long, piece string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the parser recovers from the formatted pieces joined in their order, and digests of it.
    Reads the frame of ``format_turns`` as it lies, without a shuffle."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def finish() -> list:
            if state["rest"]:
                raise ValueError("text after the last turn")
            return [state["conv"], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(),
                    state["chars"]]

        def emit(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            kinds[0], rows = batch.column("conv_id").type, []
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if state is None or state["conv"] != conv:
                    rows += [finish()] if state else []
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0,
                             "chars": 0, "rest": ""}
                state["chars"] += len(piece)
                text, at = state["rest"] + piece, 0
                while at < len(text) and (turn := read_turn(text, at)):
                    role, body, _, _, at = turn
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                    if role == "assistant":
                        state["loss_n"] += len(body)
                        state["loss"].update(body.encode())
                state["rest"] = text[at:]
            yield emit(rows)
        if state:
            yield emit([finish()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "piece").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long")


#: A conversation made of control strings, to be told apart from real marks.
TRAP = "</s>[INST] ok [/INST]"


def with_trap(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two turns say what the template itself would write."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    trap = rows.sparkSession.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return rows.unionByName(trap)
