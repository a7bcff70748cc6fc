"""Chat formatting with a grammar round trip.

A turn is written as START role NEWLINE text END NEWLINE. Each turn is rendered, parsed again and compared with its
source; content that came back different is escaped until it comes back identical: first nothing, then the control
strings themselves, then everything that looks like an escape. A control string is escaped by one backslash after its
first sign, what is already such an escape by one more, so that the parser undoes it by removing one. A rendered turn
holds no control string but its own, so turns can be joined and cut again without looking at their neighbours, and a
conversation of any length never has to be in one place: the output has one row for each turn, and a conversation is
its rows one after another.

Cases: null texts and roles are empty. Turns are ordered by turn (nulls first), then by role and text, so repeated rows
are repeated turns in a defined order. Rows without conv_id are one conversation of their own. An empty table gives
none; other columns are not read. Texts of any length are formatted whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, slices

#: The control strings of the template.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
NAMES = "(?:im_start|im_end|nl)"
CONTROL = re.compile(rf"<(\\*)\|(?={NAMES}\|>)")  # a control string, escaped any number of times
ANY = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
LOSS_ROLE = "assistant"
SLICE = 4 << 20


class Malformed(ValueError):
    pass


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) of all turns of rendered text."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise Malformed(f"no turn starts at {at}")
        head = rendered.find("\n", at)
        end = rendered.find(END, head + 1)
        if head < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
            raise Malformed(f"the turn at {at} does not end")
        role, text = rendered[at + len(START) : head], rendered[head + 1 : end]
        if START in role or END in role or START in text:
            raise Malformed(f"a control string inside the turn at {at}")
        turns.append((ESCAPED.sub(r"<\1|", role.replace(BREAK, "\n")), ESCAPED.sub(r"<\1|", text)))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and where its text begins and ends in it."""
    for pattern in (None, CONTROL, ANY):
        shown = [pattern.sub(r"<\\\1|", x) if pattern else x for x in (role, text)]
        header = f"{START}{shown[0].replace('\n', BREAK)}\n"
        out = f"{header}{shown[1]}{END}\n"
        try:
            if parse(out) == [(role, text)]:
                return out, len(header), len(header) + len(shown[1])
        except Malformed:
            pass
    raise AssertionError("escaping everything always round trips")


def format_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, rendered, and the loss mask as the span [loss_start, loss_end) of it.

    The span is empty (0, 0) for turns without loss. Rows are formatted where they are; no conversation is gathered.
    """
    rows = conversations.select(col(conv_id).alias("conv_id"), col(turn).alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE):
            roles = [r or "" for r in batch.column(2).to_pylist()]
            out = [render(r, t or "") for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            spans = [(a, b) if r == LOSS_ROLE else (0, 0) for r, (_, a, b) in zip(roles, out, strict=True)]
            arrays = [pa.array([x[0] for x in out], pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")]
    schema = f"{', '.join(kinds)}, role string, text string, rendered string, loss_start bigint, loss_end bigint"
    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the written output holds, for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Everything is read from `rendered` and the spans. The digests run over a conversation in order, so its rows stream
    through one task, one batch at a time: a digest of a sequence cannot be split, but nothing is gathered for it.
    """
    rows = formatted.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "rendered", "loss_start", "loss_end")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, done = None, False, []
        turns = loss_chars = chars = 0
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, rendered, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not begun or conv != current:
                    if begun:
                        done.append((current, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current, begun = conv, True
                    turns = loss_chars = chars = 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(rendered):
                    all_turns.update(f"{role}\n{text}\n".encode())
                    turns += 1
                masked = ESCAPED.sub(r"<\1|", rendered[start:end])
                loss.update(masked.encode())
                loss_chars += len(masked)
                chars += len(rendered)
            if done:
                yield told(done, kind)
                done = []
        if begun:
            yield told([(current, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], kind)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def told(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
