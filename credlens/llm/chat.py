"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to text, and nothing else is known of it. Each conversation's prefixes are
rendered one after the other. Where an output begins with the one before, the rest is the new turn's piece; where it
doesn't, the template has rewritten history, and the piece replaces all from the first difference on. The text's place in
a piece is found by rendering the turn once more with a placeholder as text. Concatenated pieces (each put at its start)
are the conversation's output.

Rows come by conversation and turn (ties by role, then text; nulls last) in sorted partitions and are worked on as a
stream. Of a black box, every prefix is rendered whole, however many turns there are, so that no rewriting goes unseen; that
takes time with the square of a conversation's length. A template made by `by_turn`, from a function of a turn and those
shortly before it, can't rewrite history: it is rendered over windows of turns. A null text or role is empty, rows repeating a
turn are turns of their own, rows with a null conv_id are one conversation, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

Turn = tuple[str, str]

#: Turns of a window besides those that a piece depends on.
WINDOW = 64
#: Stands for a text while its place is looked for: a private-use character that no template changes.
PLACEHOLDER = "\ue000"


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str]
    #: Turns before a turn that its piece depends on, if the template is known to be made of pieces.
    context: int | None = None
    #: Whether it is: what a black box says of its context isn't relied on.
    of_pieces: bool = False


def by_turn(piece: Callable[[list[Turn]], str], context: int = 0) -> Template:
    """A template of pieces, one after the other: piece gets a turn behind up to `context` turns before it."""
    return Template(lambda turns: "".join(piece(turns[max(0, k - context) : k + 1]) for k in range(len(turns))), context, True)


def escape(text: str) -> str:
    """Puts a backslash before the characters that control strings are made of, so that none stands in a text."""
    return re.sub(r"([\\#<:])", r"\\\1", text) if re.search(r"[\\#<:]", text) else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def marked_piece(turns: list[Turn]) -> str:
    role, text = turns[-1]
    return f"### {escape(role)}: {escape(text)}</turn>\n"


MARKED = by_turn(marked_piece)
render_marked = MARKED.render
PIECE = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*)</turn>\n", re.S)


class Renderer:
    """One conversation's state: the turns still needed, their output, and the output's length before that."""

    def __init__(self, template: Template):
        self.render, self.context, self.turns, self.out, self.dropped = template.render, template.context if template.of_pieces else None, [], "", 0

    def shorten(self) -> None:
        """Leaves out the turns that no new piece depends on."""
        self.turns = self.turns[len(self.turns) - self.context :]
        shorter = self.render(self.turns)
        self.dropped, self.out = self.dropped + len(self.out) - len(shorter), shorter

    def add(self, role: str, text: str) -> tuple[int, str, int | None, int | None, bool]:
        """The new turn's start, its piece, the text's start and end in the whole output (None if it isn't there as it
        is), and whether history was rewritten."""
        render = self.render
        if self.context is not None and len(self.turns) >= self.context + WINDOW:
            self.shorten()
        before, self.turns = self.out, [*self.turns, (role, text)]
        self.out = render(self.turns)
        rewritten = not self.out.startswith(before)
        start = len(commonprefix([before, self.out])) if rewritten else len(before)
        piece, first, last = self.out[start:], None, None
        probe = render([*self.turns[:-1], (role, PLACEHOLDER)])
        if not rewritten and PLACEHOLDER not in text and probe.count(PLACEHOLDER) == 1 and probe.startswith(before):
            head, tail = probe.split(PLACEHOLDER)
            if self.out.startswith(head) and self.out.endswith(tail) and len(head) + len(tail) <= len(self.out):
                first, last = self.dropped + len(head), self.dropped + len(self.out) - len(tail)
        elif not rewritten and PLACEHOLDER in text:  # the text holds the placeholder: an empty text shows head and tail
            probe = render([*self.turns[:-1], (role, "")])
            head = commonprefix([probe, self.out])
            tail = probe[len(head) :]
            if self.out.endswith(tail):
                first, last = self.dropped + len(head), self.dropped + len(self.out) - len(tail)
        return self.dropped + start, piece, first, last, rewritten


SCHEMA = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("rewritten", pa.bool_())])


def format_turns(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """A row for each turn, in order within partitions that hold whole conversations: conv_id, seq (from 0), role, piece,
    start (the piece's place in the output), text_start and text_end (the turn's text in the output), rewritten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seq, current = None, 0, object()
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current or state is None:
                    state, seq, current = Renderer(template), 0, conv
                start, piece, first, last, rewritten = state.add(role, text)
                rows.append((conv, seq, role, piece, start, first, last, rewritten))
                seq += 1
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return rows.mapInArrow(run, "conv_id long, seq long, role string, piece string, start long, text_start long, text_end long, rewritten boolean")


class Digest:
    """What one conversation's output says when it is read back, kept as running digests."""

    def __init__(self):
        self.turns, self.loss, self.n, self.chars, self.formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, start: int, first: int | None, last: int | None) -> None:
        m = PIECE.fullmatch(piece)
        if m is None:
            raise ValueError("a piece is not one whole turn")
        self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        self.n, self.formatted = self.n + 1, self.formatted + len(piece)
        if unescape(m[1]) == "assistant":  # the loss mask covers assistant texts; the role is the one read back
            text = unescape(piece[first - start : last - start])
            self.loss.update(text.encode())
            self.chars += len(text)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """format_turns' rows of the marked template, read back: a row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        one, current = None, None

        def result() -> list:
            return [current, one.n, one.turns.hexdigest(), one.chars, one.loss.hexdigest(), one.formatted]

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            rows = []
            for conv, seq, piece, start, first, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "piece", "start", "text_start", "text_end")), strict=True):
                if seq == 0:
                    if one is not None:
                        rows.append(result())
                    one, current = Digest(), conv
                one.add(piece, start, first, last)
            if rows:
                yield table(rows)
        if one is not None:
            yield table([result()])

    return formatted.mapInArrow(run, DIGESTS)
