"""Conversations as training text: a compiled template writes each turn and marks what is to be learned.

Turns are shuffled once by conversation and sorted; a task then streams through them with one turn in hand and writes
pieces of whole turns, so a conversation of any length takes the memory of a piece.  Control strings that stand in a
text are escaped by a backslash, and ``read_back`` undoes that: what was rendered can always be told from what was said.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.chat_template import Page, compile_template

BEGIN, END = "<turn>", "</turn>"
#: A turn: begin, role, line feed, text, end.  The assistant's texts are what a model learns.
TEMPLATE = (
    "{% for message in messages %}"
    f"{BEGIN}" "{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    f"{END}\n"
    "{% endfor %}"
)
#: A conversation is cut between turns once a piece has so many characters.
PIECE_CHARS = 1_000_000

_CONTROL = re.compile(rf"\\|{re.escape(BEGIN)}|{re.escape(END)}")
_LINE_CONTROL = re.compile(rf"\\|\n|{re.escape(BEGIN)}|{re.escape(END)}")
_UNIT = re.compile(rf"\\(.)|({re.escape(BEGIN)}|{re.escape(END)}|\n)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def escape_line(text: str) -> str:
    """The same for a text that a line feed ends."""
    return _LINE_CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS = {"escape": escape, "escape_line": escape_line}


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows whose second last cell is a text, in batches of some characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 64 + (len(row[-2]) if isinstance(row[-2], str) else 0)
        if chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _render(template: str, piece_chars: int, out: pa.Schema):
    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        compiled = compile_template(template, FILTERS)
        page, number, offset, index, said, before = Page(), 0, 0, 0, None, None
        current, open_, names = None, False, {}
        for row in chain(rows, [None]):
            starts = row is None or not open_ or row[0] != current
            if said is not None:
                # The turn in hand is written once it is known whether it is the last.
                scope = names | {
                    "message.turn": said[1], "message.role": said[2], "message.text": said[3], "loop.index": index + 1,
                    "loop.index0": index, "loop.first": index == 0, "loop.last": starts, "previous.role": before,
                }
                compiled.turn(scope, page)
                index, before, said = index + 1, said[2], None
            if starts and open_:
                compiled.tail(names, page)
            if open_ and (starts or page.size >= piece_chars):
                yield current, number, offset, "".join(page.pieces), [{"begin": a, "end": b} for a, b in page.spans]
                number, offset, page = number + 1, offset + page.size, Page()
            if row is None:
                return
            if starts:
                current, open_, number, offset, index, before = row[0], True, 0, 0, 0, None
                names = {}
                compiled.head(names, page)
            said = row

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(pieces(_rows(batches)), out)

    return look


def format_conversations(
    turns: DataFrame,
    template: str = TEMPLATE,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """id, piece, offset (code points before it), formatted, spans of (begin, end) in it: one row for most conversations.

    ``spans`` are the generation marks of the template.  Turns are in order of ``turn_column`` (null first; ties by role
    and text), repeated rows are turns of their own, null roles and texts are empty.  Rows with a null id are one
    conversation.  A conversation longer than ``piece_chars`` characters has pieces numbered from 0, cut between turns.
    A conversation sits in one task, which streams through it.  An empty table gives an empty result.
    """
    compile_template(template, FILTERS)  # refused here rather than in a task
    id_type = turns.schema[id_column].dataType
    rows = turns.select(
        turns[id_column].alias("id"),
        turns[turn_column].cast("long").alias("turn"),
        F.coalesce(turns[role_column].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_column].cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField(id_column, id_type), T.StructField("piece", T.LongType()), T.StructField("offset", T.LongType()),
            T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(span)),
        ]
    )
    return dealt.mapInArrow(_render(template, piece_chars, _arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read back from text that ``TEMPLATE`` wrote."""
    begin = line = None
    for unit in _UNIT.finditer(formatted):
        mark = unit.group(2)
        if mark == BEGIN:
            begin, line = unit.end(), None
        elif mark == "\n" and begin is not None and line is None:
            line = unit.start()
        elif mark == END and line is not None:
            yield unescape(formatted[begin:line]), unescape(formatted[line + 1 : unit.start()])
            begin = line = None


def _digests(out: pa.Schema):
    def summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
        current = state = None
        for row in chain(rows, [None]):
            if state is not None and (row is None or row[0] != current):
                yield current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                state = None
            if row is None:
                return
            if state is None:
                current, state = row[0], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            _, _, _, formatted, spans = row
            for role, text in turns_of(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in spans:
                learned = unescape(formatted[span["begin"] : span["end"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(formatted)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(summaries(_rows(batches)), out)

    return look


def read_back(pieces: DataFrame, id_column: str = "conv_id", in_order: bool = False) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its pieces alone.

    ``in_order``: the pieces of an id are in one partition and in order, as ``format_conversations`` leaves them.  A digest
    runs over a conversation from its first turn to its last, so one conversation is one task's stream.
    """
    if not in_order:
        pieces = pieces.repartition(id_column).sortWithinPartitions(id_column, "piece")
    schema = T.StructType(
        [
            T.StructField(id_column, pieces.schema[id_column].dataType), T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        ]
    )
    return pieces.select(id_column, "piece", "offset", "formatted", "spans").mapInArrow(_digests(_arrow(schema)), schema)
