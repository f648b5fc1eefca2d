"""Chat formatting by columnar byte assembly.

Rows of turns, sorted within partitions, become one text for each conversation. For a batch of turns, the lengths of headers
and contents, their cumulative offsets and the scatter indices are computed in numpy, and all bytes are copied at once into
the one buffer behind the resulting Arrow column.

The template, fixed: a turn is ``<turn>``, the role, a newline, the text, ``</turn>`` and a newline. Inside roles and texts a
backslash is written ``\\b`` and ``<`` is written ``\\l``; inside roles a newline is written ``\\n``. So no role or text can
hold a mark, and ``parse`` gives them back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, AFTER_ROLE, CLOSE = b"<turn>", b"\n", b"</turn>\n"


@dataclass(frozen=True)
class ChatParams:
    #: Roles whose texts are under the loss mask.
    learned: tuple[str, ...] = ("assistant",)


def escape(values: pa.Array, role: bool = False) -> pa.Array:
    for plain, written in (("\\", "\\b"), ("<", "\\l"), *((("\n", "\\n"),) if role else ())):
        values = pc.replace_substring(values, plain, written)
    return values


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\n", "\n").replace("\\b", "\\")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns = []
    for part in formatted.split("</turn>\n")[:-1]:
        role, _, text = part.removeprefix("<turn>").partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of binaries without nulls."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def assemble(segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``n`` rows of segments, one after the other.

    Each of ``segments`` is (source bytes, start by row, length by row). Gives the assembled bytes, the offset of each row, and
    the offset of each segment by row.
    """
    k = len(segments)
    lengths = np.empty((n, k), dtype=np.int64)
    for j, (_, _, length) in enumerate(segments):
        lengths[:, j] = length
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    at = offsets[:-1].reshape(n, k)
    out = np.empty(offsets[-1], dtype=np.uint8)
    for j, (data, start, length) in enumerate(segments):
        length = lengths[:, j]
        total = int(length.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(at[:, j], length) + within] = data[np.repeat(np.broadcast_to(start, n), length) + within]
    return out, offsets[:: k] if k else offsets, at


def _texts(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def _format(batch: pa.Table, params: ChatParams, schema: pa.Schema) -> pa.RecordBatch:
    """One row for each run of equal conv_id."""
    n = batch.num_rows
    keys = batch.column("conv_id").combine_chunks()
    roles = pc.fill_null(batch.column("role").combine_chunks(), "")
    same = np.zeros(n, dtype=bool)
    if n > 1:
        a, b = keys.slice(0, n - 1), keys.slice(1)
        same[1:] = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(~same)
    learned = pc.is_in(roles, pa.array(params.learned, pa.string())).to_numpy(zero_copy_only=False)
    text = escape(pc.fill_null(batch.column("text").combine_chunks(), ""))
    role_at, role_bytes = _bytes_of(escape(roles, role=True))
    text_at, text_bytes = _bytes_of(text)
    fixed = [np.frombuffer(x, dtype=np.uint8) for x in (OPEN, AFTER_ROLE, CLOSE)]
    data, rows, at = assemble(
        [
            (fixed[0], np.int64(0), np.int64(len(OPEN))),
            (role_bytes, role_at[:-1], np.diff(role_at)),
            (fixed[1], np.int64(0), np.int64(len(AFTER_ROLE))),
            (text_bytes, text_at[:-1], np.diff(text_at)),
            (fixed[2], np.int64(0), np.int64(len(CLOSE))),
        ],
        n,
    )
    rows = np.concatenate([rows[:n], [len(data)]])
    edges = np.concatenate([rows[first], [len(data)]])
    formatted = _texts(edges, data)
    # the loss mask, in code points of the formatted text
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text_from = begins[at[:, 3]]
    text_to = begins[at[:, 3] + np.diff(text_at)]
    base = np.repeat(begins[edges[:-1]], np.diff(np.concatenate([first, [n]])))
    spans = [[] for _ in first]
    of = np.cumsum(~same) - 1
    for i in np.flatnonzero(learned):
        spans[of[i]].append((int(text_from[i] - base[i]), int(text_to[i] - base[i])))
    sizes = np.diff(np.concatenate([first, [n]]))
    made = {
        "conv_id": keys.take(pa.array(first)),
        "n_turns": pa.array(sizes),
        "formatted": formatted,
        "loss_spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], schema.field("loss_spans").type),
    }
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def format_conversations(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start and end in code points, of each learned text) of each conversation.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Null roles and texts count as empty, null conv_ids as
    one conversation, and null turns come first; equal turns are ordered by role, then text, and repeated rows stay. One
    shuffle by conv_id, then a sort; conversations stream through in batches, and only those that a batch cuts are held.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = turns.select("conv_id").schema[0].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            last = len(keys) - 1
            cut = last
            while cut > 0 and keys[cut - 1] == keys[last]:
                cut -= 1
            table = pa.Table.from_batches([batch])
            if held and (cut > 0 or held[-1].column(0)[-1].as_py() != keys[0]):
                joined = pa.concat_tables([*held, table.slice(0, cut)])
                held = []
                yield _format(joined, params, arrow)
            elif cut > 0:
                yield _format(table.slice(0, cut), params, arrow)
            held.append(table.slice(cut))
        if held:
            yield _format(pa.concat_tables(held), params, arrow)

    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def learned_text(formatted: str, spans: list) -> str:
    """What lies under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
