"""Chat formatting by columnar byte assembly.

A partition holds whole conversations in order. For a run of them the lengths of all segments (header, role, line end,
content, footer) are laid out by one cumulative sum; constants and contents are then copied into one preallocated buffer by
scatter indices, and that buffer becomes the Arrow column without another copy.

Defined results: turns are ordered by turn, role and text, nulls first, so that ties and repeated rows have one order and each
repeated row is a turn; a null role reads ``unknown``, a null text is an empty content; a turn with a null conversation id
belongs to none and gives nothing; contents, however long, are copied as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import bounded, buffers

HEAD, MIDDLE, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"
MOST = 8 << 20  # bytes of content assembled at a time; one longer conversation is assembled by itself
FORMATTED = "conv_id long, n_turns int, n_bytes long, text string, starts array<int>, ends array<int>"


def assembled(conv: pa.Array, role: pa.Array, text: pa.Array, scored: str) -> pa.RecordBatch:
    """The rows of whole conversations, already in order, as one formatted row each."""
    ids = conv.to_numpy(zero_copy_only=False)
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = ids[1:] != ids[:-1]
    first = np.flatnonzero(new)
    roles, r_at = buffers(pc.fill_null(role, "unknown"))
    texts, t_at = buffers(text)
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 1], size[:, 2], size[:, 3], size[:, 4] = len(HEAD), np.diff(r_at), len(MIDDLE), np.diff(t_at), len(TAIL)
    end = np.cumsum(size.ravel()).reshape(n, 5)
    start = end - size
    out = np.empty(int(end[-1, -1]), np.uint8)
    for k, constant in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[(start[:, k, None] + np.arange(len(constant))).ravel()] = np.tile(np.frombuffer(constant, np.uint8), n)
    for k, data, at in ((1, roles, r_at), (3, texts, t_at)):
        out[np.arange(len(data)) + np.repeat(start[:, k] - at[:-1], np.diff(at))] = data
    bounds = np.append(start[first, 0], len(out))
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.tobytes()), pa.py_buffer(out))
    if len(out) < 2**31 - 1:
        column = column.cast(pa.string())
    mine = np.asarray(pc.fill_null(pc.equal(role, scored), False).to_numpy(zero_copy_only=False), bool)
    row = np.cumsum(new) - 1
    at = np.concatenate(([0], np.cumsum(np.bincount(row[mine], minlength=len(first))))).astype(np.int32)
    begin = bounds[row]
    lists = [pa.ListArray.from_arrays(at, pa.array((x[mine, 3] - begin[mine]).astype(np.int32))) for x in (start, end)]
    turns = np.diff(np.append(first, n)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(turns), pa.array(np.diff(bounds)), column, *lists], ["conv_id", "n_turns", "n_bytes", "text", "starts", "ends"])


def chat_format(turns: DataFrame, scored: str = "assistant", *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its id, turns and bytes, the formatted text, and the byte range of the content of each
    turn of the ``scored`` role, for a loss mask."""
    rows = bounded(turns).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).where("conv_id is not null")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, MOST

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, most
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column("conv_id").to_numpy()
            cut = len(ids) if last else int(np.searchsorted(ids, ids[-1]))  # the last conversation may go on
            if cut:
                part = [whole.column(c).slice(0, cut).combine_chunks() for c in ("conv_id", "role", "text")]
                yield assembled(*(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in part), scored)
                held = whole.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
                most = MOST
            else:  # one conversation: it's put together again only when twice as much has come
                held, most = whole.to_batches(), 2 * size

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size > most:
                    yield from flush(False)
        yield from flush(True)

    return rows.mapInArrow(run, FORMATTED)
