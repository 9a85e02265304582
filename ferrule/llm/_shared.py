"""What the operators of this subpackage share: numpy text kernels, and the library's tables and durable intermediates."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.storage import bounded, free, shared_dir, stored, table

__all__ = ["SOLID", "U", "WORD", "bounded", "buffers", "chunks", "counted", "counters", "free", "grams", "mix", "pack", "released", "shared_dir", "span_hash", "spans", "stored", "table", "trim", "unpacked", "words"]

# numpy text kernels

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLES = [(base, _powers(base, _BLOCK)) for base in (_P, pow(_P, -1, 1 << 64))]


def _tables(n: int) -> list[np.ndarray]:
    """n powers of an odd multiplier modulo 2**64 and n of its inverse; only the first block of each is kept."""
    return [own[:n] if n <= _BLOCK else np.multiply.outer(_powers(pow(base, _BLOCK, 1 << 64), -(-n // _BLOCK)), own).ravel()[:n] for base, own in _TABLES]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each span, from one prefix sum of a polynomial modulo 2**64."""
    p, inv = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def _lut(keep: bytes = b"", lower: bool = True) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalnum() or bytes([c]) in [bytes([k]) for k in keep]:
            t[c] = ord(chr(c).lower()) if lower and c < 128 else c
    return t


WORD = _lut()
#: 1 where a byte is not ASCII white space
SOLID = np.ones(256, np.uint8)
SOLID[[9, 10, 11, 12, 13, 32]] = 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes, so that working memory stays small; a longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(on: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a row: starts, ends, and the index of each row's first run."""
    if not len(on):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = on[heads]
    tails = heads[1:] - 1
    last[tails] = on[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row (runs of letters, digits and non-ASCII bytes, ASCII lower-cased), row index."""
    mapped = WORD[data]
    s, e, row = spans(mapped > 0, offsets)
    return span_hash(mapped, s, e), row


def grams(tokens: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes and the row of each; a row with 1 to n-1 tokens has one gram, all of it."""
    count = np.diff(row)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + row[doc]
    return span_hash(tokens, at, np.minimum(at + n, row[doc + 1])), doc


# count sketches

SLICE = 1 << 16


def pack(a: np.ndarray) -> bytes:
    """Numbers in the narrowest type that holds them, its width first."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]], offset=1)


FAN = 256  # bodies added up in one call


def counters(total: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """A task's counters in packed slices, those without a count left out: the task, numbers of the slices, and their bodies."""
    parts = [k for k in range(0, len(total), SLICE) if total[k : k + SLICE].any()]
    return [TaskContext.get().partitionId()] * len(parts), [k // SLICE for k in parts], [pack(total[k : k + SLICE]) for k in parts]


def counted(rows: DataFrame, bits: int) -> np.ndarray:
    """The sums of the 2**bits counters of all tasks from rows(task, slice, body), which is read several times: added up by the
    executors as a tree, ``FAN`` tasks at a time, so that no call gets more however many tasks there are."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, U)
        for chunk in part.column("body").chunks:
            for x in chunk:
                own = unpacked(x.as_py())
                total[: len(own)] += own
        out = pa.table([part.column("task")[:1], part.column("slice")[:1], pa.array([pack(total)], pa.binary())], ["task", "slice", "body"])
        trim()
        return out

    own = rows.select("task", "slice", "body")
    left = (own.agg(F.max("task")).first()[0] or 0) + 1
    while left > 1:
        own = own.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "slice").applyInArrow(add, "task int, slice int, body binary")
        left = -(-left // FAN)
    out = np.zeros(max(1 << bits, SLICE), U)
    for r in own.collect():  # a row a slice
        part = unpacked(r.body)
        out[r.slice * SLICE : r.slice * SLICE + len(part)] = part
    return out[: 1 << bits]


# memory of Python workers


def trim() -> None:
    """Give back what a Python worker no longer needs; it's used again for other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a trim at the end of a task."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return own
