"""A Bloom filter over a long column, put together by the executors: a bounded pre-filter before an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import U, mix


def bloom_size(n: int) -> int:
    """Bits of a filter for n keys: 16 a key, between 8 KB and 16 MB. Beyond that it lets more rows through; whatever it
    lets through is joined or grouped exactly."""
    return 1 << int(min(27, max(16, np.ceil(np.log2(16 * n + 1)))))


def bits_of(x: np.ndarray, bits: int) -> np.ndarray:
    h = mix(x.view(U) + U(0x1234567))
    return np.concatenate([h & U(bits - 1), (h >> U(32)) & U(bits - 1)]).astype(np.int64)


def bloom(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(bits_of(batch.column(0).to_numpy(zero_copy_only=False), bits))
            word, first = np.unique(at >> 6, return_index=True)
            own = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first) if len(at) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(own.view(np.int64))], ["at", "bits"])

    out = np.zeros(bits // 64, np.int64)
    got = keys.select(column).mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(U)


def in_bloom(filt: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = bits_of(x, len(filt) * 64)
    hit = (filt[at >> 6] >> (at & 63).astype(U)) & U(1)
    return (hit[: len(x)] & hit[len(x) :]).astype(bool)
