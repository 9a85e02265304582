"""Repeated windows by a depth-limited suffix sort.

Every word position of every document is a suffix, ordered only through its first ``length`` words. Those words are cut into
digits; a pass partitions the suffixes by the digits so far, most significant first, and what stands alone drops out. After
the last digit the groups left are exactly the windows of ``length`` words that occur more than once.

Before the passes, suffixes that can't repeat are dropped without being sent anywhere: each window has an anchor (its first
smallest word gram), equal windows have equal anchors, so a window whose anchor occurs once in the corpus occurs once.

A first digit of very many suffixes, as of a line that a third of all documents hold, would make one partition too large. A
count sketch, filled in the scan that finds the anchors, tells such digits; their suffixes are counted by aggregation within
tasks first, and the groups found are joined back, a join that Spark splits where one side is skewed.

Defined results: words are runs of bytes other than ASCII white space, compared exactly; a text of fewer than ``length``
words, a null or empty text and a null id give no rows; repeated rows of one id are occurrences in one document; an empty
table gives no rows; columns other than the id and text are ignored. The first occurrence of a window is that of the smallest
(doc_id, position).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm._bloom import bloom, bloom_size, in_bloom
from ferrule.llm._shared import SOLID, U, bounded, buffers, chunks, counted, counters, free, released, span_hash, spans, stored

_AT = U((1 << 28) - 1)  # low bits of a sort key that hold a position
SKETCH = 20  # log2 of the counters of first digits
_TOP = U(64 - SKETCH)


def windows(texts: pa.Array, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, word hashes, first word of each row, start of each window, its anchor's position and hash."""
    data, offsets = buffers(texts)
    for i, _, d, o in chunks(data, offsets):
        s, e, row = spans(SOLID[d] > 0, o)
        tokens = span_hash(d, s, e)
        many = np.maximum(np.diff(row) - length + 1, 0)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(row[:-1], many)
        if not len(start):
            continue
        at = np.arange(len(tokens) - gram + 1)
        g = span_hash(tokens, at, at + gram)
        low = (g & ~_AT) | at.astype(U)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        anchor = (low[start] & _AT).astype(np.int64)
        yield i, tokens, row, start, anchor, g[anchor]


def repeated_windows(docs: DataFrame, length: int = 50, gram: int = 10, digits: int = 3, *, text: str = "text", doc_id: str = "doc_id", most_equal: int = 2_000_000) -> DataFrame:
    """One row for each occurrence of a window of ``length`` words that occurs more than once: doc_id, pos (first word),
    copies, first (it is the occurrence to keep). A first digit of more suffixes than ``most_equal``, and than eight times the
    mean load of a counter of the sketch, is counted before it is sent anywhere."""
    if not 0 < gram <= length:
        raise ValueError("a gram has between 1 and length words")
    base = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    cuts = [round(k * length / digits) for k in range(digits + 1)]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH, np.uint32)
        for batch in batches:
            got = []
            for _, tokens, _, start, a, h in windows(batch.column("text"), length, gram):
                got.append(h[np.unique(a, return_index=True)[1]])
                sketch += np.bincount((span_hash(tokens, start, start + cuts[1]) >> _TOP).astype(np.int64), minlength=1 << SKETCH).astype(np.uint32)
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())], columns)
        tasks, slices, bodies = counters(sketch)
        m = len(slices)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(tasks, pa.int32()), pa.array(slices, pa.int32()), pa.array(bodies, pa.binary())], columns)

    columns = ["anchor", "n", "task", "slice", "body"]
    seen = stored(base.mapInArrow(released(anchors), "anchor long, n int, task int, slice int, body binary"), "anchors")
    again = stored(seen.where("slice is null").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "again")
    filt = docs.sparkSession.sparkContext.broadcast(bloom(again, "anchor", bloom_size(again.count())))
    load = counted(seen.where("slice is not null"), SKETCH)
    free(seen, again)
    heavy = load > max(most_equal, 8 * int(load.sum()) >> SKETCH)
    split = bool(heavy.any())
    ruled = docs.sparkSession.sparkContext.broadcast(heavy)
    names = [f"d{k}" for k in range(digits)]

    def suffixes(hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for i, tokens, row, start, _, h in windows(batch.column("text"), length, gram):
                    start = start[in_bloom(filt.value, h)]
                    if split:
                        start = start[ruled.value[(span_hash(tokens, start, start + cuts[1]) >> _TOP).astype(np.int64)] == hot]
                    if len(start):
                        doc = np.searchsorted(row, start, "right") - 1
                        keys = [span_hash(tokens, start + a, start + b).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])]
                        cols = [pa.array(ids[i + doc]), pa.array((start - row[doc]).astype(np.int32)), *map(pa.array, keys)]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pos", *names])

        return released(run)

    schema = "doc_id long, pos int, " + ", ".join(f"{d} long" for d in names)
    rows = base.mapInArrow(suffixes(False), schema)
    for k in range(1, digits):  # one exchange, by the first digit; later passes sort within its partitions
        rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy(*names[:k]))).where("copies > 1")
    whole = Window.partitionBy(*names)
    rows = rows.withColumn("copies", F.count("*").over(whole)).withColumn("head", F.min(F.struct("doc_id", "pos")).over(whole)).where("copies > 1")
    if split:
        hot = base.mapInArrow(suffixes(True), schema)
        groups = stored(hot.groupBy(*names).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "pos")).alias("head")).where("copies > 1"), "groups")
        rows = rows.unionByName(hot.join(groups, names))
    return rows.select("doc_id", "pos", "copies", (F.struct("doc_id", "pos") == F.col("head")).alias("first"))


def suffix_dedup(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """Maximal runs of repeated windows: doc_id, start_word, end_word (exclusive), copies (of its most frequent window),
    first. A run with first = true is where its windows occur first and stays; the others may be cut out."""
    rows = repeated_windows(docs, length, **how)
    by = Window.partitionBy("doc_id").orderBy("first", "pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(by) > 1) | (F.col("first") != F.lag("first").over(by)), F.lit(True))
    rows = rows.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "run").agg(F.min("pos").alias("start_word"), (F.max("pos") + length).cast("int").alias("end_word"), F.max("copies").alias("copies"), F.first("first").alias("first")).drop("run")
