"""Exact top-k text search with block-at-a-time pruning.

Documents are cut into ranges, the blocks. A block's forward index holds, document by document, the terms that any query has
and how often; from it comes the most that each term can add to a score within the block. For each query the blocks are
taken in the order of their summed term maxima, and their documents are scored through the forward index until the next sum
falls below the k-th score found. A first pass over the best block of each group gives every query a k-th score to start
from, so that whole groups of blocks are skipped in the second. Pruned blocks can't hold a result: the answer is exact.

Scores are BM25 over words (runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased); each distinct word of
a query counts once. All documents count in the statistics.

Defined results: results are documents with a word of the query; fewer than k are given where no more match; scores are rounded
to 6 places and ties go to the smaller doc_id; a null or empty text is an empty document; rows with a null id, of documents or
queries, are left out; a repeated document row is another document of the same id; of queries with one id the words are
united; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm._shared import U, bounded, buffers, chunks, stored, words

BLOCK = 256  # documents of a block
GROUP = 128  # blocks ordered together; a group is what a task holds in memory
K1, B = 1.2, 0.75
FOUND = "query_id long, doc_id long, score double"


def _vocabulary(queries: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries, the sorted hashes of their words, and each query's words as places among those, with offsets."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in chunks(*buffers(batch.column("text"))):
                h, row = words(d, o)
                ids = batch.column("query_id").to_numpy(zero_copy_only=False)[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(row))), pa.array(h.view(np.int64))], ["query_id", "term"])

    got = queries.mapInArrow(split, "query_id long, term long").distinct().toArrow()
    q, t = got.column("query_id").to_numpy(), got.column("term").to_numpy().view(U)
    terms, place = np.unique(t, return_inverse=True)
    order = np.lexsort((place, q))
    ids, at = np.unique(q[order], return_index=True)
    return ids, terms, place[order].astype(np.int32), np.append(at, len(q))


class _Block:
    """Documents of a range: ids, and the CSR of query terms and what each adds to a score."""

    def __init__(self, row: dict, idf: np.ndarray, mean: float) -> None:
        self.ids, length, self.at = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("lengths", np.int32), ("offsets", np.int32)))
        self.term, tf = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["counts"], np.int32).astype(float)
        norm = K1 * (1 - B + B * np.repeat(length, np.diff(self.at)) / mean)
        self.gain = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        order = np.argsort(self.term, kind="stable")
        self.terms, first = np.unique(self.term[order], return_index=True)
        self.most = np.maximum.reduceat(self.gain[order], first) if len(first) else np.zeros(0)

    def bounds(self, place: np.ndarray, at: np.ndarray, n_terms: int) -> np.ndarray:
        top = np.zeros(n_terms)
        top[self.terms] = self.most
        return np.diff(np.concatenate(([0.0], np.cumsum(top[place])))[at])

    def scores(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores above 0 and their documents; ``wanted``: which terms the query has."""
        total = np.bincount(np.repeat(np.arange(len(self.ids)), np.diff(self.at)), self.gain * wanted[self.term], len(self.ids))
        own = np.flatnonzero(total > 0)
        return np.round(total[own], 6), self.ids[own]


def _best(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= kth
        score, doc = score[near], doc[near]
    order = np.lexsort((doc, -score))[:k]
    return score[order], doc[order]


def exact_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, *, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "item_id", most_queries: int = 2_000) -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents of every query. Queries are answered ``most_queries`` or so at a
    time, each batch with its own index, so that what the executors hold of them is bounded."""
    base = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_text).cast("string").alias("text")).where("query_id is not null")
    parts = asked.count() // most_queries + 1
    out = [_answered(base, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else asked, k) for p in range(parts)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _answered(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = base.sparkSession
    q_ids, terms, place, at = _vocabulary(asked)
    if not len(q_ids):
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    vocabulary = spark.sparkContext.broadcast(terms)
    parts = ["ids", "lengths", "offsets", "terms", "counts"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        df = np.zeros(len(terms) + 2, np.int64)  # and at its end how many documents and words
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def block() -> pa.RecordBatch:
            ids, length, many, term, count = (np.concatenate(x) for x in zip(*held))
            body = [ids.astype(np.int64), length.astype(np.int32), np.concatenate(([0], np.cumsum(many))).astype(np.int32), term.astype(np.int32), count.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in body)], ["term", "n", *parts])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, d, o in chunks(*buffers(batch.column("text"))):
                h, row = words(d, o)
                p = np.searchsorted(terms, h)
                hit = np.flatnonzero(terms[np.minimum(p, len(terms) - 1)] == h)
                doc = np.searchsorted(row, hit, "right") - 1
                code, count = np.unique(doc * np.int64(len(terms)) + p[hit], return_counts=True)
                doc, term = code // len(terms), code % len(terms)
                length = np.diff(row)
                df[:-2] += np.bincount(term, minlength=len(terms))
                df[-2:] += (j - i, int(length.sum()))
                bound = np.searchsorted(doc, np.arange(j - i + 1))
                for a in range(0, j - i, BLOCK):
                    z = min(a + BLOCK, j - i)
                    own = slice(bound[a], bound[z])
                    held.append((ids[i + a : i + z], length[a:z], np.diff(bound[a : z + 1]), term[own], count[own]))
                    n += z - a
                    if n >= BLOCK:
                        yield block()
                        held, n = [], 0
        if held:
            yield block()
        some = np.flatnonzero(df)
        empty = [pa.nulls(len(some), pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some]), *empty], ["term", "n", *parts])

    indexed = stored(base.mapInArrow(index, "term int, n long, " + ", ".join(f"{c} binary" for c in parts)), "forward")
    df = np.zeros(len(terms) + 2)
    for r in indexed.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each word of the queries
        df[r["term"]] = r["n"]
    n_docs, mean = df[-2], max(df[-1] / max(df[-2], 1), 1e-9)
    idf = np.log(1 + (n_docs - df[:-2] + 0.5) / (df[:-2] + 0.5))
    shipped = spark.sparkContext.broadcast((q_ids, place, at, idf, mean))
    blocks = indexed.where("term is null").select(*parts)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Block]]:
        *_, idf, mean = shipped.value
        held: list[_Block] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(_Block(row, idf, mean))
                if len(held) == GROUP:
                    yield held
                    held = []
        if held:
            yield held

    def found(q: list, doc: list, score: list) -> pa.RecordBatch:
        q, doc, score = (np.concatenate(x) if x else np.zeros(0) for x in (q, doc, score))
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(score.astype(float))], ["query_id", "doc_id", "score"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, place, at, idf, _ = shipped.value
        for own in groups(batches):
            best = np.argmax([b.bounds(place, at, len(idf)) for b in own], axis=0)
            out: tuple[list, list, list] = [], [], []
            for i, q in enumerate(q_ids):
                wanted = np.zeros(len(idf))
                wanted[place[at[i] : at[i + 1]]] = 1
                score, doc = _best(*own[best[i]].scores(wanted), k)
                for x, y in zip(out, (np.full(len(doc), q), doc, score)):
                    x.append(y)
            yield found(*out)

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    seeds = blocks.mapInArrow(first, FOUND).withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select("query_id", "score").collect()  # a row a query
    floor = np.zeros(len(q_ids))
    for r in seeds:
        floor[np.searchsorted(q_ids, r["query_id"])] = r["score"]
    floors = spark.sparkContext.broadcast(floor)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, place, at, idf, _ = shipped.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
        floor = floors.value.copy()
        for own in groups(batches):
            bound = np.stack([b.bounds(place, at, len(idf)) for b in own]) + 1e-6
            order = np.argsort(-bound, axis=0, kind="stable")
            for i in range(len(q_ids)):
                wanted = np.zeros(len(idf))
                wanted[place[at[i] : at[i + 1]]] = 1
                for x in order[:, i]:
                    if bound[x, i] < floor[i] or bound[x, i] <= 1e-6:
                        break
                    score, doc = own[x].scores(wanted)
                    near = score >= floor[i]
                    kept[i] = _best(np.concatenate((kept[i][0], score[near])), np.concatenate((kept[i][1], doc[near])), k)
                    if len(kept[i][0]) == k:
                        floor[i] = max(floor[i], kept[i][0][-1])
        yield found([np.full(len(s), q) for q, (s, _) in zip(q_ids, kept)], [d for _, d in kept], [s for s, _ in kept])

    return blocks.mapInArrow(rest, FOUND).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
