"""Reranking of candidates by a pair scorer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import truncate_words

CANDIDATES, WORDS = 2048, 256


class Scorer(Protocol):
    def score(self, query: str, docs: list[str]) -> list[float]: ...


class OnnxScorer:
    """A cross-encoder in ONNX form, opened once a Python worker."""

    def __init__(self, model: str, vocab: str, size: int = 512) -> None:
        self.model, self.vocab, self.size, self._open = model, vocab, size, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def score(self, query: str, docs: list[str]) -> list[float]:
        import numpy as np

        if self._open is None:
            import onnxruntime

            from ferrule.operators.wordpiece import WordPiece, load_vocab

            self._open = (onnxruntime.InferenceSession(self.model), WordPiece(load_vocab(self.vocab)))
        session, own = self._open
        got = [own.encode_pair(query, d, self.size) for d in docs]
        ids, mask = (np.array(x, np.int64) for x in zip(*got))
        return [float(x) for x in session.run(None, {"input_ids": ids, "attention_mask": mask})[0][:, 0]]


def candidates(hits: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The first hits(qid, doc_id) of each topic by doc_id."""
    by = Window.partitionBy("qid").orderBy("doc_id")
    return hits.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).drop("place")


def candidate_docs(hits: DataFrame, docs: DataFrame, most: int = CANDIDATES, words: int = WORDS) -> DataFrame:
    """(qid, doc_id, content): candidates that are stored, with the first words of their content."""
    return candidates(hits, most).join(docs, "doc_id").select("qid", "doc_id", truncate_words(F.col("content"), words).alias("content"))


def lexical(pairs: DataFrame) -> DataFrame:
    """pairs(qid, doc_id, query, content) scored without a model: occurrences of query words, damped, by content length."""
    q = F.array_distinct(F.split("query", " "))
    own = F.filter(F.split("content", " "), lambda w: F.array_contains(q, w))
    score = F.log2(F.size(own) + 1.0) + F.size(F.array_distinct(own)) / F.greatest(F.size(q), F.lit(1))
    return pairs.select("qid", "doc_id", F.round(score, 6).alias("score"))


def rerank(pairs: DataFrame, scorer: Scorer | None = None, batch: int = 128) -> DataFrame:
    """(qid, doc_id, score, rank) of pairs(qid, doc_id, query, content), best first; ties by doc_id. A scorer sees a null query or
    content as an empty one; without a scorer such a pair has a null score and comes last."""
    if scorer is None:
        scored = lexical(pairs)
    else:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for q, own in pdf.groupby("query", sort=False, dropna=False):
                    for i in range(0, len(own), batch):
                        part = own.iloc[i : i + batch]
                        yield part[["qid", "doc_id"]].assign(score=scorer.score("" if pd.isna(q) else q, part["content"].fillna("").tolist()))

        scored = pairs.mapInPandas(run, f"qid {pairs.schema['qid'].dataType.simpleString()}, doc_id {pairs.schema['doc_id'].dataType.simpleString()}, score double")
    by = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by))
