"""WordPiece: greedy longest match over the basic tokens, and pair encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.storage import bounded

KNOWN = 50_000  # words that a worker remembers the pieces of
PART = 1 << 18  # characters of text of which a worker holds the ids at once
_BASIC = re.compile(r"[!-/:-@\[-`{-~]|[^ !-/:-@\[-`{-~]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_DROP = {**{c: None for c in (*range(32), 127)}, 9: " ", 10: " ", 13: " ", **_LOWER}


def load_vocab(path: str) -> dict[str, int]:
    """Token ids by line, blank lines not counted; of repeated tokens the last counts."""
    with open(path, encoding="utf-8") as file:
        own = [line.rstrip() for line in file]
    return {t: i for i, t in enumerate(t for t in own if t)}


class WordPiece:
    def __init__(self, vocab: Mapping[str, int], longest: int = 200) -> None:
        self.vocab, self.longest = dict(vocab), longest
        self.cls, self.sep, self.pad, self.unk = (self.vocab.get(t, d) for t, d in (("[CLS]", 101), ("[SEP]", 102), ("[PAD]", 0), ("[UNK]", 100)))
        self.same = {t: t for t in self.vocab}  # a piece that is remembered is no string of its own
        self.known: dict[str, list[str]] = {}

    def basic(self, text: str) -> list[str]:
        return _BASIC.findall(text.translate(_DROP))

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word, each the longest that fits; the whole is unknown if any part is, or if it is over long."""
        if word not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            out: list[str] = []
            at = 0 if len(word.encode()) <= self.longest else -1
            while 0 <= at < len(word):
                lead = "##" if at else ""
                end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.vocab), -1)
                piece = lead + word[at:end]
                out.append(self.same.get(piece, piece))
                at = end
            self.known[word] = out if at >= 0 else ["[UNK]"]
        return self.known[word]

    def tokenize(self, text: str) -> list[str]:
        return [p for w in self.basic(text) for p in self.pieces(w)]

    def ids(self, tokens: list[str]) -> list[int]:
        return [self.vocab.get(t, self.unk) for t in tokens]

    def _padded(self, own: list[int], size: int) -> tuple[list[int], list[int]]:
        own = own[:size]
        return own + [self.pad] * (size - len(own)), [1] * len(own) + [0] * (size - len(own))

    def encode(self, text: str, size: int = 512) -> tuple[list[int], list[int]]:
        return self._padded([self.cls, *self.ids(self.tokenize(text))[: size - 2], self.sep], size)

    def encode_pair(self, query: str, doc: str, size: int = 512) -> tuple[list[int], list[int]]:
        """Ids and mask; the document is cut to what the query leaves, and a longer query to the size."""
        q = self.ids(self.tokenize(query))
        d = self.ids(self.tokenize(doc))[: max(size - 3 - len(q), 0)]
        return self._padded([self.cls, *q, self.sep, *d, self.sep], size)


def encode_pairs(pairs: DataFrame, vocab: Mapping[str, int], query: str = "query", doc: str = "content", size: int = 512) -> DataFrame:
    """``pairs`` with input_ids and attention_mask."""
    pairs = bounded(pairs)
    shipped = pairs.sparkSession.sparkContext.broadcast(dict(vocab))

    rows = max(PART // size, 1)

    @F.pandas_udf("input_ids array<long>, attention_mask array<long>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = WordPiece(shipped.value)
        for q, d in parts:
            for i in range(0, len(q), rows):
                got = [own.encode_pair(a or "", b or "", size) for a, b in zip(q[i : i + rows], d[i : i + rows])]
                yield pd.DataFrame({"input_ids": [x for x, _ in got], "attention_mask": [y for _, y in got]})

    return pairs.withColumn("e", run(F.col(query), F.col(doc))).select(*pairs.columns, "e.input_ids", "e.attention_mask")


def _cut(s: pd.Series) -> Iterator[pd.Series]:
    """Runs of whole texts of about ``PART`` characters in all; a longer text is a run of its own."""
    upto = s.str.len().fillna(0).cumsum().to_numpy()
    i = 0
    while i < len(s):
        j = max(int(upto.searchsorted((upto[i - 1] if i else 0) + PART, "right")), i + 1)
        yield s[i:j]
        i = j


def piece_ids(text: Column, vocab: Mapping[str, int]) -> Column:
    """The ids of the pieces of a text. A worker holds those of about ``PART`` characters at once; ``bounded`` bounds the texts that it gets."""

    @F.pandas_udf("array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = WordPiece(vocab)
        for s in parts:
            for some in _cut(s):
                yield some.map(lambda t: np.array(own.ids(own.tokenize(t or "")), np.int64))

    return run(text)
