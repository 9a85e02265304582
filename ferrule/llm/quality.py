"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: good, poor, or abstain. Expectation-maximisation over the counts of
all vote patterns in the corpus (at most 3**LABELLERS of them, however many documents) estimates what each labeller's votes
are worth and so the posterior probability of good for each pattern. Those posteriors train a hashed linear scorer on a
bounded sample, and the scorer rates every document.

Defined results: a null, empty or blank text has no features and gets score 0.0 and keep false; texts that are equal get equal
scores; a row with a null id keeps it; repeated rows are rated each; very long texts are rated whole; other columns are ignored; an empty table gives no rows. If
no sample row has a posterior (no text at all), every score is 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import SOLID, U, WORD, bounded, buffers, chunks, mix, released, span_hash, spans

BUCKETS = 1 << 17
LABELLERS = ("symbols", "capitals", "repetition", "function_words", "word_length", "sentences", "length", "digits", "shouting", "separators", "symbol_runs", "symbol_ends", "passages")
FUNCTION_WORDS = (
    "the of and to in is that it for was on with he be by this are or der die und das den von zu ist mit für "
    "nicht ein eine des auf le la les de du et un une en est que qui dans pour sur el los las y del se por con una al su"
)

_CLASS = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 capital, 3 digit, 4 mark of ordinary text, 5 other symbol
_CLASS[SOLID == 0] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b"#$%&*|{}<>@^~=+\\_`[]":
    _CLASS[_c] = 5
_CLASS[:9] = _CLASS[14:32] = 5


def _known() -> np.ndarray:
    own = [w.encode() for w in FUNCTION_WORDS.split()]
    end = np.cumsum([len(w) for w in own])
    return np.sort(span_hash(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], end[:-1])), end))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return np.diff(total[at])


def _repeated(h: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The share of each text's runs of k words that it has had before."""
    many = np.maximum(np.diff(row) - k + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + row[doc]
    key = span_hash(h, at, at + k) ^ mix(doc.astype(U))
    order = np.argsort(key)  # equal runs of one text stand together
    key, doc = key[order], doc[order]
    return np.bincount(doc[1:][key[1:] == key[:-1]], minlength=len(many)) / np.maximum(many, 1)


def votes(d: np.ndarray, o: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The votes of each labeller (1 good, -1 poor, 0 abstains) on each text, and which texts have a word."""
    kind = _CLASS[d]
    count = [_sums(kind == k, o).astype(float) for k in range(6)]
    solid = np.maximum(sum(count[1:]), 1)
    letters = np.maximum(count[1] + count[2], 1)
    mapped = WORD[d]
    s, e, row = spans(mapped > 0, o)
    h = span_hash(mapped, s, e)
    n = np.diff(row).astype(float)
    some = np.maximum(n, 1)
    at = np.searchsorted(known, h)
    common = _sums(known[np.minimum(at, len(known) - 1)] == h, row) / some
    repeated, passages = (_repeated(h, row, k) for k in (3, 8))
    triple = np.zeros(len(d), bool)
    triple[2:] = (kind[2:] >= 4) & (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2])
    heads = o[:-1][o[:-1] < o[1:]]
    triple[heads] = triple[np.minimum(heads + 1, len(d) - 1)] = False  # a run doesn't cross texts
    runs = _sums(triple, o)
    ended = np.ones(len(d), bool)  # white space or the text's end comes next
    ended[:-1] = kind[1:] == 0
    ended[o[1:][o[:-1] < o[1:]] - 1] = True
    tails = _sums((kind == 5) & ended, o)
    ends = _sums((d == 46) | (d == 63) | (d == 33), o)
    bang = _sums(d == 33, o)
    bars = _sums((d == 124) | (d == 9), o)
    length = _sums(e - s, row) / some
    blank = n == 0

    def vote(good: np.ndarray, poor: np.ndarray) -> np.ndarray:
        return np.where(blank, 0, np.where(poor, -1, np.where(good, 1, 0))).astype(np.int8)

    # a fault, or the lack of one, says nothing of the others: those who look for one fault abstain where it is absent
    never = np.zeros(len(n), bool)
    out = np.stack(
        [
            vote(never, count[5] / solid > 0.06),
            vote(never, count[2] / letters > 0.3),
            vote(never, repeated > 0.3),
            vote(common > 0.15, (common < 0.03) & (n >= 20)),
            vote((length >= 3) & (length <= 8), (length < 2) | (length > 14)),
            vote((ends / some > 1 / 60) & (ends / some < 1 / 3), ((ends == 0) & (n >= 40)) | (ends / some > 0.5)),
            vote(n >= 40, n < 6),
            vote(never, count[3] / solid > 0.2),
            vote(never, bang / some > 0.1),
            vote(never, bars / some > 0.1),
            vote(never, runs / some > 0.15),
            vote(never, tails / some > 0.15),
            vote(never, (passages > 0.2) & (n >= 20)),
        ],
        axis=1,
    )
    return out, ~blank


def features(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text, as buckets grouped by text, their weights, and offsets: its words, and the shapes of its
    words (runs of letters, capitals, digits and each other byte); the weights of a text have length 1."""
    s, e, row = spans(SOLID[d] > 0, o)
    low = np.where(WORD[d] > 0, WORD[d], d)
    word = span_hash(low, s, e)
    kind = _CLASS[d]
    shape = np.where(kind >= 4, d, kind)
    keep = np.ones(len(d), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[s] = True
    cum = np.concatenate(([0], np.cumsum(keep)))
    form = span_hash(shape[keep], cum[s], cum[e])
    doc = np.repeat(np.arange(len(row) - 1), np.diff(row))
    mask = U(BUCKETS // 2 - 1)
    bucket = np.concatenate([word & mask, (form & mask) | U(BUCKETS // 2)]).astype(np.int64)
    code, n = np.unique(np.concatenate([doc, doc]) * BUCKETS + bucket, return_counts=True)
    doc, bucket = code // BUCKETS, code % BUCKETS
    at = np.searchsorted(doc, np.arange(len(row)))
    w = np.log1p(n)
    size = np.sqrt(np.bincount(doc, w * w, len(row) - 1))
    return bucket, w / size[doc], at


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 60, weight: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, vote probabilities by class, labeller and vote) from vote patterns and how many
    texts have each. It starts from the balance of the votes, one of poor weighing as much as ``weight`` of good since each
    fault has few labellers to name it; this also decides which class is called good."""
    score = (patterns > 0).sum(1) - weight * (patterns < 0).sum(1)
    post = 1 / (1 + np.exp(-score.astype(float)))
    theta = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, p in enumerate((1 - post, post)):
            for v in (-1, 0, 1):
                theta[c, :, v + 1] = ((patterns == v) * (n * p)[:, None]).sum(0) + 1
            theta[c] /= theta[c].sum(1, keepdims=True)
        prior = np.clip((n * post).sum() / max(n.sum(), 1), 0.01, 0.99)
        log = [np.log(theta[c, np.arange(patterns.shape[1]), patterns + 1]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 - prior) - np.log(prior), -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-7:
            return new, theta
        post = new
    return post, theta


def fit(bucket: np.ndarray, w: np.ndarray, at: np.ndarray, target: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, the last one its constant: full gradients, adaptive steps."""
    beta, square = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    share = np.clip(target.mean(), 0.02, 0.98)
    weight = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)  # both classes count alike
    for _ in range(rounds):
        z = np.bincount(doc, w * beta[bucket], len(target)) + beta[-1]
        gap = weight * (1 / (1 + np.exp(-z)) - target)
        grad = np.append(np.bincount(bucket, gap[doc] * w, BUCKETS), gap.sum()) / len(target) + ridge * beta
        square += grad * grad
        beta -= 0.5 * grad / np.sqrt(square)
    return beta


def quality_classifier(docs: DataFrame, least_score: float = 0.5, train_docs: int = 5_000, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (of the linear scorer, 0 to 1), keep (score >= least_score) and posterior (of the votes alone) of every
    document. ``train_docs`` bounds the sample the scorer is fitted on: documents whose hash is small, about as many."""
    spark = docs.sparkSession
    base = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, code = _known(), 3 ** np.arange(len(LABELLERS))
        total: dict[int, int] = {}
        for batch in batches:
            for _, _, d, o in chunks(*buffers(batch.column("text"))):
                v, ok = votes(d, o, known)
                for k, n in zip(*np.unique((v[ok] + 1) @ code, return_counts=True)):
                    total[int(k)] = total.get(int(k), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    got = base.select("text").mapInArrow(released(cast_votes), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    pattern, n = got.column("pattern").to_numpy(), got.column("n").to_numpy()
    decoded = (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(np.int8) - 1
    posterior, _ = expectation_maximisation(decoded, n)
    table = np.zeros(3 ** len(LABELLERS), np.float32)
    table[pattern] = posterior
    beliefs = spark.sparkContext.broadcast(table)

    total = int(n.sum())
    share = min(1.0, train_docs / max(total, 1))
    hashed = base.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod(F.col("h"), F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    chosen = hashed.dropDuplicates(["doc_id", "h"]).drop("h")  # repeated rows have one hash: they count once here

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, code = _known(), 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for i, j, d, o in chunks(*buffers(batch.column("text"))):
                v, ok = votes(d, o, known)
                p = beliefs.value[(v + 1).astype(np.int64) @ code]
                b, w, at = features(d, o)
                rows = np.flatnonzero(ok)
                ids = batch.column("doc_id").slice(i, j - i).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(p[rows].astype(float)), *(pa.array([x[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary()) for x in (b.astype(np.int32), w.astype(np.float32)))],
                    ["doc_id", "posterior", "bucket", "weight"],
                )

    rows = chosen.mapInArrow(sample, "doc_id long, posterior double, bucket binary, weight binary").orderBy("doc_id", "bucket").toArrow()
    beta = np.zeros(BUCKETS + 1)
    if rows.num_rows:
        b = [np.frombuffer(x, np.int32) for x in rows.column("bucket").to_pylist()]
        w = np.concatenate([np.frombuffer(x, np.float32) for x in rows.column("weight").to_pylist()]).astype(float)
        beta = fit(np.concatenate(b).astype(np.int64), w, np.cumsum([0, *map(len, b)]), rows.column("posterior").to_numpy())
    trained = bool(rows.num_rows)
    scorer = spark.sparkContext.broadcast(beta.astype(np.float32))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, code = _known(), 3 ** np.arange(len(LABELLERS))
        beta = scorer.value.astype(float)
        for batch in batches:
            for i, j, d, o in chunks(*buffers(batch.column("text"))):
                v, ok = votes(d, o, known)
                p = np.where(ok, beliefs.value[(v + 1).astype(np.int64) @ code], 0).astype(float)
                b, w, at = features(d, o)
                z = np.bincount(np.repeat(np.arange(j - i), np.diff(at)), w * beta[b], j - i) + beta[-1]
                score = np.round(np.where(ok & trained, 1 / (1 + np.exp(-z)), 0.0), 6)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array((score >= least_score) & ok), pa.array(np.round(p, 6))], ["doc_id", "score", "keep", "posterior"])

    return base.mapInArrow(released(rate), "doc_id long, score double, keep boolean, posterior double")
