"""Search over a stored index: one query, a batch of topics, evaluation and timing."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import evaluate, stats
from ferrule.operators.index import Index, build_index
from ferrule.operators.rerank import Scorer, candidate_docs, rerank
from ferrule.plans import boolean
from ferrule.plans.ast import QueryParseError, parse


class Engine:
    def __init__(self, spark: SparkSession, path: str, synonyms: Mapping[str, Sequence[str]] | None = None) -> None:
        self.spark, self.index, self.synonyms = spark, Index(spark, path), dict(synonyms or {})

    def explain_query(self, query: str) -> str:
        return parse(query, self.synonyms).dump()

    def search(self, query: str, mode: str = "strict", universe: str = "terms") -> DataFrame:
        """(doc_id, score) in order of doc_id; in compat mode a document as often as the list has it. In strict mode NOT gives
        documents with any term of the query or, with the universe "corpus", any document."""
        if universe not in ("terms", "corpus") or universe == "corpus" and mode != "strict":
            raise ValueError(f"universe is terms or, in strict mode, corpus, not {universe}")
        node = parse(query, self.synonyms)
        posted = self.index.postings(node.terms())
        if mode == "strict":
            hits = boolean.strict(posted, node, self.index.docs if universe == "corpus" else None)
        elif mode == "compat":
            hits = boolean.compat(posted, node).select(F.explode(F.array_repeat("doc_id", F.col("m").cast("int"))).alias("doc_id"))
        else:
            raise ValueError(f"mode is strict or compat, not {mode}")
        return boolean.scored(hits).orderBy("doc_id")

    def top(self, query: str, k: int = 5, scorer: Scorer | None = None) -> tuple[int, DataFrame, DataFrame]:
        """How many documents match, the first k of them and the k best after reranking, both with their names."""
        hits = self.search(query).select(F.lit("q").alias("qid"), "doc_id")
        topic = self.spark.createDataFrame([("q", query)], "qid string, query string")
        first = self.index.named(hits.orderBy("doc_id").limit(k)).select("doc_id", "doc_name").orderBy("doc_id")
        best = self.rerank(hits, topic, scorer).where(F.col("rank") <= k)
        return hits.count(), first, self.index.named(best).select("rank", "doc_id", "doc_name", "score").orderBy("rank")

    def search_batch(self, topics: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """(qid, doc_id, score) of all topics, and what was wrong with those that don't parse; these have no hits."""
        parsed, wrong = {}, {}
        for qid, title in topics.items():
            try:
                parsed[qid] = parse(title, self.synonyms)
            except QueryParseError as e:
                wrong[qid] = str(e)
        terms = sorted({t for n in parsed.values() for t in n.terms()})
        return boolean.batch(self.index.postings(terms), parsed).withColumn("score", F.lit(1.0)), wrong

    def rerank(self, hits: DataFrame, topics: DataFrame, scorer: Scorer | None = None) -> DataFrame:
        """hits(qid, doc_id) of topics(qid, query) in the order of the scorer."""
        return rerank(candidate_docs(hits, self.index.docs).join(topics.select("qid", "query"), "qid"), scorer)


@dataclass
class BenchmarkConfig:
    label: str
    num_cpu_workers: int
    use_reranking: bool = False
    scorer: Scorer | None = None


def run_benchmark(engine: Engine, topics: Mapping[str, str], qrels: DataFrame, config: BenchmarkConfig) -> DataFrame:
    """A row for the boolean run and, with reranking, one for the reranked run: times, throughput, latency, effectiveness. Each
    topic's search and reranking is timed by itself; a reranked run's times are those of both stages."""
    spark, rows = engine.spark, []
    ids = spark.createDataFrame([(q,) for q in topics], "qid string")
    queries = spark.createDataFrame(list(topics.items()), "qid string, query string")

    def timed(run) -> float:
        began = time.time()
        run()
        return (time.time() - began) * 1000

    def noop(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def row(label: str, results: DataFrame, ms: float, retrieval: list[float], reranking: list[float]) -> None:
        quality = evaluate.summary(evaluate.topic_metrics(evaluate.ranked(results), qrels, ids)).first()
        each = spark.createDataFrame([(a + b,) for a, b in zip(retrieval, reranking)], "ms double")
        t = stats.latency_stats(each.withColumn("label", F.lit(label)), "ms", ["label"]).first()
        means = [sum(x) / len(x) if x else 0.0 for x in (retrieval, reranking)]
        effect = [quality[c] if quality else 0.0 for c in ("precision_at_10", "map", "mrr", "ndcg_at_10")]
        rows.append((label, config.num_cpu_workers, "_Rerank" in label, ms, len(topics) * 1000 / ms, *effect, *means, t["median"] if t else 0.0, t["p95"] if t else 0.0))

    hits, wrong = engine.search_batch(topics)
    retrieval = [0.0 if q in wrong else timed(lambda t=title: noop(engine.search(t))) for q, title in topics.items()]
    batch_ms = timed(lambda: noop(hits))
    row(config.label, hits, batch_ms, retrieval, [0.0] * len(retrieval))
    if config.use_reranking:
        reranked = engine.rerank(hits, queries, config.scorer).drop("rank")
        each = [timed(lambda q=q: noop(engine.rerank(hits.where(F.col("qid") == q), queries, config.scorer))) for q in topics]
        row(f"{config.label}_Rerank", reranked, batch_ms + timed(lambda: noop(reranked)), retrieval, each)
    return spark.createDataFrame(rows, stats.RUN_SCHEMA)


def run_indexing_benchmark(docs: DataFrame, path: str, num_cpu_workers: int) -> DataFrame:
    """One row: workers, milliseconds to build an index at ``path``, documents a second."""
    n = docs.count()
    began = time.time()
    build_index(docs, path)
    ms = (time.time() - began) * 1000
    return docs.sparkSession.createDataFrame([(num_cpu_workers, ms, n * 1000 / ms)], stats.INDEXING_SCHEMA)
