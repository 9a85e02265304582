"""Effectiveness of ranked results against relevance judgments, binary gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10


def ranked(results: DataFrame) -> DataFrame:
    """results(qid, doc_id, score) with their rank in the topic: by score, then doc_id."""
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return results.withColumn("rank", F.row_number().over(by).cast("long"))


def topic_metrics(run: DataFrame, qrels: DataFrame, topics: DataFrame, k: int = K) -> DataFrame:
    """qid, p_at_k, ap, rr, dcg, ndcg of every topic of topics(qid); 0 where it has no result or no judgment."""
    rel = qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    judged = run.select("qid", "doc_id", "rank").join(rel, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = F.col("rank") <= k
    own = judged.withColumn("seen", seen).groupBy("qid").agg(
        (F.sum(F.when(top, F.col("rel")).otherwise(0)) / F.lit(float(k))).alias("p"),
        F.sum(F.col("rel") * F.col("seen") / F.col("rank")).alias("precisions"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    n = rel.groupBy("qid").agg(F.count("*").alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return topics.select("qid").distinct().join(own, "qid", "left").join(n, "qid", "left").select(
        "qid",
        zero(F.col("p")).alias("p_at_k"),
        zero(F.col("precisions") / F.col("n_rel")).alias("ap"),
        zero(F.lit(1.0) / F.col("first")).alias("rr"),
        zero(F.col("dcg")).alias("dcg"),
        zero(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal)).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """One row: the means over the topics; no row where there are none."""
    return metrics.agg(
        F.count("*").alias("topics"),
        F.avg("p_at_k").alias("precision_at_10"),
        F.avg("ap").alias("map"),
        F.avg("rr").alias("mrr"),
        F.avg("dcg").alias("dcg_at_10"),
        F.avg("ndcg").alias("ndcg_at_10"),
    ).where("topics > 0")


def evaluate(results: DataFrame, qrels: DataFrame, topics: DataFrame) -> DataFrame:
    return summary(topic_metrics(ranked(results), qrels, topics))
