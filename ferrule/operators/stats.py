"""Latency, throughput and comparison figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latency_stats(times: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean, median (midpoint of the middle two) and p95 of each group; p95 is the value at place int(0.95 n) from 0 in
    ascending order where there are more than 20, else the largest. Equal values are counted before anything moves."""
    by = Window.partitionBy(*keys)
    counts = times.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    placed = counts.withColumn("__upto", F.sum("__c").over(by.orderBy("__v"))).withColumn("__n", F.sum("__c").over(by))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__c") <= place), F.col("__v")))

    n = F.col("__n")
    last = F.when(n > 20, F.floor(n * 0.95)).otherwise(n - 1)
    return placed.groupBy(*keys).agg(
        F.sum("__c").alias("n"), (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("mean"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(last).alias("p95")
    )


def throughput(count: Column, milliseconds: Column) -> Column:
    """A second; null for no time."""
    return F.try_divide(count * 1000.0, milliseconds)


def percent_change(base: Column, new: Column) -> Column:
    """0 for a base that isn't above 0."""
    return F.when(base > 0, F.try_divide((new - base) * 100.0, base)).otherwise(F.lit(0.0))


def mean_by(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


RUN = "label num_cpu_workers use_reranking query_processing_time_ms throughput_qps precision_at_10 map mrr ndcg_at_10 avg_retrieval_ms avg_reranking_ms median_latency_ms p95_latency_ms".split()
RUN_SCHEMA = "label string, num_cpu_workers int, use_reranking boolean, " + ", ".join(f"{c} double" for c in RUN[3:])
INDEXING_SCHEMA = "num_cpu_workers int, indexing_time_ms double, throughput_docs_per_sec double"


def compared(results: DataFrame, value: str = "query_processing_time_ms") -> DataFrame:
    """Runs without and with reranking side by side by number of workers, and the change in per cent."""
    own = mean_by(results.withColumn("reranked", F.contains("label", F.lit("_Rerank"))), ["num_cpu_workers", "reranked"], [value])
    a = own.where("not reranked").select("num_cpu_workers", F.col(value).alias("boolean"))
    b = own.where("reranked").select("num_cpu_workers", F.col(value).alias("rerank"))
    return a.join(b, "num_cpu_workers").withColumn("change", percent_change(F.col("boolean"), F.col("rerank")))


def append_csv(results: DataFrame, path: str) -> None:
    """A file more in a folder of CSV files, each with a header: an appended run never rewrites what is there."""
    results.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a folder or file of results, those of one configuration averaged; true and 1 both mean reranking."""
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select("label", F.col("num_cpu_workers").cast("int"), F.lower("use_reranking").isin("true", "1").alias("use_reranking"), *(F.col(c).cast("double") for c in RUN[3:]))
    return mean_by(typed, RUN[:3], RUN[3:])


def read_indexing(spark: SparkSession, path: str) -> DataFrame:
    """The indexing runs in order of workers."""
    return spark.read.option("header", True).schema(INDEXING_SCHEMA).csv(path).orderBy("num_cpu_workers")


def at_most_workers(results: DataFrame) -> DataFrame:
    """The means of the effectiveness figures of both kinds of runs at the largest number of workers, where there are both."""
    most = results.agg(F.max("num_cpu_workers").alias("num_cpu_workers"))  # one row
    own = mean_by(results.join(F.broadcast(most), "num_cpu_workers"), ["num_cpu_workers", "use_reranking"], ["precision_at_10", "map", "ndcg_at_10"])
    return own.withColumn("kinds", F.count("*").over(Window.partitionBy("num_cpu_workers"))).where("kinds = 2").drop("kinds")


_SHOWN = ["num_cpu_workers", "throughput_qps", "median_latency_ms", "p95_latency_ms", "precision_at_10", "map", "ndcg_at_10"]
_CHANGES = {"throughput": "throughput_qps", "latency": "median_latency_ms", "p10": "precision_at_10", "map": "map", "ndcg10": "ndcg_at_10"}


def changes(results: DataFrame) -> DataFrame:
    """By number of workers, the change in per cent that reranking makes to each figure."""
    a, b = (results.where("use_reranking" if on else "not use_reranking").select("num_cpu_workers", *(F.col(c).alias(f"{c}_{x}") for c in _CHANGES.values())) for on, x in ((False, "a"), (True, "b")))
    both = a.join(b, "num_cpu_workers")
    return both.select("num_cpu_workers", *(F.try_divide((F.col(f"{c}_b") - F.col(f"{c}_a")) * 100.0, F.col(f"{c}_a")).alias(f"{k}_change") for k, c in _CHANGES.items()))


def report(results: DataFrame) -> str:
    """Three tables as text: runs without reranking, with it, and the change in per cent. A row for each configuration."""

    def shown(title: str, rows: DataFrame) -> str:
        own = rows.orderBy("num_cpu_workers").toPandas()
        return f"{title}\n\n{own.to_string(index=False, float_format='{:,.2f}'.format)}\n" if len(own) else f"{title}: none\n"

    parts = [shown("Boolean retrieval", results.where("not use_reranking").select(*_SHOWN)), shown("With reranking", results.where("use_reranking").select(*_SHOWN)), shown("Change by reranking, per cent", changes(results))]
    return "\n".join(parts)


def file_name(label: str) -> str:
    """A label as part of a file name: what isn't a letter, digit, hyphen or underscore becomes an underscore."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", label)
