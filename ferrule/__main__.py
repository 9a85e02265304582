"""Command line: build an index, search it, benchmark both, and report.

    python -m ferrule build CORPUS INDEX
    python -m ferrule search INDEX [QUERY ...]       without a query, queries are read line by line until "exit"
    python -m ferrule benchmark INDEX TOPICS JUDGMENTS RESULTS [--label L] [--workers N]
    python -m ferrule benchmark-indexing CORPUS INDEX RESULTS [--workers N]
    python -m ferrule report RESULTS
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from ferrule.engine import BenchmarkConfig, Engine, run_benchmark, run_indexing_benchmark
from ferrule.operators import stats
from ferrule.operators.index import build_index
from ferrule.operators.rerank import OnnxScorer
from ferrule.plans.ast import QueryParseError
from ferrule.sources import readers


def answer(engine: Engine, query: str, scorer: OnnxScorer | None = None) -> str:
    """What is shown for a query: how many match, the first five, the five best, and the time it took."""
    began = time.time()
    try:
        n, first, best = engine.top(query, 5, scorer)
    except QueryParseError as e:
        return str(e)
    own = lambda r: r["doc_name"] if r["doc_name"] is not None else f"document {r['doc_id']}, without a name"
    lines = [f"{n} documents", *(f"  {own(r)} ({r['doc_id']})" for r in first.collect()), "best after reranking"]
    lines += [f"  {r['rank']}. {own(r)} ({r['doc_id']}, {r['score']:.4f})" for r in best.collect()]
    return "\n".join([*lines, f"{(time.time() - began) * 1000:.2f} ms"])


def main(args: list[str], spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ferrule", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    own = parser.add_subparsers(dest="what", required=True)
    for name, places in (("build", "corpus index"), ("search", "index"), ("benchmark", "index topics judgments results"), ("benchmark-indexing", "corpus index results"), ("report", "results")):
        p = own.add_parser(name)
        for x in places.split():
            p.add_argument(x)
        p.add_argument("--workers", type=int, default=8)
        p.add_argument("--label", default="Boolean")
        p.add_argument("--synonyms")
        p.add_argument("--model", nargs=2, metavar=("ONNX", "VOCABULARY"))
        if name == "search":
            p.add_argument("query", nargs="*")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.master(f"local[{a.workers}]").appName("ferrule").getOrCreate()
    scorer = OnnxScorer(*a.model) if a.model else None
    opened = lambda: Engine(spark, a.index, readers.read_synonyms(spark, a.synonyms) if a.synonyms else None)
    if a.what == "build":
        build_index(readers.read_corpus(spark, a.corpus), a.index)
    elif a.what == "search":
        engine = opened()
        for query in [" ".join(a.query)] if a.query else (line.rstrip("\n") for line in sys.stdin):
            if query == "exit":
                break
            if query:
                print(answer(engine, query, scorer), flush=True)
    elif a.what == "benchmark":
        engine = opened()
        topics = {r["qid"]: r["query"] for r in readers.read_topics(spark, a.topics).collect()}
        qrels = readers.read_qrels(spark, a.judgments, engine.index.docs.select("doc_id", "doc_name"))
        stats.append_csv(run_benchmark(engine, topics, qrels, BenchmarkConfig(a.label, a.workers, True, scorer)), a.results)
    elif a.what == "benchmark-indexing":
        stats.append_csv(run_indexing_benchmark(readers.read_corpus(spark, a.corpus), a.index, a.workers), a.results)
    else:
        print(stats.report(stats.read_results(spark, a.results)))


if __name__ == "__main__":
    main(sys.argv[1:])
