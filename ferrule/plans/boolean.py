"""Boolean queries as DataFrame plans.

Strict mode has the textbook meaning: distinct documents, NOT within the documents that have any term of the query. One
aggregate by document gives a column a term, and the tree is a predicate over them.

Compat mode has list semantics: a document counts as often as the term occurs, AND takes the lesser count, OR unites, NOT
subtracts; an AND whose running result is empty starts again from its next child. What a node does depends on how many entries
its operands have in all, which are read one by one from the aggregate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.ast import AND, EMPTY, NOT, OR, Node, postfix
from ferrule.storage import stored


def _pivot(posted: DataFrame, terms: list[str]) -> tuple[DataFrame, dict[str, str]]:
    names = {t: f"m{i}" for i, t in enumerate(terms)}
    own = posted.where(F.col("term").isin(*terms)) if terms else posted.where("false")
    counts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).cast("long").alias(c) for t, c in names.items()]
    return own.groupBy("doc_id").agg(*counts or [F.lit(0).alias("none")]), names


def predicate(node: Node, names: Mapping[str, str]) -> Column:
    if node.op == "TERM":
        return F.col(names[node.term]) > 0
    if node.op == "NOT":
        return ~predicate(node.children[0], names)
    if not node.children:
        return F.lit(False)
    return reduce(Column.__and__ if node.op == "AND" else Column.__or__, (predicate(c, names) for c in node.children))


def strict(posted: DataFrame, node: Node, universe: DataFrame | None = None) -> DataFrame:
    """doc_id of the documents that match. ``universe``: the documents NOT may give, if not those with a term of the query."""
    pivot, names = _pivot(posted, node.terms())
    if universe is not None and node != EMPTY:
        pivot = universe.select("doc_id").distinct().join(pivot, "doc_id", "left").na.fill(0, list(names.values()))
    return pivot.where(predicate(node, names)).select("doc_id")


def compat(posted: DataFrame, node: Node) -> DataFrame:
    """(doc_id, m): the documents of the resulting list, and how often each is in it."""
    pivot, names = _pivot(posted, node.terms())
    pivot = stored(pivot, "pivot")
    zero = F.lit(0).cast("long")

    def size(m: Column) -> int:
        return int(pivot.agg(F.coalesce(F.sum(m), F.lit(0))).first()[0])

    sums = pivot.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names.values()] or [F.lit(0)]).first()
    held = {t: int(sums[c]) for t, c in names.items()}
    some = [t for t, n in held.items() if n]
    everything = F.col(names[some[0]]) if len(some) == 1 else F.lit(1).cast("long")

    def common(a: Column, na: int, b: Column, nb: int) -> Column:
        if not na or not nb:
            return zero
        if na > 10 * nb:
            return F.when(a > 0, b).otherwise(zero)
        if nb > 10 * na:
            return F.when(b > 0, a).otherwise(zero)
        return F.least(a, b)

    def of(n: Node, context: tuple[Column, int] | None) -> tuple[Column, int]:
        if n.op == "TERM":
            return F.col(names[n.term]), held[n.term]
        if n.op == "NOT":
            if len(n.children) != 1:
                return zero, 0
            child, _ = of(n.children[0], context)
            m = F.greatest((context[0] if context and context[1] else everything) - child, zero)
            return m, size(m)
        result, total = zero, 0
        for i, c in enumerate(n.children):
            if n.op == "OR":
                m, k = of(c, None)
                if i == 0 or not total:
                    result, total = m, k
                elif k:
                    result = ((result + m) > 0).cast("long")
                    total = size(result)
            elif i == 0 or not total:
                result, total = of(c, None)
            elif c.op == "NOT":
                result, total = of(c, (result, total))
            else:
                m, k = of(c, None)
                result = common(result, total, m, k)
                total = size(result)
        return result, total

    m, _ = of(node, None)
    return pivot.select("doc_id", m.alias("m")).where("m > 0")


SMALL = 200_000  # rows of a table of queries that is broadcast


def if_small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast where it has at most ``SMALL`` rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def batch(posted: DataFrame, queries: Mapping[str, Node]) -> DataFrame:
    """(qid, doc_id) of all queries in one plan: their terms meet the postings, and each query's tree, as a postfix program, runs
    over the terms that a document has of it."""
    spark = posted.sparkSession
    slots = {q: {t: i for i, t in enumerate(n.terms())} for q, n in queries.items()}
    terms = spark.createDataFrame([(q, t, i) for q, own in slots.items() for t, i in own.items()], "qid string, term string, slot int")
    programs = spark.createDataFrame([(q, postfix(n, slots[q])) for q, n in queries.items()], "qid string, program array<int>")
    if sum(map(len, slots.values())) <= SMALL:
        terms, programs = F.broadcast(terms), F.broadcast(programs)
    present = posted.join(terms, "term").groupBy("qid", "doc_id").agg(F.collect_set("slot").alias("present"))

    def step(stack: Column, op: Column) -> Column:
        top, below = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
        rest = F.lit(1 << 30)
        return (
            F.when(op >= 0, F.concat(F.array(F.array_contains("present", op)), stack))
            .when(op == NOT, F.concat(F.array(~top), F.slice(stack, F.lit(2), rest)))
            .when(op == AND, F.concat(F.array(top & below), F.slice(stack, F.lit(3), rest)))
            .when(op == OR, F.concat(F.array(top | below), F.slice(stack, F.lit(3), rest)))
            .otherwise(F.concat(F.array(F.lit(False)), stack))
        )

    holds = F.get(F.aggregate("program", F.array().cast("array<boolean>"), step), F.lit(0))
    return present.join(programs, "qid").where(holds).select("qid", "doc_id")


def scored(hits: DataFrame) -> DataFrame:
    """Boolean hits aren't ranked: each has score 1.0."""
    return hits.select("doc_id", F.lit(1.0).alias("score"))
