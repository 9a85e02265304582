"""The registered queries over the driver's tables and, beside each, the SQL that says the same."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import evaluate as E
from ferrule.operators import index as I
from ferrule.operators import rerank as R
from ferrule.operators import stats, wordpiece
from ferrule.plans import ast, boolean
from ferrule.sources import readers
from ferrule.sources.readers import dense_ids
from ferrule.storage import bounded, shared_dir, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SYNONYMS = {"tion": ["ble", "ring"], "des": ["les", "que"], "heed": ["thre", "ou er"]}
VOCAB = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "of", "and", "to", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "##er", "##tion", "##ing", "th", "in", "re", ".", ",", "|", "!"])}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({column}, '[A-Za-z0-9()]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))"


_TOK = f"tok AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents)"
_POST = f"{_TOK}, post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def opened(spark: SparkSession, sf: str) -> I.Index:
    """The index of the documents of a folder, built once a session and then read like any stored index."""
    held = spark.__dict__.setdefault("_ferrule_indexes", {})
    if sf not in held:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        I.build_index(docs(spark, sf), path)
        held[sf] = I.Index(spark, path)
    return held[sf]


# text


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT page_id, array_to_string({_tokens('html')}, ' ') AS content FROM pages")
def preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.preprocess(F.col("html")).alias("content"))


@query(f"""WITH raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9()]+'), lambda x: lower(x)) AS r FROM documents)
SELECT doc_id, len(r) AS before, len(list_filter(r, lambda x: x NOT IN ({_STOP}))) AS after FROM raw""")
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("doc_id", T.raw_tokens(F.col("text")).alias("r"))
    return own.select("doc_id", F.size("r").cast("long").alias("before"), F.size(T.without_stop_words(F.col("r"))).cast("long").alias("after"))


@query(r"SELECT doc_id, array_to_string((regexp_extract_all(text, '[^ \t\n\v\f\r]+'))[1:256], ' ') AS content FROM documents")
def truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.truncate_words(F.col("text")).alias("content"))


# index


@query(f"WITH {_TOK} SELECT term, doc_id FROM tok")
def term_doc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.term_doc_pairs(docs(spark, sf))


@query(f"WITH {_POST} SELECT term, doc_id, tf FROM post")
def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return I.postings(docs(spark, sf))


@query(f"WITH {_TOK} SELECT term, doc_id // {I.BLOCK} AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM tok GROUP BY ALL")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    return I.posting_lists(docs(spark, sf)).select("term", "block", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query(f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def dictionary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.dictionary(I.postings(docs(spark, sf)))


@query(f"""WITH {_POST} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes,
count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM post""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    sizes = d.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    by_term = I.dictionary(I.postings(d)).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("occurrences"))
    return sizes.crossJoin(by_term)  # one row each


_SHARD = "CAST(('0x' || md5(term)[1:8]) AS BIGINT) % 64"


@query(f"WITH {_TOK} SELECT DISTINCT term, CAST({_SHARD} AS INTEGER) AS shard FROM tok")
def shard_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return I.dictionary(I.postings(docs(spark, sf))).select("term", T.shard_id(F.col("term")).alias("shard"))


@query(f"WITH {_POST} SELECT CAST({_SHARD} AS INTEGER) AS shard, count(DISTINCT term) AS terms, count(*) AS postings FROM post GROUP BY 1")
def shard_balance(spark: SparkSession, sf: str) -> DataFrame:
    own = I.dictionary(I.postings(docs(spark, sf)))
    return own.groupBy(T.shard_id(F.col("term")).alias("shard")).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))


@query(f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS content FROM documents WHERE len({_tokens('text')}) > 0")
def doc_store(spark: SparkSession, sf: str) -> DataFrame:
    return I.doc_store(docs(spark, sf))


@query("SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS dense_id FROM pages")
def dense_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return dense_ids(table(spark, sf, "pages").select("page_id", "url"), "page_id", "dense_id")


# boolean queries


def _strict(q: str, synonyms: dict | None = None) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        node = ast.parse(q, synonyms)
        return boolean.scored(boolean.strict(opened(spark, sf).postings(node.terms()), node))

    return run


def _sql_tree(node: ast.Node) -> str:
    if node.op == "TERM":
        return f"coalesce(max(CASE WHEN term = '{node.term}' THEN 1 END), 0) = 1"
    if node.op == "NOT":
        return f"NOT ({_sql_tree(node.children[0])})"
    return "(" + f" {node.op} ".join(_sql_tree(c) for c in node.children) + ")" if node.children else "1 = 0"


def _strict_sql(q: str, synonyms: dict | None = None) -> str:
    node = ast.parse(q, synonyms)
    terms = ", ".join(f"'{t}'" for t in node.terms()) or "''"
    return f"WITH {_TOK} SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM tok WHERE term IN ({terms}) GROUP BY doc_id HAVING {_sql_tree(node)}"


BOOLEAN = {
    "bool_term": "tion",
    "bool_and": "tion and ble",
    "bool_or": "thth or quell",
    "bool_not": "not tion ble",
    "bool_and_not": "tion and not ble",
    "bool_nested_parens": "( tion or ble ) and not thth",
    "bool_implicit_and": "er re th",
    "bool_double_not": "not not ble er",
    "bool_missing_term": "zzzz or ( ble and yyyy )",
    "bool_empty_query": "the of is",
    "bool_pure_not": "not tion",
    "bool_paren_token": "(293) or tion and er",
}
for _name, _q in BOOLEAN.items():
    QUERIES[_name], SQL[_name] = _strict(_q), _strict_sql(_q)
QUERIES["synonym_query"], SQL["synonym_query"] = _strict("tion and not des", SYNONYMS), _strict_sql("tion and not des", SYNONYMS)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["bool_nested_parens"](spark, sf)


def _compat(q: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        node = ast.parse(q)
        return boolean.compat(opened(spark, sf).postings(node.terms()), node)

    return run


def _pair(a: str, b: str, m: str) -> str:
    return f"""WITH {_TOK}, p AS (SELECT doc_id, count(*) FILTER (term = '{a}') AS a, count(*) FILTER (term = '{b}') AS b
FROM tok WHERE term IN ('{a}', '{b}') GROUP BY doc_id), s AS (SELECT sum(a) AS na, sum(b) AS nb FROM p),
r AS (SELECT doc_id, CAST({m} AS BIGINT) AS m FROM p, s) SELECT doc_id, m FROM r WHERE m > 0"""


_MIN = "CASE WHEN na > 10 * nb THEN (CASE WHEN a > 0 THEN b ELSE 0 END) WHEN nb > 10 * na THEN (CASE WHEN b > 0 THEN a ELSE 0 END) ELSE least(a, b) END"
COMPAT = {
    "compat_term_bag": ("tion", _pair("tion", "", "a")),
    "compat_and_bag": ("tion ble", _pair("tion", "ble", _MIN)),
    "compat_and_skew": ("er thth", _pair("er", "thth", _MIN)),
    "compat_and_empty_left": ("zzzz tion", _pair("tion", "zzzz", "a")),
    "compat_or_bag": ("tion or zzzz", _pair("tion", "zzzz", "a")),
    "compat_except_bag": ("tion and not ble", _pair("tion", "ble", "greatest(a - b, 0)")),
}
for _name, (_q, _s) in COMPAT.items():
    QUERIES[_name], SQL[_name] = _compat(_q), _s

_SYN = " UNION ALL ".join(f"SELECT '{t}' AS term, '{s}' AS form" for t, own in SYNONYMS.items() for s in own)


@query(f"""WITH {_TOK}, syn AS ({_SYN}), q AS (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark)
SELECT DISTINCT item_id, term, form FROM (SELECT item_id, term, term AS form FROM q UNION ALL SELECT item_id, q.term, form FROM q JOIN syn ON q.term = syn.term)""")
def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    forms = spark.createDataFrame([(t, s) for t, s in SYNONYMS.items()], "term string, forms array<string>")
    q = table(spark, sf, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    own = q.join(F.broadcast(forms), "term", "left")
    return own.select("item_id", "term", F.explode(F.array_union(F.array("term"), F.coalesce("forms", F.array().cast("array<string>")))).alias("form")).distinct()


def _having(spark: SparkSession, sf: str, term: str) -> DataFrame:
    return opened(spark, sf).postings([term]).select("doc_id")


def _set_sql(op: str) -> str:
    return f"WITH {_TOK} SELECT doc_id FROM tok WHERE term = 'tion' {op} SELECT doc_id FROM tok WHERE term = 'ble'"


@query(_set_sql("INTERSECT"))
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return _having(spark, sf, "tion").intersect(_having(spark, sf, "ble"))


@query(_set_sql("UNION"))
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return _having(spark, sf, "tion").union(_having(spark, sf, "ble")).distinct()


@query(_set_sql("EXCEPT"))
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return _having(spark, sf, "tion").exceptAll(_having(spark, sf, "ble"))


# topics, judgments, evaluation


def titles(spark: SparkSession, sf: str) -> dict[str, str]:
    """The topics: the first three tokens of each benchmark text. Queries come to the driver, where they are parsed."""
    own = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.array_join(F.slice(T.raw_tokens(F.col("text")), 1, 3), " ").alias("title"))
    return {r["qid"]: r["title"] for r in own.collect()}


def _topics_sql() -> str:
    """Titles have three tokens at most: every sequence of operators, parentheses and words that long is parsed here, and the SQL has
    the resulting condition of each."""
    kinds = ("and", "or", "not", "(", ")", "word")
    holds, asked = [], []

    def name(term: str) -> str:
        return f"t[{term[4:]}]" if term.startswith("word") else f"'{term}'"

    def tree(n: ast.Node) -> str:
        if n.op == "TERM":
            return f"list_contains(present, {name(n.term)})"
        return f"NOT {tree(n.children[0])}" if n.op == "NOT" else "(" + f" {n.op} ".join(map(tree, n.children)) + ")"

    for length in (1, 2, 3):
        for own in product(kinds, repeat=length):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    node = ast.parse(" ".join(f"word{i + 1}" if k == "word" else k for i, k in enumerate(own)))
                except ast.QueryParseError:
                    continue
            sig = " ".join(own)
            holds.append(f"WHEN '{sig}' THEN {tree(node)}")
            asked.append(f"WHEN '{sig}' THEN [{', '.join(map(name, node.terms()))}]")
    return f"""WITH {_POST}, q AS (SELECT CAST(item_id AS VARCHAR) AS qid,
list_filter(list_transform((regexp_extract_all(text, '[A-Za-z0-9()]+'))[1:3], lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS t FROM benchmark),
s AS (SELECT *, array_to_string(list_transform(t, lambda x: CASE WHEN x IN ('and', 'or', 'not', '(', ')') THEN x ELSE 'word' END), ' ') AS sig FROM q),
a AS (SELECT DISTINCT qid, unnest(CASE sig {" ".join(asked)} END) AS term FROM s),
h AS (SELECT qid, doc_id, list(term) AS present FROM a JOIN post USING (term) GROUP BY qid, doc_id)
SELECT qid, doc_id FROM h JOIN s USING (qid) WHERE CASE sig {" ".join(holds)} END"""


@query(_topics_sql())
def topics_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All topics as boolean queries in one plan; one that doesn't parse has no hits."""
    parsed = {}
    for qid, title in titles(spark, sf).items():
        try:
            parsed[qid] = ast.parse(title)
        except ast.QueryParseError:
            pass
    return boolean.batch(opened(spark, sf).postings(sorted({t for n in parsed.values() for t in n.terms()})), parsed)


def plain_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The topics as conjunctions of their tokens, operator words being tokens like others, in one relational plan. A pair of topic and
    document comes once a term, from files of many: counting before the pairs meet would hold those of a task and lessen nothing."""
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.slice(T.tokens(F.col("text")), 1, 3))).alias("term"))
    need = terms.groupBy("qid").agg(F.count("*").alias("need"))
    pairs = boolean.if_small(terms).join(opened(spark, sf).postings(), "term").select("qid", "doc_id")
    met = spread(pairs, "qid", "doc_id", small=True).groupBy("qid", "doc_id").agg(F.count("*").alias("have"))
    return met.join(need, "qid").where("have = need").select("qid", "doc_id")


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """A document is relevant to the benchmark items whose whole text it holds.

    Such a document has all tokens of the item but perhaps those at its ends, which may be parts of its own; so only the
    documents of the rarest of these are read. An item without such tokens meets all documents."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item")).where("item is not null")
    inner = F.regexp_replace("item", r"^[A-Za-z0-9()]+|[A-Za-z0-9()]+$", " ")
    items = items.withColumn("terms", F.array_distinct(T.tokens(inner)))
    index = opened(spark, sf)
    held = items.select("qid", F.explode("terms").alias("term")).join(index.dictionary, "term", "left")
    rarest = held.groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("qid", F.col("r.term").alias("term"))
    met = index.postings().join(rarest, "term").select("qid", "doc_id").join(docs(spark, sf).select("doc_id", "text"), "doc_id").join(items.select("qid", "item"), "qid")
    out = met.where(F.contains("text", "item")).select("qid", "doc_id")
    bare = items.where(F.size("terms") == 0)
    if not bare.isEmpty():
        out = out.unionByName(docs(spark, sf).join(bare, F.contains(F.col("text"), F.col("item"))).select("qid", "doc_id"))
    return out


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))


_HITS = f"""{_POST}, q AS (SELECT DISTINCT item_id AS qid, unnest(({_tokens('text')})[1:3]) AS term FROM benchmark),
need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
hits AS (SELECT qid, doc_id FROM q JOIN post USING (term) JOIN need USING (qid) GROUP BY qid, doc_id, need HAVING count(*) = need)"""
_QRELS = "qrels AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_HITS} SELECT qid, doc_id FROM hits")
def topics_plain(spark: SparkSession, sf: str) -> DataFrame:
    return plain_hits(spark, sf)


@query(f"WITH {_QRELS} SELECT qid, doc_id FROM qrels")
def qrels_join(spark: SparkSession, sf: str) -> DataFrame:
    return qrels(spark, sf)


@query("SELECT doc_id, quality FROM labels WHERE quality > 0 AND doc_id NOT IN (SELECT page_id FROM pages)")
def qrels_missing(spark: SparkSession, sf: str) -> DataFrame:
    judged = table(spark, sf, "labels").where("quality > 0").select("doc_id", "quality")
    return judged.join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query(f"WITH {_POST} SELECT term, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k FROM post WHERE term IN ('er', 'tion', 'ble')) WHERE k <= 2048")
def candidates_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = opened(spark, sf).postings(["er", "tion", "ble"]).select(F.col("term").alias("qid"), "doc_id")
    return R.candidates(hits).withColumnRenamed("qid", "term")


_CAND = f"""{_HITS}, store AS (SELECT doc_id, array_to_string(({_tokens('text')})[1:256], ' ') AS content FROM documents WHERE len({_tokens('text')}) > 0),
cand AS (SELECT qid, doc_id, content FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS k FROM hits) JOIN store USING (doc_id) WHERE k <= 2048)"""


@query(f"WITH {_CAND} SELECT qid, doc_id, content FROM cand")
def candidate_docs(spark: SparkSession, sf: str) -> DataFrame:
    return R.candidate_docs(plain_hits(spark, sf), opened(spark, sf).docs)


@query(f"""WITH {_CAND}, query AS (SELECT item_id AS qid, ({_tokens('text')})[1:3] AS words FROM benchmark),
own AS (SELECT qid, doc_id, list_filter(string_split(content, ' '), lambda w: list_contains(words, w)) AS o, list_distinct(words) AS w FROM cand JOIN query USING (qid)),
scored AS (SELECT qid, doc_id, round(log2(len(o) + 1.0) + CAST(len(list_distinct(o)) AS DOUBLE) / greatest(len(w), 1), 6) AS score FROM own)
SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored""")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("query"))
    return R.rerank(R.candidate_docs(plain_hits(spark, sf), opened(spark, sf).docs).join(q, "qid"))


_METRICS = f"""{_HITS}, {_QRELS}, n AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
run AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank FROM hits),
judged AS (SELECT qid, rank, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM run LEFT JOIN qrels r USING (qid, doc_id)),
seen AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM judged),
own AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / CAST(10 AS DOUBLE) AS p, sum(CAST(rel * seen AS DOUBLE) / rank) AS precisions,
  min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0) ELSE 0 END) AS dcg FROM seen GROUP BY qid),
metrics AS (SELECT b.item_id AS qid, coalesce(p, 0) AS p_at_k, coalesce(precisions / n_rel, 0) AS ap, coalesce(CAST(1 AS DOUBLE) / first, 0) AS rr,
  coalesce(dcg, 0) AS dcg, coalesce(dcg / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg
  FROM benchmark b LEFT JOIN own ON own.qid = b.item_id LEFT JOIN n ON n.qid = b.item_id)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    run = E.ranked(boolean_scored(plain_hits(spark, sf)))
    return E.topic_metrics(run, qrels(spark, sf), topics(spark, sf))


def boolean_scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.lit(1.0))


def _metric(name: str, column: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _metrics(spark, sf).select("qid", F.round(column, 6).alias(column))

    QUERIES[name], SQL[name] = run, f"WITH {_METRICS} SELECT qid, CAST(round({column}, 6) AS DOUBLE) AS {column} FROM metrics"


for _name, _column in (("eval_p10", "p_at_k"), ("eval_ap", "ap"), ("eval_rr", "rr"), ("eval_dcg10", "dcg"), ("eval_ndcg10", "ndcg")):
    _metric(_name, _column)


@query(f"""WITH {_METRICS} SELECT count(*) AS topics, round(avg(p_at_k), 6) AS precision_at_10, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr,
round(avg(dcg), 6) AS dcg_at_10, round(avg(ndcg), 6) AS ndcg_at_10 FROM metrics""")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = E.summary(_metrics(spark, sf))
    return own.select("topics", *(F.round(c, 6).alias(c) for c in own.columns if c != "topics"))


# statistics


@query("""WITH placed AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
max(CASE WHEN k = CASE WHEN n > 20 THEN CAST(floor(n * 0.95) AS BIGINT) ELSE n - 1 END THEN value END) AS p95 FROM placed GROUP BY event_type""")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    own = stats.latency_stats(table(spark, sf, "events"), "value", ["event_type"])
    return own.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    label: Column = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 1, "_Rerank").otherwise(""))
    return table(spark, sf, "events").select(label.alias("label"), (F.col("user_id") % 8).cast("int").alias("num_cpu_workers"), F.col("value").alias("query_processing_time_ms"))


@query("""WITH runs AS (SELECT CAST(user_id % 8 AS INTEGER) AS num_cpu_workers, event_id % 2 = 1 AS reranked, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.num_cpu_workers, round(a.v, 6) AS boolean, round(b.v, 6) AS rerank, round(CASE WHEN a.v > 0 THEN (b.v - a.v) * 100 / a.v ELSE 0 END, 6) AS change
FROM runs a JOIN runs b USING (num_cpu_workers) WHERE NOT a.reranked AND b.reranked""")
def percent_change(spark: SparkSession, sf: str) -> DataFrame:
    own = stats.compared(_runs(spark, sf))
    return own.select("num_cpu_workers", *(F.round(c, 6).alias(c) for c in ("boolean", "rerank", "change")))


@query("""SELECT label, num_cpu_workers, round(avg(value), 6) AS query_processing_time_ms FROM
(SELECT event_type || CASE WHEN event_id % 2 = 1 THEN '_Rerank' ELSE '' END AS label, CAST(user_id % 8 AS INTEGER) AS num_cpu_workers, value FROM events) GROUP BY label, num_cpu_workers""")
def mean_by_run(spark: SparkSession, sf: str) -> DataFrame:
    own = stats.mean_by(_runs(spark, sf), ["label", "num_cpu_workers"], ["query_processing_time_ms"])
    return own.withColumn("query_processing_time_ms", F.round("query_processing_time_ms", 6))


@query("SELECT event_type, count(*) AS n, round(count(*) * 1000.0 / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("ms"))
    return own.select("event_type", "n", F.round(stats.throughput(F.col("n"), F.col("ms")), 6).alias("per_second"))


@query("""WITH runs AS (SELECT CAST(user_id % 8 AS INTEGER) AS num_cpu_workers, event_id % 2 = 1 AS r, avg(value) AS v, avg(value + 1) AS w FROM events GROUP BY ALL)
SELECT a.num_cpu_workers, round((b.v - a.v) * 100 / a.v, 6) AS throughput_change, round((b.w - a.w) * 100 / a.w, 6) AS latency_change
FROM runs a JOIN runs b USING (num_cpu_workers) WHERE NOT a.r AND b.r""")
def report_changes(spark: SparkSession, sf: str) -> DataFrame:
    own = stats.changes(_results(spark, sf))
    return own.select("num_cpu_workers", F.round("throughput_change", 6).alias("throughput_change"), F.round("latency_change", 6).alias("latency_change"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs: each figure of a run is a value of theirs."""
    figures = {"throughput_qps": F.col("value"), "median_latency_ms": F.col("value") + 1}
    own = table(spark, sf, "events").select((F.col("user_id") % 8).cast("int").alias("num_cpu_workers"), (F.col("event_id") % 2 == 1).alias("use_reranking"), *(figures.get(c, F.col("value")).alias(c) for c in stats.RUN[3:]))
    return stats.mean_by(own, ["num_cpu_workers", "use_reranking"], stats.RUN[3:])


@query("""SELECT CAST(user_id % 8 AS INTEGER) AS num_cpu_workers, event_id % 2 = 1 AS use_reranking, round(avg(value), 6) AS precision_at_10, round(avg(value), 6) AS map, round(avg(value), 6) AS ndcg_at_10
FROM events WHERE user_id % 8 = (SELECT max(user_id % 8) FROM events) GROUP BY ALL""")
def report_most_workers(spark: SparkSession, sf: str) -> DataFrame:
    own = stats.at_most_workers(_results(spark, sf))
    return own.select("num_cpu_workers", "use_reranking", *(F.round(c, 6).alias(c) for c in ("precision_at_10", "map", "ndcg_at_10")))


@query("""SELECT count(*) AS judged, count(*) FILTER (p.page_id IS NOT NULL) AS relevant, count(*) FILTER (p.page_id IS NULL) AS missing, count(DISTINCT CASE WHEN p.page_id IS NOT NULL THEN toxic END) AS topics
FROM labels LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = doc_id WHERE quality > 0""")
def qrels_counts(spark: SparkSession, sf: str) -> DataFrame:
    judged = table(spark, sf, "labels").select(F.col("toxic").alias("qid"), F.col("doc_id").alias("doc_name"), F.col("quality").alias("rel"))
    return readers.counted(judged, table(spark, sf, "pages").select(F.col("page_id").alias("doc_name")))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT page_id FROM pages)")
def qrels_saved(spark: SparkSession, sf: str) -> DataFrame:
    judged = table(spark, sf, "labels").select(F.col("doc_id").alias("doc_name"), "quality")
    return readers.saved_judgments(judged, table(spark, sf, "pages").select(F.col("page_id").alias("doc_name"))).withColumnRenamed("doc_name", "doc_id")


@query(f"""WITH {_HITS}, top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS k FROM hits)
SELECT qid, doc_id, url AS doc_name FROM top LEFT JOIN pages ON page_id = doc_id WHERE k <= 5""")
def top5_named(spark: SparkSession, sf: str) -> DataFrame:
    """The first five hits of each topic with a name, here the URL of the page of that number, where there is one."""
    names = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("doc_name"))
    return R.candidates(plain_hits(spark, sf), 5).join(names, "doc_id", "left")


# WordPiece

_BASIC = r"regexp_extract_all(translate(regexp_replace(regexp_replace(html, '[\t\n\r]', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]|[^ !-/:-@\[-`{-~]+')"


@query(f"SELECT page_id, len({_BASIC}) AS n_tokens, array_to_string({_BASIC}, ' ') AS tokens FROM pages")
def wordpiece_basic(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "pages").select("page_id", T.basic_tokens(F.col("html")).alias("t"))
    return own.select("page_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def _pieces_sql(table_: str, column: str) -> str:
    """Tables of the words of a column and, by word, the ids of its pieces: at each step the longest that fits."""
    vocabulary = ", ".join("('" + t.replace("'", "''") + f"', {i})" for t, i in VOCAB.items())
    basic = _BASIC.replace("html", f"coalesce({column}, '')")
    return f"""v(piece, id) AS (VALUES {vocabulary}),
part AS (SELECT id, starts_with(piece, '##') AS inner_, CASE WHEN starts_with(piece, '##') THEN piece[3:] ELSE piece END AS p FROM v),
word AS (SELECT DISTINCT unnest({basic}) AS word FROM {table_}),
m(word, pos, ids) AS (SELECT word, 1, CAST([] AS BIGINT[]) FROM word WHERE strlen(word) <= 200
  UNION ALL SELECT m.word, m.pos + max(length(p)), list_append(m.ids, CAST(arg_max(id, length(p)) AS BIGINT)) FROM m JOIN part ON inner_ = (m.pos > 1) AND starts_with(substr(m.word, m.pos), p)
  WHERE m.pos <= length(m.word) GROUP BY m.word, m.pos, m.ids),
known AS (SELECT word, coalesce(any_value(m.ids) FILTER (pos = length(word) + 1), [CAST({VOCAB["[UNK]"]} AS BIGINT)]) AS ids FROM word LEFT JOIN m USING (word) GROUP BY word)"""


def _ids_sql(words: str, key: str) -> str:
    """ids of each row of ``words`` (the key columns and its words as w), in the order of the words."""
    return f"""SELECT {key}, flatten(list(ids ORDER BY k)) AS ids FROM (SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS k FROM {words}) JOIN known USING (word) GROUP BY {key}"""


@query(f"""WITH RECURSIVE {_pieces_sql("pages", "html")}, own AS (SELECT page_id, {_BASIC.replace("html", "coalesce(html, '')")} AS w FROM pages), got AS ({_ids_sql("own", "page_id")})
SELECT page_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM own LEFT JOIN got USING (page_id)""")
def wordpiece_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(table(spark, sf, "pages")).select("page_id", F.array_join(wordpiece.piece_ids(F.col("html"), VOCAB).cast("array<string>"), " ").alias("ids"))


_TURN_WORDS = _BASIC.replace("html", "coalesce(text, '')")


@query(f"""WITH RECURSIVE {_pieces_sql("conversations", "text")}, own AS (SELECT conv_id, turn, role, text, {_TURN_WORDS} AS w FROM conversations), got AS ({_ids_sql("own", "conv_id, turn")}),
turns AS (SELECT own.conv_id, own.turn, role, text, coalesce(ids, []) AS d FROM own LEFT JOIN got USING (conv_id, turn)),
pairs AS (SELECT *, lag(d) OVER p AS q, lag(text) OVER p AS before FROM turns WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
built AS (SELECT conv_id, turn, role, text, ([{VOCAB["[CLS]"]}] || q || [{VOCAB["[SEP]"]}] || d[1:greatest(509 - len(q), 0)] || [{VOCAB["[SEP]"]}])[1:512] AS i FROM pairs WHERE before IS NOT NULL)
SELECT conv_id, turn, role, text, array_to_string(list_resize(i, 512, {VOCAB["[PAD]"]}), ' ') AS input_ids, len(i) AS n_ids FROM built""")
def encode_pair(spark: SparkSession, sf: str) -> DataFrame:
    turn = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf, "conversations").withColumn("query", F.lag("text").over(turn)).where("query is not null").withColumn("content", F.col("text"))
    got = wordpiece.encode_pairs(own, VOCAB).select("conv_id", "turn", "role", "text", "input_ids", "attention_mask")
    n = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("conv_id", "turn", "role", "text", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), n.alias("n_ids"))
