"""The retrieval engine on the micro-corpus, against a list model, and on files."""

import random

import pytest

from ferrule.engine import BenchmarkConfig, Engine, run_benchmark, run_indexing_benchmark
from ferrule.functions import text as T
from ferrule.operators import evaluate, rerank, stats, wordpiece
from ferrule.operators.index import build_index, postings
from ferrule.plans import boolean
from ferrule.plans.ast import EMPTY, Node, QueryParseError, parse
from ferrule.sources import readers

MICRO = [(0, "apple apple banana"), (1, "apple cherry"), (2, "banana cherry cherry"), (3, "durian (banana split)")]
SYN = {"fruit": ["apple", "cherry pie", "durian"]}
CASES = {
    "apple": ([0, 0, 1], [0, 1]),
    "apple banana": ([0], [0]),
    "apple and not banana": ([0, 1], [1]),
    "cherry and not banana": ([1, 2], [1]),
    "zzz apple": ([0, 0, 1], []),
    "apple zzz": ([], []),
    "apple durian cherry": ([1, 2, 2], []),
    "apple or zzz": ([0, 0, 1], [0, 1]),
    "apple or cherry": ([0, 1, 2], [0, 1, 2]),
    "not apple": ([], []),
    "not apple banana": ([2], [2]),
    "( apple or cherry ) and banana": ([0, 2], [0, 2]),
    "(banana": ([3], [3]),
    "fruit": ([0, 1, 3], [0, 1, 3]),
    "": ([], []),
    "the of": ([], []),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    build_index(spark.createDataFrame(MICRO, "doc_id long, text string"), path, num_shards=4)
    return Engine(spark, path, SYN)


@pytest.mark.parametrize("query", CASES)
def test_micro_corpus(engine, query):
    compat, strict = CASES[query]
    assert [r["doc_id"] for r in engine.search(query, "compat").collect()] == compat
    assert [r["doc_id"] for r in engine.search(query).collect()] == strict


@pytest.mark.parametrize("query", ["durian ( banana", "apple or", "apple and", "not", "( )"])
def test_parse_errors(query):
    with pytest.raises(QueryParseError):
        parse(query)


def test_tree_dump_and_corner_cases():
    assert parse("fruit apple", SYN).dump() == 'AND\n  OR\n    TERM("apple")\n    TERM("cherry pie")\n    TERM("durian")\n    TERM("fruit")\n  TERM("apple")'
    assert parse("and x").dump() == 'AND\n  TERM("and")\n  TERM("x")'
    assert parse("not or x").dump() == 'AND\n  NOT\n    TERM("or")\n  TERM("x")'
    with pytest.warns(UserWarning):
        assert parse("x ) y") == Node("TERM", "x")


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return Node("TERM", rng.choice(["apple", "banana", "cherry", "durian", "zzz"]))
    op = rng.choice(["AND", "OR", "NOT"])
    return Node(op, children=tuple(random_tree(rng, depth - 1) for _ in range(1 if op == "NOT" else rng.randint(1, 3))))


def test_batch_and_strict_against_sets(spark):
    rng = random.Random(1)
    words = {i: {t for t in text.replace("(", "").replace(")", "").split()} for i, text in MICRO}
    posted = spark.createDataFrame([(t, i, 1) for i, own in words.items() for t in own], "term string, doc_id long, tf long")

    def holds(n, own):
        if n.op == "TERM":
            return n.term in own
        if n.op == "NOT":
            return not holds(n.children[0], own)
        return (all if n.op == "AND" else any)(holds(c, own) for c in n.children)

    trees = {str(k): random_tree(rng) for k in range(40)} | {"none": EMPTY}
    want = {(q, i) for q, n in trees.items() for i, own in words.items() if own & set(n.terms()) and holds(n, own)}
    assert {(r["qid"], r["doc_id"]) for r in boolean.batch(posted, trees).collect()} == want
    for q in ("0", "1", "2", "3"):
        assert {r["doc_id"] for r in boolean.strict(posted, trees[q]).collect()} == {i for p, i in want if p == q}
    assert boolean.batch(posted, {}).count() == 0


def test_batch_of_queries_without_a_small_normal_form(spark):
    """13 disjunctions of two, and ten terms of three synonyms: their trees are small, their normal forms are not."""
    rng = random.Random(5)
    words = {i: rng.sample([f"{a}{k}" for a in "ab" for k in range(13)] + [f"t{k}" for k in range(10)] + [f"s{k}x{j}" for k in range(10) for j in range(3)], 34) for i in range(60)}
    words |= {100: [f"{rng.choice('ab')}{k}" for k in range(13)], 101: [rng.choice([f"t{k}", f"s{k}x1"]) for k in range(10)]}
    posted = spark.createDataFrame([(t, i, 1) for i, own in words.items() for t in own], "term string, doc_id long, tf long")
    ors = parse(" and ".join(f"( a{k} or b{k} )" for k in range(13)))
    synonyms = parse(" ".join(f"t{k}" for k in range(10)), {f"t{k}": [f"s{k}x{j}" for j in range(3)] for k in range(10)})
    want = {("ors", i) for i, own in words.items() if all({f"a{k}", f"b{k}"} & set(own) for k in range(13))} | {("syn", i) for i, own in words.items() if all({f"t{k}", *(f"s{k}x{j}" for j in range(3))} & set(own) for k in range(10))}
    assert ("ors", 100) in want and ("syn", 101) in want
    assert {(r["qid"], r["doc_id"]) for r in boolean.batch(posted, {"ors": ors, "syn": synonyms}).collect()} == want
    for q, n in (("ors", ors), ("syn", synonyms)):
        assert {(q, r["doc_id"]) for r in boolean.strict(posted, n).collect()} == {x for x in want if x[0] == q}


def test_compat_against_a_list_model(spark):
    """The list evaluator of the survey: posting lists with repeats, two-pointer operations."""
    rng = random.Random(2)
    lists = {"apple": [0, 0, 1], "banana": [0, 2], "cherry": [1, 2, 2], "durian": [3], "zzz": []}

    def minus(a, b):
        out, b = [], list(b)
        for x in a:
            if x in b:
                b.remove(x)
            else:
                out.append(x)
        return out

    def common(a, b):
        if not a or not b:
            return []
        if len(a) > 10 * len(b):
            return [x for x in b if x in a]
        if len(b) > 10 * len(a):
            return [x for x in a if x in b]
        return minus(a, minus(a, b))

    def of(n, context, universe):
        if n.op == "TERM":
            return lists[n.term]
        if n.op == "NOT":
            return minus(context or universe, of(n.children[0], context, universe))
        out = []
        for i, c in enumerate(n.children):
            if n.op == "OR":
                m = of(c, None, universe)
                out = m if not out else out if not m else sorted(set(out) | set(m))
            elif i == 0 or not out:
                out = of(c, None, universe)
            else:
                out = of(c, out, universe) if c.op == "NOT" else common(out, of(c, None, universe))
        return out

    posted = postings(spark.createDataFrame(MICRO, "doc_id long, text string"))  # its "(banana" is another term
    for _ in range(25):
        n = random_tree(rng, 2)
        held = [lists[t] for t in n.terms() if lists[t]]
        universe = held[0] if len(held) == 1 else sorted({x for own in held for x in own})
        got = sorted(r["doc_id"] for r in boolean.compat(posted, n).collect() for _ in range(r["m"]))
        assert got == sorted(of(n, None, universe)), n.dump()


def test_text(spark):
    rows = spark.createDataFrame([("What IS the COVID-19 (origin)?",), ("café naïve",), ("Ka",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(T.preprocess(rows.t)).collect()]
    assert got[:2] == ["covid 19 (origin)", "caf na ve"] and got[3] == "" and got[4] is None
    assert [r[0] for r in rows.limit(1).select(T.basic_tokens(rows.t)).collect()][0] == ["what", "is", "the", "covid", "-", "19", "(", "origin", ")", "?"]


def test_wordpiece():
    vocab = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] un ##aff ##able".split())}
    w = wordpiece.WordPiece(vocab)
    assert w.basic("COVID-19's a_b") == ["covid", "-", "19", "'", "s", "a", "_", "b"]
    assert w.tokenize("unaffable") == ["un", "##aff", "##able"] and w.tokenize("unaffablez") == ["[UNK]"]
    assert w.encode_pair("un", "unaffable", 8) == ([2, 4, 3, 4, 5, 6, 3, 0], [1, 1, 1, 1, 1, 1, 1, 0])
    assert w.tokenize("x" * 300) == ["[UNK]"] and len(w.encode_pair("un " * 50, "un", 16)[0]) == 16


def test_metrics(spark):
    run = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 1.0)], "qid string, doc_id long, score double")
    rel = spark.createDataFrame([("q", 1), ("q", 3), ("q", 4)], "qid string, doc_id long")
    topics = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = {r["qid"]: r for r in evaluate.topic_metrics(evaluate.ranked(run), rel, topics).collect()}
    assert [round(got["q"][c], 6) for c in ("p_at_k", "ap", "rr", "dcg", "ndcg")] == [0.2, 0.555556, 1.0, 1.5, 0.703918]
    assert got["none"]["ndcg"] == 0.0
    assert evaluate.evaluate(run.limit(0), rel, topics.limit(0)).collect() == []


def test_latency(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(21)] + [("b", float(i)) for i in range(1, 21)], "k string, v double")
    got = {r["k"]: (r["median"], r["p95"]) for r in stats.latency_stats(rows, "v", ["k"]).collect()}
    assert got == {"a": (10.0, 19.0), "b": (10.5, 20.0)}
    clash = rows.selectExpr("k AS n", "k AS mean", "v AS k")
    assert {r["n"]: (r["median"], r["p95"]) for r in stats.latency_stats(clash.drop("mean"), "k", ["n"]).toDF("n", "many", "mean", "median", "p95").collect()} == got


def test_files(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for name, text in (("b", "beta text"), ("a", "alpha\ntext"), ("empty", "")):
        (corpus / f"{name}.txt").write_text(text)
    got = readers.read_corpus(spark, str(corpus)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["doc_name"], r["text"]) for r in got] == [(0, "a", "alpha\ntext"), (1, "b", "beta text")]
    (tmp_path / "topics").write_text("<top>\n<num>Number: 1</num>\n<title>What is Alpha</title>\n</top>\n<top>\n<num>2</num>\n<title>The Of</title>\n</top>\n")
    assert {(r["qid"], r["query"]) for r in readers.read_topics(spark, str(tmp_path / "topics")).collect()} == {("1", "alpha"), ("2", "the of")}
    assert readers.read_topics(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "qrels").write_text("1 0 a 1\n1 0 b 0\n1 0 c 2\nbroken line\n")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, doc_name string")
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "qrels"), names).collect()] == [("1", 0)]
    assert [tuple(r) for r in readers.missing_judgments(spark, str(tmp_path / "qrels"), names).collect()] == [("1", "c")]
    assert readers.counted(readers.read_judgments(spark, str(tmp_path / "qrels")), names).first().asDict() == {"judged": 2, "relevant": 1, "missing": 1, "topics": 1}
    assert readers.saved_judgments(readers.read_judgments(spark, str(tmp_path / "qrels")), names).count() == 2
    assert readers.read_synonyms(spark, str(tmp_path / "none")) == {}
    (tmp_path / "syn").write_text("# no\nx: A, b\ny:\nx: C\n")
    assert readers.read_synonyms(spark, str(tmp_path / "syn")) == {"x": ["c"]}
    (tmp_path / "stop").write_text("# no\nFoo\nand\n")
    assert readers.read_stop_words(spark, str(tmp_path / "stop")) == ("foo",)


def test_benchmark_and_rerank(spark, engine):
    class Length:
        def score(self, query, docs):
            return [float(len(d)) for d in docs]

    rel = spark.createDataFrame([("1", 0), ("2", 3)], "qid string, doc_id long")
    out = run_benchmark(engine, {"1": "apple", "2": "durian (", "3": "cherry or banana"}, rel, BenchmarkConfig("x", 1, True)).collect()
    assert [r["label"] for r in out] == ["x", "x_Rerank"] and 0 <= out[0]["map"] <= 1
    assert list(out[0].asDict()) == stats.RUN and out[0]["avg_reranking_ms"] == 0 < out[1]["avg_reranking_ms"] and out[1]["median_latency_ms"] > out[0]["median_latency_ms"]
    hits, _ = engine.search_batch({"1": "apple"})
    got = rerank.rerank(rerank.candidate_docs(hits, engine.index.docs).selectExpr("*", "'apple' AS query"), Length()).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1]


def test_null_queries_rerank_alike(spark):
    class Length:
        def score(self, query, docs):
            return [float(len(query) + len(d)) for d in docs]

    pairs = spark.createDataFrame([("1", 1, "apple", "an apple"), ("1", 2, None, "pear"), ("1", 3, "apple", None)], "qid string, doc_id long, query string, content string")
    assert rerank.rerank(pairs).count() == 3 and rerank.rerank(pairs).orderBy("rank").first()["doc_id"] == 1
    assert {(r["doc_id"], r["score"]) for r in rerank.rerank(pairs, Length()).collect()} == {(1, 13.0), (2, 4.0), (3, 5.0)}


def _pb(number, value):
    """A protocol buffer field: an int as a varint, bytes or text with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_neural_scorer_on_a_tiny_model(spark, tmp_path):
    """A model that sums the ids it may look at."""
    pytest.importorskip("onnxruntime")
    node = lambda op, ins, out, *attributes: _pb(1, b"".join(_pb(1, i) for i in ins) + _pb(2, out) + _pb(4, op) + b"".join(_pb(5, a) for a in attributes))
    value = lambda field, name, kind, dims: _pb(field, _pb(1, name) + _pb(2, _pb(1, _pb(1, kind) + _pb(2, b"".join(_pb(1, _pb(2, d)) for d in dims)))))
    graph = node("Mul", ["input_ids", "attention_mask"], "seen") + node("ReduceSum", ["seen"], "sum", _pb(1, "axes") + _pb(8, 1) + _pb(20, 7), _pb(1, "keepdims") + _pb(3, 1) + _pb(20, 2)) + node("Cast", ["sum"], "logits", _pb(1, "to") + _pb(3, 1) + _pb(20, 2))
    graph += _pb(2, "g") + value(11, "input_ids", 7, "NS") + value(11, "attention_mask", 7, "NS") + value(12, "logits", 1, "NO")
    (tmp_path / "m.onnx").write_bytes(_pb(1, 6) + _pb(7, graph) + _pb(8, _pb(1, "") + _pb(2, 11)))
    words = "[PAD] [UNK] [CLS] [SEP] un ##aff ##able red".split()
    (tmp_path / "vocab.txt").write_text("\n".join(words) + "\n")
    own = rerank.OnnxScorer(str(tmp_path / "m.onnx"), str(tmp_path / "vocab.txt"), 16)
    assert own.score("un", ["unaffable", "red", ""]) == [2 + 4 + 3 + 4 + 5 + 6 + 3, 2 + 4 + 3 + 7 + 3, 2 + 4 + 3 + 3]
    pairs = spark.createDataFrame([("1", k, "un", t) for k, t in enumerate(["", "red", "unaffable"] * 100)], "qid string, doc_id long, query string, content string")
    got = rerank.rerank(pairs, own, batch=7).orderBy("rank").collect()
    assert [r["score"] for r in got] == [27.0] * 100 + [19.0] * 100 + [12.0] * 100 and [r["doc_id"] for r in got[:2]] == [2, 5]


def test_command_line(spark, tmp_path, capsys):
    from ferrule.__main__ import answer, main

    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for name, text in (("b", "beta gamma"), ("a", "alpha beta"), ("c", "the of"), ("d", "delta beta beta")):
        (corpus / f"{name}.txt").write_text(text)
    index, results = str(tmp_path / "index"), str(tmp_path / "results")
    main(["build", str(corpus), index], spark)
    main(["search", index, "beta", "and", "not", "gamma"], spark)
    said = capsys.readouterr().out
    assert said.startswith("2 documents\n  a (0)\n  d (3)\nbest after reranking\n  1. d (3, ") and said.rstrip().endswith("ms")
    assert "isn't closed" in answer(Engine(spark, index), "( beta")
    assert {r["doc_id"] for r in Engine(spark, index).search("not beta", universe="corpus").collect()} == set()
    assert {r["doc_id"] for r in Engine(spark, index).search("not gamma", universe="corpus").collect()} == {0, 3}
    (tmp_path / "topics").write_text("<top>\n<num>Number: 1</num>\n<title>beta</title>\n</top>\n")
    (tmp_path / "qrels").write_text("1 0 a 1\n")
    for _ in range(2):
        main(["benchmark", index, str(tmp_path / "topics"), str(tmp_path / "qrels"), results, "--workers", "4"], spark)
    runs = stats.read_results(spark, results)
    assert [tuple(r)[:3] for r in runs.orderBy("use_reranking").collect()] == [("Boolean", 4, False), ("Boolean_Rerank", 4, True)]
    assert stats.at_most_workers(runs).count() == 2 and stats.changes(runs).count() == 1
    main(["report", results], spark)
    assert "Change by reranking" in capsys.readouterr().out and stats.report(runs.limit(0)).count("none") == 3
    main(["benchmark-indexing", str(corpus), index, str(tmp_path / "speed"), "--workers", "2"], spark)
    assert stats.read_indexing(spark, str(tmp_path / "speed")).first()["num_cpu_workers"] == 2
    assert run_indexing_benchmark(readers.read_corpus(spark, str(corpus)), index, 1).columns == ["num_cpu_workers", "indexing_time_ms", "throughput_docs_per_sec"]
    assert stats.file_name("a b/c:1") == "a_b_c_1"


def test_dense_ids(spark):
    rng = random.Random(6)
    names = [f"n{rng.randrange(10**6)}" for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in set(names)], "name string").repartition(7)
    got = readers.dense_ids(rows, "name", "k").orderBy("k").collect()
    assert [(r["name"], r["k"]) for r in got] == [(x, i) for i, x in enumerate(sorted(set(names)))]


def test_stream(spark, tmp_path):
    from ferrule.streaming.ingest import index_stream

    spark.createDataFrame(MICRO, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = Engine(spark, str(tmp_path / "out")).index.postings(["cherry"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["tf"]) for r in got] == [(1, 1), (2, 2)]
    spark.createDataFrame([(1, "apple plum"), (9, "plum")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    index_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    engine = Engine(spark, str(tmp_path / "out"))  # document 1 came again
    assert [r["doc_id"] for r in engine.search("cherry").collect()] == [2] and [r["doc_id"] for r in engine.search("plum").collect()] == [1, 9]
    assert {r["term"]: r["df"] for r in engine.index.dictionary.collect()}["plum"] == 2


def plain_pieces(text, vocab):
    """Greedy longest match over words and marks, in plain Python."""
    out = []
    clean = "".join(" " if c in "\t\n\r" else "" if ord(c) < 32 or ord(c) == 127 else c.lower() if c.isascii() else c for c in text)
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for word in "".join(f" {c} " if c in marks else c for c in clean).split(" "):
        at, own = 0, []
        while word and at < len(word):
            lead = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocab), None)
            if end is None or len(word.encode()) > 200:
                own = [vocab.get("[UNK]", 100)]
                break
            own.append(vocab[lead + word[at:end]])
            at = end
        out += own
    return out


def test_wordpiece_ids_against_plain_python(spark, tmp_path):
    from ferrule.queries import VOCAB, wordpiece_ids

    pages = [(1, "<p>The ring, of the\tThing!</p>"), (2, ""), (3, None), (4, "éa " + "x" * 300 + " the"), (5, "in-ter re")] + [(10 + r["page_id"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    spark.createDataFrame([(i, "u", t) for i, t in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["ids"] for r in wordpiece_ids(spark, str(tmp_path)).collect()}
    assert got == {i: " ".join(map(str, plain_pieces(t or "", VOCAB))) for i, t in pages}


def test_encode_pair_has_the_reference_size(spark, tmp_path):
    from ferrule.queries import VOCAB, encode_pair

    turns = [(1, 0, "user", "a short question"), (1, 1, "assistant", "the answer " * 30), (1, 2, "user", "er " * 900), (2, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r for r in encode_pair(spark, str(tmp_path)).collect()}

    def ids(text):
        out = []
        for word in text.split():
            at, own = 0, []
            while at < len(word):
                lead = "##" if at else ""
                end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in VOCAB), None)
                if end is None:
                    own = [VOCAB.get("[UNK]", 100)]
                    break
                own.append(VOCAB[lead + word[at:end]])
                at = end
            out += own
        return out

    cls, sep, pad = (VOCAB.get(t, d) for t, d in (("[CLS]", 101), ("[SEP]", 102), ("[PAD]", 0)))
    assert set(got) == {1, 2}
    for turn in (1, 2):
        q = ids(turns[turn - 1][3])
        want = ([cls, *q, sep, *ids(turns[turn][3])[: max(512 - 3 - len(q), 0)], sep])[:512]
        assert got[turn]["input_ids"] == " ".join(map(str, want + [pad] * (512 - len(want)))) and got[turn]["n_ids"] == len(want)


ODD = [(1, "apple pear"), (1, "pear Plum pear"), (None, "apple"), (None, "apple APPLE"), (2, None), (3, "The of"), (4, "café naïve Ka x-Y_z (a) b)\t\u0000c\n"), (70_000, "apple"), (5, "")]


def plain_counts(rows):
    from collections import Counter

    from ferrule.plans.ast import query_tokens

    return Counter((t, d) for d, text in rows for t in query_tokens(text or ""))


def test_no_table_of_all_pairs(spark):
    """Rows of pairs are sorted, not held in a table whose size is that of the largest task."""
    df = postings(spark.createDataFrame(MICRO, "doc_id long, text string"))
    assert "HashAggregate" not in df._jdf.queryExecution().sparkPlan().toString()


def test_index_of_lists(spark, tmp_path):
    """A batch of documents has a row a term in the index; the counts of an id that comes again add up."""
    from ferrule.operators.index import Index

    for name, rows in (("once", MICRO), ("again", ODD)):
        path = str(tmp_path / name)
        build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, num_shards=4)
        assert {"term", "doc_ids", "tfs"} <= set(spark.read.parquet(f"{path}/postings").columns)
        want, index = plain_counts(rows), Index(spark, path)
        assert {(r.term, r.doc_id): r.tf for r in index.postings().collect()} == want
        assert index.postings().count() == len(want)
        df = {t: sum(t == u for u, _ in want) for t, _ in want}
        assert {r.term: (r.df, r.cf) for r in index.dictionary.collect()} == {t: (n, sum(c for (u, _), c in want.items() if u == t)) for t, n in df.items()}


def test_postings_add_up(spark):
    got = postings(spark.createDataFrame(ODD, "doc_id long, text string")).collect()
    assert len(got) == len(plain_counts(ODD)) and {(r.term, r.doc_id): r.tf for r in got} == plain_counts(ODD)


def test_store_is_preprocessed_text(spark):
    from ferrule.functions.text import preprocess
    from ferrule.operators.index import doc_store

    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    want = docs.select("doc_id", preprocess(docs["text"]).alias("content")).where("content <> ''")
    assert sorted(map(repr, doc_store(docs).collect())) == sorted(map(repr, want.collect()))


def test_posting_lists_move_as_lists(spark):
    """What a batch has of a list moves as a row; lists are cut by blocks and have a document as often as the term."""
    from ferrule.operators.index import posting_lists

    df = posting_lists(spark.createDataFrame(ODD, "doc_id long, text string"))
    assert "MapInArrow" in df._jdf.queryExecution().sparkPlan().toString()
    got = {(r.term, r.block): r.doc_ids for r in df.collect()}
    want = {}
    for (t, d), n in plain_counts(ODD).items():
        want.setdefault((t, None if d is None else d >> 16), []).extend([d] * n)
    assert got == {k: sorted(v, key=lambda d: -1 if d is None else d) for k, v in want.items()}


def test_topics_count_where_pairs_meet(spark):
    """Pairs of topic and document aren't counted before they move: both halves of the count come after the exchange."""
    from ferrule import queries

    plan = queries.plain_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = plan.index("hashpartitioning(qid#", plan.index("count(1)"))
    assert plan[:moved].count("partial_count(1)") >= 1 and "REPARTITION_BY_NUM" in plan


def test_pieces_take_little_memory(spark):
    """Remembered pieces are the vocabulary's own strings, and a worker has the ids of a bounded amount of text at once."""
    import pandas as pd

    from ferrule.operators import wordpiece

    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able"])}
    own = wordpiece.WordPiece(vocab)
    assert all(p is next(t for t in own.vocab if t == p) for p in own.pieces("unaffable"))
    texts = pd.Series(["x" * n for n in (wordpiece.PART // 2, wordpiece.PART // 2, 5, wordpiece.PART * 3, 1, 1)] + [None, ""])
    cut = list(wordpiece._cut(texts))
    assert [len(c) for c in cut] == [2, 1, 1, 4] and pd.concat(cut).equals(texts)


def test_pairs_in_parts(spark, monkeypatch):
    """Pairs are encoded a part at a time, in batches that are bounded by bytes."""
    from ferrule.operators import wordpiece

    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghij"])}
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(i, "abcdefghij"[i % 10], "ab" * (i % 7)) for i in range(3000)]  # more than a part
    got = wordpiece.encode_pairs(spark.createDataFrame(rows, "k int, query string, content string").coalesce(1), vocab).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20
    own = wordpiece.WordPiece(vocab)
    assert {r.k: (r.input_ids, r.attention_mask) for r in got} == {k: own.encode_pair(q, d) for k, q, d in rows}
