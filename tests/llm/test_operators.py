"""The training-data operators against brute force, on small tables of every awkward kind."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ferrule.llm import bpe, chat, decontam, langid, ngram_join, pii, quality, sharding, suffix_dedup, topk
from ferrule.llm._shared import buffers, table
from ferrule.llm.queries import RANKS

KEY = b"a key of the tests"
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, shard string, ids string, bucket int"


def docs(spark, rows):
    """(doc_id, text) rows with the other columns of documents and some of clashing names."""
    full = [(i, t, "en", "s", len(t or ""), 1, 0.5, "x", "y", 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(0)
    same = sentence(rng, 40)
    rows = [(1, None), (2, ""), (3, "   \n"), (4, same), (5, same), (6, same), (6, same), (None, same), (7, sentence(rng, 60_000)), (8, "one"), (9, "é" * 3000), (10, sentence(rng, 50))]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, []).limit(0)


# 1


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.6, 0.85])
    v = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    v[rng.random(v.shape) < 0.2] = 0
    p, n = np.unique(v, axis=0, return_counts=True)
    post, theta = quality.expectation_maximisation(p, n)
    found = theta[1, :, 2] / (theta[1, :, 2] + theta[1, :, 0])
    assert np.abs(found - right).max() < 0.04
    guess = post[[int(np.flatnonzero((p == x).all(1))[0]) for x in v[:2000]]] > 0.5
    assert (guess == truth[:2000]).mean() > 0.9


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.quality_classifier(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").select("keep", "quality").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    poor = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and 1 - sum(poor) / len(poor) > 0.6


def plain_votes(text):
    """The labellers once more, one text at a time in plain Python."""
    raw = (text or "").encode()
    kinds = ["space" if c in b" \t\n\r\x0b\x0c" else "letter" if 97 <= c <= 122 or c >= 128 else "capital" if 65 <= c <= 90 else "digit" if 48 <= c <= 57 else "other" if c in b"#$%&*|{}<>@^~=+\\_`[]" or c < 32 else "mark" for c in raw]
    solid, letters = max(sum(k != "space" for k in kinds), 1), max(sum(k in ("letter", "capital") for k in kinds), 1)
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    n, some = len(words), max(len(words), 1)
    if not n:
        return [0] * len(quality.LABELLERS)

    def repeated(k):
        runs = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        return (len(runs) - len(set(runs))) / max(len(runs), 1)

    known = {w.encode() for w in quality.FUNCTION_WORDS.split()}
    share = lambda k: sum(x == k for x in kinds)
    common, length, ends = sum(w in known for w in words) / some, sum(map(len, words)) / some, sum(raw.count(c) for c in (b".", b"?", b"!")) / some
    runs = sum(raw[i] == raw[i - 1] == raw[i - 2] and kinds[i] in ("mark", "other") for i in range(2, len(raw)))
    tails = sum(k == "other" and (i + 1 == len(raw) or kinds[i + 1] == "space") for i, k in enumerate(kinds))
    rules = [
        (False, share("other") / solid > 0.06), (False, share("capital") / letters > 0.3), (False, repeated(3) > 0.3), (common > 0.15, common < 0.03 and n >= 20), (3 <= length <= 8, length < 2 or length > 14),
        (1 / 60 < ends < 1 / 3, ends == 0 and n >= 40 or ends > 0.5), (n >= 40, n < 6), (False, share("digit") / solid > 0.2), (False, raw.count(b"!") / some > 0.1), (False, (raw.count(b"|") + raw.count(b"\t")) / some > 0.1),
        (False, runs / some > 0.15), (False, tails / some > 0.15), (False, repeated(8) > 0.2 and n >= 20),
    ]
    return [-1 if poor else 1 if good else 0 for good, poor in rules]


def test_quality_against_plain_labellers_and_em(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()] + [(900, None), (901, ""), (902, "one"), (None, "one two"), (903, "#### ==== !!!!"), (903, "#### ==== !!!!")]
    cast = [plain_votes(t) for _, t in rows]
    has = [bool(re.search(rb"[0-9A-Za-z\x80-\xff]", (t or "").encode())) for _, t in rows]
    own = [v for v, h in zip(cast, has) if h]
    post = [1 / (1 + math.exp(-(sum(x > 0 for x in v) - 4.0 * sum(x < 0 for x in v)))) for v in own]
    for _ in range(60):
        theta = [[[1 + sum(p if c else 1 - p for v, p in zip(own, post) if v[k] == x) for x in (-1, 0, 1)] for k in range(len(own[0]))] for c in (0, 1)]
        theta = [[[x / sum(row) for x in row] for row in one] for one in theta]
        prior = min(max(sum(post) / len(post), 0.01), 0.99)
        new = []
        for v in own:
            a, b = (sum(math.log(theta[c][k][x + 1]) for k, x in enumerate(v)) for c in (0, 1))
            new.append(1 / (1 + math.exp(min(max(a - b + math.log(1 - prior) - math.log(prior), -500), 500))))
        done = max(abs(x - y) for x, y in zip(new, post)) < 1e-7
        post = new
        if done:
            break
    post = iter(post)
    want = sorted((repr(i), round(next(post), 4) if h else 0.0) for (i, _), h in zip(rows, has))
    got = quality.quality_classifier(docs(spark, rows)).collect()
    assert [(a, pytest.approx(b, abs=2e-4)) for a, b in want] == sorted((repr(r["doc_id"]), r["posterior"]) for r in got)
    assert all(r["score"] == 0.0 and not r["keep"] for r in got if r["doc_id"] in (900, 901, 903) and not r["posterior"])


def test_quality_awkward(spark, awkward, nothing):
    got = quality.quality_classifier(awkward).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == awkward.count() and all(by[i][0]["score"] == 0.0 and not by[i][0]["keep"] for i in (1, 2, 3))
    assert len({r["score"] for i in (4, 5, 6, None) for r in by[i]}) == 1
    assert quality.quality_classifier(nothing).count() == 0


# 2


def test_bpe_is_the_published_tokenizer(spark, awkward, nothing):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.ranks(RANKS))}, special_tokens={})
    more = docs(spark, [(20, "it's  a\ttest 日本語テキスト 😀 ababababa banana aaaaaaaaaaaa " + "xyz" * 500 + " 1234567890 end  "), (21, "\n\n x\x1c\x85y  z")])
    rows = awkward.unionByName(more).unionByName(docs(spark, [(1000 + r["doc_id"], r["text"]) for r in table(spark, SF, "documents").limit(60).collect()]))
    got = bpe.bpe_round_trip(rows, RANKS).collect()
    assert len(got) == rows.count()
    want = sorted(repr((r["doc_id"], None if r["text"] is None else enc.encode_ordinary(r["text"]), r["text"])) for r in rows.collect())
    assert sorted(repr((r["doc_id"], r["ids"], r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == (None if r["ids"] is None else len(r["ids"])) for r in got)
    assert bpe.bpe_round_trip(nothing, RANKS).count() == 0


def test_bpe_of_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = docs(spark, [(i, " ".join("".join(rng.choice("abcdetho") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 5, 200])))) for i in range(80)])
    want = sorted((r["doc_id"], r["ids"]) for r in bpe.bpe_encode(rows, RANKS).collect())
    monkeypatch.setattr(bpe, "TOKENS", 60)
    monkeypatch.setattr(bpe, "FAMILY", 3)
    assert sorted((r["doc_id"], r["ids"]) for r in bpe.bpe_encode(rows.coalesce(1), RANKS).collect()) == want
    assert any(want[i][1] for i in range(80))


def test_bpe_plans_hold_no_vocabulary(spark):
    rows = docs(spark, [(1, "one two"), (2, "three")])
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        plan = bpe.bpe_round_trip(rows, RANKS)._jdf.queryExecution()
        assert all(len(x.toString()) < 200_000 for x in (plan.optimizedPlan(), plan.executedPlan()))
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")


def test_words_are_those_of_the_pattern():
    import public_tokenizers
    import regex

    rng = random.Random(4)
    signs = ["'", "s", "t", "re", "ll", "d", "x", " ", "  ", "\n", "\t", "\x85", "\u3000", "1", "²", "é", "日", "!", "'s", "😀", "\x1c", "-"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    d, o = buffers(pa.array(texts))
    cut = bpe.word_starts(d, o).tolist() + [len(d)]
    got = [bytes(d[a:b]).decode() for a, b in zip(cut, cut[1:])]
    assert got == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]


def test_folds_are_the_plain_algorithm(spark, tmp_path, monkeypatch):
    """A vocabulary in which pairs of one rank differ in their left token, and words folded flat and in segments."""
    import base64

    rng = random.Random(3)
    pieces = [bytes([b]) for b in range(256)]
    while len(pieces) < 330:
        new = rng.choice(pieces[97:100] + pieces[256:]) + rng.choice(pieces[97:100] + pieces[256:])
        if new not in pieces and len(new) < 9:
            pieces.append(new)
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    rank = {p: i for i, p in enumerate(pieces)}
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 20, 300, 1500]))) for _ in range(60)] + ["a" * 5000]
    monkeypatch.setattr(bpe, "SEGMENT", 4)

    def plain(text):
        word = [bytes([b]) for b in text.encode()]
        while True:
            ranked = [(rank[x + y], i) for i, (x, y) in enumerate(zip(word, word[1:])) if x + y in rank]
            if not ranked:
                return [rank[w] for w in word]
            i = min(ranked)[1]
            word[i : i + 2] = [word[i] + word[i + 1]]

    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(docs(spark, list(enumerate(texts))), str(path)).collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts[:-1])) and b"".join(pieces[x] for x in got[len(texts) - 1]) == texts[-1].encode()


# 3


def test_surrogates(spark, nothing):
    text = "Mr. John Smith <john.smith@mail.org>, Frau Müller; Smith: +1 (017) 555-7713, 4111 1111 1111 1111, 10.1.2.3. token = \"abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71\" г-жа Иванова"
    rows = docs(spark, [(1, text), (2, "JOHN.SMITH@MAIL.ORG and +10175557713 by Dr. Smith"), (3, None), (4, ""), (5, "clean text, version 3.1 of 2024-01-02"), (None, text)])
    got = {r["doc_id"]: r for r in pii.surrogates(rows, KEY, count="n").collect()}
    new = got[1]["text"]
    assert got[None]["text"] == new and got[3]["text"] is None and got[4]["text"] == "" and got[5]["n"] == 0 and got[5]["text"].startswith("clean text, version 3.1")
    for secret in ("John", "Smith", "john.smith", "Müller", "555-7713", "4111 1111", "10.1.2.3", "abe29cfc", "Иванова"):
        assert secret not in new
    own = {k: new[a:b] for a, b, k, _ in pii.entities(new)}
    assert own["given:m:latin"] in pii.GIVEN["m:latin"] and len(own["card"]) == 19 and pii._luhn(own["card"].replace(" ", "")) and own["ip"].startswith("10.")
    assert own["phone"].startswith("+1 (") and own["family:f:cyrillic"].endswith("ова")
    assert own["email"].upper() in got[2]["text"] and "".join(c for c in own["phone"] if c.isdigit()) in got[2]["text"] and own["family:u:latin"] in got[2]["text"]
    assert got[1]["source"] == "s" and pii.surrogates(nothing, KEY, count="n").count() == 0


def test_surrogates_leave_no_part():
    for text, gone in (
        ("Anna Maria Schmidt came; Schmidt left.", ("Anna", "Maria", "Schmidt")),
        ("then John went with John F. Kennedy. Kennedy spoke", ("John", " F.", "Kennedy")),
        ("by John Fitzgerald Kennedy, and Kennedy again", ("John", "Fitzgerald", "Kennedy")),
        ("Mr. Li met Dr. Ng. Later Li and Ng spoke", ("Li", "Ng")),
        ("Dr. J.F. Anders Berg, then Berg", ("J.F", "Anders", "Berg")),
        ("token: eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27u end", ("eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0In0", "dBjftJeZ4CVP", "mB92K27u")),
        ("password = S3cr3t!Pass99 end", ("S3cr3t", "Pass99")),
        ('{"password": "correct horse"} pwd=hunter, end', ("correct", "horse", "hunter")),
    ):
        new, n = pii.replaced(text, KEY, {})
        assert n and not [g for g in gone if g in new], new
    for text in ("the key: remember this", "password: !!!!!!!!", "Li and Ng spoke", "John went home"):
        assert pii.replaced(text, KEY, {}) == (text, 0)


def test_surrogates_stay_distinct(spark):
    names = [f"{n} Person" for n in pii.GIVEN["m:latin"].split()] + [f"Dr. Alex{c} Person" for c in "abcdefghij"]
    rows = docs(spark, [(i, f"Mr. {n.removeprefix('Dr. ')}") for i, n in enumerate(names)])
    for shipped in (1_000_000, 0):
        got = [r["text"] for r in pii.surrogates(rows, KEY, most_shipped=shipped).orderBy("doc_id").collect()]
        assert len(set(got)) == len(names) and not set(got) & {f"Mr. {n}" for n in names}
        if shipped:
            first = got
    assert got == first


def test_one_person_after_any_title(spark):
    texts = ["Mr. Jonas Weber", "Dr. Jonas Weber", "Mr. Jonas Weber said", "Ms. Jonas Weber", "Frau Petra Kern", "Prof. Petra Kern", "Jonas alone stays", "Prof. Rufus Ton"]
    for shipped in (1_000_000, 0):
        got = [r["text"].split() for r in pii.surrogates(docs(spark, list(enumerate(texts))), KEY, most_shipped=shipped).orderBy("doc_id").collect()]
        assert len({tuple(w[1:3]) for w in got[:4]}) == 1 and got[4][1:] == got[5][1:] and got[6] == texts[6].split()
        assert got[0][1] in pii.GIVEN["m:latin"] and got[4][1] in pii.GIVEN["f:latin"] and got[7][1] in pii.GIVEN["u:latin"]


def test_domains_stay_distinct(spark):
    names = [a + b for a in "abcdefghij" for b in "abcdefghijklmnopqrstuvwxyz"] + list("abcdefghijklmnopqrstuvwxyz")
    rows = docs(spark, [(i, f"write to x{i % 3}@{n}.co or info@{n}.co") for i, n in enumerate(names)])
    for shipped in (1_000_000, 0):
        got = [pii.entities(r["text"]) for r in pii.surrogates(rows, KEY, most_shipped=shipped).orderBy("doc_id").collect()]
        domains = [{v.partition("@")[2] for *_, v in own} for own in got]
        assert all(len(d) == 1 for d in domains) and len({x for d in domains for x in d}) == len(names)
        assert not {x for d in domains for x in d} & {f"{n}.co" for n in names}


def test_surrogates_against_a_model(spark):
    """Each value has one surrogate in all documents, no two share one and none is another's real value."""
    rng = random.Random(33)
    people = [(rng.choice(["Mr.", "Ms.", "Dr."]), f"{rng.choice('BCDFG')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}", f"{rng.choice('KLMNP')}{rng.choice('aeiou')}{rng.choice('rst')}{rng.choice('aeiou')}n") for _ in range(60)]
    rows = [(rng.choice([i, 7, None]), "; ".join(rng.choice([f"{t} {g} {f}", f"{g.lower()}@{f.lower()}.org", f"+49 30 {rng.randrange(10**3, 10**4)} 12", f"10.0.0.{rng.randrange(256)}"]) for t, g, f in rng.sample(people, 6))) for i in range(80)]
    table_ = docs(spark, rows).withColumnRenamed("source", "__own").withColumnRenamed("rank", "__row")
    for shipped in (1_000_000, 0):
        got = pii.surrogates(table_, KEY, count="n_chars", most_shipped=shipped)
        assert set(got.columns) == set(table_.columns)
        after = sorted((repr(r["doc_id"]), r["text"]) for r in got.collect())
        stands: dict = {}
        assert len(after) == len(rows)
        keyed = {r["shard"]: r["text"] for r in pii.surrogates(spark.createDataFrame([(str(k), t) for k, (_, t) in enumerate(rows)], "shard string, text string"), KEY, most_shipped=shipped).collect()}
        for k, (_, before) in enumerate(rows):
            for (a, b, kind, value), part in zip(pii.entities(before), _aligned(before, keyed[str(k)])):
                if kind != "initial":
                    assert stands.setdefault((kind.split(":")[0], value), part.lower()) == part.lower()
        for family in {f for f, _ in stands}:
            own = [n for (f, _), n in stands.items() if f == family]
            assert len(set(own)) == len(own) and (family in ("ip",) or not set(own) & {v for f, v in stands if f == family})


def _aligned(before, after):
    """The parts of ``after`` that stand where entities are in ``before``, by the text between them."""
    own, out, at, last = pii.entities(before), [], 0, 0
    for n, (a, b, *_rest) in enumerate(own):
        at += a - last
        last = b
        gap = before[b : own[n + 1][0]] if n + 1 < len(own) else before[b:]
        end = after.index(gap, at + 1) if gap else len(after)
        out.append(after[at:end])
        at = end
    return out


def test_names_take_time_in_proportion():
    import time

    def took(n):
        text = " ".join(f"Mr. A{'bcdefghijk'[i % 10]}{'lmnopqrstu'[i // 10 % 10]}{'aeiouvwxyz'[i // 100 % 10]}{'bcdfg'[i // 1000]} spoke." for i in range(n))
        began = time.process_time()
        assert len(pii.entities(text)) == n
        return time.process_time() - began

    assert took(5000) < 12 * took(1000) + 0.2


# 4


def test_top_k_against_all_scores(spark, awkward, nothing):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([0, 3, 30, 200]), 60)) for i in range(700)] + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1"), (900, None)]
    d = docs(spark, rows).repartition(3)
    queries = [(1, "w1 w2 W3 w1"), (2, "absent"), (3, ""), (4, None), (5, "w10 w11, w12!"), (None, "w1"), (6, "w1"), (6, "w2")]
    q = spark.createDataFrame([(i, t, 1, "r") for i, t in queries], "item_id long, text string, doc_id int, rank string")
    got = topk.exact_top_k(d, q, 7).collect()
    kept = [(i, (t or "").lower().split()) for i, t in rows if i is not None]
    mean = sum(len(w) for _, w in kept) / len(kept)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, set()).update((t or "").lower().replace(",", "").replace("!", "").split())
    want = []
    for i, terms in asked.items():
        df = {t: sum(t in set(w) for _, w in kept) for t in terms}
        scored = []
        for doc, w in kept:
            s = sum(np.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w)
            if s > 0:
                scored.append((-round(float(s), 6), doc))
        want += [(i, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:7])]
    assert sorted(map(tuple, got)) == sorted(want)
    split = topk.exact_top_k(d, q, 7, most_queries=2).collect()
    assert sorted(map(tuple, split)) == sorted(want)
    assert topk.exact_top_k(nothing, q).count() == 0 and topk.exact_top_k(d, q.limit(0)).count() == 0
    want = {(i, 1 + k, d) for i in (1,) for k, d in enumerate(sorted(r["doc_id"] for r in awkward.collect() if r["doc_id"] is not None and {"w1", "w2", "w3"} & set((r["text"] or "").split())))}
    assert {(r["query_id"], r["doc_id"]) for r in topk.exact_top_k(awkward, q, 99).where("query_id = 1").collect()} == {(i, d) for i, _, d in want}


# 5


def test_chat(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é" * rng.randint(1, 50), sentence(rng, rng.randint(1, 3000))])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "lost"), (70, None, "user", "x"), (71, 0, "user", "long " * 500_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    rows += [(80, t, "user", "w" * 900) for t in range(12_000)]  # one conversation of many batches, more than is assembled at a time
    df = df.unionByName(spark.createDataFrame([(*r, "z") for r in rows[-12_000:]], df.schema))
    once = {r["conv_id"]: tuple(r) for r in chat.chat_format(df).collect()}
    monkeypatch.setattr(chat, "MOST", 5_000)
    got = {r["conv_id"]: r for r in chat.chat_format(df).collect()}
    assert once == {i: tuple(r) for i, r in got.items()}
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:])
    for c, own in itertools.groupby(sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], key(r))), key=lambda r: r[0]):
        own = list(own)
        text = "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for _, _, r, t in own)
        r = got.pop(c)
        raw = text.encode()
        assert r["text"] == text and r["n_turns"] == len(own) and r["n_bytes"] == len(raw)
        assert [raw[a:b].decode() for a, b in zip(r["starts"], r["ends"])] == [t or "" for _, _, role, t in own if role == "assistant"]
    assert not got and chat.chat_format(df.limit(0)).count() == 0


# 6


def test_sharding(spark, awkward, nothing):
    names = [f"s{i}" for i in range(10)]
    a = sharding.lookup_table(names, 2003)
    assert max(np.bincount(a)) - min(np.bincount(a)) <= 1
    b = sharding.lookup_table(names[:9], 2003)
    moved = sum(x != y for x, y in zip(a, b) if x != 9)
    assert moved < 0.1 * 2003
    got = sharding.place(awkward, names, 2003).collect()
    assert len(got) == awkward.count() and all((r["shard"] is None) == (r["doc_id"] is None) for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 6}) == 1 and sharding.place(nothing, names, 2003).count() == 0
    for bad, slots in ((names, 2000), (["a\nb", "c"], 2003), (["a", "a"], 2003)):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, slots)


# 7


def gram_set(text, n=2):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def test_ngram_join_against_all_pairs(spark, awkward, nothing, monkeypatch):
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = sentence(rng, rng.randint(2, 120)).split()
        for _ in range(rng.randint(1, 8)):
            own = [f"x{rng.randrange(99)}" if rng.random() < rng.choice([0, 0.02, 0.1, 0.2]) else w for w in base]
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (3, rows[3][1])]
    d = docs(spark, rows).repartition(3)
    sets = {i: gram_set(t) for i, t in rows if i is not None and gram_set(t)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 - 1e-9}
    kept = {r["doc_id"] for r in ngram_join.one_of_each_group(d).collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = {i: [a + b - i for a, b in want if i in (a, b)] for i in sets}
    rows = sorted((i, find(i), len(own), sum(sets[x] == sets[i] for x in own)) for i, own in links.items() if own)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(d).collect())) == rows
    monkeypatch.setattr(ngram_join, "LIST", 3)
    monkeypatch.setattr(ngram_join, "PLACE", 5)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(d.coalesce(1)).collect())) == rows
    assert kept == {i for i in sets if find(i) == i} | {500, 501, None}
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(awkward).collect())) == [(i, 4, 2, 2) for i in (4, 5, 6)] and ngram_join.one_of_each_group(nothing).count() == 0
    renamed = awkward.withColumnRenamed("doc_id", "key").withColumnRenamed("text", "body").withColumnRenamed("ids", "doc_id").withColumnRenamed("bucket", "root")
    assert ngram_join.ngram_jaccard_join(renamed, text="body", doc_id="key").count() == 3 and ngram_join.one_of_each_group(renamed, text="body", doc_id="key").count() == awkward.count() - 3
    assert ngram_join.ngram_jaccard_join(nothing).count() == 0


def test_one_of_each_group_counts_rows(spark, awkward):
    rng = random.Random(77)
    a, b, c, e = (sentence(rng, 40) for _ in range(4))
    near = b.rsplit(" ", 1)[0]
    rows = [(1, a), (1, a), (1, b), (2, c), (2, c), (3, near), (4, a), (5, e), (7, e), (7, c), (7, None), (7, None), (8, ""), (8, ""), (None, a), (None, a)]
    want = [(1, a), (1, b), (2, c), (5, e), (7, None), (8, ""), (None, a), (None, a)]
    d = docs(spark, rows).repartition(3)
    got = ngram_join.one_of_each_group(d)
    assert got.columns == d.columns and sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in got.collect())
    assert ngram_join.one_of_each_group(awkward).count() == awkward.count() - 3


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for size in (230, 190, 20):
        base = sentence(rng, 60, 2000).split()
        rows += [(len(rows) + k, " ".join(f"y{rng.randrange(999)}" if k and rng.random() < 0.06 else w for w in base)) for k in range(size)]
    rows += [(len(rows) + k, sentence(rng, 50, 2000)) for k in range(100)] + [(5000, rows[3][1]), (5001, rows[3][1])]
    sets = {i: gram_set(t) for i, t in rows}
    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common >= (0.6 - 1e-9) * (len(sets[a]) + len(sets[b]) - common):
            links[a], links[b] = links[a] + 1, links[b] + 1
    made, own = {}, ngram_join.stored

    def stored(df, name):
        out = own(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    d = docs(spark, rows).repartition(3)
    want = {i: k for i, k in links.items() if k}
    for name, least in (("CROWD", 40), ("RUN", 5), ("BLOCK", 50), ("GRAMS", 3000), ("LIST", 30), ("HELD", 500)):
        monkeypatch.setattr(ngram_join, name, least, raising=False)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_jaccard_join(d).collect()} == want
    assert made["candidates"] < sum(want.values()) // 20


def test_one_of_each_large_group(spark, monkeypatch):
    rng = random.Random(9)
    base = sentence(rng, 60, 2000).split()
    rows = [(k, " ".join(f"y{rng.randrange(999)}" if k and rng.random() < 0.03 else w for w in base)) for k in range(150)] + [(900, sentence(rng, 50, 2000)), (None, "a b")]
    made, own = {}, ngram_join.stored

    def stored(df, name):
        out = own(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    for name, least in (("CROWD", 40), ("BLOCK", 60)):
        monkeypatch.setattr(ngram_join, name, least, raising=False)
    assert {r["doc_id"] for r in ngram_join.one_of_each_group(docs(spark, rows).repartition(3)).collect()} == {0, 900, None}
    assert made["candidates"] < 150 * 149 // 20


def test_pairs_of_a_place_are_passed_on_in_parts():
    rng = np.random.default_rng(3)
    docs = np.zeros(300, ngram_join._CLASS_INFO)
    docs["id"], docs["size"], docs["ell"] = np.arange(300), 100, 1
    lists = [np.sort(rng.choice(300, 200, replace=False)) for _ in range(6)]
    row = {"place": 0, "docs": docs.tobytes(), "many": ngram_join.pack(np.array([200] * 6)), "parted": ngram_join.pack(np.zeros(6, np.int64)), "doc": ngram_join.pack(np.concatenate(lists))}
    want = Counter(p for x in lists for p in itertools.combinations(x.tolist(), 2))
    got, parts = Counter(), 0
    for out in ngram_join.shared_pairs(pa.Table.from_pylist([row], ngram_join._LISTS), 0.6, 4, 1000):
        parts += 1
        for r in out.to_pylist():
            ids = np.frombuffer(r["docs"], ngram_join._PAIRED)["id"]
            for a, b, n in zip(*(ngram_join.unpacked(r[c]).tolist() for c in ("a", "b", "n"))):
                got[int(ids[a]), int(ids[b])] += n
    assert got == want and parts > 1


def test_a_place_works_in_bounded_memory():
    """A place, a part and a bucket as large as some gigabytes of input make them."""
    rng = np.random.default_rng(4)
    info = np.zeros(200_000, ngram_join._CLASS_INFO)
    info["id"], info["size"], info["ell"] = rng.permutation(200_000), rng.integers(90, 140, 200_000), 2
    many = rng.integers(2, 6, 350_000)
    lists = [np.sort(x) for x in np.split(rng.integers(0, 200_000, many.sum()), np.cumsum(many)[:-1])]
    by_size = np.concatenate([x[np.argsort(info["size"][x], kind="stable")] for x in lists])
    place = pa.Table.from_pylist([{"place": 0, "docs": info.tobytes(), "many": ngram_join.pack(many), "parted": ngram_join.pack(np.zeros(len(many), np.int64)), "doc": ngram_join.pack(by_size)}], ngram_join._LISTS)
    rows = []
    for _ in range(40):
        docs = np.zeros(30_000, ngram_join._PAIRED)
        docs["id"], docs["ell"], docs["root"] = np.sort(rng.choice(200_000, 30_000, replace=False)), 1, rng.integers(0, 200_000, 30_000)
        a, b = np.sort(rng.integers(0, 30_000, (2, 40_000)), axis=0)
        rows.append({"part": 0, "docs": docs.tobytes(), "a": ngram_join.pack(a), "b": ngram_join.pack(b), "n": ngram_join.pack(rng.integers(1, 3, 40_000))})
    part = pa.Table.from_pylist(rows, ngram_join._PAIRS)

    def peak(run):
        tracemalloc.start()
        try:
            out = run()
            return out, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    pairs, at_place = peak(lambda: sum(len(r["a"]) for out in ngram_join.shared_pairs(place, 0.6, 400, ngram_join.HELD) for r in out.select(["a"]).to_pylist()))
    got, at_part = peak(lambda: ngram_join.candidates_of(part))
    assert pairs and max(at_place, at_part) < 100, (at_place, at_part)
    pieces, whole = (sorted(zip(*(x.column(c).to_pylist() for c in x.column_names))) for x in (got, ngram_join.candidates_of(part, 1 << 40)))
    assert pieces == whole and len(whole) > 1_000_000

    info = np.zeros(5_000, ngram_join._INFO)
    info["id"], info["sig"], info["size"] = np.arange(5_000), rng.integers(0, 4_000, 5_000), 100
    doc, tok = rng.integers(0, 5_000, 20_000), rng.integers(0, 3_000, 20_000).astype(np.uint32)
    bucket = pa.table({"docs": [info.tobytes()], "doc": [ngram_join.pack(doc)], "tok": [tok.tobytes()]})
    meetings = [[(int(x["id"]), int(x["sig"]), int(y)) for i, d, z in ngram_join.bucket_pieces(bucket, most) for x, y in zip(i[d], z)] for most in (1_000, 1 << 40)]
    assert sorted(meetings[0]) == sorted(meetings[1]) and len(meetings[0]) == 20_000


def test_shared_counts():
    rng = np.random.default_rng(5)
    for many in (40, 400, 4000):
        left, right = ([np.unique(rng.integers(0, many, rng.integers(1, 120)).astype(np.uint64)) for _ in range(n)] for n in (70, 90))
        want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
        assert (ngram_join.shared_counts(left, right) == np.array(want)).all()


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 12, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)) for _ in range(60)]
    at = np.cumsum([0, *map(len, sets)])
    own = ngram_join.bitmaps(np.concatenate(sets), at)
    a, b = np.array(list(itertools.combinations(range(60), 2))).T
    assert (ngram_join.bound(own, a, b) >= ngram_join.jaccard(sets, a, b) - 1e-12).all()


# 8


def test_language(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents")
    dictionaries = langid.language_dictionaries(d.where("doc_id % 4 = 0"), most_docs=40)
    got = langid.detect_language(d.where("doc_id % 4 <> 0"), dictionaries).collect()  # none that the dictionaries are made of
    rated = [r for r in got if r["lang_accepted"]]
    assert len(got) == 750 and len(rated) / len(got) > 0.95 and sum(r["lang_found"] == r["lang"] for r in rated) / len(rated) > 0.97
    odd = {r["doc_id"]: r for r in langid.detect_language(awkward.withColumnRenamed("source", "lang_found"), dictionaries).collect()}
    assert all(odd[i]["lang_found"] is None and not odd[i]["lang_accepted"] for i in (1, 2, 3)) and len(odd) == 10 + 1
    assert langid.without_unsure(awkward, dictionaries).columns == awkward.columns
    assert langid.detect_language(nothing, dictionaries).count() == 0 and not langid.detect_language(awkward, {}).where("lang_accepted").count()
    with pytest.raises(ValueError):
        langid.without_unsure(awkward, {})
    assert langid.without_unsure(nothing, {}).count() == 0
    again = langid.language_dictionaries(d.where("doc_id % 4 = 0").unionByName(d.where("doc_id % 4 = 0")).repartition(5), most_docs=40)
    assert again == dictionaries and len(dictionaries) == 4


def test_language_against_plain_compression(spark):
    """Every document's choice, margin and acceptance from one-shot compressions by another route."""
    import zstandard

    d = table(spark, SF, "documents")
    dictionaries = langid.language_dictionaries(d)
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, window_log=18, hash_log=15, chain_log=15, search_log=langid.SEARCH, min_match=langid.MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in langid.detect_language(d, dictionaries).collect():
        raw = (r["text"] or "").strip().lower().encode()
        if len(raw) < 4 * langid.SHORT:
            continue
        sizes = []
        for name, content in dictionaries.items():
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content.decode(errors="ignore").lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes.append((sum(len(c.compress(raw[i : i + langid.PIECE])) for i in range(0, len(raw), langid.PIECE)), name))
        sizes.sort()
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert (r["lang_found"], r["lang_margin"], r["lang_accepted"]) == (sizes[0][1], round(margin, 6), margin >= 0.01)


def test_language_of_short_documents(spark):
    sf = "/root/testdata/sf0.1"
    d = table(spark, sf, "documents")
    clean = d.where("doc_id % 2 = 1").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id").where("size(split(trim(text), '[ \\n]+')) < 10")
    got = langid.detect_language(clean, langid.language_dictionaries(d.where("doc_id % 2 = 0"))).collect()
    rate = {}
    for r in got:
        rate.setdefault(len(r["text"].split()) < 5, []).append((r["lang_accepted"], r["lang_found"] == r["lang"]))
    assert all(len(own) >= 10 for own in rate.values())
    assert sum(a for a, _ in rate[True]) / len(rate[True]) > 0.7 and sum(a for a, _ in rate[False]) / len(rate[False]) > 0.95
    ok = [right for own in rate.values() for a, right in own if a]
    assert sum(ok) / len(ok) > 0.9


# 9


def test_decontamination(spark, awkward, nothing):
    item = "A farmer has 12 sheep and sells 5 sheep to Maria for 30 dollars each at the old market before the winter begins"
    rng = random.Random(9)
    fill = [sentence(rng, 30) for _ in range(8)]
    rows = [
        (1, f"{fill[0]}. {item}. {fill[1]}"),
        (2, f"{fill[2]}. {item.replace('12', '45').replace('5 sheep', '9 sheep').replace('Maria', 'Sofia').replace('30 dollars', '70 euros')}. {fill[3]}"),
        (3, fill[4]),
        (4, None),
        (5, ""),
        (None, item),
        (6, "A farmer has 12 sheep"),
    ]
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (3, None, "x"), (4, "", "x"), (None, item, "x"), (5, "too few", "x")], "item_id long, text string, doc_id string")
    d = docs(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.template_matches(d, bench).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[1, 1]["changed"] == 0 and got[2, 1]["changed"] > 0 and got[1, 1]["share"] > 0.8
    assert {k: (r["windows"], r["changed"]) for k, r in got.items()} == {(r["doc_id"], r["item_id"]): (r["windows"], r["changed"]) for r in decontam.template_matches(d, bench, most_known=0).collect()}
    left = decontam.without_benchmark(d, bench)
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6, None} and left.columns == d.columns
    assert decontam.template_matches(awkward, bench).count() == 0 and decontam.template_matches(nothing, bench).count() == 0 and decontam.template_matches(d, bench.limit(0)).count() == 0


def test_a_leak_with_one_of_two_equal_values_edited(spark):
    item = "the farmer sold exactly 12 sheep at the old market before the long winter and then after the spring she bought back 12 sheep from the same buyer"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.template_matches(docs(spark, [(1, f"so {item}"), (2, f"so {item[::-1].replace('21', '54', 1)[::-1]}")]), bench).collect()
    assert {r["doc_id"]: r["changed"] for r in got} == {1: 0, 2: 0}


def plain_tokens(text, within=False):
    """Typed tokens once more: (kind, value), kinds plain, number, name or unit."""
    units = {w: k for k, ws in decontam.UNITS.items() for w in ws.split()}
    numerals, given = set(decontam.NUMERALS.split()), {w.lower() for w in decontam.GIVEN.split()}
    out, ends = [], []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|(?:[^\W\d_]|[^\x00-\x7f])+", text):
        w, before = m[0], text[: m.start()].rstrip()
        opens = (not within and not before) or before[-1:] in set(".!?:;") and before != "" or "\n" in text[len(before) : m.start()]
        low = w.lower()
        if w[0].isdigit() or low in numerals:
            out.append(("number", low))
        elif out and out[-1][0] == "number" and low in units and not w[0].isupper():
            out.append(("unit:" + units[low], low))
        elif w[0].isupper() and len(w) > 1 and not w[1].isupper() and (not opens or low in given):
            if out and out[-1][0] == "name" and text[ends[-1] : m.start()] == " ":
                out[-1] = ("name", out[-1][1] + " " + low)
                ends[-1] = m.end()
                continue
            out.append(("name", low))
        else:
            out.append(("plain", low))
        ends.append(m.end())
    return out


def test_decontamination_against_a_plain_matcher(spark):
    """Every (document, item) for which a window of the item, as a template or, where it is poor in words, as it stands, is found, and no other."""
    rng = random.Random(99)
    vocabulary = [f"{a}{b}" for a in ("gran", "mel", "tor", "vis", "kel") for b in ("do", "ta", "rim", "sun", "po", "lek")]

    def text(n):
        kinds = [lambda: rng.choice(vocabulary), lambda: str(rng.randrange(90)), lambda: rng.choice(["Bodo", "Karla", "Tine"]), lambda: f"{rng.randrange(9)} km"]
        return " ".join(rng.choices(kinds, [8, 2, 1, 1])[0]() for _ in range(n))

    items = [(k, text(rng.choice([4, 7, 12, 18]))) for k in range(12)] + [(20, " ".join(str(k) for k in range(12)))]
    rows = []
    for i in range(60):
        own = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            own = [rng.choice([w, str(rng.randrange(90))]) if w.isdigit() else w for w in own]
        rows.append((i, f"{text(8)} {' '.join(own)} {text(8)}" if rng.random() < 0.8 else text(25)))
    want = set()
    for k, item in items:
        for reading in (False, True):
            tokens = plain_tokens(item, reading)
            size = min(10, len(tokens))
            for at in range(len(tokens) - size + 1) if size >= 6 else ():
                if reading and at:
                    continue
                own = tokens[at : at + size]
                poor = sum(t == "plain" for t, _ in own) < 6
                for i, t in rows:
                    there = plain_tokens(t)
                    for x in range(len(there) - size + 1):
                        seen = there[x : x + size]
                        same = all(a == b if poor or a[0] == "plain" else a[0] == b[0] for a, b in zip(own, seen))
                        values = {(a[1], b[1]) for a, b in zip(own, seen) if a[0] != "plain"}
                        if same and len({a for a, _ in values}) == len(values):
                            want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.template_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_leaks_poor_in_words_and_first_words(spark):
    items = [(1, "12 + 30 = 42 and 7 x 6 = 42 so 42"), (2, "What is the capital city of northern France today"), (3, "yes 1 no 2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs(spark, [(1, f"as we know {items[0][1]} which ends it"), (2, "as we know 13 + 30 = 43 and 7 x 6 = 42 so 42 again"), (3, f"see ({items[1][1]})"), (4, f'he said "{items[1][1]}"'), (5, "What is the capital city of southern France today"), (6, items[2][1])])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.template_matches(rows, bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 2)}
    renamed = rows.withColumnRenamed("doc_id", "key").withColumnRenamed("ids", "doc_id")
    assert {r["key"] for r in decontam.without_benchmark(renamed, bench, doc_id="key").collect()} == {2, 5, 6}


def test_leaks_of_the_driver_tables(spark):
    sf = "/root/testdata/sf0.01"
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    texts, items = d.select("doc_id", "text").collect(), b.collect()
    want = {(x["doc_id"], i["item_id"]) for x in texts for i in items if i["text"] in x["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.template_matches(d, b).collect()}
    assert want <= got and len(got) <= len(want) + 3


# 10


def test_repeated_windows_against_brute_force(spark, awkward, nothing):
    rng = random.Random(10)
    shared = [sentence(rng, rng.randint(10, 40)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([*shared, sentence(rng, 15)]) for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(3, shared[0]), (None, shared[0]), (99, None)]
    d = docs(spark, rows).repartition(3)
    for length, gram, digits in ((12, 4, 3), (9, 9, 1), (10, 1, 4)):
        held = {}
        for i, t in rows:
            w = (t or "").split()
            for p in range(len(w) - length + 1) if i is not None else ():
                held.setdefault(tuple(w[p : p + length]), []).append((i, p))
        want = sorted((i, p, len(own), (i, p) == min(own)) for own in held.values() if len(own) > 1 for i, p in own)
        for most in (2_000_000, 3):  # the second sends frequent digits the other way
            got = sorted((r["doc_id"], r["pos"], r["copies"], r["first"]) for r in suffix_dedup.repeated_windows(d, length, gram, digits, most_equal=most).collect())
            assert got == want
    spans = suffix_dedup.suffix_dedup(awkward, 30).collect()
    assert {r["doc_id"] for r in spans} == {4, 5, 6} and suffix_dedup.suffix_dedup(nothing, 30).count() == 0


# pipeline and contract


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rows = table(spark, SF, "documents").unionByName(table(spark, SF, "documents").limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "s", 0)], table(spark, SF, "documents").schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = table(spark, str(tmp_path), "documents")
    seen = {r["doc_id"] for r in d.collect()}
    for name, stage in cp.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == rows.columns, name
        now = {r["doc_id"] for r in d.collect()}
        assert now <= seen and len(now) > 0.5 * len(seen)
        seen = now
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == seen and all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert {(r["doc_id"], r["decoded"]) for r in got} == {(r["doc_id"], r["text"]) for r in d.collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages by plain means on a fixture whose languages, copies, leaks and personal data are known."""
    import corpus_pipeline as cp
    import public_tokenizers
    import tiktoken

    rng = random.Random(55)
    voices = {"en": "the quick brown fox jumps over lazy dogs while seven wise owls watch from their old barn every night under bright stars".split(), "de": "der schnelle braune fuchs springt über faule hunde während sieben weise eulen jede nacht unter hellen sternen zuschauen".split()}
    voice = lambda lang, n: " ".join(rng.choice(voices[lang]) for _ in range(n))
    item = " ".join(f"quiz{k}" for k in range(14))
    rows = [(i, voice(("en", "de")[i % 2], 80), ("en", "de")[i % 2]) for i in range(40)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " zuschauen", "de"), (102, rows[1][1], "de"), (103, None, "en"), (104, "", "de"), (105, "   ", None), (None, rows[2][1], "en"), (7, rows[7][1], "de")]
    rows += [(110, f"{voice('en', 40)} {item} {voice('en', 40)}", "en"), (111, f"{voice('de', 60)} schreibt an karl.otto@sterne.de heute", "de")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, root long, bucket string"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), 5, "b") for i, t, g in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_ = table(spark, str(tmp_path), "documents")
    judged = {(r["doc_id"], r["text"]): r["lang_accepted"] for r in langid.detect_language(docs_, langid.language_dictionaries(docs_)).collect()}
    kept = [(i, t) for i, t, _ in rows if judged[i, t]]
    assert len(kept) == len(rows) - 3
    once = list(dict.fromkeys(x for x in kept if x[0] is not None))
    sets = [gram_set(t) for _, t in once]
    near = [{j for j in range(len(once)) if len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= 0.6} for k in range(len(once))]
    left = []
    for k, (i, t) in enumerate(once):
        group, new = {k}, {k}
        while new:
            new = set().union(*(near[x] for x in new)) - group
            group |= new
        if (i, k) == min((once[x][0], x) for x in group):
            left.append((i, t))
    left = [(i, t) for i, t in left + [x for x in kept if x[0] is None] if item not in t]
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in left) and {100, 101, 102, 110}.isdisjoint(r["doc_id"] for r in got)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.ranks(RANKS))}, special_tokens={})
    texts = dict(left)
    for r in got:
        assert r["ids"] == enc.encode_ordinary(r["decoded"]) and r["n_tokens"] == len(r["ids"])
        if r["doc_id"] == 111:
            assert "karl.otto" not in r["decoded"] and "sterne.de" not in r["decoded"] and r["decoded"].split()[:60] == texts[111].split()[:60]
        elif r["doc_id"] is not None:
            assert r["decoded"] == texts[r["doc_id"]]


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "a")).count() == 0
    spark.createDataFrame([(1, "a text without a label", None, "s", 5)], schema).write.parquet(str(tmp_path / "b/documents.parquet"))
    with pytest.raises(ValueError):
        cp.run(spark, str(tmp_path / "b"))


def test_sql_of_the_queries(spark):
    import duckdb

    from ferrule.llm.queries import QUERIES, SQL

    own = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        a, b = QUERIES[name](spark, SF).toPandas(), own.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert sorted(map(repr, a[cols].astype(object).values.tolist())) == sorted(map(repr, b[cols].astype(object).values.tolist())), name
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_counters_add_up_as_a_tree(spark, monkeypatch):
    from ferrule.llm import _shared

    monkeypatch.setattr(_shared, "FAN", 3)
    rng = np.random.default_rng(8)
    own = [rng.integers(0, 1 << k, 1 << 17) * (rng.random(1 << 17) < 0.01) for k in (3, 9, 20, 33, 2, 5, 7, 8, 12, 1, 6)]
    rows = [(i, s, _shared.pack(x[s << 16 : (s + 1) << 16])) for i, x in enumerate(own) for s in range(2)]
    got = _shared.counted(spark.createDataFrame(rows, "task int, slice int, body binary"), 17)
    assert (got == sum(own)).all() and not _shared.counted(spark.createDataFrame([], "task int, slice int, body binary"), 4).any()


def test_kernels():
    from ferrule.llm._shared import buffers, grams, words

    d, o = buffers(pa.array(["a b a", None, "", "Ab ab"]))
    h, row = words(d, o)
    assert row.tolist() == [0, 3, 3, 3, 5] and h[0] == h[2] and h[3] == h[4]
    g, doc = grams(h, row, 2)
    assert doc.tolist() == [0, 0, 3]
