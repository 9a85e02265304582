"""Benchmark decontamination by template canonicalisation.

Texts become sequences of typed tokens: numbers, names and units of measure turn into placeholders, all else is lower-cased.
Windows of ``window`` tokens of a benchmark item are hash-joined with those of the documents. Where they match, the values
behind the placeholders are set side by side: along one alignment of item and document every value of the item must stand for
one value of the document, so a re-parameterised question is caught and a chance meeting of templates is not. Where windows of
an alignment contradict each other, those whose values are all equal count, or where there are none, one that is sound in itself.

A window of fewer than ``least_words`` plain words says too little as a template; it is looked for with all its values as they are.
The first word of an item, which is capitalised wherever it stands, is read as a plain word and as a name.

Defined results: an item of fewer than ``window`` tokens is looked for as a whole, one of fewer than ``least_words`` tokens not
at all: it is no evidence; null or empty texts, null ids and empty tables give no rows;
equal items are reported each; repeated rows of one document id are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import U, WORD, bounded, buffers, chunks, mix, released, span_hash, stored

WORD_, NUMBER, NAME, UNIT = range(4)
UNITS = {
    "length": "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres",
    "mass": "mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes",
    "time": "ms second seconds sec minute minutes min hour hours day days week weeks month months year years",
    "volume": "ml cl l liter liters litre litres gallon gallons pint pints cup cups",
    "money": "dollar dollars cent cents euro euros usd eur gbp",
    "speed": "mph kmh kph",
    "data": "bit bits byte bytes kb mb gb tb",
    "heat": "celsius fahrenheit kelvin degree degrees",
}
NUMERALS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
GIVEN = "Alice Bob Carol David Emma Frank George Henry Isabella Jack James Jane John Julia Karen Laura Liam Lucas Maria Mark Mary Michael Natalia Noah Olivia Oliver Paul Peter Rachel Robert Samuel Sarah Sofia Susan Thomas William"


def _hashes(words: str) -> np.ndarray:
    own = [w.lower().encode() for w in words.split()]
    data = np.frombuffer(b"".join(own), np.uint8)
    end = np.cumsum([len(w) for w in own])
    return np.sort(span_hash(data, np.concatenate(([0], end[:-1])), end))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


_KIND = np.zeros(256, np.uint8)
_KIND[WORD > 0] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_LISTS: dict[str, np.ndarray] = {}


def canonical(d: np.ndarray, o: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Typed tokens of a run of texts: hash, kind, first and last byte, first token of each row, and hash of the value itself.
    With ``within``, a text's first word is read as if others stood before it."""
    if not _LISTS:
        _LISTS.update({"numeral": _hashes(NUMERALS), "given": _hashes(GIVEN)} | {u: _hashes(w) for u, w in UNITS.items()})
    n = len(d)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(np.uint8), z, z, np.zeros(len(o), np.int64), z.astype(U)
    kind = _KIND[d]
    inner = np.flatnonzero((d == 46) | (d == 44))  # a point or comma between two digits belongs to the number
    inner = inner[(inner > 0) & (inner < n - 1)]
    kind[inner[(kind[inner - 1] == 2) & (kind[inner + 1] == 2)]] = 2
    low = WORD[d]
    latin = np.flatnonzero(d[1:] <= 0x9E) + 1 if n > 1 else np.zeros(0, np.int64)
    latin = latin[(d[latin - 1] == 0xC3) & (d[latin] >= 0x80) & (d[latin] != 0x97)]
    low[latin] += 0x20
    capital = _UPPER[d]
    capital[latin - 1] = True

    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[o] = True
    cut = np.flatnonzero(edge)
    s, e = cut[:-1], cut[1:]
    on = kind[s] > 0
    s, e = s[on], e[on]
    row = np.searchsorted(s, o)
    number = kind[s] == 2
    h = span_hash(low, s, e)
    numeral = _among(h, _LISTS["numeral"])

    solid = np.where(_SPACE[d], -1, np.arange(n))
    before = np.concatenate(([-1], np.maximum.accumulate(solid)[:-1]))[s]  # last byte that isn't white space before a token
    first = np.repeat(o[:-1], np.diff(row))
    lines = np.concatenate(([0], np.cumsum(d == 10)))
    opens = _STOP[d[np.maximum(before, 0)]] | (lines[s] > lines[np.maximum(before, 0)])
    opens = np.where(before < first, not within, opens)
    after = np.minimum(s + np.where(d[s] >= 0xC0, 2, 1), n - 1)
    mixed = capital[s] & (after < e) & ~capital[after]
    out = np.zeros(len(s), np.uint8)
    out[number | numeral] = NUMBER
    out[(out == 0) & mixed & (~opens | _among(h, _LISTS["given"]))] = NAME
    after_number = np.zeros(len(s), bool)
    after_number[1:] = out[:-1] == NUMBER
    after_number[row[:-1][row[:-1] < len(s)]] = False
    code = np.array([0, 0x1111, 0x2222, 0x3333], U)[out]
    at = np.flatnonzero(after_number & (out != NUMBER))
    for k, u in enumerate(UNITS):
        hit = at[_among(h[at], _LISTS[u])]
        out[hit] = UNIT
        code[hit] = U(0x3333 + k)
    h = np.where(out > 0, mix(code), h)
    # names of several words are one name
    follow = np.zeros(len(s), bool)
    follow[1:] = (out[1:] == NAME) & (out[:-1] == NAME) & (s[1:] - e[:-1] == 1) & (d[e[:-1]] == 32)
    follow[row[:-1][row[:-1] < len(s)]] = False
    keep = np.flatnonzero(~follow)
    e = e[np.concatenate((keep[1:], [len(s)])) - 1] if len(s) else e
    return h[keep], out[keep], s[keep], e, np.searchsorted(keep, row), span_hash(low, s[keep], e)


_VERBATIM = U(0x5851F42D4C957F2D)


def _windows(texts: pa.Array, sizes: list[int], least: int, known: dict[int, np.ndarray] | None, whole: int = 0, within: bool = False) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(row, first token, tokens, hash, values of the placeholders) of windows; with ``known`` only those whose hash is in
    it; with ``whole``, a row of fewer tokens than that is a window by itself and the sizes don't hold for it; with
    ``within``, only the windows that begin a row, as they read with other words before them."""
    data, offsets = buffers(texts)
    for i, _, d, o in chunks(data, offsets):
        h, kind, s, e, row, exact = canonical(d, o, within)
        plain = np.concatenate(([0], np.cumsum(kind == WORD_)))
        count = np.diff(row)
        for size in [0] if whole else sizes:
            length = np.minimum(count, whole) if whole else np.full(len(count), size)
            many = np.where(length >= least, np.maximum(count - length + 1, 0), 0)
            if within:
                many = np.minimum(many, 1)
            doc = np.repeat(np.arange(len(count)), many)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + row[doc]
            end = start + length[doc]
            key = np.where(plain[end] - plain[start] >= least, span_hash(h, start, end), span_hash(exact, start, end) ^ _VERBATIM)
            if known is not None:
                hit = _among(key, known[size])
                doc, start, end, key = doc[hit], start[hit], end[hit], key[hit]
            for r, a, b, k in zip(doc.tolist(), start.tolist(), end.tolist(), key.view(np.int64).tolist()):
                slots = [bytes(d[s[x] : e[x]]).decode("utf-8", "replace").lower() for x in range(a, b) if kind[x]]
                yield i + r, a - int(row[r]), b - a, k, slots


def template_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", least_words: int = 6, most_known: int = 4_000_000) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs: windows (of the item that were found), share (of the item's windows), slots
    (placeholder values compared), changed (of those, how many differ: a re-parameterised copy if any does).

    The benchmark's hashes go to the executors as a filter only while there are at most ``most_known`` of them; beyond that
    all windows of the documents go into the join."""
    spark = docs.sparkSession
    columns = "at int, size int, key long, slots array<string>"

    def rows(texts: pa.Array, ids: pa.Array, found: Iterator[tuple], name: str) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        held: list[tuple] = []
        for r, *rest in found:
            held.append((ids[r].as_py(), *rest))
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [name, "at", "size", "key", "slots"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [name, "at", "size", "key", "slots"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for within in (False, True):
                yield from rows(b.column("text"), b.column("item_id"), _windows(b.column("text"), [], least_words, None, window, within), "item_id")

    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    items = stored(items.mapInArrow(of_items, f"item_id long, {columns}").dropDuplicates(["item_id", "at", "size", "key"]), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` of them
    n_known = items.count()
    known = None
    if n_known <= most_known:
        got = items.select("size", "key").distinct().toArrow()
        size, key = got.column("size").to_numpy(), got.column("key").to_numpy()
        known = spark.sparkContext.broadcast({s: np.sort(key[size == s].view(U)) for s in sizes})

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from rows(b.column("text"), b.column("doc_id"), _windows(b.column("text"), sizes, least_words, known.value if known else None), "doc_id")

    base = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    own = base.mapInArrow(released(of_docs), f"doc_id long, {columns}")
    right = items.select("item_id", F.col("at").alias("item_at"), "size", "key", F.col("slots").alias("item_slots"))
    met = own.join(right, ["size", "key"]).withColumn("shift", F.col("at") - F.col("item_at"))
    pair = F.transform(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d")))
    # windows that contradict themselves go; of an alignment whose windows contradict each other those with all values equal stay
    sound = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda p: p["b"])))
    changed = lambda c: F.filter(c, lambda p: p["b"] != p["d"])
    met = met.withColumn("pairs", F.array_distinct(pair)).where(sound("pairs")).withColumn("same", F.size(changed("pairs")) == 0)
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    lined = met.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("item_at").alias("all_ats"), merged("pairs").alias("all_pairs"), F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("same_ats"), merged(F.when(F.col("same"), F.col("pairs"))).alias("same_pairs"), F.max_by("pairs", F.struct(F.size("pairs"), "item_at")).alias("one_pairs"), F.max_by("item_at", F.struct(F.size("pairs"), "item_at")).alias("one_at")
    )
    whole, copied = sound("all_pairs"), F.size("same_ats") > 0
    lined = lined.select(
        "doc_id", "item_id",
        F.when(whole, F.col("all_ats")).when(copied, F.col("same_ats")).otherwise(F.array("one_at")).alias("ats"),
        F.when(whole, F.col("all_pairs")).when(copied, F.col("same_pairs")).otherwise(F.col("one_pairs")).alias("pairs"),
    )
    total = items.groupBy("item_id").agg(F.countDistinct("at").alias("of"))
    best = lined.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("windows"),
        F.max_by(F.size("pairs"), F.struct(F.size("ats"), F.size("pairs"))).cast("long").alias("slots"),
        F.max_by(F.size(F.filter("pairs", lambda p: p["b"] != p["d"])), F.struct(F.size("ats"), F.size("pairs"))).cast("long").alias("changed"),
    )
    return best.join(total, "item_id").select("doc_id", "item_id", "windows", F.round(F.col("windows") / F.col("of"), 6).alias("share"), "slots", "changed")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that hold part of a benchmark item; rows with a null id stay."""
    gone = stored(template_matches(docs, benchmark, doc_id=doc_id, **how).select(F.col("doc_id").alias("__gone")).distinct(), "leaks")
    return docs.join(gone, docs[doc_id].cast("long") == gone["__gone"], "left_anti")
