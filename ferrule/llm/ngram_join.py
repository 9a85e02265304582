"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is the set of its word n-grams. Grams are ordered rarest first by a corpus-wide count sketch. Two sets whose
Jaccard similarity is at least t must share l grams among the first |x| - ceil(t|x|) + l of each, for every l; each document
picks the l whose posting and verification cost, estimated from the sketch, is least. A pair is a candidate when it shares
min(l_a, l_b) prefix grams, and every candidate is verified on the whole sets, so the result is exact.

Documents with equal sets are one class and meet others once. Postings meet by gram; what they leave are the lists of the
classes that share a gram, which move on to a place named by the smallest of them. The grams of a group of near copies have
nearly the same lists, so its pairs are counted at a few places and not once for each gram. Verification sends sets to
places too, and leaves for each document how many it is linked to and one of its group: pairs themselves are never a result.

The pairs of a large group grow with its square, so they are no rows at all: a crowd is what shares long lists with one
smallest id, if those lists hold as many pairs as there are in it. All its pairs are compared set by set, a block of members
against another at a time, and pass by the lists.

Defined results: a null or empty text has no grams and is similar to nothing; a text of 1 to n-1 words has one gram, all of
it; documents with equal sets are similar (jaccard 1); columns other than the id and text are ignored; an empty table
gives no rows; a null id gives no row; repeated rows of one id and text are one document; the texts of an id with several are
documents of their own (under a 64-bit hash of id and text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._bloom import bloom, bloom_size, in_bloom
from ferrule.llm._shared import U, bounded, buffers, chunks, counted, counters, free, grams, mix, pack, released, stored, trim, unpacked, words

BITS = 21  # log2 of the buckets of the count sketch: fixed, whatever the size of the corpus
_CLASS = "doc_id long, hi long, lo long, size int"
LIST = 4096  # classes of a list that meet at one place; a longer one is cut, and its parts meet in pairs
PLACE = 200_000  # pairs verified at one place
HELD = 500_000  # distinct pairs that a place counts before it passes on what it has
ONCE = 250_000  # postings of a bucket, entries of lists or pairs worked on at once
CROWD = 256  # classes of a crowd, and of a list that may make one, at least
RUN = 64  # classes of one crowd in a list from which they don't meet there; fewer do, and their pairs are dropped later
BLOCK = 1024  # members of a crowd in a block
GRAMS = 400_000  # grams of a block


def sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, distinct gram ids (56 bits) grouped by row and sorted in it, offsets by row."""
    data, offsets = buffers(texts)
    for i, j, d, o in chunks(data, offsets):
        tokens, row = words(d, o)
        g, doc = grams(tokens, row, n)
        g >>= U(8)
        by = np.argsort(g)
        by = by[np.argsort(_small(doc)[by], kind="stable")]
        g, doc = g[by], doc[by]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
        yield i, g, np.searchsorted(doc, np.arange(j - i + 1))


def _small(rows: np.ndarray) -> np.ndarray:
    """Row numbers as 16 bits where they fit: numpy then sorts them by radix."""
    return rows.astype(np.uint16) if not len(rows) or rows[-1] < 1 << 16 else rows


def surveyed(docs: DataFrame, n: int) -> tuple[np.ndarray, DataFrame]:
    """One scan of the corpus: how many documents have a gram of each bucket (2**BITS counters, however large the corpus)
    and a signature of each document's set, two independent 64-bit sums and its size."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            signed, seen = [], []
            for i, g, at in sets(batch.column("text"), n):
                seen.append((g & U((1 << BITS) - 1)).astype(np.uint32))
                at = np.asarray(at)
                some = np.flatnonzero(np.diff(at) > 0)
                if len(some):
                    own = np.zeros(len(some), _SIGN)
                    own["id"] = batch.column("doc_id").slice(i, len(at) - 1).to_numpy(zero_copy_only=False)[some]
                    own["hi"], own["lo"] = (np.add.reduceat(mix(g ^ U(x)), at[:-1][some]).view(np.int64) for x in (0, 0x5DEECE66D1234567))
                    own["size"] = np.diff(at)[some]
                    signed.append(own)
            if seen:
                total += np.bincount(np.concatenate(seen), minlength=1 << BITS).astype(np.uint32)
            if signed:
                yield _rows([None], [-1], [np.concatenate(signed).tobytes()])
        yield _rows(*counters(total))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("body").to_pylist():
                own = np.frombuffer(x, _SIGN)
                yield pa.RecordBatch.from_arrays([pa.array(own[c]) for c in ("id", "hi", "lo", "size")], ["doc_id", "hi", "lo", "size"])

    seen = stored(docs.mapInArrow(released(survey), "task int, slice int, body binary"), "survey")
    out = counted(seen.where("slice >= 0"), BITS)
    return out, seen.where("slice < 0").select("body").mapInArrow(unpack, _CLASS)


_SIGN = np.dtype([("id", "<i8"), ("hi", "<i8"), ("lo", "<i8"), ("size", "<i4")])


def _rows(tasks: list[int | None], slices: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(slices, pa.int32()), pa.array(bodies, pa.binary())], ["task", "slice", "body"])


def levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts as one logarithmic byte a bucket (what executors need for the order), and for each level the other
    documents a gram of it is expected to meet: its count less the mean load of a bucket, which is other grams' noise, but a
    share of the count at least, as a gram that the noise hides still meets some."""
    level = np.minimum(np.floor(np.log2(counts.astype(float) + 1) * 6), 255).astype(np.uint8)
    noise = float(counts.mean())
    count = 2.0 ** (np.arange(256) / 6) - 1
    return level, np.maximum(count - noise, 0.05 * count)


def choose(g: np.ndarray, at: np.ndarray, level: np.ndarray, cost: np.ndarray, t: float, most: int, verify: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams rarest first within their rows; for each row the matches it asks for, and how many grams its prefix has.

    A prefix of total expected meetings S that asks for l matches costs S to scan and leaves at most S/l candidates of
    ``verify`` units each."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    lv = level[(g & U((1 << BITS) - 1)).astype(np.int64)]
    by = np.argsort(lv, kind="stable")  # g is sorted within a row already
    by = by[np.argsort(_small(doc)[by], kind="stable")]
    g, lv = g[by], lv[by]
    need = np.ceil(t * size - 1e-9).astype(np.int64)
    total = np.concatenate(([0.0], np.cumsum(cost[lv])))
    best, ell = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for k in range(1, most + 1):
        s = total[at[:-1] + np.minimum(size - need + k, size)] - total[at[:-1]]
        c = np.where(k <= need, s * (1 + verify / k) + 1e-9 * k, np.inf)
        ell = np.where(c < best, k, ell)
        best = np.minimum(c, best)
    return g, ell, np.where(size > 0, np.minimum(size - need + ell, size), 0)


def similar(base: DataFrame, n: int, threshold: float, most_matches: int = 8, verify_cost: float = 4.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base(doc_id, text) of distinct documents: their signatures, classes(hi, lo, size, rep, members), rep the smallest id of those with one gram set
    and members how many they are, and links(rep, links, other): for each class that is similar to another, how many
    documents of other classes it is similar to and, in one row or several, a class of its group."""
    spark = base.sparkSession
    t = float(threshold)
    counts, signed = surveyed(base, n)
    level, cost = levels(counts)
    # one bucket a million postings, so that a bucket fits a Python worker at any size of the corpus
    buckets = max(4, int(counts.sum() * (1 - t) / 1.5e6) + 1)
    shipped = spark.sparkContext.broadcast((level, cost))
    long, most, run, crowd_of, block, in_block, held_most, once = min(LIST, CROWD), LIST, RUN, CROWD, BLOCK, GRAMS, HELD, ONCE

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, cost = shipped.value
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        n_docs = n_post = 0

        def flush() -> pa.RecordBatch:
            doc, tok, info = (np.concatenate(x) for x in (*zip(*held), ids))
            first = _heads(info)[1]  # of documents with equal sets only the one with the smallest id goes on
            own = first[doc]
            doc, tok = doc[own], tok[own]
            which = (tok % U(buckets)).astype(np.int32)
            tok = ((tok // U(buckets)) & U(0xFFFFFFFF)).astype(np.uint32)
            by = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[by], np.arange(buckets + 1))
            rows: dict[str, list] = {"bucket": [], "docs": [], "doc": [], "tok": []}
            for b in np.flatnonzero(np.diff(cut)):
                own = by[cut[b] : cut[b + 1]]
                used, local = np.unique(doc[own], return_inverse=True)
                rows["bucket"].append(int(b))
                rows["docs"].append(info[used].tobytes())
                rows["doc"].append(pack(local))
                rows["tok"].append(tok[own].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("docs", "doc", "tok"))], list(rows))

        for batch in batches:
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, g, at in sets(batch.column("text"), n):
                g, at = np.array(g), np.asarray(at)
                m = len(at) - 1
                sig = np.zeros(m, U)
                some = np.diff(at) > 0
                if some.any():
                    sig[some] = np.add.reduceat(mix(g), at[:-1][some])
                g, ell, keep = choose(g, at, level, cost, t, most_matches, verify_cost)
                info = np.zeros(m, _INFO)
                info["id"], info["sig"], info["size"], info["ell"] = all_ids[i : i + m], sig, np.diff(at), ell
                doc = np.repeat(np.arange(m), keep)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(keep) - keep, keep) + at[:-1][doc]
                held.append((doc + n_docs, g[pos]))
                ids.append(info)
                n_docs, n_post = n_docs + m, n_post + len(doc)
                if n_post > 1_000_000:
                    yield flush()
                    held.clear(), ids.clear()
                    n_docs = n_post = 0
        if n_post:
            yield flush()

    def meet(part: pa.Table) -> pa.Table:
        bucket = int(part.column("bucket")[0].as_py())
        out = [pa.Table.from_pylist(list(shared_lists(*own, buckets, bucket, t, long)), _LISTS) for own in bucket_pieces(part, once)]
        trim()
        return pa.concat_tables(out)

    def unlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, (name, least, pairs) = np.frombuffer(r["docs"], _CLASS_INFO), np.frombuffer(r["many"], np.int64)
                full = [np.full(len(own), x) for x in (name, least)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, full), pa.array(np.where(np.arange(len(own)) == 0, pairs, 0)), pa.array(own["id"]), pa.array(own["size"]), pa.array(own["ell"].astype(np.int32))], ["list", "least", "pairs", "id", "size", "ell"])

    def cut(part: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(cut_list(part, buckets, most, run)), _LISTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches))
        for out in shared_pairs(part, t, buckets, held_most, once):
            yield from out.to_batches(max_chunksize=16)
        trim()

    def enough(part: pa.Table) -> pa.Table:
        out = candidates_of(part, once)
        trim()
        return out

    lists = "place int, docs binary, many binary, parted binary, doc binary"
    met = base.mapInArrow(released(prefixes), "bucket int, docs binary, doc binary, tok binary").repartition(min(buckets, 1 << 15), "bucket").groupBy("bucket").applyInArrow(meet, lists)
    met = stored(met, "lists")
    short = met.where("place >= 0")
    crowd = stored(met.where("place < 0").select("docs", "many").mapInArrow(released(unlist), "list long, least long, pairs long, id long, size int, ell int"), "long-lists")
    homes = crowd.groupBy("id").agg(F.min("least").alias("home"), F.max("size").alias("size"))
    listed = crowd.groupBy(F.col("least").alias("home")).agg(F.sum("pairs").alias("pairs"))
    large = homes.groupBy("home").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).where(F.col("m") >= crowd_of).join(listed, "home").where("m * (m - 1) / 2 <= pairs")
    large = large.select("home", F.ceil(F.greatest(F.col("m") / block, F.col("grams") / in_block)).cast("int").alias("blocks"))
    crowds = stored(homes.join(large, "home").select("id", "home", "blocks"), "crowds")
    several = not crowds.isEmpty()
    if not crowd.isEmpty():
        rest = crowd.join(crowds.select("id", "home"), "id", "left") if several else crowd.withColumn("home", F.lit(None).cast("long"))
        short = short.unionByName(rest.select("list", "id", "size", "ell", "home").groupBy("list").applyInArrow(cut, lists))
    met2 = short.repartition(min(buckets, 1 << 15), "place").groupBy("place").applyInArrow(count, "part int, docs binary, a binary, b binary, n binary")
    candidates = met2.repartition(min(buckets, 1 << 15), "part").groupBy("part").applyInArrow(enough, "doc_a long, doc_b long, root long").where("doc_a <> doc_b")
    if several:  # the pairs within a crowd are compared as such
        for side in "ab":
            candidates = candidates.join(crowds.select(F.col("id").alias(f"doc_{side}"), F.col("home").alias(f"home_{side}")), f"doc_{side}", "left")
        candidates = candidates.where("home_a is null or home_b is null or home_a <> home_b").select("doc_a", "doc_b", "root")
    candidates = stored(candidates, "candidates")
    free(met, crowd)
    classes = stored(signed.groupBy("hi", "lo", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    links = verified(base, candidates, classes, n, t - 1e-9)
    if several:
        links = links.unionByName(stored(within(base, crowds, classes, n, t - 1e-9), "crowd-links"))
    free(crowds)
    return signed, classes, links


_INFO = np.dtype([("id", "<i8"), ("sig", "<u8"), ("size", "<i4"), ("ell", "u1")])
_CLASS_INFO = np.dtype([("id", "<i8"), ("size", "<i4"), ("ell", "u1")])
_LISTS = pa.schema([("place", pa.int32()), ("docs", pa.binary()), ("many", pa.binary()), ("parted", pa.binary()), ("doc", pa.binary())])
_PAIRED = np.dtype([("id", "<i8"), ("ell", "u1"), ("root", "<i8")])
_PAIRS = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
_CANDIDATES = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("root", pa.int64())])
PACKED = 50_000  # pairs of a row


def _heads(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each document, numbered by size, and which documents stand for their class: of equal sets the smallest id."""
    order = np.lexsort((info["id"], info["sig"], info["size"]))
    s = info[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["sig"][1:] != s["sig"][:-1]) | (s["size"][1:] != s["size"][:-1])
    cls, first = np.empty(len(s), np.int64), np.zeros(len(s), bool)
    cls[order] = np.cumsum(new) - 1
    first[order[new]] = True
    return cls, first


def bucket_pieces(part: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(info, doc, tok) of the postings of a bucket in pieces of about ``most``, all postings of a gram in one of them. Only the packed rows
    are held whole: they grow with the share of postings that bring a document of their own."""
    rows = [part.column(c) for c in ("docs", "doc", "tok")]
    pieces = max(1, -(-sum(len(x.as_buffer()) // 4 for x in rows[2]) // most))
    for k in range(pieces):
        docs, doc, tok, n = [], [], [], 0
        for x, y, z in zip(*rows):
            own = np.frombuffer(z.as_buffer(), np.uint32)
            some = np.flatnonzero(own % np.uint32(pieces) == k)
            if len(some):
                used, local = np.unique(unpacked(y.as_buffer())[some], return_inverse=True)
                docs.append(np.frombuffer(x.as_buffer(), _INFO)[used])
                doc.append(local + n)
                tok.append(own[some])
                n += len(used)
        if n:
            yield np.concatenate(docs), np.concatenate(doc), np.concatenate(tok)


def shared_lists(info: np.ndarray, doc: np.ndarray, tok: np.ndarray, places: int, bucket: int, t: float, long: int) -> Iterator[dict]:
    """The lists of the classes that share a gram, by place: a hash of the smallest id of the list. Classes stand in the
    order of their size within a list.

    A list of more than ``long`` classes is a row of its own, or several, at no place: its number, the smallest id and how
    many of its pairs are of sizes that can be similar stand for ``many``, of which all but one row have none."""
    cls, first = _heads(info)
    own = first[doc]
    key = tok[own].astype(U) << U(32) | cls[doc[own]].astype(U)
    key.sort()
    c = (key & U(0xFFFFFFFF)).astype(np.int64)
    head = info[first]
    head = head[np.argsort(cls[first])]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] >> U(32) != key[:-1] >> U(32)))) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(key)))
    for b, m in zip(begin[many > long].tolist(), many[many > long].tolist()):
        docs = _class_info(head, c[b : b + m])
        pairs = int((np.searchsorted(docs["size"], np.floor(docs["size"] / t + 1e-6), "right") - np.arange(m) - 1).sum())
        for i in range(0, m, PACKED):
            yield {"place": -1, "docs": docs[i : i + PACKED].tobytes(), "many": np.array([bucket << 32 | int(key[b] >> U(32)), docs["id"].min(), pairs if i == 0 else 0], np.int64).tobytes(), "parted": b"", "doc": b""}
    few = (many > 1) & (many <= long)
    begin, many = begin[few], many[few]
    if not len(begin):
        return
    lead = np.cumsum(many) - many
    c = c[np.arange(many.sum()) + np.repeat(begin - lead, many)]
    least = np.minimum.reduceat(head["id"][c], lead)
    place = _place(least, np.zeros(len(least), U), places)
    order = np.argsort(place, kind="stable")
    at = np.searchsorted(place[order], np.arange(places + 1))
    for p in np.flatnonzero(np.diff(at)):
        lists = order[at[p] : at[p + 1]]
        size = many[lists]
        used, local = np.unique(c[np.repeat(lead[lists] - (np.cumsum(size) - size), size) + np.arange(size.sum())], return_inverse=True)
        yield {"place": int(p), "docs": _class_info(head, used).tobytes(), "many": pack(size), "parted": pack(np.zeros(len(size), np.int64)), "doc": pack(local)}


def _class_info(head: np.ndarray, at: np.ndarray) -> np.ndarray:
    docs = np.zeros(len(at), _CLASS_INFO)
    for f in _CLASS_INFO.names:
        docs[f] = head[f][at]
    return docs


def _place(least: np.ndarray, part: np.ndarray, places: int) -> np.ndarray:
    return (mix(least.view(U) ^ (part << U(40))) % U(places)).astype(np.int64)


def cut_list(part: pa.Table, places: int, most: int, run: int) -> Iterator[dict]:
    """A long list in parts of ``most`` classes, as lists: a part alone, and two parts together, in which only classes of
    different parts meet (parted: where the second begins, else 0). Classes of one crowd, if ``run`` or more, are parts of
    their own, and don't meet each other."""
    docs = np.zeros(len(part), _CLASS_INFO)
    for f in _CLASS_INFO.names:
        docs[f] = part.column(f).to_numpy()
    _, group, times = np.unique(part.column("home").combine_chunks().fill_null(0).to_numpy(), return_inverse=True, return_counts=True)
    alone = part.column("home").is_null().to_numpy() | (times[group] < run)
    group = np.where(alone, -1, group)
    order = np.lexsort((docs["id"], docs["size"], group))
    docs, group = docs[order], group[order]
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    parts = [(x, min(x + most, int(e))) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist()) for x in range(b, e, most)]
    for i, (a, b) in enumerate(parts):
        for c, d in parts[i:]:
            if group[a] == group[c] and group[a] >= 0 or b - a == 1 and a == c:
                continue
            own = docs[a:b] if a == c else np.concatenate((docs[a:b], docs[c:d]))
            place = _place(own["id"].min().reshape(1), np.array([0 if a == c else c], U), places)[0]
            yield {"place": int(place), "docs": own.tobytes(), "many": pack(np.array([len(own)])), "parted": pack(np.array([0 if a == c else b - a])), "doc": pack(np.arange(len(own)))}


def shared_pairs(part: pa.Table, t: float, places: int, most_held: int, once: int = ONCE) -> Iterator[pa.Table]:
    """Pairs of classes that share lists of one place and how many, packed by a hash of the first, with the smallest id that each
    class shares a list with here. No more than some ``most_held`` pairs are held; a pair may come several times, with part of its count.
    Lists are taken ``once`` entries at a time."""
    docs = [np.frombuffer(x.as_buffer(), _CLASS_INFO) for x in part.column("docs")]
    all_many, all_parted = (np.concatenate([unpacked(x).astype(np.int64) for x in part.column(c).to_pylist()]) for c in ("many", "parted"))
    base = np.cumsum([0, *map(len, docs)])
    info = np.concatenate(docs)
    order = np.lexsort((info["id"], info["size"]))
    new = np.ones(len(order), bool)
    new[1:] = info["id"][order][1:] != info["id"][order][:-1]
    cls = np.empty(len(order), np.int32)
    cls[order] = np.cumsum(new) - 1
    head = info[order[new]]
    all_c = np.concatenate([cls[b:][unpacked(x.as_buffer())] for x, b in zip(part.column("doc"), base)])
    del docs, info, order, new, cls
    last = np.searchsorted(head["size"], np.floor(head["size"] / t + 1e-6), "right") - 1
    upto = head["size"][last]
    ends = np.cumsum(all_many)
    cuts = [0]  # whole lists
    while cuts[-1] < len(ends):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(int(np.searchsorted(ends, before + once, "right")), cuts[-1] + 1))
    runs = [(a, b, int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:])]
    root = np.full(len(head), np.iinfo(np.int64).max)
    for a, b, x, y in runs:
        many, c = all_many[a:b], all_c[x:y]
        np.minimum.at(root, c, np.repeat(np.minimum.reduceat(head["id"][c], np.cumsum(many) - many), many))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, most = 0, max(1, most_held // 2)
    for a, b, x, y in runs:
        many, parted, c = all_many[a:b], all_parted[a:b], all_c[x:y]
        begin = np.cumsum(many) - many
        number = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(c))
        # in a list of two parts a class of the first meets those of the second, in any other those after it; sizes ascend in each part
        two, middle = parted[number] > 0, (begin + parted)[number]
        start = np.where(two, middle, at + 1)
        # the order of classes here isn't that of the list among equal sizes, so partners end by size
        second = two & (at >= middle)
        sizes = number * (1 << 32) + head["size"][c] + np.where(second, 1 << 31, 0)
        end = np.searchsorted(sizes, number * (1 << 32) + upto[c] + np.where(two, 1 << 31, 0), "right")
        count = np.where(second, 0, np.maximum(end - start, 0))
        some = np.flatnonzero(count > 0)
        cum = np.concatenate(([0], np.cumsum(count[some])))
        del number, at, two, middle, second, sizes, end
        i = 0
        while i < len(some):
            j = max(int(np.searchsorted(cum, cum[i] + min(once, most_held), "right")) - 1, i + 1)
            own, m = some[i:j], count[some[i:j]]
            left = np.repeat(own, m)
            right = np.repeat(start[own] - (np.cumsum(m) - m), m) + np.arange(len(left))
            p, q = np.minimum(c[left], c[right]), np.maximum(c[left], c[right])
            found.append(np.unique((p.astype(U) << U(32)) | q.astype(U), return_counts=True))
            held += len(found[-1][0])
            if held > most:
                found = [_sum(found)]
                held = len(found[0][0])
                most = max(most, min(2 * held, most_held))
                if held > most_held // 2:
                    yield _packed_pairs(*found[0], head, root, places)
                    found, held, most = [], 0, max(1, most_held // 2)
            i = j
    if found:
        yield _packed_pairs(*_sum(found), head, root, places)


def _packed_pairs(k: np.ndarray, n: np.ndarray, head: np.ndarray, root: np.ndarray, places: int) -> pa.Table:
    x, y = (k >> U(32)).astype(np.int64), (k & U(0xFFFFFFFF)).astype(np.int64)
    to = (mix(np.ascontiguousarray(head["id"]).view(U)) % U(places)).astype(np.int32)[x]
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(places + 1))
    rows: list[dict] = []
    for p in np.flatnonzero(np.diff(cut)):
        for at in range(cut[p], cut[p + 1], PACKED):
            own = order[at : min(at + PACKED, cut[p + 1])]
            used, local = np.unique(np.concatenate((x[own], y[own])), return_inverse=True)
            docs = np.zeros(len(used), _PAIRED)
            docs["id"], docs["ell"], docs["root"] = head["id"][used], head["ell"][used], root[used]
            rows.append({"part": int(p), "docs": docs.tobytes(), "a": pack(local[: len(own)]), "b": pack(local[len(own) :]), "n": pack(n[own])})
    return pa.Table.from_pylist(rows, _PAIRS)


def candidates_of(part: pa.Table, most: int = ONCE) -> pa.Table:
    """(doc_a, doc_b, root) of the pairs that share enough prefix grams, from what all places found of them. Pairs that share a gram grow
    faster than documents, so they are unpacked ``most`` at a time, about, by a hash of the first."""
    rows = [part.column(c) for c in ("docs", "a", "b", "n")]
    pieces = max(1, -(-sum((len(x.as_buffer()) - 1) // x.as_buffer()[0] for x in rows[3]) // most))
    return pa.concat_tables([_candidates(rows, k, pieces) for k in range(pieces)])


def _candidates(rows: list[pa.ChunkedArray], k: int, pieces: int) -> pa.Table:
    docs, parts, base = [], [], 0
    for row in zip(*rows):
        info, (a, b, n) = np.frombuffer(row[0].as_buffer(), _PAIRED), (unpacked(x.as_buffer()) for x in row[1:])
        here = (mix(np.ascontiguousarray(info["id"]).view(U)) >> U(40)) % U(pieces) == k
        own = here[a]
        if not own.any():
            continue
        a, b, n = a[own], b[own], n[own]
        here[b] = True
        to = np.cumsum(here) - 1 + base
        docs.append(info[here])
        parts.append((to[a], to[b], n.astype(np.int64)))
        base += len(docs[-1])
    if not docs:
        return _CANDIDATES.empty_table()
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    info = np.concatenate(docs)
    ids, first, place = np.unique(info["id"], return_index=True, return_inverse=True)
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, place, info["root"])
    ell = info["ell"][first]
    key, back = np.unique(place[a].astype(U) << U(32) | place[b].astype(U), return_inverse=True)
    total = np.bincount(back, n, len(key))
    a, b = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
    ok = total >= np.minimum(ell[a], ell[b])
    a, b = a[ok], b[ok]
    return pa.table([ids[a], ids[b], root[a]], schema=_CANDIDATES)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(back, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)


def verified(base: DataFrame, candidates: DataFrame, classes: DataFrame, n: int, least: float) -> DataFrame:
    """links(rep, links, other) from the candidates(doc_a, doc_b, root), whose Jaccard similarity must be at least ``least``.

    First by bitmaps of some two bits a gram, each the parity of the grams of its bucket: two sets differ by no less than
    their bitmaps do, which bounds their similarity from above. Only the sets of pairs that pass are sent whole. Pairs meet
    at their root, so the members of a tight group send their sets to one place once and not once a pair; a place with many
    pairs is split by both documents of a pair."""
    heavy = candidates.groupBy("root").agg(F.ceil(F.sqrt(F.count("*") / PLACE)).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("doc_a"), "parts") * F.col("parts") + F.pmod(F.xxhash64("doc_b"), "parts")
    placed = candidates.join(heavy, "root", "left").select("root", F.coalesce(part, F.lit(0)).cast("int").alias("part"), "doc_a", "doc_b")

    def likely(own: list[bytes], a: np.ndarray, b: np.ndarray, _: np.ndarray, pairs: pa.Table) -> pa.Table:
        return pairs.filter(pa.array(bound(own, a, b) >= least))

    def linked(own: list[bytes], a: np.ndarray, b: np.ndarray, members: np.ndarray, pairs: pa.Table) -> pa.Table:
        ok = jaccard([np.frombuffer(x, U) for x in own], a, b) >= least
        a, b = a[ok], b[ok]
        group = grouped(len(own), a, b)
        links = np.bincount(a, members[b], len(own)) + np.bincount(b, members[a], len(own))
        some = np.flatnonzero(links > 0)
        ids = np.zeros(len(own), np.int64)
        ids[a], ids[b] = pairs.column("doc_a").to_numpy()[ok], pairs.column("doc_b").to_numpy()[ok]
        return pa.table([ids[some], links[some].astype(np.int64), ids[group[some]]], schema=_LINKS)

    first = stored(_compared(base, placed, classes, n, bitmaps, likely, "root long, part int, doc_a long, doc_b long"), "likely")
    free(candidates)
    whole = lambda g, at: [g[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    out = stored(_compared(base, first, classes, n, whole, linked, "rep long, links long, other long"), "links")
    free(first)
    return out


_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def grouped(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n the smallest number that the links a[i] to b[i] lead to."""
    group, before = np.arange(n), None
    while before is None or (group != before).any():
        before = group.copy()
        low = np.minimum(group[a], group[b])
        np.minimum.at(group, a, low)
        np.minimum.at(group, b, low)
        group = group[group]
    return group


def within(base: DataFrame, crowds: DataFrame, classes: DataFrame, n: int, least: float) -> DataFrame:
    """links(rep, links, other) of all pairs within each crowd, from the crowds(id, home, blocks): every block of members meets
    every other at a place of theirs, to which each member sends its set as often as there are blocks."""

    def judge(part: pa.Table) -> pa.Table:
        side = part.column("second").to_numpy()
        part = part.take(np.argsort(side, kind="stable"))
        ids, weight = part.column("doc_id").to_numpy(), part.column("members").to_numpy()
        own = [np.frombuffer(x, U) for x in part.column("grams").to_pylist()]
        size = np.array([len(x) for x in own])
        one = part.column("one")[0].as_py()  # a block by itself
        k = 0 if one else int(np.count_nonzero(~side))
        left, right = (own, own) if one else (own[:k], own[k:])
        common = shared_counts(left, right)
        ok = common >= least * (size[: len(left), None] + size[None, k:] - common)
        a, b = np.nonzero(np.triu(ok, 1) if one else ok)
        b = b + k
        links = np.bincount(a, weight[b], len(own)) + np.bincount(b, weight[a], len(own))
        group = grouped(len(own), a, b)
        some = np.flatnonzero(links > 0)
        out = pa.table([ids[some], links[some].astype(np.int64), ids[group[some]]], schema=_LINKS)
        trim()
        return out

    whole = lambda g, at: [g[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    members = crowds.join(_several(classes), F.col("id") == F.col("doc_id"), "left").select("id", "home", "blocks", F.coalesce("members", F.lit(1)).alias("members"))
    sent = _sets_of(base, crowds.select(F.col("id").alias("doc_id")), n, whole).join(members.withColumnRenamed("id", "doc_id"), "doc_id")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("home", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("one"), "doc_id", "members", "grams")
    return sent.groupBy("home", "x", "y").applyInArrow(judge, "rep long, links long, other long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of the left has in common with each of the right: by matrix product for grams of many sets, pair by
    pair for the others."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not out.size:
        return out
    _, back = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    doc = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    gram = [back[: len(doc[0])], back[len(doc[0]) :]]
    times = [np.bincount(x, minlength=int(back.max()) + 1) for x in gram]
    pairs = times[0] * times[1]
    often = pairs * 500 > out.size
    column = np.cumsum(often) - 1
    width = 2048
    for i in range(0, int(often.sum()), width):
        sides = []
        for d, g, m in zip(doc, gram, out.shape):
            at = np.flatnonzero(often[g] & (column[g] >= i) & (column[g] < i + width))
            sides.append(np.zeros((m, width), np.float32))
            sides[-1][d[at], column[g[at]] - i] = 1
        out += sides[0] @ sides[1].T
    seldom = (pairs > 0) & ~often
    a, b = (np.flatnonzero(seldom[g]) for g in gram)
    b = b[np.argsort(gram[1][b], kind="stable")]
    many = times[1][gram[0][a]]
    begin = np.searchsorted(gram[1][b], gram[0][a])
    cum = np.concatenate(([0], np.cumsum(many)))
    i = 0
    while i < len(a):
        j = max(int(np.searchsorted(cum, cum[i] + 2_000_000, "right")) - 1, i + 1)
        m = many[i:j]
        to = b[np.repeat(begin[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        flat = np.repeat(doc[0][a[i:j]] * len(right), m) + doc[1][to]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape).astype(np.float32)
        i = j
    return out


def _compared(base: DataFrame, placed: DataFrame, classes: DataFrame, n: int, packed: Callable, judged: Callable, schema: str) -> DataFrame:
    """What ``judged`` makes of the pairs of each place, given what ``packed`` makes of the gram sets."""
    wanted = stored(placed.select("root", "part", F.col("doc_a").alias("doc_id")).unionByName(placed.select("root", "part", F.col("doc_b").alias("doc_id"))).distinct(), "wanted")
    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_numpy()
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, right.column(c).to_numpy(), sorter=order)] for c in ("doc_a", "doc_b"))
        return judged(left.column("grams").to_pylist(), a, b, left.column("members").to_numpy(), right)

    sets_of = _sets_of(base, wanted.select("doc_id").distinct(), n, packed)
    wanted = wanted.join(_several(classes), "doc_id", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    sent = wanted.join(sets_of, "doc_id").select(F.col("root").alias("place"), F.col("part").alias("piece"), "doc_id", "members", "grams")
    return sent.groupBy("place", "piece").cogroup(placed.select("root", "part", "doc_a", "doc_b").groupBy("root", "part")).applyInArrow(check, schema)


def _several(classes: DataFrame) -> DataFrame:
    return classes.where("members > 1").select(F.col("rep").alias("doc_id"), "members")


def _sets_of(base: DataFrame, ids: DataFrame, n: int, packed: Callable) -> DataFrame:
    """(doc_id, grams) of the documents named by the distinct ids(doc_id), and of some others."""
    filt = base.sparkSession.sparkContext.broadcast(bloom(ids, "doc_id", bloom_size(ids.count())))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bloom(filt.value, batch.column("doc_id").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(hit))
            for i, g, at in sets(batch.column("text"), n):
                ids = batch.column("doc_id").slice(i, len(at) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed(g, at), pa.binary())], ["doc_id", "grams"])

    return base.mapInArrow(released(emit), "doc_id long, grams binary")


def bitmaps(g: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set its size (4 bytes) and a bitmap of 2 to 4 bits a gram, 64 at least: the parity of each bucket."""
    size = np.diff(at)
    bits = (1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)).astype(np.int64)
    end = np.cumsum(bits)
    doc = np.repeat(np.arange(len(size)), size)
    where = (g & (bits[doc] - 1).astype(U)).astype(np.int64) + (end - bits)[doc]
    flat = np.packbits((np.bincount(where, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [int(s).to_bytes(4, "little") + flat[(e - b) // 8 : e // 8] for s, e, b in zip(size, end, bits)]


def bound(own: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than the Jaccard similarity of sets a[i] and b[i], from their bitmaps; the larger one is folded."""
    size = np.array([int.from_bytes(x[:4], "little") for x in own])
    bits = np.array([8 * (len(x) - 4) for x in own])
    least = np.minimum(bits[a], bits[b])
    apart = np.zeros(len(a), np.int64)
    for width in np.unique(least):
        pairs = np.flatnonzero(least == width)
        used, back = np.unique(np.concatenate((a[pairs], b[pairs])), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(own[x], U, offset=4).reshape(-1, width // 64), axis=0) for x in used])
        step = max(1, (16 << 20) // int(width))
        for i in range(0, len(pairs), step):
            x, y = back[: len(pairs)][i : i + step], back[len(pairs) :][i : i + step]
            apart[pairs[i : i + step]] = np.bitwise_count(rows[x] ^ rows[y]).sum(1, dtype=np.int64)
    total = size[a] + size[b]
    common = np.minimum((total - apart) // 2, np.minimum(size[a], size[b]))
    return common / np.maximum(total - common, 1)


def jaccard(own: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of sets a[i] and b[i]: by bitmaps over the grams of all when pairs are many, else by binary search."""
    size = np.array([len(x) for x in own])
    vocabulary, back = np.unique(np.concatenate(own), return_inverse=True)
    out = np.zeros(len(a), np.int64)
    width = len(vocabulary) // 64 + 1
    if len(own) * width * 8 <= 64 << 20 and len(a) * width < int((size[a] * 25).sum()):
        flat = np.zeros(len(own) * width, U)
        doc = np.repeat(np.arange(len(own)), size)
        np.bitwise_or.at(flat, doc * width + back // 64, U(1) << (back % 64).astype(U))
        rows = flat.reshape(len(own), width)
        step = max(1, (8 << 20) // (8 * width))
        for i in range(0, len(a), step):
            out[i : i + step] = np.bitwise_count(rows[a[i : i + step]] & rows[b[i : i + step]]).sum(1, dtype=np.int64)
    else:
        for i, (x, y) in enumerate(zip(a, b)):
            p, q = (own[x], own[y]) if size[x] < size[y] else (own[y], own[x])
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            out[i] = np.count_nonzero(q[at] == p)
    return out / (size[a] + size[b] - out)


def _documents(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(documents, names): ``docs`` with a column __node, null where the id is, that tells documents apart: the id or, for an id of several
    texts, a hash of id and text; and the names(id, of) of such nodes."""
    key = F.col(f"`{doc_id}`").cast("long")
    own = docs.where(key.isNotNull()).select(key.alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("h")).groupBy("__id")
    often = stored(own.agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1").select("__id", (F.col("lo") != F.col("hi")).alias("__several")), "often")
    marked = docs.withColumn("__id", key).join(often, "__id", "left")
    marked = marked.withColumn("__node", F.when(F.col("__several"), F.xxhash64("__id", F.col(f"`{text}`"))).otherwise(F.col("__id"))).drop("__id")
    names = marked.where("__several").select(F.col("__node").alias("id"), F.col(f"`{doc_id}`").cast("long").alias("of")).distinct()
    return marked, stored(names, "names")


def _linked(docs: DataFrame, n: int, threshold: float, text: str, doc_id: str, **how) -> tuple[DataFrame, DataFrame]:
    """(marked, nodes): ``docs`` with their nodes, and nodes(id, of, root, n_links, n_copies) of the documents similar to any other."""
    bounded(docs)
    marked, names = _documents(docs, text, doc_id)
    # repeated rows are told apart by nothing that matters here
    base = marked.where("__node is not null").select(F.col("__node").alias("doc_id"), F.lower(F.col(f"`{text}`").cast("string")).alias("text"), "__several")
    base = base.where("__several is null").unionByName(base.where("__several is not null").dropDuplicates(["doc_id"])).drop("__several")
    signed, classes, links = similar(base, n, threshold, **how)
    near = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    own = classes.join(near, "rep", "left").join(groups.select(F.col("id").alias("rep"), "root"), "rep", "left").where("members > 1 or links is not null")
    own = own.select("hi", "lo", "size", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), (F.col("members") - 1).alias("n_copies"))
    nodes = signed.join(own, ["hi", "lo", "size"]).select(F.col("doc_id").alias("id"), "root", "n_links", "n_copies").join(names, "id", "left")
    nodes = stored(nodes.select("id", F.coalesce("of", "id").alias("of"), "root", "n_links", "n_copies"), "nodes")
    return marked, nodes


def ngram_jaccard_join(docs: DataFrame, n: int = 2, threshold: float = 0.6, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """A row for each document that is similar to any other: doc_id, class_id (of the group of documents linked by
    similarity, the smallest id), n_links (the documents it is similar to, of which every pair is verified) and n_copies (those of the same gram
    set). A document similar to no other has no row. Rows grow with documents, however many pairs their groups have."""
    _, nodes = _linked(docs, n, threshold, text, doc_id, **how)
    name = nodes.groupBy("root").agg(F.min("of").alias("class_id"))
    return nodes.join(name, "root").select(F.col("of").alias("doc_id"), "class_id", "n_links", "n_copies")


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (id, root), root the smallest id reached. Each round takes the smallest label
    among the neighbours and then the label of that label, so the rounds grow with the logarithm of the diameter."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    step = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("new")).withColumn("old", F.lit(None).cast("long")), "labels")
    for _ in range(most_rounds):
        label = step.select("id", F.col("new").alias("root"))
        near = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        hop = label.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = stored(label.join(near, "id").join(hop, "root", "left").select("id", F.least("root", "other", "up").alias("new"), F.col("root").alias("old")), "labels")
        free(step)
        step = after
        if step.where("new <> old").isEmpty():
            free(both)
            return step.select("id", F.col("new").alias("root"))
    raise RuntimeError("components didn't settle")


def one_of_each_group(docs: DataFrame, n: int = 2, threshold: float = 0.6, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without near copies: of each group of documents linked by similarity the one with the smallest id stays.
    Rows with a null id and rows similar to nothing stay; of repeated rows of one id and text one stays; the texts of an id
    with several are judged each for itself, as documents of their own (under a 64-bit hash of id and text)."""
    marked, nodes = _linked(docs, n, threshold, text, doc_id, **how)
    who = nodes.select("root", F.struct("of", "id").alias("who"))
    first = who.groupBy("root").agg(F.min("who").alias("first"))
    gone = stored(who.join(first, "root").where("who <> first").select(F.col("who.id").alias("__gone")).distinct(), "gone")
    kept = marked.join(gone, marked["__node"] == gone["__gone"], "left_anti").drop("__node")
    once = kept.where("__several is null").drop("__several")
    return once.unionByName(kept.where("__several is not null").drop("__several").dropDuplicates([doc_id, text]))
