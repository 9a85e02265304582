"""Byte-level BPE encoding and decoding inside Spark expressions.

Texts are cut into words by the vocabulary's pattern, and runs of documents become blocks: the distinct words of a block, and
each document as a sequence of places among them. Blocks are written once. Their distinct words, not their texts, are shuffled by a hash of
the word, so that a word of many blocks is encoded once for a family of ``FAMILY`` blocks (some gigabytes of text; of a family of any size a task gets one
slice of the words). Higher-order functions fold the ranked merges over each distinct word: the state of the fold is, for each
token of the word, the token that its pair with the next one merges into, its place and itself in one number; a step merges the pair of the least
number, so the least rank and of one rank the leftmost, and looks up the two pairs that arise. The rank map is a scalar
subquery, which goes to tasks as plain bytes and stands in the plan by its name (a literal is written out in every description of
the plan): a perfect hash table from pairs of tokens to the token they merge into, in one array, so that a look-up is two array
accesses. A long word is folded in segments, of which a step touches three, so that its cost grows with a power of 1.5 of its
length. The tokens of the words go back to their blocks, and documents are put together from them.

Decoding concatenates the pieces of the tokens, taken from such an array in hexadecimal form, and unhexes the whole.

Defined results: a null text has null tokens, an empty text no tokens; every other text, however long, decodes to its own bytes; rows are never
dropped or merged, whatever their ids; other columns are ignored; an empty table gives no rows; a null token list decodes to
null; a token that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import bounded, buffers, chunks, released, shared_dir, span_hash, trim

TOKENS = 2_000_000  # words of a block, about; one longer document is a block by itself
FAMILY = 512
SLICES = 1024
ENTRIES = 100_000  # words of blocks that meet in one call
SEGMENT = 64
ROW = 100_000  # words of a row of a block, about: rows of half a megabyte or more fragment the executors' heap
FOLD = 2_000  # words folded in a row
_PAD = (1 << 16) - 1  # stands before and after a word and merges with nothing
_NONE = 1 << 16
_EMPTY = 1 << 32
_ODD = 40_503
_PLAN = "spark.sql.maxPlanStringLength"
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4


@lru_cache(maxsize=4)
def ranks(path: str) -> tuple[bytes, ...]:
    """The pieces of a vocabulary file by rank."""
    with open(path, "rb") as file:
        own = {int(r): base64.b64decode(p) for p, r in (line.split() for line in file if line.strip())}
    if sorted(own) != list(range(len(own))) or len(own) >= _PAD:
        raise ValueError(f"{path}: ranks are 0 to n-1, n below 65,535")
    return tuple(own[i] for i in range(len(own)))


def merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens, as left * 65536 + right, and the token each merges into: the one of the joined bytes."""
    rank = {p: i for i, p in enumerate(ranks(path))}
    key, to = [], []
    for piece, r in rank.items():
        for i in range(1, len(piece)):
            a, b = rank.get(piece[:i]), rank.get(piece[i:])
            if a is not None and b is not None:
                key.append(a << 16 | b)
                to.append(r)
    return np.array(key, np.int64), np.array(to, np.int64)


@lru_cache(maxsize=4)
def rank_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bases): a pair (l, r) has the group g = (l * _ODD + r) % 65536, and slots[bases[g] + r] is g << 16 | t if it
    merges into t. Within a group r tells pairs apart, so a group needs only a base at which its slots are free."""
    key, to = merges(path)
    left, right = key >> 16, key & 0xFFFF
    group = (left * _ODD + right) & 0xFFFF
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    size = 4 * len(key) // 3 + 1
    slots, bases = np.full(size + (1 << 16), _EMPTY, np.int64), np.zeros(1 << 16, np.int64)
    rng = np.random.default_rng(0)
    for own in sorted(np.split(order, first[1:]), key=lambda x: -len(x)):
        for _ in range(1_000):
            base = rng.integers(size, size=64)
            free_at = np.flatnonzero((slots[base[:, None] + right[own]] == _EMPTY).all(1))
            if len(free_at):
                break
        else:
            raise ValueError(f"{path}: the rank table is full")
        base = base[free_at[0]]
        slots[base + right[own]] = group[own] << 16 | to[own]
        bases[group[own[0]]] = base
    return slots, bases


def entries(low: np.ndarray, right: np.ndarray, slots: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """The state of a token, given as place << 16 | token, before another: above these the token that both merge into, or more
    than any token."""
    group = ((low & 0xFFFF) * _ODD + right) & 0xFFFF
    return np.minimum(slots[bases[group] + right] ^ (group << 16), _NONE) << 46 | low


# Words


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Letter, digit, white space or other, of each code point."""
    own = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    out = np.select([own == ord("L"), own == ord("N")], [_LETTER, _DIGIT], _OTHER).astype(np.uint8)
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def word_starts(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Where the words of a run of texts begin: each is a contraction ('s 't 're 've 'm 'll 'd), or letters, digits or other
    signs after at most one blank, or white space, the last of it apart where something follows."""
    if not len(d):
        return np.zeros(0, np.int64)
    c = np.frombuffer(d.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((d & 0xC0) != 0x80)
    k, n = _kinds()[c], len(c)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, o)] = True
    new = head[:-1].copy()
    new[1:] |= k[1:] != k[:-1]
    space = k == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (c[:-1] == 32) & ~head[1:n]
    begin = new & (space | ~after_blank)
    begin[:-1] |= space[:-1] & ~space[1:] & ~head[1:n]
    q = np.flatnonzero((c == 39) & new & ~after_blank)
    q = q[q + 1 < n]
    q = q[~head[q + 1] & (k[q + 1] == _LETTER)]
    if len(q):
        a, b = c[q + 1], np.where((q + 2 < n) & ~head[np.minimum(q + 2, n)], c[np.minimum(q + 2, n - 1)], 0)
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
        q, size = q[size > 0], size[size > 0]
        begin[q + 1] = False
        rest = q + 1 + size
        rest = rest[rest < n]
        begin[rest[~head[rest] & (k[rest] == _LETTER)]] = True
    return lead[begin]


def _tight(a: np.ndarray) -> bytes:
    """Numbers in the narrowest type that holds them, its width and their count first."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return bytes([kind.itemsize]) + len(a).to_bytes(4, "little") + a.astype(kind).tobytes()


def _loose(b: bytes) -> tuple[np.ndarray, bytes]:
    """What ``_tight`` packed, and what follows it."""
    end = 5 + b[0] * int.from_bytes(b[1:5], "little")
    return np.frombuffer(b[5:end], f"<u{b[0]}").astype(np.int64), b[end:]


def _lists(bodies: list[bytes], unit: int) -> tuple[np.ndarray, list[int], bytes]:
    """Sizes of packed lists of all bodies, how many lists each body has, and the elements, of ``unit`` bytes each."""
    own = zstandard.ZstdDecompressor()
    parts = [_loose(own.decompress(b)) for b in bodies]
    return np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64), [len(p[0]) for p in parts], b"".join(p[1] for p in parts)


def _spread(at: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number at[i] of (offsets, values), one after the other, and their offsets."""
    size = np.diff(of)[at]
    end = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(end[-1]) + np.repeat(of[at] - end[:-1], size)], end


def _binary(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = words.buffers()
    of = np.frombuffer(raw[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(raw[2], np.uint8)[of[0] : of[-1]] if len(words) and raw[2] is not None else np.zeros(0, np.uint8), of - of[0]


# The fold


def _beside(rows: DataFrame, values: pa.Array) -> DataFrame:
    """``rows`` with a column ``constant``, the whole array. To be used once, in a ``select``: the optimizer then puts the subquery in its
    place, which the analyzer doesn't take within higher-order functions, and no row holds the array."""
    own = rows.sparkSession.createDataFrame(pa.table({"constant": pa.ListArray.from_arrays([0, len(values)], values)}))
    return rows.withColumn("constant", own.scalar())


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def merged(words: Column, table: Column) -> Column:
    """The final states of an array of words, given as arrays of the states of their bytes; table: the bases of ``rank_table``, as places
    in this array, and its slots."""
    none, token, odd = F.lit(_NONE).cast("long"), F.lit(0xFFFF).cast("long"), F.lit(_ODD).cast("long")
    rest, never = F.lit(1 << 30), F.lit(_NONE << 46)
    low, places = F.lit((1 << 46) - 1), F.lit((1 << 46) - (1 << 16))

    def folded(t: Column):
        def entry(own: Column, right: Column) -> Column:
            group = (own.bitwiseAND(token) * odd + right).bitwiseAND(token)
            to = F.get(t, F.get(t, group) + right).bitwiseXOR(F.shiftleft(group, 16))
            return F.shiftleft(F.least(to, none), 46).bitwiseOR(own)

        def merge(state: Column, m: Column) -> Column:
            """The pair of state m becomes one token."""

            def at_place(at: Column) -> Column:  # from 1
                new = F.shiftright(m, 46)
                before, after = F.get(state, at - 2).bitwiseAND(low), F.get(state, at + 1).bitwiseAND(token)
                return F.concat(F.slice(state, 1, at - 2), F.array(entry(before, new), entry(m.bitwiseAND(places).bitwiseOR(new), after)), F.slice(state, at + 2, rest))

            return _once(F.array_position(state, m).cast("int"), at_place)

        def flat(word: Column) -> Column:
            step = lambda state, _: _once(F.array_min(state), lambda m: F.when(m < never, merge(state, m)).otherwise(state))
            return F.aggregate(F.sequence(F.lit(4), F.size(word)), word, step)

        def in_segments(word: Column) -> Column:
            segment = lambda s: F.struct(F.array_min(s).alias("m"), s.alias("s"))
            size = F.greatest(F.lit(SEGMENT), F.floor(F.sqrt(F.size(word)))).cast("int")

            def first(n: Column) -> Column:
                last = F.floor(F.size(word) / n).cast("int") - 1
                return F.transform(F.sequence(F.lit(0), last), lambda i: segment(F.slice(word, i * n + 1, F.when(i < last, n).otherwise(rest))))

            def step(state: Column, _: Column) -> Column:
                def change(least: Column) -> Column:
                    def around(p: Column) -> Column:  # the segment's place, from 1
                        nothing = F.slice(least["s"], 1, 0)
                        near = F.concat(F.coalesce(F.get(state, p - 2)["s"], nothing), least["s"], F.coalesce(F.get(state, p)["s"], nothing))

                        def cut(own: Column) -> Column:  # into three of two tokens at least
                            third = F.floor(F.size(own) / 3).cast("int")
                            three = F.array(segment(F.slice(own, 1, third)), segment(F.slice(own, third + 1, third)), segment(F.slice(own, 2 * third + 1, rest)))
                            return F.when(F.size(own) >= 6, three).otherwise(F.array(segment(own)))

                        pieces = _once(_once(near, lambda x: merge(x, least["m"])), cut)
                        return F.concat(F.slice(state, 1, F.greatest(p - 2, F.lit(0))), pieces, F.slice(state, p + 2, rest))

                    return F.when(least["m"] < never, _once(F.array_position(state, least).cast("int"), around)).otherwise(state)

                return _once(F.array_min(state), change)

            return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(4), F.size(word)), _once(size, first), step), lambda x: x["s"]))

        return lambda w: F.when(F.size(w) > 4 * SEGMENT, in_segments(w)).when(F.size(w) > 3, flat(w)).otherwise(w)

    return _once(table, lambda t: F.transform(words, folded(t)))


# Documents to blocks, words to tokens, blocks to documents

_BLOCK = "block long, slice int, n int, ids binary, counts binary, places binary, slices binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the documents of a block (slice -1), and one for each slice of its distinct words."""
    part, held, n, seq = TaskContext.get().partitionId(), [], 0, 0
    small = zstandard.ZstdCompressor(level=3)
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def rows(block: int) -> pa.RecordBatch:
        size = np.cumsum([0, *(len(h[3]) for h in held)])
        starts = np.concatenate([h[4] + x for h, x in zip(held, size)] + [size[-1:]])
        texts = np.concatenate([h[3] for h in held])
        held[:] = [h[:3] for h in held]
        coded = _binary(texts, starts).dictionary_encode()
        del texts, starts
        at = coded.indices.to_numpy()
        often = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")  # frequent words have small places
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often))
        data, of = _parts(coded.dictionary.take(pa.array(often)))
        which = (span_hash(data, of[:-1], of[1:]) % np.uint64(SLICES)).astype(np.int64)
        at = place[at]
        ids, null, count = (np.concatenate([h[x] for h in held]) for x in (0, 1, 2))
        to = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        rows = max(1, -(-len(which) // ROW), -(-len(at) // ROW))
        cuts = np.unique(np.append(np.searchsorted(to, np.arange(rows) * ROW), len(ids)))  # whole documents
        cuts = np.concatenate((cuts, np.full(max(rows - len(cuts) + 1, 0), len(ids))))
        out = []
        for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            places = at[to[i] : to[j]].view(np.uint8).reshape(-1, 4).T
            body = [small.compress(np.ascontiguousarray(x).tobytes()) for x in places]
            out.append([block, -1, r, ids[i:j].tobytes() + null[i:j].tobytes(), count[i:j].astype(np.int32).tobytes(), b"".join(len(x).to_bytes(4, "little") + x for x in body), small.compress(which[r * ROW : (r + 1) * ROW].astype(np.uint16).tobytes()), None])
        by = np.argsort(which, kind="stable")
        data, ends = _spread(by, of, data)
        cut = np.searchsorted(which[by], np.arange(SLICES + 1))
        for s in np.flatnonzero(np.diff(cut)):
            a, b = cut[s], cut[s + 1]
            out.append([block, int(s), int(b - a), None, None, None, None, small.compress(_tight(np.diff(ends[a : b + 1])) + data[ends[a] : ends[b]].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        ids = batch.column("doc_id")
        null = np.asarray(ids.is_null()).astype(np.uint8) | np.asarray(batch.column("text").is_null()).astype(np.uint8) << 1
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for i, j, d, o in chunks(*buffers(batch.column("text"))):
            starts = word_starts(d, o)
            if held and n + len(starts) > TOKENS:
                yield rows(part << 24 | seq)
                held, n, seq = [], 0, seq + 1
            held.append((ids[i:j], null[i:j], np.diff(np.searchsorted(starts, o)), d.copy(), starts.astype(np.int32)))
            n += len(starts)
    if held:
        yield rows(part << 24 | seq)


def bpe_encode(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids, the tokens of the text, of every row."""
    spark = docs.sparkSession
    if spark.conf.get(_PLAN, "1") == "1":  # unset: the driver keeps descriptions of plans
        spark.conf.set(_PLAN, str(1 << 16))
    byte = np.zeros(256, np.int64)
    for i, p in enumerate(ranks(path)):
        if len(p) == 1:
            byte[p[0]] = i
    if len({p for p in ranks(path) if len(p) == 1}) < 256:
        raise ValueError(f"{path}: a byte-level vocabulary has all bytes")
    lookup = spark.sparkContext.broadcast(rank_table(path))  # some 5 MB, whatever the corpus

    def gathered(part: pa.Table) -> pa.Table:
        """The distinct words of some slices of a family, in rows of some, and with the last what their blocks asked for."""
        sizes, many, data = _lists(part.column("words").to_pylist(), 1)
        coded = _binary(data, np.concatenate(([0], np.cumsum(sizes)))).dictionary_encode()
        data, of = _parts(coded.dictionary)
        fan = np.concatenate((part.column("block").to_numpy(), part.column("slice").to_numpy(), many)).astype(np.int64).tobytes() + coded.indices.to_numpy().astype(np.int32).tobytes()
        word = np.repeat(np.arange(len(of) - 1), np.diff(of))
        padded = np.full(len(data) + 2 * (len(of) - 1) + 1, _PAD, np.int64)
        padded[np.arange(len(data)) + 2 * word + 1] = byte[data]
        at = of + 2 * np.arange(len(of))
        place = np.arange(len(padded) - 1) - np.repeat(at[:-1], np.diff(at))
        states = entries(place << 16 | padded[:-1], padded[1:], *lookup.value)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(states))
        cuts = list(range(0, len(lists), FOLD))
        rows = [lists.slice(i, FOLD) for i in cuts]
        words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.concat_arrays(rows))
        trim()
        return pa.table({"asked": pa.array([None] * (len(cuts) - 1) + [len(many).to_bytes(4, "little") + fan], pa.binary()), "words": words})

    def fanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of each slice of each block that asked."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words").slice(k, 1).flatten()
                size = words.value_lengths().to_numpy(zero_copy_only=False)
                tokens = words.flatten().to_numpy(zero_copy_only=False) & _PAD
                held.append((tokens[tokens != _PAD].astype(np.uint16), size - 2))
                if (asked := batch.column("asked")[k].as_py()) is None:
                    continue
                m = int.from_bytes(asked[:4], "little")
                block, slices, many = np.frombuffer(asked, np.int64, 3 * m, 4).reshape(3, m)
                tokens, of = np.concatenate([h[0] for h in held]), np.concatenate(([0], np.cumsum(np.concatenate([h[1] for h in held]))))
                held = []
                values, end = _spread(np.frombuffer(asked, np.int32, offset=4 + 24 * m), of, tokens)
                cut = np.concatenate(([0], np.cumsum(many)))
                body = [small.compress(_tight(np.diff(end[a : b + 1])) + values[end[a] : end[b]].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(slices.astype(np.int32)), pa.array(body, pa.binary())], ["block", "slice", "tokens"])

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        if not left.num_rows:
            return out.empty_table()
        left, right = left.sort_by("n"), right.sort_by("slice")
        sizes, _, data = _lists(right.column("tokens").to_pylist(), 2)
        plain = zstandard.ZstdDecompressor()
        by = np.argsort(np.frombuffer(b"".join(plain.decompress(x) for x in left.column("slices").to_pylist()), np.uint16), kind="stable")  # the words' places in the order of the answers
        values, of = np.frombuffer(data, np.uint16), np.concatenate(([0], np.cumsum(sizes)))
        where = np.empty(len(by), np.int64)
        where[by] = np.arange(len(by))
        batches = []
        for row in left.select(["ids", "counts", "places"]).to_pylist():
            count = np.frombuffer(row["counts"], np.int32)
            places, rest = np.zeros((int(count.sum(dtype=np.int64)), 4), np.uint8), row["places"]
            for plane in range(4):
                m = 4 + int.from_bytes(rest[:4], "little")
                places[:, plane], rest = np.frombuffer(plain.decompress(rest[4:m]), np.uint8), rest[m:]
            n = len(count)
            doc_ids, null = np.frombuffer(row["ids"], np.int64, n), np.frombuffer(row["ids"], np.uint8, n, 8 * n)
            at = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
            tokens, end = _spread(where[places.view(np.uint32).ravel()], of, values)
            lists = pa.ListArray.from_arrays(pa.array(end[at].astype(np.int32), mask=np.append(null & 2 > 0, False)), pa.array(tokens.astype(np.int32)))
            batches.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null & 1 > 0), lists], schema=out))
        trim()
        return pa.Table.from_batches(batches, out)

    own = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(_blocks), _BLOCK)
    stored = _by_block(own)
    asked = stored.where("slice >= 0").select("block", "slice", "n", "words")
    total = asked.agg(F.sum("n").alias("words"), F.countDistinct("block").alias("blocks")).first()
    families = -(-(total["blocks"] or 1) // FAMILY)
    per_slice = (total["words"] or 0) / (families * SLICES) + 1
    keyed = asked.select(F.pmod(F.xxhash64("block"), F.lit(families)).cast("int").alias("family"), F.floor(F.col("slice") / max(1, min(SLICES, int(ENTRIES / per_slice)))).cast("int").alias("some"), "block", "slice", "words")
    distinct = keyed.groupBy("family", "some").applyInArrow(gathered, "asked binary, words array<array<long>>")
    slots, bases = rank_table(path)
    answers = _beside(distinct, pa.array(np.concatenate((bases + len(bases), slots)))).select("asked", merged(F.col("words"), F.col("constant")).alias("words")).mapInArrow(released(fanned), "block long, slice int, tokens binary")
    blocks = stored.where("slice < 0").select("block", "n", "ids", "counts", "places", "slices")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assembled, "doc_id long, ids array<int>")


def _by_block(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder, bucketed by block: blocks then stay where they are when their answers come."""
    spark = rows.sparkSession
    name, path = f"bpe_{uuid.uuid4().hex}", f"{shared_dir(spark)}/bpe-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now: the plan holds the files, and the name can go
    spark.sql(f"DROP TABLE {name}")
    return out


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of an array of tokens."""
    with_pieces = _beside(rows, pa.array([p.hex() for p in ranks(path)]))
    decoded = _once(F.col("constant"), lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(p, i.cast("int") + 1)), "")))
    return with_pieces.select(*rows.columns, decoded.alias("decoded"))


def bpe_round_trip(docs: DataFrame, path: str, **how) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them, of every row."""
    out = bpe_encode(docs, path, **how)
    n = F.when(F.col("ids").isNotNull(), F.size("ids"))
    return bpe_decode(out, path).select("doc_id", n.alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))
