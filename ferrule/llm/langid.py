"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its own text. A text, however long, is encoded piece by piece,
once with each dictionary; the language whose dictionary makes it smallest is chosen, and the choice is rejected when the
runner-up is nearly as small. zstandard stores a very short text raw, whatever the dictionary; so a text of fewer than ``SHORT``
bytes, or of fewer than four times as many and the same size in all languages, is encoded behind a carrier that always compresses, once from each of its bytes on, and what it adds is summed.

Defined results: a null, empty or blank text, and one whose margin is below ``least_margin``, is rejected (accepted false;
lang null where there is no text to judge); of equal sizes the alphabetically first language is taken, with margin 0; rows
are never dropped or merged, null and repeated ids included; an empty table gives no rows; without any dictionary, as of a
corpus of which no row has a language label, ``detect_language`` rejects all, and ``without_unsure`` refuses to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm._shared import bounded, released

PIECE = 4096  # bytes encoded at a time, so that a long text keeps meeting the dictionary and not only itself
MATCH = 4  # least bytes of a match: short enough for what the words of one language share
SEARCH = 5  # log2 of the match candidates looked at
SHORT = 64  # bytes; a text below is measured behind the carrier
CARRIER = bytes(64)


def language_dictionaries(docs: DataFrame, most_bytes: int = 32 << 10, most_docs: int = 64, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionary content of each labelled language: texts of at most ``most_docs`` documents, chosen by a hash of their
    id, up to ``most_bytes`` bytes; a bounded training sample, whatever the size of the corpus."""
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id)).alias("h")).where("lang is not null and doc_id is not null")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            if held.num_rows > 100_000:
                held = smallest(held)
        if held is not None:
            yield from smallest(held).combine_chunks().to_batches()

    def smallest(rows: pa.Table) -> pa.Table:
        rows = rows.group_by(["lang", "doc_id", "h"]).aggregate([]).sort_by([("lang", "ascending"), ("h", "ascending"), ("doc_id", "ascending")]).select(["lang", "doc_id", "h"])
        name = rows.column("lang").to_numpy()
        new = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
        place = np.arange(len(name)) - np.repeat(new, np.diff(np.append(new, len(name))))
        return rows.filter(pa.array(place < most_docs))

    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = labelled.mapInArrow(least, labelled.schema).distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= most_docs)
    ids = {(r["lang"], r["doc_id"]) for r in chosen.collect()}
    if not ids:
        return {}
    own = docs.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = own.where(F.col("doc_id").isin(sorted({d for _, d in ids})) & F.col("text").isNotNull()).dropDuplicates().collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"] or "", r["doc_id"], r["text"])):
        if (r["lang"], r["doc_id"]) in ids and len(out.get(r["lang"], b"")) < most_bytes:
            out[r["lang"]] = (out.get(r["lang"], b"") + b"\n" + r["text"].encode())[:most_bytes]
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


def compressors(dictionaries: dict[str, bytes], short: bool = False) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """By language; with ``short``, those for short texts: matches of three bytes and an optimal parse."""
    own = []
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTULTRA2 if short else zstandard.STRATEGY_LAZY2, window_log=18, hash_log=15, chain_log=15, search_log=SEARCH, min_match=3 if short else MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    for name, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        own.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))
    return own


def added(raw: bytes, c: zstandard.ZstdCompressor) -> int:
    """Bytes that a short text, set apart by spaces, adds to the carrier, summed over its suffixes."""
    words = b" " + b" ".join(raw.split()) + b" "
    ends = range(max(len(words) - 3, 1))
    return sum(len(c.compress(CARRIER + words[i:])) for i in ends) - len(ends) * len(c.compress(CARRIER))


def judge(text: str | None, own: list[tuple[str, zstandard.ZstdCompressor]], least_margin: float, short: list[tuple[str, zstandard.ZstdCompressor]] | None = None) -> tuple[str | None, float | None, bool]:
    raw = (text or "").strip().lower().encode("utf-8", "replace")
    if not raw or not own:
        return None, None, False
    sizes = sorted((sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)), name) for name, c in own)
    if short and (len(raw) < SHORT or len(raw) < 4 * SHORT and sizes[0][0] == sizes[-1][0]):
        sizes = sorted((added(raw, c), name) for name, c in short)
    best = sizes[0]
    margin = (sizes[1][0] - best[0]) / max(sizes[1][0], 1) if len(sizes) > 1 else 1.0
    return best[1], round(margin, 6), margin >= least_margin


def detect_language(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.01, *, text: str = "text", out: tuple[str, str, str] = ("lang_found", "lang_margin", "lang_accepted")) -> DataFrame:
    """``docs`` with the language found, its margin over the runner-up as a share of that one's size, and whether it is
    accepted; existing columns of those names are replaced."""
    kept = bounded(docs).select(*(F.col(f"`{c}`") for c in docs.columns if c not in out))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in zip(out, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    found = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = {k: v.lower() if v.isascii() else v.decode("utf-8", "ignore").lower().encode() for k, v in found.value.items()}
        own, short = compressors(lower), compressors(lower, short=True)
        for batch in batches:
            got = [judge(t.as_py(), own, least_margin, short) for t in batch.column(text)]
            lang, margin, ok = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(margin, pa.float64()), pa.array(ok, pa.bool_())], [*batch.schema.names, *out])

    return kept.mapInArrow(released(run), schema)


def without_unsure(docs: DataFrame, dictionaries: dict[str, bytes], **how) -> DataFrame:
    """``docs`` without the rows whose language is rejected; their columns as they were."""
    if not dictionaries and not docs.isEmpty():
        raise ValueError("no document with a language label has text: there is nothing to tell languages by, and all documents would go")
    out = ("__lang_found", "__lang_margin", "__lang_accepted")
    return detect_language(docs, dictionaries, out=out, **how).where(out[2]).drop(*out)
