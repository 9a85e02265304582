"""The inverted index as ordinary tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import STOP_WORDS, TOKEN, shard_id, tokens
from ferrule.storage import bounded, spread


def term_doc_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, doc_id), a row for each occurrence."""
    return docs.select(F.explode(tokens(F.col(text), stop_words)).alias("term"), F.col(doc_id).alias("doc_id"))


def counts(words: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of rows of (doc_id, words), an array of tokens: the words of each row are counted within the row, so that
    no table of all pairs is held anywhere. Ids that several rows have aren't merged yet."""
    t, at = F.col("words"), F.col("at")
    begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    runs = words.where(F.size("words") > 0).select("doc_id", F.sort_array("words").alias("words")).select("doc_id", "words", begins.alias("at"))
    each = F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("tf")))
    return runs.select("doc_id", F.explode(each).alias("p")).select("p.term", "doc_id", "p.tf")


def _words(docs: DataFrame, terms: list[str] | None, text: str, doc_id: str, stop_words: tuple[str, ...]) -> DataFrame:
    own = tokens(F.col(text), stop_words)
    if terms is not None:
        own = F.filter(own, lambda t: t.isin(*terms)) if terms else F.filter(own, lambda t: F.lit(False))
    return docs.select(F.col(doc_id).alias("doc_id"), own.alias("words"))


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of (term, doc_id, tf) of one term and document as one, spread by the keys and sorted by them, term and doc_id. That the term is
    an aggregate too makes Spark go through sorted rows, one pair at a time, where it would else hold a table of all pairs of a task."""
    by = dict.fromkeys((*keys, "term", "doc_id"))
    own = spread(rows, *keys, "term").groupBy(*by).agg(F.max("term").alias("__term"), F.sum("tf").alias("tf"))
    return own.select(*keys, F.col("__term").alias("term"), "doc_id", "tf")


def postings(docs: DataFrame, terms: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, doc_id, tf). With ``terms``, of these only: others are dropped before a row is made of them."""
    return _merged(counts(_words(docs, terms, text, doc_id, stop_words)))


def _lists(store: DataFrame) -> DataFrame:
    """(term, doc_ids, tfs) of (doc_id, content), a document store: the postings of a batch of documents, a row a term. Lists move and are
    sorted in place of pairs; a batch has some 8 MB at most, so that a worker's memory doesn't grow with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("content").cast(pa.large_string()), " ")
            ids, doc = _codes(batch.column("doc_id"))
            terms, code = _codes(words.flatten())
            pairs, tf = np.unique(code.astype(np.int64) << 32 | np.repeat(doc, np.diff(words.offsets)), return_counts=True)
            ends = np.searchsorted(pairs >> 32, np.arange(len(terms) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), values) for values in (ids.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(tf.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), *lists], ["term", "doc_ids", "tfs"])

    kind = store.schema["doc_id"].dataType.simpleString()
    return bounded(store.select("doc_id", "content")).mapInArrow(run, f"term string, doc_ids array<{kind}>, tfs array<bigint>")


def _codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, null as one of them, and the place of each row's value among these."""
    own = column.dictionary_encode("encode")
    return own.dictionary, own.indices.to_numpy()


def each_posting(lists: DataFrame) -> DataFrame:
    """(term, doc_id, tf), and the other columns, of rows of lists."""
    return lists.withColumn("__p", F.explode(F.arrays_zip("doc_ids", "tfs"))).select("term", F.col("__p.doc_ids").alias("doc_id"), F.col("__p.tfs").alias("tf"), *(c for c in lists.columns if c not in ("term", "doc_ids", "tfs")))


BLOCK = 1 << 16  # document ids of a block of a posting list


def posting_lists(docs: DataFrame, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, block, doc_ids): sorted, each document as often as the term occurs in it; a list is cut by ranges of ids, so that
    that of a frequent term isn't one row. What a batch of documents has of a list moves as one row."""
    repeated = F.flatten(F.transform(F.arrays_zip("doc_ids", "tfs"), lambda p: F.array_repeat(p["doc_ids"], p["tfs"].cast("int"))))
    own = _lists(doc_store(docs, text, doc_id, stop_words)).select("term", repeated.alias("d"))
    blocks = F.transform("d", lambda x: F.floor(x / block))
    cut = own.withColumn("b", blocks).withColumn("block", F.explode(F.array_distinct("b"))).select("term", "block", F.when(F.size(F.array_distinct("b")) == 1, F.col("d")).otherwise(F.filter("d", lambda x: F.floor(x / block).eqNullSafe(F.col("block")))).alias("d"))
    return spread(cut, "term", "block").groupBy("term", "block").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("doc_ids"))


def dictionary(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, and occurrences."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _listed(lists: DataFrame) -> DataFrame:
    """The dictionary of rows of lists."""
    n = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.groupBy("term").agg(F.sum(F.size("doc_ids").cast("long")).alias("df"), F.sum(n).alias("cf"))


_ASCII = np.full(256, 32, np.uint8)
for _c in map(chr, range(128)):
    if re.fullmatch(TOKEN, _c):
        _ASCII[ord(_c)] = ord(_c.lower())


def doc_store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, content), and doc_name where ``docs`` has it: texts as ``preprocess`` leaves them, those that aren't empty. The bytes
    outside tokens become spaces in one step, which takes a fraction of the time of a pattern."""
    names = ["doc_name"] if "doc_name" in docs.columns else []
    stop = frozenset(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.fill_null(batch.column("content").cast(pa.large_string()), "")
            at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            ascii_ = _ASCII[np.frombuffer(own.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]].tobytes().decode("ascii")
            at = (at - at[0]).tolist()
            got = pa.array([" ".join([w for w in ascii_[i:j].split() if w not in stop]) for i, j in zip(at, at[1:])], pa.string())
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), got, *(batch.column(c) for c in names)], ["doc_id", "content", *names])
            yield rows.filter(pc.not_equal(got, ""))

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content"), *names)
    return bounded(own).mapInArrow(run, own.schema)


def write_meta(spark: SparkSession, path: str, num_shards: int) -> None:
    spark.createDataFrame([(json.dumps({"num_shards": num_shards}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def by_shard(store: DataFrame, num_shards: int) -> DataFrame:
    """(shard, term, doc_ids, tfs) of a document store, a row or more a term; a shard may be several tasks, as terms are spread too, each
    sorted by term. Documents of ids that come again are counted by pairs, as their counts add up."""
    again = store.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        lists = _lists(store)
    else:
        here = store.select("doc_id", "content").join(again.select(F.col("doc_id").alias("__again"), F.lit(True).alias("__more")), F.col("doc_id").eqNullSafe(F.col("__again")), "left")
        words = here.where("__more").select("doc_id", F.split("content", " ").alias("words"))
        lists = _lists(here.where("__more is null")).unionByName(_merged(counts(words)).select("term", F.array("doc_id").alias("doc_ids"), F.array("tf").alias("tfs")))
    own = lists.withColumn("shard", shard_id(F.col("term"), num_shards))
    return spread(own, "shard", "term").sortWithinPartitions("shard", "term")


def build_index(docs: DataFrame, path: str, num_shards: int = 64, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write documents, with their names where ``docs`` has a doc_name, postings (a folder a shard, its files sorted by term) and
    dictionary under ``path``. Texts are cut into tokens once: postings are made of the stored documents."""
    spark = docs.sparkSession
    doc_store(docs, text, doc_id).write.mode("overwrite").parquet(f"{path}/docs")
    by_shard(spark.read.parquet(f"{path}/docs"), num_shards).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    _listed(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/dictionary")
    write_meta(spark, path, num_shards)


class Index:
    """A stored index; the number of shards is stored with it. One that a stream wrote has batches: a document's last counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.num_shards = json.loads(spark.read.text(f"{path}/meta").first()["value"])["num_shards"]
        docs = spark.read.parquet(f"{path}/docs")
        self.batched = "batch" in docs.columns
        if self.batched:
            self.latest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
            docs = docs.join(self.latest, ["doc_id", "batch"]).drop("batch")
        self.docs = docs
        self.dictionary = dictionary(self.postings()) if self.batched else spark.read.parquet(f"{path}/dictionary")

    def named(self, hits: DataFrame) -> DataFrame:
        """``hits`` with doc_name, null where the index has none."""
        if "doc_name" not in self.docs.columns:
            return hits.withColumn("doc_name", F.lit(None).cast("string"))
        return hits.join(self.docs.select("doc_id", "doc_name"), "doc_id", "left")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc_id, tf); with ``terms``, only their shards are read, and in those the terms are pushed to the scan."""
        own = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            if not terms:
                own = own.where("false")
            else:
                names = self.spark.createDataFrame([(t,) for t in terms], "term string")
                shards = [r[0] for r in names.select(shard_id(F.col("term"), self.num_shards)).distinct().collect()]
                own = own.where(F.col("shard").isin(*shards) & F.col("term").isin(*terms))
        own = each_posting(own) if "tfs" in own.columns else own  # pairs: an index of an older form
        if self.batched:
            own = own.join(self.latest, ["doc_id", "batch"])
        return own.select("term", "doc_id", "tf")
