"""Corpus pipeline over ``documents``: language, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.

Rows with a null id stay until the end (nothing says that they are copies or leaks); rows with a null or empty text have no
language and go in the first stage; repeated rows of one id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm._shared import stored, table
from ferrule.llm.bpe import bpe_round_trip
from ferrule.llm.decontam import without_benchmark
from ferrule.llm.langid import language_dictionaries, without_unsure
from ferrule.llm.ngram_join import one_of_each_group
from ferrule.llm.pii import surrogates
from ferrule.llm.queries import RANKS, surrogate_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected."""
    return without_unsure(docs, language_dictionaries(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold part of a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data; ``n_chars`` is that of the new text."""
    out = surrogates(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return bpe_round_trip(docs, RANKS)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminated), ("PII", anonymous), ("BPE", tokens)]

#: Compression, similarity groups and merges aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
