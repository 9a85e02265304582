"""Readers of corpora, topics, judgments, synonyms and stop words."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import preprocess
from ferrule.storage import stored


def dense_ids(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, 2 ... in the order of ``by``. Rows are spread by range and numbered within
    their range; what comes before a range is known from one count a range."""
    placed = stored(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")  # a row a range
    own = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(by)))
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__part", "__before", "__k")


def _lines(spark: SparkSession, path: str, **how) -> DataFrame | None:
    """The lines of a text file anywhere that Spark reads; None if it's missing."""
    try:
        return spark.read.text(path, **how)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc_name, text, file_size) of the non-empty .txt files right in a folder; ids are dense from 0 by path."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("text")).where("file_size > 0")
    rows = dense_ids(rows, "path", "doc_id")
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return rows.select("doc_id", F.try_url_decode(name).alias("doc_name"), "text", "file_size")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, query) of a file of <top> sections with one-line <num> and <title>; of repeated ids the last counts. A
    title that preprocessing empties is its own query, in lower case. A missing file has no topics."""
    if (lines := _lines(spark, path, lineSep="</top>")) is None:
        return spark.createDataFrame([], "qid string, title string, query string")
    parts = lines.where(F.contains("value", F.lit("<top>"))).withColumn("k", F.monotonically_increasing_id())
    number = F.trim(F.regexp_extract("value", r"<num>(?:[^:\n<]*:)?[ \t]*([^\n<]*)", 1))
    title = F.trim(F.regexp_extract("value", r"<title>[ \t]*([^\n<]*)", 1))
    rows = parts.select(number.alias("qid"), title.alias("title"), "k").where("qid <> ''")
    last = rows.groupBy("qid").agg(F.max_by("title", "k").alias("title"))
    return last.withColumn("query", F.coalesce(F.nullif(preprocess(F.col("title")), F.lit("")), F.lower("title")))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_name, rel) of lines ``qid iter doc_name rel``; other lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(p, 0).alias("qid"), F.get(p, 2).alias("doc_name"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 3) AS INT)").alias("rel"))
    return rows.where("rel is not null")


def read_qrels(spark: SparkSession, path: str, doc_names: DataFrame) -> DataFrame:
    """(qid, doc_id) judged relevant, of documents that exist."""
    return read_judgments(spark, path).where("rel > 0").join(doc_names, "doc_name").select("qid", "doc_id").distinct()


def missing_judgments(spark: SparkSession, path: str, doc_names: DataFrame) -> DataFrame:
    """(qid, doc_name) judged relevant, of documents that don't exist."""
    return read_judgments(spark, path).where("rel > 0").join(doc_names, "doc_name", "left_anti").select("qid", "doc_name")


def counted(judgments: DataFrame, doc_names: DataFrame) -> DataFrame:
    """One row: judgments(qid, doc_name, rel) that say relevant, those of documents that exist, those of documents that
    don't, and topics with a relevant document that exists."""
    own = judgments.where("rel > 0").join(doc_names.select("doc_name", F.lit(True).alias("there")).distinct(), "doc_name", "left")
    there = F.col("there").isNotNull()
    return own.agg(F.count("*").alias("judged"), F.count_if(there).alias("relevant"), F.count_if(~there).alias("missing"), F.count_distinct(F.when(there, F.col("qid"))).alias("topics"))


def saved_judgments(judgments: DataFrame, doc_names: DataFrame) -> DataFrame:
    """The judgments(qid, doc_name, rel) of documents that were saved."""
    return judgments.join(doc_names, "doc_name", "left_semi")


def read_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Lines ``term: form, form``; # starts a comment line; of repeated terms the last counts; a missing file has none. The
    lines come to the driver, where queries are parsed."""
    out: dict[str, list[str]] = {}
    lines = _lines(spark, path)
    for r in lines.coalesce(1).collect() if lines is not None else ():
        name, colon, forms = r["value"].strip().partition(":")
        own = [f for f in (x.strip().lower() for x in forms.split(",")) if f]
        if colon and own and not name.startswith("#"):
            out[name.strip().lower()] = own
    return out


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word a line; # starts a comment line; the operator words can't be stop words."""
    own = {r["value"].strip().lower() for r in spark.read.text(path).collect() if not r["value"].strip().startswith("#")}
    return tuple(sorted(own - {"", "and", "or", "not"}))


def title_and_abstract(rows: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """``rows`` with ``text``, title and abstract with a space between; those with neither are dropped."""
    text = F.trim(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(abstract), F.lit(""))))
    return rows.withColumn("text", text).where("text <> ''")
