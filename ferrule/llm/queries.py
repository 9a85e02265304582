"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm._shared import table
from ferrule.llm.bpe import bpe_round_trip
from ferrule.llm.chat import chat_format
from ferrule.llm.decontam import template_matches
from ferrule.llm.langid import detect_language, language_dictionaries
from ferrule.llm.ngram_join import ngram_jaccard_join
from ferrule.llm.pii import surrogates
from ferrule.llm.quality import quality_classifier
from ferrule.llm.sharding import SLOTS, lookup_table, place
from ferrule.llm.suffix_dedup import suffix_dedup
from ferrule.llm.topk import exact_top_k

#: a published byte-level vocabulary of this machine; the operators take the path as a parameter
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{k:02d}" for k in range(64)]
_OWN_KEY = secrets.token_bytes(32)


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of the session's setting spark.ferrule.surrogate.key; where it's unset, one of this process alone."""
    return (spark.conf.get("spark.ferrule.surrogate.key", None) or "").encode() or _OWN_KEY


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), RANKS)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count="n_replaced")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws("-", a, b)), ",")
    return out.select("conv_id", "n_turns", "n_bytes", spans.alias("assistant_spans"), "text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), SHARDS)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect_language(docs.select("doc_id", "lang", "text"), language_dictionaries(docs))
    return found.drop("text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_bpe,
        op3_pii_surrogates,
        op4_exact_top_k,
        op5_chat_formatting,
        op6_sharding,
        op7_ngram_jaccard_join,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_suffix_dedup,
    )
}

#: ASCII lower case only, as the operators have it
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

_TOP_K = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
size AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
posting AS (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM d),
tf AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM posting GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (
  SELECT item_id AS query_id, doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), size GROUP BY item_id, doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10
"""

_CHAT = """
WITH part AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, role AS r0, text AS t0
  FROM conversations WHERE conv_id IS NOT NULL),
sized AS (
  SELECT *, 13 + strlen(role) AS head, strlen(text) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS k
  FROM part),
placed AS (
  SELECT *, coalesce(sum(head + body + 11) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(head + body + 11) AS BIGINT) AS n_bytes,
  coalesce(string_agg(CAST(start + head AS BIGINT) || '-' || CAST(start + head + body AS BIGINT), ',' ORDER BY k) FILTER (r0 = 'assistant'), '') AS assistant_spans,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM placed GROUP BY conv_id
"""

_SHARD = f"""
SELECT documents.*, ([{", ".join(f"'{SHARDS[k]}'" for k in lookup_table(SHARDS))}])[1 + CAST(('0x' || md5(CAST(doc_id AS VARCHAR))[1:8]) AS BIGINT) % {SLOTS}] AS shard
FROM documents
"""

#: Every pair of texts by the grams that they share; groups by following the links.
_JOIN = r"""
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT row_number() OVER () AS node, doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM t),
g AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM d WHERE len(w) > 0),
size AS (SELECT node, count(*) AS n FROM g GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.node < b.node GROUP BY a.node, b.node),
pair AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN size x ON x.node = a JOIN size y ON y.node = b WHERE c >= (0.6 - 1e-9) * (x.n + y.n - c)),
link AS (SELECT a, b, same FROM pair UNION ALL SELECT b, a, same FROM pair),
reach(a, b) AS (SELECT a, a FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT reach.a, min(doc_id) AS class_id FROM reach JOIN d ON d.node = reach.b GROUP BY reach.a)
SELECT d.doc_id, class_id, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM link JOIN d ON d.node = link.a JOIN class ON class.a = link.a GROUP BY d.node, d.doc_id, class_id
"""

_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 49], ' ') AS window_ FROM p),
o AS (SELECT doc_id, pos, count(*) OVER g AS copies, row_number() OVER (PARTITION BY window_ ORDER BY doc_id, pos) = 1 AS first FROM x WINDOW g AS (PARTITION BY window_) QUALIFY copies > 1),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, first ORDER BY pos) AS run FROM o)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, max(copies) AS copies, first FROM r GROUP BY doc_id, first, run
"""

SQL: dict[str, str] = {
    "op4_exact_top_k": _TOP_K,
    "op5_chat_formatting": _CHAT,
    "op6_sharding": _SHARD,
    "op7_ngram_jaccard_join": _JOIN,
    "op10_suffix_dedup": _REPEATS,
}
