"""Text as retrieval sees it, in Column expressions only.

A token is a run of ASCII letters, digits and parentheses, lower-cased, that isn't a stop word. Extraction comes before
lower-casing: the other way round, characters such as the Kelvin sign would turn into ASCII letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9()]+"
STOP_WORDS = tuple(
    sorted(
        "would should might may been being had having did does do could can those these this how who which where when what "
        "with will was to the that on of its it is in he has from for by be at as are an a".split()
    )
)


def raw_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def without_stop_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The tokens of a text in order, repeats included; null for a null text."""
    return without_stop_words(raw_tokens(text), stop_words)


def preprocess(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The tokens joined by single spaces; applying it twice changes nothing."""
    return F.array_join(tokens(text, stop_words), " ")


def truncate_words(text: Column, n: int = 256) -> Column:
    """The first n words, separated by ASCII white space, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)), 1, n), " ")


def shard_id(term: Column, shards: int = 64) -> Column:
    """The first 32 bits of the term's MD5 modulo the shards: a placement that any system can work out."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def basic_tokens(text: Column) -> Column:
    """The first step of WordPiece: ASCII lower case, control characters dropped, each ASCII mark a token."""
    spaced = F.regexp_replace(text, r"[\t\n\r]", " ")
    clean = F.regexp_replace(spaced, r"[\x00-\x1F\x7F]", "")
    lower = F.translate(clean, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[!-/:-@\[-`{-~]|[^ !-/:-@\[-`{-~]+"), F.lit(0))
