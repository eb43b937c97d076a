"""Text expressions: tokens, slugs, sentences, overlap, citations.  All are Column builders that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as fenced code, as a citation at an answer's end, as an endpoint path and as a heading.  Other
#: patterns would find other things.
FENCE = r"(?s)```[a-zA-Z]*[ \t]*\n?(.*?)```"
CITATION = r"\s*\[chunk:([^\]]+)\]\s*$"
ENDPOINT = r"/v\d+/[A-Za-z0-9_\-/{}]*[A-Za-z0-9_}]"
HEADING = r"^(#{1,6})\s+(.*)$"


def _some(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def tokens_simple(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; anything else separates."""
    return _some(F.split(F.lower(text), "[^a-z0-9]+"))


def symbols(text: Column) -> Column:
    """Identifiers as they stand: words with ``.``, ``-`` or ``_`` in them are one."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+(?:[.\-][a-z0-9_]+)*"), F.lit(0))


def symbol_parts(word: Column) -> Column:
    """An identifier and, where it has several parts, the parts too.  Plain words, which most are, aren't taken apart."""
    parts = _some(F.split(word, r"[._\-]"))
    return F.when(F.rlike(word, F.lit(r"[._\-]")), F.when(F.size(parts) > 1, F.concat(F.array(word), parts)).otherwise(F.array(word))).otherwise(F.array(word))


def tokens_symbol(text: Column) -> Column:
    """Identifiers whole (``a_b``, ``x-y``, ``v1.2``) and, where they have several parts, the parts too."""
    return F.flatten(F.transform(symbols(text), symbol_parts))


def tokens_space(text: Column) -> Column:
    """Lower-case runs of anything but white space, punctuation kept."""
    return _some(F.split(F.lower(text), r"\s+"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def sentences(text: Column) -> Column:
    """Pieces that end at ``. ! ?`` and white space, or at a line's end; runs of blanks count as one."""
    # single blanks, which most are, stay as they are
    pieces = F.split(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"(?<=[.!?])\s+|\n+")
    return _some(F.transform(pieces, lambda s: F.when(F.rlike(s, F.lit(r"^\s|\s$")), F.regexp_replace(s, r"^\s+|\s+$", "")).otherwise(s)))


def word_count(text: Column) -> Column:
    return F.size(_some(F.split(text, r"\s+")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` and its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct simple tokens that the text has; 0 without any."""
    # a text's tokens between single blanks: looking words up there takes no arrays
    spread = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    found = lambda q, t: F.size(F.filter(q, lambda w: F.contains(t, F.concat(F.lit(" "), w, F.lit(" ")))))
    return let(F.array_distinct(tokens_simple(question)), lambda q: let(spread, lambda t: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(found(q, t) / F.greatest(F.size(q), F.lit(1)))))


def split_citation(answer: Column) -> tuple[Column, Column]:
    """(body, cited chunk or null) of an answer that may end in ``[chunk:ID]``."""
    return F.regexp_replace(answer, CITATION, ""), F.nullif(F.regexp_extract(answer, CITATION, 1), F.lit(""))


def fences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def endpoint_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(0))


def page_title(path: Column) -> Column:
    """Title from a file name: the stem, underscores as spaces, initials upper-case."""
    return F.initcap(F.replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" ")))


def fingerprint(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; the cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
