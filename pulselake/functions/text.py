"""Text functions as Spark expressions: cleaning, tags, language gate, normalisation, attack scan."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from pulselake.functions import fixed_values as fixed

_ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def clean_document(text: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """Without boilerplate and page marks, broken words joined, blanks squeezed, ends trimmed."""
    for pattern in (*boilerplate, r"(?i)\bpage\s+\d+\s+(?:of\s+\d+)?\b"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def topic_tags(text: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """The tags whose patterns occur in the lower-cased text, in the table's order."""
    low = F.lower(text)
    hits = [F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(tag)) for tag, ps in (patterns or fixed.TOPIC_PATTERNS).items()]
    return F.array_compact(F.array(*hits))


def slug(name: Column) -> Column:
    """Lower-case letters, digits and underscores only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", "_"), "^_+|_+$", "")


def chunk_id(name: Column, index: Column) -> Column:
    return F.format_string("%s_c%03d", slug(name), index)


def title(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))


def strip_accents(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), _ACCENTS, _PLAIN)


def normalise_prefix(text: Column) -> Column:
    """The part of the normalisation that every SQL engine has: accents, case, leet signs."""
    return F.translate(strip_accents(text), fixed.LEET_SIGNS, fixed.LEET_LETTERS)


@F.pandas_udf(StringType())
def to_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII only; Spark has no function for that."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def normalise(text: Column) -> Column:
    """Text as an attacker meant it: ASCII, lower case, no control characters, leet undone,
    stretched letters cut to two, single letters joined."""
    text = F.regexp_replace(F.lower(to_ascii(text)), r"[\x00-\x1f\x7f-\x9f]", "")
    text = F.translate(text, fixed.LEET_SIGNS, fixed.LEET_LETTERS)
    text = F.regexp_replace(text, r"(.)\1{2,}", "$1$1")
    text = F.regexp_replace(text, r"(?<=\b[a-z])\s+(?=[a-z]\b)", "")
    return F.trim(text)


def attack_category(raw: Column, normalised: Column) -> Column:
    """The first family whose pattern occurs in either form; null if none does."""
    return F.coalesce(*[F.when(raw.rlike(p) | normalised.rlike(p), F.lit(name)) for name, p in fixed.ATTACK_PATTERNS.items()])


def word_set(text: Column) -> Column:
    """Distinct words of a-z in text without accents."""
    return F.array_distinct(F.filter(F.split(strip_accents(text), "[^a-z]+"), lambda w: w != ""))


def query_language(text: Column) -> Column:
    """'es', 'en' or 'other' by marks and word counts; null where those do not tell."""
    words = word_set(text)
    count = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    es, en = count(fixed.SPANISH_WORDS), count(fixed.ENGLISH_WORDS)
    return (
        F.when(text.rlike("[¿¡ñÑ]"), "es")
        .when(count(fixed.FOREIGN_WORDS) > 0, "other")
        .when((es > 0) & (es >= en), "es")
        .when(en > 0, "en")
    )


def approximate_tokens(text: Column) -> tuple[Column, Column]:
    """(words, tokens) of a text, a token being three quarters of a word."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("bigint")
    return words, F.floor(words * F.lit(133) / F.lit(100)).cast("bigint")


def excerpt(text: Column, n: int = 250) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def repaired_json(raw: Column) -> Column:
    """JSON without code fences; an open string and an open object at the end are closed."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    quoted = F.when(text.rlike(r"[^\"}]$"), F.concat(text, F.lit('"'))).otherwise(text)
    count = lambda c: F.length(quoted) - F.length(F.replace(quoted, F.lit(c), F.lit("")))
    return F.when(count("{") > count("}"), F.concat(quoted, F.lit("}"))).otherwise(quoted)
