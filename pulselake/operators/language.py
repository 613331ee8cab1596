"""A language detector: counts of letter trigrams per language, learnt and applied with aggregates only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Trigrams that a model holds at most, the most frequent ones; languages at most; letters that a text needs.
GRAMS, LANGUAGES, LETTERS = 20_000, 200, 10


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def word_grams(word: Column) -> Column:
    """The trigrams of a word between two spaces, as many as it has letters."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


@dataclass
class Detector:
    """``weights``: (gram, w0, w1, ...), a thousand times the log share of a gram in each of ``languages``; ``default`` is the commonest."""

    languages: list[str]
    weights: DataFrame
    default: str | None


def fit(docs: DataFrame, text: str = "text", language: str = "lang") -> Detector:
    """Learns from documents with a language.

    Words are counted first, so that trigrams are cut from every different word once. Rows
    without a language are left out. The model has ``GRAMS`` rows at most, so it can be broadcast.
    """
    known = docs.filter(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.explode(_words(F.col(text))).alias("word"))
    words = known.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = words.select("lang", "n", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = docs.filter(F.col(language).isNotNull()).groupBy(F.col(language).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(r.lang for r in found)
    of = [F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"c{k}") for k, name in enumerate(languages)]
    wide = counts.groupBy("gram").agg(F.sum("n").alias("n"), *of).orderBy(F.desc("n"), "gram").limit(GRAMS)
    sums = wide.agg(F.count(F.lit(1)).alias("kinds"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"t{k}") for k in range(len(languages))]).first()
    weight = lambda k: F.floor(1000 * F.ln((F.col(f"c{k}") + 1) / F.lit(float(sums[f"t{k}"] + sums["kinds"])))).cast("long").alias(f"w{k}")
    return Detector(languages, wide.select("gram", *[weight(k) for k in range(len(languages))]), found[0].lang if found else None)


def detect(docs: DataFrame, key: str, detector: Detector, text: str = "text") -> DataFrame:
    """(key, language, method) of every row of ``docs``, whose ``key`` is unique.

    The language of the greatest sum of weights over all trigrams of the whole text, the first
    in order of equals (``model``); texts of under ten letters, and those that share no
    trigram with the model, get the commonest language (``default``).
    """
    grams = docs.select(F.col(key).alias("_key"), F.explode(_words(F.col(text))).alias("word")).groupBy("_key", "word").agg(F.count(F.lit(1)).alias("n"))
    grams = grams.select("_key", "n", F.length("word").alias("letters"), F.explode(word_grams(F.col("word"))).alias("gram")).join(F.broadcast(detector.weights), "gram")
    sums = [F.sum(F.col("n") * F.col(f"w{k}")) for k in range(len(detector.languages))]
    scored = grams.groupBy("_key").agg(F.sum("n").alias("known"), *[s.alias(f"s{k}") for k, s in enumerate(sums)])
    ranked = [F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("lang")) for k, name in enumerate(detector.languages)]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0] if ranked else F.struct(F.lit(None).cast("string").alias("lang"))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", ""))
    told = docs.select(F.col(key), (letters >= LETTERS).alias("_long")).join(scored.select("_key", best["lang"].alias("_best")), F.col(key).eqNullSafe(F.col("_key")), "left")
    sure = F.col("_long") & F.col("_best").isNotNull()
    return told.select(key, F.when(sure, F.col("_best")).otherwise(F.lit(detector.default)).alias("language"), F.when(sure, "model").otherwise("default").alias("method"))
