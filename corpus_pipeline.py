"""A corpus pipeline: toxicity, quality, near duplicates, source mixing, sequence packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. The classifiers learn from ``labels`` outside the held-out fold and from the
documents that the stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.llm.common import materialise
from pulselake.llm.minhash import near_duplicates
from pulselake.llm.mixing import mixed_copies
from pulselake.llm.packing import pack
from pulselake.llm.quality import fit_quality, score_quality
from pulselake.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept``; rows without an id stay."""
    rows = docs.select(*COLUMNS)
    known = rows.filter("doc_id is not null").join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.select(*COLUMNS).union(rows.filter("doc_id is null"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects (score of 0.5 or more).

    A document is judged by all rows of its ``doc_id``, so repeated rows go or stay together;
    rows without an id are kept. Null and empty texts have no evidence and stay; texts of any
    length are read whole; a score of exactly 0.5 rejects; an empty table stays empty; columns
    other than those of ``documents`` are left out, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = materialise(score_toxicity(docs, fit_toxicity(docs, labels)).select("doc_id", "predicted"))
    return _drop(docs, scored.filter("predicted = 1"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (score under 0.3).

    A document is judged by all rows of its ``doc_id``, so repeated rows go or stay together;
    rows without an id are kept. Null and empty texts get the score of no words; texts of any
    length are read whole; a score of exactly 0.3 keeps; an empty table stays empty; columns
    other than those of ``documents`` are left out, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = materialise(score_quality(docs, fit_quality(docs, labels)).select("doc_id", "predicted"))
    return _drop(docs, scored.filter("predicted = 0"))


def _drop(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.filter("doc_id is not null").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the smallest ``doc_id``.

    Rows that repeat a kept ``doc_id`` stay one row; rows without an id are kept. Null, empty
    and blank texts have no shingles and are kept; texts with fewer words are one shingle;
    texts of any length are shingled whole; an empty table stays empty; columns other than
    those of ``documents`` are left out, whatever their names.
    """
    kept = near_duplicates(docs, width=5).filter("kept and doc_id is not null")
    one = _keep(docs, kept)
    return one.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(one.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to twice), in its order; a cut last copy counts if half of it is taken.

    Texts that are null or without words have no size and are never taken; a null source is a
    source of its own; repeated rows and rows without an id are documents of their own; ties
    in the order fall by hash; an empty table stays empty; columns other than those of
    ``documents`` are left out, whatever their names.
    """
    mixed = mixed_copies(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    return mixed.filter(2 * F.col("words") >= F.col("size")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens.

    ``row_id`` tells the copies of a document apart. Null and empty texts are the end id
    alone; longer texts than a sequence are cut into pieces; repeated rows and rows without
    an id are documents of their own; an empty table stays empty; other columns are ignored.
    """
    return pack(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id")), keep=("row_id",))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, hashes and tokens are outside SQL; ``tests/llm`` holds each stage against a plain version of its decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
