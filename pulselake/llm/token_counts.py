"""Token counts of whole texts, kept in a cache by digests of content and tokenizer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulselake.llm.common import materialise
from pulselake.llm.packing import WordTokenizer

#: Remembered units of a worker, after which it forgets them all; longer units are not remembered.
MEMORY_UNITS, LONGEST = 1 << 20, 48
#: Texts that are counted at once.
BATCH = 200
#: Raised when the way of counting changes, so that older counts are no longer used.
REVISION = "1"
_MARK = "▁"  # stands for a space inside the vocabulary
_UNITS = re.compile(f"[ {_MARK}]*[^ {_MARK}]+|[ {_MARK}]+")


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class PieceCounter:
    """Numbers of pieces that a sentencepiece model gives whole texts, with a memory of units.

    Where no piece holds a space mark behind another sign, no merge reaches across such a
    place, so a text may be cut there: into spaces with the signs that follow them. Models that
    normalise, that have pieces of their users' own or other kinds of pieces encode whole texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self._model = SentencePieceProcessor(model_file=path)
        kinds = sentencepiece_model_pb2.ModelProto()
        kinds.ParseFromString(Path(path).read_bytes())
        signs, trained = kinds.normalizer_spec, kinds.trainer_spec
        plain = signs.escape_whitespaces and signs.add_dummy_prefix and not signs.remove_extra_whitespaces and not signs.precompiled_charsmap
        own = any(p.type == p.USER_DEFINED for p in kinds.pieces)
        across = any(_MARK in p.piece.lstrip(_MARK) for p in kinds.pieces)
        self.by_units = bool(plain and not own and not across and trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix)
        with_space, without = self.whole(["a ", "a"])
        self._space = with_space - without
        self._memory: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self._model.encode(texts, num_threads=1)]

    def _units(self, units: list[str]) -> dict[str, int]:
        """A unit begins with a space; the model puts that in front by itself."""
        found = dict(zip(units, self.whole([u[1:] for u in units])))
        return found | {u: self._space for u in (" ", _MARK) if u in found}  # of these nothing is left to encode

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_units:
            return self.whole(texts)
        if len(self._memory) > MEMORY_UNITS:
            self._memory = {}
        memory = self._memory
        parts = [_UNITS.findall(" " + t) if t else [] for t in texts]
        new = self._units([u for u in {u for units in parts for u in units} if u not in memory])
        long = {u: n for u, n in new.items() if len(u) > LONGEST}
        memory.update((u, n) for u, n in new.items() if u not in long)
        get = (lambda u: long[u] if u in long else memory[u]) if long else memory.__getitem__
        return [sum(map(get, units)) for units in parts]


@lru_cache(maxsize=2)
def token_counter(vocabulary: str):
    """The counter of a worker process: sentencepiece for ``.model``, tokenizers for ``.json``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    if vocabulary.endswith(".model"):
        return PieceCounter(_path(vocabulary))
    encode = WordTokenizer(_path(vocabulary))
    return lambda texts: [len(ids) // 4 for ids in encode(texts)]


def tokenizer_digest(vocabulary: str) -> str:
    """SHA-256 of the vocabulary's file and of the way of counting."""
    return hashlib.sha256(REVISION.encode() + Path(_path(vocabulary)).read_bytes()).hexdigest()


def normalised(text: Column, vocabulary: str) -> Column:
    """Text in a form that all texts of equal tokens may share: null is empty, and a piece
    vocabulary's space mark is a space."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(known, _MARK, " ") if vocabulary.endswith(".model") else known


def encode_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer; one row a digest, though two writers may have appended it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/version={version}")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted_tokens(docs: DataFrame, cache: str, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; only contents that ``cache`` lacks are encoded.

    ``cache`` is a shared folder of (digest, n_tokens), one subfolder a tokenizer digest.
    Digests of the normalised texts are looked up in it; of those that it lacks, one text
    each is encoded, and the counts are appended; then every document takes its count from
    the cache. Texts are shuffled only where they are missing, one a task and digest: Spark
    moves the search for missing digests below the choice of texts if they are few enough to
    broadcast. Copies of one text meet as digests only, in a join that may split them.

    Null text is empty and has no tokens; texts of any length are counted whole; repeated rows
    and null ids keep their rows; no text is null or too short for the cache; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    content = normalised(F.col("text"), vocabulary)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    keyed = materialise(docs.select(F.col("doc_id").cast("long"), n_bytes, digest))
    misses = materialise(keyed.select("digest").distinct().join(stored_counts(spark, cache, version), "digest", "left_anti"))
    texts = docs.select(digest, content.alias("text")).groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")
    encode_counts(texts, vocabulary).write.mode("append").parquet(f"{cache}/version={version}")
    counts = materialise(stored_counts(spark, cache, version))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
