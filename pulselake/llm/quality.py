"""Quality classifier: random-indexing word vectors, pooled per document, and a small network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulselake.llm.common import text_slices
from pulselake.llm.learning import FIT_ROWS, Network, emit_blocks, held_out, labelled_sample, sum_blocks
from pulselake.llm.shingles import Shingler

WORDS = 8192  # hash buckets of words
SHAPES = 180
DIMENSIONS = 48
_SPARSE = 2  # non-zero entries of an index vector
_WINDOW = 2
_IDS = WORDS + SHAPES
_rng = np.random.default_rng(99)
_PLACES = _rng.integers(0, DIMENSIONS, (_IDS, _SPARSE))
_SIGNS = _rng.choice([-1.0, 1.0], (_IDS, _SPARSE))
#: Kinds of last bytes: letters, points, marks of exclamation and question, digits, others.
_KIND = np.full(256, 4)
_KIND[list(b".,;:)'\"")], _KIND[list(b"!?")], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 0, 0, 0
#: Index vectors as rows. Sums over a window fit a byte.
_INDEX = np.zeros((_IDS, DIMENSIONS), np.int8)
np.add.at(_INDEX, (np.arange(_IDS)[:, None], _PLACES), _SIGNS.astype(np.int8))
#: Two sums share a float: the second is counted in lanes, which no sum over a block of words fills by half.
_LANE, _BLOCK = float(1 << 26), 1 << 20
#: Bytes of text that are read at once (one document at least), so that the arrays stay in a core's cache.
SLICE_BYTES = 128 << 10


@dataclass
class Words:
    """The words of several texts: hash bucket, shape, text number; and per text sums of simple counts."""

    ids: np.ndarray
    shapes: np.ndarray
    of: np.ndarray
    hashes: np.ndarray


class Reader:
    """Words and their shapes (case, last character, length, repetition) of whole texts, in numpy."""

    def __init__(self):
        self._shingler = Shingler(1)

    def __call__(self, texts: list[str | None]) -> Words:
        hashes, of = self._shingler.words(texts)
        data = np.frombuffer(b" ".join((t or "").encode("utf-8", "replace") for t in texts) + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
        start, end = edge[::2], edge[1::2]
        before = np.concatenate(([0], data[:-1]))
        upper = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E))
        lower = ((data >= 97) & (data <= 122)) | ((before == 0xC3) & (data >= 0x9F) & (data <= 0xBF))
        count = lambda mask: (s := np.concatenate(([0], np.cumsum(mask))))[end] - s[start]
        n_upper, n_lower = count(upper), count(lower)
        case = np.where((n_upper >= 2) & (n_lower == 0), 2, (n_upper > 0).astype(int))
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        kind = _KIND[last]
        size = np.searchsorted([2, 4, 7, 11, 21], end - start, side="right")
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])))[: len(hashes)]
        shapes = ((case * 5 + kind) * 6 + size) * 2 + same
        return Words((hashes >> np.uint64(51)).astype(np.int64), shapes, of, hashes)


def _surroundings(words: Words) -> np.ndarray:
    """A row per word: the sum of the index vectors of the words and shapes up to two words away in its text."""
    index = _INDEX.take(words.ids, axis=0) + _INDEX.take(words.shapes + WORDS, axis=0)
    around = np.zeros_like(index)
    for step in range(1, _WINDOW + 1):
        around[:-step] += index[step:]
        around[step:] += index[:-step]
        apart = np.flatnonzero(words.of[step:] != words.of[:-step])
        around[apart] -= index[apart + step]
        around[apart + step] -= index[apart]
    return around


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all word buckets and shapes from the contexts in all documents.

    Every id has a sparse random index vector; an id's vector is the sum of the index
    vectors of the words and shapes up to two words away. Tasks emit sums of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, total, half = Reader(), np.zeros((DIMENSIONS, _IDS)), DIMENSIONS // 2
        for batch in batches:
            for part in text_slices(batch, 0, SLICE_BYTES):
                words = read(part.column(0).to_pylist())
                around = _surroundings(words)
                for at in range(0, len(around), _BLOCK):
                    some = slice(at, at + _BLOCK)
                    lanes = np.ascontiguousarray(around[some].T).astype(np.float64)
                    lanes = lanes[:half] + lanes[half:] * _LANE
                    sums = np.array([np.concatenate((np.bincount(words.ids[some], v, WORDS), np.bincount(words.shapes[some], v, SHAPES))) for v in lanes])
                    high = np.rint(sums / _LANE)
                    total[:half] += sums - high * _LANE
                    total[half:] += high
        yield emit_blocks(np.rint(total.T).astype(np.int64))

    partials = docs.select(F.col("text").cast("string")).mapInArrow(run, "block int, values binary")
    sums = sum_blocks(partials, (_IDS, DIMENSIONS)).astype(np.float64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), 0)
    return (unit - unit[norm[:, 0] > 0].mean(axis=0) * (norm > 0) if (norm > 0).any() else unit).astype(np.float32)


def pooled(read: Reader, texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row per text: means of its word and shape vectors, shares of distinct and repeated words and of shapes, length."""
    words = read(texts)
    n = np.bincount(words.of, minlength=len(texts)).astype(np.float64)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 12))
    if not len(words.of):
        return out
    first = np.flatnonzero(np.concatenate(([True], words.of[1:] != words.of[:-1])))
    at, edges = words.of[first], [*first.tolist(), len(words.of)]
    counts = np.bincount(words.of * SHAPES + words.shapes, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)[at]
    out[at, :DIMENSIONS] = [vectors.take(words.ids[i:j], axis=0).sum(axis=0) for i, j in zip(edges, edges[1:])] / n[at, None]
    out[at, DIMENSIONS : 2 * DIMENSIONS] = counts @ vectors[WORDS:].astype(np.float64) / n[at, None]
    distinct = np.array([1 + np.count_nonzero(np.diff(np.sort(words.hashes[i:j]))) for i, j in zip(edges, edges[1:])])
    shape = np.arange(SHAPES)
    case, kind, same = shape // 60, shape // 12 % 5, shape % 2
    share = lambda mask: counts[:, mask].sum(axis=1) / n[at]
    extra = [np.log1p(n[at]), distinct / n[at], share(same == 1), share(case == 1), share(case == 2)]
    extra += [share(kind == k) for k in range(5)] + [distinct / np.sqrt(n[at]), share(shape // 2 % 6 >= 4)]
    out[at, 2 * DIMENSIONS :] = np.stack(extra, axis=1)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and a network fitted on at most about ``rows`` labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                features = pooled(read, part.column(1).to_pylist(), shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f.tobytes() for f in features], pa.binary())], names=["doc_id", "label", "features"])

    sample = labelled_sample(docs, labels, "quality", rows).mapInArrow(run, "doc_id long, label int, features binary").toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    x = np.array([np.frombuffer(f.as_py(), np.float32) for f in sample["features"]], np.float64).reshape(len(order), 2 * DIMENSIONS + 12)[order]
    return vectors, Network().fit(x, sample["label"].to_numpy()[order].astype(np.float64))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by its whole text alone. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (vectors, network) = Reader(), shared.value
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                scores = network.score(pooled(read, part.column(1).to_pylist(), vectors))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on the training fold of ``labels`` and score every document.

    Null and empty texts pool to zeros and get the network's score for that; a null
    ``doc_id`` is scored like any other and not held out; repeated rows are scored alike;
    without labels, or with labels of one kind, the score is a constant; empty input gives
    an empty result; other columns are ignored.
    """
    return score_quality(docs, fit_quality(docs, labels), threshold)
