"""Recursive text splitting into chunks of bounded size with overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def count_words(text: str) -> int:
    return len(re.findall(r"\w+|[^\w\s]", text))


def split_text(text: str, size: int = 400, overlap: int = 160, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of at most ``size`` tokens; each begins with up to ``overlap`` tokens of the one before.

    The text is cut at the first separator that it has; parts that are too long are cut at
    the next one. ``count`` may be any token counter.
    """

    def parts(piece: str, level: int) -> Iterator[tuple[str, int]]:
        n = count(piece)
        if n <= size or level == len(SEPARATORS):
            yield piece, n
            return
        separator = SEPARATORS[level]
        if not separator:
            step = max(1, len(piece) * size // (2 * n))
            for k in range(0, len(piece), step):
                yield piece[k : k + step], count(piece[k : k + step])
            return
        split = piece.split(separator)
        for k, part in enumerate(split):
            if part := part + (separator if k < len(split) - 1 else ""):
                yield from parts(part, level + 1)

    chunks: list[str] = []
    window: list[tuple[str, int]] = []
    total = 0
    for part, n in parts(text, 0):
        if window and total + n > size:
            chunks.append("".join(p for p, _ in window).strip())
            while window and (total > overlap or total + n > size):
                total -= window.pop(0)[1]
        window.append((part, n))
        total += n
    if window:
        chunks.append("".join(p for p, _ in window).strip())
    return chunks


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 400, overlap: int = 160) -> DataFrame:
    """(key, chunk_index, chunk, token_count): blank chunks are left out but keep their index. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(k, i, c, count_words(c)) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, c in enumerate(split_text(t or "", size, overlap)) if c]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[key, "chunk_index", "chunk", "token_count"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{key} long, chunk_index int, chunk string, token_count int")
