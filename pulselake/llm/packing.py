"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulselake.llm.common import materialise, ranked, text_slices

#: Bytes of remembered words, about, after which a worker forgets them all; longer words are not remembered.
MEMORY_BYTES, LONGEST = 128 << 20, 48
#: Bytes of text whose words are looked up together (one document at least).
SLICE_BYTES = 2 << 20
#: Pieces of one length that a task ranks, about.
RANK_ROWS = 1 << 18
#: A word with the space before it, or blanks up to the one that a word follows.
_PARTS = re.compile(r" ?\S+|\s+?(?=\s\S|\Z)|\s")
#: Signs that are blanks in Python only, and with them all blanks outside ASCII.
_ODD = re.compile("[\x1c-\x1f]")
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True
_SIGN, _LETTER, _LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True  # second bytes of letters after 0xC3


def split_parts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The parts (``_PARTS``) of all texts one after the other, and how many each text has.

    Joined, they are the texts. Bounds come from the bytes; signs of ASCII after a letter of ASCII or
    Latin-1 begin a part of their own. Texts with blanks outside ASCII are cut by the pattern alone.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.cumsum([0, *map(len, raw)])
    blank = _BLANK[data]
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[edges[:-1]] = True
    ends[edges[1:] - 1] = True  # -1, for empty texts in front, is the place after all
    begins, ends = begins[:-1], ends[:-1]
    after_blank, after_space = np.zeros(len(data), bool), np.zeros(len(data), bool)
    after_blank[1:], after_space[1:] = blank[:-1], data[:-1] == 0x20
    before_word = np.zeros(len(data), bool)
    before_word[:-1] = ~blank[1:]
    starts = begins | blank & (~after_blank | before_word & ~ends) | ~blank & after_blank & ~after_space
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    starts[1:] |= letter[:-1] & _SIGN[data[1:]]
    for k, text in enumerate(texts):
        if not text.isascii() and _RARE.search(text):
            sizes = [len(part.encode()) for part in _PARTS.findall(text)]
            starts[edges[k] : edges[k + 1]] = False
            starts[edges[k] + np.cumsum([0, *sizes[:-1]])] = True
    at = np.flatnonzero(starts)
    parts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
    return parts, np.diff(np.searchsorted(at, edges))


class WordTokenizer:
    """Token ids of whole texts by a byte-level BPE tokenizer, with a memory of words.

    Pre-tokens of such a vocabulary never reach from a visible sign to a blank, nor from a
    blank other than a space to a visible sign, nor from a letter to a sign, so a text may be
    cut there. The distinct parts of several texts are looked up or encoded alone. Texts that
    hold an added token's content are encoded whole. The ids are those of ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        [self._line_end] = self._tokenizer.encode("\n", add_special_tokens=False).ids
        vocabulary = self._tokenizer.get_vocab()
        self._spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self._spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # a space, as such vocabularies write it
        self._memory: dict[str, bytes] = {}
        self._bytes = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they are, as little-endian unsigned 32-bit numbers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words and blanks. Words are encoded many at a time: where they begin with a space, the tokens
        that do so tell them apart; others are put one a line, where a line's end is a token of its own."""
        blank = [w for w in words if w.isspace()]
        found = dict(zip(blank, self.encode(blank)))
        for end, some in (("", [w for w in words if w[0] == " " and not w.isspace()]), ("\n", [w for w in words if w[0] != " " and not w.isspace()])):
            lines = [some[k : k + 1000] for k in range(0, len(some), 1000)]
            for line, joined in zip(lines, self._tokenizer.encode_batch_fast([end.join(line) + end for line in lines], add_special_tokens=False)):
                ids = np.array(joined.ids, "<u4")
                edges = 4 * np.flatnonzero(np.append(ids == self._line_end, False) if end else np.append(self._spaced[ids], True))
                starts, ends = ([0, *(edges[:-1] + 4).tolist()], edges.tolist()) if end else (edges[:-1].tolist(), edges[1:].tolist())
                data = ids.tobytes()
                found.update((word, data[i:j]) for word, i, j in zip(line, starts, ends, strict=True))
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self._bytes > MEMORY_BYTES:
            self._memory, self._bytes = {}, 0
        memory = self._memory
        odd = [any(a in t for a in self._added) or _ODD.search(t) is not None for t in texts]
        whole = iter(self.encode([t for t, o in zip(texts, odd) if o]))
        parts, counts = split_parts(["" if o else t for t, o in zip(texts, odd)])
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [memory.get(w) for w in words]
        new = self.encode_words([w for w, ids in zip(words, known) if ids is None])
        for word, ids in new.items():
            if len(word) <= LONGEST:
                memory[word] = ids
                self._bytes += 200 + len(word) + len(ids)
        found = pa.array([new[w] if ids is None else ids for w, ids in zip(words, known)], pa.large_binary()).take(coded.indices)
        if not len(found):
            return [next(whole) if o else b"" for o in odd]
        data, bounds = memoryview(found.buffers()[2] or b""), np.frombuffer(found.buffers()[1], np.int64)
        edges = bounds[np.cumsum([0, *counts])].tolist()
        return [next(whole) if o else bytes(data[i:j]) for o, i, j in zip(odd, edges, edges[1:])]


@lru_cache(maxsize=1)
def word_tokenizer(vocabulary: str) -> WordTokenizer:
    """The tokenizer of a worker process, which keeps its memory from task to task."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    return WordTokenizer(public_tokenizers.path(vocabulary))


def piece_bounds(length: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one if it fits, else windows after a shorter first piece."""
    if length <= window:
        return [(0, length)]
    first = length % window
    starts = ([0] if first else []) + list(range(first, length, window))
    return [(s, (first if first and s == 0 else window)) for s in starts]


def tokenize_pieces(docs: DataFrame, window: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document; null text is empty.

    ``vocabulary`` names the tokenizer's file, which every executor finds through
    ``public_tokenizers``. ``keep`` names integer columns to carry along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokenizer(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                out: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
                for row, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, window)):
                        part_ids = ids[4 * start : 4 * (start + length)]
                        for name, value in zip(out, (row, piece, start, length, zlib.crc32(part_ids), part_ids)):
                            out[name].append(value)
                rows = pa.array(out["row"], pa.int64())
                columns = [part.column(0).take(rows), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids_crc32"], pa.int64())]
                columns += [part.column(2 + k).take(rows) for k in range(len(keep))]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *keep] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {c} long" for c in keep) + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("long") for c in keep]).mapInArrow(run, schema)


def plan_best_fit(counts: dict[int, int], window: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, n, first sequence, offset).

    Items of one length are placed together: into the open sequences with the least
    sufficient room, then into new sequences, in each case as many per sequence as fit. That is
    what placing one item after the other gives, as a sequence that has just taken an item has
    the least sufficient room if it has any.
    The work and the number of rows depend on the window, not on the number of items.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, n)
    rooms: list[int] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            first, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, window - room + k * length))
                rank += full
            put(room - each * length, first, full)
            left -= full * each
            over = left if full < n else 0  # too few for one more sequence to take all it can
            for k in range(over):
                plan.append((length, rank + k, 1, first + full, window - room + k * length))
            put(room - over * length, first + full, 1 if over else 0)
            put(room, first + full + (over > 0), n - full - (over > 0))
            rank, left = rank + over, left - over
        if left:
            each = window // length
            full, rest = divmod(left, each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, sequences, k * length))
                rank += full
            put(window - each * length, sequences, full)
            sequences += full
            for k in range(rest):
                plan.append((length, rank + k, 1, sequences, k * length))
            if rest:
                put(window - rest * length, sequences, 1)
                sequences += 1
    return plan


def pack(docs: DataFrame, window: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each is packed at.

    One pass tokenizes and keeps only the pieces' lengths and checksums. The histogram
    of lengths (at most ``window`` rows) is planned on the driver; pieces take the planned
    slots by their rank within their length. A length is ranked in as many hash buckets as
    its count asks for (``RANK_ROWS`` a bucket), so a length that most pieces have is spread
    over many tasks. The plan has a number of rows that the window bounds; every task looks
    its pieces up in it by binary search.

    Null or empty text is the end id alone; equal or null ``doc_id`` and repeated rows are
    documents of their own; very long texts are cut into pieces like others; empty input
    gives an empty result; other columns are ignored, whatever their names, but integer
    columns named in ``keep`` come along.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenize_pieces(docs, window, end_id, vocabulary, keep=keep))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(plan_best_fit(counts, window), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    buckets = spark.createDataFrame([(n, 1 + c // RANK_ROWS) for n, c in counts.items()], "length long, _buckets long")
    placed = ranked(pieces.join(F.broadcast(buckets), "length"), ["length"], ["doc_id", "piece", "ids_crc32"], "rank", buckets=F.col("_buckets"))
    shared = spark.sparkContext.broadcast(plan)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        first_of = plan[:, 0] * (1 << 48) + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(first_of, length * (1 << 48) + rank, side="right") - 1
            sequence, offset = plan[at, 3] + rank - plan[at, 1], plan[at, 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *keep]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {c} long" for c in keep) + ", sequence_id long, offset long"
    return placed.select(*columns, F.col("rank").cast("long")).mapInArrow(seat, schema)
