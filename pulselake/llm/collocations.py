"""Phrase collocations: shards mined at lowered support, their unions counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pulselake.llm.common import materialise

#: Bytes of text that a task works on at once (one document at least).
SLICE_BYTES = 2 << 20
#: Sums that a task holds, about, and bytes of text whose sums may meet in one group.
TALLY, GROUP_BYTES = 1 << 20, 8 << 20
#: Bits of the broadcast filters at most; 16 bits a key below that.
FILTER_BITS = 1 << 27
LONGEST = 4
_BREAK, _BLANK = 0xFF, 0x20  # 0xFF is in no UTF-8 text
_SIGNS = bytearray(range(256))
_SIGNS[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
for _sign in b".,;:!?\n\x0b\x0c\r":
    _SIGNS[_sign] = _BREAK
_SIGNS[ord("\t")] = _BLANK
_SIGNS = bytes(_SIGNS)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hashes of a large_binary array without nulls."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    longest = int(sizes.max()) if len(sizes) else 0
    powers = np.cumprod(np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])))
    return mixed(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]])


class Words:
    """The words of some texts: ``ids`` into ``vocabulary``, the piece and the document of each word."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        signs = np.frombuffer(b"\xff".join(texts).translate(_SIGNS), np.uint8)
        breaks = signs == _BREAK
        inside = ~(breaks | (signs == _BLANK))
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(signs[inside])])
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy(), coded.dictionary
        self.piece = np.cumsum(breaks)[starts] if len(starts) else np.zeros(0, np.int64)
        self.document = np.searchsorted(np.cumsum(sizes), starts, side="right")


    def keys(self, languages: np.ndarray) -> np.ndarray:
        """A key per word that holds the language of its document as well."""
        return mixed(hashed(self.vocabulary)[self.ids] ^ languages[self.document])

    def grams(self, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the runs of ``width`` words, and whether each lies within a piece."""
        found = keys
        for k in range(1, width):
            found = mixed(found[: len(keys) - k] * np.uint64(0x9E3779B97F4A7C15) + keys[k:])
        return found, self.piece[: len(found)] == self.piece[width - 1 :]

    def phrases(self, first: np.ndarray, width: int) -> pa.Array:
        """The runs of ``width`` words that begin at ``first``, joined by spaces."""
        parts = [self.vocabulary.take(pa.array(self.ids[first + k])) for k in range(width)]
        return parts[0] if width == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """The texts (first column, binary) with their rows, some ``SLICE_BYTES`` at a time; a document is never cut."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for row, text in enumerate(batch.column(0)):
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= SLICE_BYTES or row + 1 == batch.num_rows:
                yield texts, batch.slice(first, row + 1 - first)
                texts, size, first = [], 0, row + 1


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for keys that the filter may hold, and for all that it does."""
    size = np.uint64(64 * len(bits) - 1)
    has = lambda p: (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    found = has(keys & size)
    at = np.flatnonzero(found)
    found[at] = has((keys[at] >> np.uint64(32)) & size)
    return found


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of a two-hash filter of the column ``key``: a power of two, 16 a key, ``FILTER_BITS`` at most.

    More keys fill it further, so that more phrases than wanted are counted, and none is lost.
    """
    size = min(FILTER_BITS, max(1 << 13, 1 << (16 * keys.count()).bit_length()))
    spots = keys.select(F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 32))).alias("spot")).select(F.col("spot").bitwiseAND(size - 1).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def _languages(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names, code of each row, hash of each row's name) of the column ``lang``."""
    coded = rows.column("lang").dictionary_encode()
    codes = coded.indices.to_numpy()
    return coded.dictionary, codes, hashed(coded.dictionary.cast(pa.large_binary()))[codes]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n) of all words of ``docs`` (text, lang, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in slices(batches):
            words = Words(texts)
            names, codes, seeds = _languages(rows)
            size = max(1, len(words.vocabulary))
            pairs, n = np.unique(codes[words.document].astype(np.int64) * size + words.ids, return_counts=True)
            lang, word = pairs // size, pa.array(pairs % size)
            seed = hashed(names.cast(pa.large_binary()))[lang]
            found = words.vocabulary.take(word)
            keys = mixed(hashed(found) ^ seed)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), found.cast(pa.large_string()).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "word", "key", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(run, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


def _summed(keys: np.ndarray, shards: np.ndarray, n: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns with ``n`` summed per key and shard; the others are the same for all rows of a key and shard."""
    order = np.argsort(keys ^ mixed(shards.astype(np.uint64)))
    keys, shards, n = keys[order], shards[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (shards[1:] != shards[:-1]))))
    return keys[first], shards[first], np.add.reduceat(n, first) if len(keys) else n, *[c[order[first]] for c in rest]


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of the equal ranges of the keys (a power of two) each is in."""
    return (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)


_PACKED = {"keys": np.uint64, "shards": np.uint16, "n": np.int64, "supports": np.int32}
_SCHEMA = pa.schema([("range", pa.int64()), *[(c, pa.binary()) for c in _PACKED]])


def mine_shards(docs: DataFrame, least: int, ranges: int, widths: tuple[int, ...], frequent_words: np.ndarray, pairs: np.ndarray | None = None) -> DataFrame:
    """(key): phrases of ``widths`` words that reach the ``support`` of a shard in it, and ``least`` in all shards together.

    A shard is mined completely: runs with a word that is not frequent, or (where ``pairs``
    are given) with a pair that was not found, cannot be frequent themselves. A task
    sums what it reads of each shard as far as ``TALLY`` allows and packs its sums by range
    of the keys; there are as many ranges (a power of two) as keep what meets in one bounded.
    A range meets the sums of all shards, so the total of each key is known there.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent_words, pairs))

    def pack(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)] if held else [np.zeros(0, k) for k in _PACKED.values()]
        columns = _summed(*columns)
        order = np.argsort(columns[0])
        columns = [c[order].astype(k) for c, k in zip(columns, _PACKED.values())]
        of = _ranges(columns[0], ranges)
        edges = np.concatenate((np.flatnonzero(np.diff(of, prepend=-1)), [len(of)])).tolist()
        cut = [[c[i:j].tobytes() for i, j in zip(edges, edges[1:])] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(of[edges[:-1]]), *[pa.array(c, pa.binary()) for c in cut]], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, pairs = shared.value
        held, size = [], 0
        for texts, rows in slices(batches):
            words = Words(texts)
            keys = words.keys(_languages(rows)[2])
            shard, support = (rows.column(c).to_numpy()[words.document] for c in ("shard", "support"))
            usable = among(frequent_words, keys)
            if pairs is not None:
                pair, inside = words.grams(keys, 2)
                paired = inside & usable[: len(pair)] & usable[1:]
                paired[paired] = among(pairs, pair[paired])
            for width in widths:
                gram, inside = words.grams(keys, width)
                for k in range(width) if pairs is None else range(width - 1):
                    inside &= (usable if pairs is None else paired)[k : k + len(gram)]
                at = np.flatnonzero(inside)
                held.append(_summed(gram[at], shard[at], np.ones(len(at), np.int64), support[at]))
                size += len(held[-1][0])
            if size > TALLY:
                yield pack(held)
                held, size = [], 0
        yield pack(held)

    def add(_: tuple, table: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in _PACKED.items()]
        keys, _, n, supports = _summed(*columns)
        found = np.unique(keys[n >= supports])
        at = np.searchsorted(found, keys)
        same = np.flatnonzero(found[np.minimum(at, len(found) - 1)] == keys) if len(found) else np.zeros(0, np.int64)
        total = np.bincount(at[same], n[same], len(found))
        return pa.table({"key": pa.array(found[total >= least].view(np.int64))})

    packed = docs.select(F.col("text").cast("binary").alias("text"), "lang", "shard", "support").mapInArrow(run, "range long, " + ", ".join(f"{c} binary" for c in _PACKED))
    return packed.groupBy("range").applyInArrow(add, "key long")


def count_phrases(docs: DataFrame, least: int, ranges: int, widths: tuple[int, ...], frequent_words: np.ndarray, candidates: np.ndarray) -> DataFrame:
    """(lang, phrase, width, n): exact counts over all of ``docs``, from ``least``, of the phrases that ``candidates`` may hold.

    Tasks sum phrases, not keys, and hand over their sums of a language in lists by range of the keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent_words, candidates))
    schema = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def summed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(parts, schema).group_by(["range", "lang", "phrase"]).aggregate([("n", "sum")])
        return table.rename_columns(schema.names).cast(schema).combine_chunks().to_batches()

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in (part for part in held if part.num_rows):
            sums = sums.sort_by([("range", "ascending"), ("lang", "ascending")])
            lang = sums.column("lang").dictionary_encode().indices.to_numpy()
            of = sums.column("range").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (lang[1:] != lang[:-1]))))
            edges = pa.array(np.append(first, len(of)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, sums.column(c)) for c in ("phrase", "n")]
            yield pa.RecordBatch.from_arrays([*[sums.column(c).take(pa.array(first)) for c in ("range", "lang")], *lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, candidates = shared.value
        held, last = [], 0
        for texts, rows in slices(batches):
            words = Words(texts)
            langs, codes, seeds = _languages(rows)
            keys = words.keys(seeds)
            usable = among(frequent_words, keys)
            for width in widths:
                gram, inside = words.grams(keys, width)
                for k in range(width):
                    inside &= usable[k : k + len(gram)]
                inside[inside] = among(candidates, gram[inside])
                at = np.flatnonzero(inside)
                _, first, group, n = np.unique(gram[at], return_index=True, return_inverse=True, return_counts=True)
                same = codes[words.document[at]] == codes[words.document[at[first]]][group]
                for k in range(width):
                    same &= words.ids[at + k] == words.ids[at[first] + k][group]
                odd = at[~same]  # two phrases of one key: counted one by one
                n = n - np.bincount(group[~same], minlength=len(n))
                for where, count in ((at[first], n), (odd, np.ones(len(odd), np.int64))):
                    phrase = words.phrases(where, width).cast(pa.large_string()).cast(pa.string())
                    lang = langs.take(pa.array(codes[words.document[where]])).cast(pa.string())
                    held.append(pa.RecordBatch.from_arrays([pa.array(_ranges(gram[where], ranges)), lang, phrase, pa.array(count)], schema=schema))
            if sum(b.num_rows for b in held) > last + (1 << 18):
                held = summed(held)
                last = sum(b.num_rows for b in held)
                if last > 1 << 20:
                    yield from pack(held)
                    held, last = [], 0
        yield from pack(summed(held))

    def add(keys: tuple, table: pa.Table) -> pa.Table:
        sums = pa.table({c: pc.list_flatten(table[c]) for c in ("phrase", "n")}).group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
        width = pc.add(pc.count_substring(sums["phrase"], " "), 1).cast(pa.int32())
        return pa.table({"lang": pa.array([keys[1].as_py()] * len(sums), pa.string()), "phrase": sums["phrase"], "width": width, "n": sums["n_sum"]})

    packed = docs.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(run, "range long, lang string, phrase array<string>, n array<long>")
    return packed.groupBy("range", "lang").applyInArrow(add, "lang string, phrase string, width int, n long")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST, shards: int = 8) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, n) of all phrases of up to ``longest`` words with ``n >= least``, and (lang, n) of all words.

    Documents are dealt to ``shards`` by a hash of their text. A phrase that is frequent
    overall reaches, in one shard at least, the support that falls to that shard by its share
    of its language's bytes; so the phrases that do so in some shard hold all wanted ones. Those
    whose hashed counts of all shards reach ``least`` are counted exactly in all documents. Pairs are mined first, and longer phrases only where
    all their pairs were found.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    bytes_ = rows.groupBy("lang", "shard").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    in_all = bytes_.withColumn("total", F.greatest(F.sum("bytes").over(Window.partitionBy("lang")), F.lit(1)))
    support = F.expr(f"greatest((cast(bytes as decimal(20,0)) * {int(least)} + total - 1) div total, 1)")
    supports = materialise(in_all.select("lang", "shard", "bytes", support.cast("int").alias("support")))
    size = supports.agg(F.sum("bytes")).first()[0] or 0
    ranges = 1 << int(size // GROUP_BYTES).bit_length()
    dealt = rows.join(supports.drop("bytes"), ["lang", "shard"])
    words = materialise(count_words(rows))
    common = words.filter(F.col("n") >= least)
    usable = key_filter(common)
    mined = materialise(mine_shards(dealt, least, ranges, (2,), usable))
    if longest > 2:
        pairs = key_filter(mined)
        mined = mined.union(materialise(mine_shards(dealt, least, ranges, tuple(range(3, longest + 1)), usable, pairs)))
    counted = count_phrases(rows, least, ranges, tuple(range(2, longest + 1)), usable, key_filter(mined))
    phrases = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("width"), "n").union(counted)
    return materialise(phrases), materialise(words.groupBy("lang").agg(F.sum("n").alias("n")))


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, inside: int = 80, shards: int = 8) -> DataFrame:
    """The ``top`` phrases of each language by the weakest of their cuts: lang, rank, phrase, a, l, r, n, score.

    Cutting a phrase of count a after some of its words gives two parts with counts l and r,
    and the score floor(2000000 a / (l + r)); its lowest-scoring cut counts, the first of
    equals. Phrases inside a longer one that occurs ``inside`` percent as often are dropped.
    Products are decimals of 38 digits.

    A null lang is ``und``; null, empty and blank texts have no words; texts of any length
    are read whole, and only a task's slice of them is held; repeated rows count as often as
    they occur; ties of score and count go by the phrase's bytes; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    phrases, totals = frequent_phrases(docs, least, longest, shards)
    whole = phrases.filter("width > 1").select("lang", "phrase", "width", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
    piece = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    cuts = cuts.select("lang", "phrase", "width", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("width") - F.col("k")).alias("right"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("doubled", exact("a") * F.lit(2_000_000)).withColumn("both", exact("l") + exact("r"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("doubled div both").alias("score"), "k", "l", "r")).alias("cut"))

    longer = whole.filter("width > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("width") - 1)))
    longer = longer.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("size") + 1)))
    covers = longer.select("lang", piece(F.col("first"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = weakest.join(covers, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (exact("over") * 100 < exact("a") * inside))
    scored = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
