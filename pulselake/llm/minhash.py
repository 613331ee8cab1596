"""Near-duplicate documents by MinHash: banded buckets, star edges, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulselake.llm.common import materialise
from pulselake.llm.graph import components, cross_blocks
from pulselake.llm.shingles import MinHasher, Shingler, set_digest

#: Bytes of the sets of an unresolved bucket's members that are compared with each other at once, and what a member counts at least.
BLOCK_BYTES, MEMBER_BYTES = 16 << 20, 4096
#: Members that are compared at once by signatures alone.
SIGNED = 4096


def _texts(batch: pa.RecordBatch, n: int = 200) -> Iterator[tuple[list, list]]:
    for at in range(0, batch.num_rows, n):
        part = batch.slice(at, n)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def signatures(docs: DataFrame, width: int, bins: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, bands) of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(width), MinHasher(bins, rows)
        for batch in batches:
            for ids, texts in _texts(batch):
                sets = shingler(texts)
                signed = np.array([hasher.signature(s) for s in sets])
                keys = hasher.bands(signed)
                short = (signed & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                        pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "signature", "bands"],
                )

    schema = "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full sets as sorted 64-bit hashes in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for ids, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingler(texts)], pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, shingles binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted arrays share."""
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    return int((merged[1:] == merged[:-1]).sum())


def least_agreement(n: np.ndarray, percent: int, bins: int) -> np.ndarray:
    """Share of equal bins below which two sets, the smaller of ``n``, are no link: five deviations under the threshold."""
    t = percent / 100
    return t - 5 * np.sqrt(t * (1 - t) / (bins * (1 - np.exp(-np.maximum(n, 1) / bins))))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int, bins: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (4, 5))
            low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
            keep = (100 * low >= percent * high) & ((a == b).mean(axis=1) >= least_agreement(low, percent, bins))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    of = lambda side: reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                possible = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                both = _common(x, y) if possible else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side, name: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(name))
    joined = pairs.select("a", "b").join(of("a", "set_a"), "a").join(of("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long")


_MEMBER = ["key", "block", "other", "side", "doc_id", "n_shingles", "component", "band", "bands", "signature"]


class _Block:
    """One block of an unresolved bucket against itself or another: arrays of the ``_MEMBER`` columns."""

    def __init__(self, rows: list[tuple], percent: int, bins: int):
        self.rows, self.percent, self.bins = rows, percent, bins
        _, self.block, self.other = rows[0][:3]
        self.side, self.ids, self.n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        _, self.part = np.unique(np.array([r[6] for r in rows], np.int64), return_inverse=True)
        self.band = rows[0][7]
        self.bands = np.array([r[8] for r in rows], np.int64)
        self.signed = np.frombuffer(b"".join(r[9] for r in rows), np.uint16).reshape(len(rows), -1)

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, rows of other components that sizes and signatures do not rule out, the likeliest first, and shares of equal bins).

        A pair is looked at in the first band that it shares.
        """
        first = np.flatnonzero(self.side == 0)
        second = first if self.block == self.other else np.flatnonzero(self.side == 1)
        for i in first:
            js = second[(self.part[second] != self.part[i]) & ((second > i) | (self.block != self.other))]
            js = js[100 * np.minimum(self.n[js], self.n[i]) >= self.percent * np.maximum(self.n[js], self.n[i])]
            js = js[(self.bands[js] == self.bands[i]).argmax(axis=1) == self.band] if len(js) else js
            if len(js):
                alike = (self.signed[js] == self.signed[i]).mean(axis=1)
                order = np.argsort(-alike, kind="stable")
                js, alike = js[order], alike[order]
                likely = alike >= least_agreement(np.minimum(self.n[js], self.n[i]), self.percent, self.bins)
                if likely.any():
                    yield i, js[likely], alike[likely]


def _blocks(batches: Iterator[pa.RecordBatch], percent: int, bins: int) -> Iterator[_Block]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)))

    for _, group in groupby(rows(), key=lambda r: r[:3]):
        yield _Block(list(group), percent, bins)


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")


def cross_members(members: DataFrame, percent: int, bins: int) -> DataFrame:
    """(key, doc_id, other) of the members that have a candidate in another component, by sizes and
    signatures alone, with the likeliest one that each has in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, percent, bins):
            best, share = np.full(len(block.rows), -1), np.full(len(block.rows), -1.0)
            for i, js, alike in block.candidates():
                if alike[0] > share[i]:
                    best[i], share[i] = js[0], alike[0]
                more = alike > share[js]
                best[js[more]], share[js[more]] = i, alike[more]
            some = np.flatnonzero(best >= 0)
            if len(some):
                keys = np.full(len(some), block.rows[0][0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block.ids[some]), pa.array(block.ids[best[some]])], names=["key", "doc_id", "other"])

    return _dealt(members.select(*_MEMBER)).mapInArrow(run, "key long, doc_id long, other long")


def cross_links(members: DataFrame, percent: int, bins: int) -> DataFrame:
    """Links (a, b) that join different components within buckets, as a forest.

    The full sets (column ``shingles``) decide, before two sides are taken for one; so the
    rows that come out grow with those that went in, whatever the size of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, percent, bins):
            sets = [np.frombuffer(r[len(_MEMBER)], np.uint64) for r in block.rows]
            part, out = block.part, []
            for i, js, _ in block.candidates():
                for j in js:
                    if part[i] != part[j]:
                        both = _common(sets[i], sets[j])
                        if 100 * both >= percent * (block.n[i] + block.n[j] - both):
                            out.append((int(min(block.ids[i], block.ids[j])), int(max(block.ids[i], block.ids[j]))))
                            part[part == part[j]] = part[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _dealt(members.select(*_MEMBER, "shingles")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = 128, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents link when 100 * intersection >= ``percent`` * union of their distinct
    ``width``-word shingles; a component is what links reach, named by its smallest
    ``doc_id``; one document of each is kept. Steps:

    1. Documents with equal sets fall together by a digest of the set.
    2. Signatures (one permutation, optimal densification) give ``bins / rows`` band keys.
       In each bucket every member gets one edge, to the bucket's hub, so edges grow with
       the rows and not with the square of a bucket; edges are confirmed on the full sets.
    3. Buckets whose members are still in different components are searched in blocks for
       links between components, first by signatures (``cross_members``), whose likeliest pair
       for each member is confirmed at once, then, where that leaves candidates in different
       components, on the full sets (``cross_links``). Blocks are bounded by members and by
       bytes of their sets; a bucket's largest component is not repeated for itself.

    A link is missed only if it shares no band (5e-8 at similarity 0.8 with 128 bins in bands
    of 4) or if its signatures agree five deviations less than expected (about 3e-7).

    Null text is empty; documents without words link with nothing; very long texts are
    shingled whole; equal sets are one group. Rows that share a
    ``doc_id`` are one node (a link of one is a link of all) but keep their rows; a null
    ``doc_id`` never links, has a null component and is kept. Empty input gives an empty
    result; other columns are ignored.
    """
    signed = materialise(signatures(docs, width, bins, rows))
    named = signed.filter("doc_id is not null and digest is not null")
    copies = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    member = materialise(named.select("doc_id", "digest").join(copies, "digest").select("doc_id", "rep"))
    reps = named.join(copies.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"])
    reps = materialise(reps.select("doc_id", "n_shingles", "signature", "bands"))

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64(F.lit(11), "doc_id").alias("p"), F.col("doc_id").alias("hub"))
    hubs = banded.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(hubs.select("key", F.col("first.hub").alias("hub"), "n"))
    spread = materialise(banded.join(shared, "key"))
    stars = materialise(
        spread.filter("doc_id != hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    )
    stars = materialise(plausible(stars, reps, percent, bins))
    wanted = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).union(spread.filter("n > 2").select("doc_id")).distinct()
    sets = materialise(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), width))
    links = materialise(confirm(stars, sets, percent))

    def still_open(located: DataFrame) -> DataFrame:
        """Members (key, band, doc_id) of buckets that more than one component has part in, with their component."""
        labels = components(links).withColumnRenamed("node", "doc_id")
        placed = materialise(located.join(labels, "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")))
        apart = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
        return materialise(placed.join(apart, "key"))

    open_ = still_open(spread.filter("n > 2"))  # two members have been compared as a star already
    members = cross_blocks(open_, "doc_id", F.lit(1), SIGNED).join(reps, "doc_id")
    found = materialise(cross_members(members, percent, bins))
    likeliest = found.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    links = materialise(links.union(confirm(likeliest, sets, percent)))
    open_ = still_open(found.select("key", "doc_id").distinct().join(open_.drop("component"), ["key", "doc_id"]))
    held = open_.join(reps, "doc_id")
    members = cross_blocks(held, "doc_id", F.greatest(F.col("n_shingles") * 8, F.lit(MEMBER_BYTES)), BLOCK_BYTES).join(sets, "doc_id")
    links = materialise(links.union(cross_links(members, percent, bins)))

    # a document of two sets (one id, several texts) ties their representatives together
    multiple = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo != hi")
    links = links.union(multiple.select("lo", "hi"))
    labels = components(links)
    part = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    named_by = part.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(named_by, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
