"""Conversation structure repair by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulselake.llm.common import materialise

BLANKS = " \t\n\x0b\f\r"
#: What has been given out so far: nothing, ``s``, ``...u``, ``...a``; the first and the last may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: Illegal neighbours are all but these.
FOLLOWS = {"su", "ua", "au"}
_GIVES = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
Row = tuple[str, bool, bool]


def wanted(state: int) -> int:
    """The state after the one turn that a user or an assistant may take next."""
    return ASSISTANT if state == USER else USER


def edits(row: Row | None, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows taken, next state) in ASCII order: Delete, Insert, Keep, Rerole; ``row`` is None behind the last."""
    insert = ("I", INSERT, 0, wanted(state))
    if row is None:
        return [insert]
    initial, faulty, cut = row
    found = [("D", DELETE, 1, state), insert]
    if not faulty:
        kept = _GIVES.get((initial, state))
        if kept is not None:
            found.append(("K", CUT * cut, 1, kept))
        if kept != wanted(state):
            found.append(("R", REROLE + CUT * cut, 1, wanted(state)))
    return found


def least_costs(rows: list[Row]) -> list[tuple[int, int]]:
    """For each place the least cost to the end while a user's, or an assistant's, turn is due.

    The grammar is relaxed: a system turn may stand anywhere and a conversation may end behind
    it, so no cost is above the true one.
    """
    found = [(0, INSERT)]
    for initial, faulty, cut in reversed(rows):
        user, assistant = found[-1]
        due = [DELETE + user, DELETE + assistant]
        if not faulty:
            kept = CUT * cut
            if initial == "s":
                due = [kept + user, kept + assistant]
            due[0] = min(due[0], kept + assistant + (0 if initial == "u" else REROLE))
            due[1] = min(due[1], kept + user + (0 if initial == "a" else REROLE))
        found.append((min(due[0], INSERT + due[1]), min(due[1], INSERT + due[0])))
    return found[::-1]


def cheapest_edits(rows: list[Row]) -> tuple[int, str]:
    """(cost, initials) of the cheapest edits that make the roles ``(s?(ua)+)?``, of equals the ASCII-least.

    ``rows`` are (role's initial, blank or duplicate, truncated). Depth-first search in the
    order of ``edits`` under a cost bound, which rises to the least cost that exceeded it until
    a path is accepted. A state that failed is kept with the least cost to the end that is
    still possible for it, and is not entered again with less than that, under any bound.
    """
    relaxed = least_costs(rows)
    end = len(rows)
    failed: dict[tuple[int, int], int] = {}

    def least(at: int, state: int) -> int:
        return failed.get((at, state), relaxed[at][state == USER])

    while True:
        left = least(0, START)
        path: list[str] = []
        steps = [(0, START, left, iter(edits(rows[0] if end else None, START)), [1 << 60], 0)]
        while steps:
            at, state, left, open_, beyond, _ = steps[-1]
            if at == end and state in (START, ASSISTANT):
                return sum(s[5] for s in steps), "".join(path)
            for letter, cost, taken, then in open_:
                need = cost + least(at + taken, then)
                if need <= left:
                    path.append(letter)
                    steps.append((at + taken, then, left - cost, iter(edits(rows[at + taken] if at + taken < end else None, then)), [1 << 60], cost))
                    break
                beyond[0] = min(beyond[0], need)
            else:
                failed[at, state] = max(beyond[0], least(at, state))
                cost = steps.pop()[5]
                if steps:
                    path.pop()
                    steps[-1][4][0] = min(steps[-1][4][0], cost + failed[at, state])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with the faults that crc32 of ``conv_id:turn`` picks; nulls but those of
    ids and turns become a space. A dropped row stays, marked ``gone``, so that its conversation is known."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _streamed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """A conversation's rows one after another in one task, which reads past them without holding them."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


class Faults:
    """What is seen of a conversation while its rows go by."""

    def __init__(self):
        self.rows: list[Row] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.rows and self.rows[-1][0] + initial not in FOLLOWS:
            self.illegal += 1
        repeated = not blank and (role, digest) in self.seen
        cut = cut and not blank and not repeated
        self.seen.add((role, digest))
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.rows.append((initial, blank or repeated, cut))

    def result(self) -> tuple[int, int, int, int, int, int, str]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(self.rows))


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def diagnosed(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): faults, cost and edits; texts go no further than their digests."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = trimmed == ""
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), blank.alias("blank"), cut.alias("cut"), "gone")
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in FIELDS], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, done = None, None, []
        for batch in batches:
            for conv, turn, role, digest, blank, cut, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv != key:
                    if open_ is not None:
                        done.append((key, *open_.result()))
                    key, open_ = conv, Faults()
                if not gone:
                    open_.add(turn, role, digest, blank, cut)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((key, *open_.result()), schema)], schema=schema)

    return _streamed(light, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]).mapInArrow(run, "conv_id long, " + ", ".join(f"{n} long" for n in FIELDS) + ", audit string")


class Repair:
    """Takes a conversation's rows one by one and hashes what its edits make of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, START, hashlib.sha256(), True

    def give(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = wanted(self.state), self.at + 1
            self.give(_NAMES[self.state], "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = _GIVES[role[:1], self.state]
            self.give(role, text)
        elif letter == "R":
            self.state = wanted(self.state)
            self.give(_NAMES[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in
    (conv_id, turn, role, text, gone).

    Rows stand in the order of their turns, nulls first; rows of one turn in that of role and
    of the text's SHA-256. A first pass sends no texts and finds each conversation's faults and
    cheapest edits; a second meets the texts again, behind the edits in the same partition, and
    hashes the repaired conversation while they go by. A conversation is read in one task, as
    its hash needs its rows in order; what a task holds of it is a few bytes a row.

    A null id is a conversation of its own; roles and texts that are null count as a space; a role
    is known by its initial, and an empty one has none that may be kept; texts of any length
    are read whole; repeated rows are duplicates; a conversation whose rows are all gone has
    zeros, no edits and the hash of nothing; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    found = materialise(diagnosed(rows))
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.filter("not gone").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", *[none("long").alias(n) for n in FIELDS], F.lit(1).alias("kind"))
    heads = found.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"), *FIELDS, F.lit(0).alias("kind"))
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in FIELDS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repair, done = (), None, []
        for batch in batches:
            for conv, kind, role, text, *counts in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text", *FIELDS))):
                if kind == 0:
                    if repair:
                        done.append((*head, repair.digest()))
                    head, repair = (conv, *counts, text), Repair(text)
                else:
                    repair.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if repair:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*head, repair.digest()), schema)], schema=schema)

    both = _streamed(texts.unionByName(heads), [F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])
    return both.mapInArrow(run, "conv_id long, " + ", ".join(f"{n} long" for n in FIELDS) + ", audit string, repaired_sha256 string")
