"""Toxicity by noisy-channel deobfuscation.

Words that look disguised (leet signs, look-alike letters, separators, stretched or
spaced-out letters) are restored first: each sign opens a few readings at a cost, and a
Viterbi search picks the path that a character trigram model of the corpus likes best; a
second search may spell entries of the lexicon only, whose words can be rare in the corpus.
The lexicon of words and word beginnings, learnt from labels, weighs the restored text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulselake.llm.common import materialise
from pulselake.llm.learning import FIT_ROWS, Network, emit_blocks, held_out, labelled_sample, sum_blocks
from pulselake.llm.shingles import Shingler

#: Readings of leet signs, and Latin letters that letters of other scripts look like (fixed values).
LEET = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letter classes: 0 is a word's edge, 1 to 26 Latin letters, the rest share letters of other scripts.
_SIZE, _OTHER = 64, 37
_READ, _DROP, _STRETCH, _WILD, _ALIKE, _SEPARATOR = 1.0, 2.0, 0.7, 2.5, 0.5, 0.5
#: What a path may cost for each letter that it reads.
ALLOWANCE = 1.4
#: Entries of the lexicon at most, in rounds of equal share, and about how many features a sample has.
LEXICON, FEATURES = 4096, 1e5
ROUNDS = 4
#: Signs (runs count as one) that are restored as one word; longer tokens are restored part by part.
STRETCH = 40
_EDGES = re.compile(r"^[^\w@$€|+!]+|[^\w@$€|+]+$")
_TRIPLE = re.compile(r"(.)\1\1")
_SEPARATORS = re.compile(r"[^\w@$€|+!*]+|_+")
#: Words of up to ``LONGEST`` signs that a task remembers before it forgets them all.
MEMORY, LONGEST = 100_000, 64


def _fold(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return _LETTERS.find(base) + 1 or 27 + ord(c) % _OTHER


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([_fold(chr(k)) if chr(k).isalpha() else 0 for k in range(0x20000)], np.int32)


def letter_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _classes()[np.where(codes < 0x20000, codes, 0)]


def character_model(docs: DataFrame) -> np.ndarray:
    """-log P(letter | two before it), smoothed, from all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                text = " ".join(t or "" for t in batch.column(0).slice(at, 100).to_pylist())
                c = letter_classes("  " + text + " ")
                keep = np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))  # one edge between words
                c = c[keep]
                before = np.where(c[1:-1] == 0, 0, c[:-2])
                total += np.bincount((before * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=len(total))
        yield emit_blocks(total.reshape(_SIZE**2, _SIZE))

    counts = sum_blocks(docs.select(F.col("text").cast("string")).mapInArrow(run, "block int, values binary"), (_SIZE**2, _SIZE))
    counts = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    one = counts.sum(axis=(0, 1)) + 1
    two = counts.sum(axis=0) + 5 * one / one.sum()
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 5 * two[None]
    return -np.log(three / three.sum(axis=2, keepdims=True))


def _readings(c: str) -> list[tuple[str, float]]:
    if c in LEET:
        return [(r, _READ) for r in LEET[c]] + ([("", _DROP + 2)] if not c.isalnum() else [])
    if c.isalpha():
        return [(c, 0.0), (LOOKALIKES[c], _ALIKE)] if c in LOOKALIKES else [(c, 0.0)]
    if c == "*":
        return [("", _DROP)] + [(r, _WILD) for r in _LETTERS]
    return [("", _DROP if c.isdigit() else _SEPARATOR)]


Unit = list[tuple[str, float]]


def lattice(word: str) -> list[Unit]:
    """Readings and costs of each sign; a run of three or more of a sign reads as one or two,
    and a sign that may repeat the letter before it ('0o') may be left out."""
    units, at, letters = [], 0, set()
    while at < len(word):
        run = 1
        while at + run < len(word) and word[at + run] == word[at]:
            run += 1
        options = _readings(word[at])
        before, letters = letters, {r for r, _ in options if r}
        again = [("", _STRETCH)] if len(before & letters) and options[0][0] else []
        if run >= 3:
            units.append([(r * k, cost + _STRETCH) for r, cost in options for k in (1, 2) if r or k == 1] + again)
        else:
            units += [options + again, options][:run]
        at += run
    return units


class CharacterModel:
    """The trigram model in the form that the search reads fast."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self._flat = costs.ravel().tolist()
        self._fold = lru_cache(maxsize=4096)(_fold)

    def restore(self, units: list[Unit]) -> str:
        """The likeliest letters behind a lattice: Viterbi, with the last two letters as state; no state is left out."""
        flat, fold = self._flat, self._fold
        paths: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for unit in units:
            following: dict[int, tuple[float, str]] = {}
            for state, (cost, text) in paths.items():
                for reading, price in unit:
                    at, total = state, cost + price
                    for c in reading:
                        z = fold(c)
                        total += flat[at * _SIZE + z]
                        at = at % _SIZE * _SIZE + z
                    known = following.get(at)
                    if known is None or total < known[0]:
                        following[at] = (total, text + reading)
            paths = following
        return min(((cost + flat[state * _SIZE], text) for state, (cost, text) in paths.items()), default=(0, ""))[1]


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest letters behind a lower-case word."""
    return CharacterModel(model).restore(lattice(word))


class Trie:
    """The lexicon as letters to follow: Viterbi over a lattice that may only spell its words."""

    def __init__(self, lexicon: dict[str, float]):
        self.root: dict = {"depth": 0}
        for feature, weight in lexicon.items():
            letters, node = feature.rstrip("~"), self.root
            for k, c in enumerate(letters):
                node["depth"] = max(node["depth"], len(letters) - k)
                node = node.setdefault(c, {"depth": 0})
            kind = "begins" if feature.endswith("~") else "is"
            node[kind] = max(weight, node.get(kind, 0.0))

    def weight(self, word: str, inside: bool = False) -> float:
        """The greatest weight of an entry that the word may spell at a cost of at most ``ALLOWANCE`` a letter."""
        return self.spelt(lattice(word), 0, inside)

    def hidden(self, units: list[Unit]) -> float:
        """The greatest weight of entries that begin at any sign of a lattice."""
        return max((self.spelt(units, k, True) for k in range(len(units))), default=0.0)

    def spelt(self, units: list[Unit], start: int, inside: bool) -> float:
        """``inside``: the entry may end before the word does, as in a run of spaced-out words.

        A path ends where even the longest entry ahead of it would not pay for its cost, so
        the search is exact and as long as the lexicon's words, whatever the lattice's length.
        """
        best, states, last = 0.0, {id(self.root): (self.root, 0.0, 0)}, len(units) - 1
        for k in range(start, len(units)):
            following: dict[int, tuple[dict, float, int]] = {}
            for node, cost, length in states.values():
                for reading, price in units[k]:
                    at, n, total = node, length + len(reading), cost + price
                    for c in reading:
                        at = at.get(c)
                        if at is None:
                            break
                    if at is None or total > ALLOWANCE * (n + at["depth"]):
                        continue
                    if total <= ALLOWANCE * n:
                        best = max(best, at.get("begins", 0.0) if n >= 4 else 0.0)
                        if k == last or (inside and n >= 4):
                            best = max(best, at.get("is", 0.0))
                    known = following.get(id(at))
                    if known is None or total < known[1]:
                        following[id(at)] = (at, total, n)
            states = following
            if not states:
                break
        return best


def core(token: str) -> tuple[str, bool]:
    """(a token in lower case without punctuation at its edges, whether it looks disguised); '' for numbers and signs."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
    found = _EDGES.sub("", token.lower())
    if found.endswith(("!", "|", "+")) and found[:-1].isalpha():
        found = found[:-1]
    if found.isalpha():
        alike = not found.isascii() and any(c in LOOKALIKES for c in found) and all(c in LOOKALIKES or c.isascii() for c in found)
        return found, alike or bool(_TRIPLE.search(found))
    letters = sum(c.isalpha() for c in found)
    if letters < 2 and not (letters and any(c in LEET for c in found)):
        return "", False
    return found, True


def pieces(word: str) -> list[str]:
    """What separators leave of a disguised word, if they leave more than one piece of three signs or more."""
    found = [p for p in _SEPARATORS.split(word) if len(p) >= 3]
    return found if len(found) > 1 or (found and len(word) > STRETCH) else []


def _stretches(units: list[Unit]) -> list[list[Unit]]:
    if len(units) <= STRETCH:
        return [units]
    return [units[k : k + STRETCH] for k in range(0, len(units) - STRETCH // 2, STRETCH // 2)]


def plain_words(token: str, model: CharacterModel) -> list[str]:
    """The words behind a token: its core, restored if it looks disguised, and the pieces that separators leave.

    What is longer than ``STRETCH`` is restored in overlapping stretches of that length.
    """
    word, disguised = core(token)
    if not disguised:
        return [word] if word else []
    found = [model.restore(part) for part in _stretches(lattice(word))]
    for piece in pieces(word):
        plain, odd = core(piece)
        found += [model.restore(part) for part in _stretches(lattice(plain))] if odd else [plain]
    return found


def plain_word(token: str, model: np.ndarray) -> str:
    """The first word behind a token."""
    return next(iter(plain_words(token, CharacterModel(model))), "")


def word_features(word: str) -> list[str]:
    """A word and its first 4, 5 and 6 letters."""
    return [word] + [f"{word[:k]}~" for k in (4, 5, 6) if len(word) >= k] if len(word) >= 3 else []


def spaced_runs(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters ('s t u p i d', by any blanks) without the blanks."""
    single = bytes(len(t) == 1 for t in tokens)
    found, at = [], single.find(b"\1\1\1")
    while at >= 0:
        end = single.find(b"\0", at)
        end = len(single) if end < 0 else end
        signs = "".join(tokens[at:end])
        if len(set(signs)) > 2:
            found.append(signs)
        at = single.find(b"\1\1\1", end)
    return found


def split_words(lexicon: dict[str, float]) -> dict[str, dict[str, float]]:
    """{beginning: {rest: weight}} of the lexicon's whole words of five letters or more, cut in two."""
    found: dict[str, dict[str, float]] = {}
    for word, weight in lexicon.items():
        if len(word) >= 5 and not word.endswith("~"):
            for k in range(2, len(word) - 1):
                found.setdefault(word[:k], {})[word[k:]] = weight
    return found


def found_splits(tokens: list[str], splits: dict[str, dict[str, float]]) -> list[tuple[str, str, float]]:
    """(beginning, rest, weight) of words cut in two that stand in the tokens."""
    if not splits or splits.keys().isdisjoint(tokens):
        return []
    found = []
    for a, b in zip(tokens, tokens[1:]):
        rests = splits.get(a)
        if rests and (weight := rests.get(_EDGES.sub("", b))):
            found.append((a, _EDGES.sub("", b), weight))
    return found


@dataclass
class Model:
    characters: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    splits: dict[str, dict[str, float]] = field(default_factory=dict)
    network: Network = field(default_factory=Network)


class Evidence:
    """Evidence of a text against the lexicon: the greatest weights of its words, and how many are strong."""

    def __init__(self, characters: np.ndarray, lexicon: dict[str, float], splits: dict[str, dict[str, float]] | None = None):
        self.characters, self.lexicon, self.trie, self.splits = CharacterModel(characters), lexicon, Trie(lexicon), splits or {}
        evidence = self

        class Memory(dict):
            def __missing__(self, token: str) -> float:
                found = evidence.token(token)
                if len(token) <= LONGEST:
                    self[token] = found
                return found

        self._memory = Memory()

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in word_features(word)), default=0.0)

    def token(self, token: str) -> float:
        """The greatest weight of what a token may stand for, whatever its length."""
        found = max(map(self.weight, plain_words(token, self.characters)), default=0.0)
        word, disguised = core(token)
        if disguised:
            units = lattice(word)
            found = max(found, self.trie.spelt(units, 0, False), self.trie.hidden(units) if len(units) > STRETCH else 0.0)
            found = max([found, *(self.trie.weight(piece) for piece in pieces(word))])
        return found

    def __call__(self, text: str | None) -> list[float]:
        if len(self._memory) >= MEMORY:
            self._memory.clear()
        tokens = (text or "").lower().split()
        weights = list(map(self._memory.__getitem__, tokens))
        weights += [self.trie.hidden(lattice(run)) for run in spaced_runs(tokens)]
        weights += [weight for _, _, weight in found_splits(tokens, self.splits)]
        strong = sorted((w for w in weights if w > 0), reverse=True)
        top = strong[:3] + [0.0] * (3 - len(strong[:3]))
        return [top[0], top[1], top[2], float(np.log1p(len(strong))), len(strong) / (len(tokens) + 10)]


def restored_features(text: str | None, characters: CharacterModel, memory: dict[str, list[str]]) -> set[str]:
    """Distinct features of all words of a text."""
    found: set[str] = set()
    tokens = (text or "").lower().split()
    for token in set(tokens):
        features = memory.get(token)
        if features is None:
            features = [f for word in plain_words(token, characters) for f in word_features(word)]
            if len(memory) >= MEMORY:
                memory.clear()
            if len(token) <= LONGEST:
                memory[token] = features
        found.update(features)
    for run in spaced_runs(tokens):
        for part in _stretches(lattice(run)):
            found.update(word_features(characters.restore(part)))
    return found


def sample_features(sample: DataFrame, characters: np.ndarray) -> DataFrame:
    """(row, label, check, features): the features of every text of the bounded sample, decoded once."""
    shared = sample.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = CharacterModel(shared.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [sorted(restored_features(t, model, memory)) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(found, pa.list_(pa.string()))], names=["row", "label", "check", "features"])

    rows = sample.select(F.monotonically_increasing_id().alias("row"), "label", "check", "text")
    return materialise(rows.mapInArrow(run, "row long, label int, check boolean, features array<string>"))


def learn_lexicon(features: DataFrame) -> dict[str, float]:
    """Weights of features that tell toxic documents from others, in a few rounds.

    Each round looks at the toxic documents that no feature so far explains. A feature needs
    so many of them that chance would hardly give one such feature among all. ``features``
    (row, label, features) comes from the bounded sample; its near copies have been thinned,
    or a copied toxic text would make all its words suspect. At most ``LEXICON`` features,
    the weightiest of each round, make up the lexicon.
    """
    spark = features.sparkSession
    rows = {r.label: r["count"] for r in features.groupBy("label").count().collect()}
    toxic, clean = rows.get(1, 0), rows.get(0, 0)
    lexicon: dict[str, float] = {}
    if not toxic or not clean:
        return lexicon
    pairs = features.select("row", "label", F.explode("features").alias("feature"))
    n, other = F.col("n"), F.col("other")
    weight = F.log((n + 0.5) / (toxic + 1)) - F.log((other + 0.5) / (clean + 1))
    totals = pairs.groupBy("feature").agg(F.sum("label").alias("n"), F.sum(1 - F.col("label")).alias("other")).filter("n >= 2")
    totals = materialise(totals.withColumn("weight", weight).filter((F.col("weight") > 2.5) & (other <= 0.02 * n * max(1, clean / toxic))))
    of_toxic = materialise(pairs.filter("label = 1").select("row", "feature"))
    open_, left = toxic, of_toxic
    for _ in range(ROUNDS):
        least = max(2, math.ceil(math.log(FEATURES) / -math.log(min(0.9, open_ / (toxic + clean)))), open_ // 200)
        candidates = left.groupBy("feature").count().filter(F.col("count") >= least).join(totals.filter(n >= least), "feature")
        best = {r.feature: r.weight for r in candidates.orderBy(F.desc("weight"), "feature").limit(LEXICON // ROUNDS).collect()}
        if not best:
            break
        lexicon |= best
        known = spark.createDataFrame([(f,) for f in lexicon], "feature string")
        explained = of_toxic.join(F.broadcast(known), "feature").select("row").distinct()
        open_ = toxic - explained.count()
        if not open_:
            break
        left = of_toxic.join(explained, "row", "left_anti")
    return lexicon


def learn_splits(sample: DataFrame, lexicon: dict[str, float]) -> dict[str, dict[str, float]]:
    """Ways to cut the lexicon's words in two that no clean text of the sample has as two words."""
    splits = split_words(lexicon)
    shared = sample.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((a, b) for a, b, _ in found_splits((text or "").lower().split(), shared.value))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in sorted(seen)], pa.string()) for k in (0, 1)], names=["a", "b"])

    if splits:
        for r in sample.filter("label = 0").select("text").mapInArrow(run, "a string, b string").distinct().collect():
            splits[r.a].pop(r.b, None)
    return {a: rests for a, rests in splits.items() if rests}


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Character model from all documents; lexicon and network from a bounded labelled sample.

    The network learns what evidence is worth on a fifth of the sample, against a lexicon of
    the other four; the lexicon that is kept is then learnt from the whole sample.
    """
    spark = docs.sparkSession
    characters = character_model(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(5)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                least = [int(s[0] >> np.uint64(1)) if len(s) else 0 for s in shingler(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(least, pa.int64())], names=["doc_id", "text", "label", "sketch"])

    drawn = labelled_sample(docs, labels, "toxic", rows).mapInArrow(sketch, "doc_id long, text string, label int, sketch long")
    sample = materialise(drawn.withColumn("check", F.pmod(F.xxhash64(F.lit(31), "sketch"), F.lit(5)) == 0))
    thinned = materialise(sample.join(sample.groupBy("sketch", "label").agg(F.min("doc_id").alias("doc_id")), ["sketch", "label", "doc_id"], "left_semi"))
    features = sample_features(thinned, characters)
    training = thinned.filter("not check")
    lexicon = learn_lexicon(features.filter("not check"))
    shared = spark.sparkContext.broadcast((characters, lexicon, learn_splits(training, lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*shared.value)
        for batch in batches:
            rows_ = [evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows_, pa.list_(pa.float64()))], names=["doc_id", "label", "evidence"])

    checked = sample.filter("check").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, evidence array<double>").toArrow()
    order = np.argsort(checked["doc_id"].to_numpy(), kind="stable")
    x = np.array(checked["evidence"].to_pylist(), np.float64).reshape(len(order), 5)[order]
    network = Network(hidden=8, decay=1e-3).fit(x, checked["label"].to_numpy()[order].astype(np.float64))
    whole = learn_lexicon(features)
    return Model(characters, whole, learn_splits(thinned, whole), network)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by its whole text alone. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = Evidence(model.characters, model.lexicon, model.splits)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = np.array([evidence(t) for t in part.column(1).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.network.score(x))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fit on the training fold of ``labels`` and score every document.

    Null and empty texts have no evidence and get the score of that; texts and tokens of any
    length are read whole; a null ``doc_id`` is
    scored like any other and not held out; repeated rows are scored alike; without labels
    of both kinds the score is a constant; empty input gives an empty result; other columns
    are ignored.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels), threshold)
