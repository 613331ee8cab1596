"""Held-out accuracy of the classifiers, restoration of disguised words, and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pulselake.llm import registry
from pulselake.llm.common import text_slices
from pulselake.llm.learning import Network
from pulselake.llm.mixing import mixed_copies
from pulselake.llm.quality import _IDS, _INDEX, DIMENSIONS, SLICE_BYTES, WORDS, Reader, classify_quality, pooled, word_vectors
from pulselake.llm.toxicity import STRETCH, CharacterModel, Evidence, Trie, character_model, classify_toxicity, found_splits, lattice, plain_word, plain_words, spaced_runs, split_words

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def characters(spark):
    return character_model(spark.createDataFrame([("you stupid loser are pathetic and worthless trash idiot moron " * 20,), ("the other words are here for the model " * 20,)], "text string"))


@pytest.mark.parametrize(
    "raw,plain",
    [("L0SER!!", "loser"), ("$tupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("1diot", "idiot"), ("loooooser", "loser"), ("path3tic,", "pathetic"), ("st*pid", "stupid"), ("the", "the"), ("1234", ""), ("!!!", "")],
)
def test_disguised_words_are_restored(characters, raw, plain):
    assert plain_word(raw, characters) == plain


def test_spaced_out_words_are_found(characters):
    assert spaced_runs("what a s t u p i d thing".split()) == ["astupid"] and spaced_runs("a a a a a".split()) == []
    assert spaced_runs("s  t\tu\np i d".split()) == ["stupid"] and spaced_runs(["x", "y"]) == []
    evidence = Evidence(characters, {"stupid": 5.0})
    assert evidence("you are s t u p i d today")[0] == 5.0 and evidence("you are s   t  u\np\ti d today")[0] == 5.0 and evidence("fine words")[0] == 0.0 and evidence(None)[0] == 0.0


@pytest.mark.parametrize("raw", ["!d!ot", "1d107", "id*ot", "i*iot", "iddddiot", "iD1000t", "1.d.1.o.t", "vilk0", "v1lkx", "1.d.1.0.7", "1-d-1-0-7", "111d111000777", "i****diot", "\u0456di\u043et"])
def test_lexicon_entries_are_spelt_from_lattices(raw):
    assert Trie({"idiot": 4.0, "vilk~": 3.0}).weight(raw.lower()) >= 3.0


@pytest.fixture(scope="module")
def reader(characters):
    return Evidence(characters, {"idiot": 4.0, "loser": 5.0, "vilk~": 3.0, "привет": 6.0}, split_words({"loser": 5.0}))


@pytest.mark.parametrize(
    "text,weight",
    [
        ("id1" + "0" * 90 + "t", 4.0),
        ("l0" + "o" * 45 + "ser", 5.0),
        ("1" + "-" * 40 + "d1ot", 4.0),
        ("some.words.and.idiot.glued.by.signs.into.one.token.that.is.long", 4.0),
        ("x/idiot_word", 4.0),
        ("joined-l0ser", 5.0),
        ("_".join(f"word{k}" for k in range(400)) + "_1d10t_" + "_".join(f"more{k}" for k in range(400)), 4.0),
        ("zzqj" * 30 + "1d10t" + "kwv" * 30 + "9", 4.0),
        ("a lo ser!", 5.0),
        ("l.o.s.3.r", 5.0),
        ("i\u0434 п-р-и-в-е-т", 6.0),
        ("п р и в е т", 6.0),
        ("ｉｄｉｏｔ", 4.0),
        ("i\u200bd\u200bi\u200bo\u200bt", 4.0),
        ("plain words-and_others/of 12-34 x9 no k1nd", 0.0),
        ("a" * 5000 + "1" * 5000 + "-" * 5000, 0.0),
    ],
)
def test_evidence_in_long_glued_split_and_foreign_words(reader, text, weight):
    assert reader(text)[0] == weight


def test_words_cut_in_two():
    splits = split_words({"loser": 5.0, "idio~": 3.0, "bad": 4.0})
    assert splits == {"lo": {"ser": 5.0}, "los": {"er": 5.0}}
    assert found_splits("a lo ser. los. er los er".split(), splits) == [("lo", "ser", 5.0), ("los", "er", 5.0)]


@pytest.mark.parametrize("raw", ["1d10t", "s*up!d", "l**er", "+r4sh", "a-b*c", "ooops", "пр1т", "x"])
def test_viterbi_finds_the_best_of_all_paths(characters, raw):
    model, best = CharacterModel(characters), None
    from pulselake.llm.toxicity import _fold

    def walk(k, text, cost):
        nonlocal best
        if k == len(units):
            letters = [0, 0, *map(_fold, text), 0]
            total = cost + sum(characters[a, b, c] for a, b, c in zip(letters, letters[1:], letters[2:]))
            if best is None or total < best - 1e-9:
                best = total
            return
        for reading, price in units[k]:
            walk(k + 1, text + reading, cost + price)

    units = lattice(raw)
    walk(0, "", 0.0)
    text = model.restore(units)
    letters = [0, 0, *map(_fold, text), 0]
    model_cost = sum(characters[a, b, c] for a, b, c in zip(letters, letters[1:], letters[2:]))
    prices: dict = {"": 0.0}
    for unit in units:
        following: dict = {}
        for t, cost in prices.items():
            for reading, price in unit:
                if text.startswith(t + reading):
                    following[t + reading] = min(cost + price, following.get(t + reading, 1e9))
        prices = following
    assert abs(model_cost + prices[text] - best) < 1e-6


def test_trie_agrees_with_all_readings():
    rng = random.Random(6)
    words = {"".join(rng.choice("abio") for _ in range(rng.choice([3, 4, 5]))): 2.0 + k for k, _ in enumerate(range(30))}
    trie = Trie(words)
    for _ in range(300):
        raw = "".join(rng.choice("abio140-*") for _ in range(rng.choice([2, 4, 6])))
        reachable = {("", 0.0)}
        for unit in lattice(raw):
            reachable = {(t + r, c + p) for t, c in reachable for r, p in unit if any(w.startswith(t + r) for w in words)}
        want = max((words[t] for t, c in reachable if t in words and c <= 1.4 * len(t) + 1e-9), default=0.0)
        assert abs(trie.weight(raw) - want) < 1e-9 or any(t in words and abs(c - 1.4 * len(t)) < 1e-6 for t, c in reachable)


def test_long_tokens_are_restored_in_stretches(characters):
    found = plain_words("x" + "1oser" * 40, CharacterModel(characters))
    assert len(found) > 4 and all(len(w) <= 2 * STRETCH for w in found)


@pytest.mark.parametrize("raw", ["idiom", "10+", "*****", "i*****", "a1b2c3d4", "x9", ""])
def test_other_words_do_not_spell_lexicon_entries(raw):
    assert Trie({"idiot": 4.0, "vilk~": 3.0}).weight(raw) == 0.0


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    score = Network().fit(x[:3000], y[:3000]).score(x[3000:])
    assert abs(score.mean() - y[3000:].mean()) < 0.05 and np.abs(score - p[3000:]).mean() < 0.08


def _accuracy(spark, found, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in found if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in rows if r.held_out]
    return np.mean([r.predicted == labels[r.doc_id] for r in held]), held, labels


def test_word_vectors_equal_sums_word_by_word(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "the", "Word!", "NOT", "x1", "été", "word word"]) for _ in range(draw.randrange(12))) for _ in range(60)] + [None, "", " \n", "one"]
    words, sums = Reader()(texts), np.zeros((_IDS, DIMENSIONS), np.int64)
    pairs = list(zip(words.ids, words.shapes + WORDS))
    for here, there in ((i, j) for i in range(len(pairs)) for j in range(max(0, i - 2), min(len(pairs), i + 3)) if i != j and words.of[i] == words.of[j]):
        for row in pairs[here]:
            sums[row] += _INDEX[list(pairs[there])].sum(axis=0)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.maximum(norm, 1)
    wanted = unit - unit[norm[:, 0] > 0].mean(axis=0) * (norm > 0)
    found = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(found, wanted, atol=1e-6) and norm.any()


def test_slices_are_bounded_by_bytes_and_keep_all_rows():
    texts = ["x" * SLICE_BYTES, None, "y" * 10, "", "z" * (3 * SLICE_BYTES), "end"] + ["w" * 1000] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = [part.column(1).to_pylist() for part in text_slices(batch, 1, SLICE_BYTES)]
    assert [t for part in parts for t in part] == texts
    assert all(sum(len(t or "") for t in part[:-1]) <= SLICE_BYTES for part in parts) and not list(text_slices(batch.slice(0, 0), 1, SLICE_BYTES))


def test_pooling_takes_little_more_time_than_reading():
    draw = random.Random(3)
    texts = ["".join(draw.choice("etaoin shrdlu ") for _ in range(4000)) for _ in range(100)]
    read, vectors = Reader(), np.ones((_IDS, DIMENSIONS), np.float32)

    def seconds(call):
        call()
        times = []
        for _ in range(3):
            begin = time.process_time()
            call()
            times.append(time.process_time() - begin)
        return min(times)

    assert seconds(lambda: pooled(read, texts, vectors)) < 4 * seconds(lambda: read(texts))


def test_quality_on_held_out_labels(spark):
    accuracy, _, _ = _accuracy(spark, registry.op9_quality(spark, DATA).collect(), "quality")
    assert accuracy > 0.93


def test_toxicity_on_held_out_labels(spark):
    accuracy, held, labels = _accuracy(spark, registry.op10_toxicity(spark, DATA).collect(), "toxic")
    assert accuracy > 0.93
    assert sum(r.predicted and not labels[r.doc_id] for r in held) <= 1


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_classifier_edges(spark, edge_docs, no_docs, labels, classify):
    assert classify(no_docs, labels).count() == 0
    found = classify(edge_docs, labels).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4, 5)}) == 1
    without = classify(edge_docs, labels.limit(0)).collect()
    assert {r.score for r in without} == {0.5}


def test_planted_toxic_words_are_caught_in_disguise(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    bad = ["grumblex", "vilkor", "snarfle", "dreckop"]
    docs, rows = [], []
    for k in range(1500):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = k % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        docs.append((k, " ".join(words)))
        rows.append((k, 1, int(toxic)))
    docs += [(9000, "some word1 gruumblex".replace("uu", "uuuu")), (9001, "word2 v1lk0r word3"), (9002, "word5 s n a r f l e word6"), (9003, "word7 word8 word9")]
    found = classify_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    predicted = {r.doc_id: r.predicted for r in found.collect()}
    assert [predicted[k] for k in (9000, 9001, 9002, 9003)] == [1, 1, 1, 0]
    assert all(predicted[k] == int(k % 6 == 0) for k in range(1500))


def test_pipeline_stages_on_small_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    at = corpus_pipeline.materialise(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, at, DATA))
        assert after.columns == corpus_pipeline.COLUMNS
        before_ids, ids = ({r.doc_id for r in d.select("doc_id").collect()} for d in (at, after))
        assert ids <= before_ids
        gone = [labels[i] for i in before_ids - ids if i in labels]
        if name == "toxicity":
            assert sum(not r.toxic for r in gone) <= 3 and sum(r.toxic for r in gone) >= 20
        if name == "quality":
            assert sum(r.quality for r in gone) <= 3 and sum(not r.quality for r in gone) >= 40
        if name == "near_duplicates":
            assert after.count() == len(ids) and 0 < len(before_ids - ids) < 0.3 * len(before_ids)
        at = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").collect()}


def _rows(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_pipeline_stages_equal_plain_versions(spark, edge_docs, tmp_path, labels):
    """Each stage against its decisions made row by row, over nulls, odd and very long texts, repeats and clashing columns."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    folder, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    near = " ".join(f"near{k}" for k in range(60))
    extra = [(20, near, "en", "a", 1), (21, near + " more", "en", "b", 2), (22, "L0ng " * 9 + near, None, "b", 3), (None, near, "en", None, 4), (23, near.upper(), "en", "a", None)]
    columns = [c for c in edge_docs.columns if c not in corpus_pipeline.COLUMNS]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"null as {c}" for c in columns])
    docs = corpus_pipeline.materialise(edge_docs.union(more))
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]

    for name, classify in (("toxicity", classify_toxicity), ("quality", classify_quality)):
        rejected = {r.doc_id for r in classify(docs, labels).collect() if r.predicted == (name == "toxicity")} - {None}
        assert _rows(stages[name](spark, docs, folder)) == Counter(r for r in rows if r[0] not in rejected)

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(i, []).append(shingles(text))
    ids = sorted(k for k in sets if k is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(x and y and 5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = stages["near_duplicates"](spark, docs, folder)
    assert _rows(kept) == Counter({r: 1 for r in rows if r[0] is not None and root[r[0]] == r[0]}) + Counter(r for r in rows if r[0] is None)

    mixed = corpus_pipeline.materialise(stages["mixing"](spark, docs, folder))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter()
    for r in mixed_copies(docs).collect():
        taken[r.doc_id] += 2 * r.words >= r["size"]
    found = _rows(mixed)
    assert set(found) <= set(rows) and all(n <= 2 * rows.count(r) and size(r[1]) for r, n in found.items())
    copies = Counter()
    for r, n in found.items():
        copies[r[0]] += n
    assert copies == +taken

    packed = stages["packing"](spark, mixed, folder).collect()
    pieces = Counter((r.row_id, r.piece) for r in packed)
    assert max(pieces.values()) == 1 and len({r.row_id for r in packed}) == sum(found.values())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_keep_empty_tables_empty(spark, edge_docs, tmp_path, labels, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = dict(corpus_pipeline.STAGES)[name](spark, edge_docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and (name == "packing" or empty.columns == corpus_pipeline.COLUMNS)
