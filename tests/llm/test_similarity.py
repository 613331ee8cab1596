"""Fingerprints, embedding dedup and MinHash dedup against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from pulselake.llm.edit_embedding import EditFingerprinter, edit, edited_fingerprints, least_likeness, likeness, likenesses, near_documents, nibbles
from pulselake.llm.embedding_dedup import embedding_duplicates
from pulselake.llm.graph import components
from pulselake.llm.minhash import near_duplicates
from pulselake.llm.shingles import MinHasher, Shingler

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, width):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def near_copies(seed=4, families=12, members=9):
    """Families of texts with growing edits, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        for m in range(members):
            words = list(base)
            for _ in range(int(len(words) * 0.012 * m * rng.random() * 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + k, docs[k][1].upper()) for k in range(10)]
    return docs


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_equals_all_pairs(spark, width):
    docs = near_copies()
    sets = {i: shingles(t, width) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(sets, linked)
    assert 20 < len(set(root.values())) < len(docs)
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize("n", [10, 60, 300, 2000])
def test_pairs_at_the_threshold_are_candidates(n):
    """Pairs at similarity 0.8 share a band and agree in signature as the search asks for."""
    from pulselake.llm.minhash import least_agreement

    rng, hasher, missed = np.random.default_rng(n), MinHasher(), 0
    for _ in range(400):
        both = round(n * 0.8 / 0.9)  # |A| = |B| = n, overlap / union = 0.8
        pool = np.unique(rng.integers(0, 2**63, 4 * n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4 * n, dtype=np.uint64))
        pool = rng.permutation(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : 2 * n - both])))
        signed = np.array([hasher.signature(a), hasher.signature(b)])
        keys = hasher.bands(signed)
        short = (signed & np.uint64(0xFFFF)).astype(np.uint16)
        share = (short[0] == short[1]).mean()
        if 10 * both >= 8 * (2 * n - both):
            missed += not (keys[0] == keys[1]).any() or share < least_agreement(np.array([n]), 80, 128)[0]
    assert missed == 0


def test_minhash_in_small_blocks_equals_all_pairs(spark, monkeypatch):
    """Buckets of many components, searched in several blocks by members and by bytes."""
    from pulselake.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4 * minhash.MEMBER_BYTES)
    monkeypatch.setattr(minhash, "SIGNED", 6)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(90), k % 7):
            words[at] = f"x{rng.randrange(4)}"
        docs.append((k, " ".join(words[k % 5 :])))
    sets = {i: shingles(t, 5) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(sets, linked)
    found = near_duplicates(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, digest string, blocks int")).collect()
    assert {r.doc_id: r.component_id for r in found} == root


def test_minhash_edges(spark, edge_docs, no_docs):
    assert near_duplicates(no_docs).count() == 0
    found = near_duplicates(edge_docs, width=4).collect()
    assert len(found) == 11
    by_id = {r.doc_id: r for r in found}
    assert (by_id[1].component_id, by_id[2].component_id, by_id[2].kept) == (1, 1, False)
    for i in (3, 4, 5):
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[7].n_shingles == 1 and by_id[6].n_shingles == len(shingles(edge_docs.filter("doc_id = 6").first().text, 4))
    assert by_id[None].component_id is None and by_id[None].kept


def test_shingle_sets_and_signature_estimate():
    docs = near_copies(9)
    sets = Shingler(5)([t for _, t in docs])
    assert [len(s) for s in sets] == [len(shingles(t, 5)) for _, t in docs]
    hasher = MinHasher()
    for a, b in ((0, 1), (0, 5), (9, 17)):
        x, y = (shingles(docs[k][1], 5) for k in (a, b))
        alike = (hasher.signature(sets[a]) == hasher.signature(sets[b])).mean()
        assert abs(alike - len(x & y) / len(x | y)) < 0.25
    assert (hasher.signature(sets[0][:1]) == sets[0][0]).all()  # one shingle fills every bin


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50, 90)] + [(7, k) for k in range(8, 40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 50 for i in range(50, 91)} | {i: 7 for i in range(7, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(int(k), (base[k % 60] + rng.normal(size=16) * (0.05 if k % 3 else 0.4) * (k // 60)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[5][1]) for k in range(4)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15)]
    found = embedding_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), rows_per_cell=50).collect()
    ids = [i for i, _ in rows]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    want = {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, linked.sum(axis=1))} | {i: (0, i, True) for i, _ in odd}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == want


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [0.0, 1.0]), (3, [1e200, 1e200]), (4, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, embedding_duplicates(rows).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False)], key=str)


def test_fingerprints_follow_the_edits(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ijklmnop") for _ in range(rng.choice([40, 400, 4000]))) for _ in range(60)]
    printer = EditFingerprinter()
    prints = printer(texts)
    assert prints == [printer([t])[0] for t in texts]
    changed = printer([edit(a, b) for a, b in zip(texts, texts[1:])])
    near = [likeness(a, b) for a, b in zip(prints, changed)]
    far = [likeness(a, b) for a, b in zip(prints, prints[1:])]
    assert min(near) > 0.35 and np.mean(near) > 0.5 and np.mean(far) < 0.25
    for a, b, x in zip(prints, changed, near):  # equal nibbles of the best walk, counted one by one
        walks = [sum(p == q for p, q in zip(a[k : k + 64], b[k : k + 64])) / 64 for k in (0, 64, 128)]
        assert len(a) == 192 and abs(x - max(0.0, (max(walks) - 1 / 16) / (15 / 16))) < 1e-12
    one = printer([t[: len(t) // 2] + "X" + t[len(t) // 2 + 1 :] for t in texts])
    assert np.median([likeness(a, b) for a, b in zip(prints, one)]) > 0.9


def test_edited_fingerprints_edges(spark, edge_docs, no_docs):
    assert edited_fingerprints(no_docs).count() == 0
    rows = edge_docs.select("doc_id", "text").collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    found = sorted(edited_fingerprints(edge_docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for k, (row, (i, text)) in enumerate(zip(found, ordered, strict=True)):
        changed = edit(text, ordered[(k + 1) % len(ordered)][1])
        assert (row.doc_id, row.n_chars, row.edited_sha256) == (i, len(text), sha256(changed.encode()).hexdigest())
    single = edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert single.edited_sha256 == sha256(b"abab").hexdigest() and single.near_next == 1.0


def edited_at_random(rng, text, share):
    out = []
    for c in text:
        if rng.random() < share:
            kind = rng.randrange(3)
            out += [[], [rng.choice("abcdefgh "), c], [rng.choice("abcdefgh ")]][kind]
        else:
            out.append(c)
    return "".join(out)


@pytest.mark.parametrize("n,share,pairs", [(100, 0.01, 120), (900, 0.01, 120), (5_000, 0.01, 120), (20_000, 0.01, 60), (120_000, 0.005, 40)])
def test_recall_of_fingerprints_on_random_edits(n, share, pairs):
    rng = random.Random(n)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [(" ".join(rng.choice(words) for _ in range(n // 3)))[:n] for _ in range(pairs)]
    printer = EditFingerprinter()
    prints, bands = printer.fingerprints_and_bands(texts)
    others, keys = printer.fingerprints_and_bands([edited_at_random(rng, t, share) for t in texts])
    found = (likenesses(prints, others) >= least_likeness(n)) & ((bands == keys) & (bands != 0)).any(axis=1)
    assert found.mean() >= 0.9
    far = likenesses(prints, prints[1:] + prints[:1])
    assert (far < least_likeness(n)).all() and ((bands == np.roll(bands, -1, axis=0)) & (bands != 0)).any(axis=1).mean() < 0.1


def test_near_documents_equal_all_pairs_of_their_buckets(spark, monkeypatch):
    """Buckets of many components, searched in several blocks."""
    from pulselake.llm import edit_embedding

    monkeypatch.setattr(edit_embedding, "BLOCK", 5)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij klmn") for _ in range(rng.choice([200, 900, 2500]))) for _ in range(8)]
    rows = [(k, b) for k, b in enumerate(base)] + [(100 + k, b[:150] + "Z" + b[151:]) for k, b in enumerate(base)] + [(200, base[0])]
    rows += [(300 + 20 * k + j, edited_at_random(rng, b, 0.03 * j / 20)) for k, b in enumerate(base) for j in range(20)]
    printer = EditFingerprinter()
    prints, bands = printer.fingerprints_and_bands([t for _, t in rows])
    linked = []
    for i in range(len(rows)):
        near = likenesses([prints[i]] * i, prints[:i]) >= least_likeness(np.maximum(len(rows[i][1]), [len(t) for _, t in rows[:i]])) if i else []
        shared = ((bands[i] == bands[:i]) | (np.array([[p == prints[i]] for p in prints[:i]]) if i else np.zeros((0, 1), bool))).any(axis=1)
        linked += [(rows[i][0], rows[j][0]) for j in range(i) if near[j] and shared[j]]
    root = brute_components([i for i, _ in rows], linked)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, key int")
    found = {r.doc_id: (r.component_id, r.kept) for r in near_documents(docs).collect()}
    assert found == {i: (c, i == c) for i, c in root.items()}
    assert all(found[100 + k][0] == k for k in range(8)) and found[200][0] == 0


def test_near_documents_edges(spark, edge_docs, no_docs):
    assert near_documents(no_docs).count() == 0
    found = sorted((r.doc_id, r.component_id) for r in near_documents(edge_docs).collect())
    assert found == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (9, 9)]
    assert {r.doc_id: r.component_id for r in edited_fingerprints(edge_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, None: None}
