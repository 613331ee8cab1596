"""Collocations, conversation repair and token counts against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from pulselake.llm import collocations as found_collocations
from pulselake.llm.collocations import SLICE_BYTES, collocations, frequent_phrases, key_filter
from pulselake.llm.common import new_path
from pulselake.llm.conversation_repair import cheapest_edits, damaged, edits, repaired
from pulselake.llm.token_counts import PieceCounter, counted_tokens, tokenizer_digest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    return counts, totals


def plain_collocations(rows, least, top, inside=80):
    out = []
    counts, totals = plain_counts(rows)
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not covered:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(seed, n=1200):
    rng = random.Random(seed)
    words = ["New", "york", "é", "Ein", "zwei\x1c", "漢", "the", "of", " x", "A\x00b", "i̇"]
    rows = []
    for _ in range(n):
        signs = [rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\x0b", "?"]) for _ in range(rng.randrange(12))]
        rows.append(("".join(signs), rng.choice(["en", "en", "de", None, ""])))
    return rows + [("same words here again", "en")] * 300


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_plain_version(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = sorted(tuple(r) for r in collocations(docs, least=6, top=25, shards=4).collect())
    assert found == plain_collocations(rows, 6, 25) and len(found) > 30


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_every_frequent_phrase_is_found_for_any_shards(spark, shards):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    phrases, totals = frequent_phrases(docs, least=5, shards=shards)
    counts, n = plain_counts(rows)
    want = {(lang, " ".join(p)): a for lang, f in counts.items() for p, a in f.items() if a >= 5}
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == want
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_only_phrases_frequent_in_all_shards_together_are_counted(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(9)), "en") for _ in range(2000)]
    sizes = []
    monkeypatch.setattr(found_collocations, "key_filter", lambda keys: sizes.append(keys.count()) or key_filter(keys))
    phrases, _ = frequent_phrases(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=45, shards=8)
    counts = {p: a for p, a in plain_counts(rows)[0]["en"].items() if a >= 45}
    assert {r.phrase: r.n for r in phrases.collect()} == {" ".join(p): a for p, a in counts.items()}
    assert sizes == [20, sum(len(p) == 2 for p in counts), sum(len(p) > 1 for p in counts)] and 0 < sizes[1] < 200


def test_many_ranges_of_keys_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(found_collocations, "GROUP_BYTES", 1000)
    rows = corpus(11) + [("", "fr"), ("nothing twice", "fr")]
    found = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, "text string, lang string").repartition(40), least=6, top=25, shards=4).collect())
    assert found == plain_collocations(rows, 6, 25) and len(found) > 30


def test_exact_counts_leave_tasks_in_lists(spark, monkeypatch):
    handed = []
    whole = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: handed.append(found := whole(self, run, schema)) or found)
    rows = [("a b c d e f g h i j k l m n", "en")] * 40
    phrases, _ = frequent_phrases(spark.createDataFrame(rows, "text string, lang string").repartition(2), least=30)
    assert phrases.filter("width > 1").count() == 13 + 12 + 11
    assert handed[-1].count() <= 4


def test_collocations_of_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.text, r.lang) for r in edge_docs.collect()]
    found = sorted(tuple(r) for r in collocations(edge_docs, least=2, top=50).collect())
    assert found == plain_collocations(rows, 2, 50) and found
    assert collocations(no_docs).collect() == []


def test_a_text_longer_than_a_slice_is_read_whole(spark):
    text = "left right " * (SLICE_BYTES // 11 + 100_000)
    [row] = [r for r in collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), top=5).collect() if r.phrase == "left right left right"]
    assert row.a == SLICE_BYTES // 11 + 100_000 - 1


def plain_edits(rows):
    """Least (cost, initials) by Dijkstra's search over whole prefixes."""
    heap = [(0, "", 0, 0)]
    while heap:
        cost, path, at, state = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, path
        for letter, more, taken, then in edits(rows[at] if at < len(rows) else None, state):
            if cost + more <= 40:
                heapq.heappush(heap, (cost + more, path + letter, at + taken, then))


def stated_edits(rows):
    """The same from the contract's words, by trying all edits of each row and the roles they give."""
    best = None
    stack = [("", 0, "", 0)]
    while stack:
        path, at, roles, cost = stack.pop()
        if best and (cost, path) > best:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, path), (cost, path))
        if len(roles) < 2 * len(rows) + 3 and cost <= 24:
            stack += [(path + "I", at, roles + r, cost + 3) for r in "ua" if not (len(roles) and roles[-1] == r)]
        if at < len(rows):
            initial, faulty, cut = rows[at]
            stack.append((path + "D", at + 1, roles, cost + 4))
            if not faulty:
                stack.append((path + "K", at + 1, roles + (initial or "?"), cost + 3 * cut))
                stack += [(path + "R", at + 1, roles + r, cost + 3 + 3 * cut) for r in "ua"]
    return best


def random_rows(rng, n):
    return [(rng.choice("suauaua?"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_cheapest_edits_equal_search_over_everything():
    rng = random.Random(3)
    for _ in range(150):
        rows = random_rows(rng, rng.randrange(5))
        assert cheapest_edits(rows) == stated_edits(rows)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(9))
        assert cheapest_edits(rows) == plain_edits(rows)
    assert cheapest_edits([("", False, False)]) == (4, "D")


def test_long_conversations_are_repaired_in_time_in_proportion():
    rng = random.Random(4)
    rows = [(("u", "a")[k % 2] if rng.random() > 0.05 else "u", rng.random() < 0.05, rng.random() < 0.05) for k in range(20_000)]
    cost, audit = cheapest_edits(rows)
    spent, state, at = 0, 0, 0
    for letter in audit:
        [(_, more, taken, state)] = [e for e in edits(rows[at] if at < len(rows) else None, state) if e[0] == letter]
        spent, at = spent + more, at + taken
    assert (spent, at) == (cost, len(rows)) and state in (0, 3)


def plain_repair(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    found = []
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in rows:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain_edits([(r[1][:1], f in ("b", "d"), f == "t") for r, f in zip(rows, faults)])
        done, at, due = [], 0, "user"
        for letter in audit:
            _, role, text = rows[at] if at < len(rows) else (None, "", "")
            at += letter != "I"
            if letter == "D":
                continue
            role, text = (role, text) if letter == "K" else (due, "" if letter == "I" else text)
            due = "user" if role[:1] in ("s", "a") else "assistant"
            done.append(f"{role}:{text}")
        counts = Counter(faults)
        found.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(found, key=repr)


def test_conversations_equal_plain_version(spark):
    rng = random.Random(5)
    texts = ["fine.", "cut", "", " \t\n\x0b\x0c\r", "end! ", "why?\n", "fine.", " ", "x" * 200_000 + ".", "é.", None]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2, 3, 3, 4, 9]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(300)]
    frame = spark.createDataFrame([(*r, 1, "x", True, 7) for r in rows], "conv_id long, turn long, role string, text string, kind int, audit string, gone boolean, cost int").repartition(4)
    assert sorted((tuple(r) for r in repaired(damaged(frame)).collect()), key=repr) == plain_repair(rows)
    assert repaired(damaged(frame.limit(0))).collect() == []


def test_a_conversation_that_loses_all_rows_stays(spark):
    [lost] = [k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:1]
    [row] = repaired(damaged(spark.createDataFrame([(lost, 0, "user", "hello.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    from pulselake.llm.token_counts import _path

    return PieceCounter(_path(MODEL))


def test_units_give_the_counts_of_whole_texts(pieces):
    assert pieces.by_units
    rng = random.Random(6)
    signs = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\r\n", "\t", "é", "漢", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", ".", ");\r", "\x00", " ", "'s", " " * 16, "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert pieces(texts) == pieces.whole(texts)
    assert pieces.whole([t.replace("▁", " ") for t in texts]) == pieces.whole(texts)


def test_token_counts_equal_the_library(spark, edge_docs, no_docs, pieces):
    found = counted_tokens(edge_docs, new_path(spark, "test-tokens"), limit=10).collect()
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    want = [(i, len(t.encode()), pieces.whole([t])[0]) for i, t in rows]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((*w, w[2] > 10) for w in want), key=repr)
    assert counted_tokens(no_docs, new_path(spark, "test-tokens")).collect() == []


def test_json_vocabularies_are_counted_by_their_library(spark, edge_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = counted_tokens(edge_docs, new_path(spark, "test-tokens"), vocabulary="byte_bpe_50k.json").select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in edge_docs.collect()), key=repr)


def test_only_distinct_misses_are_encoded_and_stored(spark):
    cache, schema = new_path(spark, "test-tokens"), "doc_id long, text string"
    version = tokenizer_digest(MODEL)
    stored = lambda: spark.read.parquet(f"{cache}/version={version}")
    first = spark.createDataFrame([(k, f"text {k % 3}") for k in range(30)], schema).repartition(4)
    want = {(r.doc_id, r.n_tokens) for r in counted_tokens(first, cache).collect()}
    assert stored().count() == 3 and len(want) == 30
    files = len(stored().inputFiles())
    assert {(r.doc_id, r.n_tokens) for r in counted_tokens(first, cache).collect()} == want
    assert stored().count() == 3 and stored().filter("n_tokens is null").isEmpty() and len(stored().inputFiles()) >= files
    more = first.union(spark.createDataFrame([(99, "text▁0"), (100, "text 9"), (101, None)], schema))
    assert counted_tokens(more, cache).count() == 33
    assert stored().count() == 5  # a space mark is a space; null is the empty text
    # what the cache holds is what is answered: nothing is encoded twice
    stored().withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(f"{cache}-2/version={version}")
    assert {r.n_tokens for r in counted_tokens(first, f"{cache}-2").collect()} == {n + 1000 for _, n in want}
    # two writers that appended one digest leave one count
    stored().write.mode("append").parquet(f"{cache}-2/version={version}")
    assert counted_tokens(first, f"{cache}-2").count() == 30
