"""Sharding, mixing, packing, archives and HTML against brute force and round trips."""

import io
import random
import re
import time
import zipfile
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings, strategies as st

from pulselake.llm import warc
from pulselake.llm.html_text import extract_text, page_text
from pulselake.llm.mixing import fair_targets, mix, mixed_copies
from pulselake.llm.packing import WordTokenizer, pack, piece_bounds, plan_best_fit, split_parts, tokenize_pieces
from pulselake.llm.sharding import rendezvous_shard, shard_slots
from pyspark.sql import functions as F


def test_shards_slots_and_growth(spark, edge_docs, no_docs):
    assert shard_slots(no_docs).count() == 0
    rows = edge_docs.select("doc_id", "text").collect()
    found = shard_slots(edge_docs).collect()
    assert len(found) == len(rows)
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == sizes
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rendezvous_weights_and_small_moves(spark):
    keys = spark.range(40_000)
    placed = keys.select(rendezvous_shard(F.col("id"), [1.0, 2.0, 1.0]).alias("s"), rendezvous_shard(F.col("id"), [1.0, 2.0, 1.0, 4.0]).alias("g")).collect()
    share = Counter(r.s for r in placed)
    assert abs(share[1] / 40_000 - 0.5) < 0.02 and abs(share[0] / 40_000 - 0.25) < 0.02
    assert all(r.g in (r.s, 3) for r in placed) and abs(sum(r.g == 3 for r in placed) / 40_000 - 0.5) < 0.02


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=2) | st.none(), st.integers(0, 10_000), max_size=8))
def test_targets_fill_the_budget_below_their_limits(sizes):
    targets = fair_targets(sizes)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))
    assert all(t <= 2 * sizes[s] + 1e-6 for s, t in targets.items())


def test_mix_meets_targets_and_repeats(spark, edge_docs, no_docs):
    assert mix(no_docs).count() == 0
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = edge_docs.select("doc_id", "text", "source").collect()
    found = mix(edge_docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r.doc_id, count(r.text)) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    targets, taken = fair_targets({s: sizes[s] for s in {r.source for r in rows}}), Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    again = mix(edge_docs).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)
    copies = mixed_copies(edge_docs, keep=("text",)).collect()
    assert sum(r.words for r in copies) == sum(taken.values())
    assert [r["at"] for r in copies] == sorted(r["at"] for r in copies)


def test_mix_serves_copies_as_a_queue_would(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 10, 200])), rng.choice("aaaab") if k % 7 else None) for k in range(400)] + [(7, "w w", "a"), (7, "w w", "a"), (None, "w", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _row int, words int")
    hashed = docs.select("doc_id", "text", "source", F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", F.length("text")), 1).alias("h"), F.xxhash64("text").alias("tie")).collect()
    size = lambda t: len(t.split())
    waiting, served, total = {}, Counter(), Counter()
    for r in sorted(hashed, key=lambda r: (r.h, r.doc_id or 0, size(r.text), r.tie)):
        waiting.setdefault(r.source, []).append((r.doc_id, size(r.text)))
        total[r.source] += size(r.text)
    targets = fair_targets(dict(total))
    line = []
    for source, queue in waiting.items():
        passed = 0
        for copy in range(2):
            for doc, words in queue:
                passed += words
                if words:
                    line.append((passed / targets[source], source or "", -1 if doc is None else doc, copy, words, source))
    taken, budget = Counter(), round(sum(targets.values()))
    for _, _, doc, copy, words, source in sorted(line):
        gets = max(0, min(words, round(targets[source]) - served[source], budget - sum(served.values())))
        served[source] += gets
        taken[doc] += gets
    found = Counter()
    for r in mix(docs).collect():
        found[-1 if r.doc_id is None else r.doc_id] += r.taken
    assert sum(found.values()) == sum(taken.values()) and sum(abs(found[k] - taken[k]) for k in found) <= len(targets)
    copies = mixed_copies(docs).collect()
    assert sum(r.words for r in copies) == sum(found.values()) and max(r["at"] for r in copies) <= 1.0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once_without_overlap(counts):
    plan, ranks, used = plan_best_fit(counts, 64), defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in plan:
        for k in range(n):
            ranks[length].append(rank + k)
            used[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items()}
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    # best-fit decreasing, item by item
    rooms: list[int] = []
    for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(64 - length)
    assert len(used) == len(rooms)


def test_piece_bounds():
    assert piece_bounds(1024, 1024) == [(0, 1024)]
    assert piece_bounds(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert piece_bounds(2048, 1024) == [(0, 1024), (1024, 1024)]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), WordTokenizer(path)


_WORDS = st.sampled_from(["a", "b", "'s", "12", "漢字", "é", ".", "!", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\u2003", "\r", "<|endoftext|>", "<|", "|>", "endoftext", "x" * 60])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(_WORDS, st.text(max_size=3)), max_size=25).map("".join))
def test_word_memory_gives_the_tokenizers_ids(tokenizers, text):
    whole, mine = tokenizers
    assert mine([text, "other " + text]) == [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in (text, "other " + text)]


_SIGNS = st.sampled_from(["a", "Z", "é", "ß", "×", "÷", "Ã", "漢", "e\u0301", "7", "'s", "'", ",", ".", "!?", "»", "_", " ", "  ", "\n", " \n", "\x1c", "\xa0", "\u3000", "<|endoftext|>"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(_SIGNS, max_size=12).map("".join), max_size=5))
def test_several_texts_get_the_tokenizers_ids(tokenizers, texts):
    whole, mine = tokenizers
    assert mine(texts) == [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    parts, counts = split_parts(texts)
    found = iter(parts.to_pylist())
    assert ["".join(next(found) for _ in range(n)) for n in counts] == texts and next(found, None) is None


def test_signs_after_a_word_make_no_new_word():
    import public_tokenizers

    tokenizer = WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer(["".join(f" {word}{sign}" for word in ("one", "été", "Straße") for sign in ("", ".", ",", "!", "?", ";", ":", ")", "..."))])
    assert len(tokenizer._memory) <= 3 + 8


def test_added_tokens_are_one_id(tokenizers):
    assert len(tokenizers[1](["a <|endoftext|> b"])[0]) == 4 * 4


def test_packing_round_trip(spark, tokenizers, edge_docs, no_docs):
    assert pack(no_docs).count() == 0
    rows = edge_docs.select("doc_id", "text").collect()
    ids = Counter()
    for r in rows:
        whole = [*tokenizers[0].encode(r.text or "", add_special_tokens=False).ids, 2]
        for piece, (start, length) in enumerate(piece_bounds(len(whole), 1024)):
            ids[r.doc_id, piece, start, length, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in whole[start : start + length]))] += 1
    found = pack(edge_docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == ids
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in found) // 1024) + 1
    texts = tokenize_pieces(edge_docs, with_ids=True).filter("doc_id = 7").first()
    assert zlib.crc32(bytes(texts.ids)) == texts.ids_crc32


def test_archives_round_trip(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", page), (1, None, page), (2, "u", page), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", page), (7, "u", "é" * 80), (1, None, page), (8, "u", "\r\n\r\n" * 60)]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, digest string")
    found = warc.archive_round_trip(spark, pages).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = 1 if h == page and i not in (1, None) else None
        want.append((i, len(b), sha256(b).hexdigest(), "revisit" if revisit else "response", revisit))
    assert Counter(map(tuple, found)) == Counter(want)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    packages = warc.write_packages(pages)
    records = warc.read_records(warc.locate_records(packages), payloads=True).filter("type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in records} == {h or "" for _, _, h in rows}


def test_directories_with_and_without_zip64(tmp_path):
    files = pafs.LocalFileSystem()
    for force in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            with z.open("a.txt", "w", force_zip64=force) as f:
                f.write(b"hello")
            z.writestr("b.txt", "world")
        (tmp_path / "z.zip").write_bytes(raw.getvalue())
        with files.open_input_file(str(tmp_path / "z.zip")) as f:
            members = {m.name: f.read_at(m.size, warc.data_offset(f, m)) for m in warc.read_directory(f)}
        assert members == {"a.txt": b"hello", "b.txt": b"world"}
    # a ZIP64 end record: move the 32-bit directory fields into one
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, size, offset = (int.from_bytes(data[end + a : end + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(4) + bytes(8) + count.to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + offset.to_bytes(8, "little")
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    tail = b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    (tmp_path / "z64.zip").write_bytes(data[:end] + record + locator + tail)
    with files.open_input_file(str(tmp_path / "z64.zip")) as f:
        assert [m.name for m in warc.read_directory(f)] == ["a.txt", "b.txt"]


PAGES = {
    "<p>One <b>two</b>\n three<p>Four<br>five": "One two three\n\nFour\nfive",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>2</table>": "Name       Qty\napple pie  2",
    "<div>a<div hidden>no</div><span style='display:none'>no</span><script>no</script>b</div>": "ab",
    "<title>no</title><body>yes<!-- no --><noscript>no</noscript>": "yes",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "a &lt;b&gt; &amp; &eacute;": "a <b> & é",
    "<dl><dt>k<dd>v</dl>": "k\n  v",
    "</p></div>stray <i>end": "stray end",
    "<a title='x>y'>link</a> 1 < 2": "link 1 < 2",
    "": "",
}


@pytest.mark.parametrize("source", PAGES)
def test_page_text(source):
    assert page_text(source) == PAGES[source]


VISIBLE = {
    "<div title=\"the hidden cost\">yes</div>": "yes",
    "<body class='a hidden b'><p class=\"a hidden b\">yes": "yes",
    "<a title=don't>Visible text. It's fine</a>": "Visible text. It's fine",
    "<a href=/x?q=\"a>yes</a> \"more\"": 'yes "more"',
    "<head><title>no</title><meta charset=x>yes <b>too</b>": "yes too",
    "<head><style>no</style><a href=x>yes</a>": "yes",
    "<div style=display:none>no</div><div data-style='display:none' HIDDEN=''>no</div>yes": "yes",
    "<div title='style=\"display:none\"'>yes</div>": "yes",
}


@pytest.mark.parametrize("source", VISIBLE)
def test_visible_text_is_kept(source):
    assert page_text(source) == VISIBLE[source]


LAYOUT = {
    "<p title=don't>hi</p><p title=can't>next</p>": "hi\n\nnext",
    "<p title=don't>hi</p><p>next</p>": "hi\n\nnext",
    '<a href="foo>text</a> more': "text more",
    "<div style=display:none>no</div>yes": "yes",
    "<div style='visibility:hidden'>no <i style=visibility:visible>yes</i> no</div>": "yes",
    "<table><tr><td><p>One<p>Two<ul><li>a<li>b</ul><td>right</table>": "One  right\n\nTwo\n\n- a\n- b",
    "<table><tr><td colspan=2>wide one<tr><td>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table>": "wide one\na  b\nc  d\n   e",
    "<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>": "漢字  x\nab    y",
    "a < b </ > <!x> <? y> <!-- no": "a < b",
    "a<!-->b<!--->c<!-- > -- --!>d": "abcd",
    "<p>one</x></p>two": "one\n\ntwo",
}


@pytest.mark.parametrize("source", LAYOUT)
def test_layout(source):
    assert page_text(source) == LAYOUT[source]


HARD = {
    "unmatched": "<b>" * 30_000 + "</x>" * 30_000,
    "quotes": '<a b="x>t ' * 30_000,
    "open paragraphs": "<b>" * 30_000 + "<p>" * 30_000,
    "nested tables": "<table><tr><td>" * 5_000 + "x",
    "lists": "<ul><li>x" * 30_000,
    "spans": "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 10_000,
    "one row": "<table><tr>" + "<td colspan=9>x" * 30_000,
    "wide cell": "<table><tr><td>" + "x" * 1_000_000 + "<td>y" + "<tr><td>a<td>b" * 10_000,
    "signs": "<" * 500_000,
    "whole page": "<p class='a b'>some words here <b>bold</b> &amp; more</p>\n" * 90_000,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_time_and_room_in_proportion(name):
    began = time.process_time()
    text = page_text(HARD[name])
    assert time.process_time() - began < 12 and len(text) < 20 * len(HARD[name])


class _Words(HTMLParser):
    """An independent reading of well-formed pages: words outside hidden elements."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.hidden.append(tag in ("head", "script", "style", "title") or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or ""))

    def handle_endtag(self, tag):
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.hidden.pop()

    def handle_data(self, data):
        if not any(self.hidden):
            self.words += data.split()


_TREES = st.recursive(
    st.sampled_from(["w1 ", " w2", "x &amp; y ", "&lt;b&gt; "]),
    lambda inner: st.tuples(st.sampled_from(["<div>|</div>", "<ul><li>|</li></ul>", "<p>|</p>", "<b>|</b> ", "<div hidden>|</div>", "<section style='display:none'>|</section>", "<table><tr><td>|</td><td> z </td></tr></table>", "<blockquote title=\"a > 'b\">|</blockquote>"]), st.lists(inner, max_size=3)).map(lambda t: t[0].replace("|", "".join(t[1]))),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(_TREES)
def test_words_are_those_of_another_parser(source):
    other = _Words()
    other.feed(source)
    # inline elements join words and table rows interleave cells, so the signs are compared
    assert sorted("".join(page_text(source).split()).replace("-", "")) == sorted("".join(other.words))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "<tr>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<div hidden>", "</div>", "x", " y\n", "<", "&amp;", "<script>", "</script>", "<caption>", "<td rowspan=2 colspan=3>", "<a b=\"", "<!--", "-->", "</td>", "</tr>"]), max_size=30))
def test_broken_markup_never_fails(parts):
    page_text("".join(parts))


def test_deep_nesting_and_edges(spark):
    assert page_text("<div>" * 5000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>a", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract_text(pages).collect()), key=str) == [(1, ""), (1, ""), (None, "a")]
    assert extract_text(pages.limit(0)).count() == 0
