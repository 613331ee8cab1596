"""The trigram language detector."""

import math
import re
from collections import Counter

import pytest

from pulselake.operators import language

TEXTS = [
    (1, "the river runs through the old town and the people walk there", "en"),
    (2, "where is the house that the children painted this morning", "en"),
    (3, "el río pasa por la ciudad vieja y la gente camina por allí", "es"),
    (4, "dónde está la casa que los niños pintaron esta mañana", "es"),
    (5, "der Fluss läuft durch die alte Stadt und die Leute gehen dort", "de"),
    (6, None, "en"),
    (7, "", "es"),
    (8, "no language is given here", None),
]


def plain(texts, train):
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda t: Counter(f" {w} "[i : i + 3] for w in words(t) for i in range(len(w)))
    counts = {}
    for _, text, lang in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    kept = {g for c in counts.values() for g in c}
    weight = {lang: {g: math.floor(1000 * math.log((c[g] + 1) / (sum(c.values()) + len(kept)))) for g in kept} for lang, c in counts.items()}
    tally = Counter(lang for _, _, lang in train if lang)
    common = min(tally, key=lambda x: (-tally[x], x))
    out = {}
    for key, text, _ in texts:
        found = {g: n for g, n in grams(text).items() if g in kept}
        score = {lang: sum(n * w[g] for g, n in found.items()) for lang, w in weight.items()}
        sure = bool(found) and sum(map(len, words(text))) >= 10
        out[key] = (min(score, key=lambda x: (-score[x], x)), "model") if sure else (common, "default")
    return out


def test_detector_equals_plain_version(spark):
    more = [(20, "the people of the town", ""), (21, "la gente de la ciudad", ""), (22, "wo gehen die Leute", ""), (23, "short", ""), (24, "漢字" * 20, ""), (25, "1234 5678 ..", ""), (26, "zzzz " * 5, "")]
    schema = "doc_id long, text string, lang string"
    train, asked = spark.createDataFrame(TEXTS, schema), spark.createDataFrame(TEXTS + more, schema)
    model = language.fit(train)
    assert model.languages == ["de", "en", "es"] and model.default == "en"
    found = {r.doc_id: (r.language, r.method) for r in language.detect(asked, "doc_id", model).collect()}
    assert found == plain(TEXTS + more, TEXTS)
    assert [found[k][0] for k in (20, 21, 22)] == ["en", "es", "de"] and {found[k] for k in (6, 7, 23, 24, 25)} == {("en", "default")}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.filter("doc_id % 5 <> 0"))
    held = docs.filter("doc_id % 5 = 0")
    found = held.join(language.detect(held, "doc_id", model), "doc_id").collect()
    assert all(r.language for r in found)
    assert sum(r.language == r.lang for r in found) / len(found) > 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(none)
    some = spark.createDataFrame([(1, "a text of some letters")], "doc_id long, text string")
    assert [tuple(r) for r in language.detect(some, "doc_id", model).collect()] == [(1, None, "default")]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "LANGUAGES", 2)
        with pytest.raises(ValueError):
            language.fit(spark.createDataFrame(TEXTS, "doc_id long, text string, lang string"))
