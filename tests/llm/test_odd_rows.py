"""Names that clash with the operators' own, very long runs of white space, and gates of both kinds."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, language_id, line_quality, mixing, simhash

CLASHES = ["_len", "_sha", "_start", "_by_len", "_by_start", "_slot", "_bucket", "_map", "_text", "_id", "_n", "_copies", "_row", "row", "h", "taken_id", "id", "copies", "size", "_key", "_gone", "component_id", "a.b"]


@pytest.fixture
def wide(spark):
    texts = ["one text of some words", "one text of some words", "another one", None, "", "  \n "]
    rows = [(i, t, "en", f"s{i % 2}", *range(100 * i, 100 * i + len(CLASHES))) for i, t in enumerate(texts)]
    names = ["doc_id long", "text string", "lang string", "source string", *[f"`{c}` int" for c in CLASHES]]
    return spark.createDataFrame(rows, ", ".join(names))


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_clashing_names(wide):
    rows = told(wide)
    assert told(exact_dedup.drop_copies(wide)) == [rows[k] for k in (1, 2, 4, 5)]
    mixed = mixing.mixed(wide)
    assert mixed.columns == wide.columns and set(told(mixed)) <= set(rows)
    assert told(language_id.keep_identified(wide)) == rows[:3]
    kept = simhash.drop_near_duplicates(wide)
    assert kept.columns == wide.columns and told(kept) == [rows[k] for k in (0, 2, 3)]


def test_mixed_takes_each_document_as_often_as_told(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 3}", i * 7) for i in range(60)], "doc_id long, text string, source string, _n long")
    want = Counter({r.doc_id: r.copies for r in mixing.fair_mix(docs).collect() if r.copies})
    got = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r._n == 7 * r.doc_id and r.text == "w " * (r.doc_id % 9 + 1) for r in got)


def test_runs_of_white_space(spark):
    blanks = " \t" * 500_000
    docs = spark.createDataFrame([(1, "a" + blanks + "b"), (2, blanks), (3, blanks + "a b" + blanks), (4, "\x0b a\x0c\r\nb\x85c\x1c ")], "doc_id long, text string")
    for count in (mixing.n_words(F.col("text")), F.size(line_quality.words(F.col("text")))):
        began = time.time()
        assert [r[0] for r in docs.orderBy("doc_id").select(count).collect()] == [2, 0, 2, 2]
        assert time.time() - began < 10
    began = time.time()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines) for r in line_quality.cleaned(docs).collect()}
    assert got == {1: (2, 2, 0), 2: (0, 0, 0), 3: (2, 2, 0), 4: (2, 5, 0)} and time.time() - began < 20


@pytest.mark.parametrize("keys", [exact_dedup.GATE_KEYS, 1, -1])
def test_both_gates(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "GATE_KEYS", keys)
    texts = ["x" * 300 + str(i % 5) for i in range(20)] + ["y" * 300, "z" * 301, "alone", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    want = sorted((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)
    assert sorted(tuple(r) for r in exact_dedup.exact_copies(docs).collect()) == want
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == sorted(max(g) for g in groups.values())
