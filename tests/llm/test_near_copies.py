"""The near-copy stage against all pairs of five-word sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import near_copies, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def pairs_at(rows, least=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    return [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if len(a & b) >= least * len(a | b)]


def kept(rows, pairs):
    comp = {i: i for i, _ in rows}
    for a, b in pairs:
        x, y = comp[a], comp[b]
        comp = {i: min(x, y) if c in (x, y) else c for i, c in comp.items()}
    return sorted(set(comp.values()))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    body = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    out = []
    for changes in (1, 2, 3, 5, 6, 7, 8, 10, 14) * 4:  # about 0.97 down to 0.6
        w = body(300)
        out.append(w)
        for _ in range(3):
            c = list(w)
            for p in r.sample(range(300), changes):
                c[p] = f"new{r.randrange(10**6)}"
            out.append(c)
    line = body(12)
    out += [line * 40 + body(150) for _ in range(6)]  # one repeated line, other bodies
    out += [["short"], ["Short"], ["two", "words"], []]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())


@pytest.mark.parametrize("block", [near_copies.BLOCK, 2])
def test_stage_finds_what_all_pairs_find(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    pairs = pairs_at(texts)
    assert len(pairs) > 40
    assert ids(spark, texts) == kept(texts, pairs)


def test_similar_is_the_real_jaccard(monkeypatch, texts):
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    near = near_copies.similar([near_copies.shingles(t, 5) for _, t in texts], 0.8)
    assert sorted((int(a), int(b)) for a, b in np.argwhere(near) if a > b) == sorted(pairs_at(texts))


def test_repeated_and_null_ids(spark, texts):
    rows = [(1, texts[0][1]), (1, texts[0][1] + " end"), (None, texts[0][1]), (None, "alone here"), (2, texts[50][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 1, 2]
    assert corpus_pipeline.near(spark, docs.where("false"), "").count() == 0


def bits(a, b):
    return (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()


@pytest.mark.parametrize("block", [near_copies.BLOCK, 2])
@pytest.mark.parametrize("star", [near_copies.STAR, 2])
def test_simhash_links_are_checked(spark, texts, monkeypatch, block, star):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "STAR", star)
    copies = [(1000 + i, f"{t} end") for i, t in texts if i % 4 == 0 and t]
    rows = texts + copies + [(2000, "one two three four five six"), (2001, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(min(e), max(e)) for e in near_copies.simhash_links(docs, "doc_id", "text", 5, 0.8, 3).collect()}
    real = {(min(p), max(p)) for p in pairs_at(rows)}
    assert found and found <= real
    if star == block == 256:  # smaller stars fall apart, and MinHash finds the rest
        text = dict(rows)
        joined = kept(rows, found)
        close = {(a, b) for a, b in real if bits(text[a], text[b]) <= 3}
        assert close and joined == kept(rows, found | close)


def test_stage_goes_by_simhash(spark, monkeypatch):
    """Without the search beyond its radius, SimHash alone drops the copies within it."""
    w = [f"w{i}" for i in range(400)]
    near = next(" ".join(w[:p] + w[p + 1 :]) for p in range(400) if bits(" ".join(w), " ".join(w[:p] + w[p + 1 :])) <= 3)
    rows = [(1, " ".join(w)), (2, near), (3, "something else entirely")]
    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(near_copies, "minhash_links", lambda *a, **k: none, raising=False)
    monkeypatch.setattr(near_copies, "verified_links", lambda *a, **k: none, raising=False)
    assert ids(spark, rows) == [1, 3]
