"""The relative parse: every factor's words lie at its source, no factor could go on, and nothing found is left out."""

import random

import numpy as np
import pytest

from palimpsest.llm import substring_dedup

SIZE = 35


@pytest.fixture(scope="module")
def docs():
    r = random.Random(8)
    body = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    a, b, c = body(120), body(90), body(45)
    out = [body(20) + a + body(5), body(3) + b, a[:70] + b[10:80], a[40:] + c + b, c + body(40), ["again"] * 90, body(400)]
    out += [body(r.randint(0, 40)) + c[r.randint(0, 10) :] for _ in range(60)]  # a passage of most documents
    out += [a, a, [], body(34)]
    return {n: w for n, w in enumerate(out)}


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("rows", [10_000, 7])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_factors_point_to_the_same_words_elsewhere(spark, docs, parts, rows, kind):
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in docs.items()], "doc_id long, text string")
    table = table.withColumn("doc_id", table.doc_id.cast(kind))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {int(r.doc_id): r for r in substring_dedup.duplicate_spans(table.repartition(parts), size=SIZE).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(docs)
    places = {}
    for n, w in docs.items():
        for i in range(len(w) - SIZE + 1):
            places.setdefault(tuple(w[i : i + SIZE]), []).append((n, i))
    texts = {got[n].name: n for n in docs}
    copies = [n for n, w in docs.items() if kind == "string" and list(docs.values()).count(w) > 1]  # they share a name
    for n, w in docs.items():
        inside = {p for k in places.values() if len(k) > 1 for m, i in k if m == n for p in range(i, i + SIZE)}
        parsed = got[n].factors
        assert {p for f in parsed for p in range(f.start, f.start + f.length)} == inside
        assert {p for s in got[n].spans for p in range(s.start, s.start + s.length)} == inside
        for f in parsed:
            source = docs[texts[f.source]][f.source_start : f.source_start + f.length]
            assert f.length >= SIZE and source == w[f.start : f.start + f.length]
            assert n in copies or (f.source, f.source_start) != (got[n].name, f.start)
        for f, g in zip(parsed, parsed[1:], strict=False):
            assert f.start < g.start and (f.source, f.source_start + g.start - f.start) != (g.source, g.source_start)
    assert any(len(r.factors) > len(r.spans) for r in got.values())  # spliced copies


def test_greedy_parse():
    starts, docs, places = np.array([7, 3, 4, 5, 8, 20, 8]), np.array([1, 0, 0, 1, 1, 2, 5]), np.array([9, 1, 2, 7, 10, 4, 0])
    first, n = substring_dedup.factors(starts, docs, places, 5)
    assert [(starts[i], int(k), docs[i], places[i]) for i, k in zip(first, n, strict=True)] == [(3, 6, 0, 1), (5, 5, 1, 7), (7, 6, 1, 9), (20, 5, 2, 4)]
    assert substring_dedup.covered(starts[first], n) == [(3, 10), (20, 5)]
    none = np.empty(0, np.int64)
    assert [len(x) for x in substring_dedup.factors(none, none, none, 5)] == [0, 0]
