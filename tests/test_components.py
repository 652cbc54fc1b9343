"""Connected components of shapes that slow down label propagation, by rounds of contraction and by union-find."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components


def labels(spark, edges, **options):
    df = spark.createDataFrame(edges, "src long, dst long").repartition(4)
    rows = connected_components(df, **options).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def shapes():
    """Edges of seven thousand nodes and more, and every node's component."""
    r = random.Random(4)
    perm = list(range(3000))
    r.shuffle(perm)
    edges = list(zip(perm, perm[1:], strict=False))  # a chain with random numbers
    want = dict.fromkeys(perm, 0)
    edges += [(10_000 + i, 9_999 + i) for i in range(3000, 0, -1)]  # one that falls
    want |= dict.fromkeys(range(10_000, 13_001), 10_000)
    for arm in range(50):  # a star of chains whose numbers fall away from the hub
        chain = [20_000, *[20_001 + 40 * arm + k for k in range(39, -1, -1)]]
        edges += zip(chain, chain[1:], strict=False)
        want |= dict.fromkeys(chain, 20_000)
    edges += [(40_000, 40_000 + k) for k in range(1, 2500)]  # a hub
    want |= dict.fromkeys(range(40_000, 42_500), 40_000)
    r.shuffle(edges)
    return edges, want


def test_union_find(spark, shapes):
    edges, want = shapes
    assert labels(spark, edges) == want


@pytest.mark.parametrize("local", [0, 2000])
def test_rounds_are_few(spark, shapes, local):
    edges, want = shapes
    assert labels(spark, edges, local=local, rounds=20) == want


def test_odd_edges(spark):
    edges = [(1, 1), (None, 2), (3, None), (5, 4), (5, 4), (4, 5), (6, 5)]
    for local in (None, 0):
        assert labels(spark, edges, local=local) == {4: 4, 5: 4, 6: 4}
        assert labels(spark, [], local=local) == {}


def test_strings(spark):
    df = spark.createDataFrame([("b", "é"), ("é", "a"), ("x", "\U0001f600"), ("￿", "x")], "src string, dst string")
    for local in (None, 0):
        got = {r.node: r.component for r in connected_components(df, local=local).collect()}
        assert got == {"a": "a", "b": "a", "é": "a", "x": "x", "￿": "x", "\U0001f600": "x"}


def test_edges_that_differ_between_evaluations(spark):
    """A random spanning tree of the same nodes each time it is computed."""
    parent = F.udf(lambda i: random.randrange(i), "long").asNondeterministic()
    rows = spark.range(1, 400).select(parent("id").alias("src"), F.col("id").alias("dst"))
    got = {r.node: r.component for r in connected_components(rows).collect()}
    assert got == dict.fromkeys(range(400), 0)
