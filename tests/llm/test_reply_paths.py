"""Paths of random trees against a plain walk, whatever the numbering."""

import random

import pytest

from palimpsest.llm import reply_trees


def plain(nodes, top):
    out = []
    for conv in {n[0] for n in nodes}:
        parent = {n: p for c, n, p, _ in nodes if c == conv}
        score = {n: s or 0.0 for c, n, _, s in nodes if c == conv}
        found = []
        for leaf in set(parent) - set(parent.values()):
            path, at = [], leaf
            while at in parent and at not in path:
                path.append(at)
                at = parent[at]
            if at not in path:
                found.append((-sum(score[x] for x in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:top], 1):
            out += [(conv, leaf, rank, depth, n) for depth, n in enumerate(path)]
    return sorted(out, key=str)


@pytest.mark.parametrize("top", [1, 3])
def test_paths_of_random_trees(spark, top):
    r = random.Random(top)
    nodes = []
    for conv in range(12):
        n = r.randint(1, 60)
        names = list(range(1, n + 1)) if conv % 3 else r.sample(range(500), n)
        for i, name in enumerate(names):
            back = 1 if r.random() < 0.7 else r.randint(1, 6)  # mostly chains
            nodes.append((conv, name, names[i - back] if i >= back else None, float(r.randint(0, 3))))
    nodes += [(20, 1, 2, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (21, 5, 99, None), (22, 1, 1, 0.0)]  # cycles, a missing parent
    nodes += [(23, i, i - 1, 1.0) for i in range(1, 300)]
    df = spark.createDataFrame(nodes, "conv long, node long, parent long, score double")
    got = sorted((tuple(x) for x in reply_trees.paths(df, top).collect()), key=str)
    assert got == plain(nodes, top)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    tree = reply_trees.thread(none)
    assert reply_trees.read_back(reply_trees.formatted(tree, reply_trees.paths(tree))).collect() == []
