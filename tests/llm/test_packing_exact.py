"""Bin completion against an exact packer, and its bounds."""

import random
from collections import Counter

import pytest

from palimpsest.llm import packing


def exact(items, limit):
    """Fewest bins, by the least fill of the last bin for every subset."""
    n = len(items)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, limit)
    for mask in range(1 << n):
        bins, fill = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                into = (bins, fill + items[i]) if fill + items[i] <= limit else (bins + 1, items[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], into)
    return best[-1][0]


def packed_into(counts, limit, **options):
    found = packing.plan(counts, limit, **options)
    held = Counter()
    for pattern, times in found:
        assert sum(s * n for s, n in pattern) <= limit and times > 0
        for s, n in pattern:
            held[s] += n * times
    assert held == Counter(counts)
    return sum(t for _, t in found)


@pytest.mark.parametrize("low, high, limit", [(20, 60, 100), (1, 100, 100), (1, 12, 20), (25, 45, 100)])
def test_small_instances_are_optimal(low, high, limit):
    r = random.Random(low * high)
    for _ in range(60):
        items = [r.randint(low, high) for _ in range(r.randint(1, 11))]
        want = exact(items, limit)
        assert packing.lower_bound(Counter(items), limit) <= want
        assert packed_into(Counter(items), limit) == want


def test_known_case():
    items = [23, 30, 30, 30, 34, 36, 37, 38, 39, 41, 46, 47, 58]
    assert packed_into(Counter(items), 100) == 5


def test_planted_perfect_packings():
    r = random.Random(9)
    for _ in range(20):
        items = []
        for _ in range(12):
            cuts = sorted(r.sample(range(1, 100), r.randint(1, 4)))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        assert packed_into(Counter(items), 100) <= 13


def test_large_counts():
    counts = {4096: 10**9, 2048: 3 * 10**9 + 1, 1500: 10**9, 700: 10**9, 3: 7}
    # whole ones alone, halves in pairs, two of 1500 beside one of 700, the other 700s by five
    assert packed_into(counts, 4096) == 10**9 + 15 * 10**8 + 1 + 5 * 10**8 + 10**8
    r = random.Random(3)
    many = Counter(r.randint(1000, 3000) for _ in range(5000))
    assert packed_into(many, 4096, nodes=2000) <= 1.01 * packing.lower_bound(many, 4096)
    assert packed_into({}, 10) == 0


def test_dominated_fillings():
    left = {2: 1, 3: 1, 5: 1, 6: 1}
    assert packing.dominated(((3, 1),), 6, [2, 3, 5, 6], left)  # 5 in the place of 3
    assert packing.dominated(((3, 1), (2, 1)), 6, [2, 3, 5, 6], left)  # 6 in the place of both
    assert not packing.dominated(((6, 1),), 6, [2, 3, 5, 6], left)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 3, 0, 40 if i % 2 else 60) for i in range(30)]
    got = packing.placed(spark.createDataFrame(rows, "doc_id long, piece int, length long"), limit=100).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == 30 and len({p[0] for p in places}) == 15
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter(rows)
