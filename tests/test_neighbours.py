"""The costs of neighbouring snapshots reach every pair that can share a path."""

from pathlib import Path

import pytest

from palimpsest.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_all_pairs_are_there(spark):
    for name in ("content_cost_consecutive", "metadata_cost_consecutive", "path_cost_consecutive", "fused_matches_consecutive"):
        got = {r.pair_idx for r in queries.QUERIES[name](spark, SF).select("pair_idx").distinct().collect()}
        assert got >= {i for i in range(17) if i % 6 != 5}, name  # three folders of six versions
