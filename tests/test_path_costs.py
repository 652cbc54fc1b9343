"""Costs of paths that are little alike, against DuckDB: doc_ids of up to six digits share a text."""

import random

import duckdb
import pytest

from palimpsest.functions import similarity
from palimpsest.plans import oracle, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("paths"))
    r = random.Random(5)
    ids = sorted({int(10 ** r.uniform(0, 5.9)) for _ in range(240)})
    rows = [(i, f"the same text\nof copy {n % 4}", "en", "a") for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def same_as_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(oracle.SQL[name])
    columns = [d[0] for d in want.description]
    assert got.columns == columns
    return sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_similarity_is_duckdbs_to_the_last_bit():
    r = random.Random(6)
    path = lambda: r.choice(("p1/{}.txt", "p4/{}_r.txt", "moved/{}.txt", "copy/{}.txt")).format(int(10 ** r.uniform(0, 6)))
    pairs = [(path(), path()) for _ in range(20_000)] + [("p1/1.txt", "p1/382076_r.txt")]
    con = duckdb.connect()
    con.execute("create table t as select unnest($1) as a, unnest($2) as b", [[a for a, _ in pairs], [b for _, b in pairs]])
    assert con.execute("select jaro_winkler_similarity(a, b) from t").fetchall() == [(similarity.jaro_winkler(a, b),) for a, b in pairs]


def test_path_cost_consecutive(spark, folder):
    assert same_as_sql(spark, folder, "path_cost_consecutive")


def test_fused_matches(spark, folder):
    assert same_as_sql(spark, folder, "fused_matches")


def test_fused_matches_consecutive(spark, folder):
    assert same_as_sql(spark, folder, "fused_matches_consecutive")


def test_similarity_of_many_is_that_of_each():
    r = random.Random(7)
    text = lambda n: "".join(r.choice("ab/.é\0") for _ in range(r.randrange(n)))
    pairs = [(text(n), text(n)) for n in (6, 90) for _ in range(6000)] + [("", ""), ("", "a"), ("a\0", "a"), ("a" * 64, "a" * 64), ("ab" * 32, "ba" * 32)]
    a, b = map(list, zip(*pairs, strict=True))
    assert similarity.jaro_winkler_all(a, b).tolist() == [similarity.jaro_winkler(*p) for p in pairs]
    assert similarity.jaro_winkler_all([], []).tolist() == []


def test_similarity_of_many_is_duckdbs_to_the_last_bit():
    r = random.Random(8)
    path = lambda: r.choice(("p1/{}.txt", "p4/{}_r.txt", "moved/{}.txt", "copy/{}.txt")).format(int(10 ** r.uniform(0, 12)))
    a, b = [path() for _ in range(20_000)], [path() for _ in range(20_000)]
    con = duckdb.connect()
    con.execute("create table t as select unnest($1) as a, unnest($2) as b", [a, b])
    assert con.execute("select jaro_winkler_similarity(a, b) from t").fetchall() == [(x,) for x in similarity.jaro_winkler_all(a, b).tolist()]
