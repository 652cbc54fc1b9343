"""Hand-built cases for the traps of the history operators."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import content, paths, similarity
from palimpsest.kb import feedback, rules
from palimpsest.kb.store import KnowledgeStore
from palimpsest.operators import consistency, diff, identity, projects, signals, timeline
from palimpsest.sources import discovery


def files(spark, *rows):
    """(snapshot, path, hash[, norm])"""
    full = [(s, p, len(h), 33188, 1000, h, (n[0] if n else h) or None, h) for s, p, h, *n in rows]
    return spark.createDataFrame(full, "snapshot_id string, path string, size long, mode int, mtime_ns long, raw_hash string, norm_hash string, fast_hash string")


def snaps(df):
    return identity.numbered(df.select("snapshot_id").distinct())


def ops(df, mode="compat"):
    found = diff.derive_operations(df, identity.assign_identities(df), snaps(df), mode)
    return sorted((r.pair_idx, r.op_type, r.source_path, r.target_path, r.confidence) for r in found.collect())


def test_diff_kinds(spark):
    df = files(spark, ("S0", "a", "1"), ("S0", "b", "2"), ("S0", "c", "3"), ("S0", "d/e", "5"), ("S1", "a", "9"), ("S1", "x", "2"), ("S1", "f/e", "5"), ("S1", "n", "7"), ("S1", "c", "3"), ("S1", "c2", "3"))
    got = ops(df)
    assert (0, "modify", "a", "a", 1.0) in got
    assert (0, "rename", "b", "x", 1.0) in got
    assert (0, "move", "d/e", "f/e", 1.0) in got
    assert (0, "create", None, "n", 1.0) in got
    assert (0, "copy", "c", "c2", 1.0) in got
    assert len(got) == 5


def test_diff_lost_copy_only_in_complete_mode(spark):
    df = files(spark, ("S0", "a", "1"), ("S0", "b", "1"), ("S1", "a", "1"))
    assert ops(df) == []
    assert ops(df, "complete") == [(0, "delete", "b", None, 1.0)]
    with pytest.raises(ValueError):
        ops(df, "other")


def test_line_ends_and_rename_is_delete_and_create(spark):
    df = files(spark, ("S0", "a", "1", "n"), ("S1", "b", "2", "n"))
    assert [x[1] for x in ops(df)] == ["create", "delete"]


def test_bridged_cluster_gives_confidence_08(spark):
    df = files(spark, ("S0", "a", "1", "n"), ("S1", "b", "2", "n"), ("S2", "a", "3"), ("S2", "b", "3"))
    assert (0, "rename", "a", "b", 0.8) in ops(df)


def test_symlinks_and_empty_files(spark):
    df = files(spark, ("S0", "l", ""), ("S0", "m", ""), ("S1", "l", ""), ("S0", "e", "z"), ("S0", "f", "z"))
    uid = {(r.snapshot_id, r.path): r.cluster_uid for r in identity.assign_identities(df).collect()}
    assert uid["S0", "l"] == uid["S1", "l"] != uid["S0", "m"]
    assert uid["S0", "e"] == uid["S0", "f"] == "default:e"


def test_order_is_lexicographic(spark):
    df = files(spark, *[(f"S{i}", "a", "1") for i in (0, 1, 2, 10)])
    assert [r.snapshot_id for r in snaps(df).orderBy("snapshot_idx").collect()] == ["S0", "S1", "S10", "S2"]


def test_anchors_name_clusters(spark):
    df = files(spark, ("S0", "a", "1"), ("S0", "b", "2"))
    known = spark.createDataFrame([("1", "zz"), ("1", "yy")], "hash string, cluster_uid string")
    got = {r.path: (r.cluster_uid, r.anchored) for r in identity.assign_identities(df, known).collect()}
    assert got == {"a": ("yy", True), "b": ("default:b", False)}


def test_few_snapshots_are_never_grouped(spark):
    df = files(spark, *[(s, p, p) for s in ("A", "B") for p in "abcd"])
    assert projects.group_snapshots(df).select("project_uid").distinct().count() == 2
    filler = files(spark, *[(f"F{i}", "q", f"q{i}") for i in range(7)])
    got = {r.snapshot_id: r.project_uid for r in projects.group_snapshots(df.unionByName(filler)).collect()}
    assert got["A"] == got["B"] == "A"
    assert len(set(got.values())) == 8
    with pytest.raises(ValueError):
        projects.group_snapshots(df, mode="odd")


def test_content_probe_prefers_share_then_depth(spark):
    large = files(spark, ("L", "x/y/1", "1"), ("L", "x/y/2", "2"), ("L", "z", "9"))
    ref = files(spark, ("R", "1", "1"), ("R", "2", "2"))
    assert [tuple(r) for r in projects.content_probe(large, ref).collect()] == [("x/y", 1.0)]
    assert projects.content_probe(large, ref.where("false")).count() == 0


def test_temporal_gap_is_strict_and_nulls_join_the_last(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3600.0), (3, 7201.0), (4, None)], "id long, t double").withColumn("k", F.lit(1))
    assert {r.id: r.group_no for r in timeline.temporal_groups(df, "t", ["k"], id="id").collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_branching(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "parent_id string, child_id string")
    got = {r.snapshot_id: (r.is_root, r.is_leaf, r.is_fork, r.is_merge) for r in timeline.branching(edges.select(F.col("parent_id").alias("snapshot_id")), edges).collect()}
    assert got["a"] == (True, False, True, False)
    assert got["d"] == (False, True, False, True)


def test_consistency_and_inner_loop(spark):
    df = files(spark, ("S0", "a", "1"), ("S0", "b", "2"))
    obs = identity.assign_identities(df)
    bare = obs.select("cluster_uid").distinct()
    assert consistency.check_consistency(df, bare, obs).passes
    report = consistency.check_with_inner_loop(df, bare, obs.where("path = 'a'"))
    assert report.passes and report.iterations_used == 1


def test_store_versions_and_rollback(spark, tmp_path):
    kb = KnowledgeStore(spark, str(tmp_path)).open()
    for uid in ("u1", "u2"):
        kb.upsert("identities", spark.createDataFrame([("h", uid, 1.0)], "hash string, cluster_uid string, confidence double"))
        kb.close()
    assert kb.tables["identities"].first().cluster_uid == "u2"
    kb.rollback(1)
    assert kb.tables["identities"].first().cluster_uid == "u1"
    with pytest.raises(ValueError):
        kb.rollback(0)
    with pytest.raises(FileNotFoundError):
        kb.rollback(9)
    (tmp_path / "current.json").write_text("{")
    with pytest.raises(ValueError):
        KnowledgeStore(spark, str(tmp_path)).open()


def test_feedback_counts_and_igs(spark, tmp_path):
    kb = KnowledgeStore(spark, str(tmp_path)).open()
    df = files(spark, ("S0", "a", "1"))
    prints = spark.createDataFrame([("p", "1", 1.0)], "uid string, hash string, weight double")
    out = feedback.analyze_with_project(kb, identity.assign_identities(df), prints)
    assert (out.projects_updated, out.igs) == (1, 1.0)
    c = spark.createDataFrame([("h", "a", "a")] * 3, "hash string, identity_a string, identity_b string")
    assert rules.growth_score(c).first().igs == -2.0


def test_signals_blocking_loses_nothing(spark):
    a = files(spark, ("A", "x", "11"), ("A", "y", "2"))
    b = files(spark, ("B", "x", "11"), ("B", "z", "333"))
    blocked = {tuple(r) for r in signals.match_files(a, b).select("path_a", "path_b").collect()}
    assert blocked == {("x", "x")}
    assert signals.match_files(a, b, similarity.Weights(0.1, 0.3, 0.1)).count() == 4


def test_discovery_depths(spark):
    listed = discovery.listing(spark.createDataFrame([("r.txt",), ("a/b/f",), ("a/b/c/g",), ("d/h",)], "path string"))
    found = lambda n: [r[0] for r in discovery.discover(listed, n).collect()]
    assert found(0) == ["."]
    assert found(1) == ["a", "d"] or set(found(1)) >= {"a", "d"}
    assert found(-1) == ["a/b", "d"]


def test_expressions(spark):
    row = spark.range(1).select(
        paths.path_change(F.lit("a/x"), F.lit("b/x")).alias("m"), paths.path_change(F.lit("a/x"), F.lit("b/y")).alias("r"), paths.ancestors(F.lit("f")).alias("none"),
        content.line_ending(F.lit("a\r\nb\n")).alias("mixed"), content.line_ending(F.lit("")).alias("lf"), paths.nfc(F.lit("é")).alias("nfc"), content.xxh64_seed0(F.lit("a")).alias("xx"),
    ).first()
    assert (row.m, row.r, row.none, row.mixed, row.lf, row.nfc, row.xx) == ("move", "rename", [], "mixed", "lf", "é", "d24ec4f1a98c6e5b")


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds(a, b):
    x = similarity.jaro_winkler(a, b)
    assert 0.0 <= x <= 1.0 and abs(x - similarity.jaro_winkler(b, a)) < 0.35
    assert similarity.jaro_winkler(a, a) == 1.0


def test_jaro_winkler_fixed():
    assert 1 - similarity.jaro_winkler("", "") == 0.0
    assert 1 - similarity.jaro_winkler("", "zzzz") == 1.0
    assert round(similarity.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert unicodedata.normalize("NFC", "é") == "é"


def test_store_records(spark, tmp_path):
    kb = KnowledgeStore(spark, str(tmp_path)).open()
    assert kb.get_identity("h") is None and kb.get_project("p") is None and kb.get_frequency("h") == 0 and not kb.dirty
    kb.set_project("p", {"h": 0.5})
    assert kb.increment_frequency("h") == 1 and kb.increment_frequency("h") == 2 and kb.dirty
    kb.close()
    again = KnowledgeStore(spark, str(tmp_path)).open()
    assert again.get_project("p") == {"h": 0.5} and again.get_frequency("h") == 2
    for bad in (3, "text", {"other": 1}, None):
        with pytest.raises(TypeError):
            again.add_contradiction(bad)
