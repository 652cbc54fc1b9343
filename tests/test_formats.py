"""Texts of timelines: the log, lines of JSON, changes and commit messages."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import timeline
from palimpsest.sinks import formats, trees

OPS = "op_ord int, op_type string, file_id string, source_path string, target_path string, old_hash string, new_hash string, confidence double"


def operations(spark):
    rows = [
        (0, "create", "n", None, "n", None, "1", 1.0),
        (1, "delete", "d", "d", None, "2", None, 1.0),
        (2, "modify", "m", "m", "m", "3", "4", 1.0),
        (3, "rename", "a", "a", "b", "5", "5", 1.0),
        (4, "copy", "a", "a", "c", "5", "5", 0.8),
        (5, "create", "n", None, "n", None, "1", 1.0),
        (6, "odd", "x", None, None, None, None, 1.0),
    ]
    return spark.createDataFrame(rows, OPS)


def test_changes(spark):
    got = trees.changes(operations(spark)).orderBy("op_ord").collect()
    assert [r.shown for r in got] == ["  + n (created)", "  - d (deleted)", "  ~ m (modified)", "  > a -> b", "  = a -> c (copied)", "  + n (created)", None]
    assert got[0].told == {"op": "create", "new_path": "n", "new_hash": "1"} and got[6].told == {"op": "odd"}


def test_messages(spark):
    ops = operations(spark).withColumn("snapshot_id", F.lit("S1"))
    got = {r.snapshot_id: r.message for r in trees.summaries(ops).collect()}
    counts = "1 copy, 1 create, 1 delete, 1 modify, 1 odd, 1 rename"
    lists = "\nCreate:\n  n\nModify:\n  m\nRename:\n  b\nDelete:\n  d\nCopy:\n  c"
    assert got == {"S1": f"Snapshot: S1\n\n{counts}{lists}"}


def test_log(spark):
    snaps = spark.createDataFrame(
        [("S0", 0, None, "/a"), ("S1", 1, 1784228146.9, "/a"), ("S2", 2, 0.0, "/b")], "snapshot_id string, snapshot_idx int, timestamp double, source_path string"
    )
    one = operations(spark).withColumn("pair_idx", F.lit(0)).where("op_ord = 0").drop("op_ord")
    told = formats.to_log(timeline.build_timeline(snaps, one)).split("\n")
    assert told[:6] == ["commit S0", "Date:   unknown", "root: /a", "", "\t0 operations", ""]
    assert told[6:12] == ["commit S1", "Date:   Thu Jul 16 18:55:46 2026 +0000", "root: /a", "", "\t1 operation", ""]
    assert told[12:] == ["commit S2", "Date:   Thu Jan 01 00:00:00 1970 +0000", "root: /b", "Root change: /a → /b", "", "\t0 operations", ""]


def test_lines_of_json(spark, tmp_path):
    ops = operations(spark).drop("op_ord").withColumns({"pair_idx": F.lit(0), "from_id": F.lit("S0"), "to_id": F.lit("S1")})
    formats.write_jsonlines(ops, str(tmp_path / "out"))
    rows = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert len(rows) == 7 and {tuple(r) for r in rows} == {("snapshot_id", "op_type", "file_id", "source_path", "target_path", "old_hash", "new_hash", "confidence")}
    assert {r["snapshot_id"] for r in rows} == {"S1"}
