"""Folders in, timelines out."""

import json
import os
import subprocess

import pytest

from palimpsest import cli
from palimpsest.kb.store import KnowledgeStore
from palimpsest.plans import analysis
from palimpsest.sinks import trees
from palimpsest.sources import timelines, tree


@pytest.fixture
def root(tmp_path):
    for i, files in enumerate([{"a.txt": "one", ".hidden": "h", "d/e": "x"}, {"b.txt": "one", ".hidden": "h2", "d/e": "x"}]):
        for name, text in files.items():
            p = tmp_path / "in" / f"S{i}" / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        os.symlink("nowhere", tmp_path / "in" / f"S{i}" / "link")
    return tmp_path


def test_read_tree(spark, root):
    got = {(r.snapshot_id, r.path): r for r in tree.read_tree(spark, str(root / "in")).collect()}
    assert len(got) == 8 and got["S0", "link"].is_symlink and got["S0", "link"].raw_hash == ""
    assert got["S0", "a.txt"].raw_hash == got["S1", "b.txt"].raw_hash
    assert tree.snapshot_dirs(str(root / "none")) == [] and [d for d, _ in tree.snapshot_dirs(str(root), -1)] == ["in/S0", "in/S1"]


def test_manifest_round_trip(spark, root):
    files = tree.read_tree(spark, str(root / "in"))
    tree.save_manifest(files, "S0", "/x", None, str(root / "m.json"))
    back, snaps = tree.read_manifests(spark, str(root / "m.json"))
    assert sorted(map(tuple, back.select("path", "raw_hash", "size").collect())) == sorted(map(tuple, files.where("snapshot_id = 'S0'").select("path", "raw_hash", "size").collect()))
    assert snaps.first().timestamp is None


def test_cli(spark, root, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["diff", str(root / "in/S0"), str(root / "in/S1")]) == 0
    out = capsys.readouterr().out
    assert "rename a.txt b.txt 1.0" in out and "modify .hidden .hidden 1.0" in out
    kb = ["--kb-path", str(root / "kb")]
    assert cli.main(["analyze", str(root / "in"), "--out", str(root / "t.json"), *kb]) == 0
    assert [n["snapshot_id"] for n in json.loads((root / "t.json").read_text())["nodes"]] == ["S0", "S1"]
    assert cli.main(["analyze", str(root / "in"), "--out", str(root / "g"), "--format", "git", *kb]) == 0
    assert subprocess.run(["git", "-C", str(root / "g"), "ls-files"], capture_output=True, text=True, check=True).stdout.split() == [".hidden", "b.txt", "d/e", "link"]
    assert cli.main(["analyze", str(root / "in"), "--out", str(root / "w"), "--format", "working-copy", *kb]) == 0
    assert (root / "w/Snapshots/latest/b.txt").read_text() == "one"
    assert cli.main(["analyze", str(root / "none"), "--out", str(root / "x"), *kb]) == 1


def test_timeline_read_back(spark, root):
    ops = [{"op_type": "rename", "file_id": "d/a", "source_path": "d/a", "target_path": "e/b", "confidence": 0.8}, {"source_path": "f/c"}, None]
    (root / "n.json").write_text(json.dumps({"nodes": [{"snapshot_id": "S0"}, None, {"snapshot_id": "S1", "parent_id": "S0", "operations": ops}]}))
    nested = timelines.read_timeline(spark, str(root / "n.json")).orderBy("snapshot_idx").collect()
    assert [(r.snapshot_id, r.parent_id, len(r.operations)) for r in nested] == [("S0", None, 0), ("S1", "S0", 2)]
    assert tuple(nested[1].operations[1]) == ("modify", "", "f/c", None, None, None, 1.0)
    flat = {"snapshots": [{"id": "S0"}, {"id": "S1", "timestamp": 5}], "operations": [{"snapshot_id": "S1", **ops[1]}, {"snapshot_id": "S1", **ops[0]}, {"snapshot_id": "gone"}]}
    (root / "f.json").write_text(json.dumps(flat))
    back = timelines.read_timeline(spark, str(root / "f.json"))
    assert [(r.snapshot_id, r.timestamp, [o.source_path for o in r.operations]) for r in back.orderBy("snapshot_idx").collect()] == [("S0", None, []), ("S1", 5.0, ["f/c", "d/a"])]
    part = timelines.subtree(back, "e/").orderBy("snapshot_idx").collect()
    assert [[(o.source_path, o.target_path, o.file_id) for o in r.operations] for r in part] == [[], [("d/a", "b", "d/a")]]
    assert timelines.subtree(back, ".") is back
    with pytest.raises(FileNotFoundError):
        timelines.read_timeline(spark, str(root / "none.json"))


def test_working_copy_grows(spark, root):
    (root / "in/S1/d/e").unlink()
    dirs = {i: str((root / f"in/S{i}").rename(root / "in" / i)) for i in ("0", "1")}
    found = analysis.compare_timeline(*[tree.read_tree(spark, f, single="true") for f in dirs.values()], tuple(dirs.values()))
    out = root / "w"
    trees.export_working_copy(found, dirs, str(out))
    assert (out / "Snapshots/1/.fh-deleted/d/e").read_text() == "x" and (out / "Snapshots/1/.fh-renamed/a.txt").read_text() == "one"
    assert "  - d/e (deleted)" in json.loads((out / "Snapshots/1/CHANGES.txt").read_text())["human"]
    trees.export_working_copy(found, dirs, str(root / "w2"), exclude_deleted=True)
    assert not (root / "w2/Snapshots/1/.fh-deleted").exists()
    new = root / "S2"
    new.mkdir()
    (new / "c.txt").write_text("one")
    (new / ".hidden").write_text("h2")
    os.symlink("nowhere", new / "link")
    trees.round_trip(spark, str(out), str(new))
    rows = timelines.read_timeline(spark, str(out / "timeline.json")).orderBy("snapshot_idx").collect()
    assert [(r.snapshot_id, r.parent_id) for r in rows] == [("0", None), ("1", "0"), ("S2", "1")]
    assert [tuple(o)[:4] for o in rows[2].operations] == [("rename", "b.txt", "b.txt", "c.txt")]
    assert sorted(p.name for p in (out / "Content").iterdir()) == [".hidden", "c.txt", "link"] and os.readlink(out / "Snapshots/latest") == "S2"
    with pytest.raises(ValueError):
        trees.round_trip(spark, str(out), str(new))
    trees.export_git_from_json(spark, str(out / "timeline.json"), str(root / "in"), str(root / "g"))
    git = lambda *a: subprocess.run(["git", "-C", str(root / "g"), *a], capture_output=True, text=True, check=True).stdout
    assert git("log", "--format=%s").split("\n")[:2] == ["Snapshot: 1", "Snapshot: 0"]
    assert set(json.loads(git("notes", "--ref", "fh/metadata", "show", "HEAD"))["files"]) == {".hidden", "b.txt", "link"}


def test_corrections_and_rollback(spark, root, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    kb = ["--kb-path", str(root / "kb")]
    (root / "c.json").write_text(json.dumps([{"hash": "h", "override_cluster_uid": "u"}, {"hash": "x"}, 3, {"hash": "h", "override_cluster_uid": "v"}]))
    run = ["analyze", str(root / "in"), "--out", str(root / "t.json"), *kb]
    assert cli.main([*run, "--apply", str(root / "c.json")]) == 0 and "2 corrections" in capsys.readouterr().out
    assert [tuple(r) for r in KnowledgeStore(spark, str(root / "kb")).open().tables["identities"].collect()] == [("h", "v", 1.0)]
    assert cli.main([*run, "--kb-rollback", "7"]) == 1
    (root / "bad.json").write_text("{}")
    assert cli.main([*run, "--apply", str(root / "bad.json")]) == 1
    capsys.readouterr()
    assert cli.main(["log", str(root / "t.json"), "--subtree", "d"]) == 0 and "commit S1" in capsys.readouterr().out
    assert cli.main(["diff", str(root / "in/S0"), str(root / "in/S1"), "--format", "json"]) == 0
    assert [len(n["operations"]) for n in json.loads(capsys.readouterr().out)["nodes"]] == [0, 2]


def test_follow_manifests(spark, root):
    from palimpsest.streaming import follow_manifests

    (root / "m").mkdir()
    files = tree.read_tree(spark, str(root / "in"))
    seen = []
    for s in ("S0", "S1"):
        tree.save_manifest(files, s, "/x", None, str(root / "m" / f"{s}.json"))
        follow_manifests(spark, str(root / "m"), str(root / "ck"), lambda df, i: seen.extend(r.snapshot_id for r in df.select("snapshot_id").distinct().collect())).awaitTermination()
    assert seen == ["S0", "S1"]
