"""Timelines written as folders or as a git repository, on the driver: the work is file copies, one snapshot at a time."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.analysis import compare
from palimpsest.runtime import stored
from palimpsest.sources.timelines import read_timeline
from palimpsest.sources.tree import read_tree

# The mark of a change by its kind, what is said after it, the names of a change's fields in CHANGES.txt,
# and where an exported snapshot keeps what is gone or has a new name.
MARKS = {"create": "+", "delete": "-", "modify": "~", "rename": ">", "move": ">", "copy": "="}
SAID = {"create": " (created)", "delete": " (deleted)", "modify": " (modified)", "copy": " (copied)"}
FIELDS = {"op_type": "op", "source_path": "old_path", "target_path": "new_path", "old_hash": "old_hash", "new_hash": "new_hash"}
DELETED, RENAMED, CHANGES = ".fh-deleted", ".fh-renamed", "CHANGES.txt"
KINDS = ("create", "modify", "rename", "move", "delete", "copy")


def _copy(src: Path, dst: Path) -> None:
    if src.is_symlink() or src.exists():
        dst.parent.mkdir(parents=True, exist_ok=True)
        if dst.is_symlink():
            dst.unlink()
        shutil.copy2(src, dst, follow_symlinks=False)


def _files(root: Path) -> list[Path]:
    return [p.relative_to(root) for p in sorted(root.rglob("*")) if p.is_file() or p.is_symlink()]


def _nodes(timeline: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in timeline.orderBy("snapshot_idx").collect()]  # a row per snapshot


def changes(operations: DataFrame) -> DataFrame:
    """operations with `shown`, the line by which people are told of each (null for kinds without a mark), and `told`,
    a map of the fields that are not null."""
    kind = F.col("op_type")
    table = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    one = kind.isin("create", "delete", "modify")
    paths = F.when(one, F.when(kind == "create", F.col("target_path")).otherwise(F.col("source_path")))
    paths = F.coalesce(paths, F.concat(F.coalesce("source_path", F.lit("None")), F.lit(" -> "), F.coalesce("target_path", F.lit("None"))))
    shown = F.concat(F.lit("  "), F.try_element_at(table(MARKS), kind), F.lit(" "), paths, F.coalesce(F.try_element_at(table(SAID), kind), F.lit("")))
    fields = F.map_filter(F.create_map(*[x for old, new in FIELDS.items() for x in (F.lit(new), F.col(old))]), lambda _, v: v.isNotNull())
    return operations.withColumns({"shown": shown, "told": fields})


def _changes(spark: SparkSession, node: dict) -> str:
    """CHANGES.txt of one snapshot: its operations for programs and for people."""
    fields = "op_type string, source_path string, target_path string, old_hash string, new_hash string"
    names = [f.split()[0] for f in fields.split(", ")]
    ops = spark.createDataFrame([tuple(op[n] for n in names) for op in node["operations"]], fields)
    rows = changes(ops).select("shown", "told").collect()  # in their order, like the snapshot's operations
    when = [] if node["timestamp"] is None else [f"Timestamp: {node['timestamp']}"]
    listed = [r.shown for r in rows if r.shown is not None]
    human = "\n".join([f"Snapshot: {node['snapshot_id']}", *when, "", "Changes:", *listed, "", f"{len(rows)} operations"])
    return json.dumps({"machine": [r.told for r in rows], "human": human}, indent=2)


def _write_snapshot(spark: SparkSession, top: Path, node: dict, folder: Path, before: Path | None, exclude_deleted: bool) -> None:
    """Snapshots/<id>: the files, those deleted since `before`, links from old names to new ones, and the changes."""
    own = top / "Snapshots" / node["snapshot_id"]
    own.mkdir(parents=True, exist_ok=True)
    for rel in _files(folder):
        _copy(folder / rel, own / rel)
    for op in node["operations"]:
        if op["op_type"] == "delete" and before is not None and not exclude_deleted and op["source_path"]:
            _copy(before / op["source_path"], own / DELETED / op["source_path"])
        elif op["op_type"] in ("rename", "move") and op["source_path"] and op["target_path"]:
            stub = own / RENAMED / op["source_path"]
            stub.parent.mkdir(parents=True, exist_ok=True)
            stub.unlink(missing_ok=True)
            os.symlink(os.path.relpath(own / op["target_path"], stub.parent), stub)
    (own / CHANGES).write_text(_changes(spark, node))


def _finish(top: Path, nodes: list[dict], latest: Path | None) -> None:
    """Content/ as the latest tree, the link to the latest snapshot, and timeline.json last, replaced in one step."""
    if nodes and latest is not None:
        fresh = top / "Content.new"
        shutil.rmtree(fresh, ignore_errors=True)
        fresh.mkdir(parents=True)
        for rel in _files(latest):
            _copy(latest / rel, fresh / rel)
        shutil.rmtree(top / "Content", ignore_errors=True)
        fresh.rename(top / "Content")
        link = top / "Snapshots" / "latest"
        link.unlink(missing_ok=True)
        os.symlink(nodes[-1]["snapshot_id"], link)
    flat = [{"snapshot_id": n["snapshot_id"], **op} for n in nodes for op in n["operations"]]
    heads = [{"id": n["snapshot_id"], "timestamp": n["timestamp"], "parent_id": n["parent_id"], "op_count": len(n["operations"])} for n in nodes]
    fresh = top / "timeline.json.new"
    fresh.write_text(json.dumps({"version": 1, "format": "working-copy", "snapshots": heads, "operations": flat}, indent=2))
    fresh.replace(top / "timeline.json")


def export_working_copy(timeline: DataFrame, folders: dict[str, str], out: str, exclude_deleted: bool = False) -> str:
    """Path of timeline.json, which keeps hashes and confidences, so that the timeline can be read back whole.

    Content/ is the latest tree. Snapshots/<id>/ holds a snapshot's own files rather than links into Content/, where
    later snapshots would overwrite them; beside them lie CHANGES.txt, .fh-deleted/ and .fh-renamed/. Snapshots without
    a folder keep their place in the timeline only.
    """
    top, nodes, before = Path(out), _nodes(timeline), None
    (top / "Snapshots").mkdir(parents=True, exist_ok=True)
    for n in nodes:
        here = folders.get(n["snapshot_id"])
        if here is not None:
            _write_snapshot(timeline.sparkSession, top, n, Path(here), before, exclude_deleted)
            before = Path(here)
    _finish(top, nodes, before if nodes and nodes[-1]["snapshot_id"] in folders else None)
    return str(top / "timeline.json")


def round_trip(spark: SparkSession, out: str, folder: str, timestamp: float | None = None) -> str:
    """Append a new snapshot, named by its folder, to an exported working copy; earlier snapshots are not touched.

    It is compared with Content/, the whole latest tree. A name already in the timeline is an error.
    """
    top, new = Path(out), Path(folder)
    nodes = _nodes(read_timeline(spark, str(top / "timeline.json")))
    node = {"snapshot_id": new.resolve().name, "timestamp": timestamp, "parent_id": None, "operations": []}
    if any(n["snapshot_id"] == node["snapshot_id"] for n in nodes):
        raise ValueError(f"already in the timeline: {node['snapshot_id']}")
    before = top / "Content"
    if nodes:
        node["parent_id"] = nodes[-1]["snapshot_id"]
        before.mkdir(parents=True, exist_ok=True)
        sides = [stored(read_tree(spark, str(p), single="true")) for p in (before, new)]
        fields = ("op_type", "file_id", "source_path", "target_path", "old_hash", "new_hash", "confidence")
        node["operations"] = [r.asDict() for r in compare(*sides).select(*fields).orderBy(*fields).collect()]
    _write_snapshot(spark, top, node, new, before if nodes else None, False)
    _finish(top, [*nodes, node], new)
    return str(top / "timeline.json")


def summaries(operations: DataFrame) -> DataFrame:
    """(snapshot_id, message): what a commit says about a snapshot's operations(snapshot_id, op_type, file_id, paths).

    First the number of different paths by kind, in the order of the kinds' names, then every path under its kind. A
    path is the new one, else the old one, else the file_id.
    """
    path = F.coalesce(F.nullif("target_path", F.lit("")), F.nullif("source_path", F.lit("")), "file_id")
    rows = operations.select("snapshot_id", "op_type", path.alias("path"), F.coalesce("op_ord", F.lit(0)).alias("at"))
    once = rows.groupBy("snapshot_id", "op_type", "path").agg(F.min("at").alias("at"))
    kinds = once.groupBy("snapshot_id", "op_type").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("at", "path"))).alias("paths")
    )
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("op_type"))
    count = F.concat_ws(" ", F.col("n").cast("string"), "op_type")
    listed = F.concat(F.lit("\n"), F.initcap("op_type"), F.lit(":\n"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("  "), p["path"])), "\n"))
    told = kinds.select("snapshot_id", F.struct("op_type", count.alias("x")).alias("count"), F.when(place > 0, F.struct(place.alias("i"), listed.alias("x"))).alias("part"))
    whole = told.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("count")).alias("counts"), F.array_sort(F.collect_list("part")).alias("parts"))
    line, rest = F.array_join(F.col("counts.x"), ", "), F.array_join(F.col("parts.x"), "")
    return whole.select("snapshot_id", F.concat(F.lit("Snapshot: "), "snapshot_id", F.lit("\n\n"), line, rest).alias("message"))


def _metadata(folder: Path) -> str:
    """Times and modes of the files, which git does not keep, and the folders without anything in them."""
    told = {}
    for rel in _files(folder):
        s = os.lstat(folder / rel)
        told[rel.as_posix()] = {"ctime_ns": s.st_ctime_ns, "mtime_ns": s.st_mtime_ns, "mode": s.st_mode}
    bare = sorted(Path(here).relative_to(folder).as_posix() for here, dirs, names in os.walk(folder) if not dirs and not names)
    return json.dumps({"files": told, "empty_dirs": bare}, indent=2)


def export_git(timeline: DataFrame, folders: dict[str, str], out: str, name: str = "history", email: str = "history@localhost", branch: str = "main") -> None:
    """A commit per snapshot with the snapshot's exact tree (deletes included) and notes with metadata and confidences.
    Snapshots without a folder get no commit."""
    top = Path(out)
    top.mkdir(parents=True, exist_ok=True)

    def git(*args: str, told: str | None = None) -> None:
        subprocess.run(["git", "-C", out, "-c", f"user.name={name}", "-c", f"user.email={email}", *args], check=True, capture_output=True, text=True, input=told)

    git("init", "-q", "-b", branch)
    ops = timeline.select("snapshot_id", F.posexplode("operations").alias("op_ord", "op")).select("snapshot_id", "op_ord", "op.*")
    messages = {r.snapshot_id: r.message for r in summaries(ops).collect()}  # a row per snapshot
    for n in _nodes(timeline):
        here = folders.get(n["snapshot_id"])
        if here is None:
            continue
        for p in top.iterdir():
            if p.name != ".git":
                shutil.rmtree(p) if p.is_dir() and not p.is_symlink() else p.unlink()
        for rel in _files(Path(here)):
            _copy(Path(here) / rel, top / rel)
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-F", "-", told=messages.get(n["snapshot_id"], f"Snapshot: {n['snapshot_id']}\n\nno changes"))
        git("notes", "--ref", "fh/metadata", "add", "-f", "-F", "-", told=_metadata(Path(here)))
        if n["operations"]:
            git("notes", "--ref", "fh/confidence", "add", "-f", "-F", "-", told=json.dumps({op["file_id"]: op["confidence"] for op in n["operations"]}, indent=2))


def export_git_from_json(spark: SparkSession, timeline_json: str, snapshots: str, out: str, **options: str) -> None:
    """The same from a stored timeline; a snapshot's folder is snapshots/<id>, and those without one are passed over."""
    timeline = stored(read_timeline(spark, timeline_json))
    found = {r[0]: str(Path(snapshots) / r[0]) for r in timeline.select("snapshot_id").collect()}  # a row per snapshot
    export_git(timeline, {k: p for k, p in found.items() if Path(p).is_dir()}, out, **options)
