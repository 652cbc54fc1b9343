"""python -m palimpsest.cli analyze|diff|log|round-trip|git-export|kb-status"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.kb.corrections import apply_corrections
from palimpsest.kb.store import KnowledgeStore
from palimpsest.operators.timeline import root_changes
from palimpsest.plans.analysis import analyze, compare, compare_timeline
from palimpsest.runtime import local_session, stored
from palimpsest.sinks import formats, trees
from palimpsest.sources.timelines import read_timeline, subtree
from palimpsest.sources.tree import read_manifests, read_tree, snapshot_dirs

KB_PATH = str(Path.home() / ".palimpsest" / "kb")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("root")
    a.add_argument("--out", "-o", default="timeline.json")
    a.add_argument("--format", "-f", default="json", choices=["json", "jsonlines", "gitlog", "working-copy", "git"])
    a.add_argument("--mode", "-m", default="auto", choices=["full", "delta", "auto"])
    a.add_argument("--apply", help="JSON array of corrections to identities")
    a.add_argument("--kb-rollback", type=int, help="first make the N-th last knowledge version current")
    a.add_argument("--kb-path", default=KB_PATH)
    a.add_argument("--recursive", "-r", action="store_true")
    a.add_argument("--max-depth", "-d", type=int, help="default 1, with --recursive -1 (no bound)")
    d = sub.add_parser("diff")
    d.add_argument("before", help="folder or manifest")
    d.add_argument("after", help="folder or manifest")
    d.add_argument("--format", "-f", default="plain", choices=["plain", "json", "jsonlines", "gitlog"])
    g = sub.add_parser("log")
    g.add_argument("timeline")
    g.add_argument("--subtree", default="")
    t = sub.add_parser("round-trip")
    t.add_argument("working_copy")
    t.add_argument("folder")
    e = sub.add_parser("git-export")
    e.add_argument("timeline")
    e.add_argument("snapshots")
    e.add_argument("out")
    k = sub.add_parser("kb-status")
    k.add_argument("--kb-path", default=KB_PATH)
    return p


def _side(spark: SparkSession, path: str) -> DataFrame:
    """Files of one snapshot, from a folder or a manifest."""
    return stored(read_tree(spark, path, single="true") if Path(path).is_dir() else read_manifests(spark, path)[0])


def _text(timeline: DataFrame, form: str) -> str:
    if form == "json":
        return formats.to_json(timeline, root_changes(timeline))
    return formats.to_jsonlines(timeline) if form == "jsonlines" else formats.to_log(timeline)


def _knowledge(spark: SparkSession, args: argparse.Namespace) -> KnowledgeStore | None:
    """The store as the options ask for it: rolled back, corrected, and left out where nothing is known."""
    if args.kb_rollback is not None:
        KnowledgeStore(spark, args.kb_path).rollback(args.kb_rollback)
        print(f"knowledge rolled back by {args.kb_rollback}")
    if args.mode == "full" and args.apply is None and args.kb_rollback is None:
        return None
    kb = KnowledgeStore(spark, args.kb_path).open()
    if args.apply is not None:
        n = apply_corrections(kb, args.apply)
        print(f"{n} corrections applied")
        kb.close()
    return None if args.mode == "auto" and not kb.has_data() else kb


def _analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        kb = _knowledge(spark, args)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    depth = args.max_depth if args.max_depth is not None else -1 if args.recursive else 1
    dirs = snapshot_dirs(args.root, depth)
    if not dirs:
        print("no snapshots", file=sys.stderr)
        return 1
    files = stored(read_tree(spark, args.root, max_depth=str(depth)))
    roots = spark.createDataFrame([(i, str(Path(f).resolve())) for i, f in dirs], "snapshot_id string, source_path string").withColumn("timestamp", F.unix_timestamp().cast("double"))
    found = stored(analyze(files, roots, kb, args.mode))
    if args.format == "working-copy":
        trees.export_working_copy(found, dict(dirs), args.out)
    elif args.format == "git":
        trees.export_git(found, dict(dirs), args.out)
    else:
        Path(args.out).write_text(_text(found, args.format))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = local_session()
    if args.command == "analyze":
        return _analyze(spark, args)
    if args.command == "diff":
        sides = [_side(spark, x) for x in (args.before, args.after)]
        if args.format != "plain":
            print(_text(stored(compare_timeline(*sides, (args.before, args.after))), args.format))
            return 0
        for r in compare(*sides).orderBy("op_type", "source_path", "target_path").collect():
            print(r.op_type, r.source_path or "", r.target_path or "", r.confidence)
    elif args.command == "log":
        print(formats.to_log(subtree(read_timeline(spark, args.timeline), args.subtree)))
    elif args.command == "round-trip":
        print(trees.round_trip(spark, args.working_copy, args.folder))
    elif args.command == "git-export":
        trees.export_git_from_json(spark, args.timeline, args.snapshots, args.out)
    else:
        for name, n in KnowledgeStore(spark, args.kb_path).open().counts().items():
            print(f"{name}: {n}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
