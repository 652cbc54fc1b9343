"""The whole analysis: projects, identities, operations, timeline."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.kb.store import KnowledgeStore
from palimpsest.operators import diff, identity, projects, timeline
from palimpsest.schemas import SNAPSHOTS


def analyze(files: DataFrame, roots: DataFrame, kb: KnowledgeStore | None = None, mode: str = "auto", diff_mode: str = "compat") -> DataFrame:
    """The timeline of all snapshots in id order. roots(snapshot_id, timestamp, source_path)."""
    stored_prints = kb.tables["projects"] if kb is not None and mode != "full" else None
    known = kb.tables["identities"] if kb is not None and mode != "full" else None
    groups = projects.group_snapshots(files, stored_prints, mode if stored_prints is not None else "full")
    observations = identity.assign_identities(files.join(groups, "snapshot_id"), known)
    snaps = identity.numbered(roots.select("snapshot_id", "timestamp", "source_path"))
    return timeline.build_timeline(snaps, diff.derive_operations(files, observations, snaps, diff_mode))


def compare(before: DataFrame, after: DataFrame, mode: str = "compat") -> DataFrame:
    """Operations from one snapshot to another, as one project."""
    files = before.withColumn("snapshot_id", F.lit("0")).unionByName(after.withColumn("snapshot_id", F.lit("1")))
    return diff.derive_operations(files, identity.assign_identities(files), identity.numbered(files.select("snapshot_id").distinct()), mode)


def compare_timeline(before: DataFrame, after: DataFrame, roots: tuple[str, str], mode: str = "compat") -> DataFrame:
    """The timeline of two snapshots, named by their folder or manifest."""
    names = [(str(i), i, None, str(Path(r).resolve())) for i, r in enumerate(roots)]
    snaps = before.sparkSession.createDataFrame(names, SNAPSHOTS)
    return timeline.build_timeline(snaps, compare(before, after, mode))
