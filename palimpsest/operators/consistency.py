"""Consistency checks. Every check is a DataFrame of conflicts; a report is their union."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import stored
from palimpsest.schemas import OP_TYPES


def _conflict(hash: Column, sources: Column, targets: Column, kind: str, a: Column, b: Column) -> list[Column]:
    return [hash.alias("hash"), sources.alias("source_paths"), targets.alias("target_paths"), F.lit(kind).alias("conflict_type"), a.alias("confidence_a"), b.alias("confidence_b")]


def _none() -> Column:
    return F.array().cast("array<string>")


def empty_clusters(clusters: DataFrame, observations: DataFrame) -> DataFrame:
    bare = clusters.join(observations.select("cluster_uid").distinct(), "cluster_uid", "left_anti")
    return bare.select(*_conflict(F.lit(""), F.array("cluster_uid"), _none(), "identity_mismatch", F.lit(0.0), F.lit(0.0)))


def uncovered(files: DataFrame, observations: DataFrame) -> DataFrame:
    """Files that no identity holds, as they are."""
    return files.join(observations.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_anti")


def uncovered_files(files: DataFrame, observations: DataFrame) -> DataFrame:
    return uncovered(files, observations).select(*_conflict(F.col("raw_hash"), F.array("path"), _none(), "identity_mismatch", F.lit(0.0), F.lit(0.0)))


def invalid_operations(operations: DataFrame) -> DataFrame:
    """Unknown kinds, and second and later operations on one file_id in a pair, in their order (op_ord if present)."""
    order = ["op_ord"] if "op_ord" in operations.columns else ["op_type", "source_path", "target_path"]
    hash_ = F.coalesce(F.nullif("old_hash", F.lit("")), "new_hash", F.lit(""))
    told = lambda kind: _conflict(hash_, F.array(F.coalesce("source_path", F.lit(""))), F.array(F.coalesce("target_path", F.lit(""))), kind, F.col("confidence"), F.lit(0.0))
    bad = operations.where(~F.col("op_type").isin(*OP_TYPES)).select(*told("path_mismatch"))
    again = operations.withColumn("_n", F.row_number().over(W.partitionBy("pair_idx", "file_id").orderBy(*order))).where("_n > 1")
    return bad.unionByName(again.select(*told("temporal_overlap")))


def path_discontinuity(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    rows = files.join(snapshots.select("snapshot_id", "source_path"), "snapshot_id").groupBy("path").agg(F.sort_array(F.collect_set("source_path")).alias("s"))
    return rows.where(F.size("s") > 1).select(*_conflict(F.lit(""), F.col("s"), F.array("path"), "path_mismatch", F.lit(0.5), F.lit(0.5)))


def temporal_overlap(snapshots: DataFrame, matches: DataFrame) -> DataFrame:
    """matches(snapshot_id, matched_id) whose times differ by less than a second; (a, b) and (b, a) both count."""
    a, b = snapshots.alias("a"), snapshots.alias("b")
    rows = matches.join(a, matches["snapshot_id"] == F.col("a.snapshot_id")).join(b, matches["matched_id"] == F.col("b.snapshot_id"))
    near = F.abs(F.col("a.timestamp") - F.col("b.timestamp")) < 1.0
    return rows.where(near).select(*_conflict(F.lit(""), F.array("a.source_path"), F.array("b.source_path"), "temporal_overlap", F.lit(0.3), F.lit(0.3)))


def hash_on_many_paths(files: DataFrame) -> DataFrame:
    rows = files.where("raw_hash <> ''").groupBy("raw_hash").agg(F.sort_array(F.collect_set("path")).alias("p"))
    return rows.where(F.size("p") > 1).select(*_conflict(F.col("raw_hash"), _none(), F.col("p"), "identity_mismatch", F.lit(0.7), F.lit(0.3)))


@dataclass
class Report:
    passes: bool
    conflicts: DataFrame
    iterations_used: int = 0
    relaxed: dict[str, float] = field(default_factory=dict)


def check_consistency(files: DataFrame, clusters: DataFrame, observations: DataFrame, operations: DataFrame | None = None) -> Report:
    found = empty_clusters(clusters, observations).unionByName(uncovered_files(files, observations))
    if operations is not None:
        found = found.unionByName(invalid_operations(operations))
    found = stored(found)
    return Report(not found.limit(1).count(), found)


def check_cross_location(files: DataFrame, snapshots: DataFrame, matches: DataFrame) -> DataFrame:
    return path_discontinuity(files, snapshots).unionByName(temporal_overlap(snapshots, matches)).unionByName(hash_on_many_paths(files))


def check_with_inner_loop(files: DataFrame, clusters: DataFrame, observations: DataFrame, operations: DataFrame | None = None, max_iterations: int = 2, step: float = 0.05) -> Report:
    """Relax until the check passes: round i keeps conflicts with confidence_a of at least 1 - i * step."""
    report = check_consistency(files, clusters, observations, operations)
    for i in range(1, max_iterations + 1):
        if report.passes:
            break
        threshold = max(1.0 - i * step, 0.0)
        kept = report.conflicts.where(F.col("confidence_a") >= threshold)
        report = Report(not kept.limit(1).count(), kept, i, {"confidence_threshold": threshold})
    return report
