"""Timelines: linear, filtered to a folder, grouped by time, and branching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.paths import under


def root_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, from_root, to_root) where the root differs from the snapshot before."""
    before = F.lag("source_path").over(W.orderBy("snapshot_idx"))
    return snapshots.withColumn("from_root", before).where(F.col("from_root") != F.col("source_path")).select("snapshot_id", "from_root", F.col("source_path").alias("to_root"))


def build_timeline(snapshots: DataFrame, operations: DataFrame) -> DataFrame:
    """A row per snapshot: parent_id, root_change ('from → to') and the array of operations that led to it."""
    w = W.orderBy("snapshot_idx")
    before = F.lag("source_path").over(w)
    nodes = snapshots.withColumn("parent_id", F.lag("snapshot_id").over(w)).withColumn("root_change", F.when(before != F.col("source_path"), F.concat(before, F.lit(" → "), "source_path")))
    fields = ("op_type", "file_id", "source_path", "target_path", "old_hash", "new_hash", "confidence")
    ops = operations.groupBy((F.col("pair_idx") + 1).alias("snapshot_idx")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("operations"))
    return nodes.join(ops, "snapshot_idx", "left").withColumn("operations", F.coalesce("operations", F.array().cast(ops.schema["operations"].dataType)))


def filter_by_subtree(operations: DataFrame, prefix: str) -> DataFrame:
    """Operations that touch a folder, with the touching paths rebased; file_id stays. '' and '.' change nothing."""
    prefix = prefix.rstrip("/")
    if prefix in ("", "."):
        return operations
    inside = lambda c: F.coalesce(under(F.col(c), prefix), F.lit(False))
    out = operations.where(inside("source_path") | inside("target_path"))
    for c in ("source_path", "target_path"):
        out = out.withColumn(c, F.when(inside(c), F.expr(f"substring({c}, {len(prefix) + 2})")).otherwise(F.col(c)))
    return out


def temporal_groups(events: DataFrame, time: str, keys: list[str], gap: float = 3600.0, id: str | None = None) -> DataFrame:
    """events with group_no: a new group begins after more than `gap` seconds; null times join the key's last group."""
    w = W.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), *([id] if id else []))
    step = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    rows = events.withColumn("_step", step)
    return rows.withColumn("group_no", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def branching(snapshots: DataFrame, edges: DataFrame, arrays: bool = True) -> DataFrame:
    """Nodes of a version graph: n_parents, n_children, is_root, is_leaf, is_fork, is_merge; with arrays also their ids.

    edges(parent_id, child_id); ids that occur only on edges become nodes too. The arrays are for graphs that are shown:
    a hub's neighbours meet in one row there, while the counts are summed before they are shuffled.
    """
    ids = snapshots.select("snapshot_id").union(edges.select("parent_id")).union(edges.select("child_id")).distinct()
    edges = edges.select("parent_id", "child_id").distinct()
    out = ids
    for own, other, n, names in (("child_id", "parent_id", "n_parents", "parent_ids"), ("parent_id", "child_id", "n_children", "children_ids")):
        sums = [F.count(F.lit(1)).alias(n), *([F.array_sort(F.collect_list(other)).alias(names)] if arrays else [])]
        out = out.join(edges.groupBy(F.col(own).alias("snapshot_id")).agg(*sums), "snapshot_id", "left")
        out = out.withColumn(n, F.coalesce(n, F.lit(0).cast("long")))
        if arrays:
            out = out.withColumn(names, F.coalesce(names, F.array().cast("array<string>")))
    n, m = F.col("n_parents"), F.col("n_children")
    return out.withColumns({"is_root": n == 0, "is_leaf": m == 0, "is_fork": m > 1, "is_merge": n > 1})


def node_operations(operations: DataFrame) -> DataFrame:
    """operations(parent_id, child_id, ...) by node, one row each: those of all its parents stand on one snapshot."""
    return operations.withColumnRenamed("child_id", "snapshot_id").where("snapshot_id is not null")


def ordered_ends(nodes: DataFrame, ordering: DataFrame) -> DataFrame:
    """(kind, snapshot_id, place) of the roots and leaves of `branching`, by place in ordering(snapshot_id, position).

    An id that ordering has twice goes by its later position; ids it does not have come last, by name.
    """
    at = ordering.groupBy("snapshot_id").agg(F.max("position").alias("position"))
    kinds = F.array_compact(F.array(F.when(F.col("is_root"), F.lit("root")), F.when(F.col("is_leaf"), F.lit("leaf"))))
    ends = nodes.where("is_root or is_leaf").select("snapshot_id", F.explode(kinds).alias("kind")).join(at, "snapshot_id", "left")
    order = W.partitionBy("kind").orderBy(F.col("position").asc_nulls_last(), "snapshot_id")
    return ends.select("kind", "snapshot_id", (F.row_number().over(order) - 1).alias("place"))
