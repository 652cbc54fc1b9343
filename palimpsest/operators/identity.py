"""Logical-file identities: paths joined by equal content, as connected components of path, hash and anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components

SEP = "\x1f"


def _node(kind: str, value: Column) -> Column:
    """Anchors ('0') sort before paths ('1'), so the smallest node of a component is its smallest anchor if it has one."""
    return F.concat(F.col("project_uid"), F.lit(SEP + kind), value)


def assign_identities(files: DataFrame, known: DataFrame | None = None, blocking: bool = False) -> DataFrame:
    """(project_uid, cluster_uid, anchored, snapshot_id, path), one row per file.

    files needs snapshot_id, path, raw_hash (with blocking also size and fast_hash) and may have project_uid.
    known(hash, cluster_uid) anchors content to earlier identities. A hash adds one edge per path, never pairs.
    """
    if "project_uid" not in files.columns:
        files = files.withColumn("project_uid", F.lit("default"))
    rows = files.withColumn("_node", _node("1", F.col("path")))
    key = ["project_uid", "raw_hash", *(["size", "fast_hash"] if blocking else [])]
    hashed = rows.where("raw_hash <> ''" + " and fast_hash <> ''" * blocking).select(*key, "_node").distinct()
    edges = hashed.join(hashed.groupBy(*key).agg(F.min("_node").alias("_low")), key).select(F.col("_node").alias("src"), F.col("_low").alias("dst"))
    if known is not None:
        anchored = rows.where("raw_hash <> ''").join(known.select(F.col("hash").alias("raw_hash"), F.col("cluster_uid").alias("_uid")), "raw_hash")
        edges = edges.union(anchored.select(F.col("_node").alias("src"), _node("0", F.col("_uid")).alias("dst")))
    found = connected_components(edges)
    out = rows.join(found, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("component", "_node"))
    tail = F.substring_index("_root", SEP, -1)
    anchored = F.substring(tail, 1, 1) == "0"
    uid = F.when(anchored, F.substring(tail, 2, 1 << 30)).otherwise(F.concat_ws(":", F.col("project_uid"), F.substring(tail, 2, 1 << 30)))
    return out.select("project_uid", uid.alias("cluster_uid"), anchored.alias("anchored"), "snapshot_id", "path")


def canonical_paths(observations: DataFrame) -> DataFrame:
    """(project_uid, cluster_uid, path, n): each cluster's commonest path, on ties the one seen first."""
    seen = observations.groupBy("project_uid", "cluster_uid", "path").agg(F.countDistinct("snapshot_id").alias("n"), F.min(F.struct("snapshot_id", "path")).alias("first"))
    best = seen.groupBy("project_uid", "cluster_uid").agg(F.max("n").alias("n"))
    top = seen.join(best, ["project_uid", "cluster_uid", "n"])
    return top.groupBy("project_uid", "cluster_uid", "n").agg(F.min("first").alias("first")).select("project_uid", "cluster_uid", F.col("first.path").alias("canonical_path"), "n")


def clusters(observations: DataFrame) -> DataFrame:
    """Nested form: a sorted observation array and the canonical path per cluster."""
    nested = observations.groupBy("project_uid", "cluster_uid").agg(F.array_sort(F.collect_set(F.struct("snapshot_id", "path"))).alias("observations"))
    return nested.join(canonical_paths(observations).drop("n"), ["project_uid", "cluster_uid"]).withColumn("confidence", F.lit(1.0))


def first_cluster(observations: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(snapshot_id, path) with the smallest cluster that holds it, null if none does."""
    one = observations.groupBy("snapshot_id", "path").agg(F.min("cluster_uid").alias("cluster_uid"))
    return wanted.join(one, ["snapshot_id", "path"], "left")


def numbered(ids: DataFrame, order: str = "snapshot_id") -> DataFrame:
    """Snapshots in lexicographic id order (S10 before S2)."""
    return ids.withColumn("snapshot_idx", F.row_number().over(W.orderBy(order)) - 1)
