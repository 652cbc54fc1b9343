"""Timelines read back from JSON: what `analyze` writes (nested nodes) and what a working copy holds (flat lists)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATION = "op_type string, file_id string, source_path string, target_path string, old_hash string, new_hash string, confidence double"
HEAD = "timestamp double, parent_id string"
NESTED = f"nodes array<struct<snapshot_id string, {HEAD}, source_path string, root_change string, operations array<struct<{OPERATION}>>>>"
FLAT = f"format string, snapshots array<struct<id string, {HEAD}>>, operations array<struct<snapshot_id string, {OPERATION}>>"
# What a missing field stands for.
DEFAULTS = {"op_type": "modify", "file_id": "", "confidence": 1.0}


def _whole(op: Column) -> Column:
    """One operation with its fields in order and its gaps filled."""
    names = [f.split()[0] for f in OPERATION.split(", ")]
    return F.struct(*[(F.coalesce(op[n], F.lit(DEFAULTS[n])) if n in DEFAULTS else op[n]).alias(n) for n in names])


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A row per snapshot, as `build_timeline` gives them, in the order of the file.

    Missing fields take their defaults; null entries are left out; a working copy's operations meet their snapshot by
    its id, in the order of the file, and those of no listed snapshot are left out.
    """
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    nested = spark.read.schema(NESTED).option("multiLine", True).json(path).where("nodes is not null")
    nodes = nested.select(F.posexplode(F.filter("nodes", lambda n: n.isNotNull()))).select("pos", "col.*")
    flat = spark.read.schema(FLAT).option("multiLine", True).json(path).where("snapshots is not null")
    ops = flat.select(F.posexplode(F.filter("operations", lambda o: o.isNotNull()))).select(F.col("col.snapshot_id").alias("id"), F.struct("pos", F.col("col").alias("op")).alias("o"))
    told = ops.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: _whole(o["op"])).alias("operations"))
    heads = flat.select(F.posexplode(F.filter("snapshots", lambda s: s.isNotNull()))).select("pos", "col.*")
    none = F.lit(None).cast("string")
    listed = heads.join(told, "id", "left").select("pos", F.col("id").alias("snapshot_id"), "timestamp", "parent_id", F.lit("").alias("source_path"), none.alias("root_change"), "operations")
    rows = nodes.withColumn("operations", F.transform(F.filter("operations", lambda o: o.isNotNull()), _whole)).unionByName(listed)
    empty = F.array().cast(f"array<struct<{OPERATION}>>")
    return rows.select(
        F.col("pos").alias("snapshot_idx"), F.coalesce("snapshot_id", F.lit("")).alias("snapshot_id"), "timestamp", F.coalesce("source_path", F.lit("")).alias("source_path"),
        "parent_id", "root_change", F.coalesce("operations", empty).alias("operations"),
    )


def subtree(timeline: DataFrame, prefix: str) -> DataFrame:
    """timeline with only the operations that touch a folder, rebased to it; every snapshot stays. '' and '.' change nothing."""
    prefix = prefix.rstrip("/")
    if prefix in ("", "."):
        return timeline
    inside = lambda p: F.coalesce(F.startswith(p, F.lit(prefix + "/")), F.lit(False))
    cut = lambda p: F.when(inside(p), F.substring(p, len(prefix) + 2, 1 << 30)).otherwise(p)
    rebase = lambda o: o.withField("source_path", cut(o["source_path"])).withField("target_path", cut(o["target_path"]))
    return timeline.withColumn("operations", F.transform(F.filter("operations", lambda o: inside(o["source_path"]) | inside(o["target_path"])), rebase))
