"""Which folders are snapshots, from a listing of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import ancestors, dir_name


def listing(files: DataFrame) -> DataFrame:
    """(dir, has_file, has_dir), one row per entry: each file in its folder, each folder in its parent."""
    own = files.select(dir_name(F.col("path")).alias("dir"), F.lit(True).alias("has_file"), F.lit(False).alias("has_dir"))
    up = files.select(F.explode(ancestors(F.col("path"))).alias("child")).distinct()
    return own.unionByName(up.select(dir_name(F.col("child")).alias("dir"), F.lit(False).alias("has_file"), F.lit(True).alias("has_dir")))


def classify(entries: DataFrame) -> DataFrame:
    """(dir, kind): files_only, dirs_only, mixed or empty."""
    f, s = F.bool_or("has_file"), F.bool_or("has_dir")
    return entries.groupBy("dir").agg(F.when(f & s, "mixed").when(f, "files_only").when(s, "dirs_only").otherwise("empty").alias("kind"))


def discover(entries: DataFrame, max_depth: int = 1) -> DataFrame:
    """Snapshot folders by id. Depth 0: the root alone, if it has files ('.'); 1: every folder under the root; deeper or
    -1: the topmost folders that hold files, never the root."""
    kinds = classify(entries)
    if max_depth == 0:
        return kinds.where("dir = '' and kind in ('files_only', 'mixed')").select(F.lit(".").alias("snapshot_dir"))
    children = entries.select("dir").distinct()
    if max_depth == 1:
        return children.where("dir <> '' and not contains(dir, '/')").select(F.col("dir").alias("snapshot_dir")).orderBy("snapshot_dir")
    full = kinds.where("dir <> '' and kind in ('files_only', 'mixed')").select("dir")
    if max_depth > 0:
        full = full.where(F.size(F.split("dir", "/")) <= max_depth)
    above = full.select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    nested = above.join(full.select(F.col("dir").alias("up")), "up", "left_semi").select("dir").distinct()
    return full.join(nested, "dir", "left_anti").select(F.col("dir").alias("snapshot_dir")).orderBy("snapshot_dir")
