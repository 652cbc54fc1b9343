"""Exact matching of files between snapshots by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.content import usable_hash
from palimpsest.runtime import small


def _keyed(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(idx, hash, low): the smallest path of a hash in a snapshot; symlinks have no hash and drop out."""
    rows = files.where("raw_hash <> ''").groupBy("snapshot_id", F.col("raw_hash").alias("hash")).agg(F.min("path").alias("low"))
    return rows.join(small(snapshots.select("snapshot_id", F.col("snapshot_idx").alias("idx"))), "snapshot_id").select("idx", "hash", "low")


def match_consecutive(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(idx_a, idx_b, hash, path): hashes that neighbours share, with the smallest path of either side."""
    a, b = _keyed(files, snapshots).alias("a"), _keyed(files, snapshots).alias("b")
    on = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.idx") + 1 == F.col("b.idx"))
    return a.join(b, on).select(F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), F.col("a.hash").alias("hash"), F.least("a.low", "b.low").alias("path"))


def match_all_pairs(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same for every pair of snapshots: one join on the hash. The result itself holds a row per pair and hash."""
    a, b = _keyed(files, snapshots).alias("a"), _keyed(files, snapshots).alias("b")
    on = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.idx") < F.col("b.idx"))
    return a.join(b, on).select(F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), F.col("a.hash").alias("hash"), F.least("a.low", "b.low").alias("path"))


def inverted_index(files: DataFrame) -> DataFrame:
    """(hash, snapshot_id, path) of every usable hash, left flat so that no hash becomes one huge row."""
    return files.withColumn("hash", usable_hash()).where("hash is not null").select("hash", "snapshot_id", "path")


def nested_index(files: DataFrame) -> DataFrame:
    """hash with its sorted array of observations, for small results."""
    return inverted_index(files).groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("snapshot_id", "path"))).alias("observations"))


def hash_frequency(files: DataFrame) -> DataFrame:
    """Number of snapshots that hold a hash."""
    return inverted_index(files).groupBy("hash").agg(F.countDistinct("snapshot_id").alias("freq"))
