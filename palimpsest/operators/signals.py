"""Probabilistic matching of two snapshots by content, path and metadata costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.similarity import Weights, content_cost, metadata_cost, path_cost


def _content(a: str, b: str) -> Column:
    return content_cost(*[F.col(f"{s}.{c}") for s in (a, b) for c in ("size", "raw_hash", "fast_hash")])


def _metadata(a: str, b: str) -> Column:
    return metadata_cost(F.col(f"{a}.mtime_ns"), F.col(f"{a}.mode"), F.col(f"{b}.mtime_ns"), F.col(f"{b}.mode"))


def match_files(files_a: DataFrame, files_b: DataFrame, weights: Weights = Weights(), threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, path_a, path_b, content, metadata, path, cost) of pairs whose weighted cost is below the threshold.

    Both sides hold the columns `keys`, and only rows that agree in them meet: so many pairs of snapshots go in one join.
    Unequal sizes cost the whole content weight, so when that reaches the threshold the join on size loses nothing and
    no cross join is made; other weights have to compare every pair of the two snapshots. Content and metadata are
    built in and cut pairs before the path cost runs in Python.
    """
    a, b = files_a.alias("a"), files_b.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, *(("size",) if weights.content >= threshold else ()))]
    pairs = a.join(b, on) if on else a.crossJoin(b)
    rows = pairs.select(*[F.col(f"a.{c}") for c in keys], F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), _content("a", "b").alias("content"), _metadata("a", "b").alias("metadata"))
    rows = rows.where(F.col("content") * weights.content + F.col("metadata") * weights.metadata < threshold)
    rows = rows.withColumn("path", path_cost("path_a", "path_b"))
    return rows.withColumn("cost", F.col("content") * weights.content + F.col("path") * weights.path + F.col("metadata") * weights.metadata).where(F.col("cost") < threshold)
