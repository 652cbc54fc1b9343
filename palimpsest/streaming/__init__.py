"""Manifests that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.schemas import MANIFEST


def follow_manifests(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Read each new manifest once and hand its file records to `handle(files, batch_id)`.

    Components merge when snapshots arrive, so labels are no monotone state: the handler runs the batch analysis on
    the stored files of the touched projects rather than keeping state in the stream.
    """
    raw = spark.readStream.schema(MANIFEST).option("multiLine", True).json(folder)
    files = raw.select(F.col("id").alias("snapshot_id"), F.explode("files").alias("f")).select("snapshot_id", "f.*")
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
