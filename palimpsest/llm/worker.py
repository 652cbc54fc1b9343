"""Memory of Python workers: batches in small slices, and nothing kept back when a task ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from palimpsest.runtime import release

#: Rows and bytes of a batch between the JVM and a worker.
BATCH_ROWS = 1500
BATCH_BYTES = "16m"
#: What operators keep in a worker from task to task, by operator.
_KEPT: dict[str, dict] = {}
#: Rows that a worker has done by groups since it gave memory back.
_done = [0]


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds twice, in an Arrow buffer beside the JVM's heap and in its worker; lower settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, "1b") == "1b":  # not set by the user
        spark.conf.set(size, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows`; after the last one, free memory goes back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
    release()


def kept(operator: str) -> dict:
    """What an operator keeps in this worker. What others kept is given back first: workers outlive the stage that they
    were started for, and would hold its model in idleness beside the next one's."""
    if _KEPT.keys() - {operator}:
        _KEPT.clear()
        release()
    return _KEPT.setdefault(operator, {})


def done(rows: int, most: int) -> None:
    """Give memory back after every `most` rows, over all groups and tasks of a worker."""
    _done[0] += rows
    if _done[0] > most:
        _done[0] = 0
        release()
