"""A timeline as JSON, JSON lines, a log or a graph. Timelines are small: a row per snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nodes(timeline: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in timeline.orderBy("snapshot_idx").collect()]


def to_json(timeline: DataFrame, root_changes: DataFrame) -> str:
    keys = ("snapshot_id", "timestamp", "source_path", "parent_id", "root_change", "operations")
    return json.dumps({"root_changes": [r.asDict() for r in root_changes.collect()], "nodes": [{k: n[k] for k in keys} for n in _nodes(timeline)]}, indent=2)


def to_jsonlines(timeline: DataFrame) -> str:
    return "\n".join(json.dumps({"snapshot_id": n["snapshot_id"], **op}) for n in _nodes(timeline) for op in n["operations"])


def write_jsonlines(operations: DataFrame, folder: str) -> None:
    """The same for any number of operations: executors write a folder of JSON lines, in order of the pairs."""
    rows = operations.withColumn("snapshot_id", F.col("to_id")).drop("from_id", "to_id")
    names = [c for c in rows.columns if c not in ("snapshot_id", "pair_idx")]
    rows.repartitionByRange("pair_idx", "file_id").sortWithinPartitions("pair_idx", "file_id").select("snapshot_id", *names).write.option("ignoreNullFields", "false").json(folder)


def to_log(timeline: DataFrame) -> str:
    """One entry per snapshot: its id, time, root, a change of root if there is one, and the number of operations."""
    when = F.coalesce(F.date_format(F.timestamp_seconds(F.floor("timestamp")), "EEE MMM dd HH:mm:ss yyyy xx"), F.lit("unknown"))
    n = F.size("operations")
    unit = F.when(n == 1, F.lit(" operation")).otherwise(F.lit(" operations"))
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("commit "), "snapshot_id"),
        F.concat(F.lit("Date:   "), when),
        F.concat(F.lit("root: "), F.coalesce("source_path", F.lit(""))),
        F.concat(F.lit("Root change: "), "root_change"),  # concat_ws leaves out what is null
        F.lit(""),
        F.concat(F.lit("\t"), n.cast("string"), unit),
        F.lit(""),
    )
    return "\n".join(r.entry for r in timeline.orderBy("snapshot_idx").select(entry.alias("entry")).collect())  # a row per snapshot


def to_dot(nodes: DataFrame, counts: dict[str, int] | None = None) -> str:
    """nodes as `branching` gives them."""
    counts, rows = counts or {}, nodes.orderBy("snapshot_id").collect()
    lines = [f'  "{r.snapshot_id}" [label="{r.snapshot_id}' + (f"\\n{counts[r.snapshot_id]} ops" if counts.get(r.snapshot_id) else "") + '"];' for r in rows]
    return "\n".join(["digraph timeline {", *lines, *[f'  "{r.snapshot_id}" -> "{c}";' for r in rows for c in r.children_ids], "}"])
