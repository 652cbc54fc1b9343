"""The driver's documents as file histories.

`doc_files`: each source is a snapshot. `history_files`: every document has six versions in one of three folders, with
edits, renames, moves, copies and line-end changes laid out by arithmetic on doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.content import line_ending

DOC_FILES = """
SELECT source AS snapshot_id, concat(lang, '/', cast(doc_id div 20 AS string), '.txt') AS path, text AS content, doc_id, 0 AS v FROM documents
"""

HISTORY = """
SELECT concat('F', cast(doc_id % 3 AS string), '/S', cast(v AS string)) AS snapshot_id,
  CASE WHEN (doc_id + v) % 11 = 0 THEN concat('moved/', cast(doc_id AS string), '.txt')
       WHEN (doc_id + v) % 7 = 0 THEN concat('p', cast(doc_id % 5 AS string), '/', cast(doc_id AS string), '_r.txt')
       ELSE concat('p', cast(doc_id % 5 AS string), '/', cast(doc_id AS string), '.txt') END AS path,
  CASE WHEN doc_id % 17 = v THEN replace(text, char(10), concat(char(13), char(10)))
       WHEN doc_id % 5 = 0 AND v >= doc_id % 6 THEN concat(text, ' v', cast(v AS string)) ELSE text END AS content, doc_id, v
FROM documents LATERAL VIEW explode(sequence(0, 5)) AS v WHERE (doc_id + 3 * v) % 13 <> 0
UNION ALL
SELECT concat('F', cast(doc_id % 3 AS string), '/S', cast(v AS string)), concat('copy/', cast(doc_id AS string), '.txt'), text, doc_id, v
FROM documents LATERAL VIEW explode(sequence(3, 5)) AS v WHERE doc_id % 19 = 0
"""


def _records(rows: DataFrame) -> DataFrame:
    c = F.col("content")
    return rows.select(
        "snapshot_id",
        "path",
        F.octet_length(c).cast("long").alias("size"),
        (F.lit(33188) + (F.col("doc_id") + F.col("v")) % 2 * 73).cast("int").alias("mode"),
        ((F.lit(1_700_000_000) + F.col("doc_id") * 60 + F.col("v") * 7200) * 1_000_000_000).cast("long").alias("mtime_ns"),
        F.sha2(c, 256).alias("raw_hash"),
        F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")), 256).alias("norm_hash"),
        line_ending(c).alias("line_ending"),
        F.md5(c).alias("fast_hash"),
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark.sql(DOC_FILES.replace("documents", "{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet")))


def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark.sql(HISTORY.replace("documents", "{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet")))


def snapshots(files: DataFrame) -> DataFrame:
    """Snapshots of a history, in id order, with a time and a root derived from the id."""
    ids = files.select("snapshot_id").distinct()
    folder, version = F.substring("snapshot_id", 2, 1).cast("int"), F.substring("snapshot_id", 5, 1).cast("int")
    rows = ids.withColumn("snapshot_idx", F.row_number().over(W.orderBy("snapshot_id")) - 1)
    return rows.withColumn("timestamp", (F.lit(1_700_000_000) + folder * 20_000 + version * version * 900).cast("double")).withColumn("source_path", F.concat(F.when(version < 3, "/data/").otherwise("/mnt/"), F.substring("snapshot_id", 1, 2)))
