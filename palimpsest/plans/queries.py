"""The registered queries: each applies one operator to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.paths import path_change
from palimpsest.functions.similarity import content_cost, metadata_cost, path_cost
from palimpsest.kb import rules
from palimpsest.operators import consistency, diff, identity, match, projects, signals, timeline
from palimpsest.runtime import small, stored
from palimpsest.sources import discovery
from palimpsest.sources.testdata import doc_files, history_files, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _files(spark, d, "snapshot_id", "path", "raw_hash", "norm_hash")
    return files, snapshots(files), identity.assign_identities(files)


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The history's files, stored: texts are expanded and hashed once, for the columns that are needed."""
    return stored(history_files(spark, d).select(*columns))


def _operations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files, snaps, obs = _history(spark, d)
    return diff.derive_operations(files, obs, snaps), snaps


@query
def history_operations(spark: SparkSession, d: str) -> DataFrame:
    return _operations(spark, d)[0]


@query
def diff_two_snapshots(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d).where(F.col("snapshot_id").isin("F0/S1", "F0/S2"))
    return diff.derive_operations(files, identity.assign_identities(files), snapshots(files))


@query
def op_counts_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return _operations(spark, d)[0].groupBy("pair_idx", "op_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


@query
def subtree_filter(spark: SparkSession, d: str) -> DataFrame:
    return timeline.filter_by_subtree(_operations(spark, d)[0], "p1/").select("pair_idx", "op_type", "file_id", "source_path", "target_path")


@query
def duplicate_file_ids(spark: SparkSession, d: str) -> DataFrame:
    return _operations(spark, d)[0].groupBy("pair_idx", "file_id").agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


@query
def identity_exact(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)[2].select("cluster_uid", "snapshot_id", "path")


@query
def identity_blocking(spark: SparkSession, d: str) -> DataFrame:
    return identity.assign_identities(_files(spark, d, "snapshot_id", "path", "raw_hash", "size", "fast_hash"), blocking=True).select("cluster_uid", "snapshot_id", "path")


@query
def identity_canonical_path(spark: SparkSession, d: str) -> DataFrame:
    return identity.canonical_paths(stored(_history(spark, d)[2])).select("cluster_uid", "canonical_path", "n")


@query
def match_consecutive(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, "snapshot_id", "path", "raw_hash")
    return match.match_consecutive(files, snapshots(files))


@query
def match_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, "snapshot_id", "path", "raw_hash")
    return match.match_all_pairs(files, snapshots(files))


@query
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return match.inverted_index(doc_files(spark, d))


@query
def hash_frequency(spark: SparkSession, d: str) -> DataFrame:
    return match.hash_frequency(doc_files(spark, d))


@query
def idf_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return projects.jaccard_pairs(_files(spark, d, "snapshot_id", "path", "raw_hash", "norm_hash"))


@query
def plain_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return projects.jaccard_pairs(doc_files(spark, d), discount=False)


@query
def weighted_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    prints = match.inverted_index(doc_files(spark, d)).groupBy(F.col("snapshot_id").alias("id"), "hash").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return projects.weighted_jaccard(prints)


@query
def project_groups(spark: SparkSession, d: str) -> DataFrame:
    return projects.group_snapshots(_files(spark, d, "snapshot_id", "path", "raw_hash", "norm_hash"))


@query
def project_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return projects.project_fingerprints(doc_files(spark, d))


@query
def content_probe(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    return projects.content_probe(files.where("snapshot_id = 'F0/S1'"), files.where("snapshot_id = 'F0/S0' and path like 'p1/%'"), 0.3)


@query
def rebase_paths(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d).select("snapshot_id", "path", "raw_hash")
    roots = files.where("snapshot_id like 'F1/%'").select("snapshot_id").distinct().withColumn("root", F.lit("p2"))
    return projects.normalize_to_root(files, roots)


@query
def line_ending_class(spark: SparkSession, d: str) -> DataFrame:
    return history_files(spark, d).select("snapshot_id", "path", "line_ending")


@query
def normalized_hash(spark: SparkSession, d: str) -> DataFrame:
    return history_files(spark, d).select("snapshot_id", "path", "norm_hash", (F.col("norm_hash") != F.col("raw_hash")).alias("differs"))


@query
def path_change_class(spark: SparkSession, d: str) -> DataFrame:
    p = stored(history_files(spark, d).select("raw_hash", "path").distinct())
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.raw_hash") == F.col("b.raw_hash")) & (F.col("a.path") < F.col("b.path")))
    return pairs.groupBy(F.col("a.path").alias("old"), F.col("b.path").alias("new")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", path_change(F.col("old"), F.col("new")))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = history_files(spark, d)
    return files.where("snapshot_id = 'F0/S1'").alias("a"), files.where("snapshot_id = 'F0/S2'").alias("b")


@query
def content_cost_by_path(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    cost = content_cost(*[F.col(f"{s}.{c}") for s in "ab" for c in ("size", "raw_hash", "fast_hash")])
    return a.join(b, F.col("a.path") == F.col("b.path")).select("a.path", cost.alias("cost"))


@query
def metadata_cost_by_path(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    cost = metadata_cost(F.col("a.mtime_ns"), F.col("a.mode"), F.col("b.mtime_ns"), F.col("b.mode"))
    return a.join(b, F.col("a.path") == F.col("b.path")).select("a.path", cost.alias("cost"))


@query
def path_cost_by_content(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    pairs = a.join(b, F.col("a.norm_hash") == F.col("b.norm_hash")).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))
    return pairs.withColumn("cost", F.round(path_cost("path_a", "path_b"), 6))


@query
def fused_matches(spark: SparkSession, d: str) -> DataFrame:
    return signals.match_files(*_sides(spark, d)).select("path_a", "path_b", F.round("cost", 6).alias("cost"))


def _neighbours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every snapshot's files on the left, and on the right those of its successor, under the same pair_idx."""
    files = stored(history_files(spark, d))
    rows = files.join(small(snapshots(files).select("snapshot_id", "snapshot_idx")), "snapshot_id")
    return rows.withColumn("pair_idx", F.col("snapshot_idx")).alias("a"), rows.withColumn("pair_idx", F.col("snapshot_idx") - 1).alias("b")


@query
def content_cost_consecutive(spark: SparkSession, d: str) -> DataFrame:
    a, b = _neighbours(spark, d)
    cost = content_cost(*[F.col(f"{s}.{c}") for s in "ab" for c in ("size", "raw_hash", "fast_hash")])
    return a.join(b, (F.col("a.pair_idx") == F.col("b.pair_idx")) & (F.col("a.path") == F.col("b.path"))).select("a.pair_idx", "a.path", cost.alias("cost"))


@query
def metadata_cost_consecutive(spark: SparkSession, d: str) -> DataFrame:
    a, b = _neighbours(spark, d)
    cost = metadata_cost(F.col("a.mtime_ns"), F.col("a.mode"), F.col("b.mtime_ns"), F.col("b.mode"))
    return a.join(b, (F.col("a.pair_idx") == F.col("b.pair_idx")) & (F.col("a.path") == F.col("b.path"))).select("a.pair_idx", "a.path", cost.alias("cost"))


@query
def path_cost_consecutive(spark: SparkSession, d: str) -> DataFrame:
    a, b = _neighbours(spark, d)
    pairs = a.join(b, (F.col("a.pair_idx") == F.col("b.pair_idx")) & (F.col("a.norm_hash") == F.col("b.norm_hash"))).select("a.pair_idx", F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))
    return pairs.withColumn("cost", F.round(path_cost("path_a", "path_b"), 6))


@query
def fused_matches_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return signals.match_files(*_neighbours(spark, d), keys=("pair_idx",)).select("pair_idx", "path_a", "path_b", F.round("cost", 6).alias("cost"))


@query
def root_changes(spark: SparkSession, d: str) -> DataFrame:
    return timeline.root_changes(snapshots(history_files(spark, d)))


@query
def timeline_parent(spark: SparkSession, d: str) -> DataFrame:
    ops, snaps = _operations(spark, d)
    return timeline.build_timeline(snaps, ops).select("snapshot_id", "parent_id", F.size("operations").cast("long").alias("n_ops"))


@query
def temporal_groups(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timeline.temporal_groups(events, "t", ["user_id"], id="event_id").select("event_id", "user_id", "group_no")


def _dag(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 0")
    edges = ids.select(F.expr("concat('n', doc_id div 2)").alias("parent_id"), F.expr("concat('n', doc_id)").alias("child_id"))
    return timeline.branching(edges.select(F.col("child_id").alias("snapshot_id")), edges, arrays=False)


@query
def dag_roots_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _dag(spark, d).select("snapshot_id", "is_root", "is_leaf")


@query
def dag_fork_merge(spark: SparkSession, d: str) -> DataFrame:
    return _dag(spark, d).select("snapshot_id", "is_fork", "is_merge")


@query
def coverage_antijoin(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    covered = files.where("path like 'p%'").select("snapshot_id", "path")
    return consistency.uncovered(files, covered).select("snapshot_id", "path", F.col("raw_hash").alias("hash"))


@query
def path_discontinuity(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    return consistency.path_discontinuity(files, snapshots(files)).select(F.col("target_paths")[0].alias("path"), F.size("source_paths").cast("long").alias("roots"), F.col("source_paths")[0].alias("first_root"))


@query
def temporal_overlap(spark: SparkSession, d: str) -> DataFrame:
    snaps = snapshots(history_files(spark, d))
    ids = snaps.select("snapshot_id")
    matches = ids.join(ids.select(F.col("snapshot_id").alias("matched_id")), F.col("snapshot_id") <= F.col("matched_id"))
    return consistency.temporal_overlap(snaps, matches).select(F.col("source_paths")[0].alias("source"), F.col("target_paths")[0].alias("target"))


@query
def hash_multi_path(spark: SparkSession, d: str) -> DataFrame:
    return consistency.hash_on_many_paths(history_files(spark, d)).select("hash", F.size("target_paths").cast("long").alias("paths"), F.col("target_paths")[0].alias("first_path"))


def _kb(files: DataFrame) -> DataFrame:
    return files.where("snapshot_id = 'F0/S0'").groupBy(F.col("raw_hash").alias("hash")).agg(F.concat(F.lit("known-"), F.min("path")).alias("cluster_uid"))


@query
def kb_probe(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    return files.join(_kb(files), F.col("raw_hash") == F.col("hash"), "left").select("snapshot_id", "path", "cluster_uid")


@query
def kb_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return history_files(spark, d).groupBy(F.col("norm_hash").alias("hash")).agg(F.count(F.lit(1)).alias("freq"))


def _frequencies(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("raw_hash").alias("hash")).agg(F.count(F.lit(1)).alias("freq"))


@query
def kb_identities_update(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    return rules.confident_identities(_kb(files), _frequencies(files), 0.3)


@query
def kb_projects_update(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d).select(F.substring("snapshot_id", 1, 2).alias("uid"), F.substring("snapshot_id", 4, 2).alias("s"), F.col("norm_hash").alias("hash"), F.lit(1.0).alias("weight")).distinct()
    return rules.accepted_projects(files.where("s = 'S1'"), files.where("s = 'S0'")).select("uid", "jaccard")


@query
def contradiction_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d)
    low = F.concat(F.lit("known-"), F.min("path"))
    conflicts = files.groupBy(F.col("raw_hash").alias("hash")).agg(low.alias("identity_a"), F.when(F.countDistinct("path") > 1, F.max("path")).otherwise(low).alias("identity_b"))
    return rules.resolved(conflicts, _kb(files), _frequencies(files)).select("hash", "strategy", "confidence")


@query
def igs(spark: SparkSession, d: str) -> DataFrame:
    c = history_files(spark, d).groupBy("raw_hash").agg(F.min("path").alias("identity_a"), F.max("path").alias("identity_b")).where("identity_a <> identity_b")
    return rules.growth_score(c)


@query
def discovery_classify(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d).select(F.concat_ws("/", "snapshot_id", "path").alias("path"))
    return discovery.classify(discovery.listing(files)).where("dir <> ''")


for _old, _new in (("content_cost_by_path", "content_cost"), ("metadata_cost_by_path", "metadata_cost"), ("path_cost_by_content", "path_cost")):
    QUERIES[_new] = QUERIES.pop(_old)
