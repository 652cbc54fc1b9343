"""More registered queries: identities and projects that are known already, consistency reports, the knowledge store,
discovery, version graphs. Each goes through the library's operator; where the tables have no faulty record, some are
forged by arithmetic on columns, in the SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import content
from palimpsest.kb import feedback, rules
from palimpsest.kb.store import KnowledgeStore
from palimpsest.operators import consistency, diff, identity, match, projects, timeline
from palimpsest.operators.components import connected_components
from palimpsest.runtime import stored
from palimpsest.sources import discovery
from palimpsest.sources.testdata import doc_files, history_files, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _known(files: DataFrame) -> DataFrame:
    """Identities as an earlier run over F0/S0 would have left them."""
    first = files.where("snapshot_id = 'F0/S0'").groupBy(F.col("raw_hash").alias("hash"))
    return first.agg(F.concat(F.lit("known-"), F.min("path")).alias("cluster_uid"))


def _partial(files: DataFrame) -> DataFrame:
    """Observations of files below p*, so that the others are covered by none."""
    return identity.assign_identities(files).where("path like 'p%'")


def _forged(files: DataFrame, observations: DataFrame) -> DataFrame:
    """Operations of which the copies in every fifth pair have a kind that does not exist."""
    ops = diff.derive_operations(files, observations, snapshots(files))
    bad = (F.col("op_type") == "copy") & (F.col("pair_idx") % 5 == 0)
    return ops.withColumn("op_type", F.when(bad, "teleport").otherwise(F.col("op_type")))


def _flat(conflicts: DataFrame) -> DataFrame:
    source, target = F.get("source_paths", F.lit(0)), F.get("target_paths", F.lit(0))
    return conflicts.select("hash", source.alias("source"), target.alias("target"), "conflict_type", "confidence_a")


@query
def components_long_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains of 97 documents whose nodes are numbered at random."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 97 <> 0")
    name = lambda c: F.md5(F.expr(c).cast("string").cast("binary"))
    return connected_components(docs.select(name("doc_id - 1").alias("src"), name("doc_id").alias("dst")))


@query
def identity_known(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    found = identity.assign_identities(files, _known(files))
    return found.select("cluster_uid", "anchored", "snapshot_id", "path")


@query
def identity_blocking_forged(spark: SparkSession, d: str) -> DataFrame:
    """Copies whose recorded size is wrong share a hash with their original but no block."""
    files = stored(history_files(spark, d))
    forged = files.withColumn("size", F.col("size") + F.when(F.col("path").startswith("copy/"), 1).otherwise(0))
    return identity.assign_identities(forged, blocking=True).select("cluster_uid", "snapshot_id", "path")


@query
def cluster_of_path(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    wanted = files.where("size % 3 = 0").select("snapshot_id", F.concat("path", F.when(F.col("size") % 2 == 0, "").otherwise("~")).alias("path"))
    return identity.first_cluster(identity.assign_identities(files), wanted)


def _kb_projects(files: DataFrame) -> DataFrame:
    """The project of F0/S0 with its hashes, and one whose hashes have changed since."""
    prints = projects.project_fingerprints(files)
    held = match.inverted_index(files).select("snapshot_id", "hash").distinct().join(prints, "snapshot_id")
    kept = (F.col("snapshot_id") == "F0/S0") | ((F.col("snapshot_id") == "F1/S0") & (F.ascii("hash") % 2 == 0))
    return held.where(kept).select(F.col("fingerprint").alias("uid"), "hash")


@query
def project_groups_known(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    return projects.group_snapshots(files, _kb_projects(files))


@query
def project_groups_delta(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    return projects.group_snapshots(files, _kb_projects(files), mode="delta")


@query
def plain_jaccard_with_empty(spark: SparkSession, d: str) -> DataFrame:
    """Sources, and languages as snapshots whose files have no hash."""
    files = doc_files(spark, d)
    bare = files.select(F.substring_index("path", "/", 1).alias("snapshot_id"), "path").withColumns({c: F.lit("") for c in ("raw_hash", "norm_hash")})
    files = stored(files.select("snapshot_id", "path", "raw_hash", "norm_hash").unionByName(bare))
    return projects.with_empty_pairs(projects.jaccard_pairs(files, discount=False), files)


@query
def empty_clusters(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    obs = stored(identity.assign_identities(files))
    found = consistency.empty_clusters(obs.select("cluster_uid").distinct(), obs.where("path like 'p%'"))
    return found.select(F.col("source_paths")[0].alias("cluster_uid"), "conflict_type", "confidence_a")


@query
def invalid_operations(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    return _flat(consistency.invalid_operations(_forged(files, identity.assign_identities(files))))


@query
def consistency_report(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    obs = stored(identity.assign_identities(files))
    clusters = obs.select("cluster_uid").distinct()
    report = consistency.check_consistency(files, clusters, obs.where("path like 'p%'"), _forged(files, obs))
    return _flat(report.conflicts).withColumn("passes", F.lit(report.passes))


@query
def consistency_relaxed(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    obs = stored(identity.assign_identities(files))
    clusters = obs.select("cluster_uid").distinct()
    report = consistency.check_with_inner_loop(files, clusters, obs.where("path like 'p%'"), _forged(files, obs))
    return _flat(report.conflicts).withColumns({"passes": F.lit(report.passes), "iterations": F.lit(report.iterations_used)})


@query
def cross_location(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    snaps = snapshots(files)
    pairs = match.match_consecutive(files, snaps).select("idx_a", "idx_b").distinct()
    names = lambda c, n: snaps.select(F.col("snapshot_idx").alias(c), F.col("snapshot_id").alias(n))
    matches = pairs.join(names("idx_a", "snapshot_id"), "idx_a").join(names("idx_b", "matched_id"), "idx_b")
    both = matches.select("snapshot_id", "matched_id").union(snaps.select("snapshot_id", F.col("snapshot_id").alias("matched_id")))
    return _flat(consistency.check_cross_location(files, snaps, both))


@query
def kb_added_frequencies(spark: SparkSession, d: str) -> DataFrame:
    files = history_files(spark, d).select("snapshot_id", F.col("raw_hash").alias("hash"))
    kb = KnowledgeStore(spark, "never-written").open()
    for folder in ("F0", "F1", "F2"):
        kb.add_frequencies(files.where(F.col("snapshot_id").startswith(folder)))
    return kb.tables["frequencies"]


@query
def kb_records(spark: SparkSession, d: str) -> DataFrame:
    """Single records of a store: the second identity of a hash replaces the first, a new count adds up."""
    files = stored(history_files(spark, d).select("snapshot_id", F.col("raw_hash").alias("hash")))
    low, high = files.agg(F.min("hash"), F.max("hash")).first()
    kb = KnowledgeStore(spark, "never-written").open()
    kb.add_frequencies(files)
    for uid in ("first", "second"):
        kb.set_identity(low, uid, 0.5)
        kb.set_project(uid, {low: 1.0, high: 2.0})
    kb.add_contradiction({"hash": high, "identity_a": "a", "identity_b": "b"})
    project = kb.get_project("second") or {}
    row = (low, kb.get_identity(low), kb.get_identity(high), kb.increment_frequency(low), project.get(high), len(kb.get_contradictions()))
    return spark.createDataFrame([row], "hash string, identity string, other string, freq long, weight double, contradictions long")


@query
def kb_contradiction_candidates(spark: SparkSession, d: str) -> DataFrame:
    files = stored(history_files(spark, d))
    conflicts = consistency.hash_on_many_paths(files)
    return rules.candidates(conflicts, identity.assign_identities(files).where("path not like 'moved/%'"), _known(files))


@query
def kb_feedback(spark: SparkSession, d: str) -> DataFrame:
    """What a run over all files tells a store that has seen paths below p1 ten times."""
    files = stored(history_files(spark, d))
    obs = stored(identity.assign_identities(files))
    kb = KnowledgeStore(spark, "never-written").open()
    seen = obs.where("path like 'p1/%'").select(F.concat_ws(":", "snapshot_id", "path").alias("hash"))
    kb.add_frequencies(seen.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))))
    prints = match.inverted_index(files).groupBy(F.col("snapshot_id").alias("uid"), "hash").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    conflicts = stored(consistency.hash_on_many_paths(files))
    found = feedback.analyze_with_project(kb, obs, prints, consistency.Report(False, conflicts))
    row = (found.identities_updated, found.projects_updated, found.contradictions_resolved, found.igs)
    return spark.createDataFrame([row], "identities long, projects long, contradictions long, igs double")


@query
def discovery_depths(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot folders at every depth of a listing with a file at the root and an empty folder."""
    files = history_files(spark, d).select(F.concat_ws("/", "snapshot_id", "path").alias("path"))
    more = spark.createDataFrame([("readme.txt",), ("F0/notes.txt",), ("old/a/b/c.txt",)], "path string")
    entries = stored(discovery.listing(files.union(more)).union(spark.createDataFrame([("bare", False, False)], "dir string, f boolean, d boolean")))
    out = [discovery.discover(entries, n).select(F.lit(n).alias("depth"), "snapshot_dir") for n in (0, 1, 2, -1)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query
def discovery_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of folder, the empty one too."""
    files = history_files(spark, d).select(F.concat_ws("/", "snapshot_id", "path").alias("path"))
    listed = discovery.listing(files).union(spark.createDataFrame([("bare", False, False)], "dir string, f boolean, d boolean"))
    return discovery.classify(listed)


@query
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash and line ending of texts with every kind of line end, some of them binary."""
    text = "CASE WHEN doc_id % 10 = 0 THEN concat(char(0), text) WHEN doc_id % 3 = 0 THEN replace(text, char(10), concat(char(13), char(10))) WHEN doc_id % 3 = 1 THEN concat(char(13), char(10), text, char(10), char(13)) ELSE text END"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.expr(text).alias("t"))
    return docs.select("doc_id", content.normalized_hash(F.col("t")).alias("hash"), content.line_ending(F.col("t")).alias("ending"))


@query
def temporal_groups_untimed(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event has no time and joins its user's last group."""
    time = F.when(F.col("event_id") % 10 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", time.alias("t"))
    return timeline.temporal_groups(events, "t", ["user_id"], id="event_id").select("event_id", "user_id", "group_no")


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """A tree of documents in which every seventh one has a second parent."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 3").select("doc_id")
    parents = F.expr("CASE WHEN doc_id % 7 = 0 THEN array(doc_id div 2, doc_id div 3) ELSE array(doc_id div 2) END")
    edges = docs.select("doc_id", F.explode(parents).alias("p"))
    return edges.select(F.concat(F.lit("n"), "p").alias("parent_id"), F.concat(F.lit("n"), "doc_id").alias("child_id"), (F.col("doc_id") % 4 + 1).alias("ops"))


@query
def dag_merges(spark: SparkSession, d: str) -> DataFrame:
    edges = _merges(spark, d)
    nodes = timeline.branching(edges.select(F.col("child_id").alias("snapshot_id")), edges, arrays=False)
    ops = edges.select("parent_id", "child_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ops"))).alias("op_no"))
    n = timeline.node_operations(ops).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("operations"))
    out = nodes.join(n, "snapshot_id", "left").withColumn("operations", F.coalesce("operations", F.lit(0).cast("long")))
    return out.select("snapshot_id", "n_parents", "n_children", "is_root", "is_leaf", "is_fork", "is_merge", "operations")


@query
def dag_ordered_ends(spark: SparkSession, d: str) -> DataFrame:
    """Roots and leaves in the order of reversed numbers; those of every eleventh document are in no order."""
    edges = _merges(spark, d)
    nodes = timeline.branching(edges.select(F.col("child_id").alias("snapshot_id")), edges, arrays=False)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 11 <> 0")
    order = docs.select(F.concat(F.lit("n"), "doc_id").alias("snapshot_id"), (-F.col("doc_id")).alias("position"))
    return timeline.ordered_ends(nodes, order)
