"""Project alignment: which snapshots are of the same project, and where a project lies inside a larger snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.content import usable_hash
from palimpsest.functions.paths import ancestors, rebased
from palimpsest.operators.components import connected_components
from palimpsest.operators.match import inverted_index


def jaccard_pairs(files: DataFrame, total: int | None = None, discount: bool = True) -> DataFrame:
    """(a, b, shared, n_a, n_b, jaccard) of snapshots that share a hash. With discount, hashes in sqrt(total) snapshots
    or more are left out first (freq * freq >= total, in integers), which is also what keeps hot hashes off the join."""
    held = inverted_index(files).select("hash", "snapshot_id").distinct()
    if discount:
        n = files.select("snapshot_id").distinct().count() if total is None else total
        rare = held.groupBy("hash").count().where(F.col("count") * F.col("count") < n).select("hash")
        held = held.join(rare, "hash", "left_semi")
    sizes = held.groupBy("snapshot_id").count()
    a, b = held.alias("a"), held.alias("b")
    shared = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.snapshot_id") < F.col("b.snapshot_id"))).groupBy(F.col("a.snapshot_id").alias("a"), F.col("b.snapshot_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(sizes.select(F.col("snapshot_id").alias("a"), F.col("count").alias("n_a")), "a").join(sizes.select(F.col("snapshot_id").alias("b"), F.col("count").alias("n_b")), "b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b", "shared", "n_a", "n_b", "jaccard")


def with_empty_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """`jaccard_pairs` and the pairs of snapshots that have no usable hash at all: two empty sets are alike (1.0)."""
    counts = files.groupBy("snapshot_id").agg(F.count(usable_hash()).alias("n"))
    bare = counts.where("n = 0").select("snapshot_id")
    a, b = bare.select(F.col("snapshot_id").alias("a")), bare.select(F.col("snapshot_id").alias("b"))
    none = F.lit(0).cast("long")
    both = a.join(b, F.col("a") < F.col("b")).select("a", "b", none.alias("shared"), none.alias("n_a"), none.alias("n_b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(both)


def weighted_jaccard(fingerprints: DataFrame) -> DataFrame:
    """(a, b, jaccard) of fingerprints(id, hash, weight): sum of minima over sum of maxima, absent weights 0."""
    a, b = fingerprints.alias("a"), fingerprints.alias("b")
    low = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.least("a.weight", "b.weight")).alias("low"))
    sums = fingerprints.groupBy("id").agg(F.sum("weight").alias("w"))
    out = low.join(sums.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(sums.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    high = F.col("wa") + F.col("wb") - F.col("low")  # max(x, y) = x + y - min(x, y)
    return out.select("a", "b", F.when(high > 0, F.col("low") / high).otherwise(0.0).alias("jaccard"))


def project_fingerprints(files: DataFrame) -> DataFrame:
    """(snapshot_id, fingerprint): sha-256 over the sorted usable hashes, duplicates kept; a snapshot is one record."""
    return files.withColumn("h", usable_hash()).groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("all")).select("snapshot_id", F.when(F.col("all") == "", F.lit("")).otherwise(F.sha2("all", 256)).alias("fingerprint"))


def group_snapshots(files: DataFrame, kb_projects: DataFrame | None = None, mode: str = "auto", threshold: float = 0.5) -> DataFrame:
    """(project_uid, snapshot_id). Known projects first: equal fingerprint key and Jaccard of at least 0.7 with the stored
    hashes; then components of discounted Jaccard over the threshold (strictly), named by their first snapshot.

    mode: 'full' ignores kb_projects(uid, hash), 'delta' stops after known projects (if there are any), 'auto' does both.
    """
    if mode not in ("full", "delta", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    ids = files.select("snapshot_id").distinct()
    total = ids.count()
    matched = None
    if kb_projects is not None and mode != "full":
        own = files.withColumn("hash", usable_hash()).where("hash is not null").select("snapshot_id", "hash").distinct()
        pairs = project_fingerprints(files).join(kb_projects.select(F.col("uid").alias("fingerprint")).distinct(), "fingerprint")
        shared = pairs.join(own, "snapshot_id").join(kb_projects.select(F.col("uid").alias("fingerprint"), "hash"), ["fingerprint", "hash"]).groupBy("snapshot_id", "fingerprint").agg(F.count(F.lit(1)).alias("shared"))
        sizes = own.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).join(shared, "snapshot_id").join(kb_projects.groupBy(F.col("uid").alias("fingerprint")).agg(F.countDistinct("hash").alias("m")), "fingerprint")
        matched = sizes.where(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")) >= 0.7).select(F.col("fingerprint").alias("project_uid"), "snapshot_id")
        if mode == "delta":
            return matched
    edges = jaccard_pairs(files, total).where(F.col("jaccard") > threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if matched is not None:
        rest = ids.join(matched, "snapshot_id", "left_anti")
        for c in ("src", "dst"):
            edges = edges.join(rest.select(F.col("snapshot_id").alias(c)), c, "left_semi")
        ids = rest
    found = connected_components(edges)
    out = ids.join(found, F.col("snapshot_id") == F.col("node"), "left").select(F.coalesce("component", "snapshot_id").alias("project_uid"), "snapshot_id")
    return out if matched is None else matched.unionByName(out)


def content_probe(large: DataFrame, reference: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(root, score) of the folder of `large` whose files are most often in `reference`: best share, then deepest, then
    smallest path; no row if none reaches the threshold. Files at the root have no folder."""
    known = reference.select(usable_hash().alias("h")).where("h is not null").distinct().withColumn("hit", F.lit(1))
    rows = large.select(usable_hash().alias("h"), F.explode(ancestors(F.col("path"))).alias("root")).where("h is not null")
    share = rows.join(known, "h", "left").groupBy("root").agg((F.count("hit") / F.count(F.lit(1))).alias("score"))
    depth = F.size(F.split("root", "/"))
    return share.where(F.col("score") >= threshold).orderBy(F.desc("score"), depth.desc(), "root").limit(1)


def normalize_to_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with paths rebased to roots(snapshot_id, root); files outside the root and other snapshots stay."""
    joined = files.join(roots, "snapshot_id", "left")
    return joined.withColumn("path", rebased(F.col("path"), F.coalesce("root", F.lit("")))).select(*files.columns)
