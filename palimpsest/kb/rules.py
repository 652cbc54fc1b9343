"""Update rules of the knowledge store, each over whole tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confident_identities(found: DataFrame, frequencies: DataFrame, threshold: float = 0.95) -> DataFrame:
    """found(hash, cluster_uid) with confidence min(1, freq / 10), where that reaches the threshold."""
    rows = found.join(frequencies, "hash", "left").withColumn("confidence", F.least(F.lit(1.0), F.coalesce("freq", F.lit(0)) * 0.1))
    return rows.where(F.col("confidence") >= threshold).select("hash", "cluster_uid", "confidence")


def accepted_projects(new: DataFrame, known: DataFrame, threshold: float = 0.7) -> DataFrame:
    """uids of new(uid, hash, weight) that are unknown, or whose weighted Jaccard with the stored print reaches threshold."""
    both = new.select("uid", "hash", F.col("weight").alias("x")).join(known.select("uid", "hash", F.col("weight").alias("y")), ["uid", "hash"], "full_outer")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    score = both.groupBy("uid").agg((F.sum(F.least(x, y)) / F.sum(F.greatest(x, y))).alias("jaccard"))
    uids = new.select("uid").distinct().join(known.select("uid").distinct().withColumn("old", F.lit(True)), "uid", "left").join(score, "uid", "left")
    return uids.where(F.col("old").isNull() | (F.coalesce("jaccard", F.lit(0.0)) >= threshold)).select("uid", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), F.col("old").isNull().alias("is_new"))


def resolved(conflicts: DataFrame, identities: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Strategy and confidence for conflicts(hash, identity_a, identity_b); nothing else changes."""
    rows = conflicts.join(identities.select("hash", F.col("cluster_uid").alias("current")), "hash", "left").join(frequencies, "hash", "left")
    f = F.coalesce("freq", F.lit(0))
    a, b, now = F.col("identity_a"), F.col("identity_b"), F.col("current")
    stands = F.coalesce((now == a) | (now == b), F.lit(False))
    evidence = ~stands & (f > 0) & now.isNotNull()
    strategy = F.when((a != b) & evidence, "EVIDENCE_WEIGHT").otherwise("CONFIDENCE_WEIGHT")
    confidence = F.when(a == b, 1.0).when(stands, F.least(0.5 + f * 0.1, F.lit(0.95))).when(evidence, F.least(0.5 + f * 0.05, F.lit(0.85))).otherwise(0.5)
    return rows.select("hash", "identity_a", "identity_b", strategy.alias("strategy"), confidence.alias("confidence"), F.lit(datetime.now(UTC).isoformat()).alias("resolved_at"))


def candidates(conflicts: DataFrame, observations: DataFrame, identities: DataFrame) -> DataFrame:
    """(hash, identity_a, identity_b): the two smallest clusters known for a conflict's paths or hash, else 'unknown'."""
    rows = conflicts.where("hash <> ''").withColumn("_n", F.xxhash64("hash", "source_paths", "target_paths", "conflict_type"))
    paths = rows.select("_n", "hash", F.explode(F.array_union("source_paths", "target_paths")).alias("path")).join(observations.select("path", "cluster_uid").distinct(), "path")
    kb = rows.select("_n", "hash").join(identities.select("hash", "cluster_uid"), "hash")
    found = paths.select("_n", "cluster_uid").union(kb.select("_n", "cluster_uid")).groupBy("_n").agg(F.min("cluster_uid").alias("identity_a"), F.array_sort(F.collect_set("cluster_uid")).alias("all"))
    out = rows.join(found, "_n", "left")
    return out.select("hash", F.coalesce("identity_a", F.lit("unknown")).alias("identity_a"), F.coalesce(F.get("all", F.lit(1)), F.lit("unknown")).alias("identity_b"))


def growth_score(contradictions: DataFrame) -> DataFrame:
    """igs: 1 - contradictions / distinct identities in them, 1 without any; not clamped."""
    uids = contradictions.select(F.explode(F.array("identity_a", "identity_b")).alias("u")).agg(F.countDistinct("u").alias("uids"))
    n = contradictions.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(uids).select(F.when(F.col("uids") == 0, 1.0).otherwise(1 - F.col("n") / F.col("uids")).alias("igs"))  # one row each
