"""Operations between consecutive snapshots, for all pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import path_change
from palimpsest.runtime import small, stored

FIELDS = ("op_type", "file_id", "source_path", "target_path", "old_hash", "new_hash", "confidence")


def _op(kind: Column | str, file_id: Column, source: Column | None, target: Column | None, old: Column | None, new: Column | None, confidence: float = 1.0) -> Column:
    none = F.lit(None).cast("string")
    values = (kind if isinstance(kind, Column) else F.lit(kind), file_id, *[none if x is None else x for x in (source, target, old, new)], F.lit(confidence))
    return F.struct(*[v.alias(k) for k, v in zip(FIELDS, values, strict=True)])


def derive_operations(files: DataFrame, observations: DataFrame, snapshots: DataFrame, mode: str = "compat") -> DataFrame:
    """One row per operation with pair_idx, from_id and to_id.

    A cluster that only one side has gives one delete or create of its first path. Otherwise the smallest path both
    sides have (else each side's smallest) is compared; further new paths are copies if their content was anywhere in
    the earlier snapshot, else creates. mode='complete' also deletes paths a surviving or vanishing cluster lost,
    creates every path of a new one and compares every shared path.
    """
    if mode not in ("compat", "complete"):
        raise ValueError(f"unknown mode: {mode}")
    order = small(snapshots.select("snapshot_id", "snapshot_idx"))
    last = snapshots.agg(F.max("snapshot_idx")).first()[0] or 0
    record = files.groupBy("snapshot_id", "path").agg(F.max(F.struct("raw_hash", "norm_hash")).alias("r"))
    held = observations.select("project_uid", "cluster_uid", "snapshot_id", "path").distinct().join(record, ["snapshot_id", "path"], "left").join(order, "snapshot_id")
    # a snapshot's files are the later side of one pair and the earlier side of the next
    sides = F.array(F.struct(F.col("snapshot_idx").alias("pair_idx"), F.lit("a").alias("side")), F.struct((F.col("snapshot_idx") - 1).alias("pair_idx"), F.lit("b").alias("side")))
    rows = held.select("project_uid", "cluster_uid", "path", F.struct(F.lit(True).alias("there"), "r.raw_hash", "r.norm_hash").alias("r"), F.explode(sides).alias("s"))
    rows = rows.where((F.col("s.pair_idx") >= 0) & (F.col("s.pair_idx") < last))
    cluster = ["project_uid", "cluster_uid", "pair_idx"]
    own = lambda side: F.max(F.when(F.col("s.side") == side, F.col("r"))).alias(side)
    # one row per path of a cluster in a pair, with its record on either side
    flat = stored(rows.groupBy("project_uid", "cluster_uid", F.col("s.pair_idx").alias("pair_idx"), "path").agg(own("a"), own("b")))

    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    first = lambda cond, *sides: F.min(F.when(cond, F.struct("path", *sides)))
    found = flat.groupBy(*cluster).agg(first(in_a & in_b, "a", "b").alias("common"), first(in_a, "a").alias("first_a"), first(in_b, "b").alias("first_b"))
    # the compared path of either side: the smallest common one, else each side's smallest
    at = lambda side, field: F.coalesce(F.col(f"common.{field}"), F.col(f"first_{side}.{field}"))
    both = found.select(*cluster, at("a", "path").alias("path_a"), at("b", "path").alias("path_b"), at("a", "a").alias("ra"), at("b", "b").alias("rb"))
    old, new, p, q = F.col("ra.raw_hash"), F.col("rb.raw_hash"), F.col("path_a"), F.col("path_b")
    same_raw, same_norm = F.coalesce(old == new, F.lit(False)), F.coalesce(F.col("ra.norm_hash") == F.col("rb.norm_hash"), F.lit(False))
    moved = lambda c: _op(path_change(p, q), p, p, q, old, new, c)
    none = F.filter(F.array(_op("", p, p, q, old, new)), lambda x: F.lit(False))
    delete, create = _op("delete", p, p, None, old, None), _op("create", q, None, q, None, new)
    ops = (
        F.when(q.isNull(), F.array(delete))
        .when(p.isNull(), F.array(create))
        .when((p == q) & same_raw, none)
        .when(p == q, F.array(_op("modify", p, p, p, old, new)))
        .when(same_raw, F.array(moved(1.0)))
        .when(same_norm, F.array(moved(0.8)))
        .otherwise(F.array(delete, create))
    )
    main = both.select("pair_idx", F.explode(ops).alias("op")).select("pair_idx", "op.*")

    # further new paths: copies if the hash was in the earlier snapshot, from the cluster's own path if it can be
    known = both.select(*cluster, "path_a", "path_b")
    fresh = flat.where(in_b & ~in_a & F.col("b.raw_hash").isNotNull()).select(*cluster, "path", F.col("b.raw_hash").alias("hash")).join(known, cluster)
    fresh = fresh.where(p.isNotNull() & (F.col("path") != q))
    earlier = files.join(order, "snapshot_id").groupBy(F.col("snapshot_idx").alias("pair_idx"), F.col("raw_hash").alias("hash")).agg(F.min("path").alias("any_path"))
    inside = flat.where(in_a).groupBy(*cluster, F.col("a.raw_hash").alias("hash")).agg(F.min("path").alias("own_path"))
    wide = fresh.join(earlier, ["pair_idx", "hash"], "left").join(inside, [*cluster, "hash"], "left")
    src, h = F.coalesce("own_path", "any_path"), F.col("hash")
    extra = wide.select("pair_idx", F.when(F.col("any_path").isNotNull(), _op("copy", src, src, F.col("path"), h, h)).otherwise(_op("create", F.col("path"), None, F.col("path"), None, h)).alias("op")).select("pair_idx", "op.*")
    out = main.unionByName(extra)
    if mode == "complete":
        more = flat.join(known, cluster)
        path, before, after = F.col("path"), F.col("a.raw_hash"), F.col("b.raw_hash")
        op = (
            F.when(in_a & ~in_b & (path != p), _op("delete", path, path, None, before, None))
            .when(p.isNull() & (path != q), _op("create", path, None, path, None, after))
            .when(in_a & in_b & (path != p) & (before != after), _op("modify", path, path, path, before, after))
        )
        out = out.unionByName(more.select("pair_idx", op.alias("op")).where("op is not null").select("pair_idx", "op.*"))
    names = snapshots.select(F.col("snapshot_idx").alias("pair_idx"), F.col("snapshot_id").alias("from_id"))
    after = snapshots.select((F.col("snapshot_idx") - 1).alias("pair_idx"), F.col("snapshot_id").alias("to_id"))
    return out.join(small(names), "pair_idx").join(small(after), "pair_idx").select("pair_idx", "from_id", "to_id", *FIELDS)
