"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level groups a key of a few bytes and passes the keys that occur twice or more to the next level as a bitmap
sized by their number, so rows that are alone at one level are never hashed further and no text is shuffled to find that out.
A bitmap can only let a lone row through (it is then found alone by its full hash); it never holds a copy back.

Defined cases: a null text equals an empty one. A null id sorts below every other. Rows that repeat both id and text
count in group_size; each row whose id is keep_id is marked kept, and `drop_copies` leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import stored

#: Bits per bitmap row in Spark's bitmap functions.
ROW_BITS = 32768
#: Bits for each key of a bitmap, so that one lone row in 16 at most passes by chance.
KEY_BITS = 16
#: Keys that go into a bitmap (16 MB at most); more of them are joined instead.
GATE_KEYS = 1 << 23
#: Groups with more than this part of the shared rows are hot; there are fewer of them than this, whatever the input.
HOT_PARTS = 10_000


def bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """The int64 column `h` of keys as at most bits/32768 rows of 4 KB."""
    slot = F.pmod(F.col("h"), F.lit(bits))
    return keys.select((slot / ROW_BITS).cast("long").alias("_bucket"), (slot % ROW_BITS).alias("_bit")).groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_map"))


def marked(rows: DataFrame, h: str, flag: str) -> DataFrame:
    """rows with a boolean column: the value of h (int64, null is never marked) occurs twice or more.

    The repeated values are stored and counted. As a bitmap, sized by their number, they are broadcast and no row moves;
    beyond GATE_KEYS they are joined.
    """
    keys = stored(rows.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).count().where("count > 1").select("h"))
    n = keys.count()
    if n > GATE_KEYS:
        return rows.join(keys, rows[h] == keys["h"], "left").withColumn(flag, F.col("h").isNotNull()).drop("h")
    bits = max(ROW_BITS, 1 << (n * KEY_BITS - 1).bit_length())
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_slot % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(_slot % 8 as int)")
    out = rows.withColumn("_slot", F.pmod(F.coalesce(F.col(h), F.lit(0)), F.lit(bits))).withColumn("_bucket", (F.col("_slot") / ROW_BITS).cast("long"))
    out = out.join(F.broadcast(bitmap(keys, bits)), "_bucket", "left")
    hit = F.coalesce(F.call_function("getbit", byte, bit) == 1, F.lit(False))
    return out.withColumn(flag, F.col(h).isNotNull() & hit).drop("_slot", "_bucket", "_map")


def refined(rows: DataFrame, prefix: int = 256) -> DataFrame:
    """rows (with a column _text, no other name may begin with _) with _len, its bytes, and _sha: the full hash of rows
    that share length and prefix with another, else null."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows = rows.withColumn("_len", F.octet_length(body).cast("long"))
    rows = marked(rows, "_len", "_by_len")
    start = F.when(F.col("_by_len"), F.xxhash64(F.col("_len"), F.substring(body, 1, prefix)))
    rows = marked(rows.withColumn("_start", start).drop("_by_len"), "_start", "_by_start")
    return rows.withColumn("_sha", F.when(F.col("_by_start"), F.sha2(body, 256))).drop("_start", "_by_start")


def exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, *extra) for every row of docs; extra columns are computed beside the hashes."""
    extra = extra or {}
    found = refined(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *[e.alias(k) for k, e in extra.items()])).drop("_text")
    found = stored(found)
    key, rows = ["_len", "_sha"], found.where("_sha is not null")
    groups = stored(rows.groupBy(*key).agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    most = (groups.agg(F.sum("group_size")).first()[0] or 0) / HOT_PARTS
    # rows of hot groups stay where they are; the others are dealt by key, none with more than 1/HOT_PARTS of the rows
    hot, rest = F.broadcast(groups.where(F.col("group_size") > most)), groups.where(F.col("group_size") <= most)
    alone = found.where("_sha is null").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *extra)
    shared = [rows.join(hot, key), rows.join(hot.select(*key), key, "left_anti").join(rest, key)]
    out = alone
    for part in shared:
        out = out.unionByName(part.select("_id", "keep_id", "group_size", *extra))
    return out.select(F.col("_id").alias(id), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *extra)


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without copies: of equal texts the row with the largest id stays. Lone rows pass without a shuffle."""
    found = refined(docs.select(F.struct("*").alias("row"), F.col(id).alias("_id"), F.col(text).alias("_text")))
    order = F.struct(F.col("_id").isNotNull(), F.col("_id"), F.xxhash64("row"))
    best = found.where("_sha is not null").groupBy("_len", "_sha").agg(F.max_by("row", order).alias("row"))
    return found.where("_sha is null").select("row").unionByName(best.select("row")).select("row.*")
