"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in a seeded shuffle, again from the start when its target asks for more than it has
(three times at most). A copy's virtual finish time is the source's words served so far over the source's target; the
mix is the prefix of all copies by finish time whose words fit the budget. Running sums are taken in two levels (sums
of small buckets, then inside a bucket), so no source and no cell lands in one task.

Defined cases: null text has size 0; documents of size 0 are never taken; a null source is a source of its own, last;
null ids are shuffled like any other value; rows that repeat an id are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import small, stored

#: White space between words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
CELLS = 4096
EPOCHS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null: one more than the breaks in the text without white space at its ends.

    Trimming goes by a set of characters: a pattern tied to the end would look at every run of white space from each of
    its characters."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources(skey, source_size, docs) with weight (1, 2, 3, repeating by skey) and target.

    Water-filling in closed form: ordered by the level at which each source's cap of EPOCHS times its size binds, the
    first level that caps every source before it and none after it is the one.
    """
    ordered = sources.withColumn("weight", (F.row_number().over(W.orderBy("skey")) - 1) % 3 + 1)
    ordered = ordered.withColumn("_r", F.col("source_size") * EPOCHS / F.col("weight"))
    w = W.orderBy("_r", "skey")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    onward = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * EPOCHS) / F.sum("weight").over(onward)
    ordered = ordered.withColumn("_level", F.when(level <= F.col("_r"), level))
    ordered = ordered.withColumn("_level", F.first("_level", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cap = (F.col("source_size") * EPOCHS).cast("double")
    return ordered.withColumn("target", F.least(cap, F.col("_level") * F.col("weight"))).drop("_r", "_level")


def fair_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, *carry) for every row of docs."""
    carry = carry or []
    spark = docs.sparkSession
    skey = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    key = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    sized = stored(docs.select(F.col(id).alias("_id"), F.col(source).alias("_source"), skey.alias("skey"), key.alias("_key"), n_words(F.col(text)).alias("size"), *[F.col(c).alias(f"_c_{c}") for c in carry]))
    sources = stored(targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))))
    head = sources.agg(F.sum("source_size"), F.max("docs")).first()
    budget, most = int(head[0] or 0), int(head[1] or 0)
    # a bucket is a range of the shuffled order, of about 20 000 documents
    digits = next((k for k in range(1, 8) if most / 16**k <= 20_000), 8)
    bucketed = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = bucketed.groupBy("skey", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("skey").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("skey", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("size").over(W.partitionBy("skey", "_bucket").orderBy("_key", "_id", "size").rowsBetween(W.unboundedPreceding, 0))
    served = bucketed.withColumn("_inside", inside).join(sums, ["skey", "_bucket"]).join(small(sources), "skey")
    served = stored(served.withColumn("_served", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket", "docs", "weight"))

    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("_served")) / F.col("target")
    copies = served.where("size > 0 and target > 0").select("_id", "_key", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish(e).alias("vft")) for e in range(EPOCHS)])).alias("c")).select("_id", "_key", "size", "c.*")
    cut = _cut(copies, budget)
    place = lambda e: F.struct(finish(e).alias("a"), F.col("_key").alias("b"), F.col("_id").alias("c"), F.lit(e).alias("d"))
    if cut is None:
        n = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(EPOCHS)).otherwise(0)
    else:
        last = spark.createDataFrame([cut], "a double, b string, c " + served.schema["_id"].dataType.simpleString() + ", d int")
        served = served.crossJoin(F.broadcast(last.select(F.struct("a", "b", "c", "d").alias("_last"))))  # one row
        n = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (place(e) < F.col("_last")), 1).otherwise(0) for e in range(EPOCHS)), F.lit(0))
    out = served.withColumn("copies", n)
    return out.select(F.col("_id").alias(id), F.col("_source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def _cut(copies: DataFrame, budget: int) -> tuple | None:
    """The first copy in (vft, key, id, epoch) order that no longer fits the budget; None if all fit.

    Two grids of fixed size narrow the place down before the copies of one cell are summed in order.
    """
    base, low, width, rows = 0, 0.0, 1.0 / CELLS, copies
    for _ in range(2):
        cell = F.least(((F.col("vft") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(4 * CELLS - 1).cast("long"))
        rows = rows.withColumn("_cell", cell)
        run = F.sum("n").over(W.orderBy("_cell"))
        hit = rows.groupBy("_cell").agg(F.sum("size").alias("n")).withColumn("run", run).where(F.col("run") + base > budget).orderBy("_cell").first()
        if hit is None:
            return None
        base += hit["run"] - hit["n"]
        rows = rows.where(F.col("_cell") == hit["_cell"]).drop("_cell")
        low, width = low + hit["_cell"] * width, width / CELLS
        if hit["_cell"] == 4 * CELLS - 1:  # the open last cell keeps no width
            break
    order = W.orderBy("vft", "_key", "_id", "epoch")
    hit = rows.withColumn("run", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("run") + base > budget).orderBy("vft", "_key", "_id", "epoch").first()
    return None if hit is None else (hit["vft"], hit["_key"], hit["_id"], hit["epoch"])


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with the columns of docs, each as often as it is taken.

    Only ids and sizes go through the queue; texts meet the decisions once, by id. Rows that repeat an id are taken as
    often as the most served of them.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"))  # no name of docs meets one used here
    taken = fair_mix(docs.select(id, text, source), id, text, source).where("copies > 0").groupBy(F.col(id).alias("taken_id")).agg(F.max("copies").alias("copies"))
    out = rows.join(taken, F.col("id").eqNullSafe(F.col("taken_id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
