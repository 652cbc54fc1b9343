"""Chat formatting of reply trees.

Root-to-leaf paths come from self-joins that double the jump each round. Nodes that follow each other without a branch
are one run first; log2(runs on a path) joins give every run's depth and its 2^k-th run above, then each chosen leaf's
path is halved down to single runs, again by joins. No path array grows along the way, so a deep thread costs rows in
proportion to its length. Branches are ranked by the sum of their nodes' scores, and each chosen path becomes one
conversation.

Defined cases: null role or text is empty; a parent that is missing makes a root; nodes on a parent cycle reach no root
and yield no path; equal scores prefer the smaller leaf; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import stored

# Fixed values of the template: marks and the escapes that keep them out of texts.
OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ('"', "\\q"))


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def thread(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A flat log as a tree: node numbers in turn order (ties by role, then text), each row the reply to the one before."""
    order = W.partitionBy("conv").orderBy("_turn", "role", "text")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long")).drop("_turn")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def in_runs(nodes: DataFrame) -> DataFrame:
    """nodes(conv, node, parent, score) with `run`, the first node of the run a node belongs to, and `pos` within it.

    A node goes on with a run if it is the only reply to the node before it in the order of numbers; so a flat log is
    one run, and a tree has a run for each stretch between branches that is numbered in a row.
    """
    order = W.partitionBy("conv").orderBy("node")
    rows = nodes.withColumns({"before": F.lag("node").over(order), "at": F.row_number().over(order)})
    # second, so that the partitioning by conv serves here too
    replies = F.count(F.lit(1)).over(W.partitionBy("conv", "parent"))
    rows = rows.withColumn("first", ~F.coalesce((F.col("parent") == F.col("before")) & (replies == 1), F.lit(False)))
    start = F.last(F.when(F.col("first"), F.struct("node", "at")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("start", start)
    return rows.select("conv", "node", "parent", "score", F.col("start.node").alias("run"), (F.col("at") - F.col("start.at")).cast("long").alias("pos"))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv, leaf, rank, depth, node) for the best `top` root-to-leaf paths of each conversation; depth 0 is the root.

    nodes: conv, node, parent, score; conv and node are non-null together for a usable row, a null conv is a tree too.
    Runs of nodes are joined as one, so the rounds go by the branches on a path and not by its length.
    """
    members = stored(in_runs(nodes.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    head = F.when(F.col("pos") == 0, F.col("parent"))
    runs = stored(members.groupBy("conv", "run").agg(F.max(head).alias("parent"), F.max("node").alias("end"), F.count(F.lit(1)).alias("len"), F.sum("score").alias("score")))
    first = runs.alias("n").join(runs.alias("p"), same("n", "p") & (F.col("n.parent") == F.col("p.end")), "left")
    # up: the 2^k-th run above; steps and above: runs and nodes passed so far; total: score from the run over those
    # steps, up excluded
    passed = F.when(F.col("p.run").isNotNull(), 1).otherwise(0).cast("long")
    now = first.select("n.conv", F.col("n.run").alias("node"), "n.end", F.col("p.run").alias("up"), passed.alias("steps"), F.coalesce("p.len", F.lit(0).cast("long")).alias("above"), F.col("n.score").alias("total"))
    now = stored(now)
    most = now.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps, done, moving = [], now.where("up is null"), now.where("up is not null")
    inner = moving.select("conv", F.col("up").alias("node")).distinct()
    while 2 ** len(jumps) <= most and moving.limit(1).count():
        # only runs below their root move on; a run's row is among those moving or those done
        jumps.append(moving)
        a, b = moving.alias("a"), moving.unionByName(done).alias("b")
        both = a.join(b, same("a", "b") & (F.col("a.up") == F.col("b.node")))
        sums = [(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("steps", "above", "total")]
        now = stored(both.select("a.conv", "a.node", "a.end", "b.up", *sums))
        done, moving = done.unionByName(now.where("up is null")), now.where("up is not null")
    # runs that lead into a cycle never get done
    leaves = done.alias("d").join(inner.alias("i"), same("d", "i") & (F.col("d.node") == F.col("i.node")), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("total"), "end"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    part = chosen.select("conv", F.col("end").alias("leaf"), "rank", "node", (F.col("steps") + 1).alias("n"))
    for k in range(len(jumps) - 1, -1, -1):
        size = 2**k
        long, rest = part.where(F.col("n") > size), part.where(F.col("n") <= size)
        above = long.alias("a").join(jumps[k].alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node")))
        above = above.select("a.conv", "leaf", "rank", F.col("b.up").alias("node"), (F.col("n") - size).alias("n"))
        part = stored(rest.unionByName(long.withColumn("n", F.lit(size).cast("long"))).unionByName(above))
    # back from runs to nodes: a run begins below the nodes above it
    placed = part.alias("a").join(done.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node"))).select("a.conv", "leaf", "rank", "a.node", "above")
    found = placed.alias("a").join(members.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.run")))
    return found.select("a.conv", "leaf", "rank", (F.col("above") + F.col("pos")).alias("depth"), "b.node")


def formatted(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, leaf, rank, n_turns, formatted, loss_spans): one string per path; spans (start, length) of assistant text.

    A conversation is one record, so its turns meet in one row; nothing else is gathered.
    """
    same = F.col("c.conv").eqNullSafe(F.col("n.conv")) & (F.col("c.node") == F.col("n.node"))
    turns = chosen.alias("c").join(nodes.alias("n"), same).select("c.conv", "leaf", "rank", "depth", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    rows = turns.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE))
    whole = F.array_join(F.transform("t", lambda x: F.concat(head(x), x["text"], F.lit(CLOSE))), "")
    at = lambda x, y: F.struct((x["at"] + F.length(head(y)) + F.length(y["text"]) + len(CLOSE)).cast("long").alias("at"), F.when(y["role"] == "assistant", F.concat(x["spans"], F.array(F.struct((x["at"] + F.length(head(y))).cast("long").alias("start"), F.length(y["text"]).cast("long").alias("length"))))).otherwise(x["spans"]).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return rows.select("conv", "leaf", "rank", F.size("t").cast("long").alias("n_turns"), whole.alias("formatted"), F.aggregate("t", start, at)["spans"].alias("loss_spans"))


def read_back(rows: DataFrame) -> DataFrame:
    """rows with turns (array of role and text) and loss_text, both taken from the formatted string and its spans."""
    parts = F.split(F.col("formatted"), "</turn>\n", -1)
    turn = lambda x: F.struct(
        unescaped(F.regexp_extract(x, f'^{OPEN}([^"]*){MIDDLE}', 1)).alias("role"), unescaped(F.regexp_replace(x, f'^{OPEN}[^"]*{MIDDLE}', "")).alias("text")
    )
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
    loss = F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    return rows.withColumn("turns", turns).withColumn("loss_text", unescaped(loss))
