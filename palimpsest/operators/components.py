"""Connected components by contraction in a random order that is new in every round.

In a round each vertex takes as its representative the vertex of the smallest hash among itself and its neighbours, and
the graph is contracted to the representatives. A vertex with a neighbour gives way with a chance of one half or more,
so whatever the shape and the numbering the graph shrinks by a constant factor a round, and the rounds are logarithmic
in the number of nodes. The smallest node of every vertex is carried along, so no component is ever gathered by name;
what a join meets under one key are the neighbours of one vertex, which AQE may split, since no order is asked for.

Once LOCAL edges or fewer are left, one task ends the work by union-find; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import discard, release, stored

#: Edges that one task joins by union-find.
LOCAL = 250_000


def roots(edges: list[tuple]) -> dict:
    """Union-find: every node on an edge with the smallest node it is connected to."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _joined_locally(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            pairs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        found = roots(pairs)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), pa.array(found.values(), kind)], names=["node", "component"])
        del pairs, found
        release()

    kind = edges.schema["src"].dataType.simpleString()
    half = edges.where("src < dst").select("src", "dst")
    return half.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, local: int | None = None, rounds: int = 100) -> DataFrame:
    """(node, component) for every node on an edge (src, dst); component is the smallest node reachable.

    Null ends and loops are no edges; repeated edges count once; an empty table gives no rows. rounds is a guard against
    endless work only: a billion nodes need about 45 rounds even if each removes just over a third of the vertices.
    """
    local = LOCAL if local is None else local
    # both directions come from one evaluation: edges that depend on the order of rows may differ the next time
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    arcs = F.explode(F.array(ends("src", "dst"), ends("dst", "src")))
    both = stored(edges.where("src <> dst").select(arcs.alias("e")).select("e.src", "e.dst").distinct())
    steps: list[DataFrame] = []
    # for each round's vertices (vertex, low): the smallest node that was contracted into a vertex
    lows: list[DataFrame] = []
    while (left := both.count()) > 2 * local:
        if len(steps) == rounds:
            raise RuntimeError(f"{left // 2} edges are left after {rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("src").agg(F.min(order("dst")).alias("best"))
        step = stored(near.select(F.col("src").alias("node"), F.least("best", order("src"))["v"].alias("rep")))
        own = step.join(lows[-1], "node") if lows else step.withColumn("low", F.col("node"))
        lows.append(stored(own.groupBy(F.col("rep").alias("node")).agg(F.min("low").alias("low"))))
        steps.append(step)
        half = both.where("src < dst")
        one = half.join(step.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src")
        two = one.join(step.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst").where("a <> b")
        before, both = both, stored(two.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e")).select("e.src", "e.dst").distinct())
        discard(before)
    last = stored(_joined_locally(both))
    discard(both)
    if not steps:
        return last
    # names of the last vertices: the smallest low of those that union-find joined
    grouped = last.join(lows[-1], "node").groupBy("component").agg(F.min("low").alias("low"))
    named = last.join(grouped, "component").select("node", F.col("low").alias("component"))
    for k in range(len(steps) - 1, -1, -1):
        # a vertex without an edge is a whole component
        found = lows[k].join(named, "node", "left").select(F.col("node").alias("rep"), F.coalesce("component", "low").alias("component"))
        after = stored(steps[k].join(found, "rep").select("node", "component"))
        used, named = [lows[k], steps[k], *([] if k == len(steps) - 1 else [named])], after
        discard(*used)
    discard(last)
    return named
