"""SimHash near-duplicates with candidates from the general pigeonhole principle.

The 64 fingerprint bits are grouped into partitions of correlated bits. Partition i gets a threshold t_i with
sum(t_i) = tau - m + 1: two fingerprints within tau bits agree up to t_i bits in at least one partition. The thresholds
(unequal if that is cheaper, -1 for a partition never probed) come from dynamic programming over the candidates
estimated for each partition and threshold. Fingerprints meet in the buckets of their probes and are verified there.
A bucket of n fingerprints costs n^2/2 checks; one with more than CROWDED goes by masks instead: fingerprints that agree
outside some tau bits are linked to the smallest of them, which finds the same components in C(64, tau) rows each.

Work is on distinct fingerprints, so a group of copies counts once. Defined cases: a text without words has fingerprint
zero and is linked like any other; fewer words than a shingle make one shingle of all; null text has no words; a
component is named by its smallest non-null id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.worker import kept, slices
from palimpsest.operators.components import connected_components
from palimpsest.runtime import stored

CROWDED = 2048
BITS = 64
#: For a byte, its eight bits in eight byte lanes: 255 of them add up without a carry between lanes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def fingerprint(text: str | None, k: int) -> int:
    """The SimHash of a text's k-word shingles, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
        lanes = LANES[h.view(np.uint8).reshape(-1, 8)]
        sums += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64x64 matrix of how often two bits are set together, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), pa.array(list(both), pa.list_(pa.float64()))], names=["bit", "n", "row"])

    parts = fps.select("fp").mapInArrow(run, "bit int, n long, row array<double>")
    sums = parts.groupBy("bit").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("row")[i]) for i in range(BITS)]).alias("row")).orderBy("bit").collect()  # 64 rows
    return (int(sums[0]["n"]), np.array([r["row"] for r in sums])) if sums else (0, np.zeros((BITS, BITS)))


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions; each is grown by the free bit that correlates most with those it has."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [min(free)]
        free.remove(part[0])
        while len(part) < size:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i in -1..len-2 with the given sum and least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row):
                key = (c + x, [*ts, t - 1])
                if s + t - 1 not in step or key < step[s + t - 1]:
                    step[s + t - 1] = key
        best = step
    return best[total]


def _masks(bits: list[int], t: int) -> list[int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << b for b in bits) & ~sum(1 << b for b in c)) for c in combinations(bits, t)]


def probe_plan(fps: DataFrame, tau: int) -> list[tuple[int, int]]:
    """(partition, mask) of every probe: fingerprints that agree under a mask meet in a bucket."""
    n, both = bit_statistics(fps)
    p = both.diagonal() / max(n, 1)
    flip = float(np.mean(2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)))
    options = []
    layouts = [group_bits(n, both, m) for m in range(max(1, (tau + 2) // 2), tau + 2)]
    pairs = F.col("count") * (F.col("count") - 1) / 2
    keys = [(i, j, _masks(part, 0)[0]) for i, parts in enumerate(layouts) for j, part in enumerate(parts)]
    tagged = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, j, m in keys])).alias("x")).select("x.*")
    same = {(r["i"], r["j"]): float(r["n"]) for r in tagged.groupBy("i", "j", "v").count().groupBy("i", "j").agg(F.sum(pairs).alias("n")).collect()}  # a row for each partition
    for i, parts in enumerate(layouts):
        costs = []
        for j, part in enumerate(parts):
            rows = [0.0]
            for t in range(tau + 1):
                near = same.get((i, j), 0.0) * sum(comb(len(part), d) * flip**d for d in range(t + 1))
                rows.append(n * comb(len(part), t) + near)
            costs.append(rows)
        options.append((*allocate(costs, tau - len(parts) + 1), parts))
    _, thresholds, parts = min(options)
    return [(j, mask) for j, (t, part) in enumerate(zip(thresholds, parts, strict=True)) if t >= 0 for mask in _masks(part, t)]


def links(fps: DataFrame, tau: int, star: int | None = None) -> DataFrame:
    """(src, dst) between distinct fingerprints: every pair within tau bits, or, in crowded buckets, edges that connect
    the same fingerprints. fps: a stored table with the distinct column fp.

    Masks are C(64, tau) rows for each crowded fingerprint. With `star`, buckets of more than that many fingerprints have
    only the pairs with their smallest instead; then components may fall apart, and the caller has to find the rest."""
    probes = probe_plan(fps, tau)
    key = [F.struct(F.lit(k).alias("probe"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for k, (_, mask) in enumerate(probes)]
    rows = fps.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.probe", "k.value")
    sizes = rows.groupBy("probe", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(rows.join(sizes, ["probe", "value"]))
    most = CROWDED if star is None else star
    a, b = met.where(F.col("n") <= most).alias("a"), met.where(F.col("n") <= most).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= tau
    pairs = a.join(b, (F.col("a.probe") == F.col("b.probe")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    if star is not None:
        full = met.where(F.col("n") > most)
        low = full.groupBy("probe", "value").agg(F.min("fp").alias("src"))
        rays = full.join(low, ["probe", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("src"))) <= tau).where("fp <> src")
        return pairs.union(rays.select("src", F.col("fp").alias("dst"))).distinct()
    crowd = met.where(F.col("n") > most).select("fp").distinct()
    if not crowd.limit(1).count():
        return pairs.distinct()
    wide = crowd.select("fp", F.explode(F.array(*[F.lit(m) for m in _masks(list(range(BITS)), tau)])).alias("mask"))
    wide = wide.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    low = wide.groupBy("mask", "value").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = wide.join(low, ["mask", "value"]).where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, tau: int = 2, star: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs; star as in `links`."""
    marked = stored(fingerprints(docs, id, text, k))
    fps = stored(marked.groupBy("fp").agg(F.min(id).alias("low")))
    joined = connected_components(links(fps, tau, star))
    heads = fps.join(joined, fps["fp"] == joined["node"], "left").select(fps["fp"], "low", F.coalesce("component", fps["fp"]).alias("root"))
    roots = heads.groupBy("root").agg(F.min("low").alias("component_id"))
    named = heads.join(roots, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, tau: int = 2) -> DataFrame:
    """docs with one row of each component, the one with the smallest id; all columns stay.

    Where ids repeat or are null, rows are numbered first: a null id comes last, and of equal ids the row with the
    smallest hash of its text stays, one of them if the texts are equal too.
    """
    return drop_by_component(docs, id, text, lambda rows, name: near_duplicates(rows, name, text, k, tau))


def drop_by_component(docs: DataFrame, id: str, text: str, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same for any find(rows, id) that gives (id, component_id); rows it leaves out are alone and stay."""
    if docs.groupBy(F.col(id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).count():
        return _drop_by_row(docs, id, text, find)
    found = find(docs, id)
    gone = found.where(F.col(id) > F.col("component_id")).select(F.col(id).alias("_gone")).distinct()
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")


def _drop_by_row(docs: DataFrame, id: str, text: str, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same by a number of each row, which is stored with it and so stays the same when a task runs again."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = find(rows, row).select(F.col(row).alias("row"), F.col("component_id").alias("component"))
    keys = rows.select(F.col(row).alias("row"), F.struct(F.col(id).isNull().alias("a"), F.col(id).alias("b"), F.xxhash64(text).alias("c"), F.col(row).alias("d")).alias("rank"))
    ranked = found.join(keys, "row")
    best = ranked.groupBy("component").agg(F.min("rank").alias("rank"))
    gone = ranked.join(best.withColumnRenamed("rank", "best"), "component").where("rank.d <> best.d").select(F.col("row").alias("_gone"))
    return rows.join(gone, rows[row] == gone["_gone"], "left_anti").drop(row)
