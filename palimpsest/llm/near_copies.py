"""Near copies by the Jaccard similarity of their sets of k-word shingles, found by SimHash and, beyond its radius, MinHash.

First `simhash.near_duplicates` gives the components of fingerprints that link within `tau` bits (in buckets of more than
STAR fingerprints, those that link with the smallest). Each component is
compared by the real shingle sets, in blocks of about BLOCK documents that all hold its smallest one; only pairs of
similarity `least` or more are links. That is linear in the size of a component.

SimHash can't decide a similarity of 0.8, so the rest follows: BANDS MinHash keys of ROWS minima each, of which a pair at
similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS; at 0.8 one pair in 300 000 is missed. A key whose
documents are all linked already adds nothing and is left out; every other pair that shares a key is compared by the
real intersection of its shingle sets.

There too documents are compared in blocks. A document belongs to the smallest id that any of its keys has, and the
documents of one such id form a block, or several of about BLOCK documents if they are many. Two blocks meet in one task
if some key has documents of both. So a text is sent once for its own block and once for every other block it has a key
in common with; only where n documents share keys throughout does that come to n / BLOCK times.

Words are as in `simhash`. Shingles are compared by 64 bits of hash. Defined cases: fewer words than a shingle make one
shingle of all; texts without words are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.simhash import near_duplicates
from palimpsest.llm.worker import done, kept, slices
from palimpsest.operators.components import connected_components
from palimpsest.runtime import stored

BANDS, ROWS = 32, 5
BLOCK = 256
#: SimHash buckets with more fingerprints link them to their smallest only; MinHash finds what that leaves apart.
STAR = 256
#: Columns of a group's matrix of shingles at a time.
COLUMNS = 4096
_random = np.random.default_rng(42)
FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | 1).astype(np.uint32)
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, sorted."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        low = np.minimum(low, (short[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    rows = low.astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def banded(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """(id, keys) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near copies")
        for b in slices(batches):
            keys = [band_keys(shingles(t.as_py(), k)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, keys array<long>")


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least `least`."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    width = int(shared.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        both += x @ x.T
    return both >= least * (n[:, None] + n[None, :] - both) - 1e-9


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect."""
    free, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        todo, free[i] = [i] if free[i] else [], False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & free)
            free[found] = False
            out += [(x, y) for y in found.tolist()]
            todo += found.tolist()
    return out


def compared(docs: DataFrame, id: str, text: str, k: int, least: float, sent: DataFrame, group: list[str]) -> DataFrame:
    """(src, dst): edges that connect the rows of similarity `least` or more in each group of sent's nodes."""
    texts = docs.select(F.col(id).alias("node"), F.col(text).alias("text"))

    def run(t: pa.Table) -> pa.Table:
        kept("near copies")
        t = t.sort_by("node")  # the order in which rows arrive is not the same when a task runs again
        edges = forest(similar([shingles(x.as_py(), k) for x in t.column("text")], least))
        node = t.column("node")
        done(t.num_rows, 4 * BLOCK)
        return pa.table({"src": node.take(pa.array([a for a, _ in edges], pa.int64())), "dst": node.take(pa.array([b for _, b in edges], pa.int64()))})

    kind = docs.schema[id].dataType.simpleString()
    return sent.join(texts, "node").groupBy(*group).applyInArrow(run, f"src {kind}, dst {kind}")


def simhash_links(docs: DataFrame, id: str, text: str, k: int, least: float, tau: int) -> DataFrame:
    """(src, dst): edges between rows of similarity `least` or more in the same SimHash component."""
    found = stored(near_duplicates(docs, id, text, k, tau, STAR).select(F.col(id).alias("node"), F.col("component_id").alias("head")))
    sizes = found.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil((F.col("n") - 1) / BLOCK).cast("int")
    mine = F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))
    everywhere = F.sequence(F.lit(0), parts - 1)
    sent = found.join(sizes, "head").select("head", "node", F.explode(F.when(F.col("node") == F.col("head"), everywhere).otherwise(mine)).alias("part"))
    return compared(docs, id, text, k, least, sent, ["head", "part"])


def minhash_links(docs: DataFrame, id: str, text: str, k: int, least: float, joined: DataFrame) -> DataFrame:
    """(src, dst): edges between rows of similarity `least` or more that connect all candidates which `joined`, the
    components (node, component) found before, leaves apart."""
    keys = stored(banded(docs, id, text, k))
    roots = keys.join(joined, keys["id"] == joined["node"], "left").select("id", F.coalesce("component", "id").alias("root"), "keys")
    heads = roots.select("id", "root", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("low"), F.min("root").alias("first"), F.max("root").alias("last"))
    rows = keys.select("id", F.explode("keys").alias("key"))
    met = stored(rows.join(heads.where("first <> last").select("key", "low"), "key").select("id", "key", "low"))
    own = met.groupBy("id").agg(F.min("low").alias("head"))
    sizes = own.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = stored(own.join(sizes, "head").select("id", F.struct("head", part.alias("part")).alias("block")))
    # blocks that have a key in common, and every block with itself
    held = met.join(placed, "id").select("key", "block").distinct()
    other = held.select("key", F.col("block").alias("other"))
    pairs = stored(held.join(other, "key").where("block <= other").select(F.col("block").alias("a"), F.col("other").alias("b")).distinct())
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    sent = ends.join(placed, "block").select("a", "b", F.col("id").alias("node"))
    return compared(docs, id, text, k, least, sent, ["a", "b"])


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, tau: int = 3) -> DataFrame:
    """(id, component_id) of the rows that are connected to another one; ids must be unique and not null."""
    first = stored(simhash_links(docs, id, text, k, least, tau))
    joined = stored(connected_components(first))
    rest = minhash_links(docs, id, text, k, least, joined)
    return connected_components(first.union(rest)).select(F.col("node").alias(id), F.col("component").alias("component_id"))
