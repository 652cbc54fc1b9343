"""Substring dedup by relative Lempel-Ziv parsing against an indexed, sharded reference.

The reference is the whole corpus. Its index holds phrases of `size` words by 96 bits of their hash and is dealt over
shards (the reference blocks) by that hash; it answers a phrase with its first place in the shard's order, or with
another place where the phrase asked for is that first one itself. A document is parsed greedily: a factor starts at a
phrase found elsewhere, points to its place there, and grows while the words that follow in the document are those that
follow at that place. At a factor's end the phrases across the boundary are looked up themselves, so a copy spliced from
two sources gives two factors that overlap and is not cut short. Every factor has `size` words or more; what factors
cover becomes the duplicate spans. A place is a document and a number of words before it.

To keep the index to what can match, each phrase is filed under its anchor: the smallest of its seed (8-word) hashes.
Equal phrases have equal anchors, so phrases whose anchor occurs once in the corpus are alone and never indexed.

Defined cases: null or short texts have no phrases; copies inside one document count; windows are judged on the input;
rows that repeat id and text are other places of the same words, so long ones are removed in all of them. Factors tell
which of several places they point to by the order of ids, hashes and words, for very common phrases by the order of
rows; spans do not depend on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 8
#: Words parsed at a time; a longer document is read in parts that overlap by a phrase less one word.
PART = 1 << 19
#: A key that a task meets so often in one batch is known to repeat: its rows need not be gathered.
OFTEN = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _anchors(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes by position, and for each phrase the position of its anchor (the leftmost smallest seed)."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = len(words) - SEED + 1
    seeds = np.zeros(n, np.uint64)
    for i in range(SEED):
        seeds = seeds * _MUL + h[i : i + n]
    seeds ^= seeds >> np.uint64(29)
    seeds *= np.uint64(0xBF58476D1CE4E5B9)
    seeds ^= seeds >> np.uint64(32)
    width = size - SEED + 1
    return seeds, np.arange(n - width + 1) + sliding_window_view(seeds, width).argmin(axis=1)


def _parts(words: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, max(len(words) - size + 1, 0), PART):
        yield at, words[at : at + PART + size - 1]


def anchors_of(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of all anchors of a document, one for each place."""
    out = []
    last = -1
    for at, part in _parts(words, size):
        seeds, pos = _anchors(part, size)
        places = np.unique(pos)
        out.append(seeds[places[places + at > last]])
        last = at + int(places[-1])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def phrases_of(words: list[bytes], size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every phrase whose anchor's hash is in wanted."""
    starts, hashes = [], []
    digest = xxhash.xxh3_128_digest
    for at, part in _parts(words, size):
        seeds, pos = _anchors(part, size)
        hit = np.flatnonzero(np.isin(seeds[pos], wanted))
        if len(hit):
            whole = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            begin = np.concatenate(([0], ends))[hit].tolist()
            stop = (ends[hit + size - 1] - 1).tolist()
            hashes.append(np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(begin, stop, strict=True)]), "<i8").reshape(-1, 2))
            starts.append(hit + at)
    if not starts:
        return np.empty(0, np.int64), np.empty((0, 2), np.int64)
    return np.concatenate(starts), np.concatenate(hashes)


def factors(starts: np.ndarray, docs: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse of a document whose phrases at `starts` lie elsewhere, in `docs` at `places`.

    Gives for each factor the index of its first phrase, which has its source, and its number of words.
    """
    order = np.lexsort((places, docs, starts))
    order = order[np.concatenate(([True], np.diff(starts[order]) > 0))[: len(order)]]  # a phrase may be told twice
    s, d, p = starts[order], docs[order], places[order]
    goes_on = (np.diff(s) == 1) & (np.diff(d) == 0) & (np.diff(p) == 1)
    first = np.flatnonzero(np.concatenate(([True], ~goes_on))[: len(s)])
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return order[first], s[last] - s[first] + size


def covered(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """(first word, words) of the spans that factors in order of their starts cover; what touches is one span."""
    out: list[tuple[int, int]] = []
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


def marked(h: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to take from a batch, their h, and another row of the same key: h is ~h (negative) for rows whose key occurs
    OFTEN in the batch; of the others no second row is known (-1).

    One more row of each such key comes last with its h unchanged; it tells the key to the task that compares it.
    """
    n = len(h)
    if n < OFTEN:
        return np.arange(n), h, np.full(n, -1)
    order = np.lexsort(keys)
    new = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, n)) >= OFTEN
    group = np.cumsum(new) - 1
    known = np.zeros(n, bool)
    known[order] = often[group]
    other = np.full(n, -1)
    other[order] = order[first[group]]
    other[order[first[often]]] = order[first[often] + 1]
    other[~known] = -1
    told = order[first[often]]
    return np.concatenate((np.arange(n), told)), np.concatenate((np.where(known, ~h, h), h[told])), np.concatenate((other, np.full(len(told), -1)))


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers in one: a place and the second part of a phrase's hash, or two places."""
    return (high.astype(np.int64) << 32) | (low.astype(np.int64) & 0xFFFFFFFF)


def repeated(rows: DataFrame, keys: dict[str, Column | None], name: str | None = None) -> DataFrame:
    """The rows whose keys occur twice or more, without gathering any group; h comes from `marked`.

    One shuffle: rows of unknown keys by the keys, rows known to repeat by their whole content, so that a key which a
    third of all rows hold is spread over all tasks. Each task then reads its rows in key order and compares
    neighbours, one batch at a time, so a key of any number of rows needs no memory and no join. Rows known to repeat are
    no one's neighbours: the row that tells their key may be one of them again.

    keys: the columns that make the key; where an expression stands with one, it takes the low half of the number.
    name: the column by which another row is called, if rows are phrases (id, h, at, p1) with the first word in the high
    half of `at`. Then p1 becomes the name of another row with the key, and the low half of `at` its first word there.
    That is the first such row in order, for that one the second. Rows known to repeat bring theirs in the key's place.
    """
    names, halves = list(keys), {c for c, k in keys.items() if k is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose right neighbour is in the next batch
        origin: tuple[int, int] | None = None  # name and first word of the first row with its key, if not itself
        for b in chain(batches, [None]):
            last = b is None
            if last and held is None or not last and not b.num_rows:
                continue
            parts = [x for x in (held, b) if x is not None]
            b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            column = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names if n != "id" or n == name}
            h = column["h"]
            known = h < 0
            equal = ~(known[1:] | known[:-1])
            for k in names:
                v = column[k] & 0xFFFFFFFF if k in halves else column[k]
                equal &= v[1:] == v[:-1]
            twin = origin is not None
            n = b.num_rows - (not last)  # rows to give out
            places = np.arange(b.num_rows)
            heads = np.maximum.accumulate(np.where(np.concatenate(([True], ~equal)), places, 0))
            keep = (known | np.concatenate(([twin], equal)) | np.concatenate((equal, [False])))[:n]
            h = np.where(known, ~h, h)
            told = {"h": h}
            if name:
                own = h if name == "h" else column[name]
                other = np.where(heads == places, np.minimum(heads + 1, b.num_rows - 1), heads)
                first = column["at"] >> 32
                source, word = own[other], first[other]
                if twin:
                    source[heads == 0], word[heads == 0] = origin
                told["at"] = packed(first, np.where(known, column["at"], word))
                told["p1"] = np.where(known, column["p1"], source)
            arrays = [pa.array(told[f.name], f.type) if f.name in told else b.column(f.name) for f in b.schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema).slice(0, n).filter(pa.array(keep))
            if not last:
                held = b.slice(n)
                if heads[n] == n:
                    origin = None
                elif heads[n] or not twin:
                    origin = (int(own[heads[n]]), int(column["at"][heads[n]]) >> 32) if name else (0, 0)

    known = F.col("h") < 0
    key = [F.col(c) if part is None else part for c, part in keys.items()]
    dealt = [F.when(known, F.xxhash64(*rows.columns)), *[F.when(~known, k) for k in key]]
    order = [*key, known, *([name, "at"] if name else [])]
    return rows.repartition(*dealt).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def duplicate_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 35) -> DataFrame:
    """(id, n_words, n_removed, spans, factors, kept_text, name) for every row of docs.

    spans: (start, length) in words, apart from each other; factors: (start, length, source, source_start), which may
    overlap; source is the `name` of a row that has the same words there. A row's name is its id, if ids are whole
    numbers of which none is null or repeated; else it is a hash of its text, and rows are told apart by both. Which rows of common keys a task marks
    depends on where its batches end, so before texts are read for the index they are put in an order that is the same
    when the task runs again.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    twice = docs.groupBy(F.col(id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    by_id = kind in ("bigint", "int", "smallint", "tinyint") and not twice.limit(1).count()
    # its sign is free for `marked`; zeros take no room in a shuffle
    rows = rows.withColumn("h", F.lit(0).cast("long") if by_id else F.shiftrightunsigned(F.xxhash64("text"), 1))

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [anchors_of(_words(t.as_py()), size) for t in b.column(1)]
            rows = np.repeat(np.arange(len(got)), [len(g) for g in got])
            flat = np.concatenate([*got, np.empty(0, np.uint64)]).view(np.int64)
            take, h, _ = marked(b.column(2).to_numpy(zero_copy_only=False)[rows], flat)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[take])), pa.array(h), pa.array(flat[take])], names=["id", "h", "anchor"])

    def emit_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                got = [phrases_of(_words(t.as_py()), size, np.array(w.as_py(), np.int64).view(np.uint64)) for t, w in zip(c.column(1), c.column(3), strict=True)]
                rows = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                hashes = np.concatenate([g[1] for g in got])
                starts, p1, p2 = np.concatenate([g[0] for g in got]).astype(np.int32), hashes[:, 0], hashes[:, 1].astype(np.int32)
                take, h, other = marked(c.column(2).to_numpy(zero_copy_only=False)[rows], p1, p2)
                # a row known to repeat brings another place along instead of its key
                own = np.where(h < 0, starts[other], p2[take])
                named = c.column(0 if by_id else 2).to_numpy(zero_copy_only=False)
                p1 = np.where(h < 0, named[rows][other], p1[take])
                cols = [c.column(0).take(pa.array(rows[take])), pa.array(h), pa.array(packed(starts[take], own)), pa.array(p1)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "at", "p1"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, removed, spans, kept = [], [], [], []
            hits, sources = b.column(3), b.column(4)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            at, doc = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (hits, sources))
            start, place = at >> 32, at & 0xFFFFFFFF
            chosen, sizes, counts = [], [], []
            for t, lo, hi in zip(b.column(1), [0, *ends[:-1]], ends, strict=True):
                words = _words(t.as_py())
                first, n = factors(start[lo:hi], doc[lo:hi], place[lo:hi], size)
                chosen.append(first + lo)
                sizes.append(n)
                counts.append(len(n))
                found = covered(start[lo:hi][first], n)
                keep, done = [], 0
                for a, w in found:
                    keep += words[done:a]
                    done = a + w
                keep += words[done:]
                ns.append(len(words))
                removed.append(len(words) - len(keep))
                spans.append([{"start": a, "length": w} for a, w in found])
                kept.append(b" ".join(keep).decode())
            pick = np.concatenate([*chosen, np.empty(0, np.int64)]).astype(np.int64)
            length = np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)
            told = pa.StructArray.from_arrays([pa.array(start[pick]), pa.array(length), pa.array(doc[pick]), pa.array(place[pick])], names=["start", "length", "source", "source_start"])
            parsed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), told)
            cols = [b.column(0), pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), parsed, pa.array(kept, pa.string()), b.column(0 if by_id else 2).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "spans", "factors", "kept_text", "name"])

    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    # the index: anchors that occur twice, by document
    anchors = rows.mapInArrow(emit_anchors, f"id {kind}, h long, anchor long")
    wanted = repeated(anchors, {"anchor": None}).groupBy("id", "h").agg(F.collect_set("anchor").alias("anchors"))
    routed = rows.join(wanted, same(rows, wanted)).select(rows["id"], rows["text"], rows["h"], "anchors").sortWithinPartitions("h", "id")
    # the reference blocks: phrases by hash; found elsewhere means two places or more
    phrases = routed.mapInArrow(emit_phrases, f"id {kind}, h long, at long, p1 long")
    found = repeated(phrases, {"p1": None, "at": F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))}, name="id" if by_id else "h")
    # the two lists are gathered row by row, so they stay in step
    hits = found.groupBy("id", "h").agg(F.collect_list("at").alias("hits"), F.collect_list("p1").alias("sources"))
    parsed = rows.join(hits, same(rows, hits), "left").select(rows["id"], rows["text"], rows["h"], "hits", "sources")
    factor = "struct<start:bigint,length:bigint,source:bigint,source_start:bigint>"
    shape = f"id {kind}, n_words long, n_removed long, spans array<struct<start:bigint,length:bigint>>, factors array<{factor}>"
    out = parsed.mapInArrow(parse, f"{shape}, kept_text string, name long")
    return out.withColumnRenamed("id", id)
