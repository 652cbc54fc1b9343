"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any place of a new text, the longest match with that
text. Parsing a text greedily into such matches needs few phrases in its own language and many in others; phrases are
normalised by the log of the training length, and the language with the fewest wins. Every letter of the training text
counts; one that a language has not seen is a phrase of its own there, and runs of other characters are one break.

The training sample is bounded: `rows` documents a language (those with the smallest hash), `chars` characters from
each. Prediction reads every text whole, in parts of LANE symbols that are parsed side by side and start a phrase each.

Defined cases: null text or one without a letter is `und` with score 0; ties go to the smaller language name; without
a labelled row every text is `und`; rows are predicted one by one, so repeats are equal.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.worker import kept, slices

LANE = 1024
#: Letters of a language up to which its automaton is a dense table; with more, transitions are searched in order.
DENSE = 128
#: Symbols handled at a time by a worker.
BLOCK = 1 << 21


def held_out(id: Column) -> Column:
    """True for documents kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_text(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 64, chars: int = 500) -> dict[str, str]:
    """At most rows * chars characters a language, collected: labelled documents with the smallest hash of id."""
    h = F.xxhash64(F.col(id).cast("string"), F.lit("sample"))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id))).select(F.col(lang).alias("lang"), h.alias("h"), F.substring(F.col(text), 1, chars).alias("text"))
    # two steps, so that a common language is no single task
    part = labelled.withColumn("_k", F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "text"))).where(F.col("_k") <= rows)
    best = part.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("_k") <= rows)
    out: dict[str, list[str]] = {}
    for r in sorted(best.select("lang", "h", "text").collect()):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


class Automaton:
    """The suffix automaton of one language's symbols, as transitions that many texts follow side by side.

    Symbols are numbers common to all languages. `own` gives a language's number for each: 0 is a break, then come its
    letters, and the last stands for every letter it has not seen, which never matches.
    """

    def __init__(self, s: np.ndarray, symbols: int):
        seen = np.unique(s[s > 0])
        self.width = len(seen) + 2
        self.own = np.full(symbols, self.width - 1, np.uint32)
        self.own[0] = 0
        self.own[seen] = np.arange(1, len(seen) + 1)
        rows = self._transitions(self.own[s].tolist())
        self.dead = len(rows)  # a state without any way on: before a text, and after a letter never seen
        rows.append({})
        # short numbers keep the tables in a core's cache; the largest number says that there is no way on
        self.kind = np.uint16 if len(rows) < 0xFFFF else np.uint32
        self.none = np.iinfo(self.kind).max
        if self.width <= DENSE:
            table = np.full((len(rows), self.width), self.none, self.kind)
            for i, row in enumerate(rows):
                if row:
                    table[i, list(row)] = list(row.values())
            self.table, self.keys = table.ravel(), None
        else:
            found = sorted((i * self.width + c, to) for i, row in enumerate(rows) for c, to in row.items())
            self.keys = np.array([k for k, _ in found], np.int64)
            self.table = np.array([to for _, to in found], self.kind)
        first = self.step(np.zeros(self.width, np.int32), np.arange(self.width))
        self.root = np.where(first == self.none, self.dead, first).astype(self.kind)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that follow, `none` where there is no way on."""
        if self.keys is None:
            return self.table[state * np.int32(self.width) + c]
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.table[at], self.none)

    @staticmethod
    def _transitions(s: list[int]) -> list[dict[int, int]]:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in s:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        return nxt


class CrossParser:
    """One automaton per language, over all letters of the training text."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if unicodedata.category(c)[0] == "L"})
        # 0: anything but a letter, 1: a letter that no training text has
        self.code = np.zeros(0x110000, np.uint16 if len(letters) < 0xFFFE else np.uint32)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == "L":
                self.code[cp] = 1
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 2
        parts = [self.symbols(texts[lang]) for lang in self.langs]
        self.automata = [Automaton(s, len(letters) + 2) for s in parts]
        self.scale = [log2(max(len(s), 2)) for s in parts]

    def symbols(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text, runs of other characters than letters as one break."""
        s = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        if not len(s):
            return s
        return s[(s > 0) | np.concatenate(([True], s[:-1] > 0))]

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of every part in every language: (languages, parts)."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        sizes = np.array([len(parts[i]) for i in order])
        grid = np.zeros((LANE, len(parts)), self.code.dtype)
        for k, i in enumerate(order):
            grid[: len(parts[i]), k] = parts[i]
        alive = [int(np.searchsorted(-sizes, -step, "left")) for step in range(int(sizes[0]) if len(sizes) else 0)]  # parts longer than step
        out = np.zeros((len(self.langs), len(parts)), np.int64)
        for x, a in enumerate(self.automata):
            state = np.full(len(parts), a.dead, np.int32)
            count = np.zeros(len(parts), np.int32)
            for step, n in enumerate(alive):
                c = a.own[grid[step, :n]]
                s = a.step(state[:n], c)
                stop = s == a.none
                s[stop] = a.root[c[stop]]
                count[:n] += stop
                state[:n] = s
            out[x, order] = count
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        at = 0
        while at < len(texts):
            parts, owner, filled, first = [], [], 0, at
            while at < len(texts) and (filled < BLOCK or at == first):
                s = self.symbols(texts[at] or "")
                if (s > 0).any():
                    for k in range(0, len(s), LANE):
                        parts.append(s[k : k + LANE])
                        owner.append(at)
                    filled += len(s)
                at += 1
            totals = np.zeros((len(self.langs), at - first))
            for k in range(0, len(parts), BLOCK // LANE):  # a very long text fills several grids
                own = np.array(owner[k : k + BLOCK // LANE]) - first
                for x, row in enumerate(self.phrases(parts[k : k + BLOCK // LANE])):
                    totals[x] += np.bincount(own, row, at - first)
            for i in sorted(set(owner)):
                col = totals[:, i - first] * self.scale
                best = int(col.argmin())
                rest = np.delete(col, best)
                out[i] = (self.langs[best], float(1 - col[best] / rest.min()) if len(rest) else 1.0)
        return out


def _model(texts: dict[str, str]) -> CrossParser:
    key = zlib.crc32(repr(sorted(texts.items())).encode())
    models = kept("language_id")
    if key not in models:
        models.clear()
        models[key] = CrossParser(texts)
    return models[key]


def predicted(docs: DataFrame, texts: dict[str, str], id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, *carry) for every row; texts is the training text per language (bounded, see above)."""
    carry = carry or []
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    names = ["_id", *[f"_c_{c}" for c in carry]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = _model(texts).predict(b.column(1).to_pylist())
            cols = [b.column(names[0]), *[b.column(n) for n in names[1:]], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, schema + ", lang_pred string, score double")
    return out.select(F.col("_id").alias(id), "lang_pred", "score", *[F.col(f"_c_{c}").alias(c) for c in carry])


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that get no language; columns and row contents stay as they are."""
    texts = training_text(docs, id, text, lang)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = _model(texts).predict(b.column(at).to_pylist())
            yield b.filter(pa.array([g[0] != "und" for g in got], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a worker's columns may have no dots in their names
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
