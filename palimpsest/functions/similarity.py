"""Costs between two file records; 0 is alike. Arguments are the columns of either side."""

from __future__ import annotations

from dataclasses import dataclass
from math import fma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

HOUR_NS, DAY_NS = 3_600 * 10**9, 86_400 * 10**9


@dataclass(frozen=True)
class Weights:
    content: float = 0.6
    path: float = 0.3
    metadata: float = 0.1


def content_cost(size_a: Column, raw_a: Column, fast_a: Column, size_b: Column, raw_b: Column, fast_b: Column) -> Column:
    """Sizes are compared first, then full hashes, then fast ones."""
    return F.when(size_a != size_b, 1.0).when(raw_a == raw_b, 0.0).when(fast_a == fast_b, 0.3).otherwise(0.6)


def metadata_cost(mtime_a: Column, mode_a: Column, mtime_b: Column, mode_b: Column) -> Column:
    """Mean of a time step (hour, day) and a permission step; decimals keep extreme times from overflowing."""
    gap = F.abs(mtime_a.cast("decimal(38,0)") - mtime_b.cast("decimal(38,0)"))
    when = F.when(gap < HOUR_NS, 0.0).when(gap < DAY_NS, 0.5).otherwise(1.0)
    mode = F.when(mode_a.bitwiseAND(F.lit(4095)) == mode_b.bitwiseAND(F.lit(4095)), 0.0).otherwise(0.5)
    return (when + mode) / 2


def jaro_winkler(a: str, b: str, scale: float = 0.1, longest: int = 4, above: float = 0.7) -> float:
    """The published similarity: Jaro plus a bonus for a common prefix of up to four characters, where Jaro is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    hits_a, taken = [], [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == c:
                taken[j] = True
                hits_a.append(c)
                break
    m = len(hits_a)
    if not m:
        return 0.0
    hits_b = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= above:
        return jaro
    prefix = 0
    while prefix < min(longest, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return fma(prefix * scale, 1 - jaro, jaro)  # rounded once, as DuckDB does, so that costs at a threshold fall on the same side


#: Pairs compared at a time, and for n up to 64 the word whose lowest n bits are set.
PAIRS = 4096
LOWEST = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """The same to the last bit for many pairs: those of up to 64 characters a block at a time, longer ones singly."""
    out = np.empty(len(a))
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = jaro_winkler(a[i], b[i])
    short = np.flatnonzero(size <= 64)
    for at in range(0, len(short), PAIRS):
        rows = short[at : at + PAIRS]
        out[rows] = _block([a[i] for i in rows.tolist()], [b[i] for i in rows.tolist()])
    return out


def _block(a: list[str], b: list[str], scale: float = 0.1, longest: int = 4, above: float = 0.7) -> np.ndarray:
    """A character of b is a bit of its row's word, so one step places a character of every a."""
    n, len_a, len_b = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = max(1, int(max(len_a.max(), len_b.max())))
    text_a, text_b = (np.array(t, f"<U{width}").view("<u4").reshape(n, width) for t in (a, b))
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    taken, hits_a, equal = np.zeros(n, np.uint64), np.zeros((n, width), bool), np.zeros((n, 8), np.uint8)
    for i in range(width):
        equal[:, : -(-width // 8)] = np.packbits(text_b == text_a[:, i : i + 1], axis=1, bitorder="little")
        near = LOWEST[np.minimum(len_b, i + reach + 1)] & ~LOWEST[np.maximum(i - reach, 0)] & ~taken
        free = np.where(i < len_a, equal.view("<u8").ravel() & near, np.uint64(0))
        taken |= free & (~free + np.uint64(1))
        hits_a[:, i] = free != 0
    hits_b = np.unpackbits(taken.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width].astype(bool)
    m = hits_a.sum(axis=1)
    moved = np.repeat(np.arange(n), m)[text_a[hits_a] != text_b[hits_b]]
    swaps = np.bincount(moved, minlength=n) // 2
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(m > 0, (m / len_a + m / len_b + (m - swaps) / m) / 3, np.where(len_a + len_b > 0, 0.0, 1.0))
    same = np.cumprod((text_a == text_b)[:, :longest], axis=1).sum(axis=1)
    prefix = np.where(out > above, np.minimum(same, np.minimum(len_a, len_b)), 0)
    for p in range(1, longest + 1):
        rows = np.flatnonzero(prefix == p)
        jaro, each = np.unique(out[rows], return_inverse=True)  # few different ones
        out[rows] = np.array([fma(p * scale, 1 - x, x) for x in jaro.tolist()])[each]
    return out


@F.pandas_udf(DoubleType())
def path_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(1.0 - jaro_winkler_all([x or "" for x in a], [x or "" for x in b]))
