"""Best-fit packing by bin completion over length classes.

There are at most `limit` different lengths, so the histogram of lengths is small at any scale and exact. Bin completion
is a branch and bound on it: a node places the largest open length, its branches are the undominated fillings of the
room beside it, least waste first. A filling goes to as many sequences at once as the counts allow; going back, it is
tried for one sequence alone, which makes the search complete. Best-fit decreasing on the same histogram is the first
incumbent; a branch is cut when its waste leaves no way to beat the incumbent, and the search ends at the lower bound.

Packing is NP-hard, so the search has a budget: `nodes` steps after the first full dive, and `width` steps for the
fillings of one room where there are many lengths. Every packing is whole; beyond the budget it is the best one found,
without a proof. The plan (length, rank range, first sequence, offset) is a table bounded by the search, and every piece
finds its place by its rank within its length.

Defined cases: an empty table gives no rows; a length above the limit is an error; equal lengths are ranked by a hash
of the row, then by id, so ties and repeated rows get places of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import stored

Filling = tuple[tuple[int, int], ...]  # ((length, how often), ...)
Pattern = tuple[Filling, int]  # and the number of sequences it goes to

#: Lengths up to which all fillings of a room are listed, and states remembered.
FEW = 64


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Sequences that any packing needs: by volume, and by what can't share one with pieces over half of it."""
    sizes = sorted(k for k, n in counts.items() if n)
    if not sizes:
        return 0
    number = [0, *accumulate(counts[s] for s in sizes)]
    volume = [0, *accumulate(s * counts[s] for s in sizes)]
    best = -(-volume[-1] // limit)
    half = bisect_right(sizes, limit // 2)
    for k in range(half + 1):
        small = sizes[k] if k < len(sizes) else limit
        # above limit - small: alone; then over a half: one to a sequence, with some room; then from small up
        alone = bisect_right(sizes, limit - small) if k < half else half
        big = number[-1] - number[half]
        room = (number[alone] - number[half]) * limit - (volume[alone] - volume[half])
        best = max(best, big + max(0, -(-(volume[half] - volume[k] - room) // limit)) if k < half else big)
    return best


def dominated(filling: Filling, room: int, open_: list[int], left: dict[int, int]) -> bool:
    """Whether an open piece that stays out could replace nothing, one or two of the filling's pieces without overflow.

    Then the packing is no worse with it in their place. open_ ascends; `left` counts pieces before the filling."""
    used = dict(filling)
    rest = room - sum(s * n for s, n in filling)

    def fits(low: int) -> bool:
        """A piece of low to low + rest stays out."""
        for i in range(bisect_left(open_, max(low, 1)), bisect_right(open_, low + rest)):
            if left[open_[i]] > used.get(open_[i], 0):
                return True
        return False

    sizes = [s for s, n in filling]
    if fits(0):
        return True
    if any(fits(s + 1) for s in sizes):
        return True
    pairs = {a + b for i, a in enumerate(sizes) for b in sizes[i + 1 :]} | {2 * s for s, n in filling if n > 1}
    return any(fits(x) for x in pairs)


def fillings(room: int, open_: list[int], left: dict[int, int], waste: int, steps: int | None) -> tuple[list[Filling], int]:
    """Undominated fillings of room that waste at most `waste`, least waste first, then largest pieces; steps spent.

    steps bounds the search; larger pieces are tried first, each as often as it fits and then less often."""
    volume = [0, *accumulate(s * left[s] for s in open_)]
    found: list[tuple[int, Filling]] = []
    spent = 0
    stack: list[tuple[int, int, Filling]] = [(room, len(open_), ())]
    while stack and (steps is None or spent < steps):
        rest, top, chosen = stack.pop()
        spent += 1
        k = bisect_right(open_, rest, 0, top)
        if rest - volume[k] > waste:
            continue
        if not k:
            found.append((rest, chosen))
            continue
        size = open_[k - 1]
        for n in range(min(rest // size, left[size]) + 1):  # the last one pushed is the first one tried
            stack.append((rest - n * size, k - 1, (*chosen, (size, n)) if n else chosen))
    found.sort(key=lambda x: x[0])  # stable: of equal waste the largest pieces come first
    whole = [f for _, f in found if not dominated(f, room, open_, left)]
    return whole or [f for _, f in found[:1]], spent


def _best_fit(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Largest first; each room left is filled by the largest length that fits, over whole classes at a time."""
    left, out = dict(counts), []
    open_ = sorted(k for k, n in left.items() if n)
    while open_:
        size = open_[-1]
        pattern, room = [(size, 1)], limit - size
        left[size] -= 1
        k = len(open_)
        while (k := bisect_right(open_, room, 0, k)) > 0:
            n = min(room // open_[k - 1], left[open_[k - 1]])
            if n:
                pattern.append((open_[k - 1], n))
                left[open_[k - 1]] -= n
                room -= n * open_[k - 1]
            k -= 1
        use: dict[int, int] = {}
        for s, n in pattern:
            use[s] = use.get(s, 0) + n
        times = 1 + min(left[s] // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * (times - 1)
        out.append((tuple(use.items()), times))
        open_ = [s for s in open_ if left[s] > 0]
    return out


def plan(counts: dict[int, int], limit: int, nodes: int = 100_000, width: int = 400) -> list[Pattern]:
    """Patterns that hold every piece, in as few sequences as the search finds; see above for nodes and width."""
    if any(not 0 < k <= limit for k in counts):
        raise ValueError("lengths must lie between 1 and the limit")
    counts = {k: n for k, n in counts.items() if n}
    used = lambda p: sum(n for _, n in p)
    best = _best_fit(counts, limit)
    bound, most = lower_bound(counts, limit), used(best)
    few = len(counts) <= FEW
    left, sizes = dict(counts), sorted(counts)
    volume, bins, spent, dived = sum(k * n for k, n in counts.items()), 0, 0, False
    path: list[Pattern] = []
    seen: dict[tuple[int, ...], int] = {}

    def branches() -> list[Pattern]:
        """Ways to go on from here, best first; none where the incumbent can't be beaten."""
        nonlocal spent
        if bins + -(-volume // limit) >= most:
            return []
        if few:
            state = tuple(left[s] for s in sizes)
            if seen.get(state, most) <= bins:
                return []
            seen[state] = bins
        open_ = [s for s in sizes if left[s]]
        size = open_[-1]
        left[size] -= 1
        rest = open_ if left[size] else open_[:-1]
        allowed = (most - 1 - bins) * limit - volume  # more waste than this can't beat the incumbent
        chosen, steps = fillings(limit - size, rest, left, allowed, None if few and dived else width)
        left[size] += 1
        spent += steps
        out: list[Pattern] = []
        for f in chosen:
            whole = dict(f)
            whole[size] = whole.get(size, 0) + 1
            times = min(left[s] // n for s, n in whole.items())
            out += [(tuple(whole.items()), t) for t in ((times, 1) if times > 1 else (1,))]
        return out

    def apply(pattern: Pattern, sign: int) -> None:
        nonlocal bins, volume
        for s, n in pattern[0]:
            left[s] -= sign * n * pattern[1]
            volume -= sign * s * n * pattern[1]
        bins += sign * pattern[1]

    if few:
        dived = True
    stack = [iter(branches())] if most > bound else []
    while stack and most > bound and (not dived or spent < nodes):
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                apply(path.pop(), -1)
            if not dived:
                dived, spent = True, 0
            continue
        apply(step, 1)
        path.append(step)
        if volume:
            stack.append(iter(branches()))
            continue
        if bins < most:
            best, most = list(path), bins
        apply(path.pop(), -1)
        if not dived:
            dived, spent = True, 0
    return best


def placed(pieces: DataFrame, limit: int = 4096, length: str = "length", key: list[str] | None = None) -> DataFrame:
    """pieces (a stored table: it is read twice) with sequence_id and offset; key names the columns that order ties."""
    spark, key = pieces.sparkSession, key or ["doc_id", "piece"]
    hist = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `limit` rows
    ranks, sequence, rows = {}, 0, []
    for pattern, times in plan(hist, limit):
        at = 0
        for size, n in pattern:
            first = ranks.get(size, 0)
            rows.append((size, first, first + n * times, n, sequence, at))
            ranks[size] = first + n * times
            at += size * n
        sequence += times
    places = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "_size long, _first long, _end long, _n long, _seq long, _at long")
    # ranks within a length: counts of hash buckets first, then the order inside a bucket
    buckets = max(1, max(hist.values(), default=0) // 20_000)
    h = F.xxhash64(*key)
    dealt = pieces.withColumn("_h", h).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    sums = dealt.groupBy(length, "_bucket").count()
    before = F.sum("count").over(W.partitionBy(length).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(length, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(length, "_bucket").orderBy("_h", *key)) - 1
    ranked = dealt.withColumn("_inside", inside).join(sums, [length, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    small = F.broadcast(places) if len(rows) <= 100_000 else places
    out = ranked.join(small, (F.col(length) == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_first")
    out = out.withColumn("sequence_id", F.col("_seq") + F.expr("(_rank - _first) div _n")).withColumn("offset", F.col("_at") + (nth % F.col("_n")) * F.col(length))
    return out.select(*pieces.columns, "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 4096, end: int = 1, ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    from palimpsest.llm.tokens import pieces

    return placed(stored(pieces(docs, tokenizer, id, text, limit, end, ids)), limit, key=[id, "piece"])
