"""Search for the window and dead band whose smoothed labels disagree least with the true ones."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.windows import RUN, changed, run_order

#: Samples of a block; a block's task also sees half the widest window on both sides.
BLOCK = 65_536


def intervals(df: DataFrame, true: str, inferred: str) -> DataFrame:
    """(subject, run, _n, _a, _b, _p, _t): the stretches [_a, _b) of a run's sample positions on which
    neither label changes, with twice the labels' values, and the run's length."""
    w, whole = run_order(), Window.partitionBy(*RUN)
    level = lambda c: (2 * L.encode(F.col(c))).cast("int")
    rows = df.select(*RUN, "run_us", level(inferred).alias("_p"), level(true).alias("_t"))
    rows = rows.withColumns({"_a": (F.row_number().over(w) - 1).cast("long"), "_n": F.count("*").over(whole), "_new": changed(F.col("_p") * 3 + F.col("_t"), w)})
    starts = rows.filter("_new = 1")
    return starts.select(*RUN, "_n", "_a", F.coalesce(F.lead("_a").over(Window.partitionBy(*RUN).orderBy("_a")), F.col("_n")).alias("_b"), "_p", "_t")


def in_blocks(stretches: DataFrame, reach: int, block: int) -> DataFrame:
    """(subject, run, _g, _lo, _hi, _a, _b, _p, _t): each stretch, continued over reflected edges by
    `reach` places, in every block [_lo, _hi) that sees it, cut to what the block sees."""
    n = F.col("_n")
    turns = F.ceil(F.lit(float(reach)) / n).cast("int") + 1
    period = F.sequence(-turns, turns)
    even = F.transform(period, lambda k: F.struct((2 * n * k + F.col("_a")).alias("a"), (2 * n * k + F.col("_b")).alias("b")))
    odd = F.transform(period, lambda k: F.struct((2 * n * k - F.col("_b")).alias("a"), (2 * n * k - F.col("_a")).alias("b")))
    seen = F.filter(F.concat(even, odd), lambda s: (s["b"] > -reach) & (s["a"] < n + reach))
    rows = stretches.select(*RUN, "_n", "_p", "_t", F.explode(seen).alias("_s"))
    last = F.floor((n - 1) / block)
    clip = lambda g: F.least(F.greatest(g, F.lit(0)), last).cast("long")
    groups = F.sequence(clip(F.floor((F.col("_s.a") - reach) / block)), clip(F.floor((F.col("_s.b") - 1 + reach) / block)))
    rows = rows.withColumn("_g", F.explode(groups)).withColumns({"_lo": F.col("_g") * block, "_hi": F.least((F.col("_g") + 1) * block, n)})
    cut = {"_a": F.greatest(F.col("_s.a"), F.col("_lo") - reach), "_b": F.least(F.col("_s.b"), F.col("_hi") + reach)}
    return rows.withColumns(cut).filter("_a < _b").select(*RUN, "_g", "_lo", "_hi", "_a", "_b", "_p", "_t")


def _at_least(start, slope, length, bound):
    """How many of the values start + slope * j, j below length, are at least the bound."""
    up = length - np.clip(-((start - bound) // np.maximum(slope, 1)), 0, length)
    down = np.clip((start - bound) // np.maximum(-slope, 1) + 1, 0, length)
    return np.where(slope > 0, up, np.where(slope < 0, down, np.where(start >= bound, length, 0)))


def _tallies(start, slope, length, true, size):
    """A function of a bound: the samples with at least that sum, by true label (0, 0.5, 1)."""
    if slope is None:
        seen = np.bincount(true * (2 * size + 1) + start, minlength=3 * (2 * size + 1)).reshape(3, -1)
        return lambda bound: seen[:, bound:].sum(axis=1)
    return lambda bound: np.bincount(true, weights=_at_least(start, slope, length, bound), minlength=3).astype(np.int64)


def _cuts(method: str, size: int, delta: float, threshold: float) -> tuple[int, int]:
    """Of the values a smoothed sample can have, the first that becomes 1 and the first that doesn't
    become 0: (twice the) sums of a window, or the levels 0, 0.5 and 1 of a median."""
    values = np.arange(2 * size + 1) / 2 / size if method == "uniform" else np.array([0.0, 0.5, 1.0])
    one = int(np.count_nonzero(values < threshold + delta))
    return one, min(int(np.count_nonzero(values <= threshold - delta)), one)


def _search_block(table: pa.Table, windows, cuts, method) -> pa.Table:
    a, b, p, t = (table[c].to_numpy().astype(np.int64) for c in ("_a", "_b", "_p", "_t"))
    order = np.argsort(a)
    a, b, p, t = a[order], b[order], p[order], t[order]
    lo, hi, base = table["_lo"][0].as_py(), table["_hi"][0].as_py(), int(a[0])
    levels, truth = np.repeat(p, b - a), np.repeat(t, b - a)
    series = [levels] if method == "uniform" else [(levels < 1).astype(np.int64), (levels < 2).astype(np.int64)]
    sums = [np.concatenate(([0], np.cumsum(s))) for s in series]
    own = np.bincount(truth[lo - base : hi - base], minlength=3)
    turn = a[1:][p[1:] != p[:-1]]
    fixed = np.concatenate(([lo], a[1:][t[1:] != t[:-1]]))
    # A window's sum is linear in its place between the places where an edge meets a change; where
    # changes are many, every place is looked at.
    few = 2 * len(turn) + len(fixed) < (hi - lo) // 8
    out = []
    for i, size in enumerate(windows):
        before, after = size // 2, size - size // 2 - 1
        if few:
            at = np.unique(np.concatenate((fixed, turn - after - 1, turn + before)))
            at = at[(at >= lo) & (at < hi)]
        else:
            at = np.arange(lo, hi)
        first, past, true = at - before - base, at + after + 1 - base, truth[at - base]
        length = np.diff(np.append(at, hi)) if few else None
        above = [_tallies(c[past] - c[first], s[past] - s[first] if few else None, length, true, size) for c, s in zip(sums, series)]
        # at_least[k]: samples whose smoothed value is the k-th or higher, by true label
        if method == "uniform":
            at_least = above[0]
        else:
            zeros, under = (f(size // 2 + 1) for f in above)
            at_least = (own, own - zeros, own - under, 0 * own).__getitem__
        for j, (one, some) in enumerate(cuts[i]):
            ones, more = at_least(one), at_least(some)
            out.append((i, j, int(own.sum() - (own - more)[0] - (more - ones)[1] - ones[2])))
    keys = {k: pa.array([table[k][0].as_py()] * len(out), pa.int64()) for k in RUN}
    return pa.table({**keys, **{name: pa.array(v, pa.int64()) for name, v in zip(("_w", "_d", "_m"), zip(*out))}})


def grid_search(df: DataFrame, true: str, inferred: str, windows: tuple[int, ...] = tuple(range(200, 2001, 10)), deltas: tuple[float, ...] = (0.02, 0.05, 0.07, 0.1), threshold: float = 0.5, method: str = "uniform", block: int = BLOCK) -> DataFrame:
    """(subject, run, size, delta, mismatches) of the best window and dead band: fewest
    disagreements, then the smallest window, then the first delta. method: uniform or median, as in
    smooth. Only stretches between label changes are shuffled; a block of positions of a run is searched for
    itself, with work in proportion to its changes, and counts of blocks are summed. Missing labels
    count as mixed; a run without samples has no row."""
    if method not in ("uniform", "median"):
        raise ValueError(f"unknown method {method}")
    windows, deltas = tuple(windows), tuple(deltas)
    cuts = [[_cuts(method, size, delta, threshold) for delta in deltas] for size in windows]
    search = partial(_search_block, windows=windows, cuts=cuts, method=method)
    rows = in_blocks(intervals(df, true, inferred), max(windows) // 2 + 1, block)
    # A number is given, as few bytes mean much work here.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *RUN, "_g")
    each = rows.groupBy(*RUN, "_g").applyInArrow(lambda table: search(table), "subject long, run long, _w long, _d long, _m long")
    total = each.groupBy(*RUN, "_w", "_d").agg(F.sum("_m").alias("mismatches"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(i) + 1).cast("int"))
    best = total.withColumns({"size": pick(windows, "_w").cast("long"), "delta": pick([float(d) for d in deltas], "_d")})
    best = best.groupBy(*RUN).agg(F.min(F.struct("mismatches", "size", F.col("_d").alias("order"), "delta")).alias("_b"))
    return best.select(*RUN, "_b.size", "_b.delta", "_b.mismatches")
