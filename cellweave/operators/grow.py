"""Significance maps of windows and the growing of significant regions on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PLANE_VALUES = 100_000  # cells of a plane whose features one task handles together


def significance(cells: DataFrame, plane: list[str], features: list[str], maps: Sequence[tuple[int, int]], top: int = 5) -> DataFrame:
    """(plane, window, wx, wy, score, n): how much each window's cells differ from those of its whole plane, for all ``maps`` of (window, stride).

    The score is the sum of the ``top`` largest -ln p of the features' Kolmogorov-Smirnov tests. Windows without cells, or
    whose cells have no value, have no row. A cell is shuffled once with all its values, not once for each of its windows and
    features; in a plane of many cells the features are shared out among tasks, and each task gives its own largest.
    """
    located = cells.where(" AND ".join(f"{c} IS NOT NULL" for c in (*plane, "x", "y")))
    sizes = located.groupBy(*plane).agg(F.count("*").alias("_n")).where(F.col("_n") > PLANE_VALUES)  # at most rows / PLANE_VALUES
    share = F.ceil(F.lit(len(features)) / F.ceil(F.col("_n") / PLANE_VALUES)).cast("int")  # features a task
    values = F.array(*[F.col(f).cast("double") for f in features])
    placed = located.select(*plane, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), values.alias("v")).join(F.broadcast(sizes), plane, "left")
    starts = F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(features) - 1), share))
    parts = placed.select(*plane, "x", "y", "v", F.coalesce(share, F.lit(len(features))).alias("_w"), F.explode(starts).alias("part")).withColumn("v", F.slice("v", F.col("part") + 1, F.col("_w"))).drop("_w")
    kinds = dict(cells.dtypes)

    def score(keys, table):
        import numpy as np
        import pyarrow as pa

        n = len(table)
        v = table.column("v").combine_chunks()
        v = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T)
        x, y = (table.column(c).to_numpy() for c in "xy")
        less, upto, count = plane_ranks(v)
        found = [plane_scores(x, y, less, upto, count, window, stride, top) for window, stride in maps]
        rows = [len(f[0]) for f in found]
        fixed = [pa.array([k.as_py()] * sum(rows), table.schema.field(c).type) for k, c in zip(keys, plane, strict=False)]
        wx, wy, m, best = (np.concatenate([f[i] for f in found]) for i in range(4))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype="int32") * best.shape[1]), pa.array(best.ravel()))
        return pa.table([*fixed, pa.array(np.repeat([w for w, _ in maps], rows).astype("int32")), pa.array(wx), pa.array(wy), pa.array(m), lists], names=out)

    out = [*plane, "window", "wx", "wy", "n", "best"]
    scored = parts.groupBy(*plane, "part").applyInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in plane) + ", window int, wx int, wy int, n long, best array<double>")
    largest = F.slice(F.sort_array(F.filter(F.flatten(F.collect_list("best")), lambda s: s >= 0), asc=False), 1, top)
    merged = scored.groupBy(*plane, "window", "wx", "wy").agg(largest.alias("best"), F.max("n").alias("n")).where(F.size("best") > 0)
    return merged.select(*plane, "window", "wx", "wy", F.aggregate("best", F.lit(0.0), lambda a, b: a + b).alias("score"), "n")


def plane_ranks(v):
    """Of values (features, cells): how many are less than each (cells + 1 for no value), how many are up to it by that number, and how many there are."""
    import numpy as np

    k, n = v.shape
    less, upto, count = np.full((k, n), n + 1, "int64"), np.zeros((k, n + 2), "int64"), np.zeros(k, "int64")
    for f in range(k):
        order = np.argsort(v[f])  # NaN comes last
        m = count[f] = n - int(np.isnan(v[f]).sum())
        if m:
            s = v[f][order[:m]]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            copies = np.diff(np.r_[first, m])
            less[f, order[:m]] = np.repeat(first, copies)
            upto[f, first] = first + copies
    return less, upto, count


def plane_scores(x, y, less, upto, count, window: int, stride: int, top: int, bound: int = 1 << 19):
    """(wx, wy, cells, the ``top`` largest scores or fewer, -1 for none) of every window of one plane that holds cells.

    Windows are handled in runs of about ``bound`` values, whatever the plane's size.
    """
    import numpy as np

    def spans(c):
        return np.maximum(0, np.floor((c - window) / stride).astype("int64") + 1), np.ceil(c / stride).astype("int64") - 1

    (x0, x1), (y0, y1) = spans(x), spans(y)
    reach = -(-window // stride)
    cell, kx, ky = [], [], []
    for i in range(reach):
        for j in range(reach):
            at = np.flatnonzero((x0 + i <= x1) & (y0 + j <= y1))
            cell.append(at.astype("int32"))
            kx.append((x0[at] + i).astype("int32"))
            ky.append((y0[at] + j).astype("int32"))
    cell, kx, ky = (np.concatenate(a) for a in (cell, kx, ky))
    order = np.lexsort((ky, kx))
    cell, kx, ky = cell[order], kx[order], ky[order]
    features, n = len(less), less.shape[1]
    if not len(cell):
        return np.empty(0, "int32"), np.empty(0, "int32"), np.empty(0, "int64"), np.empty((0, min(top, features)))
    first = np.flatnonzero(np.r_[True, (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])])
    ends = np.r_[first[1:], len(cell)]
    cells, best = ends - first, np.empty((len(first), min(top, features)))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + bound // features, "right")))
        size = cells[lo:hi]
        at = first[lo:hi] - first[lo]
        best[lo:hi] = window_scores(cell[first[lo] : ends[hi - 1]], at, size, less, upto, count, top)
        lo = hi
    return kx[first] * np.int32(stride), ky[first] * np.int32(stride), cells, best


def window_scores(cell, at, size, less, upto, count, top: int):
    """The ``top`` largest -ln p of each window: of the cells ``cell`` those from ``at`` on, ``size`` of them."""
    import numpy as np

    features, n = len(less), less.shape[1]
    own = np.repeat(np.arange(len(at)), size)
    base = own * (n + 2)
    r = less[:, cell] + base
    r.sort(axis=1)  # within each window by rank, cells without a value last
    r -= base
    valid = r < n + 1
    na = np.add.reduceat(valid.astype("int64"), at, axis=1)
    before = np.arange(len(cell)) - np.repeat(at, size)
    step = np.ones(r.shape, bool)
    np.not_equal(r[:, 1:], r[:, :-1], out=step[:, 1:])
    step[:, at] = True
    last = np.ones(r.shape, bool)
    last[:, :-1] = step[:, 1:]
    m, nb = np.maximum(na, 1)[:, own], np.maximum(count, 1)[:, None]
    gap = np.abs(before / m - r / nb) * (step & valid)
    after = np.abs((before + 1) / m - np.take_along_axis(upto, r, axis=1) / nb) * (last & valid)
    d = np.maximum.reduceat(np.maximum(gap, after, out=gap), at, axis=1)
    s = np.where(na > 0, minus_log_p(d, np.maximum(na, 1), nb), -1.0)
    s.sort(axis=0)
    return s[::-1][:top].T


def minus_log_p(d, na, nb, terms: int = 100):
    """-ln of ``ecdf.ks_p_value``; terms below 1e-18 of the first one are left out, as they change no digit of the sum."""
    import numpy as np

    e = np.sqrt(na * nb / (na + nb))
    x = ((e + 0.12 + 0.11 / e) * d).ravel()
    at = np.flatnonzero(x >= 0.2)
    z = -2.0 * x[at] ** 2
    p = np.ones(len(x))
    p[at] = 2.0 * np.exp(z)
    for k in range(2, terms + 1):
        some = (k * k - 1) * z > -41.5
        at, z = at[some], z[some]
        if not len(at):
            break
        p[at] += (2.0 if k % 2 else -2.0) * np.exp(k * k * z)
    return -np.log(np.clip(p, 1e-300, 1.0)).reshape(d.shape)


def ks_within(inner: DataFrame, outer: DataFrame, plane: list[str], sub: list[str]) -> DataFrame:
    """(plane, sub, feature, d, na, nb): statistic of each part of a plane against the whole plane.

    The largest gap between the two distributions lies at a value of the part, or just before one, so the whole's ranks are
    needed at the part's values only: one equi-join on the value, since every value of a part is one of the whole.
    """
    from .ecdf import ecdf

    key = [*plane, "feature"]
    part = ecdf(inner, [*plane, *sub, "feature"]).select(*plane, *sub, "feature", "v", F.col("less").alias("al"), F.col("copies").alias("ac"), F.col("n").alias("na"))
    whole = ecdf(outer, key).select(*key, "v", F.col("less").alias("bl"), F.col("copies").alias("bc"), F.col("n").alias("nb"))
    both = part.join(whole, [*key, "v"])
    before = F.abs(F.col("al") / F.col("na") - F.col("bl") / F.col("nb"))
    after = F.abs((F.col("al") + F.col("ac")) / F.col("na") - (F.col("bl") + F.col("bc")) / F.col("nb"))
    return both.groupBy(*plane, *sub, "feature").agg(F.max(F.greatest(before, after)).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def grow(scores: DataFrame, plane: list[str], stride: int | Column, share: float = 0.5) -> DataFrame:
    """(plane, wx, wy, region): regions of neighbouring windows that score at least ``share`` of their seed's score.

    In every plane, seeds are the windows of highest score among their eight neighbours; all regions of a plane grow
    together, one ring of neighbours a round until no window is left to take, and a window goes to the seed of highest score
    that reaches it first. A plane's windows, which are fewer than its cells, are grown in one task; nothing is staged.
    """
    located = scores.where(" AND ".join(f"{c} IS NOT NULL" for c in plane)).select(*plane, "wx", "wy", "score", (F.lit(stride) if isinstance(stride, int) else stride).alias("_stride"))
    kinds = dict(located.dtypes)

    def regions(keys, table):
        import numpy as np
        import pyarrow as pa

        wx, wy, score, step = (table.column(c).to_numpy() for c in ("wx", "wy", "score", "_stride"))
        at, seed = grown(wx, wy, score, int(step[0]), share)
        fixed = [pa.array([k.as_py()] * len(at), table.schema.field(c).type) for k, c in zip(keys, plane, strict=True)]
        names, of = np.unique(seed, return_inverse=True)
        named = pa.array([f"{wx[k]}_{wy[k]}" for k in names], "string").take(pa.array(of))
        return pa.table([*fixed, pa.array(wx[at]), pa.array(wy[at]), named], names=[*plane, "wx", "wy", "region"])

    return located.groupBy(*plane).applyInArrow(regions, ", ".join(f"{c} {kinds[c]}" for c in (*plane, "wx", "wy")) + ", region string")


def grown(wx, wy, score, stride: int, share: float):
    """(window, seed): which windows are taken, and by which seed, as positions in one plane's windows."""
    import numpy as np

    n = len(score)
    order = np.lexsort((wy, wx, score))
    rank = np.empty(n, "int64")
    rank[order] = np.arange(n)  # by score, then by place
    wide = int(wy.max()) - int(wy.min()) + 2 * stride + 1
    key = (wx.astype("int64") - int(wx.min())) * wide + (wy.astype("int64") - int(wy.min())) + stride
    by = np.argsort(key)
    keys = key[by]
    near = np.full((n, 8), -1, "int64")
    for k, (i, j) in enumerate((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)):
        want = key + (i * wide + j) * stride
        at = np.minimum(np.searchsorted(keys, want), n - 1)
        near[:, k] = np.where(keys[at] == want, by[at], -1)
    around = np.where(near >= 0, rank[near], -1).max(axis=1)
    edge = np.flatnonzero((score > 0) & (rank > around))
    seed = np.full(n, -1, "int64")  # rank of each window's seed
    seed[edge] = rank[edge]
    claim = np.full(n, -1, "int64")
    while len(edge):
        to, by_seed = near[edge], np.repeat(seed[edge][:, None], 8, axis=1)
        can = (to >= 0) & (seed[to] < 0)
        to, by_seed = to[can], by_seed[can]
        can = score[to] >= share * score[order[by_seed]]
        to, by_seed = to[can], by_seed[can]
        np.maximum.at(claim, to, by_seed)
        edge = np.unique(to)
        seed[edge] = claim[edge]
    at = np.flatnonzero(seed >= 0)
    return at, order[seed[at]]


def mark_cells(cells: DataFrame, ranges: DataFrame, features: list[str]) -> DataFrame:
    """(columns of cells, marks): which of the named open value ranges (feature, low, high, mark) each cell falls into.

    Ranges are a short table; Spark broadcasts them by their size as one row.
    """
    listed = ranges.agg(F.collect_list(F.struct("feature", "low", "high", "mark")).alias("_ranges"))
    value = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))
    hits = F.filter("_ranges", lambda r: (F.element_at(F.col("_values"), r.feature) > r.low) & (F.element_at(F.col("_values"), r.feature) < r.high))
    return cells.withColumn("_values", value).join(F.broadcast(listed), how="cross").withColumn("marks", F.transform(hits, lambda r: r.mark)).drop("_ranges", "_values")  # listed is one row
