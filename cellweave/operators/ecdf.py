"""Empirical distributions of groups: values, lookups at thresholds, nearest-rank quantiles, region vectors.

The empirical distribution of n sorted values gives the i-th one (from 0) the height i / n. Groups are handled as counts of
distinct values and bounded tables of buckets, so a group that holds a third of all rows is no single task's work. Null and
NaN are no values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_prefix


def melt(df: DataFrame, keys: list[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, v): one row per value; ``feature`` is the position in ``features``."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))
    return df.select(*keys, values.alias("_e")).select(*keys, "_e.feature", "_e.v").where("v IS NOT NULL AND NOT isnan(v)")


def counted(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys, "v").agg(F.count("*").alias("copies"))


def ecdf(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, copies, less, n): every distinct value with how many are equal and how many are less, of n.

    Ranks come from one range-partitioned running total over all groups, from which the group's own start is taken off.
    """
    placed = global_prefix(counted(values, keys), [*keys, "v"], "copies", "_at")
    ends = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.sum("copies").alias("n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "n")
    condition = F.lit(True)
    for i, k in enumerate(keys):  # null keys are groups of their own
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(ends, condition).select(*keys, "v", "copies", (F.col("_at") - F.col("_first")).alias("less"), "n")


def nearest_rank(n: Column, q: Column) -> Column:
    """The row i of n whose height i / n is nearest to q; of two equally near the lower one."""
    about = F.floor(q * n)
    rows = F.filter(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: (about + k).cast("long")), lambda i: (i >= 0) & (i < n))
    return F.array_min(F.transform(F.when(F.size(rows) > 0, rows).otherwise(F.array(n - 1)), lambda i: F.struct(F.abs(i / n - q).alias("d"), i.alias("i"))))["i"]


def quantiles(values: DataFrame, keys: list[str], levels: Sequence[float]) -> DataFrame:
    """(keys, j, v): the value at the nearest height for every level; no interpolation."""
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(q)).alias("q")) for j, q in enumerate(levels)])
    close = lambda e: (e.q * F.col("n") >= F.col("less") - 2) & (e.q * F.col("n") <= F.col("less") + F.col("copies") + 1)  # noqa: E731  # few levels are near a value
    mine = F.filter(F.filter(each, close), lambda e: (nearest_rank(F.col("n"), e.q) >= F.col("less")) & (nearest_rank(F.col("n"), e.q) < F.col("less") + F.col("copies")))
    return ecdf(values, keys).select(*keys, "v", F.explode(mine).alias("_e")).select(*keys, F.col("_e.j").alias("j"), "v")


def at_thresholds(values: DataFrame, keys: list[str], thresholds: DataFrame) -> DataFrame:
    """(keys, feature, j, y): height of the distribution at the value nearest to each threshold (of two, the smaller value).

    ``keys`` must not include ``feature``; ``thresholds`` holds (feature, ts: sorted array), a handful of rows. Values fall
    into the buckets between thresholds; a bucket keeps its count and its outermost values, which is all a lookup needs.
    """
    group = [*keys, "feature"]
    placed = counted(values, group).join(thresholds, "feature").withColumn("b", F.size(F.filter("ts", lambda t: t < F.col("v"))))  # v in (ts[b-1], ts[b]]
    buckets = placed.groupBy(*group, "b").agg(F.sum("copies").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max_by("copies", "v").alias("hi_copies"))
    listed = buckets.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("b", "c", "lo", "hi", "hi_copies"))).alias("bs"), F.sum("c").alias("n")).join(thresholds, "feature")
    upto = lambda j: F.filter("bs", lambda x: x.b <= j)
    over = lambda j: F.filter("bs", lambda x: x.b > j)
    looked = listed.select(*group, "n", "bs", F.posexplode("ts").alias("j", "t"))
    looked = looked.select(*group, "n", "j", "t", upto(F.col("j")).alias("below"), over(F.col("j")).alias("above"))
    count = F.aggregate("below", F.lit(0).cast("long"), lambda s, x: s + x.c)
    last = F.try_element_at("below", F.lit(-1))
    first = F.try_element_at("above", F.lit(1))
    low = last.hi.isNotNull() & (first.lo.isNull() | (F.abs(last.hi - F.col("t")) <= F.abs(first.lo - F.col("t"))))
    return looked.select(*group, "j", (F.when(low, count - last.hi_copies).otherwise(count) / F.col("n")).alias("y"))


def region_vector(df: DataFrame, keys: list[str], features: Sequence[str], thresholds: DataFrame, area: float) -> DataFrame:
    """(keys, vector): heights at all thresholds of all features, then cells per 224 x 224 pixels of ``area``, then the share of it that cells cover.

    Features without a value in a region have zeros.
    """
    heights = at_thresholds(melt(df, keys, features), keys, thresholds)
    by_feature = heights.groupBy(*keys, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda e: e.y).alias("ys"))
    vectors = by_feature.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "ys"))).alias("m"))
    totals = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("area").alias("cover"))
    size = F.element_at(F.map_from_entries(F.collect_list(F.struct("feature", F.size("ts")))), F.lit(0))
    width = thresholds.agg(size.alias("width"))
    zeros = F.array_repeat(F.lit(0.0), F.col("width"))
    parts = [F.coalesce(F.try_element_at("m", F.lit(i)), zeros) for i in range(len(features))]
    tail = F.array(F.col("n") * (224.0 * 224.0) / area, F.coalesce("cover", F.lit(0)) / F.lit(float(area)))
    return totals.join(vectors, keys, "left").join(F.broadcast(width), how="cross").select(*keys, F.concat(*parts, tail).alias("vector"))  # width is one row


def thinned(heights: DataFrame, most: int = 10_000) -> DataFrame:
    """Every k-th row of each group's distribution, k = int(n / most) or 1: at most 2 ``most`` rows are left of a group."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return heights.where(F.ceil(F.col("less") / k) * k < F.col("less") + F.col("copies"))


def merged_heights(a: DataFrame, b: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, v, y): the mean height of two distributions at every value of the first; the second's is that of its nearest value.

    Both are thinned to a bounded number of rows a group, as the merge is defined, before the window that pairs them.
    """
    left, right = thinned(ecdf(a, keys), most), thinned(ecdf(b, keys), most)
    own = left.select(*keys, "v", (F.col("less") / F.col("n")).alias("ya"))
    tagged = own.select(*keys, "v", "ya", F.lit(None).cast("double").alias("vb"), F.lit(None).cast("double").alias("yb")).unionByName(
        right.select(*keys, "v", F.lit(None).cast("double").alias("ya"), F.col("v").alias("vb"), (F.col("less") / F.col("n")).alias("yb"))
    )
    w = Window.partitionBy(*keys).orderBy("v")
    back = F.last(F.when(F.col("vb").isNotNull(), F.struct("vb", "yb")), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(F.col("vb").isNotNull(), F.struct("vb", "yb")), ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = tagged.withColumn("p", back).withColumn("q", ahead).where("ya IS NOT NULL")
    low = F.col("p").isNotNull() & (F.col("q").isNull() | (F.col("v") - F.col("p.vb") <= F.col("q.vb") - F.col("v")))
    return both.select(*keys, "v", ((F.col("ya") + F.when(low, F.col("p.yb")).otherwise(F.col("q.yb"))) / 2).alias("y"))


def ks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d, na, nb): two-sample Kolmogorov-Smirnov statistic of groups that both samples have.

    Values of both are counted together and run through one range-partitioned total; no group is one task's sort.
    """
    both = a.select(*keys, "v", F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(b.select(*keys, "v", F.lit(0).alias("ia"), F.lit(1).alias("ib")))
    steps = both.groupBy(*keys, "v").agg(F.sum("ia").alias("ca"), F.sum("ib").alias("cb"))
    sizes = steps.groupBy(*keys).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb")).where("na > 0 AND nb > 0")
    at = global_prefix(steps, [*keys, "v"], "ca", "pa", {"pb": "cb"})
    base = at.groupBy(*keys).agg(F.min("pa").alias("ba"), F.min("pb").alias("bb"))
    height = lambda p, b, c, n: (F.col(p) - F.col(b) + F.col(c)) / F.col(n)
    gap = F.abs(height("pa", "ba", "ca", "na") - height("pb", "bb", "cb", "nb"))
    return at.join(base, keys).join(sizes, keys).groupBy(*keys, "na", "nb").agg(F.max(gap).alias("d")).select(*keys, "d", "na", "nb")


def ks_p_value(d: Column, na: Column, nb: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the statistic, kept at 1e-300 or more so that its logarithm is finite."""
    e = F.sqrt(na * nb / (na + nb))
    x = (e + 0.12 + 0.11 / e) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), F.when(x < 0.2, F.lit(1.0)).otherwise(series)))


def ks_combined(tests: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """(keys, product, total, top, largest) of the features' statistics (keys, feature, d, na, nb): the product of 1 - p, the sum of -ln p, that of the ``top`` largest -ln p, and the largest d."""
    p = tests.withColumn("_p", ks_p_value(F.col("d"), F.col("na"), F.col("nb"))).withColumn("_s", -F.ln("_p"))
    best = F.aggregate(F.slice(F.sort_array(F.collect_list("_s"), asc=False), 1, top), F.lit(0.0), lambda a, b: a + b)
    return p.groupBy(*keys).agg(F.product(1 - F.col("_p")).alias("product"), F.sum("_s").alias("total"), best.alias("top"), F.max("d").alias("largest"))


def ks_normal(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d, n): one-sample statistic of each group against the normal distribution of its own mean and deviation; groups without spread have none."""
    fit = values.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    at = ecdf(values, keys).join(fit, keys).where("_s > 0").withColumn("_c", normal_cdf((F.col("v") - F.col("_m")) / F.col("_s")))
    gap = F.greatest(F.abs(F.col("less") / F.col("n") - F.col("_c")), F.abs((F.col("less") + F.col("copies")) / F.col("n") - F.col("_c")))
    return at.groupBy(*keys).agg(F.max(gap).alias("d"), F.first("n").alias("n"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the fifth-degree approximation of Abramowitz and Stegun (26.2.17, error below 7.5e-8)."""
    # Its coefficients.
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def interpolated_heights(a: DataFrame, b: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(keys, v, y): like ``merged_heights``, with the second distribution's height interpolated between its neighbours of ``v``.

    Beyond the second's values its end heights count.
    """
    left, right = thinned(ecdf(a, keys), most), thinned(ecdf(b, keys), most)
    tagged = left.select(*keys, "v", (F.col("less") / F.col("n")).alias("ya"), F.lit(None).cast("double").alias("yb")).unionByName(
        right.select(*keys, "v", F.lit(None).cast("double").alias("ya"), (F.col("less") / F.col("n")).alias("yb"))
    )
    w = Window.partitionBy(*keys).orderBy("v")  # at most 2 ``most`` rows of each side
    point = F.when(F.col("yb").isNotNull(), F.struct(F.col("v").alias("x"), F.col("yb").alias("h")))
    p, q = F.last(point, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(point, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = tagged.withColumn("_p", p).withColumn("_q", q).where("ya IS NOT NULL AND (_p IS NOT NULL OR _q IS NOT NULL)")
    share = F.coalesce((F.col("v") - F.col("_p.x")) / F.nullif(F.col("_q.x") - F.col("_p.x"), F.lit(0.0)), F.lit(0.0))
    height = F.when(F.col("_p").isNull(), F.col("_q.h")).when(F.col("_q").isNull(), F.col("_p.h")).otherwise(F.col("_p.h") + share * (F.col("_q.h") - F.col("_p.h")))
    return both.select(*keys, "v", ((F.col("ya") + height) / 2).alias("y"))
