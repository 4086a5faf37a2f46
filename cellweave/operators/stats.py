"""Statistics over groups and sequences."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, code: list[str], rare: int = 0) -> DataFrame:
    """Shannon entropy, in nats, of the code columns; codes seen at most ``rare`` times are one code."""
    counts = df.groupBy(*code).agg(F.count("*").alias("_c")).select("_c", (F.col("_c") <= rare).alias("_r"))
    parts = counts.agg(F.sum("_c").alias("n"), F.sum(F.when(~F.col("_r"), F.col("_c") * F.ln("_c")).otherwise(0.0)).alias("clogc"), F.coalesce(F.sum(F.when(F.col("_r"), F.col("_c"))), F.lit(0)).alias("rare"))
    total = F.col("clogc") + F.when(F.col("rare") > 0, F.col("rare") * F.ln(F.greatest(F.lit(1), F.col("rare")))).otherwise(0.0)
    return parts.select("n", (F.ln("n") - total / F.col("n")).alias("entropy"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n): equal bins over [low, high); values outside fall into bins 0 and bins + 1."""
    return df.groupBy(*keys, F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, keys: list[str], label: str, background=None) -> DataFrame:
    """(keys, label, n): the commonest label, without the background one; ties go to the smaller label."""
    kept = df.where(F.col(label).isNotNull()) if background is None else df.where(F.col(label).isNotNull() & (F.col(label) != background))
    counts = kept.groupBy(*keys, label).agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(most, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(label).alias(label))


def gap_split(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, cut): the value before the largest gap between neighbouring distinct values (the first of equal gaps)."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(value)
    gaps = distinct.withColumn("_next", F.lead(value).over(w)).where("_next IS NOT NULL").withColumn("_gap", F.col("_next") - F.col(value))
    return gaps.groupBy(*keys).agg(F.max_by(value, F.struct("_gap", (-F.col(value)).alias("o"))).alias("cut"), F.max("_gap").alias("gap"))


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(positives, negatives, auc, accuracy): area under the ROC curve with ties counted half, and accuracy at margin 0.

    Scores are counted by distinct value and ranked by a running total over a range partitioning.
    """
    from .ranking import global_prefix

    kept = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(label).cast("int").alias("l"), F.col(score).cast("double").alias("s"))
    counts = kept.groupBy("s").agg(F.sum(F.when(F.col("l") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("l") == 1, 0).otherwise(1)).alias("q"))
    placed = global_prefix(counts, ["s"], "q", "below")
    sums = placed.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum(F.when(F.col("s") > 0, F.col("p")).otherwise(F.col("q"))).alias("right"))
    return sums.select("positives", "negatives", F.try_divide("u", F.col("positives") * F.col("negatives")).alias("auc"), F.try_divide("right", F.col("positives") + F.col("negatives")).alias("accuracy"))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.05, warm: int = 10) -> DataFrame:
    """(keys, order, ema): exponential moving average in ``order``, begun with the mean of the first ``warm`` values.

    Sequences are cut into blocks so long that what lies more than one block back weighs less than a double resolves
    (about 41 / alpha values). A block is folded on its own and starts from what the two before it leave over, so no task
    holds a whole sequence. Null values must be left out before.
    """
    from .ranking import global_prefix

    keep = 1.0 - alpha
    block = math.ceil(41.5 / -math.log(keep))
    at = global_prefix(df.select(*keys, *order, F.col(value).cast("double").alias("_x")), [*keys, *order], F.lit(1), "_at")
    first = at.groupBy(*keys).agg(F.min("_at").alias("_first"))
    placed = at.join(first, keys).withColumn("_i", F.col("_at") - F.col("_first"))
    start = placed.where(F.col("_i") < warm).groupBy(*keys).agg(F.avg("_x").alias("_warm"))
    blocks = placed.groupBy(*keys, F.floor(F.col("_i") / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", "_x", *order))).alias("_s"))  # at most ``block`` each
    fold = F.aggregate("_s", F.lit(0.0), lambda s, e: s * keep + e["_x"] * alpha)
    w = Window.partitionBy(*keys).orderBy("_b")
    left = blocks.withColumn("_f", fold).withColumn("_f1", F.lag("_f", 1).over(w)).withColumn("_f2", F.lag("_f", 2).over(w)).join(start, keys)
    base = F.when(F.col("_b") == 0, F.col("_warm")).otherwise(F.col("_f1") + keep**block * F.coalesce("_f2", "_warm"))
    steps = F.aggregate(
        "_s",
        F.struct(base.alias("m"), F.array().cast("array<double>").alias("out")),
        lambda a, e: F.struct((a.m * keep + e["_x"] * alpha).alias("m"), F.concat(a.out, F.array(a.m * keep + e["_x"] * alpha)).alias("out")),
    )
    return left.withColumn("_o", steps.out).select(*keys, F.explode(F.arrays_zip("_s", "_o")).alias("_z")).select(*keys, *[F.col(f"_z._s.{c}").alias(c) for c in order], F.col("_z._o").alias("ema"))


def half_width(curve: DataFrame, keys: list[str], position: str, score: str) -> DataFrame:
    """(keys, peak, width): where a curve is highest (the first of equal peaks) and how far apart the points nearest to half its height lie on its two sides."""
    top = curve.groupBy(*keys).agg(F.max_by(F.struct(F.col(position).alias("p"), F.col(score).alias("s")), F.struct(F.col(score), (-F.col(position)).alias("o"))).alias("_t"))
    at = curve.join(top, keys)
    off = F.abs(F.col(score) - F.col("_t.s") / 2)
    side = lambda ok, o: F.min_by(F.when(ok, F.col(position)), F.when(ok, F.struct(off.alias("d"), o.alias("o"))))
    left, right = F.col(position) <= F.col("_t.p"), F.col(position) >= F.col("_t.p")
    return at.groupBy(*keys, F.col("_t.p").alias("peak")).agg((side(right, F.col(position)) - side(left, -F.col(position))).alias("width"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, d: s + d)


def hamming_neighbours(codes: DataFrame, code: str, length: int) -> DataFrame:
    """(a, b): pairs of distinct codes (arrays of ``length``) that differ in exactly one place, a < b.

    Every code is written once for each place with that place left out; codes that meet there differ in it alone, so the
    join is on equal keys.
    """
    distinct = codes.select(code).where(F.col(code).isNotNull()).distinct()
    holes = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.col(code)[j] for j in range(length) if j != i]).alias("rest")) for i in range(length)])
    masked = distinct.select(code, F.explode(holes).alias("h")).select(code, "h.i", "h.rest")
    return masked.select(F.col(code).alias("a"), "i", "rest").join(masked.select(F.col(code).alias("b"), "i", "rest"), ["i", "rest"]).where("a < b").select("a", "b")


def top_by_group(df: DataFrame, group: Column, value: str, k: int) -> DataFrame:
    """(name, total): the k groups of largest total; ties by name."""
    return df.groupBy(group.alias("name")).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), "name").limit(k)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def autocorrelation(df: DataFrame, keys: list[str], position: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, r, n): correlation of the standardised value with itself ``lag`` positions on, over the pairs that exist.

    Every value is written once for each lag and met by an equi-join on its position.
    """
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(position).alias("_p"), F.col(value).cast("double").alias("_v"))
    norm = base.groupBy(*keys).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_d"))
    z = base.join(norm, keys).where("_d > 0").select(*keys, "_p", ((F.col("_v") - F.col("_m")) / F.col("_d")).alias("_z"))
    ahead = z.select(*keys, F.col("_z").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "_p").select(*keys, "_y", "lag", (F.col("_p") - F.col("lag")).alias("_p"))
    return z.join(ahead, [*keys, "_p"]).groupBy(*keys, "lag").agg(F.avg(F.col("_z") * F.col("_y")).alias("r"), F.count("*").alias("n"))


def autocorrelation_volume(df: DataFrame, keys: list[str], axes: list[str], value: str, reach: list[tuple[int, int]]) -> DataFrame:
    """(keys, d<axis> …, r, n): correlation of the standardised value with itself at every shift within ``reach`` (low, high) of each axis.

    Every value is written once for each shift and met by an equi-join on its place.
    """
    base = df.where(F.col(value).isNotNull()).select(*keys, *axes, F.col(value).cast("double").alias("_v"))
    norm = base.groupBy(*keys).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_d"))
    z = base.join(norm, keys).where("_d > 0").select(*keys, *axes, ((F.col("_v") - F.col("_m")) / F.col("_d")).alias("_z"))
    ahead = z.select(*keys, *axes, F.col("_z").alias("_y"))
    for a, (low, high) in zip(axes, reach, strict=True):
        ahead = ahead.withColumn(f"d{a}", F.explode(F.sequence(F.lit(low), F.lit(high))))
    moved = ahead.select(*keys, "_y", *[f"d{a}" for a in axes], *[(F.col(a) - F.col(f"d{a}")).alias(a) for a in axes])
    return z.join(moved, [*keys, *axes]).groupBy(*keys, *[f"d{a}" for a in axes]).agg(F.avg(F.col("_z") * F.col("_y")).alias("r"), F.count("*").alias("n"))
