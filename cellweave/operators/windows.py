"""Sliding windows over a plane: points are sent to their windows by arithmetic, without a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(value: Column, window: int, stride: int, origin: Column | float = 0) -> Column:
    """Starts of the windows (start, start + window), open at both ends, that hold ``value``; starts begin at ``origin``."""
    last = F.ceil((value - origin) / stride) - 1  # the largest k with start < value
    first = F.greatest(F.lit(0), F.floor((value - origin - window) / stride) + 1)  # the least k with start + window > value
    return F.when(last >= first, F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda k: (k * stride + origin).cast("int"))).otherwise(F.array().cast("array<int>"))


def assign(df: DataFrame, window: int, stride: int, x: str = "x", y: str = "y") -> DataFrame:
    """Add (wx, wy): one row for every window of the grid from 0 that strictly contains the point."""
    return df.withColumn("wx", F.explode(starts(F.col(x), window, stride))).withColumn("wy", F.explode(starts(F.col(y), window, stride)))


def grid(bounds: DataFrame, step: int) -> DataFrame:
    """Grid points (gx, gy) of every row's closed-open box (left, right, up, down)."""
    axis = lambda a, b: F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return bounds.withColumn("gx", F.explode(axis("left", "right"))).withColumn("gy", F.explode(axis("up", "down")))


def tiles(sizes: DataFrame, step: int) -> DataFrame:
    """Tiles (tile_x, tile_y, w, h) that cover an image of (width, height); those at the edge are smaller."""
    out = sizes.withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step)))).withColumn("tile_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))))
    return out.withColumn("w", F.least(F.lit(step), F.col("width") - F.col("tile_x"))).withColumn("h", F.least(F.lit(step), F.col("height") - F.col("tile_y")))


def merge_max_abs(df: DataFrame, keys: list[str], score: str, ties: str = "keep") -> DataFrame:
    """Per key the score of largest magnitude. Opposite scores of equal magnitude: ``keep`` the larger one or give ``zero``."""
    size = F.abs(F.col(score))
    merged = df.groupBy(*keys).agg(F.max_by(score, F.struct(size, F.col(score))).alias("_top"), F.max_by(score, F.struct(size, -F.col(score))).alias("_low"))
    value = F.col("_top") if ties == "keep" else F.when(F.col("_top") == F.col("_low"), F.col("_top")).otherwise(F.lit(0).cast(dict(df.dtypes)[score]))
    return merged.select(*keys, value.alias(score))


def block_mean(df: DataFrame, keys: list[str], block: int, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Down-sampling: the mean of ``value`` in blocks of ``block`` by ``block`` pixels."""
    return df.groupBy(*keys, F.floor(F.col(x) / block).cast("int").alias("bx"), F.floor(F.col(y) / block).cast("int").alias("by")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))


def owners(points: DataFrame, point_id: str, window: int, stride: int) -> DataFrame:
    """(point_id, wx, wy): of the windows that hold a point the one whose middle is nearest; ties go to the lower start."""
    far = (F.col("x") - F.col("wx") - window / 2) ** 2 + (F.col("y") - F.col("wy") - window / 2) ** 2
    placed = assign(points.select(point_id, "x", "y"), window, stride)
    return placed.groupBy(point_id).agg(F.min(F.struct(far.alias("d"), "wx", "wy")).alias("o")).select(point_id, "o.wx", "o.wy")


def canvas(df: DataFrame, keys: list[str], x: str, y: str, side: int) -> DataFrame:
    """Rows with (cx, cy): pixel of a ``side`` x ``side`` canvas on which the group's values are spread from edge to edge."""
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.coalesce(F.floor((F.col(c) - F.col(f"_lo{c}")) / F.nullif(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(0)) * (side - 1)), F.lit(0)).cast("int")
    return df.join(ends, keys).withColumn("cx", at(x)).withColumn("cy", at(y)).drop(*[f"_{n}{c}" for c in (x, y) for n in ("lo", "hi")])
