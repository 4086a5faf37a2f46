"""Selections and derived columns of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(df: DataFrame, left: float, right: float, up: float, down: float) -> DataFrame:
    """Rows inside the closed box; both comparisons reach the Parquet scan."""
    return df.where(F.col("x").between(left, right) & F.col("y").between(up, down))


def sections(df: DataFrame, first: int, count: int) -> DataFrame:
    """Rows of ``count`` sections from ``first`` on."""
    return df.where(F.col("section").between(first, first + count - 1))


def centroid(left: Column, top: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(x, y) of a bounding box's middle, cut to whole pixels towards zero."""
    return (left + width / 2).cast("int"), (top + height / 2).cast("int")


def size_class(size: Column, classes: Sequence[int] = (15, 51, 201)) -> Column:
    """The first class strictly above ``size``; null where there is none."""
    out = None
    for c in classes:
        out = F.when(size < c, F.lit(c)) if out is None else out.when(size < c, F.lit(c))
    return out


def touches_edge(left: Column, top: Column, width: Column, height: Column, w: int, h: int) -> Column:
    """Whether a bounding box touches the border of its tile."""
    return (left == 0) | (top == 0) | (left + width == w) | (top + height == h)


def affine(vector: Sequence[str], size: str, df: DataFrame, maps: DataFrame) -> DataFrame:
    """``v M + mu`` with the map (size, m: array of rows, mu) of the row's size class; rows without a map keep their vector.

    The maps are one row per size class; Spark broadcasts them by their size.
    """
    v = F.array(*[F.col(c).cast("double") for c in vector])
    joined = df.withColumn("_v", v).join(maps.select(F.col("size").alias("_size"), "m", "mu"), F.col(size) == F.col("_size"), "left")

    def column(j: int) -> Column:
        dot = F.aggregate(F.zip_with("_v", "m", lambda a, row: a * row[j]), F.lit(0.0), lambda s, t: s + t)
        return F.when(F.col("m").isNull(), F.col(vector[j])).otherwise(dot + F.col("mu")[j]).alias(vector[j])

    return joined.select(*[c for c in df.columns if c not in vector], *[column(j) for j in range(len(vector))])


def rescale(df: DataFrame, keys: list[str], value: str, scale: float, offset: float, out: str) -> DataFrame:
    """Min-max rescaling of ``value`` within its group to [offset, offset + scale]; a constant group gets ``offset``.

    Group extremes come from a hash aggregate, so that a hot group is combined in the map tasks.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    return df.join(ends, keys).withColumn(out, F.coalesce(share, F.lit(0.0)) * scale + offset).drop("_lo", "_hi")


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def colour_class(size: Column, rotation: Column, third: Column) -> Column:
    """Class of a cell by size, quadrant of its rotation and third shape coordinate."""
    turned = ((rotation >= -90) & (rotation < 0)) | (rotation > 90)
    side = F.when(turned, 1).otherwise(0)
    return F.when(size == 15, F.lit(0)).when(size == 51, F.lit(1) + side).when(third > -1.8, F.lit(3) + side).otherwise(F.lit(5) + side)


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``: later layers override earlier ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
