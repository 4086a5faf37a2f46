"""Percentiles with bounded relative error, from mergeable signed logarithmic buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OFFSET = 1 << 21  # beyond any bucket index of a double at the least allowed error


def _gamma(error: float) -> float:
    if not 0.001 <= error < 1:
        raise ValueError("the relative error must be at least 0.001 and below 1")
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float) -> Column:
    """Signed bucket: order of buckets is order of values; 0 holds zero, and infinities have the outermost buckets."""
    size = F.abs(value)
    code = F.when(size == float("inf"), F.lit(2 * _OFFSET)).otherwise(F.ceil(F.ln(size) / F.lit(math.log(_gamma(error)))) + _OFFSET)
    return F.when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code).cast("long")


def value_of(bucket: Column, error: float) -> Column:
    g = _gamma(error)
    size = F.when(F.abs(bucket) == 2 * _OFFSET, F.lit(float("inf"))).otherwise(F.pow(F.lit(g), F.abs(bucket) - _OFFSET) * (2 / (1 + g)))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, keys: list[str | Column], fields: list[str], error: float = 0.01) -> DataFrame:
    """(keys, field, bucket, n): how many values of each field fall into each bucket. Null and NaN are no values.

    Counts are combined in the map tasks, and the shuffle is by key and bucket, so a group that holds a third of all rows
    is spread over its buckets. The number of buckets of a group is bounded by the range of doubles, not by its rows.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("_e")
    return (
        df.select(*keys, values)
        .where("_e.v IS NOT NULL AND NOT isnan(_e.v)")
        .select(*[_name(df, k) for k in keys], F.col("_e.field").alias("field"), bucket_of(F.col("_e.v"), error).alias("bucket"))
        .groupBy(*[_name(df, k) for k in keys], "field", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _name(df: DataFrame, key: str | Column) -> str:
    return key if isinstance(key, str) else df.select(key).columns[0]


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Add matching bucket counts: the sketch of the union of what the sketches were made of."""
    return sketches.groupBy(*keys, "field", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float], error: float = 0.01, merged: bool = False) -> DataFrame:
    """(keys, field, n, one column per rank) of sketches, which are merged first unless they are ``merged`` already.

    Counts are combined in the map tasks and by bucket before the buckets of a group, as many as its range needs, meet.

    A percentile q is the value of rank ``max(1, ceil(q n))``, answered with a relative error of at most ``error`` of that
    value; zero and the infinities are exact. Null keys are groups of their own. A group without values has no row; an
    empty table gives none.
    """
    group = Window.partitionBy(*keys, "field")
    ordered = group.orderBy("bucket")
    upto = (sketches if merged else merge(sketches, keys)).withColumn("_c", F.sum("n").over(ordered)).withColumn("_t", F.sum("n").over(group))
    found = [
        F.min(F.when(F.col("_c") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_t"))), F.col("bucket"))).alias(name) for name, q in ranks.items()
    ]
    return upto.groupBy(*keys, "field").agg(F.max("_t").alias("n"), *found).select(*keys, "field", "n", *[value_of(F.col(r), error).alias(r) for r in ranks])
