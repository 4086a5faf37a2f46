"""Global running totals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def global_prefix(df: DataFrame, order: list[str], value: str | Column, out: str = "start", more: dict[str, str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come earlier in ``order``, and in the same pass those of ``more`` (out: value).

    Rows are range-partitioned by ``order``; each task sums its own range, and only one total per partition (a bounded
    table) is accumulated globally. ``order`` should be unique; tied rows get an arbitrary but fixed order within their
    range. Nulls in ``value`` count as 0; an empty table gives an empty result.
    """
    value = F.col(value) if isinstance(value, str) else value
    sums = {out: value} | {k: F.col(v) for k, v in (more or {}).items()}
    held = [F.coalesce(v, F.lit(0)).cast("long").alias(f"_v{i}") for i, v in enumerate(sums.values())]
    ranged = stage(df.select("*", *held).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "_pid")  # one row per partition of the range shuffle
    running = {k: F.col(f"_base{i}") + F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i, k in enumerate(sums)}
    return placed.withColumns(running).drop("_pid", *[f"_{c}{i}" for i in range(len(sums)) for c in ("v", "base")])
