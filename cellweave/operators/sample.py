"""Deterministic samples, splits and shuffles; the order of rows is that of a seeded hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_prefix


def order_key(key: str, seed: int = 0) -> Column:
    """A position in [0, 2^31 - 1) for an integer key, by multiplication; other engines can repeat it."""
    return F.pmod(F.col(key).cast("decimal(38,0)") * 48271 + seed * 69621 + 12345, F.lit(2147483647)).cast("long")


def per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, the first in hash order; groups are cut down in the map tasks already."""
    w = Window.partitionBy(*groups).orderBy(order_key(key, seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def ranked(df: DataFrame, source: str, key: str, seed: int = 0) -> DataFrame:
    """Add rn (from 1): the row's place in its source, in hash order, without a task holding a whole source."""
    at = global_prefix(df.withColumn("_h", order_key(key, seed)), [source, "_h", key], F.lit(1), "_at")
    first = at.groupBy(source).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    return at.join(first, source).withColumn("rn", F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_h")


def stratified_files(df: DataFrame, source: str, key: str, files: int, rows: int) -> DataFrame:
    """Rows with ``file``: every file takes ``int(n_source / n_all * rows)`` rows of each source, the next ones in hash order.

    Rows beyond the files' shares are left out, as the operator's definition has it; a source too short fills fewer files.
    """
    placed = ranked(df, source, key)
    total = df.groupBy(source).agg(F.count("*").alias("_c")).agg(F.sum("_c")).first()[0] or 1
    share = F.floor(F.col("_n") / F.lit(float(total)) * rows).cast("long")
    return placed.withColumn("_s", share).where("_s > 0").withColumn("file", F.floor((F.col("rn") - 1) / F.col("_s")).cast("int")).where(F.col("file") < files).drop("_n", "_s", "rn")


def permute(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows with ``pos``, their place (from 0) in an order that depends on the seed only, and sorted by it within range partitions."""
    placed = global_prefix(df.withColumn("_h", order_key(key, seed)), ["_h", key], F.lit(1), "pos")
    return placed.repartitionByRange("pos").sortWithinPartitions("pos").drop("_h")


def every_kth(df: DataFrame, source: str, key: str, most: int) -> DataFrame:
    """Every k-th row of a source in key order, k = max(1, int(n / most))."""
    at = global_prefix(df, [source, key], F.lit(1), "_at")
    first = at.groupBy(source).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return at.join(first, source).where((F.col("_at") - F.col("_first")) % k == 0).drop("_at", "_first", "_n")


def hash_split(key: str, shares: dict[str, float], seed: int = 0) -> Column:
    """Name of the part a row falls into, in the given proportions."""
    u, upto, out, total = order_key(key, seed) / 2147483647.0, 0.0, None, sum(shares.values())
    for name, share in list(shares.items())[:-1]:
        upto += share / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def proportional_draws(df: DataFrame, source: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, rows): draws of sources with probability by size; each takes its source's next row in hash order.

    A draw whose source is used up takes nothing. Sources are few; their cumulative shares decide each draw by arithmetic.
    """
    spark = df.sparkSession
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    bands = global_prefix(sizes, [source], "n", "lo").select(source, (F.col("lo") / total).alias("lo"), ((F.col("lo") + F.col("n")) / total).alias("hi"))
    picks = spark.range(draws).select(F.col("id").alias("draw"), (order_key("id", seed) / 2147483647.0).alias("u"))
    chosen = picks.join(bands, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", source)
    turn = ranked(chosen, source, "draw").select("draw", source, "rn")
    return turn.join(ranked(df, source, key, seed).drop("_n"), [source, "rn"]).drop("rn")
