"""Look-ups whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``df`` with the columns of ``table`` (one row for each ``key``), null where it has none or the key is null.

    ``heavy`` names the keys that many rows share; there can't be more of them than rows over that bound. Their rows are
    answered by broadcast and spread evenly over the shuffle of the others, so no task gets a hot key. A null key is
    spread like them.
    """
    values = [c for c in table.columns if c != key]
    top = F.broadcast(table.join(F.broadcast(heavy.select(key)), key, "left_semi").select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv")))
    told = df.join(top, F.col(key) == F.col("_hk"), "left")
    away = F.col("_hk").isNotNull() | F.col(key).isNull()
    salted = told.withColumn("_s", F.when(away, F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1).otherwise(F.lit(0)).cast("int"))
    rest = table.select(F.col(key).alias("_rk"), F.struct(*values).alias("_rv"), F.lit(0).alias("_rs"))
    met = salted.join(rest, (F.col(key) == F.col("_rk")) & (F.col("_s") == F.col("_rs")), "left")
    return met.select(*df.columns, *[F.coalesce(F.col(f"_hv.`{c}`"), F.col(f"_rv.`{c}`")).alias(c) for c in values])
