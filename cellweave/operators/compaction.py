"""Consolidation of many tiny files into few well-sized ones, clustered along a Hilbert curve."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, stage
from .ranking import global_prefix


def hilbert_code(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert index of integer points with ``bits`` bits in each dimension (Skilling, 2004), all points at once."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in coords]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << 1) | (((x[i] ^ t) >> b) & 1)
    return code


@dataclass(frozen=True)
class Compacted:
    path: str
    files: int
    rows: int
    digest: tuple


def _digest(columns: list[str]) -> list[Column]:
    """Aggregates over the rows' hashes: their number, the sums of three parts of 22 bits and less (no overflow below 10^12 rows), and their xor."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in columns])
    parts = [F.coalesce(F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 22) - 1))), F.lit(0)).alias(f"s{at}") for at in (0, 22, 44)]
    return [F.count("*").alias("n"), *parts, F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")]


def digest(df: DataFrame, columns: list[str]) -> tuple:
    """(rows, sums and xor of row hashes): equal multisets of rows have equal digests, in whatever order and files they lie."""
    return tuple(df.agg(*_digest(columns)).first())


def compact(df: DataFrame, by: list[str], dims: list[str], path: str | None = None, rows_per_file: int = 250_000, least_files: int = 8) -> Compacted:
    """Rewrite ``df`` as balanced Parquet files clustered by ``by`` and then by the Hilbert code of ``dims``.

    Every dimension is scaled to the same width, so a range of any of them meets few files. The exact histogram of code
    prefixes gives every prefix its place in the global order, hence its file; a prefix that alone holds a quarter of a file
    is cut by row hash before it is joined with its place, so no key of the join and no file is hot. Files hold
    ``rows_per_file`` rows, or fewer where there would be less than ``least_files``, so no single task writes everything.
    The digest of what was written must equal that of the source, else ``RuntimeError``. Rows with a null in ``dims`` are
    kept, ahead of the others; ties, repeated rows and extra columns are kept as they are; an empty table gives no rows.
    """
    spark, schema, names = df.sparkSession, df.schema, df.columns
    columns = [f"c{i}" for i in range(len(names))]  # so that no name of the source clashes with one used here
    by, dims = ([columns[names.index(c)] for c in part] for part in (by, dims))
    df = stage(df.toDF(*columns), "source")  # the source may be costly to read; it is read once
    ends = [f(F.col(c).cast("long")).alias(f"{k}{i}") for i, c in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
    spans = df.agg(*_digest(columns), *ends).first()
    before = tuple(spans[: len(spans) - len(ends)])
    total = before[0]
    low = [spans[f"lo{i}"] or 0 for i in range(len(dims))]
    wide = [max(1, (spans[f"hi{i}"] or 0) - low[i]) for i in range(len(dims))]
    bits = 62 // len(dims)

    @F.pandas_udf("long")
    def code(block: pd.DataFrame) -> pd.Series:
        known = block.notna().all(axis=1).to_numpy()
        out = np.full(len(block), -1, dtype=np.int64)
        if known.any():
            share = [(block.iloc[:, i].to_numpy()[known].astype(np.int64) - low[i]) / wide[i] for i in range(len(low))]
            out[known] = hilbert_code([np.floor(s * ((1 << bits) - 1)).astype(np.int64) for s in share], bits)
        return pd.Series(out)

    files = max(1, min(max(total, 1), max(least_files, -(-total // rows_per_file))))
    share = total / files
    # prefixes so fine that a file holds about 64 of them, if rows were spread evenly
    keep = min(bits, -(-(files * 64).bit_length() // len(dims)) + 2)
    source = df.withColumn("_code", code(F.struct(*[F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(dims)]))).withColumn("_bin", F.shiftright("_code", (bits - keep) * len(dims)))
    placed = stage(global_prefix(source.groupBy(*by, "_bin").agg(F.count("*").alias("_n")), [*by, "_bin"], "_n", out="_start"), "histogram")
    row = F.col("_row")
    source = source.withColumn("_row", F.xxhash64(F.monotonically_increasing_id(), *columns))  # equal rows differ in it; the staged files fix it, should a task run again
    hot = placed.where(F.col("_n") > max(1.0, share / 4)).select(*[F.col(c).alias(f"h{c}") for c in by], F.col("_bin").alias("h_bin"), F.col("_n").alias("_hn"), F.col("_start").alias("_hs"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"h{c}")) for c in [*by, "_bin"]])
    told = source.join(F.broadcast(hot), same, "left").withColumn("_cut", F.pmod(row, F.lit(1 << 20)) / float(1 << 20))  # at most four prefixes a file are hot
    free = told.withColumn("_key", F.when(F.col("_hn").isNull(), F.xxhash64(*by, "_bin")).otherwise(row)).withColumn("_is", F.col("_hn").isNull())
    rest = placed.select(*[F.col(c).alias(f"p{c}") for c in by], F.col("_bin").alias("p_bin"), F.col("_n").alias("_pn"), F.col("_start").alias("_ps"), F.xxhash64(*by, "_bin").alias("_pkey"))
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"p{c}")) for c in [*by, "_bin"]])
    at = F.when(F.col("_is"), F.col("_ps") + F.col("_pn") / 2).otherwise(F.col("_hs") + F.col("_cut") * F.col("_hn"))
    target = (
        free.join(rest, (F.col("_key") == F.col("_pkey")) & F.col("_is") & match, "left")
        .withColumn("_file", F.least(F.lit(files - 1), F.floor(at * files / max(1, total))).cast("int"))
        .select(*columns, "_code", "_file")
        .repartitionById(files, "_file")
        .sortWithinPartitions(*by, "_code")
        .select(*columns)
    )
    path = path or fresh_path(spark, "compacted")
    target.toDF(*names).write.parquet(path)
    after = digest(spark.read.schema(schema).parquet(path), names)
    if after != before:
        raise RuntimeError(f"compaction changed the rows: {before} before, {after} after")
    return Compacted(path, files, total, after)
