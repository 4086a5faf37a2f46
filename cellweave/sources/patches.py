"""Raw little-endian half-precision patch files: reading, writing, and listings of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_half(spark: SparkSession, path: str, side: int) -> DataFrame:
    """(path, i, patch): the patches of raw float16 files, ``side`` x ``side`` each, as floats. A cut-off last patch is an error."""
    size = 2 * side * side

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                if data.size % size:
                    raise ValueError(f"{name} ends within a patch")
                for at in range(0, data.size // size, 4096):
                    part = np.frombuffer(data, dtype="<f2", offset=at * size, count=min(4096, data.size // size - at) * side * side).astype(np.float32)
                    rows = len(part) // (side * side)
                    patch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) + 1, side * side, dtype=np.int32)), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(at, at + rows)), patch], names=["path", "i", "patch"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, i long, patch array<float>")


def half_bytes(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, content): every patch as little-endian half-precision bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if p is None else np.asarray(p, dtype="<f2").tobytes() for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], names=["k", "content"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(patch).alias("p")).mapInArrow(pack, f"k {kind}, content binary").withColumnRenamed("k", key)


def section_map(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, filename, section, valid) of ``filename index`` lines in ``value``; ``Placeholder`` names no slice; other lines give nothing."""
    parts = F.split(F.trim("value"), r"\s+")
    named = lines.where(F.size(parts) == 2).select(*(keys or []), parts[0].alias("filename"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias("section"), (parts[0] != "Placeholder").alias("valid"))
    return named.where("section IS NOT NULL")


def file_table(names: DataFrame, path: str) -> DataFrame:
    """(stem, extensions): what files there are of each stem; the stem is the name before its last dot."""
    base = F.substring_index(path, "/", -1)
    stem, ext = F.regexp_extract(base, r"^(.*)\.([^.]*)$", 1), F.lower(F.regexp_extract(base, r"^(.*)\.([^.]*)$", 2))
    return names.select(stem.alias("stem"), ext.alias("ext")).where("stem <> ''").groupBy("stem").agg(F.array_sort(F.collect_set("ext")).alias("extensions"))
