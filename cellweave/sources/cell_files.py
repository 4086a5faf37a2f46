"""Records of freshly extracted cells, out of the texts of tiny files in several layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The record's fields in their default order.
FIELDS = ["section", "x", "y", "area", "height"]

_NAME = r'"?(?:section|x|y|area|height)"?'
_SEPARATOR = r"[,;|\t]"
_HEADER = rf"(?i)^\s*{_NAME}(?:\s*{_SEPARATOR}\s*{_NAME})+\s*$"
_NUMBER = r"^[+-]?\d+(?:\.0*)?$"


def parse_cell_files(files: DataFrame) -> DataFrame:
    """(stack, section, x, y, area, height, file_id, written_at) of every complete record, repeated ones included.

    A line that names the fields gives the order of those below it; JSON objects name their own. A record is complete
    if all five fields are there and are whole numbers (``7``, ``007`` and ``7.000`` are the same number); cut-off
    lines, remarks and blank lines give none. Null or empty texts and paths without a stack give no rows. The text is
    cut at the naming lines inside its row, so order is carried without a shuffle or window.
    """
    stack = F.regexp_extract("file_path", r"(?:^|/)(?:stack=)?([A-Za-z][A-Za-z0-9]*\d)/(?:section=)?\d+/", 1)
    text = F.regexp_replace(F.regexp_replace("file_text", "﻿", ""), r"\r\n?", "\n")
    base = files.select("file_id", "written_at", F.nullif(stack, F.lit("")).alias("stack"), text.alias("t")).where("stack IS NOT NULL AND t IS NOT NULL AND t <> ''")
    objects = F.regexp_extract_all("t", F.lit(r"(\{[^{}]*\})"), F.lit(1))
    plain = F.regexp_replace("t", r"\{[^{}]*\}", "")
    segments = F.split(plain, rf"(?im)^(?=[ ]*{_NAME}[ ]*{_SEPARATOR})")

    def fields(line):
        return F.transform(F.split(line, _SEPARATOR), lambda v: F.trim(F.regexp_replace(v, '"', "")))

    by_line = (
        base.select("file_id", "written_at", "stack", F.explode(segments).alias("seg"))
        .select("file_id", "written_at", "stack", F.split("seg", "\n").alias("lines"))
        .withColumn("named", F.col("lines")[0].rlike(_HEADER))
        .withColumn("order", F.when(F.col("named"), fields(F.lower(F.col("lines")[0]))).otherwise(F.array(*map(F.lit, FIELDS))))
        .select("file_id", "written_at", "stack", "order", F.explode("lines").alias("line"))
        .where(F.col("line").rlike(r'^\s*"?[+-]?\d'))
        .withColumn("v", fields(F.col("line")))
        .where(F.size("v") == F.size("order"))
        .select("file_id", "written_at", "stack", *[F.get("v", F.array_position("order", f) - 1).alias(f) for f in FIELDS])
    )
    by_name = base.select("file_id", "written_at", "stack", F.explode(objects).alias("o")).select(
        "file_id", "written_at", "stack", *[F.get_json_object("o", f"$.{f}").alias(f) for f in FIELDS]
    )
    whole = by_line.unionByName(by_name)
    for f in FIELDS:
        whole = whole.where(F.col(f).rlike(_NUMBER))
    return whole.select(
        "stack", *[F.expr(f"try_cast(regexp_replace({f}, '[.].*', '') AS INT)").alias(f) for f in FIELDS], "file_id", "written_at"
    ).where(" AND ".join(f"{f} IS NOT NULL" for f in FIELDS))


def distinct_cells(records: DataFrame) -> DataFrame:
    """One row per (stack, section, x, y); area and height come from the record written last (ties: the larger file_id)."""
    return records.groupBy("stack", "section", "x", "y").agg(
        F.max_by(F.struct("area", "height"), F.struct("written_at", "file_id", "area", "height")).alias("r")
    ).select("stack", "section", "x", "y", "r.area", "r.height")
