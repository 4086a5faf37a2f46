"""Queries of the core's two pipeline operators: compaction (p2) and spatial neighbours (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.compaction import compact
from ..operators.spatial import near_and_inside
from ..sources.cell_files import distinct_cells, parse_cell_files
from .registry import query, table


_FIELDS = ("section", "x", "y", "area", "height")
P2_SQL = rf"""
WITH f AS (SELECT file_id, regexp_extract(file_path, '(?:^|/)(?:stack=)?([A-Za-z][A-Za-z0-9]*[0-9])/(?:section=)?[0-9]+/', 1) AS stack,
             string_split(replace(replace(file_text, chr(65279), ''), chr(13), ''), chr(10)) AS ls FROM cell_files WHERE file_text IS NOT NULL),
l AS (SELECT file_id, stack, i, trim(ls[i]) AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM f) WHERE stack <> ''),
s AS (SELECT *, CASE WHEN regexp_matches(lower(line), '^(section|x|y|area|height) *[,;|\t]') THEN regexp_replace(regexp_replace(lower(line), '[;|\t]', ',', 'g'), ' ', '', 'g') END AS h FROM l),
t AS (SELECT *, string_split(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i), '{",".join(_FIELDS)}'), ',') AS o FROM s),
v AS (SELECT stack, o, string_split(regexp_replace(regexp_replace(line, '[;|\t]', ',', 'g'), ' ', '', 'g'), ',') AS c FROM t WHERE regexp_matches(line, '^[0-9]')),
r AS (SELECT stack, {", ".join(f"c[list_position(o, '{f}')] AS {f}" for f in _FIELDS)} FROM v WHERE len(c) = len(o)
      UNION ALL SELECT stack, {", ".join(f"""regexp_extract(line, '"{f}": *([0-9.]+)[,}}]', 1)""" for f in _FIELDS)} FROM t WHERE line LIKE '{{%}}')
SELECT DISTINCT stack, CAST(CAST(section AS DOUBLE) AS INTEGER) AS section, CAST(CAST(x AS DOUBLE) AS INTEGER) AS x, CAST(CAST(y AS DOUBLE) AS INTEGER) AS y FROM r
WHERE {" AND ".join(f"regexp_matches({f}, '^[0-9]+([.]0*)?$')" for f in _FIELDS)}
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells held by the compacted files, read back from them."""
    cells = distinct_cells(parse_cell_files(table(spark, folder, "cell_files")))
    done = compact(cells, ["stack"], ["section", "x", "y"])
    return spark.read.schema(cells.schema).parquet(done.path).select("stack", "section", "x", "y")


P3_SQL = """
WITH f AS (SELECT cell_id, stack, section, x, y FROM features WHERE stack IS NOT NULL AND section IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT a.cell_id, b.cell_id AS other_id FROM f a JOIN f b ON a.stack = b.stack AND a.section = b.section AND a.cell_id < b.cell_id
      WHERE abs(a.x - b.x) <= 15 AND abs(a.y - b.y) <= 15 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225),
v AS (SELECT annotation_id, stack, section, vertices, len(vertices) AS n FROM annotation WHERE section IS NOT NULL AND len(vertices) >= 3),
e AS (SELECT annotation_id, stack, section, vertices[i].x AS ax, vertices[i].y AS ay, vertices[i % n + 1].x AS bx, vertices[i % n + 1].y AS by_
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM v)),
r AS (SELECT f.cell_id, e.annotation_id FROM f JOIN e ON f.stack = e.stack AND f.section = e.section
      WHERE (e.ay > f.y) <> (e.by_ > f.y) AND f.x < (e.bx - e.ax) * (f.y - e.ay) / (e.by_ - e.ay) + e.ax
      GROUP BY f.cell_id, e.annotation_id HAVING count(*) % 2 = 1)
SELECT cell_id, 'cell' AS other_kind, other_id FROM c UNION ALL SELECT cell_id, 'region' AS other_kind, annotation_id AS other_id FROM r
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells within 15 pixels of each other and contours around cells, by section."""
    return near_and_inside(table(spark, folder, "features"), table(spark, folder, "annotation"), 15.0, ("stack", "section"))
