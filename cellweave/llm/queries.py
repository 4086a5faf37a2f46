"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import clusters, components, leakage, percentiles, residue, tokens

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- p1

P1_FIELDS = ["area", "rotation", "std", "height"]
P1_RANKS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
P1_ERROR = 0.01

_G = (1 + P1_ERROR) / (1 - P1_ERROR)
P1_SQL = f"""
WITH v AS (
  SELECT stack, padded_size, CAST(extracted_at AS DATE) AS day, field, v FROM (
    SELECT stack, padded_size, extracted_at, 'area' AS field, CAST(area AS DOUBLE) AS v FROM features
    UNION ALL SELECT stack, padded_size, extracted_at, 'rotation', rotation FROM features
    UNION ALL SELECT stack, padded_size, extracted_at, 'std', std FROM features
    UNION ALL SELECT stack, padded_size, extracted_at, 'height', CAST(height AS DOUBLE) FROM features)
  WHERE v IS NOT NULL AND NOT isnan(v)),
s AS (SELECT 'day' AS scope, stack, padded_size, day, field, v FROM v UNION ALL SELECT 'all', stack, padded_size, NULL, field, v FROM v),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY scope, stack, padded_size, day, field) AS n FROM s
      WINDOW w AS (PARTITION BY scope, stack, padded_size, day, field ORDER BY v)),
b AS (SELECT scope, stack, padded_size, day, field, n, i,
        CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * pow({_G!r}, ceil(ln(abs(v)) / ln({_G!r}))) * 2 / (1 + {_G!r}) END AS e FROM r)
SELECT scope, stack, padded_size, day, field, n,
  {", ".join(f"round(max(CASE WHEN i = greatest(1, CAST(ceil(CAST({q} AS DOUBLE) * n) AS BIGINT)) THEN e END), 6) AS {name}" for name, q in P1_RANKS.items())}
FROM b GROUP BY scope, stack, padded_size, day, field, n
"""


@_query("p1_percentiles", P1_SQL)
def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each stack and padded_size: of every day (scope ``day``) and, by adding the days' buckets, of all (``all``)."""
    features = _table(spark, folder, "features")
    days = stage(percentiles.sketch(features, ["stack", "padded_size", F.to_date("extracted_at").alias("day")], P1_FIELDS, P1_ERROR), "days")
    whole = percentiles.merge(days, ["stack", "padded_size"])
    by_day = percentiles.percentiles(days, ["stack", "padded_size", "day"], P1_RANKS, P1_ERROR, merged=True).withColumn("scope", F.lit("day"))
    by_all = percentiles.percentiles(whole, ["stack", "padded_size"], P1_RANKS, P1_ERROR, merged=True).withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")})
    found = by_day.unionByName(by_all)
    return found.select("scope", "stack", "padded_size", "day", "field", "n", *[F.round(r, 6).alias(r) for r in P1_RANKS])


# ---------------------------------------------------------------- p4

# What may follow a structure's name without changing what it names, and how its side is written.
NAME_TAILS = r"(?i)(?:\.npy|[ _.-]*\(\d+\)|[ _.-]+v\d+|[ _.-]*\(?copy(?:[ _]?\d+)?\)?|[ _.-]+surround(?:ings?)?(?:[ _]\d+ ?um)?(?:[ _]noclass)?)+$"
NAME_SIDE = r"(?i)^(.*?)[ _.\-]+\(?(left|right|l|r)\)?$"


def structure_of(name: Column) -> Column:
    """``structure|side`` of a contour's name, null for a null or blank one; case counts in the structure, not in the side."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), NAME_TAILS, ""))
    side = F.upper(F.substring(F.regexp_extract(bare, NAME_SIDE, 2), 1, 1))
    stem = F.when(side == "", bare).otherwise(F.regexp_extract(bare, NAME_SIDE, 1))
    stem = F.when(stem == "2kk", F.lit("2k")).otherwise(stem)
    return F.when(bare != "", F.concat(stem, F.lit("|"), side))


def _p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    contours = _table(spark, folder, "annotation").select("annotation_id", "stack", "section", "name")
    stack = F.col("stack")
    section = F.when(stack.isNotNull() & F.col("section").isNotNull(), F.concat_ws("|", stack, F.col("section").cast("string")))
    structure = structure_of(F.col("name"))
    return components.group_records(contours, "annotation_id", [section, F.when(stack.isNotNull() & structure.isNotNull(), F.concat_ws("|", stack, structure))])


P4_SQL = f"""
WITH RECURSIVE a AS (
  SELECT annotation_id, stack, section, trim(regexp_replace(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '{NAME_TAILS}', '')) AS bare FROM annotation),
b AS (SELECT annotation_id, stack, section, CASE WHEN bare <> '' THEN
        CASE WHEN regexp_extract(bare, '{NAME_SIDE}', 2) = '' THEN CASE WHEN bare = '2kk' THEN '2k' ELSE bare END || '|'
        ELSE CASE WHEN regexp_extract(bare, '{NAME_SIDE}', 1) = '2kk' THEN '2k' ELSE regexp_extract(bare, '{NAME_SIDE}', 1) END
          || '|' || upper(substr(regexp_extract(bare, '{NAME_SIDE}', 2), 1, 1)) END END AS structure FROM a),
k AS (SELECT annotation_id, stack || '|s|' || section AS key FROM b WHERE stack IS NOT NULL AND section IS NOT NULL
      UNION ALL SELECT annotation_id, stack || '|n|' || structure FROM b WHERE stack IS NOT NULL AND structure IS NOT NULL),
e AS (SELECT DISTINCT x.annotation_id AS a, y.annotation_id AS b FROM k x JOIN k y ON x.key = y.key),
reach(a, b) AS (SELECT annotation_id, annotation_id FROM annotation UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS annotation_id, min(b) AS group_id FROM reach GROUP BY a
"""


@_query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every contour with the group that must stay in one split."""
    return _p4_groups(spark, folder)


@_query("p4_splits")
def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every contour with its group and split: train, validation and test near 80, 10 and 10 percent."""
    grouped = stage(_p4_groups(spark, folder), "grouped")
    return grouped.join(components.split_groups(grouped, {"train": 0.8, "validation": 0.1, "test": 0.1}), "group_id").select("annotation_id", "group_id", "split")


# ---------------------------------------------------------------- p5

P5_VECTOR = [f"dmvec{i}" for i in range(1, 11)]

P5_SQL = f"""
WITH f AS (SELECT * FROM features WHERE {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in P5_VECTOR)} AND area >= 0 AND padded_size IS NOT NULL),
e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM f a JOIN f b ON a.padded_size = b.padded_size
      WHERE abs(a.dmvec1 - b.dmvec1) <= 1 AND greatest(a.area, b.area) <= 2 * least(a.area, b.area)
        AND {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in P5_VECTOR)} <= 1),
d AS (SELECT a, count(*) AS n, min(b) AS g FROM e GROUP BY a),
s AS (SELECT g, count(*) AS size FROM d GROUP BY g),
bad AS (SELECT DISTINCT x.g FROM e JOIN d x ON e.a = x.a JOIN d y ON e.b = y.a JOIN s ON s.g = x.g WHERE x.g <> y.g OR x.n <> s.size)
SELECT d.a AS cell_id, d.g AS group_id FROM d JOIN s ON d.g = s.g WHERE s.size >= 5 AND d.g NOT IN (SELECT g FROM bad)
"""


@_query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of every cluster."""
    return clusters.spectral_clusters(_table(spark, folder, "features"), "cell_id", P5_VECTOR, "area", "padded_size")


P5_CLUSTERS_SQL = f"""
WITH c AS ({P5_SQL}), v AS (SELECT c.group_id, f.cell_id, {", ".join(f"f.{c}" for c in P5_VECTOR)} FROM c JOIN features f USING (cell_id)),
w AS (SELECT a.group_id, a.cell_id, round(sum(1 - ({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in P5_VECTOR)})), 4) AS affinity FROM v a JOIN v b ON a.group_id = b.group_id GROUP BY a.group_id, a.cell_id),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY affinity DESC, cell_id) AS i, count(*) OVER (PARTITION BY group_id) AS size FROM w)
SELECT group_id, size, {", ".join(f"max(CASE WHEN i = {k} THEN cell_id END) AS typical_{k}" for k in (1, 2, 3))} FROM r GROUP BY group_id, size
"""


@_query("p5_clusters", P5_CLUSTERS_SQL)
def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size and its three most typical cells."""
    features = _table(spark, folder, "features")
    members = stage(clusters.spectral_clusters(features, "cell_id", P5_VECTOR, "area", "padded_size"), "members")
    found = clusters.typical_members(members, features, "cell_id", P5_VECTOR)
    return found.select("group_id", "size", *[F.col("typical")[k - 1].alias(f"typical_{k}") for k in (1, 2, 3)])


# ---------------------------------------------------------------- p6

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@_query("p6_ids")
def p6_ids(spark: SparkSession, folder: str, ranks_path: str = TOKENIZER) -> DataFrame:
    """Ids of every text by byte_bpe_50k."""
    return tokens.encode_corpus(_table(spark, folder, "documents"), ranks_path)


# ---------------------------------------------------------------- p7


@_query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and evaluation items that share ten consecutive words."""
    return leakage.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


# ---------------------------------------------------------------- p8


@_query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold what a template, a server or a page tool left in place of content."""
    return residue.residue_records(_table(spark, folder, "documents"))
