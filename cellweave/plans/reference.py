"""Queries of the reference's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ecdf, geometry, grow, patch, select, stats, windows
from ..schema import FEATURES, PARAMETERS

from .registry import query, table

CELLS = "section IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"
PLANE = ["stack", "section"]
SHAPE = [f"dmvec{i}" for i in range(1, 11)]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features").where(CELLS)


def contours(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "annotation").where("section IS NOT NULL AND size(vertices) >= 3")


CONTOURS = "SELECT * FROM annotation WHERE section IS NOT NULL AND len(vertices) >= 3"
EDGES = f"""c AS ({CONTOURS}), e AS (SELECT annotation_id, stack, section, vertices[i].x AS ax, vertices[i].y AS ay, vertices[i % len(vertices) + 1].x AS bx, vertices[i % len(vertices) + 1].y AS by_
  FROM (SELECT *, unnest(range(1, len(vertices) + 1)) AS i FROM c))"""
BOXES = """b AS (SELECT annotation_id, stack, section, name, min(v.x) AS l, max(v.x) AS r, min(v.y) AS u, max(v.y) AS d FROM (SELECT annotation_id, stack, section, name, unnest(vertices) AS v FROM c) GROUP BY ALL)"""

# ---------------------------------------------------------------- scans and projections


@query("box_scan", "SELECT cell_id, stack, section, x, y, area FROM features WHERE x BETWEEN 200 AND 800 AND y BETWEEN 300 AND 900")
def box_scan(spark, folder):
    return select.box(table(spark, folder, "features"), 200, 800, 300, 900).select("cell_id", "stack", "section", "x", "y", "area")


@query("multi_section_scan", "SELECT cell_id, stack, section FROM features WHERE section BETWEEN 120 AND 129")
def multi_section_scan(spark, folder):
    return select.sections(table(spark, folder, "features"), 120, 10).select("cell_id", "stack", "section")


@query(
    "centroids",
    f"SELECT cell_id, CAST(trunc((x - width) + width / 2.0) AS INTEGER) AS cx, CAST(trunc((y - height) + height / 2.0) AS INTEGER) AS cy FROM features WHERE {CELLS}",
)
def centroids(spark, folder):
    cx, cy = select.centroid(F.col("x") - F.col("width"), F.col("y") - F.col("height"), F.col("width"), F.col("height"))
    return cells(spark, folder).select("cell_id", cx.alias("cx"), cy.alias("cy"))


@query(
    "size_classes",
    "SELECT cell_id, CASE WHEN s < 15 THEN 15 WHEN s < 51 THEN 51 WHEN s < 201 THEN 201 END AS size_class FROM (SELECT cell_id, greatest(width, height) AS s FROM features WHERE area >= 10)",
)
def size_classes(spark, folder):
    big = table(spark, folder, "features").where(F.col("area") >= PARAMETERS.min_area)
    return big.select("cell_id", select.size_class(F.greatest("width", "height"), PARAMETERS.size_classes).alias("size_class"))


def _map(size: int) -> tuple[list, list]:
    return [[((i * 3 + j * 7 + size) % 5 - 2) / 4.0 for j in range(10)] for i in range(10)], [j / 10.0 for j in range(10)]


def _affine_sql() -> str:
    def column(j):
        when = " ".join(f"WHEN padded_size = {s} THEN {' + '.join(f'{SHAPE[i]} * ({_map(s)[0][i][j]})' for i in range(10))} + {_map(s)[1][j]}" for s in (15, 51))
        return f"round(CASE {when} ELSE {SHAPE[j]} END, 6) AS {SHAPE[j]}"

    return f"SELECT cell_id, {', '.join(map(column, range(10)))} FROM features"


@query("affine_vectors", _affine_sql())
def affine_vectors(spark, folder):
    maps = spark.createDataFrame([(s, *_map(s)) for s in (15, 51)], "size int, m array<array<double>>, mu array<double>")
    out = select.affine(SHAPE, "padded_size", table(spark, folder, "features").select("cell_id", "padded_size", *SHAPE), maps)
    return out.select("cell_id", *[F.round(c, 6).alias(c) for c in SHAPE])


@query(
    "colour_classes",
    """SELECT cell_id, CASE WHEN padded_size = 15 THEN 0 WHEN padded_size = 51 THEN 1 + t WHEN dmvec3 > -1.8 THEN 3 + t ELSE 5 + t END AS colour
       FROM (SELECT *, CASE WHEN (rotation >= -90 AND rotation < 0) OR rotation > 90 THEN 1 ELSE 0 END AS t FROM features WHERE rotation IS NOT NULL AND NOT isnan(rotation))""",
)
def colour_classes(spark, folder):
    known = table(spark, folder, "features").where("rotation IS NOT NULL AND NOT isnan(rotation)")
    return known.select("cell_id", select.colour_class(F.col("padded_size"), F.col("rotation"), F.col("dmvec3")).alias("colour"))


@query(
    "minmax_rescale",
    f"""SELECT cell_id, round(coalesce((area - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 0) * 0.8 + 0.2, 6) AS shade FROM
        (SELECT cell_id, area, min(area) OVER (PARTITION BY stack, section) AS lo, max(area) OVER (PARTITION BY stack, section) AS hi FROM features WHERE {CELLS} AND area IS NOT NULL)""",
)
def minmax_rescale(spark, folder):
    out = select.rescale(cells(spark, folder).where("area IS NOT NULL").withColumn("area", F.col("area").cast("double")), PLANE, "area", 0.8, 0.2, "shade")
    return out.select("cell_id", F.round("shade", 6).alias("shade"))


@query(
    "sigmoid_scores",
    "SELECT cell_id, round(1 / (1 + exp(-dmvec1)), 6) AS p, CAST(trunc(255 / (1 + exp(-dmvec1))) AS INTEGER) AS grey, round(255 - mean, 6) AS inverted FROM features WHERE dmvec1 IS NOT NULL",
)
def sigmoid_scores(spark, folder):
    p = select.sigmoid(F.col("dmvec1"))
    return table(spark, folder, "features").where("dmvec1 IS NOT NULL").select("cell_id", F.round(p, 6).alias("p"), (255 * p).cast("int").alias("grey"), F.round(255 - F.col("mean"), 6).alias("inverted"))


@query(
    "angles",
    "SELECT cell_id, round(a - 360.0 * ceil((a - 180.0) / 360.0), 6) AS angle, CASE WHEN isnan(std) THEN 0.0 ELSE coalesce(std, 0.0) END AS std FROM (SELECT *, rotation * 2 AS a FROM features) WHERE NOT coalesce(isnan(rotation), false)",
)
def angles(spark, folder):
    known = table(spark, folder, "features").where(~F.coalesce(F.isnan("rotation"), F.lit(False)))
    return known.select("cell_id", F.round(patch.wrap_angle(F.col("rotation") * 2), 6).alias("angle"), F.coalesce(F.nanvl("std", F.lit(0.0)), F.lit(0.0)).alias("std"))


@query(
    "tile_grid",
    f"""WITH s AS (SELECT stack, section, max(x) + 1 AS width, max(y) + 1 AS height FROM features WHERE {CELLS} GROUP BY stack, section),
        a AS (SELECT *, unnest(range(0, width, 1000)) AS tile_x FROM s), b AS (SELECT *, unnest(range(0, height, 1000)) AS tile_y FROM a)
        SELECT stack, section, tile_x, tile_y, least(1000, width - tile_x) AS w, least(1000, height - tile_y) AS h FROM b""",
)
def tile_grid(spark, folder):
    sizes = cells(spark, folder).groupBy(*PLANE).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return windows.tiles(sizes, 1000).select(*PLANE, "tile_x", "tile_y", "w", "h")


# ---------------------------------------------------------------- windows and maps


@query(
    "window_features",
    f"""WITH f AS (SELECT * FROM features WHERE {CELLS}), g AS (SELECT CAST(range * 112 AS INTEGER) AS w FROM range(0, 400)),
        p AS (SELECT f.*, g.w AS wx FROM f JOIN g ON f.x > g.w AND f.x < g.w + 224), q AS (SELECT p.*, g.w AS wy FROM p JOIN g ON p.y > g.w AND p.y < g.w + 224)
        SELECT stack, section, wx, wy, count(*) AS n, round(sum(coalesce(area, 0)) / (224.0 * 224.0), 6) AS cover FROM q GROUP BY stack, section, wx, wy""",
)
def window_features(spark, folder):
    placed = windows.assign(cells(spark, folder).select(*PLANE, "x", "y", "area"), 224, 112)
    return placed.groupBy(*PLANE, "wx", "wy").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("area", F.lit(0))) / (224.0 * 224.0), 6).alias("cover"))


@query(
    "max_abs_merge",
    f"""WITH s AS (SELECT stack, section, x // 200 AS bx, y // 200 AS by_, round(dmvec1, 0) AS v FROM features WHERE {CELLS} AND dmvec1 IS NOT NULL),
        m AS (SELECT stack, section, bx, by_, max(abs(v)) AS top FROM s GROUP BY ALL)
        SELECT stack, section, bx, by_, max(v) AS keep, CASE WHEN max(v) = min(v) THEN max(v) ELSE 0 END AS zero FROM s JOIN m USING (stack, section, bx, by_) WHERE abs(v) = top GROUP BY stack, section, bx, by_""",
)
def max_abs_merge(spark, folder):
    s = cells(spark, folder).where("dmvec1 IS NOT NULL").select(*PLANE, F.floor(F.col("x") / 200).alias("bx"), F.floor(F.col("y") / 200).alias("by_"), F.round("dmvec1", 0).alias("v"))
    keys = [*PLANE, "bx", "by_"]
    keep = windows.merge_max_abs(s, keys, "v", "keep").withColumnRenamed("v", "keep")
    return keep.join(windows.merge_max_abs(s, keys, "v", "zero").withColumnRenamed("v", "zero"), keys)


@query(
    "block_means",
    f"SELECT stack, section, x // 400 AS bx, y // 400 AS by_, round(avg(area), 6) AS value, count(*) AS n FROM features WHERE {CELLS} AND area IS NOT NULL GROUP BY ALL",
)
def block_means(spark, folder):
    out = windows.block_mean(cells(spark, folder).where("area IS NOT NULL"), PLANE, 400, "area")
    return out.select(*PLANE, "bx", F.col("by").alias("by_"), F.round("value", 6).alias("value"), "n")


# ---------------------------------------------------------------- distributions

THRESHOLDS = {"std": [4.0, 8.0, 10.0, 12.0, 14.0, 17.0, 20.0, 25.0, 40.0], "area": [20.0, 40.0, 60.0, 90.0, 150.0, 250.0, 500.0, 1000.0, 4000.0], "height": [5.0, 8.0, 10.0, 14.0, 20.0, 30.0, 45.0, 70.0, 150.0], "dmvec1": [-12.0, -8.0, -4.0, -2.0, 0.0, 2.0, 4.0, 8.0, 12.0]}
REGION_FEATURES = list(THRESHOLDS)
_LEVELS = [0.01 * (j + 1) for j in range(99)]


def _values_sql(keys: str, where: str = "true", source: str = "features") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {i} AS feature, CAST({f} AS DOUBLE) AS v FROM {source} WHERE {where} AND {f} IS NOT NULL AND NOT isnan(CAST({f} AS DOUBLE))" for i, f in enumerate(REGION_FEATURES))


_THRESHOLD_SQL = " UNION ALL ".join(f"SELECT {i} AS feature, {j} AS j, CAST({t} AS DOUBLE) AS t" for i, ts in enumerate(THRESHOLDS.values()) for j, t in enumerate(ts))


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, ts) for i, ts in enumerate(THRESHOLDS.values())], "feature int, ts array<double>")


@query(
    "ecdf_values",
    """SELECT padded_size, v, count(*) AS copies, round((min(rn) - 1) / CAST(n AS DOUBLE), 9) AS height FROM
       (SELECT padded_size, std AS v, row_number() OVER (PARTITION BY padded_size ORDER BY std) AS rn, count(*) OVER (PARTITION BY padded_size) AS n
        FROM features WHERE std IS NOT NULL AND NOT isnan(std)) GROUP BY padded_size, v, n""",
)
def ecdf_values(spark, folder):
    values = ecdf.melt(table(spark, folder, "features"), ["padded_size"], ["std"])
    return ecdf.ecdf(values, ["padded_size"]).select("padded_size", "v", "copies", F.round(F.col("less") / F.col("n"), 9).alias("height"))


_LOOKUP = """
n AS (SELECT {k}, feature, count(*) AS n FROM v GROUP BY {k}, feature),
d AS (SELECT {k}, feature, v, count(*) AS c FROM v GROUP BY {k}, feature, v),
r AS (SELECT {k}, feature, v, c, sum(c) OVER (PARTITION BY {k}, feature ORDER BY v) - c AS less FROM d),
z AS (SELECT {k}, r.feature, t.j, r.less, row_number() OVER (PARTITION BY {k}, r.feature, t.j ORDER BY abs(r.v - t.t), r.v) AS i FROM r JOIN t ON r.feature = t.feature),
y AS (SELECT {k}, z.feature, z.j, z.less / CAST(n.n AS DOUBLE) AS y FROM z JOIN n USING ({k}, feature) WHERE z.i = 1)"""


@query("ecdf_at_thresholds", f"WITH v AS ({_values_sql('stack')}), t AS ({_THRESHOLD_SQL}), {_LOOKUP.format(k='stack')} SELECT stack, feature, j, round(y, 9) AS y FROM y")
def ecdf_at_thresholds(spark, folder):
    values = ecdf.melt(table(spark, folder, "features"), ["stack"], REGION_FEATURES)
    return ecdf.at_thresholds(values, ["stack"], thresholds(spark)).select("stack", "feature", "j", F.round("y", 9).alias("y"))


_WINDOW_KEYS = "stack, section, wx, wy"


@query(
    "region_vector",
    f"""WITH f AS (SELECT *, x // 448 * 448 AS wx, y // 448 * 448 AS wy FROM features WHERE {CELLS} AND x % 448 > 0 AND y % 448 > 0),
        v AS ({_values_sql(_WINDOW_KEYS, source='f')}), t AS ({_THRESHOLD_SQL}), {_LOOKUP.format(k=_WINDOW_KEYS)},
        w AS (SELECT {_WINDOW_KEYS}, count(*) AS n, sum(coalesce(area, 0)) AS a FROM f GROUP BY {_WINDOW_KEYS}),
        l AS (SELECT {_WINDOW_KEYS}, t.feature * 9 + t.j AS pos, coalesce(y.y, 0.0) AS value FROM w CROSS JOIN t LEFT JOIN y USING ({_WINDOW_KEYS}, feature, j)
              UNION ALL SELECT {_WINDOW_KEYS}, 36, n * 50176.0 / 200704.0 FROM w UNION ALL SELECT {_WINDOW_KEYS}, 37, a / 200704.0 FROM w)
        SELECT {_WINDOW_KEYS}, pos, round(value, 9) AS value FROM l""",
)
def region_vector(spark, folder):
    """The vector of every 448-pixel window, one row per position: 36 heights, density, share of area."""
    placed = windows.assign(cells(spark, folder).select(*PLANE, "x", "y", *REGION_FEATURES), 448, 448)
    vectors = ecdf.region_vector(placed, [*PLANE, "wx", "wy"], REGION_FEATURES, thresholds(spark), 448.0 * 448.0)
    return vectors.select(*PLANE, "wx", "wy", F.posexplode("vector").alias("pos", "value")).select(*PLANE, "wx", "wy", "pos", F.round("value", 9).alias("value"))


def quantile_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, ts): the 99 quantiles of each of the twenty features over all cells."""
    found = ecdf.quantiles(ecdf.melt(cells(spark, folder), [], FEATURES), ["feature"], _LEVELS)
    return found.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e.v).alias("ts"))


@query("region_vector_full")
def region_vector_full(spark, folder):
    """The vector of every 448-pixel window over all features and their 99 quantiles: 1980 heights, density, share of area."""
    placed = windows.assign(cells(spark, folder).select(*PLANE, "x", "y", *FEATURES), 448, 448)
    return ecdf.region_vector(placed, [*PLANE, "wx", "wy"], FEATURES, quantile_thresholds(spark, folder), 448.0 * 448.0)


@query(
    "quantile_nearest",
    """WITH r AS (SELECT padded_size, std AS v, row_number() OVER (PARTITION BY padded_size ORDER BY std) - 1 AS i, count(*) OVER (PARTITION BY padded_size) AS n FROM features WHERE std IS NOT NULL AND NOT isnan(std)),
       q AS (SELECT CAST(range AS INTEGER) AS j, CAST(0.01 AS DOUBLE) * (range + 1) AS q FROM range(0, 99)),
       z AS (SELECT padded_size, j, v, row_number() OVER (PARTITION BY padded_size, j ORDER BY abs(i / CAST(n AS DOUBLE) - q), i) AS k FROM r, q)
       SELECT padded_size, j, v FROM z WHERE k = 1""",
)
def quantile_nearest(spark, folder):
    return ecdf.quantiles(ecdf.melt(table(spark, folder, "features"), ["padded_size"], ["std"]), ["padded_size"], _LEVELS)


# distributions of both size classes with every k-th row, k = n / most
THIN = """ed AS (SELECT stack, padded_size, v, count(*) AS copies FROM f WHERE padded_size IN (15, 51) GROUP BY stack, padded_size, v),
       el AS (SELECT *, sum(copies) OVER (PARTITION BY stack, padded_size ORDER BY v) - copies AS less, sum(copies) OVER (PARTITION BY stack, padded_size) AS n FROM ed),
       et AS (SELECT stack, padded_size, v, less / CAST(n AS DOUBLE) AS y FROM (SELECT *, greatest(1, n // {most}) AS k FROM el) WHERE ceil(less / CAST(k AS DOUBLE)) * k < less + copies),
       a AS (SELECT stack, v, y FROM et WHERE padded_size = 15), b AS (SELECT stack, v, y FROM et WHERE padded_size = 51)"""
_MERGED = """WITH f AS (SELECT stack, padded_size, std AS v FROM features WHERE std IS NOT NULL AND NOT isnan(std)), {thin},
       m AS (SELECT a.stack, a.v, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.stack, a.v ORDER BY abs(a.v - b.v), b.v) AS k FROM a JOIN b ON a.stack = b.stack)
       SELECT stack, v, round((ya + yb) / 2, 9) AS y FROM m WHERE k = 1"""


def _merged(spark, folder, most):
    f = table(spark, folder, "features")
    part = lambda s: ecdf.melt(f.where(F.col("padded_size") == s), ["stack"], ["std"])
    return ecdf.merged_heights(part(15), part(51), ["stack"], most).where("y IS NOT NULL").select("stack", "v", F.round("y", 9).alias("y"))


@query("merged_heights", _MERGED.format(thin=THIN.format(most=10_000)))
def merged_heights(spark, folder):
    return _merged(spark, folder, 10_000)


@query("merged_heights_thin", _MERGED.format(thin=THIN.format(most=40)))
def merged_heights_thin(spark, folder):
    """The same with a smaller bound, which small tables reach too."""
    return _merged(spark, folder, 40)


_KS = """{w} u AS (SELECT DISTINCT stack, v FROM (SELECT stack, v FROM a UNION ALL SELECT stack, v FROM b)),
ca AS (SELECT u.stack, u.v, count(a.v) AS c FROM u LEFT JOIN a ON a.stack = u.stack AND a.v = u.v GROUP BY u.stack, u.v), cb AS (SELECT u.stack, u.v, count(b.v) AS c FROM u LEFT JOIN b ON b.stack = u.stack AND b.v = u.v GROUP BY u.stack, u.v),
s AS (SELECT ca.stack, sum(ca.c) OVER w AS sa, sum(cb.c) OVER w AS sb, sum(ca.c) OVER (PARTITION BY ca.stack) AS na, sum(cb.c) OVER (PARTITION BY ca.stack) AS nb FROM ca JOIN cb USING (stack, v) WINDOW w AS (PARTITION BY ca.stack ORDER BY ca.v))
SELECT stack, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, round(max(abs(sa / CAST(na AS DOUBLE) - sb / CAST(nb AS DOUBLE))), 9) AS d FROM s WHERE na > 0 AND nb > 0 GROUP BY stack, na, nb"""


@query("ks_statistic", _KS.format(w="WITH f AS (SELECT stack, padded_size, std AS v FROM features WHERE std IS NOT NULL AND NOT isnan(std)), a AS (SELECT stack, v FROM f WHERE padded_size = 15), b AS (SELECT stack, v FROM f WHERE padded_size = 51),"))
def ks_statistic(spark, folder):
    f = table(spark, folder, "features")
    part = lambda s: ecdf.melt(f.where(F.col("padded_size") == s), ["stack"], ["std"])
    return ecdf.ks(part(15), part(51), ["stack"]).select("stack", "na", "nb", F.round("d", 9).alias("d"))


@query(
    "window_ks",
    f"""WITH f AS (SELECT stack, section, CAST(area AS DOUBLE) AS v, CASE WHEN x % 896 > 0 AND y % 896 > 0 THEN x // 896 * 896 END AS wx, y // 896 * 896 AS wy FROM features WHERE {CELLS} AND area IS NOT NULL),
        p AS (SELECT *, count(*) OVER (PARTITION BY stack, section) AS nb FROM f),
        d AS (SELECT stack, section, wx, wy, v, count(*) AS ac FROM f WHERE wx IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, sum(ac) OVER (PARTITION BY stack, section, wx, wy ORDER BY v) - ac AS al, sum(ac) OVER (PARTITION BY stack, section, wx, wy) AS na FROM d),
        q AS (SELECT s.stack, s.section, wx, wy, s.v, ac, al, na, (SELECT count(*) FROM f WHERE f.stack = s.stack AND f.section = s.section AND f.v < s.v) AS bl,
                (SELECT count(*) FROM f WHERE f.stack = s.stack AND f.section = s.section AND f.v = s.v) AS bc, (SELECT count(*) FROM f WHERE f.stack = s.stack AND f.section = s.section) AS nb FROM s)
        SELECT stack, section, wx, wy, round(max(greatest(abs(al / CAST(na AS DOUBLE) - bl / CAST(nb AS DOUBLE)), abs((al + ac) / CAST(na AS DOUBLE) - (bl + bc) / CAST(nb AS DOUBLE)))), 9) AS d FROM q GROUP BY stack, section, wx, wy""",
)
def window_ks(spark, folder):
    base = cells(spark, folder).select(*PLANE, "x", "y", "area")
    tests = grow.ks_within(ecdf.melt(windows.assign(base, 896, 896), [*PLANE, "wx", "wy"], ["area"]), ecdf.melt(base, PLANE, ["area"]), PLANE, ["wx", "wy"])
    return tests.select(*PLANE, "wx", "wy", F.round("d", 9).alias("d"))


MAPS = ((448, 224), (224, 112))  # Fixed values: window and stride of the reference's two maps


@query("significance_map")
def significance_map(spark, folder):
    """Both maps over all features, told apart by ``window``."""
    return grow.significance(cells(spark, folder), PLANE, FEATURES, MAPS).select(*PLANE, "wx", "wy", "score", "n", "window")


@query("region_growing")
def region_growing(spark, folder):
    """Regions of both maps, each grown at its own stride."""
    scores = grow.significance(cells(spark, folder), PLANE, FEATURES, MAPS)
    stride = F.when(F.col("window") == MAPS[0][0], MAPS[0][1]).otherwise(MAPS[1][1])
    return grow.grow(significance_map(spark, folder), [*PLANE, "window"], stride).select(*PLANE, "wx", "wy", "region", "window")


# ---------------------------------------------------------------- regions


@query(
    "polygon_boxes",
    f"""WITH {EDGES}, {BOXES}, a AS (SELECT annotation_id, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM e GROUP BY annotation_id)
        SELECT b.annotation_id, round(area, 8) AS area, round(l - 10, 4) AS "left", round(r + 10, 4) AS "right", round(u - 10, 4) AS up, round(d + 10, 4) AS down FROM b JOIN a USING (annotation_id)""",
)
def polygon_boxes(spark, folder):
    boxed = contours(spark, folder).select("annotation_id", geometry.polygon_area(F.col("vertices")).alias("area"), *geometry.bounding_box(F.col("vertices"), 10.0))
    return boxed.select("annotation_id", F.round("area", 8).alias("area"), *[F.round(c, 4).alias(c) for c in ("left", "right", "up", "down")])


@query(
    "polygon_rings",
    f"""WITH {EDGES}, {BOXES}, f AS (SELECT cell_id, stack, section, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, area FROM features WHERE {CELLS}),
        p AS (SELECT annotation_id, cell_id, f.x, f.y, area FROM f JOIN b ON f.stack = b.stack AND f.section = b.section AND f.x BETWEEN l - 40 AND r + 40 AND f.y BETWEEN u - 40 AND d + 40),
        t AS (SELECT p.*, e.*, greatest(0.0, least(1.0, coalesce(((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0.0))) AS s FROM p JOIN e ON e.annotation_id = p.annotation_id),
        g AS (SELECT annotation_id, cell_id, any_value(area) AS area, sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 AS odd,
                min(sqrt(power(x - ax - s * (bx - ax), 2) + power(y - ay - s * (by_ - ay), 2))) AS dist FROM t GROUP BY annotation_id, cell_id)
        SELECT annotation_id, CASE WHEN odd = 1 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n, sum(area) AS cover FROM g WHERE odd = 1 OR dist <= 40 GROUP BY ALL""",
)
def polygon_rings(spark, folder):
    points = cells(spark, folder).select("cell_id", *PLANE, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "area")
    split = geometry.ring_split(points, contours(spark, folder).select("annotation_id", *PLANE, "vertices"), PLANE, 40.0)
    return split.groupBy("annotation_id", "polarity").agg(F.count("*").alias("n"), F.sum("area").alias("cover"))


STEP = PARAMETERS.shift_step


HALF = PARAMETERS.shift_half_range


def shift_search(spark, folder, half):
    points = cells(spark, folder).select(*PLANE, "x", "y", "area")
    outlines = contours(spark, folder).select("annotation_id", *PLANE, "vertices")
    return geometry.shift_search(points, outlines, *PLANE, "annotation_id", half, STEP, PARAMETERS.shift_margin, F.coalesce("area", F.lit(0)))


@query("shift_counts")
def shift_counts(spark, folder):
    """Cells inside every contour and in its ring at all 41 x 41 x 41 shifts."""
    return shift_search(spark, folder, (HALF, HALF, HALF)).drop("stack")


@query("shift_peaks")
def shift_peaks(spark, folder):
    """Peak and half width of every brain's curve of inside minus ring, along x, y and sections."""
    curves = None
    for i, axis in enumerate(("dx", "dy", "dz")):
        moved = shift_search(spark, folder, tuple(HALF if i == k else 0 for k in range(3)))
        curve = moved.groupBy("stack", F.col(axis).alias("shift")).agg(F.sum(F.col("positive") - F.col("negative")).alias("n")).withColumn("axis", F.lit(axis))
        curves = curve if curves is None else curves.unionByName(curve)
    return stats.half_width(curves, ["stack", "axis"], "shift", "n")


# the grid small enough for SQL: 3 x 3 shifts, and 7 in x
@query(
    "shift_counts_fixture",
    f"""WITH {EDGES}, o AS (SELECT a.range * {STEP} AS dx, b.range * {STEP} AS dy FROM range(-1, 2) a, range(-1, 2) b), f AS (SELECT cell_id, stack, section, x, y, area FROM features WHERE {CELLS}),
        h AS (SELECT e.annotation_id, cell_id, dx, dy, any_value(area) AS area FROM f JOIN e ON f.stack = e.stack AND f.section = e.section CROSS JOIN o
              WHERE (ay > y - dy) <> (by_ > y - dy) AND x - dx < (bx - ax) * (y - dy - ay) / nullif(by_ - ay, 0) + ax GROUP BY e.annotation_id, cell_id, dx, dy HAVING count(*) % 2 = 1)
        SELECT annotation_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, count(*) AS n, CAST(sum(coalesce(area, 0)) AS DOUBLE) AS total FROM h GROUP BY annotation_id, dx, dy""",
)
def shift_counts_fixture(spark, folder):
    points = cells(spark, folder).select("cell_id", *PLANE, "x", "y", "area")
    offsets = [(i * STEP, j * STEP) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return geometry.shift_counts(points, contours(spark, folder).select("annotation_id", *PLANE, "vertices"), PLANE, offsets, ["annotation_id"], F.coalesce("area", F.lit(0)).cast("double"))


@query(
    "shift_peaks_fixture",
    f"""WITH {EDGES}, o AS (SELECT range * {STEP} AS dx FROM range(-3, 4)), f AS (SELECT cell_id, stack, section, x, y FROM features WHERE {CELLS}),
        h AS (SELECT e.annotation_id, f.stack, cell_id, dx FROM f JOIN e ON f.stack = e.stack AND f.section = e.section CROSS JOIN o
              WHERE (ay > y) <> (by_ > y) AND x - dx < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax GROUP BY e.annotation_id, f.stack, cell_id, dx HAVING count(*) % 2 = 1),
        k AS (SELECT stack, CAST(dx AS INTEGER) AS dx, count(*) AS n FROM h GROUP BY stack, dx),
        t AS (SELECT stack, dx AS peak, n AS top FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY n DESC, dx) AS i FROM k) WHERE i = 1),
        r AS (SELECT stack, dx FROM (SELECT k.stack, dx, row_number() OVER (PARTITION BY k.stack ORDER BY abs(n - top / 2.0), dx) AS i FROM k JOIN t USING (stack) WHERE dx >= peak) WHERE i = 1),
        l AS (SELECT stack, dx FROM (SELECT k.stack, dx, row_number() OVER (PARTITION BY k.stack ORDER BY abs(n - top / 2.0), -dx) AS i FROM k JOIN t USING (stack) WHERE dx <= peak) WHERE i = 1)
        SELECT t.stack, peak, r.dx - l.dx AS width FROM t JOIN r USING (stack) JOIN l USING (stack)""",
)
def shift_peaks_fixture(spark, folder):
    points = cells(spark, folder).select("cell_id", *PLANE, "x", "y")
    counts = geometry.shift_counts(points, contours(spark, folder).select("annotation_id", *PLANE, "vertices"), PLANE, [(i * STEP, 0) for i in range(-3, 4)], ["stack"])
    return stats.half_width(counts.select("stack", "dx", "n"), ["stack"], "dx", "n")


@query(
    "box_overlaps",
    f"""WITH c AS ({CONTOURS}), {BOXES} SELECT p.stack, p.section, p.annotation_id AS a, q.annotation_id AS b FROM b p JOIN b q ON p.stack = q.stack AND p.section = q.section AND p.annotation_id < q.annotation_id
        WHERE p.l < q.r AND q.l < p.r AND p.u < q.d AND q.u < p.d""",
)
def box_overlaps(spark, folder):
    boxes = contours(spark, folder).select("annotation_id", *PLANE, *geometry.bounding_box(F.col("vertices")))
    return geometry.overlaps(boxes, PLANE, "annotation_id")


@query(
    "grid_outside",
    f"""WITH {EDGES}, {BOXES}, k AS (SELECT annotation_id, CAST(floor(l) AS INTEGER) AS l, CAST(ceil(r) AS INTEGER) AS r, CAST(floor(u) AS INTEGER) AS u, CAST(ceil(d) AS INTEGER) AS d FROM b),
        g AS (SELECT *, unnest(range(u, d, 100)) AS gy FROM (SELECT *, unnest(range(l, r, 100)) AS gx FROM k)),
        i AS (SELECT g.annotation_id, gx, gy FROM g JOIN e USING (annotation_id) WHERE (ay > gy) <> (by_ > gy) AND gx < (bx - ax) * (gy - ay) / nullif(by_ - ay, 0) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
        SELECT annotation_id, gx, gy FROM g EXCEPT SELECT annotation_id, gx, gy FROM i""",
)
def grid_outside(spark, folder):
    c = contours(spark, folder)
    box = geometry.bounding_box(F.col("vertices"))
    bounds = c.select("annotation_id", "vertices", *[f(b).cast("int").alias(n) for f, b, n in zip((F.floor, F.ceil, F.floor, F.ceil), box, ("left", "right", "up", "down"), strict=True)])
    points = windows.grid(bounds, 100)
    return points.where(~geometry.inside(geometry.edges(F.col("vertices")), F.col("gx"), F.col("gy"))).select("annotation_id", "gx", "gy").distinct()


@query(
    "largest_regions",
    f"""WITH {EDGES}, a AS (SELECT annotation_id, round(abs(sum(ax * by_ - bx * ay)) / 2, 8) AS area FROM e GROUP BY annotation_id)
        SELECT stack, name, section, annotation_id, area FROM (SELECT *, row_number() OVER (PARTITION BY stack, name ORDER BY area DESC, section, annotation_id) AS i FROM c JOIN a USING (annotation_id) WHERE name IS NOT NULL) WHERE i = 1""",
)
def largest_regions(spark, folder):
    sized = contours(spark, folder).where("name IS NOT NULL").select("stack", "name", "section", "annotation_id", F.round(geometry.polygon_area(F.col("vertices")), 8).alias("area"))
    return select.newest(sized, ["stack", "name"], [F.desc("area"), F.col("section"), F.col("annotation_id")])


@query(
    "structure_vertices",
    "SELECT stack, name, CAST(sum(len(vertices)) AS BIGINT) AS n_vertices, count(DISTINCT section) AS n_sections FROM annotation WHERE name IS NOT NULL AND vertices IS NOT NULL GROUP BY stack, name",
)
def structure_vertices(spark, folder):
    known = table(spark, folder, "annotation").where("name IS NOT NULL AND vertices IS NOT NULL")
    return known.groupBy("stack", "name").agg(F.sum(F.size("vertices")).alias("n_vertices"), F.countDistinct("section").alias("n_sections"))
