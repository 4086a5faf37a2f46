"""Queries of the reference's smaller operators: vectors, listings, entropies, gaps, slices, single-sample tests, patch normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ecdf, patch, sample, stats, windows
from ..schema import PARAMETERS
from .more import _LONG, _patches
from .reference import CELLS, EDGES, HALF, PLANE, REGION_FEATURES, STEP, _values_sql, cells, shift_search
from .registry import query, table

# ---------------------------------------------------------------- vectors


@query("vector_prefix", "SELECT vec_id, v[1] AS v0, v[2] AS v1, v[10] AS v9, round(list_sum(v), 5) AS total FROM (SELECT vec_id, CAST(embedding[1:10] AS DOUBLE[]) AS v FROM embeddings)")
def vector_prefix(spark, folder):
    """The first ten numbers of every vector, some as columns, and their sum."""
    v = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    first = _patches(spark, folder).select("vec_id", v.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return first.select("vec_id", *[F.col("v")[i].alias(f"v{i}") for i in (0, 1, 9)], F.round(total, 5).alias("total"))


@query("half_grid", f"SELECT vec_id, count(*) AS pixels, round(sum(x * (i // 16 * 4 + i % 8 // 2 + 1)), 4) AS placed FROM ({_LONG}) WHERE i // 8 % 2 = 0 AND i % 2 = 0 GROUP BY vec_id")
def half_grid(spark, folder):
    """Every second pixel of every second row of the 8 x 8 patches, as a 4 x 4 patch."""
    small = F.filter("embedding", lambda v, i: (F.floor(i / 8) % 2 == 0) & (i % 2 == 0))
    placed = F.aggregate(F.transform("s", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return _patches(spark, folder).select("vec_id", small.alias("s")).select("vec_id", F.size("s").cast("long").alias("pixels"), F.round(placed, 4).alias("placed"))


@query("shaped_patches", "SELECT label, count(*) FILTER (WHERE len(embedding) = 64) AS shaped, count(*) FILTER (WHERE len(embedding) IS DISTINCT FROM 64) AS other FROM embeddings GROUP BY label")
def shaped_patches(spark, folder):
    """Patches of 8 x 8 pixels and others."""
    right = F.coalesce(F.size("embedding") == 64, F.lit(False))
    return _patches(spark, folder).groupBy("label").agg(F.count_if(right).alias("shaped"), F.count_if(~right).alias("other"))


@query("renamed_contours", "SELECT name AS structure, section AS plane, len(vertices) AS corners FROM annotation WHERE vertices IS NOT NULL")
def renamed_contours(spark, folder):
    """Columns named anew by their position."""
    rows = table(spark, folder, "annotation").where("vertices IS NOT NULL").select("name", "section", F.size("vertices").cast("long").alias("n"))
    return rows.toDF("structure", "plane", "corners")


@query(
    "lag_distances",
    f"SELECT a.label, a.vec_id, round(sum((a.x - b.x) * (a.x - b.x)), 5) AS d2 FROM (SELECT l.*, p.before FROM ({_LONG}) l JOIN (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) p USING (vec_id)) a JOIN ({_LONG}) b ON b.vec_id = a.before AND a.i = b.i GROUP BY a.label, a.vec_id",
)
def lag_distances(spark, folder):
    """Squared distance of every patch to the one before it in its sequence."""
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    return _patches(spark, folder).withColumn("b", before).where("b IS NOT NULL").select("label", "vec_id", F.round(stats.squared_distance(wide("embedding"), wide("b")), 5).alias("d2"))


@query("shared_labels", "SELECT section, list_sort(list_filter(list(DISTINCT padded_size), lambda s: s IS NOT NULL AND s <> 15))::VARCHAR AS classes FROM features WHERE section IS NOT NULL GROUP BY section")
def shared_labels(spark, folder):
    """The size classes met on a section without the one that counts as background."""
    sets = table(spark, folder, "features").where("section IS NOT NULL").groupBy("section").agg(F.collect_set("padded_size").alias("s"))
    kept = F.array_sort(F.array_except("s", F.array(F.lit(15))))
    return sets.select("section", F.concat(F.lit("["), F.array_join(F.transform(kept, lambda v: v.cast("string")), ", "), F.lit("]")).alias("classes"))


# ---------------------------------------------------------------- listings and names


@query(
    "preferred_files",
    r"""WITH f AS (SELECT DISTINCT stack, idx, filename, CASE WHEN lower(filename) LIKE '%\_raw.tif' ESCAPE '\' THEN 0 WHEN lower(filename) LIKE '%\_lossless.jp2' ESCAPE '\' THEN 1 END AS kind FROM section_files WHERE idx IS NOT NULL)
        SELECT stack, idx, filename FROM (SELECT *, row_number() OVER (PARTITION BY stack, idx ORDER BY kind, filename) AS i FROM f WHERE kind IS NOT NULL) WHERE i = 1""",
)
def preferred_files(spark, folder):
    """One file of each section: its raw image, or where there is none its lossless one."""
    low = F.lower("filename")
    kind = F.when(low.endswith("_raw.tif"), 0).when(low.endswith("_lossless.jp2"), 1)
    known = table(spark, folder, "section_files").where("idx IS NOT NULL").withColumn("kind", kind).where("kind IS NOT NULL")
    return known.groupBy("stack", "idx").agg(F.min(F.struct("kind", "filename")).alias("b")).select("stack", "idx", "b.filename")


@query("unfiled_brains", "SELECT b.stack, NOT EXISTS (SELECT 1 FROM section_files s WHERE s.stack = b.stack AND starts_with(s.filename, b.stack || '_')) AS empty FROM brain b")
def unfiled_brains(spark, folder):
    """Whether any file's name begins with a brain's."""
    filed = table(spark, folder, "section_files").where(F.col("filename").startswith(F.concat("stack", F.lit("_")))).select("stack").distinct().withColumn("filed", F.lit(True))
    return table(spark, folder, "brain").select("stack").join(filed, "stack", "left").select("stack", F.col("filed").isNull().alias("empty"))


@query("folder_sizes", "SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM cell_files GROUP BY ALL")
def folder_sizes(spark, folder):
    """Files and bytes of each folder."""
    return table(spark, folder, "cell_files").groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


# Structure names that mean the same.
ALIASES = [("7nn", "7n"), ("2kk", "2k"), ("RtTgg", "RtTg")]


@query("alias_names", "SELECT annotation_id, coalesce(a.name, n.name) AS name FROM annotation n LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") a(alias, name) ON n.name = a.alias")
def alias_names(spark, folder):
    """Contours with the usual name of their structure, by a table of aliases."""
    aliases = spark.createDataFrame(ALIASES, "alias string, usual string")
    named = table(spark, folder, "annotation").select("annotation_id", "name")
    return named.join(aliases, F.col("name") == F.col("alias"), "left").select("annotation_id", F.coalesce("usual", "name").alias("name"))


@query("late_rows", "SELECT CAST(date_trunc('day', extracted_at) AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE loaded_at > extracted_at + INTERVAL 30 DAY) AS late FROM features WHERE extracted_at >= TIMESTAMP '2019-06-01' GROUP BY ALL")
def late_rows(spark, folder):
    """Rows of each day from a given one on, and those loaded more than thirty days later."""
    f = table(spark, folder, "features").where(F.col("extracted_at") >= F.to_timestamp_ntz(F.lit("2019-06-01")))
    return f.groupBy(F.to_date("extracted_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("loaded_at") > F.col("extracted_at") + F.expr("INTERVAL 30 DAYS")).alias("late"))


# ---------------------------------------------------------------- windows, gaps, slices


@query(
    "blank_tiles",
    f"SELECT stack, section, x // 224 AS bx, y // 224 AS by_, count(*) AS n, round(stddev_pop(mean), 6) AS deviation FROM features WHERE {CELLS} AND mean IS NOT NULL AND NOT isnan(mean) GROUP BY ALL HAVING stddev_pop(mean) < {PARAMETERS.min_std}",
)
def blank_tiles(spark, folder):
    """Tiles whose grey values hardly differ."""
    known = cells(spark, folder).where("mean IS NOT NULL AND NOT isnan(mean)")
    tiles = known.groupBy(*PLANE, F.floor(F.col("x") / 224).alias("bx"), F.floor(F.col("y") / 224).alias("by_")).agg(F.count("*").alias("n"), F.stddev_pop("mean").alias("s"))
    return tiles.where(F.col("s") < PARAMETERS.min_std).select(*PLANE, "bx", "by_", "n", F.round("s", 6).alias("deviation"))


@query(
    "gap_sides",
    """WITH s AS (SELECT DISTINCT stack, section FROM features WHERE section IS NOT NULL), g AS (SELECT stack, section, lead(section) OVER (PARTITION BY stack ORDER BY section) - section AS gap FROM s),
       c AS (SELECT stack, section AS cut FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY gap DESC, section) AS i FROM g WHERE gap IS NOT NULL) WHERE i = 1)
       SELECT s.stack, s.section, CASE WHEN c.cut IS NULL OR s.section <= c.cut THEN 'before' ELSE 'after' END AS side FROM s LEFT JOIN c USING (stack)""",
)
def gap_sides(spark, folder):
    """On which side of the largest gap of its brain each section lies."""
    f = table(spark, folder, "features").where("section IS NOT NULL").select(*PLANE)
    sides = f.distinct().join(stats.gap_split(f, ["stack"], "section").select("stack", "cut"), "stack", "left")
    return sides.select(*PLANE, F.when(F.col("cut").isNull() | (F.col("section") <= F.col("cut")), "before").otherwise("after").alias("side"))


@query(
    "refine_slices",
    "SELECT vec_id, CAST(pos // 50 - 1 AS INTEGER) AS slice FROM (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * CAST(48271 AS HUGEINT) + 12345) % 2147483647, vec_id) - 1 AS pos FROM embeddings) WHERE pos // 50 BETWEEN 1 AND 5",
)
def refine_slices(spark, folder):
    """The five disjoint slices of 50 patches each on which a codebook of two is refined, after the 50 of its seeding."""
    at = sample.permute(_patches(spark, folder).select("vec_id"), "vec_id")
    part = F.floor(F.col("pos") / 50)
    return at.where(part.between(1, 5)).select("vec_id", (part - 1).cast("int").alias("slice"))


@query(
    "far_windows",
    f"""WITH f AS (SELECT stack, section, x // 448 * 448 AS wx, y // 448 * 448 AS wy FROM features WHERE {CELLS} AND x % 448 > 0 AND y % 448 > 0), w AS (SELECT stack, section, wx, wy, count(*) AS n FROM f GROUP BY ALL),
        s AS (SELECT stack, section, wx, wy FROM (SELECT *, row_number() OVER (PARTITION BY stack, section ORDER BY n DESC, wx, wy) AS i FROM w) WHERE i = 1)
        SELECT w.stack, w.section, w.wx, w.wy FROM w JOIN s ON w.stack = s.stack AND w.section = s.section WHERE sqrt(power(w.wx - s.wx, 2) + power(w.wy - s.wy, 2)) >= 1000""",
)
def far_windows(spark, folder):
    """Windows at least 1000 pixels from the fullest one of their section, where another seed may stand."""
    placed = windows.assign(cells(spark, folder).select(*PLANE, "x", "y"), 448, 448).groupBy(*PLANE, "wx", "wy").agg(F.count("*").alias("n"))
    seeds = placed.groupBy(*PLANE).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("wx").alias("sx"), F.col("wy").alias("sy"))).alias("s"))
    far = F.sqrt((F.col("wx") - F.col("s.sx")) ** 2 + (F.col("wy") - F.col("s.sy")) ** 2) >= 1000
    return placed.join(seeds, PLANE).where(far).select(*PLANE, "wx", "wy")


# ---------------------------------------------------------------- entropies and tests

_CODE = ["a", "b", "c"]
_CODES = "SELECT padded_size AS a, area // 200 AS b, height // 10 AS c FROM features WHERE area >= 0 AND height >= 0 AND padded_size IS NOT NULL"


def _entropy_sql(name: str, keys: str) -> str:
    return f"""SELECT '{name}' AS codes, any_value(n) AS n, round(-sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))), 9) AS entropy FROM (SELECT c, sum(c) OVER () AS n FROM
      (SELECT sum(c) AS c FROM (SELECT count(*) AS c, CASE WHEN count(*) > 1 THEN row_number() OVER () ELSE 0 END AS g FROM ({_CODES}) GROUP BY {keys}) GROUP BY g))"""


@query(
    "joint_entropy",
    "SELECT codes, CAST(n AS BIGINT) AS n, entropy FROM (" + " UNION ALL ".join([_entropy_sql(k, k) for k in _CODE] + [_entropy_sql("upto_" + _CODE[i], ", ".join(_CODE[: i + 1])) for i in range(3)]) + ")",
)
def joint_entropy(spark, folder):
    """Entropy of each of three codes alone, and of the first one, two and three together; codes seen once are one code."""
    known = table(spark, folder, "features").where("area >= 0 AND height >= 0 AND padded_size IS NOT NULL")
    codes = known.select(F.col("padded_size").alias("a"), F.floor(F.col("area") / 200).alias("b"), F.floor(F.col("height") / 10).alias("c"))
    parts = [(k, [k]) for k in _CODE] + [(f"upto_{_CODE[i]}", _CODE[: i + 1]) for i in range(3)]
    out = None
    for name, keys in parts:
        one = stats.entropy(codes, keys, 1).select(F.lit(name).alias("codes"), "n", F.round("entropy", 9).alias("entropy"))
        out = one if out is None else out.unionByName(one)
    return out


_P_SQL = """greatest(1e-300, least(1.0, CASE WHEN z < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * z * z))) END))"""


@query(
    "ks_combiners",
    f"""WITH f AS (SELECT * FROM features WHERE padded_size IN (15, 51)), v AS ({_values_sql("stack, padded_size", source="f")}),
        d AS (SELECT stack, feature, v, count(*) FILTER (WHERE padded_size = 15) AS ca, count(*) FILTER (WHERE padded_size = 51) AS cb FROM v GROUP BY ALL),
        s AS (SELECT stack, feature, sum(ca) OVER w AS sa, sum(cb) OVER w AS sb, sum(ca) OVER g AS na, sum(cb) OVER g AS nb FROM d WINDOW w AS (PARTITION BY stack, feature ORDER BY v), g AS (PARTITION BY stack, feature)),
        k AS (SELECT stack, feature, max(abs(sa / CAST(na AS DOUBLE) - sb / CAST(nb AS DOUBLE))) AS d, sqrt(CAST(na AS DOUBLE) * nb / (na + nb)) AS e FROM s WHERE na > 0 AND nb > 0 GROUP BY stack, feature, na, nb),
        z AS (SELECT stack, d, (e + 0.12 + 0.11 / e) * d AS z FROM k), p AS (SELECT stack, d, {_P_SQL} AS p FROM z)
        SELECT stack, round(product(1 - p), 6) AS product, round(sum(-ln(p)), 5) AS total, round(list_sum(list_sort(list(-ln(p)), 'DESC')[1:2]), 5) AS top, round(max(d), 9) AS largest FROM p GROUP BY stack""",
)
def ks_combiners(spark, folder):
    """How far small and middling cells differ in four features, by every way of combining the tests; the two largest count as top."""
    f = table(spark, folder, "features")
    part = lambda s: ecdf.melt(f.where(F.col("padded_size") == s), ["stack"], REGION_FEATURES)
    out = ecdf.ks_combined(ecdf.ks(part(15), part(51), ["stack", "feature"]), ["stack"], 2)
    return out.select("stack", F.round("product", 6).alias("product"), F.round("total", 5).alias("total"), F.round("top", 5).alias("top"), F.round("largest", 9).alias("largest"))


_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]  # as in normal_cdf


@query(
    "ks_normal",
    f"""WITH f AS (SELECT padded_size, std AS v FROM features WHERE std IS NOT NULL AND NOT isnan(std) AND padded_size IS NOT NULL), m AS (SELECT padded_size, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM f GROUP BY ALL),
        d AS (SELECT padded_size, v, count(*) AS c FROM f GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY padded_size ORDER BY v) - c AS less FROM d),
        z AS (SELECT r.*, n, (v - m) / s AS z, 1 / (1 + 0.2316419 * abs((v - m) / s)) AS t FROM r JOIN m USING (padded_size) WHERE s > 0),
        u AS (SELECT *, exp(-z * z / 2) / {math.sqrt(2 * math.pi)!r} * t * ({_B[0]} + t * ({_B[1]} + t * ({_B[2]} + t * ({_B[3]} + t * {_B[4]})))) AS u FROM z),
        q AS (SELECT *, CASE WHEN z >= 0 THEN 1 - u ELSE u END AS p FROM u)
        SELECT padded_size, any_value(n) AS n, round(max(greatest(abs(less / CAST(n AS DOUBLE) - p), abs((less + c) / CAST(n AS DOUBLE) - p))), 8) AS d FROM q GROUP BY padded_size""",
)
def ks_normal(spark, folder):
    """How far each size class's grey deviation is from a normal distribution."""
    known = table(spark, folder, "features").where("padded_size IS NOT NULL")
    return ecdf.ks_normal(ecdf.melt(known, ["padded_size"], ["std"]), ["padded_size"]).select("padded_size", "n", F.round("d", 8).alias("d"))


@query(
    "volume_autocorrelation",
    f"""WITH c AS (SELECT stack, section AS z, x // 500 AS x, y // 500 AS y, count(*) AS v FROM features WHERE {CELLS} GROUP BY ALL), n AS (SELECT stack, avg(v) AS m, stddev_pop(v) AS d FROM c GROUP BY stack HAVING stddev_pop(v) > 0),
        s AS (SELECT c.*, (v - m) / d AS s FROM c JOIN n USING (stack))
        SELECT a.stack, CAST(b.z - a.z AS INTEGER) AS dz, CAST(b.y - a.y AS INTEGER) AS dy, CAST(b.x - a.x AS INTEGER) AS dx, round(avg(a.s * b.s), 8) AS r, count(*) AS n FROM s a JOIN s b ON a.stack = b.stack
        AND b.z - a.z BETWEEN 0 AND 1 AND b.y - a.y BETWEEN -1 AND 1 AND b.x - a.x BETWEEN -1 AND 1 GROUP BY ALL""",
)
def volume_autocorrelation(spark, folder):
    """Correlation of the blocks' cell counts with those of their neighbours in the same and the next section."""
    c = cells(spark, folder).groupBy("stack", F.col("section").alias("z"), F.floor(F.col("y") / 500).alias("y"), F.floor(F.col("x") / 500).alias("x")).agg(F.count("*").alias("v"))
    found = stats.autocorrelation_volume(c, ["stack"], ["z", "y", "x"], "v", [(0, 1), (-1, 1), (-1, 1)])
    return found.select("stack", *[F.col(f"d{a}").cast("int").alias(f"d{a}") for a in "zyx"], F.round("r", 8).alias("r"), "n")


# ---------------------------------------------------------------- shifts and patches


@query(
    "shift_curve_fixture",
    f"""WITH {EDGES}, o AS (SELECT range * {STEP} AS dx FROM range(-2, 3)), f AS (SELECT cell_id, stack, section, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM features WHERE {CELLS}),
        t AS (SELECT e.annotation_id, e.stack, f.cell_id, o.dx, f.x - o.dx AS px, f.y AS py, ax, ay, bx, by_ FROM f JOIN e ON f.stack = e.stack AND f.section = e.section CROSS JOIN o),
        u AS (SELECT *, greatest(0.0, least(1.0, coalesce(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0.0))) AS s FROM t),
        g AS (SELECT annotation_id, stack, cell_id, dx, sum(CASE WHEN (ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 AS odd,
              min(sqrt(power(px - ax - s * (bx - ax), 2) + power(py - ay - s * (by_ - ay), 2))) AS dist FROM u GROUP BY ALL)
        SELECT stack, CAST(dx AS INTEGER) AS dx, CAST(sum(CASE WHEN odd = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN odd = 0 AND dist <= {PARAMETERS.shift_margin!r} THEN 1 ELSE 0 END) AS BIGINT) AS negative,
          CAST(sum(CASE WHEN odd = 1 THEN 1 WHEN dist <= {PARAMETERS.shift_margin!r} THEN -1 ELSE 0 END) AS BIGINT) AS difference FROM g WHERE odd = 1 OR dist <= {PARAMETERS.shift_margin!r} GROUP BY stack, dx""",
)
def shift_curve_fixture(spark, folder):
    """Cells inside, in the ring, and their difference, of every brain's contours moved along x by up to two steps."""
    moved = shift_search(spark, folder, (2, 0, 0)).groupBy("stack", "dx").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    return moved.select("stack", "dx", "positive", "negative", (F.col("positive") - F.col("negative")).alias("difference"))


_SECTIONS = """WITH {edges}, o AS (SELECT CAST(range AS INTEGER) AS dz FROM range(-{half}, {half} + 1)), f AS (SELECT cell_id, stack, section, x, y FROM features WHERE {cells}),
        h AS (SELECT e.annotation_id, f.cell_id, o.dz FROM e CROSS JOIN o JOIN f ON f.stack = e.stack AND f.section = e.section + o.dz
              WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
        SELECT annotation_id, dz, count(*) AS positive FROM h GROUP BY ALL"""


@query("section_shifts", _SECTIONS.format(edges=EDGES, cells=CELLS, half=HALF))
def section_shifts(spark, folder):
    """Cells inside every contour laid on each of the 41 sections around its own."""
    return shift_search(spark, folder, (0, 0, HALF)).where("positive > 0").select("annotation_id", "dz", "positive")


_M = f"""m AS (SELECT vec_id, sum(x * x) AS m, sum(x * x * (i % 8)) / sum(x * x) AS cx, sum(x * x * (i // 8)) / sum(x * x) AS cy, sum(x * x * (i % 8) * (i % 8)) / sum(x * x) AS a, sum(x * x * (i // 8) * (i // 8)) / sum(x * x) AS b,
        sum(x * x * (i % 8) * (i // 8)) / sum(x * x) AS c FROM ({_LONG}) GROUP BY vec_id), n AS (SELECT *, a - cx * cx AS xx, b - cy * cy AS yy, c - cx * cy AS xy FROM m)"""


@query(
    "patch_orientation",
    f"""WITH {_M}, q AS (SELECT *, CASE WHEN xy <> 0 THEN abs((xx - yy) / xy) ELSE 0.0 END AS conf, round_even(cx, 0) AS rx, round_even(cy, 0) AS ry FROM n),
        p AS (SELECT *, CASE WHEN conf > 0.1 THEN 0.5 - atan(2 * xy / (xx - yy)) / {math.pi!r} ELSE 0.0 END AS part FROM q), t AS (SELECT *, (CASE WHEN part > 0.5 THEN part - 1 ELSE part END + sign(xy) / 2.0) * 90 AS turn FROM p)
        SELECT vec_id, round(CASE WHEN turn >= 180 THEN turn - 360 WHEN turn < -180 THEN turn + 360 ELSE turn END, 5) AS angle, round(conf, 5) AS confidence,
          CASE WHEN abs(cx - 4) > abs(cy - 4) THEN cx < 4 ELSE cy < 4 END AS flip, round(sqrt(abs(xx)), 6) AS horizontal, round(sqrt(abs(yy)), 6) AS vertical,
          CAST(ceil(sqrt(greatest(rx * rx + ry * ry, (8 - rx) * (8 - rx) + ry * ry, rx * rx + (8 - ry) * (8 - ry), (8 - rx) * (8 - rx) + (8 - ry) * (8 - ry)))) AS BIGINT) AS radius FROM t""",
)
def patch_orientation(spark, folder):
    """Angle, confidence, flip, widths and circle of every patch (of squared values), by its moments."""
    squared = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    p = F.col("p")
    m = patch.moments(p, 8)
    rows = _patches(spark, folder).select("vec_id", squared.alias("p")).select("vec_id", "p", *[c.alias(k) for k, c in m.items()])
    angle, confidence = patch.main_angle(F.col("xx"), F.col("yy"), F.col("xy"))
    widths = [F.round(patch.weighted_width(p, 8, a), 6).alias(n) for a, n in (("x", "horizontal"), ("y", "vertical"))]
    named = {k: F.col(k) for k in m}
    radius = patch.circle_radius(F.lit(8.0), F.lit(8.0), F.col("cx"), F.col("cy")).alias("radius")
    return rows.select("vec_id", F.round(angle, 5).alias("angle"), F.round(confidence, 5).alias("confidence"), patch.flip_needed(named, 8).alias("flip"), *widths, radius)


@query("normalised_patches")
def normalised_patches(spark, folder):
    """Every patch (of squared values) set into its circle, scaled, turned upright in two passes and padded, with its statistics."""
    squared = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return _patches(spark, folder).select("vec_id", patch.normalise()(squared).alias("n")).select("vec_id", "n.*")


@query("edge_boxes", "SELECT cell_id, ((x - width) % 1000 + 1000) % 1000 = 0 OR ((y - height) % 1000 + 1000) % 1000 = 0 OR (((x - width) % 1000 + 1000) % 1000) + width >= 1000 OR (((y - height) % 1000 + 1000) % 1000) + height >= 1000 AS cut FROM features WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
def edge_boxes(spark, folder):
    """Whether the box of a cell touches or leaves the tile of 1000 pixels in which it begins."""
    known = table(spark, folder, "features").where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    left, top = F.pmod(F.col("x") - F.col("width"), F.lit(1000)), F.pmod(F.col("y") - F.col("height"), F.lit(1000))
    return known.select("cell_id", ((left == 0) | (top == 0) | (left + F.col("width") >= 1000) | (top + F.col("height") >= 1000)).alias("cut"))


@query(
    "joined_contours",
    "SELECT stack, name, count(*) AS corners, round(sum(v.x), 4) AS sx, round(sum(v.y), 4) AS sy, min(section) AS first, max(section) AS last FROM (SELECT stack, name, section, unnest(vertices) AS v FROM annotation WHERE name IS NOT NULL AND section IS NOT NULL) GROUP BY stack, name",
)
def joined_contours(spark, folder):
    """The corners of all contours of a structure put together, as a volume outline: their number, sums and extent."""
    known = table(spark, folder, "annotation").where("name IS NOT NULL AND section IS NOT NULL")
    corners = known.select("stack", "name", "section", F.explode("vertices").alias("v"))
    return corners.groupBy("stack", "name").agg(F.count("*").alias("corners"), F.round(F.sum("v.x"), 4).alias("sx"), F.round(F.sum("v.y"), 4).alias("sy"), F.min("section").alias("first"), F.max("section").alias("last"))
