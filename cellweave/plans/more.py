"""More queries of the reference's own operators: statistics, quantisation, patches, samples, catalogue, streams, learning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, diffusion, ecdf, grow, learn, patch, sample, stats, vq, windows
from ..schema import FEATURES
from ..session import fresh_path, stage
from ..sources import patches as files
from ..streaming import events as streams
from .reference import CELLS, PLANE, THIN, cells, quantile_thresholds
from .registry import query, table

# ---------------------------------------------------------------- statistics


@query(
    "dominant_labels",
    f"""WITH k AS (SELECT stack, section, padded_size, count(*) AS n FROM features WHERE {CELLS} AND padded_size IS NOT NULL AND padded_size <> 15 GROUP BY ALL)
        SELECT stack, section, padded_size, n FROM (SELECT *, row_number() OVER (PARTITION BY stack, section ORDER BY n DESC, padded_size) AS i FROM k) WHERE i = 1""",
)
def dominant_labels(spark, folder):
    return stats.most_frequent(cells(spark, folder), PLANE, "padded_size", 15)


@query(
    "code_entropy",
    """WITH k AS (SELECT padded_size, area // 100 AS a, count(*) AS c FROM features WHERE area >= 0 AND padded_size IS NOT NULL GROUP BY ALL),
       p AS (SELECT c FROM k WHERE c > 2 UNION ALL SELECT sum(c) FROM k WHERE c <= 2 HAVING sum(c) > 0), t AS (SELECT sum(c) AS n FROM p)
       SELECT CAST(any_value(n) AS BIGINT) AS n, round(-sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))), 9) AS entropy FROM p, t""",
)
def code_entropy(spark, folder):
    codes = table(spark, folder, "features").where("area >= 0 AND padded_size IS NOT NULL").withColumn("a", F.floor(F.col("area") / 100))
    return stats.entropy(codes, ["padded_size", "a"], 2).select("n", F.round("entropy", 9).alias("entropy"))


@query(
    "area_histogram",
    """SELECT padded_size, CASE WHEN area < 0 THEN 0 WHEN area >= 4000 THEN 101 ELSE CAST(floor(area / 40.0) AS INTEGER) + 1 END AS bin, count(*) AS n FROM features WHERE area IS NOT NULL GROUP BY ALL""",
)
def area_histogram(spark, folder):
    return stats.histogram(table(spark, folder, "features").where("area IS NOT NULL"), ["padded_size"], "area", 0.0, 4000.0, 100)


@query(
    "gap_splits",
    """WITH s AS (SELECT DISTINCT stack, section FROM features WHERE section IS NOT NULL), g AS (SELECT stack, section, lead(section) OVER (PARTITION BY stack ORDER BY section) - section AS gap FROM s)
       SELECT stack, section AS cut, gap FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY gap DESC, section) AS i FROM g WHERE gap IS NOT NULL) WHERE i = 1""",
)
def gap_splits(spark, folder):
    return stats.gap_split(table(spark, folder, "features"), ["stack"], "section")


@query(
    "elapsed",
    "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS elapsed_us FROM events",
)
def elapsed(spark, folder):
    before = F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - before).alias("elapsed_us"))


@query(
    "moving_average",
    """WITH o AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
       s AS (SELECT user_id, avg(value) AS m FROM o WHERE i <= 10 GROUP BY user_id)
       SELECT o.user_id, o.event_id, round(any_value(s.m) * power(0.95, o.i) + sum(0.05 * power(0.95, o.i - p.i) * p.value), 10) AS ema
       FROM o JOIN s USING (user_id) JOIN o p ON p.user_id = o.user_id AND p.i <= o.i GROUP BY o.user_id, o.event_id, o.i""",
)
def moving_average(spark, folder):
    known = table(spark, folder, "events").where("value IS NOT NULL")
    return stats.moving_average(known, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", F.round("ema", 10).alias("ema"))


@query(
    "auc_accuracy",
    """WITH k AS (SELECT CASE WHEN padded_size = 51 THEN 1 ELSE 0 END AS l, dmvec1 AS s FROM features WHERE padded_size IS NOT NULL AND dmvec1 IS NOT NULL),
       r AS (SELECT l, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM k),
       c AS (SELECT CAST(sum(l) AS BIGINT) AS p, CAST(sum(1 - l) AS BIGINT) AS q, sum(CASE WHEN l = 1 THEN mid ELSE 0 END) AS w, sum(CASE WHEN (s > 0) = (l = 1) THEN 1 ELSE 0 END) AS ok FROM r)
       SELECT p AS positives, q AS negatives, round((w - p * (p + 1) / 2.0) / (p * q), 9) AS auc, round(ok / CAST(p + q AS DOUBLE), 9) AS accuracy FROM c""",
)
def auc_accuracy(spark, folder):
    scored = table(spark, folder, "features").where("padded_size IS NOT NULL").withColumn("l", F.when(F.col("padded_size") == 51, 1).otherwise(0))
    out = stats.auc(scored, "l", "dmvec1")
    return out.select("positives", "negatives", F.round("auc", 9).alias("auc"), F.round("accuracy", 9).alias("accuracy"))


@query(
    "importance_rollup",
    "SELECT p_brand AS feature, round(sum(p_retailprice), 4) AS total FROM part GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 5",
)
def importance_rollup(spark, folder):
    gains = table(spark, folder, "part").select(F.concat_ws("*", "p_brand", "p_size").alias("name"), F.col("p_retailprice").alias("gain"))
    return learn.roll_up(gains).select("feature", F.round("total", 4).alias("total"))


@query(
    "hamming_neighbours",
    """WITH k AS (SELECT DISTINCT area % 7 AS a, height % 7 AS b, width % 7 AS c, padded_size AS d FROM features WHERE area >= 0 AND height >= 0 AND width >= 0 AND padded_size IS NOT NULL)
       SELECT concat_ws(',', p.a, p.b, p.c, p.d) AS a, concat_ws(',', q.a, q.b, q.c, q.d) AS b FROM k p JOIN k q ON (p.a, p.b, p.c, p.d) < (q.a, q.b, q.c, q.d)
       WHERE CAST(p.a <> q.a AS INTEGER) + CAST(p.b <> q.b AS INTEGER) + CAST(p.c <> q.c AS INTEGER) + CAST(p.d <> q.d AS INTEGER) = 1""",
)
def hamming_neighbours(spark, folder):
    known = table(spark, folder, "features").where("area >= 0 AND height >= 0 AND width >= 0 AND padded_size IS NOT NULL")
    codes = known.select(F.array(F.col("area") % 7, F.col("height") % 7, F.col("width") % 7, F.col("padded_size")).alias("code"))
    return stats.hamming_neighbours(codes, "code", 4).select(F.array_join(F.transform("a", lambda v: v.cast("string")), ",").alias("a"), F.array_join(F.transform("b", lambda v: v.cast("string")), ",").alias("b"))


@query(
    "above_mean",
    "SELECT cell_id, area > m AS good FROM (SELECT cell_id, area, avg(area) OVER (PARTITION BY stack) AS m FROM features WHERE area IS NOT NULL)",
)
def above_mean(spark, folder):
    known = table(spark, folder, "features").where("area IS NOT NULL")
    return known.join(known.groupBy("stack").agg(F.avg("area").alias("m")), "stack").select("cell_id", (F.col("area") > F.col("m")).alias("good"))


@query(
    "region_stats",
    f"""SELECT stack, section, count(*) AS n, CAST(sum(area) AS BIGINT) AS cover, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS deviation, stddev_pop(mean) < 10 AS blank, min(x) AS lo, max(x) AS hi
        FROM features WHERE {CELLS} GROUP BY stack, section HAVING count(*) >= 5""",
)
def region_stats(spark, folder):
    out = cells(spark, folder).groupBy(*PLANE).agg(
        F.count("*").alias("n"), F.sum("area").alias("cover"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_pop("mean"), 6).alias("deviation"), (F.stddev_pop("mean") < 10).alias("blank"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    return out.where("n >= 5")


@query(
    "box_dimension",
    f"""SELECT stack, round(ln(a / CAST(b AS DOUBLE)) / ln(2), 9) AS dimension FROM (SELECT stack, count(DISTINCT (section, x // 64, y // 64)) AS a, count(DISTINCT (section, x // 128, y // 128)) AS b FROM features WHERE {CELLS} GROUP BY stack)""",
)
def box_dimension(spark, folder):
    boxes = lambda k: cells(spark, folder).select("stack", "section", F.floor(F.col("x") / k), F.floor(F.col("y") / k)).distinct().groupBy("stack").agg(F.count("*").alias(f"n{k}"))
    return boxes(64).join(boxes(128), "stack").select("stack", F.round(F.ln(F.col("n64") / F.col("n128")) / F.ln(F.lit(2.0)), 9).alias("dimension"))


@query(
    "stage_shares",
    "SELECT event_type, round(avg(value), 6) AS per_event, round(sum(value) / (SELECT sum(value) FROM events), 9) AS share FROM events GROUP BY event_type",
)
def stage_shares(spark, folder):
    per = table(spark, folder, "events").groupBy("event_type").agg(F.avg("value").alias("per_event"), F.sum("value").alias("s"))
    total = per.agg(F.sum("s").alias("t"))
    return per.join(F.broadcast(total), how="cross").select("event_type", F.round("per_event", 6).alias("per_event"), F.round(F.col("s") / F.col("t"), 9).alias("share"))  # one row


# ---------------------------------------------------------------- patches and quantisation

_E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_LONG = f"SELECT vec_id, label, i - 1 AS i, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ({_E}))"


def _patches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _reps(spark: SparkSession, folder: str) -> DataFrame:
    return _patches(spark, folder).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("long").alias("rep_id"), "vector")


_NEAREST = f"""r AS (SELECT label AS rep_id, i, x FROM ({_LONG}) WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
d AS (SELECT l.vec_id, r.rep_id, sum((l.x - r.x) * (l.x - r.x)) AS d2 FROM ({_LONG}) l JOIN r ON l.i = r.i GROUP BY l.vec_id, r.rep_id),
a AS (SELECT vec_id, rep_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, rep_id) AS k FROM d) WHERE k = 1)"""


@query("nearest_rep", f"WITH {_NEAREST} SELECT vec_id, rep_id, round(d2, 5) AS d2 FROM a")
def nearest_rep(spark, folder):
    return vq.nearest(_patches(spark, folder), _reps(spark, folder), "vec_id", "embedding").select("vec_id", "rep_id", F.round("d2", 5).alias("d2"))


@query("vq_refine", f"WITH {_NEAREST} SELECT rep_id, i, round(avg(x), 6) AS value, count(*) AS n FROM a JOIN ({_LONG}) l USING (vec_id) GROUP BY rep_id, i HAVING count(*) > 5")
def vq_refine(spark, folder):
    out = vq.refine(_patches(spark, folder), _reps(spark, folder), "vec_id", "embedding", 5)
    return out.select("rep_id", F.posexplode("vector").alias("i", "value"), F.col("count").alias("n")).select("rep_id", "i", F.round("value", 6).alias("value"), "n")


@query(
    "centroid_distances",
    f"WITH c AS (SELECT label, i, avg(x) AS x FROM ({_LONG}) GROUP BY label, i) SELECT p.label AS a, q.label AS b, round(sqrt(sum((p.x - q.x) * (p.x - q.x))), 6) AS distance FROM c p JOIN c q ON p.i = q.i AND p.label < q.label GROUP BY ALL",
)
def centroid_distances(spark, folder):
    long = _patches(spark, folder).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    other = long.select(F.col("label").alias("b"), "i", F.col("x").alias("y"))
    pairs = long.withColumnRenamed("label", "a").join(other, "i").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)), 6).alias("distance"))


@query(
    "patch_moments",
    f"""WITH m AS (SELECT vec_id, sum(x * x) AS m, sum(x * x * (i % 8)) / sum(x * x) AS cx, sum(x * x * (i // 8)) / sum(x * x) AS cy, sum(x * x * (i % 8) * (i % 8)) / sum(x * x) AS a, sum(x * x * (i // 8) * (i // 8)) / sum(x * x) AS b,
        sum(x * x * (i % 8) * (i // 8)) / sum(x * x) AS c FROM ({_LONG}) GROUP BY vec_id)
        SELECT vec_id, round(m, 5) AS mass, round(cx, 5) AS cx, round(cy, 5) AS cy, round(a - cx * cx, 5) AS xx, round(b - cy * cy, 5) AS yy, round(c - cx * cy, 5) AS xy,
        round(sqrt(power(a - cx * cx - b + cy * cy, 2) + 4 * power(c - cx * cy, 2)) / (a - cx * cx + b - cy * cy), 5) AS confidence FROM m""",
)
def patch_moments(spark, folder):
    squared = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    m = patch.moments(F.col("p"), 8)
    rows = _patches(spark, folder).select("vec_id", squared.alias("p")).select("vec_id", *[c.alias(k) for k, c in m.items()])
    _, confidence = patch.orientation(F.col("xx"), F.col("yy"), F.col("xy"))
    return rows.select("vec_id", *[F.round(k, 5).alias(k) for k in m], F.round(confidence, 5).alias("confidence"))


@query("grey_norm", f"SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(sum(CASE WHEN i = 0 THEN x END) / stddev_pop(x), 5) AS first FROM ({_LONG}) GROUP BY vec_id")
def grey_norm(spark, folder):
    g = patch.grey_normalise(F.col("embedding"))
    return _patches(spark, folder).select("vec_id", F.round(g["mean"], 6).alias("mean"), F.round(g["std"], 6).alias("std"), F.round(F.element_at(g["patch"], 1), 5).alias("first"))


@query(
    "padded_patches",
    f"SELECT vec_id, count(*) AS pixels, round(sum(x), 4) AS total, round(sum(x * ((i // 8 + 3) * 15 + i % 8 + 3)), 3) AS placed FROM ({_LONG}) GROUP BY vec_id",
)
def padded_patches(spark, folder):
    padded = _patches(spark, folder).select("vec_id", F.posexplode(patch.pad(F.col("embedding"), 8, 15)).alias("k", "v")).where("v <> 0")
    return padded.groupBy("vec_id").agg(F.count("*").alias("pixels"), F.round(F.sum("v"), 4).alias("total"), F.round(F.sum(F.col("v") * F.col("k")), 3).alias("placed"))


_GAUSS = [math.exp(-(k * k) / 2) / sum(math.exp(-(j * j) / 2) for j in range(-3, 4)) for k in range(-3, 4)]
_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(
    "smooth_patches",
    f"""WITH l AS ({_LONG}), g AS (SELECT unnest(range(-3, 4)) AS k, unnest({_GAUSS}) AS w),
        t AS (SELECT vec_id, i, x, {_REFLECT.format("i // 8 + a.k")} AS y2, {_REFLECT.format("i % 8 + b.k")} AS x2, a.w * b.w AS w FROM l, g a, g b),
        s AS (SELECT t.vec_id, t.i, any_value(t.x) AS x, sum(t.w * l.x) AS smooth FROM t JOIN l ON l.vec_id = t.vec_id AND l.i = t.y2 * 8 + t.x2 GROUP BY t.vec_id, t.i),
        e AS (SELECT vec_id, sqrt(avg(abs(x - smooth))) AS error FROM s GROUP BY vec_id),
        r AS (SELECT vec_id, sum(x * ((i % 8) * 8 + 7 - i // 8 + 1)) AS turned FROM l GROUP BY vec_id)
        SELECT vec_id, round(error, 6) AS error, error < 0.27 AS kept, round(turned, 4) AS turned, 128 AS bytes FROM e JOIN r USING (vec_id)""",
)
def smooth_patches(spark, folder):
    """Patches with their smoothing error, whether it is small enough to keep them, a weighted sum of the patch turned by 90 degrees, and their bytes in half precision."""
    rows = _patches(spark, folder).select("vec_id", patch.smoothing_error()("embedding").alias("error"), patch.rotate(8)("embedding", F.lit(90.0)).alias("turned"))
    weighed = F.aggregate(F.transform("turned", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    packed = rows.join(files.half_bytes(_patches(spark, folder), "vec_id", "embedding"), "vec_id")
    return packed.select("vec_id", F.round("error", 6).alias("error"), (F.col("error") < 0.27).alias("kept"), F.round(weighed, 4).alias("turned"), F.length("content").alias("bytes"))


@query("codebook")
def codebook(spark, folder):
    return vq.quantise(_patches(spark, folder), "vec_id", "embedding", 20, scale=40.0).select("rep_id", "count", F.round("error", 4).alias("error"))


@query("code_tuples")
def code_tuples(spark, folder):
    """The labels of every patch under 20 codebooks, each learnt on a part of the patches of its own."""
    books = [vq.quantise(_patches(spark, folder).where(F.pmod(F.xxhash64("vec_id"), F.lit(20)) == k), "vec_id", "embedding", 10, rounds=2, scale=40.0, least=0) for k in range(20)]
    return vq.code_tuples(_patches(spark, folder), [b.select("rep_id", "vector") for b in books], "vec_id", "embedding")


@query("diffusion_map")
def diffusion_map(spark, folder):
    book = vq.quantise(_patches(spark, folder), "vec_id", "embedding", 60, rounds=1, scale=40.0, least=0)
    _, reps = vq.codebook(book)
    return diffusion.transform(_patches(spark, folder), diffusion.fit(reps, 1.0, 20, 5), "vec_id", "embedding")


# ---------------------------------------------------------------- samples and splits

_H = "(cell_id * CAST(48271 AS HUGEINT) + 12345) % 2147483647"


@query("per_group_sample", f"SELECT cell_id, stack, section FROM (SELECT *, row_number() OVER (PARTITION BY stack, section ORDER BY {_H}, cell_id) AS i FROM features WHERE section IS NOT NULL) WHERE i <= 10")
def per_group_sample(spark, folder):
    return sample.per_group(table(spark, folder, "features").where("section IS NOT NULL"), PLANE, "cell_id", 10).select("cell_id", *PLANE)


@query("stratified_files")
def stratified_files(spark, folder):
    """The reference's 20 files of 100 000 rows."""
    return sample.stratified_files(table(spark, folder, "features").select("cell_id", "stack"), "stack", "cell_id", 20, 100_000).select("cell_id", "stack", "file")


@query(
    "stratified_files_fixture",
    f"""WITH r AS (SELECT cell_id, stack, row_number() OVER (PARTITION BY stack ORDER BY {_H}, cell_id) - 1 AS i, count(*) OVER (PARTITION BY stack) AS c, count(*) OVER () AS n FROM features),
        s AS (SELECT *, CAST(floor(c / CAST(n AS DOUBLE) * 1000) AS BIGINT) AS k FROM r) SELECT cell_id, stack, CAST(i // k AS INTEGER) AS file FROM s WHERE k > 0 AND i // k < 5""",
)
def stratified_files_fixture(spark, folder):
    return sample.stratified_files(table(spark, folder, "features").select("cell_id", "stack"), "stack", "cell_id", 5, 1000).select("cell_id", "stack", "file")


@query("hash_split", f"SELECT cell_id, CASE WHEN {_H} / 2147483647.0 < 0.7 THEN 'train' ELSE 'test' END AS part FROM features")
def hash_split(spark, folder):
    return table(spark, folder, "features").select("cell_id", sample.hash_split("cell_id", {"train": 0.7, "test": 0.3}).alias("part"))


@query(
    "every_kth",
    "SELECT cell_id, stack FROM (SELECT cell_id, stack, row_number() OVER (PARTITION BY stack ORDER BY cell_id) - 1 AS i, count(*) OVER (PARTITION BY stack) AS n FROM features) WHERE i % greatest(1, n // 100) = 0",
)
def every_kth(spark, folder):
    return sample.every_kth(table(spark, folder, "features").select("cell_id", "stack"), "stack", "cell_id", 100).select("cell_id", "stack")


@query("section_batches", "SELECT stack, section, CAST((row_number() OVER (PARTITION BY stack ORDER BY section) - 1) // 32 AS INTEGER) AS batch FROM (SELECT DISTINCT stack, idx AS section FROM section_files WHERE idx IS NOT NULL)")
def section_batches(spark, folder):
    distinct = table(spark, folder, "section_files").where("idx IS NOT NULL").select("stack", F.col("idx").alias("section")).distinct()
    return distinct.select("stack", "section", F.floor((F.row_number().over(Window.partitionBy("stack").orderBy("section")) - 1) / 32).cast("int").alias("batch"))


@query("permuted_cells", "SELECT cell_id, stack, row_number() OVER (ORDER BY (cell_id * CAST(48271 AS HUGEINT) + 3 * 69621 + 12345) % 2147483647, cell_id) - 1 AS pos FROM features")
def permuted_cells(spark, folder):
    return sample.permute(table(spark, folder, "features").select("cell_id", "stack"), "cell_id", 3)


@query(
    "proportional_draws",
    f"""WITH s AS (SELECT stack, count(*) AS n FROM features GROUP BY stack), t AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (ORDER BY stack) - n AS lo FROM s),
        p AS (SELECT range AS draw, (range * CAST(48271 AS HUGEINT) + 12345) % 2147483647 AS h FROM range(0, (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM features))),
        c AS (SELECT draw, stack, row_number() OVER (PARTITION BY stack ORDER BY h, draw) AS rn FROM p JOIN t ON h / 2147483647.0 >= lo / CAST(total AS DOUBLE) AND h / 2147483647.0 < (lo + n) / CAST(total AS DOUBLE)),
        r AS (SELECT cell_id, stack, row_number() OVER (PARTITION BY stack ORDER BY {_H}, cell_id) AS rn FROM features)
        SELECT c.draw, c.stack, r.cell_id FROM c JOIN r ON c.stack = r.stack AND c.rn = r.rn""",
)
def proportional_draws(spark, folder):
    f = table(spark, folder, "features").select("cell_id", "stack")
    return sample.proportional_draws(f, "stack", "cell_id", int(f.count() * 0.2)).select("draw", "stack", "cell_id")


# ---------------------------------------------------------------- listings, catalogue, sets


@query(
    "file_table",
    r"SELECT stem, array_to_string(list_sort(list(DISTINCT ext)), ',') AS extensions FROM (SELECT regexp_extract(filename, '^(.*)\.([^.]*)$', 1) AS stem, lower(regexp_extract(filename, '^(.*)\.([^.]*)$', 2)) AS ext FROM section_files) WHERE stem <> '' GROUP BY stem",
)
def file_table(spark, folder):
    return files.file_table(table(spark, folder, "section_files"), "filename").select("stem", F.array_join("extensions", ",").alias("extensions"))


@query("section_map", "SELECT stack, count(*) AS total, count(*) FILTER (WHERE filename <> 'Placeholder') AS valid FROM section_files WHERE filename IS NOT NULL AND idx IS NOT NULL GROUP BY stack")
def section_map(spark, folder):
    lines = table(spark, folder, "section_files").where("filename IS NOT NULL AND idx IS NOT NULL").select("stack", F.concat_ws(" ", "filename", "idx").alias("value"))
    return files.section_map(lines, ["stack"]).groupBy("stack").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"))


@query(
    "lock_status",
    r"""SELECT place, bool_or(file_path LIKE '%/\_temporary/%' ESCAPE '\') AS locked, bool_or(n_bytes > 100) AS done, bool_or(n_bytes = 0) AS empty, sum(n_bytes)::BIGINT AS bytes
        FROM (SELECT *, regexp_extract(file_path, '^(cells/[^/]*/[^/]*)/', 1) AS place FROM cell_files) GROUP BY place""",
)
def lock_status(spark, folder):
    placed = table(spark, folder, "cell_files").withColumn("place", F.regexp_extract("file_path", r"^(cells/[^/]*/[^/]*)/", 1))
    return placed.groupBy("place").agg(F.bool_or(F.col("file_path").contains("/_temporary/")).alias("locked"), F.bool_or(F.col("n_bytes") > 100).alias("done"), F.bool_or(F.col("n_bytes") == 0).alias("empty"), F.sum("n_bytes").alias("bytes"))


@query(
    "pending_sections",
    "SELECT DISTINCT stack, idx AS section FROM section_files s WHERE filename <> 'Placeholder' AND stack IS NOT NULL AND idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM features f WHERE f.stack = s.stack AND f.section = s.idx)",
)
def pending_sections(spark, folder):
    parent = table(spark, folder, "section_files").where("filename <> 'Placeholder'").select("stack", F.col("idx").alias("section"))
    return catalog.pending(parent, table(spark, folder, "features"), PLANE)


@query(
    "free_jobs",
    """WITH j AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS i FROM events), m AS (SELECT max(ts) AS now FROM events)
       SELECT user_id FROM j, m WHERE i = 1 AND event_type <> 'error' AND ts < now - INTERVAL 2 HOUR""",
)
def free_jobs(spark, folder):
    """Keys whose last entry in the log is neither an error nor a reservation younger than two hours."""
    log = table(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("reserved").alias("status"), "event_type", "ts")
    now = F.broadcast(log.agg(F.max("ts").alias("now")))  # one row
    held = catalog.held(log, ["user_id"], now, "2 HOURS", ["ts", "event_type"])
    return log.select("user_id").distinct().join(held, "user_id", "left_anti")


@query(
    "insert_ignore",
    """SELECT stack, filename FROM (SELECT stack, min(filename) AS filename FROM section_files WHERE idx % 2 = 0 GROUP BY stack, idx) GROUP BY ALL HAVING false
       UNION ALL SELECT stack, filename FROM section_files WHERE idx % 2 = 0
       UNION ALL SELECT stack, min(filename) FROM section_files i WHERE idx % 2 = 1 AND filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM section_files e WHERE e.idx % 2 = 0 AND e.stack = i.stack) GROUP BY stack""",
)
def insert_ignore(spark, folder):
    f = table(spark, folder, "section_files").select("stack", "filename", "idx")
    return catalog.insert_ignore(f.where("idx % 2 = 0").select("stack", "filename"), f.where("idx % 2 = 1 AND filename IS NOT NULL").select("stack", "filename"), ["stack"])


@query(
    "override",
    """WITH a AS (SELECT stack, section, count(*) AS n FROM features WHERE section IS NOT NULL GROUP BY ALL), b AS (SELECT stack, section, count(*) AS n FROM annotation WHERE section IS NOT NULL GROUP BY ALL)
       SELECT coalesce(b.stack, a.stack) AS stack, coalesce(b.section, a.section) AS section, coalesce(b.n, a.n) AS n FROM a FULL JOIN b ON a.stack = b.stack AND a.section = b.section""",
)
def override(spark, folder):
    count = lambda name: table(spark, folder, name).where("section IS NOT NULL").groupBy(*PLANE).agg(F.count("*").alias("n"))
    return catalog.override([count("features"), count("annotation")], PLANE)


@query(
    "section_sets",
    """WITH a AS (SELECT DISTINCT stack, section FROM features WHERE section IS NOT NULL), b AS (SELECT DISTINCT stack, section FROM annotation WHERE section IS NOT NULL)
       SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'cells', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'contours', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def section_sets(spark, folder):
    a, b = (table(spark, folder, t).where("section IS NOT NULL").select(*PLANE) for t in ("features", "annotation"))
    named = lambda name, df: df.select(F.lit(name).alias("part"), *PLANE)
    return named("both", a.intersect(b)).unionByName(named("cells", a.subtract(b))).unionByName(named("contours", b.subtract(a)))


@query("first_cells", "SELECT cell_id, area FROM features WHERE area IS NOT NULL ORDER BY area DESC, cell_id LIMIT 100")
def first_cells(spark, folder):
    """A top-k report: the hundred largest cells."""
    return table(spark, folder, "features").where("area IS NOT NULL").select("cell_id", "area").orderBy(F.desc("area"), "cell_id").limit(100)


@query(
    "human_cells",
    "SELECT cell_id, lower(trim(b.stain)) AS stain FROM features f JOIN brain b ON f.stack = b.stack WHERE b.human_annotated",
)
def human_cells(spark, folder):
    dimension = table(spark, folder, "brain").where("human_annotated").select("stack", F.lower(F.trim("stain")).alias("stain"))
    return table(spark, folder, "features").select("cell_id", "stack").join(dimension, "stack").select("cell_id", "stain")


_RANGES = [("std", 5.0, 12.0, "soft"), ("area", 50.0, 300.0, "middling"), ("dmvec1", -2.0, 2.0, "central")]


@query(
    "cell_marks",
    "SELECT cell_id, concat_ws(',', " + ", ".join(f"CASE WHEN {f} > {a} AND {f} < {b} THEN '{m}' END" for f, a, b, m in _RANGES) + ") AS marks FROM features",
)
def cell_marks(spark, folder):
    ranges = spark.createDataFrame(_RANGES, "feature string, low double, high double, mark string").coalesce(1)
    out = grow.mark_cells(table(spark, folder, "features").select("cell_id", "std", "area", "dmvec1"), ranges, ["std", "area", "dmvec1"])
    return out.select("cell_id", F.array_join("marks", ",").alias("marks"))


# ---------------------------------------------------------------- streams and learning


@query(
    "stream_tumbling",
    """WITH m AS (SELECT max(ts) AS last FROM events), o AS (SELECT ts, event_type, value FROM events, m WHERE NOT (event_id % 50 = 0 AND ts < last - INTERVAL 1 DAY))
       SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM o, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= last - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def stream_tumbling(spark, folder):
    """Hourly counts by a streaming query with a watermark of ten minutes: windows come out when it has passed them, and rows that arrive after that are left out.

    Every fiftieth event that is more than a day old arrives after all others.
    """
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    held = F.coalesce((F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit(last) - F.expr("INTERVAL 1 DAY")), F.lit(False))
    inbox = fresh_path(spark, "inbox")
    out, state = fresh_path(spark, "tumbling"), fresh_path(spark, "stream")
    for part in (events.where(~held), events.where(held)):  # the same query, run again whenever files have arrived
        part.write.mode("append").parquet(inbox)
        counted = streams.windowed_counts(streams.event_stream(spark, inbox, events.schema, 1_000), "1 hour")
        counted.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(counted.schema).parquet(out)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, folder):
    out = streams.sessions(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _boosted(spark, folder, rounds):
    placed = windows.assign(cells(spark, folder).select(*PLANE, "x", "y", *FEATURES), 448, 448)
    keys = [*PLANE, "wx", "wy"]
    vectors = ecdf.region_vector(placed, keys, FEATURES, quantile_thresholds(spark, folder), 448.0 * 448.0)
    wide = placed.groupBy(*keys).agg(F.avg("width").alias("w"))
    middle = wide.agg(F.percentile_approx("w", 0.5)).first()[0] or 0.0
    samples = vectors.join(wide.select(*keys, (F.col("w") > middle).cast("int").alias("label")), keys).where("label IS NOT NULL")
    samples = stage(samples.withColumn("test", F.pmod(F.xxhash64(*keys), F.lit(10)) < 3), "samples")
    model = learn.train(samples.where("NOT test"), rounds=rounds)
    return learn.score(model, samples.where("test")).select(*keys, "label", F.round("margin", 6).alias("margin"))


@query("boosted_trees")
def boosted_trees(spark, folder):
    """Margins, on three tenths of the windows held out, of 100 trees that tell windows of wide cells from others by their 1982 numbers."""
    return _boosted(spark, folder, 100)


# ---------------------------------------------------------------- further maps and curves


@query(
    "window_owners",
    f"""WITH f AS (SELECT cell_id, x, y FROM features WHERE {CELLS}), g AS (SELECT CAST(range * 56 AS INTEGER) AS w FROM range(0, 800)),
        p AS (SELECT f.*, g.w AS wx FROM f JOIN g ON f.x > g.w AND f.x < g.w + 112), q AS (SELECT p.*, g.w AS wy FROM p JOIN g ON p.y > g.w AND p.y < g.w + 112)
        SELECT cell_id, wx, wy FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY power(x - wx - 56, 2) + power(y - wy - 56, 2), wx, wy) AS i FROM q) WHERE i = 1""",
)
def window_owners(spark, folder):
    return windows.owners(cells(spark, folder), "cell_id", 112, 56)


@query(
    "canvas_pixels",
    f"""SELECT cell_id, CAST(coalesce(floor((x - lx) / CAST(nullif(hx - lx, 0) AS DOUBLE) * 99), 0) AS INTEGER) AS cx, CAST(coalesce(floor((y - ly) / CAST(nullif(hy - ly, 0) AS DOUBLE) * 99), 0) AS INTEGER) AS cy FROM
        (SELECT cell_id, x, y, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM features WHERE {CELLS} WINDOW w AS (PARTITION BY stack, section))""",
)
def canvas_pixels(spark, folder):
    return windows.canvas(cells(spark, folder).select("cell_id", *PLANE, "x", "y"), PLANE, "x", "y", 100).select("cell_id", "cx", "cy")


@query(
    "section_autocorrelation",
    """WITH c AS (SELECT stack, section, count(*) AS v FROM features WHERE section IS NOT NULL GROUP BY ALL), n AS (SELECT stack, avg(v) AS m, stddev_pop(v) AS d FROM c GROUP BY stack HAVING stddev_pop(v) > 0),
       z AS (SELECT c.stack, section, (v - m) / d AS z FROM c JOIN n ON c.stack = n.stack)
       SELECT a.stack, CAST(b.section - a.section AS INTEGER) AS lag, round(avg(a.z * b.z), 9) AS r, count(*) AS n FROM z a JOIN z b ON a.stack = b.stack AND b.section - a.section BETWEEN 0 AND 5 GROUP BY ALL""",
)
def section_autocorrelation(spark, folder):
    counts = table(spark, folder, "features").where("section IS NOT NULL").groupBy(*PLANE).agg(F.count("*").alias("v"))
    return stats.autocorrelation(counts, ["stack"], "section", "v", 5).select("stack", "lag", F.round("r", 9).alias("r"), "n")


_INTERPOLATED = """WITH f AS (SELECT stack, padded_size, std AS v FROM features WHERE std IS NOT NULL AND NOT isnan(std)), {thin},
       m AS (SELECT a.stack, a.v, a.y, max(CASE WHEN b.v <= a.v THEN b.v END) AS px, min(CASE WHEN b.v >= a.v THEN b.v END) AS qx FROM a JOIN b ON a.stack = b.stack GROUP BY a.stack, a.v, a.y)
       SELECT m.stack, m.v, round((m.y + CASE WHEN px IS NULL THEN q.y WHEN qx IS NULL THEN p.y ELSE p.y + coalesce((m.v - px) / nullif(qx - px, 0), 0) * (q.y - p.y) END) / 2, 9) AS y
       FROM m LEFT JOIN b p ON p.stack = m.stack AND p.v = px LEFT JOIN b q ON q.stack = m.stack AND q.v = qx"""


def _interpolated(spark, folder, most):
    f = table(spark, folder, "features")
    part = lambda s: ecdf.melt(f.where(F.col("padded_size") == s), ["stack"], ["std"])
    return ecdf.interpolated_heights(part(15), part(51), ["stack"], most).select("stack", "v", F.round("y", 9).alias("y"))


@query("interpolated_heights", _INTERPOLATED.format(thin=THIN.format(most=10_000)))
def interpolated_heights(spark, folder):
    return _interpolated(spark, folder, 10_000)


@query("interpolated_heights_thin", _INTERPOLATED.format(thin=THIN.format(most=40)))
def interpolated_heights_thin(spark, folder):
    """The same with a smaller bound, which small tables reach too."""
    return _interpolated(spark, folder, 40)


@query(
    "event_props",
    """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""",
)
def event_props(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("csv_scan", "SELECT stack, filename, CAST(idx AS INTEGER) AS idx FROM section_files WHERE idx >= 110")
def csv_scan(spark, folder):
    """The section map, written as CSV and read back with a given schema."""
    path = fresh_path(spark, "csv")
    table(spark, folder, "section_files").select("stack", "filename", "idx").write.option("header", True).option("emptyValue", "").csv(path)
    return spark.read.schema("stack string, filename string, idx int").option("header", True).csv(path).where("idx >= 110")
