import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import catalog, diffusion, ecdf, geometry, grow, patch, sample, select, stats, vq, windows
from cellweave.sources import patches as files
from cellweave.streaming import events as streams


def test_windows_are_open_and_start_at_zero(spark):
    df = spark.createDataFrame([(10, 5), (0, 5), (25, 5), (None, 5)], "x int, y int")
    got = {(r.x, r.wx) for r in windows.assign(df, 10, 10).collect()}
    assert got == {(25, 20)}  # 10 lies on an edge, 0 on the first start
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2))]
    got = sorted((r.x, r.y, r.wx, r.wy) for r in windows.assign(spark.createDataFrame(rows, "x int, y int"), 12, 5).collect())
    assert got == sorted((x, y, a, b) for x, y in rows for a in range(0, 100, 5) for b in range(0, 100, 5) if a < x < a + 12 and b < y < b + 12)


def test_merge_of_opposite_scores(spark):
    df = spark.createDataFrame([(1, -2.0), (1, 2.0), (2, 1.0), (2, -3.0), (3, None)], "k int, s double")
    assert {r.k: r.s for r in windows.merge_max_abs(df, ["k"], "s", "keep").collect()} == {1: 2.0, 2: -3.0, 3: None}
    assert {r.k: r.s for r in windows.merge_max_abs(df, ["k"], "s", "zero").where("k < 3").collect()} == {1: 0.0, 2: -3.0}


def test_ecdf_and_lookup(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None), ("a", float("nan")), (None, 7.0)], "k string, f double")
    values = ecdf.melt(df, ["k"], ["f"])
    got = {(r.k, r.v): (r.copies, r.less, r.n) for r in ecdf.ecdf(values, ["k"]).collect()}
    assert got == {("a", 1.0): (1, 0, 4), ("a", 2.0): (2, 1, 4), ("a", 4.0): (1, 3, 4), (None, 7.0): (1, 0, 1)}
    ts = spark.createDataFrame([(0, [2.0, 3.0, 99.0])], "feature int, ts array<double>")
    got = {r.j: r.y for r in ecdf.at_thresholds(values.where("k = 'a'"), ["k"], ts).collect()}
    assert got == {0: 0.25, 1: 0.25, 2: 0.75}


def test_nearest_quantiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "f double").withColumn("k", F.lit(1))
    got = {r.j: r.v for r in ecdf.quantiles(ecdf.melt(df, ["k"], ["f"]), ["k"], [0.01, 0.5, 0.99]).collect()}
    assert got == {0: 10.0, 1: 30.0, 2: 40.0}
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(0, 3, 237), 1)
    levels = [0.01 * (j + 1) for j in range(99)]
    df = spark.createDataFrame([(float(v),) for v in values], "f double").withColumn("k", F.lit(1))
    got = {r.j: r.v for r in ecdf.quantiles(ecdf.melt(df, ["k"], ["f"]), ["k"], levels).collect()}
    x = np.sort(values)
    y = np.arange(len(x)) / len(x)
    assert got == {j: x[np.argmin(np.abs(y - q))] for j, q in enumerate(levels)}


def test_region_vector_of_empty_feature(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", None, None)], "k string, f double, area int")
    ts = spark.createDataFrame([(0, [1.0, 2.0])], "feature int, ts array<double>")
    r = ecdf.region_vector(df, ["k"], ["f"], ts, 224.0 * 224.0).first()
    assert r.vector == [0.0, 0.0, 2.0, 5 / (224 * 224)]
    assert ecdf.region_vector(df.limit(0), ["k"], ["f"], ts, 1.0).count() == 0


@pytest.mark.parametrize("a,b,d", [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 0.0), ([1.0, 2.0], [5.0, 6.0], 1.0), ([1.0, 1.0, 4.0], [1.0, 3.0], 1 / 3)])
def test_ks(spark, a, b, d):
    put = lambda v: spark.createDataFrame([(1, x) for x in v], "k int, v double")
    assert abs(ecdf.ks(put(a), put(b), ["k"]).first().d - d) < 1e-12
    p = spark.range(1).select(ecdf.ks_p_value(F.lit(d), F.lit(50), F.lit(60)).alias("p")).first().p
    assert 1e-300 <= p <= 1 and (d != 0 or p == 1)


def test_polygons(spark):
    square, ell = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(1, square), (2, ell), (3, ell[::-1]), (4, ell[:2]), (5, [])], "i int, vertices array<struct<x:double,y:double>>")
    v = F.col("vertices")
    inside = lambda x, y: geometry.inside(geometry.edges(v), F.lit(x), F.lit(y))
    got = {r.i: r for r in df.select("i", geometry.polygon_area(v).alias("a"), inside(0.5, 1.5).alias("p"), inside(1.5, 1.5).alias("q"), inside(0.5, 0.5).alias("s")).collect()}
    assert [got[i].a for i in (1, 2, 3, 4, 5)] == [1.0, 3.0, 3.0, 0.0, 0.0]
    assert [(got[i].p, got[i].q, got[i].s) for i in (1, 2, 3)] == [(False, False, True), (True, False, True), (True, False, True)]


def test_shift_moves_points_and_polygon_alike(spark):
    ring = [(10.5, 10.5), (60.5, 10.5), (60.5, 60.5), (10.5, 60.5)]
    rng = np.random.default_rng(3)
    p = [("a", int(x), int(y)) for x, y in rng.integers(0, 120, (300, 2))]
    regions = spark.createDataFrame([("a", 1, ring)], "s string, i int, vertices array<struct<x:double,y:double>>")
    points = spark.createDataFrame(p, "s string, x int, y int")
    got = {(r.dx, r.dy): r.n for r in geometry.shift_counts(points, regions, ["s"], [(0, 0), (43, 0), (-43, 43)], ["i"]).collect()}
    assert got == {(dx, dy): n for dx, dy in [(0, 0), (43, 0), (-43, 43)] if (n := sum(10.5 < x - dx < 60.5 and 10.5 < y - dy < 60.5 for _, x, y in p))}


def test_size_class_and_colour(spark):
    df = spark.createDataFrame([(14,), (15,), (51,), (200,), (201,), (None,)], "s int")
    assert [r[0] for r in df.select(select.size_class(F.col("s"))).collect()] == [15, 51, 201, 201, None, None]


def test_grey_keeps_its_mean(spark):
    df = spark.createDataFrame([([0.0, 2.0],), ([3.0, 3.0],)], "p array<double>")
    g = patch.grey_normalise(F.col("p"))
    assert [tuple(r) for r in df.select(g["mean"], g["std"], g["patch"]).collect()] == [(1.0, 1.0, [0.0, 2.0]), (3.0, 1.0, [3.0, 3.0])]


def test_patches(spark):
    p = [float(i) for i in range(9)]
    df = spark.createDataFrame([(p,), (None,)], "p array<double>")
    r = df.select(patch.pad(F.col("p"), 3, 5).alias("q"), patch.rotate(3)("p", F.lit(180.0)).alias("t"), patch.smoothing_error()("p").alias("e")).collect()
    assert np.array_equal(np.array(r[0].q).reshape(5, 5)[1:4, 1:4].ravel(), p) and sum(r[0].q) == sum(p)
    assert np.allclose(r[0].t, p[::-1]) and r[0].e > 0 and r[1].t is None
    wrapped = spark.createDataFrame([(190.0,), (-180.0,), (180.0,), (540.0,)], "a double").select(patch.wrap_angle(F.col("a"))).collect()
    assert [w[0] for w in wrapped] == [-170.0, 180.0, 180.0, 180.0]


def test_labels_gaps_entropy(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, None), (2, 0), (2, 0), (2, 3), (2, 4)], "k int, l int")
    assert {r.k: (r.l, r.n) for r in stats.most_frequent(df, ["k"], "l", 0).collect()} == {1: (5, 2), 2: (3, 1)}
    s = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10, 11, 11)] + [("b", 1), ("c", None)], "k string, v int")
    assert [tuple(r) for r in stats.gap_split(s, ["k"], "v").collect()] == [("a", 3, 7)]
    codes = lambda counts: spark.createDataFrame([(i,) for i, c in enumerate(counts) for _ in range(c)], "c int")
    assert abs(stats.entropy(codes([2, 2]), ["c"]).first().entropy - math.log(2)) < 1e-12
    want = -(4 / 6) * math.log(4 / 6) - (2 / 6) * math.log(2 / 6)
    assert abs(stats.entropy(codes([4, 1, 1]), ["c"], 1).first().entropy - want) < 1e-12


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 200), rng.integers(-4, 5, 200), strict=True)] + [(None, 1.0), (1, None)]
    got = stats.auc(spark.createDataFrame(rows, "l int, s double"), "l", "s").first()
    pos, neg = [s for la, s in rows if la == 1 and s is not None], [s for la, s in rows if la == 0]
    assert abs(got.auc - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12
    assert stats.auc(spark.createDataFrame([], "l int, s double"), "l", "s").first().auc is None


def test_nearest_and_seed(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (300, 6))
    reps = v[:7].copy()
    reps[3] = reps[1]  # a tie: the smaller id
    patches = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "id long, v array<double>")
    book = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(reps)], "rep_id long, vector array<double>")
    got = {r.id: r.rep_id for r in vq.nearest(patches, book, "id", "v").collect()}
    d2 = ((v[:, None] - reps[None]) ** 2).sum(-1)
    assert got == dict(enumerate(d2.argmin(1).tolist()))
    refined = {r.rep_id: r for r in vq.refine(patches, book, "id", "v", 5).collect()}
    for k, r in refined.items():
        assert np.allclose(r.vector, v[d2.argmin(1) == k].mean(0)) and r["count"] == (d2.argmin(1) == k).sum() > 5
    assert len(vq.seed(v, 10, scale=2.0)) == 10
    assert vq.quantise(patches, "id", "v", 12, scale=2.0, rounds=2, least=0).count() <= 12


def test_diffusion_extends_itself(spark):
    rng = np.random.default_rng(6)
    reps = np.concatenate([rng.normal(0, 0.2, (20, 3)), rng.normal(3, 0.2, (20, 3))])
    model = diffusion.fit(reps, 2.0, 100, 2)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(reps)], "id long, v array<double>")
    got = {r.id: r.dm for r in diffusion.transform(rows, model, "id", "v").collect()}
    assert np.allclose([got[i] for i in range(40)], model.vectors, atol=1e-6)
    first = model.vectors[:, 0]
    assert (first[:20] * first[20:]).max() < 0  # the first coordinate tells the two clouds apart


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(90)], "i long, s string")
    got = sample.stratified_files(df, "s", "i", 2, 30).collect()
    assert sorted((r.s, r.file) for r in got) == sorted([("a", k) for k in (0, 1)] * 20 + [("b", k) for k in (0, 1)] * 10)
    assert len({r.i for r in got}) == 60
    assert [r.pos for r in sample.permute(df, "i").collect()] == list(range(90))
    assert sample.per_group(df, ["s"], "i", 7).groupBy("s").count().where("count = 7").count() == 2
    assert [r.i for r in sample.every_kth(df, "s", "i", 20).orderBy("i").collect() if r.s == "a"] == list(range(0, 60, 3))
    drawn = sample.proportional_draws(df, "s", "i", 30).collect()
    assert len({r.i for r in drawn}) == len(drawn) == 30


def test_catalogue(spark, tmp_path):
    parent = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k int, v string")
    assert sorted(r.k for r in catalog.pending(parent, parent.where("k = 1"), ["k"]).collect()) == [2]
    added = catalog.insert_ignore(spark.createDataFrame([(1, "old")], "k int, v string"), parent.where("k IS NOT NULL"), ["k"])
    assert sorted(map(tuple, added.collect())) == [(1, "old"), (2, "y")]
    assert sorted(map(tuple, catalog.override([parent.where("k = 1"), spark.createDataFrame([(1, "new")], "k int, v string")], ["k"]).collect())) == [(1, "new")]
    with pytest.raises(ValueError):
        catalog.fetch_one(parent, "v")
    c = catalog.Catalog(spark, f"file://{tmp_path}")
    c.declare("parent", ["k"])
    c.declare("child", ["k"], "parent", lambda df: df.groupBy("k").agg(F.count("*").alias("n")))
    c.insert("parent", parent.where("k IS NOT NULL"))
    assert c.populate("child") == 2 and c.populate("child") == 0
    c.insert("parent", spark.createDataFrame([(2, "again"), (3, "w")], "k int, v string"))
    assert c.populate("child") == 1 and sorted(r.k for r in c.read("child").collect()) == [1, 2, 3]


def test_half_precision_files(spark, tmp_path):
    data = np.arange(32, dtype="<f2").reshape(2, 16)
    (tmp_path / "a.bin").write_bytes(data.tobytes())
    got = sorted((r.i, r.patch) for r in files.read_half(spark, f"file://{tmp_path}/a.bin", 4).collect())
    assert got == [(0, data[0].tolist()), (1, data[1].tolist())]
    (tmp_path / "b.bin").write_bytes(data.tobytes()[:-1])
    with pytest.raises(Exception, match="ends within a patch"):
        files.read_half(spark, f"file://{tmp_path}/b.bin", 4).collect()


def test_growing_and_marks(spark):
    rows = [(1, 0, 0, 9.0), (1, 10, 0, 6.0), (1, 20, 0, 5.0), (1, 30, 0, 1.0), (1, 100, 100, 4.0), (1, 110, 100, 0.5)]
    got = {(r.wx, r.wy): r.region for r in grow.grow(spark.createDataFrame(rows, "p int, wx int, wy int, score double"), ["p"], 10).collect()}
    assert got == {(0, 0): "0_0", (10, 0): "0_0", (20, 0): "0_0", (100, 100): "100_100"}
    df = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, None)], "i int, std double")
    ranges = spark.createDataFrame([("std", 4.0, 10.0, "m")], "feature string, low double, high double, mark string")
    assert {r.i: r.marks for r in grow.mark_cells(df, ranges, ["std"]).collect()} == {1: ["m"], 2: [], 3: []}


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(f"2020-01-01 0{i % 3}:{i % 60:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "event_type", "value")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", df.schema)
    seen = []
    q = streams.work_off(stream, lambda batch, i: seen.append(batch.count()), f"{tmp_path}/check")
    q.awaitTermination()
    assert sum(seen) == 100
    q = streams.work_off(stream, lambda batch, i: seen.append(batch.count()), f"{tmp_path}/check")
    q.awaitTermination()
    assert sum(seen) == 100  # nothing is handed over twice
    assert sum(r.n for r in streams.windowed_counts(df, "1 hour").collect()) == 100


def test_long_moving_average(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(v)) for k, n in (("a", 2500), ("b", 3), ("c", 900)) for i, v in enumerate(rng.normal(5, 2, n))]
    got = {(r.k, r.i): r.ema for r in stats.moving_average(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v").collect()}
    for k in "abc":
        own = [v for kk, _, v in rows if kk == k]
        m = float(np.mean(own[:10]))
        for i, v in enumerate(own):
            m = 0.95 * m + 0.05 * v
            assert abs(got[k, i] - m) < 1e-9


def test_interpolation_and_owners(spark):
    put = lambda v: spark.createDataFrame([(1, x) for x in v], "k int, v double")
    got = {r.v: r.y for r in ecdf.interpolated_heights(put([0.0, 1.5, 9.0]), put([1.0, 2.0]), ["k"]).collect()}
    assert got == {0.0: (0 + 0) / 2, 1.5: (1 / 3 + 0.25) / 2, 9.0: (2 / 3 + 0.5) / 2}
    got = {r.i: (r.wx, r.wy) for r in windows.owners(spark.createDataFrame([(1, 11, 9), (2, 0, 5), (3, None, 1)], "i int, x int, y int"), "i", 10, 5).collect()}
    assert got == {1: (5, 5)}
    r = stats.autocorrelation(spark.createDataFrame([(1, i, float(i % 2)) for i in range(10)] + [(2, 1, 3.0)], "k int, p int, v double"), ["k"], "p", "v", 2).collect()
    assert {(x.lag, round(x.r, 9), x.n) for x in r} == {(0, 1.0, 10), (1, -1.0, 9), (2, 1.0, 8)}


def test_seeding_scale_changes_on_every_row():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (400, 3))
    draw, reps, scale = np.random.default_rng(7), [v[0]], 5.0
    for row in v[1:]:
        if len(reps) >= 40:
            break
        p = min(min(((row - r) ** 2).sum() for r in reps), 100_000.0) / scale
        if draw.random() < p:
            reps.append(row)
        scale = scale * 2 if p > 0.5 else max(1.0, scale - 1)
    assert np.array_equal(vq.seed(v, 40, scale=5.0, rng=np.random.default_rng(7)), np.array(reps))


def test_normalised_patch_by_a_plain_loop(spark):
    side, patches = 9, np.random.default_rng(5).gamma(1.0, 1.0, (12, 81))

    def moments(m):
        y, x = np.mgrid[0 : m.shape[0], 0 : m.shape[1]]
        w = m / m.sum()
        cx, cy = (w * x).sum(), (w * y).sum()
        return cx, cy, (w * x * x).sum() - cx * cx, (w * y * y).sum() - cy * cy, (w * x * y).sum() - cx * cy

    def turn(m, degrees):
        out, c, a = np.zeros_like(m), m.shape[0] // 2, math.radians(degrees)
        for i in range(m.shape[0]):
            for j in range(m.shape[0]):
                x, y = math.cos(a) * (j - c) + math.sin(a) * (i - c) + c, -math.sin(a) * (j - c) + math.cos(a) * (i - c) + c
                for k in (math.floor(y), math.floor(y) + 1):
                    for n in (math.floor(x), math.floor(x) + 1):
                        if 0 <= k < m.shape[0] and 0 <= n < m.shape[0]:
                            out[i, j] += m[k, n] * (1 - abs(y - k)) * (1 - abs(x - n))
        return out

    def upright(m, mask):
        _, _, xx, yy, xy = moments(m)
        confidence = abs((xx - yy) / xy) if xy else 0
        part = 0.5 - math.atan(2 * xy / (xx - yy)) / math.pi if confidence > 0.1 else 0
        angle = ((part - 1 if part > 0.5 else part) + np.sign(xy) / 2) * 90
        out = turn(m, angle) * mask
        cx, cy, *_ = moments(out)
        dx, dy = cx - m.shape[0] // 2, cy - m.shape[0] // 2
        return (out[::-1, ::-1] if (dx < 0 if abs(dx) > abs(dy) else dy < 0) else out), angle, confidence

    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(patches)] + [(99, None)], "i int, p array<double>")
    got = {r.i: r.n for r in df.select("i", patch.normalise()("p").alias("n")).collect()}
    assert got[99].padded_size is None and got[99].rotation is None
    for i, p in enumerate(patches):
        m = p.reshape(side, side)
        cx, cy, *_ = moments(m)
        x, y = round(cx), round(cy)
        r = math.ceil(max(math.hypot(a, b) for a in (x, side - x) for b in (y, side - y)))
        circle = np.zeros((2 * r + 1, 2 * r + 1))
        circle[r - y : r - y + side, r - x : r - x + side] = m
        off = np.arange(-r, r + 1)
        mask = np.hypot(off[:, None], off[None]) < r + 0.1
        once, a, _ = upright(circle / circle.std(), mask)
        twice, b, confidence = upright(once, mask)
        _, _, xx, yy, _ = moments(twice)
        to = min(s for s in (15, 51, 201) if 2 * r + 1 < s)
        n = got[i]
        assert n.padded_size == to and np.allclose([n.rotation, n.rotation_confidence, n.horiz_std, n.vert_std, n.mean, n.std], [a + b, confidence, xx**0.5, yy**0.5, circle.mean(), circle.std()], rtol=1e-6)
        at = (to - 2 * r - 1) // 2
        assert np.allclose(np.array(n.padded_patch).reshape(to, to)[at : to - at, at : to - at], twice, atol=1e-6)


def test_catalogue_sizes_deletes_and_drops(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    c.declare("a", ["k"])
    c.declare("b", ["k"], "a", lambda rows: rows.select("k"))
    c.insert("a", spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string"))
    c.populate("b")
    c.delete("a", spark.createDataFrame([(3,), (4,), (99,)], "k int"))
    assert c.size("a") > 0 and sorted(r.k for r in c.read("a").collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        c.drop("a")
    c.drop("b")
    c.drop("a")
    assert not c.exists("a") and not c.exists("b")
