"""What queries must not leave out, on small tables made here."""

import math

import numpy as np
from pyspark.sql import functions as F

from cellweave import session
from cellweave.operators import geometry, grow
from cellweave.plans import more, reference  # noqa: F401  # they fill the registry
from cellweave.plans.registry import QUERIES
from cellweave.schema import FEATURES


def test_significance_sees_every_feature_at_both_window_sizes(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x, y = (int(v) for v in rng.integers(1, 1340, 2))
        values = {f: float(v) for f, v in zip(FEATURES, rng.normal(0, 1, len(FEATURES)), strict=True)}
        if 672 < x < 896 and 672 < y < 896:
            values["width"] += 50.0  # stands out in this feature and in one 224-pixel window only
        rows.append(("a", 1, x, y, *values.values()))
    spark.createDataFrame(rows, "stack string, section int, x int, y int, " + ", ".join(f"{f} double" for f in FEATURES)).write.parquet(f"{tmp_path}/features.parquet")
    got = {(r.window, r.wx, r.wy): r for r in QUERIES["significance_map"](spark, str(tmp_path)).collect()}
    table = np.array([r[2:] for r in rows])
    for (window, wx, wy), r in got.items():
        inner = table[(table[:, 0] > wx) & (table[:, 0] < wx + window) & (table[:, 1] > wy) & (table[:, 1] < wy + window)]
        assert r.n == len(inner) > 0
        scores = []
        for k in range(2, 22):
            at = table[:, k]
            d = max(abs((inner[:, k] <= v).mean() - (at <= v).mean()) for v in at)
            e = math.sqrt(len(inner) * len(table) / (len(inner) + len(table)))
            z = (e + 0.12 + 0.11 / e) * d
            p = 1.0 if z < 0.2 else sum((2.0 if j % 2 else -2.0) * math.exp(-2 * j * j * z * z) for j in range(1, 101))
            scores.append(-math.log(max(1e-300, min(1.0, p))))
        assert abs(r.score - sum(sorted(scores)[-5:])) < 1e-6
    starts = {(w, a, b) for w in (448, 224) for a in range(0, 1340, w // 2) for b in range(0, 1340, w // 2)}
    assert set(got) == {(w, a, b) for w, a, b in starts if ((table[:, 0] > a) & (table[:, 0] < a + w) & (table[:, 1] > b) & (table[:, 1] < b + w)).any()}
    assert max((k for k in got if k[0] == 224), key=lambda k: got[k].score) == (224, 672, 672)


def test_regions_grow_to_their_end(spark):
    rows = [(1, i * 10, 0, 9.0 - 0.1 * i) for i in range(45)] + [(1, 450, 0, 1.0)]  # one seed, 44 rings
    got = grow.grow(spark.createDataFrame(rows, "p int, wx int, wy int, score double"), ["p"], 10).collect()
    assert sorted((r.wx, r.region) for r in got) == [(i * 10, "0_0") for i in range(45)]


def test_shift_search_covers_the_range_sections_and_ring(spark):
    rng = np.random.default_rng(9)
    ell = [(400.0, 400.0), (520.0, 400.0), (520.0, 460.0), (460.5, 460.0), (470.0, 530.0), (400.0, 520.0)]
    points = [("a", s, int(x), int(y), float(v)) for s in (3, 5, 9) for x, y, v in rng.integers(0, 1000, (60, 3))] + [("b", 3, 450, 450, 1.0)]
    regions = spark.createDataFrame([("a", 4, "r", ell)], "stack string, section int, name string, vertices array<struct<x:double,y:double>>")
    cells = spark.createDataFrame(points, "stack string, section int, x int, y int, area double")
    found = geometry.shift_search(cells, regions, "stack", "section", "name", (6, 5, 2), 43, 90.0, F.col("area")).collect()
    got = {(r.dx, r.dy, r.dz): (r.positive, r.negative, r.positive_total, r.negative_total) for r in found}

    def state(x, y):
        odd, least = False, math.inf
        for (ax, ay), (bx, by) in zip(ell, ell[1:] + ell[:1], strict=True):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            least = min(least, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return 0 if odd else 1 if least <= 90 else None

    want = {}
    for dx in range(-6, 7):
        for dy in range(-5, 6):
            for s, x, y, v in [p[1:] for p in points if p[0] == "a" and abs(p[1] - 4) <= 2]:
                if (k := state(x - dx * 43, y - dy * 43)) is not None:
                    w = want.setdefault((dx * 43, dy * 43, s - 4), [0, 0, 0.0, 0.0])
                    w[k] += 1
                    w[k + 2] += v
    assert got == {k: tuple(w) for k, w in want.items()} and {k[2] for k in got} == {-1, 1}


def test_small_brains_get_their_share_of_the_files(spark, tmp_path):
    rows = [(i, "small" if i < 2 else "large") for i in range(3000)]  # less than 0.1 % of all rows
    spark.createDataFrame(rows, "cell_id long, stack string").write.parquet(f"{tmp_path}/features.parquet")
    got = {(r.cell_id, r.stack, r.file) for r in QUERIES["stratified_files"](spark, str(tmp_path)).collect()}
    want = set()
    for stack in ("small", "large"):
        own = sorted((i for i, s in rows if s == stack), key=lambda i: ((i * 48271 + 12345) % 2147483647, i))
        share = math.floor(len(own) / 3000 * 100_000)
        want |= {(i, stack, k // share) for k, i in enumerate(own) if share and k // share < 20}
    assert got == want and {s for _, s, _ in got} == {"small", "large"}


def test_significance_writes_no_row_for_each_window_and_feature(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [("a" if i % 4 else "b", i % 3 // 2 + 1, *(int(v) for v in rng.integers(0, 900, 2)), *(None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 9, len(FEATURES)))) for i in range(2000)]
    spark.createDataFrame(rows, "stack string, section int, x int, y int, " + ", ".join(f"{f} double" for f in FEATURES)).coalesce(1).write.parquet(f"{tmp_path}/features.parquet")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    monkeypatch.setitem(session._OWN, spark.sparkContext.applicationId, f"file://{tmp_path}/shared")
    get = lambda: {(r.window, r.stack, r.section, r.wx, r.wy): (r.n, round(r.score, 9)) for r in QUERIES["significance_map"](spark, str(tmp_path)).collect()}
    whole = get()
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) <= 4 * size
    monkeypatch.setattr(grow, "PLANE_VALUES", 120)  # planes are shared out by features
    assert get() == whole and len({k[1:3] for k in whole}) == 4


def test_regions_grow_without_a_job_for_each_ring(spark):
    rng = np.random.default_rng(11)
    rows = [(p, i * 10, j * 10, float(round(rng.random() * 9, 1))) for p in (1, 2) for i in range(-2, 22) for j in range(22) if rng.random() < 0.8] + [(3, i * 10, 0, 9.0 - 0.1 * i) for i in range(45)]
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("growing", "")
    got = {(r.p, r.wx, r.wy): r.region for r in grow.grow(spark.createDataFrame(rows, "p int, wx int, wy int, score double"), ["p"], 10).collect()}
    jobs = len(status.getJobIdsForGroup("growing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    score, want = {r[:3]: r[3] for r in rows}, {}
    near = lambda k: [w for i in (-10, 0, 10) for j in (-10, 0, 10) if (i or j) and (w := (k[0], k[1] + i, k[2] + j)) in score]
    full = lambda k: (score[k], *k)
    edge = {k: k for k in score if score[k] > 0 and all(full(k) > full(w) for w in near(k))}
    while edge:
        want |= edge
        claims = {}
        for k, seed in edge.items():
            for w in near(k):
                if w not in want and score[w] >= 0.5 * score[seed]:
                    claims[w] = max(claims.get(w, seed), seed, key=full)
        edge = claims
    assert got == {k: f"{seed[1]}_{seed[2]}" for k, seed in want.items()} and jobs <= 4


def test_shift_search_counts_outlines_of_one_name_together_and_tiles_alike(spark):
    rng = np.random.default_rng(12)
    shape = "stack string, section int, name string, vertices array<struct<x:double,y:double>>"
    bow, far = [(-60.0, -50.0), (60.0, 70.0), (60.0, -50.0), (-60.0, 70.0)], [(900.0, 900.0), (1000.0, 905.0), (950.0, 1010.5)]
    points = [("a", int(s), int(x), int(y), 2) for s, x, y in zip(rng.integers(1, 4, 400), *rng.integers(-300, 1300, (2, 400)), strict=True)]
    cells = spark.createDataFrame(points, "stack string, section int, x int, y int, area int")

    def search(rows, **more):
        found = geometry.shift_search(cells, spark.createDataFrame(rows, shape), "stack", "section", "name", (3, 2, 1), 43, 50.0, F.col("area"), **more).collect()
        return {(r.name, r.dx, r.dy, r.dz): np.array([r.positive, r.negative, r.positive_total, r.negative_total]) for r in found}

    apart = search([("a", 2, "p", bow), ("a", 3, "q", far)])
    want = {}
    for (_, *k), v in apart.items():
        want[("r", *k)] = want.get(("r", *k), 0) + v
    for tile in (4096, 256):
        got = search([("a", 2, "r", bow), ("a", 3, "r", far)], tile=tile)
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in got)
