import numpy as np
import pytest

from cellweave.llm.clusters import embedding_kmeans, gather_near, local_balls, power_iterate, spectral_clusters, typical_members

V = ["v0", "v1", "v2"]
SCHEMA = "cell_id long, v0 double, v1 double, v2 double, area int, padded_size int, group_id string"


def brute(rows, least=5):
    ok = [r for r in rows if None not in r[1:6] and not any(x != x for x in r[1:4])]
    similar = lambda a, b: a[5] == b[5] and sum((x - y) ** 2 for x, y in zip(a[1:4], b[1:4], strict=True)) <= 1 and max(a[4], b[4]) <= 2 * min(a[4], b[4])
    near = {a[0]: frozenset(b[0] for b in ok if similar(a, b)) for a in ok}
    return {i: min(n) for i, n in near.items() if len(n) >= least and i in n and all(near[j] == n for j in n)}


def data(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0

    def put(centre, area, size, n, spread=0.15):
        nonlocal k
        for _ in range(n):
            k += 1
            rows.append((k, *(float(x) for x in np.round(centre + rng.normal(0, spread, 3), 4)), int(area + rng.integers(0, 3)), size, "x"))

    for c in range(8):
        put(rng.uniform(-20, 20, 3), 30 + 10 * c, 15, int(rng.integers(3, 40)))
    put(np.array([50.0, 0, 0]), 30, 15, 12)
    put(np.array([50.0, 0, 0]), 30, 51, 12)  # elsewhere by size class
    put(np.array([60.0, 0, 0]), 62, 15, 12)  # on both sides of a power of two
    put(np.array([70.0, 0, 0]), 30, 15, 12)
    put(np.array([70.0, 0.9, 0]), 30, 15, 1, 0.01)  # near some of the others only
    put(np.array([80.0, 0, 0]), 30, 15, 12)
    put(np.array([80.0, 0, 0]), 100, 15, 9)  # other areas
    put(np.array([90.0, 0, 0]), 30, 15, 40, 0.6)  # no clique
    put(np.array([100.0, 0, 0]), 0, 15, 0)
    copies = [(k + 1 + i, 5.0, 5.0, 55.0, 40, 15, "x") for i in range(7)] + [(k + 10 + i, -5.0, 5.0, 55.0, -1, 15, "x") for i in range(7)] + [(k + 20 + i, -5.0, -5.0, 55.0, 0, 15, "x") for i in range(6)]
    odd = [(k + 30, None, 1.0, 1.0, 3, 15, "x"), (k + 31, float("nan"), 1.0, 1.0, 3, 15, "x"), (k + 32, 1.0, 1.0, 1.0, None, 15, "x"), (k + 33, 1.0, 1.0, 1.0, 3, None, "x")]
    return rows + copies + odd


@pytest.mark.parametrize("seed,sampled", [(1, 30_000), (2, 0)])
def test_against_brute_force(spark, seed, sampled):
    rows = data(seed)
    want = brute(rows)
    assert len(set(want.values())) >= 8
    df = spark.createDataFrame(rows, SCHEMA)
    members = spectral_clusters(df, "cell_id", V, "area", "padded_size", sample_rows=sampled)
    got = {r.cell_id: r.group_id for r in members.collect()}
    assert got == want
    if seed == 1:
        at = {r[0]: np.array(r[1:4]) for r in rows if r[0] in want}
        for r in typical_members(members, df, "cell_id", V).collect():
            own = [i for i in want if want[i] == r.group_id]
            value = {i: sum(1 - ((at[i] - at[j]) ** 2).sum() for j in own) for i in own}
            assert r["size"] == len(own) and abs(value[r.typical[0]] - max(value.values())) < 1e-3


def test_empty(spark):
    assert spectral_clusters(spark.createDataFrame([], SCHEMA), "cell_id", V, "area", "padded_size").count() == 0


def cliques():
    rng = np.random.default_rng(4)
    return [(2_000 * c + i, 1, 15.0, 100.0 + i % 40, [float(x) for x in 6.0 * c + rng.normal(0, 0.08, 10)]) for c in range(5) for i in range(2_000)]


def test_gathering_needs_no_sample(spark):
    rows = cliques()
    balls = local_balls(spark.createDataFrame(rows, "id long, n long, s double, lo double, v array<double>"), 1.0, 2.0, 0.5 - 1e-6, capacity=500, hot=700).collect()
    assert sorted(r.id for r in balls) == list(range(10_000))
    members = {}
    for r in balls:
        members.setdefault(r.ball, []).append(r)
    assert len(members) < 400 and sum(r.c is not None for r in balls) == len(members)  # so their links are few, whatever the number of rows
    for ball, own in members.items():
        v = np.array([r.v for r in own])
        assert ball == min(r.id for r in own) and ((v[:, None] - v[None]) ** 2).sum(-1).max() <= 1 and max(r.lo for r in own) <= 2 * min(r.lo for r in own)


def test_whole_cliques_without_sample(spark):
    df = spark.createDataFrame([(i, *v, int(lo), 15) for i, _, _, lo, v in cliques()], "id long, " + ", ".join(f"v{k} double" for k in range(10)) + ", area int, size int")
    got = spectral_clusters(df, "id", [f"v{k}" for k in range(10)], "area", "size", sample_rows=0).collect()
    assert {r.id: r.group_id for r in got} == {i: i // 2_000 * 2_000 for i in range(10_000)}


def test_gather_near_scattered():
    v = np.random.default_rng(1).uniform(-50, 50, (3_000, 4))
    ball, dist, centres = gather_near(np.concatenate([v, v[:5]]), np.zeros(3_005), 0.4)
    assert dist.max() <= 0.4 and (ball[:5] == ball[3_000:]).all() and len(centres) > 2_900
    assert len(gather_near(np.zeros((0, 4)), np.zeros(0), 0.4)[0]) == 0


def test_embedding_parts_cliques_joined_by_a_few_links(spark):
    pairs = [(a, b) for c in (0, 100) for a in range(c, c + 40) for b in range(c, c + 40) if a != b] + [(0, 100), (100, 0), (1, 101), (101, 1)]
    links = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long")
    nodes = spark.createDataFrame([(i, 1) for c in (0, 100) for i in range(c, c + 40)], "id long, n long")
    centre = {r.id: r.centre for r in embedding_kmeans(power_iterate(nodes, links), 5).collect()}
    main = [{centre.get(i) for i in range(c + 2, c + 40)} for c in (0, 100)]
    assert len(main[0]) == len(main[1]) == 1 and main[0] != main[1] and None not in main[0] | main[1]


def test_far_points_join_no_centre(spark):
    rows = [(i, 1, 5, 100, 100, 100, 100) for i in range(5)] + [(9, 1, 1, 100, 100, 1 << 29, 100)]
    at = spark.createDataFrame(rows, "id long, n long, degree long, e0 long, e1 long, e2 long, e3 long")
    assert {r.id: r.centre for r in embedding_kmeans(at, 5).collect()} == {i: 0 for i in range(5)}


def test_members_of_a_clique_keep_equal_values(spark):
    sizes = [1 + i % 7 for i in range(60)]
    nodes = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    links = spark.createDataFrame([(a, b, sizes[b]) for a in range(60) for b in range(60) if a != b], "a long, b long, w long")
    assert power_iterate(nodes, links.repartition(7)).select("e0", "e1", "e2", "e3").distinct().count() == 1
