import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellweave.llm.components import components, group_records, split_groups
from cellweave.llm.queries import structure_of


def brute(pairs):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for a in parent:
        groups[root(a)].add(a)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small", [100_000, 3])
def test_components(spark, small):
    random.seed(6)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (7, 7)] + [(random.randint(2000, 2100), random.randint(2000, 2100)) for _ in range(70)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), small).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert len(got) == len({r.node for r in got}) and {frozenset(g) for g in groups.values()} == brute(pairs)


def test_group_records(spark):
    rows = [(1, "s1", "x"), (2, "s1", None), (3, None, "x"), (4, None, None), (5, "x", "s1"), (6, "s2", "y"), (7, "s3", "y"), (8, "s3", "z"), (9, None, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string").withColumn("node", F.lit(1)).withColumn("component", F.lit(2))
    got = {r.i: r.group_id for r in group_records(df, "i", [F.col("a"), F.col("b")]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9}
    assert group_records(df.limit(0), "i", [F.col("a")]).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, i // 4) for i in range(4000)]
    grouped = spark.createDataFrame(rows, "i long, group_id long")
    split = {r.group_id: r.split for r in split_groups(grouped, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert len(split) == 1000
    n = Counter(split.values())
    assert abs(n["train"] - 800) <= 1 and abs(n["validation"] - 100) <= 1 and abs(n["test"] - 100) <= 1


def test_structure_names(spark):
    names = {
        "2K_L": "2K|L", "2k (left)": "2k|L", "2kk-L": "2k|L", " SNQ_R.npy": "SNQ|R", "Pm.r": "Pm|R", "RuTh v2": "RuTh|", "13M (2)": "13M|", "LD__L": "LD|L", "Amv (right)_surround_500um_noclass": "Amv|R",
        "2K_R_surround_200um": "2K|R", "SD\t": "SD|", "5K_R_v3": "5K|R", "": None, None: None, "LD": "LD|",
    }
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", structure_of(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == names


def test_hubs_and_giant_groups(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, 1_000 + i) for i in range(1, 50)] + [(5_000, 5_001)]
    groups = defaultdict(set)
    for r in components(spark.createDataFrame(pairs, "a long, b long"), small=2, hub=20).collect():
        groups[r.component].add(r.node)
    assert {frozenset(g) for g in groups.values()} == brute(pairs)
    rows = [(i, "all" if i % 3 == 0 else f"k{i}", f"s{i // 2}") for i in range(300)]
    got = {r.i: r.group_id for r in group_records(spark.createDataFrame(rows, "i long, a string, b string"), "i", [F.col("a"), F.col("b")], hot=20).collect()}
    links = [((0, a), (1, b)) for _, a, b in rows]
    want = {n: g for g in brute(links) for n in g}
    assert len(got) == 300 and all((got[i] == got[j]) == (want[0, rows[i][1]] is want[0, rows[j][1]]) for i in range(0, 300, 7) for j in range(300))
