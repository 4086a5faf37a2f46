from cellweave.operators.skew import lookup


def test_lookup(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 5}") for i in range(300)], "i int, k string")
    table = spark.createDataFrame([("hot", 1, "a"), ("k1", 2, "b"), ("k2", 3, None), ("other", 4, "d")], "k string, v int, w string")
    heavy = df.groupBy("k").count().where("count > 90 AND k IS NOT NULL")
    known = {"hot": (1, "a"), "k1": (2, "b"), "k2": (3, None)}
    got = sorted((r.i, r.k, r.v, r.w) for r in lookup(df, table, "k", heavy).collect())
    assert got == [(r.i, r.k, *known.get(r.k, (None, None))) for r in sorted(df.collect())]
    assert lookup(df.limit(0), table, "k", heavy).count() == 0 and lookup(df, table.limit(0), "k", heavy.limit(0)).where("v IS NULL").count() == 300
