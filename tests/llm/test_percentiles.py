import math

import numpy as np
from pyspark.sql import functions as F

from cellweave.llm.percentiles import merge, percentiles, sketch

RANKS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def test_error_bound_and_merging(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 4, 3000), -rng.lognormal(0, 3, 1500), np.zeros(200), [math.inf, -math.inf]])
    rows = [("a" if i % 3 else None, int(i % 4), float(v)) for i, v in enumerate(values)] + [("a", 0, None), ("a", 0, float("nan")), ("empty", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("field", F.lit("clash"))
    days = sketch(df.drop("field"), ["g", "day"], ["v"], 0.01)
    whole = percentiles(days.drop("day"), ["g"], RANKS, 0.01).collect()
    assert sorted(str(r.g) for r in whole) == ["None", "a"]
    direct = {r.g: r for r in percentiles(sketch(df.drop("field"), ["g"], ["v"], 0.01), ["g"], RANKS, 0.01).collect()}
    for r in whole:
        own = sorted(v for g, _, v in rows if g == r.g and v is not None and not math.isnan(v))
        assert r.n == len(own) and direct[r.g] == r
        for name, q in RANKS.items():
            true = own[max(1, math.ceil(q * len(own))) - 1]
            assert abs(r[name] - true) <= 0.01 * abs(true) * (1 + 1e-9) or r[name] == true


def test_merge_adds_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0)], "g string, v double")
    s = sketch(df, ["g"], ["v"])
    assert sorted((r.g, r.n) for r in merge(s.unionByName(s), ["g"]).collect()) == [("a", 4), ("b", 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(sketch(df, ["g"], ["v"]), ["g"], RANKS).count() == 0
