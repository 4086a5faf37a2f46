from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators.compaction import compact, digest, hilbert_code
from cellweave.operators.ranking import global_prefix
from cellweave.sources.cell_files import distinct_cells, parse_cell_files

FILES = "file_id long, file_path string, n_bytes long, written_at string, file_text string"


def files(spark, *texts, path="cells/QX1/0110/part-0.csv"):
    return spark.createDataFrame([(i, path, 0, f"2020-01-0{i + 1}", t) for i, t in enumerate(texts)], FILES)


def cells(df):
    return sorted((r.stack, r.section, r.x, r.y, r.area, r.height) for r in df.collect())


def test_hilbert_visits_neighbours():
    g = np.stack(np.meshgrid(range(8), range(8), range(8), indexing="ij"), -1).reshape(-1, 3)
    code = hilbert_code([g[:, 0], g[:, 1], g[:, 2]], 3)
    assert sorted(code) == list(range(512))
    steps = np.abs(np.diff(g[np.argsort(code)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_layouts_cut_lines_and_remarks(spark):
    f = files(
        spark,
        "110,1,2,30,4\n110,5.000,6.0,70,8\n110,9,1",
        "﻿# remark\ny|section|height|area|x\n2|0110|4|30|1\n\n7|110|8|9|6",
        '{"section": 110, "x": 11, "y": 12, "area": 13, "height": 14}\n{"height": 1, "x"\n',
        "110 , 21 , 22 , 23 , 24\r\n110\t31\t32\t33\t34\r\nx;y;section;area;height\n41;42;110;43;44\n",
        None,
        "",
    )
    got = cells(distinct_cells(parse_cell_files(f)))
    assert got == [("QX1", 110, 1, 2, 30, 4), ("QX1", 110, 5, 6, 70, 8), ("QX1", 110, 6, 7, 9, 8), ("QX1", 110, 11, 12, 13, 14), ("QX1", 110, 21, 22, 23, 24), ("QX1", 110, 31, 32, 33, 34), ("QX1", 110, 41, 42, 43, 44)]


def test_last_write_wins_and_paths(spark):
    f = files(spark, "110,1,2,30,4\n", "110,1,2,31,5\n", path="cells/stack=QX7/section=110/tile.txt").unionByName(files(spark, "1,1,1,1,1\n", path="nowhere"))
    assert cells(distinct_cells(parse_cell_files(f))) == [("QX7", 110, 1, 2, 31, 5)]


def test_compact_keeps_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else None, int(i % 5), int(x), int(y) if i % 11 else None, i) for i, (x, y) in enumerate(rng.integers(-50, 50, (600, 2)))]
    rows += [("hot", 1, 7, 7, 1)] * 300
    df = spark.createDataFrame(rows, "stack string, section int, x int, y int, _code int")
    done = compact(df, ["stack"], ["section", "x", "y"], rows_per_file=100)
    back = spark.read.schema(df.schema).parquet(done.path)
    assert Counter(map(tuple, back.collect())) == Counter(rows)
    assert digest(back, df.columns) == done.digest
    sizes = [r["count"] for r in back.groupBy(back._metadata.file_path if hasattr(back, "_metadata") else "_metadata.file_path").count().collect()]
    assert done.files == 9 and len(sizes) == 9 and max(sizes) <= 2 * min(sizes)  # equal rows are spread too


def test_box_meets_few_files(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(s), int(x), int(y)) for s, x, y in zip(rng.integers(0, 400, 20_000), rng.integers(0, 50_000, 20_000), rng.integers(0, 50_000, 20_000), strict=True)]
    df = spark.createDataFrame(rows, "stack string, section int, x int, y int")
    done = compact(df, ["stack"], ["section", "x", "y"], rows_per_file=320)
    back = spark.read.schema(df.schema).parquet(done.path).select("*", F.col("_metadata.file_path").alias("f"))
    spans = back.groupBy("f").agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in ("section", "x")], *[F.max(c).alias(f"hi_{c}") for c in ("section", "x")]).collect()
    assert done.files == len(spans) == 63 and max(r.n for r in spans) <= 2 * min(r.n for r in spans)
    assert sum(r.lo_section <= 200 <= r.hi_section for r in spans) <= 32 and sum(r.lo_x <= 25_000 <= r.hi_x for r in spans) <= 32


def test_several_files_for_few_rows(spark):
    df = spark.createDataFrame([("a", i % 7, i, -i) for i in range(1_000)], "stack string, section int, x int, y int")
    done = compact(df, ["stack"], ["section", "x", "y"])
    sizes = [r["count"] for r in spark.read.schema(df.schema).parquet(done.path).groupBy("_metadata.file_path").count().collect()]
    assert done.files == len(sizes) == 8 and max(sizes) <= 2 * min(sizes)


def test_compact_empty(spark):
    df = spark.createDataFrame([], "stack string, section int, x int, y int")
    done = compact(df, ["stack"], ["section", "x", "y"])
    assert done.rows == 0 and spark.read.schema(df.schema).parquet(done.path).count() == 0


def test_global_prefix(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "k int, v int")
    got = {r.k: r.start for r in global_prefix(df, ["k"], "v").collect()}
    total = 0
    for i in range(200):
        assert got[i] == total
        total += (i * 7) % 5
