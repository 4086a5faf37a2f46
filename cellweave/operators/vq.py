"""Vector quantisation of patches: seeding, nearest representatives, refinement, code tuples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_REPRESENTATIVES = 50_000  # a codebook is sent to every task; a larger one is refused


def codebook(reps: DataFrame, rep_id: str = "rep_id", vector: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a codebook of checked size, by id."""
    rows = reps.select(rep_id, vector).orderBy(rep_id).limit(MOST_REPRESENTATIVES + 1).collect()
    if len(rows) > MOST_REPRESENTATIVES:
        raise ValueError(f"more than {MOST_REPRESENTATIVES} representatives")
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)


def closest(v: np.ndarray, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, squared distance) of the nearest of ``c`` to every row; near-ties are decided by exact distances, ties by the smaller id."""
    best, dist = np.empty(len(v), dtype=np.int64), np.empty(len(v))
    for at in range(0, len(v), 512):
        some = v[at : at + 512]
        d2 = (some * some).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * some @ c.T
        close = d2 <= d2.min(axis=1)[:, None] + 1e-6 * (1 + np.abs(d2.min(axis=1)))[:, None]
        i, j = np.nonzero(close)
        exact = ((some[i] - c[j]) ** 2).sum(1)
        order = np.lexsort((ids[j], exact, i))
        first = np.unique(i[order], return_index=True)[1]
        best[at : at + 512], dist[at : at + 512] = j[order][first], exact[order][first]
    return best, dist


def nearest(patches: DataFrame, reps: DataFrame, patch_id: str, vector: str) -> DataFrame:
    """(patch_id, rep_id, d2): the nearest representative of every patch; ties go to the smaller id. One matrix product per Arrow batch."""
    held = patches.sparkSession.sparkContext.broadcast(codebook(reps))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = held.value
        for batch in batches:
            if batch.num_rows and len(ids):
                best, dist = closest(np.array(batch.column("v").flatten().to_numpy(), dtype=float).reshape(batch.num_rows, -1), ids, c)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[best]), pa.array(dist)], names=["id", "rep_id", "d2"])

    source = patches.where(F.col(vector).isNotNull()).select(F.col(patch_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return source.mapInArrow(assign, "id long, rep_id long, d2 double").withColumnRenamed("id", patch_id)


def refine(patches: DataFrame, reps: DataFrame, patch_id: str, vector: str, least: int = 5) -> DataFrame:
    """(rep_id, vector, count, error): means of the patches nearest to each representative; those with ``least`` or fewer are dropped.

    Vectors are summed where they lie: a task sends on one sum for each representative, which are then added.
    """
    held = patches.sparkSession.sparkContext.broadcast(codebook(reps))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = held.value
        sums, count, error = np.zeros(c.shape), np.zeros(len(ids)), np.zeros(len(ids))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            v = np.array(batch.column("v").flatten().to_numpy(), dtype=float).reshape(batch.num_rows, -1)
            best, d2 = closest(v, ids, c)
            np.add.at(sums, best, v)
            count += np.bincount(best, minlength=len(ids))
            error += np.bincount(best, d2, minlength=len(ids))
        some = np.flatnonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * c.shape[-1] + 1, max(1, c.shape[-1]), dtype=np.int32)), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), flat, pa.array(count[some].astype(np.int64)), pa.array(error[some])], names=["rep_id", "sums", "n", "e"])

    source = patches.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    parts = source.mapInArrow(add, "rep_id long, sums array<double>, n long, e double")
    whole = parts.groupBy("rep_id").agg(F.collect_list("sums").alias("s"), F.sum("n").alias("count"), F.sum("e").alias("error")).where(F.col("count") > least)  # one sum for each task
    added = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.col("s")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return whole.select("rep_id", F.transform(added, lambda x: x / F.col("count")).alias("vector"), "count", "error")


def seed(sample: np.ndarray, n: int, scale: float = 3000.0, cap: float = 100_000.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Online k-means++ over a bounded sample: a row becomes a representative with probability min(d2, cap) / scale.

    After every row, taken or not, the scale doubles if that probability exceeded one half and else falls by one, never below one.
    """
    rng = rng or np.random.default_rng(0)
    reps = [sample[0]] if len(sample) else []
    for row in sample[1:]:
        if len(reps) >= n:
            break
        p = min(float(((np.array(reps) - row) ** 2).sum(1).min()), cap) / scale
        if rng.random() < p:
            reps.append(row)
        scale = scale * 2 if p > 0.5 else max(1.0, scale - 1)
    return np.array(reps)


def quantise(patches: DataFrame, patch_id: str, vector: str, n: int, sample_rows: int = 20_000, rounds: int = 5, scale: float = 3000.0, least: int = 5) -> DataFrame:
    """(rep_id, vector, count, error): seeding on a bounded sample, then ``rounds`` refinements over all patches."""
    spark = patches.sparkSession
    drawn = patches.where(F.col(vector).isNotNull()).select(patch_id, vector).orderBy(F.xxhash64(patch_id)).limit(sample_rows).collect()
    reps = seed(np.array([r[1] for r in drawn], dtype=float), n, scale)
    book = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(reps)], "rep_id long, vector array<double>")
    for _ in range(rounds):
        refined = refine(patches, book, patch_id, vector, least).collect()  # no more rows than representatives
        if not refined:
            break
        book = spark.createDataFrame(refined, "rep_id long, vector array<double>, count long, error double")
    return book


def code_tuples(patches: DataFrame, books: list[DataFrame], patch_id: str, vector: str) -> DataFrame:
    """(patch_id, code): the labels of every patch under several codebooks."""
    out = None
    for i, book in enumerate(books):
        one = nearest(patches, book, patch_id, vector).select(patch_id, F.col("rep_id").alias(f"c{i}"))
        out = one if out is None else out.join(one, patch_id)
    return out.select(patch_id, F.array(*[f"c{i}" for i in range(len(books))]).alias("code"))
