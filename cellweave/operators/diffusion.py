"""Diffusion maps of a codebook, and their extension to any number of patches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DiffusionMap:
    reps: np.ndarray
    density: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    epsilon: float
    k: int


def _kernel(a: np.ndarray, b: np.ndarray, epsilon: float, k: int) -> np.ndarray:
    d2 = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
    kernel = np.exp(-d2 / (4 * epsilon))
    if k < len(b):
        cut = np.partition(d2, k, axis=1)[:, k]
        kernel[d2 > cut[:, None]] = 0
    return kernel


def fit(reps: np.ndarray, epsilon: float, k: int = 100, vectors: int = 10) -> DiffusionMap:
    """Diffusion map (alpha 1) of the representatives: at most a few thousand, so the eigenproblem is the driver's."""
    kernel = _kernel(reps, reps, epsilon, k)
    kernel = np.maximum(kernel, kernel.T)
    density = kernel.sum(1)
    kernel = kernel / density[:, None] / density[None]
    degree = kernel.sum(1)
    root = np.sqrt(degree)
    w, v = np.linalg.eigh(kernel / root[:, None] / root[None])
    order = np.argsort(w)[::-1][1 : vectors + 1]
    v = v[:, order] / root[:, None]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return DiffusionMap(reps, density, w[order], v, epsilon, k)


def transform(patches: DataFrame, model: DiffusionMap, patch_id: str, vector: str) -> DataFrame:
    """(patch_id, dm): Nystroem extension of the map to every patch."""
    held = patches.sparkSession.sparkContext.broadcast((model.reps, model.density, model.values, model.vectors, model.epsilon, model.k))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, density, values, vectors, epsilon, k = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            kernel = _kernel(v, reps, epsilon, k) / density[None]
            total = np.maximum(kernel.sum(1), 1e-300)
            dm = kernel @ vectors / total[:, None] / values[None]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(dm), pa.list_(pa.float64()))], names=["id", "dm"])

    source = patches.where(F.col(vector).isNotNull()).select(F.col(patch_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return source.mapInArrow(extend, "id long, dm array<double>").withColumnRenamed("id", patch_id)
