"""Points near other points, and regions that contain them: quadtree partitions, R-tree probes, exact refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .runs import map_sorted_runs

FANOUT = 16  # entries of an R-tree node


@dataclass
class Forest:
    """One quadtree for every plane (a combination of the ``by`` columns) that is too full to be one partition."""

    roots: dict[tuple, int]
    box: np.ndarray  # node -> x0, y0, side
    child: np.ndarray  # node -> first of its four children, or -1 for a leaf

    def leaves_of(self, root: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a closed box touches. Quadrants are half open, so a point has one leaf."""
        row, node = np.arange(len(root)), root.copy()
        rows, leaves = [], []
        while len(row):
            done = self.child[node] < 0
            rows.append(row[done])
            leaves.append(node[done])
            row, node = row[~done], node[~done]
            mx, my = (self.box[node, i] + self.box[node, 2] / 2 for i in (0, 1))
            low = (x0[row] < mx, y0[row] < my)
            high = (x1[row] >= mx, y1[row] >= my)
            parts = [(r, c) for qx in (0, 1) for qy in (0, 1) for t in [(low, high)[qx][0] & (low, high)[qy][1]] for r, c in [(row[t], self.child[node[t]] + 2 * qx + qy)]]
            row, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return np.concatenate(rows), np.concatenate(leaves)


def build_forest(sample: list[tuple], bounds: tuple[float, float, float, float], weight: float, capacity: int, least_side: float) -> Forest:
    """Split every plane's square while the sample says that a quadrant holds more than ``capacity`` points."""
    x0, y0, x1, y1 = bounds
    side = max(x1 - x0, y1 - y0, least_side) * (1 + 1e-9) + 1
    planes: dict[tuple, list[tuple[float, float]]] = {}
    for *key, x, y in sample:
        planes.setdefault(tuple(key), []).append((x, y))
    roots, box, child = {}, [], []
    for key, points in planes.items():
        if len(points) * weight <= capacity or len(points) < 8:
            continue  # too little is known; a leaf that turns out too full is cut into blocks
        roots[key] = len(box)
        box.append((x0, y0, side))
        child.append(-1)
        open_nodes = [(roots[key], np.array(points))]
        while open_nodes:
            node, own = open_nodes.pop()
            bx, by, s = box[node]
            if len(own) * weight <= capacity or len(own) < 8 or s / 2 < least_side:
                continue
            child[node] = len(box)
            right, upper = own[:, 0] >= bx + s / 2, own[:, 1] >= by + s / 2
            for qx in (0, 1):
                for qy in (0, 1):
                    box.append((bx + qx * s / 2, by + qy * s / 2, s / 2))
                    child.append(-1)
                    open_nodes.append((len(box) - 1, own[(right == qx) & (upper == qy)]))
    return Forest(roots, np.array(box, dtype=float).reshape(-1, 3), np.array(child, dtype=np.int64))


class RTree:
    """Static R-tree over points, packed by sort-tile-recursive; all probes of a call descend together."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        strips = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
        by_x = np.argsort(x, kind="stable")
        strip = np.empty(n, dtype=np.int64)
        strip[by_x] = np.arange(n) // (strips * FANOUT)
        self.entry = np.lexsort((y, strip))
        box = np.stack([x, y, x, y], axis=1)[self.entry]
        self.levels = [box]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below), FANOUT)
            self.levels.append(np.concatenate([np.minimum.reduceat(below[:, :2], at), np.maximum.reduceat(below[:, 2:], at)], axis=1))

    def probe(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) for every entry inside a closed box."""
        q, node = np.arange(len(boxes)), np.zeros(len(boxes), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            b = self.levels[level][node]
            p = boxes[q]
            hit = (b[:, 0] <= p[:, 2]) & (b[:, 2] >= p[:, 0]) & (b[:, 1] <= p[:, 3]) & (b[:, 3] >= p[:, 1])
            q, node = q[hit], node[hit]
            if level:
                first, size = node * FANOUT, len(self.levels[level - 1])
                count = np.minimum(first + FANOUT, size) - first
                q = np.repeat(q, count)
                node = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(q))
        return q, self.entry[node]


def even_odd(px: np.ndarray, py: np.ndarray, ring: np.ndarray, vx: np.ndarray, vy: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether point i lies in ring ``ring[i]``; ring r has the vertices ``first[r] : first[r] + count[r]``."""
    n = count[ring]
    pair = np.repeat(np.arange(len(ring)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    start = first[ring][pair]
    i, j = start + at, start + (at + 1) % n[pair]
    x, y = px[pair], py[pair]
    over = (vy[i] > y) != (vy[j] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < (vx[j] - vx[i]) * (y - vy[i]) / (vy[j] - vy[i]) + vx[i]
    return np.bincount(pair[over & left], minlength=len(ring)) % 2 == 1


PARTS = "p0 string, p1 long, leaf long, part long, kind int, id long, x double, y double, xs array<double>, ys array<double>"


def near_and_inside(
    points: DataFrame, regions: DataFrame, distance: float, by: tuple[str, str], point_id: str = "cell_id", region_id: str = "annotation_id",
    xy: tuple[str, str] = ("x", "y"), vertices: str = "vertices", capacity: int = 4_000, sample_rows: int = 100_000, hot: int = 50_000,
) -> DataFrame:
    """(cell_id, other_kind, other_id): pairs of points at most ``distance`` apart and regions around points, within one plane.

    ``by`` names a string and an integer column, equal for points and regions that may meet. A bounded sample
    (``sample_rows``, about) decides the quadtree of full planes only; every row takes part whatever the sample says.
    Points are copied to the leaves within ``distance`` of them and regions to the leaves they touch. A pair is
    reported where its smaller id is at home and a region where the point is, so nothing is reported twice. A leaf
    beyond ``hot`` points, as where many share a place, is cut into blocks and each pair of blocks is a group of its own.

    Null or NaN coordinates, null planes and null ids have no partner. Rings may be closed or not; null vertices are
    skipped, and rings of fewer than three vertices contain nothing. Repeated points are pairs at distance 0. Empty
    inputs give no rows; extra columns are ignored, whatever their names.
    """
    spark = points.sparkSession
    x, y = (F.col(c).cast("double") for c in xy)
    pts = points.select(F.col(by[0]).cast("string").alias("p0"), F.col(by[1]).cast("long").alias("p1"), F.col(point_id).cast("long").alias("id"), x.alias("x"), y.alias("y"))
    pts = pts.where("p0 IS NOT NULL AND p1 IS NOT NULL AND id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    v = F.filter(F.col(vertices), lambda s: s.x.isNotNull() & s.y.isNotNull() & ~F.isnan(s.x) & ~F.isnan(s.y))
    rings = regions.select(F.col(by[0]).cast("string").alias("p0"), F.col(by[1]).cast("long").alias("p1"), F.col(region_id).cast("long").alias("id"), v.alias("v"))
    rings = rings.where("p0 IS NOT NULL AND p1 IS NOT NULL AND id IS NOT NULL AND size(v) >= 3")
    rings = rings.select("p0", "p1", "id", F.transform("v", lambda s: s.x.cast("double")).alias("xs"), F.transform("v", lambda s: s.y.cast("double")).alias("ys"))

    s = pts.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    share = min(1.0, sample_rows / max(1, s["n"]))
    drawn = pts.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("p0", "p1", "x", "y")
    sample = [tuple(r) for r in drawn.limit(2 * sample_rows).collect()]  # the limit only guards the driver; the hash already bounds the sample
    built = build_forest(sample, (s["x0"] or 0, s["y0"] or 0, s["x1"] or 0, s["y1"] or 0), 1 / share, capacity, 4 * distance)
    trees = spark.sparkContext.broadcast((built.roots, built.box, built.child))  # bounded by the sample

    def roots(batch: pa.RecordBatch) -> np.ndarray:
        planes = trees.value[0]
        if not planes or not batch.num_rows:
            return np.full(batch.num_rows, -1)
        p0 = batch.column("p0").dictionary_encode()
        names, code, p1 = p0.dictionary.to_pylist(), p0.indices.to_numpy().astype(np.int64), batch.column("p1").to_numpy()
        numbers, place = np.unique(p1, return_inverse=True)
        pairs, at = np.unique(code * len(numbers) + place, return_inverse=True)
        known = [planes.get((names[p // len(numbers)], int(numbers[p % len(numbers)])), -1) for p in pairs.tolist()]
        return np.array(known, dtype=np.int64)[at]

    def emit(batch, row, leaf, kind, xs=None):
        take = pa.array(row)
        n = len(row)
        none = pa.nulls(n, pa.list_(pa.float64()))
        pick = lambda c: batch.column(c).take(take)
        return pa.RecordBatch.from_arrays(
            [pick("p0"), pick("p1"), pa.array(leaf.astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(kind.astype(np.int32)), pick("id")]
            + ([pa.nulls(n, pa.float64())] * 2 + [pick("xs"), pick("ys")] if xs else [pick("x"), pick("y"), none, none]),
            names=["p0", "p1", "leaf", "part", "kind", "id", "x", "y", "xs", "ys"],
        )

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = roots(batch)
            whole = np.flatnonzero(root < 0)
            yield emit(batch, whole, np.full(len(whole), -1), np.zeros(len(whole)))
            cut = np.flatnonzero(root >= 0)
            if len(cut):
                f = Forest(*trees.value)
                px, py = (batch.column(c).to_numpy()[cut] for c in ("x", "y"))
                home = np.empty(len(cut), dtype=np.int64)
                i, leaf = f.leaves_of(root[cut], px, py, px, py)
                home[i] = leaf
                i, leaf = f.leaves_of(root[cut], px - distance, py - distance, px + distance, py + distance)
                yield emit(batch, cut[i], leaf, (leaf != home[i]).astype(int))

    def place_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            root = roots(batch)
            whole = np.flatnonzero(root < 0)
            yield emit(batch, whole, np.full(len(whole), -1), np.full(len(whole), 2), True)
            cut = np.flatnonzero(root >= 0)
            if len(cut):
                xs, ys = (batch.column(c).take(pa.array(cut)) for c in ("xs", "ys"))
                at = xs.offsets.to_numpy()[:-1] - xs.offsets.to_numpy()[0]
                vx, vy = (c.flatten().to_numpy() for c in (xs, ys))
                i, leaf = Forest(*trees.value).leaves_of(root[cut], *(g.reduceat(c, at) for g in (np.minimum, np.maximum) for c in (vx, vy)))
                yield emit(batch, cut[i], leaf, np.full(len(i), 2), True)

    placed = pts.mapInArrow(place_points, PARTS).unionByName(rings.mapInArrow(place_rings, PARTS))
    placed = stage(placed, "placed")
    full = placed.where("kind < 2").groupBy("p0", "p1", "leaf").count().where(F.col("count") > hot)
    blocks = F.broadcast(full.select("p0", "p1", "leaf", F.ceil(F.col("count") / hot).cast("long").alias("k")))  # at most a row for every ``hot`` placed points
    own = F.pmod(F.xxhash64("id"), F.col("k"))
    other = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
    meets = F.transform(other, lambda b: F.least(own, b) * F.col("k") + F.greatest(own, b))
    every = F.transform(other, lambda b: b * F.col("k") + b)
    cutting = placed.join(blocks, ["p0", "p1", "leaf"], "left")
    divided = cutting.withColumn(
        "part", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("kind") < 2, meets).otherwise(every))
    ).withColumn("k", F.coalesce("k", F.lit(1).cast("long"))).withColumn("block", F.when(F.col("kind") < 2, F.pmod(F.xxhash64("id"), F.col("k"))).otherwise(F.lit(-1).cast("long")))

    def probe(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        kind, ids, part, k, block = col("kind"), col("id"), col("part"), col("k"), col("block")
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(kind))))
        is_point = np.flatnonzero(kind < 2)
        if not len(is_point):
            return
        px, py, pg = col("x")[is_point], col("y")[is_point], group[is_point]
        ring_rows = np.flatnonzero(kind == 2)
        xs, ys = (table.column(c).combine_chunks().take(pa.array(ring_rows)) for c in ("xs", "ys"))
        vx, vy = (c.flatten().to_numpy() for c in (xs, ys))
        left, right = px.min(), px.max()
        lane = (right - left) + 4 * distance + 1  # groups lie side by side and never touch
        tree = RTree(px - left + pg * lane, py)
        pid, home, pblock, ppart, pk = ids[is_point], kind[is_point] == 0, block[is_point], part[is_point], k[is_point]
        out = lambda a, kind_name, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array([kind_name]).take(pa.array(np.zeros(len(a), np.int32))), pa.array(b)], names=["cell_id", "other_kind", "other_id"])
        asking = np.flatnonzero(home)
        for at in range(0, len(asking), 20_000):
            q = asking[at : at + 20_000]
            cx, cy = px[q] - left + pg[q] * lane, py[q]
            i, e = tree.probe(np.stack([cx - distance, cy - distance, cx + distance, cy + distance], axis=1))
            a = q[i]
            near = (pg[a] == pg[e]) & (pid[a] < pid[e]) & ((px[a] - px[e]) ** 2 + (py[a] - py[e]) ** 2 <= distance * distance)
            near &= ppart[a] == np.minimum(pblock[a], pblock[e]) * pk[a] + np.maximum(pblock[a], pblock[e])
            yield out(pid[a[near]], "cell", pid[e[near]])
        if len(ring_rows):
            count = np.diff(xs.offsets.to_numpy())
            first = np.cumsum(count) - count
            g = group[ring_rows]
            lo_x, lo_y, hi_x, hi_y = (f.reduceat(c, first) for f in (np.minimum, np.maximum) for c in (vx, vy))
            clip = lambda c: np.clip(c - left, -distance, right - left + distance)
            boxes = np.stack([clip(lo_x) + g * lane, lo_y, clip(hi_x) + g * lane, hi_y], axis=1)
            for at in range(0, len(ring_rows), 256):
                i, e = tree.probe(boxes[at : at + 256])
                i = i + at
                ok = (pg[e] == g[i]) & home[e]
                i, e = i[ok], e[ok]
                for c in range(0, len(i), 50_000):
                    r, p = i[c : c + 50_000], e[c : c + 50_000]
                    inside = even_odd(px[p], py[p], r, vx, vy, first, count)
                    yield out(pid[p[inside]], "region", ids[ring_rows[r[inside]]])

    return map_sorted_runs(divided, ["p0", "p1", "leaf", "part"], ["kind"], probe, "cell_id long, other_kind string, other_id long")
