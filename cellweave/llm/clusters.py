"""Clusters of mutually similar records: sparse affinities, power iteration, k-means on the embedding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runs import map_sorted_runs
from ..session import stage, unstage

ALL, MIXED, OPEN = 0, 1, 2  # of two balls' members: all similar, some similar and some not, not told by the balls
_EPS = 1e-9


def build_tree(sample: np.ndarray, weight: float, capacity: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-d tree (axis, cut, left child; axis -1: leaf; the right child follows the left) by medians of a sample."""
    axis, cut, left = [-1], [0.0], [-1]
    todo = [(0, sample)]
    while todo:
        node, own = todo.pop()
        if len(own) * weight <= capacity or len(own) < 8:
            continue
        quantiles = np.quantile(own, [0.1, 0.9], axis=0)
        a = int(np.argmax(quantiles[1] - quantiles[0]))
        c = float(np.median(own[:, a]))
        low = own[:, a] <= c
        if quantiles[1][a] - quantiles[0][a] < 2 * radius or low.all():
            continue
        axis[node], cut[node], left[node] = a, c, len(axis)
        for part in (own[low], own[~low]):
            axis.append(-1), cut.append(0.0), left.append(-1)
            todo.append((len(axis) - 1, part))
    return np.array(axis), np.array(cut), np.array(left)


def leaves_of(tree: tuple, v: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaves within ``radius`` of each vector, by axis; ``home`` marks the one that holds it."""
    axis, cut, left = tree
    row, node, home = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), np.ones(len(v), dtype=bool)
    rows, nodes, homes = [], [], []
    while len(row):
        done = axis[node] < 0
        rows.append(row[done]), nodes.append(node[done]), homes.append(home[done])
        row, node, home = row[~done], node[~done], home[~done]
        x, c = v[row, axis[node]], cut[node]
        low, high, side = x - radius <= c, x + radius > c, x <= c
        row, home, node = (
            np.concatenate([row[low], row[high]]),
            np.concatenate([home[low] & side[low], home[high] & ~side[high]]),
            np.concatenate([left[node[low]], left[node[high]] + 1]),
        )
    return np.concatenate(rows), np.concatenate(nodes), np.concatenate(homes)


def cores_of(sample: np.ndarray, classes: np.ndarray, support: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre, size class) of every place where ``support`` points of the sample lie within ``reach`` of their mean."""
    centres, kinds = [], []
    for k in np.unique(classes):
        rest = sample[classes == k]
        while len(rest) >= support:
            c = rest[0]
            for _ in range(3):
                near = ((rest - c) ** 2).sum(1) <= reach * reach
                if not near.any():
                    break
                c = rest[near].mean(axis=0)
            near = ((rest - c) ** 2).sum(1) <= reach * reach
            if near.sum() >= support:
                centres.append(c), kinds.append(k)
            near[0] = True
            rest = rest[~near]
    return np.array(centres, dtype=float).reshape(-1, sample.shape[1]), np.array(kinds, dtype=float)


def ball_pairs(c: dict[str, np.ndarray], q: np.ndarray, a: np.ndarray, radius: float, ratio: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking ball, answering ball, kind) of all pairs of balls that may hold similar members, halving both sides until the rest is a small product."""
    v, r, lo, hi, s = c["v"], c["r"], c["lo"], c["hi"], c["s"]
    far = radius + 2 * reach + 1e-6
    todo = [(q, a)]
    while todo:
        i, j = todo.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) > 1 << 17 and len(i) > 16:
            own = v[i]
            axis = int(np.argmax(own.std(axis=0)))
            cut = np.median(own[:, axis])
            low = own[:, axis] <= cut
            if not low.all():
                x = v[j, axis]
                todo.append((i[low], j[x <= cut + far]))
                todo.append((i[~low], j[x > cut - far]))
                continue
        for at in range(0, len(i), 256):
            for to in range(0, len(j), 8192):
                ii, jj = i[at : at + 256], j[to : to + 8192]
                x, y = v[ii], v[jj]
                near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T <= (radius + r[ii][:, None] + r[jj][None]) ** 2 + 1e-6
                m, n = np.nonzero(near)
                m, n = ii[m], jj[n]
                ok = (m != n) & (s[m] == s[n]) & (lo[n] <= ratio * hi[m]) & (lo[m] <= ratio * hi[n])
                m, n = m[ok], n[ok]
                d2 = ((v[m] - v[n]) ** 2).sum(1)
                points = (r[m] == 0) & (r[n] == 0)
                span = r[m] + r[n]
                d = np.sqrt(d2)
                within = np.where(points, d2 <= radius * radius, d + span <= radius - _EPS)
                beyond = np.where(points, ~within, d - span > radius + _EPS)
                fits = (hi[n] <= ratio * lo[m]) & (hi[m] <= ratio * lo[n])
                kind = np.where(within, np.where(fits, ALL, MIXED), OPEN)
                keep = ~beyond
                yield m[keep], n[keep], kind[keep]


def similarity_links(balls: DataFrame, radius: float, ratio: float, reach: float, capacity: int = 60_000, sample_rows: int = 60_000, hot: int = 200_000) -> DataFrame:
    """(a, b, w, kind): every ordered pair of balls (id, n, s, lo, hi, r, v) that are or may be similar, with the records of b.

    A k-d tree of a bounded sample says where the space is cut; every ball is placed, and copied to the leaves within
    reach. A leaf beyond ``hot`` balls is cut into blocks, and each pair of blocks is a group of its own.
    """
    spark = balls.sparkSession
    drawn, share = draw(balls, sample_rows, 3, ["v"])
    sample = np.array([r[0] for r in drawn], dtype=float) if drawn else np.zeros((0, 1))
    far = radius + 2 * reach + 1e-6
    tree = spark.sparkContext.broadcast(build_tree(sample, 1 / share, capacity, far))  # bounded by the sample
    columns = ["id", "n", "s", "lo", "hi", "r", "v"]
    schema = "id long, n long, s double, lo double, hi double, r double, v array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            row, leaf, home = leaves_of(tree.value, v, far)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in columns], pa.array(leaf), pa.array(home)], names=[*columns, "leaf", "home"])

    placed = stage(balls.select(*columns).mapInArrow(place, f"{schema}, leaf long, home boolean"), "placed")
    full = placed.groupBy("leaf").count().where(F.col("count") > hot).select("leaf", F.ceil(F.col("count") / hot).cast("long").alias("k"))
    block = F.pmod(F.xxhash64("id"), F.col("k"))
    every = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
    asks = F.transform(every, lambda b: F.struct((block * F.col("k") + b).alias("part"), F.lit(True).alias("asks")))
    answers = F.transform(every, lambda b: F.struct((b * F.col("k") + block).alias("part"), F.lit(False).alias("asks")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(None).cast("boolean").alias("asks")))
    divided = (
        placed.join(full, "leaf", "left")
        .withColumn("p", F.explode(F.when(F.col("k").isNull(), whole).when(F.col("home"), F.concat(asks, answers)).otherwise(answers)))
        .select(*columns, "leaf", "p.part", F.coalesce("p.asks", "home").alias("asks"), F.coalesce(~F.col("p.asks"), F.lit(True)).alias("answers"))
    )

    def join(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).combine_chunks()
        c = {k: col(k).to_numpy() for k in ("id", "n", "s", "lo", "hi", "r")}
        c["v"] = col("v").flatten().to_numpy().reshape(len(c["id"]), -1)
        asks, answers = (col(k).to_numpy(zero_copy_only=False) for k in ("asks", "answers"))
        for lo, hi in zip(starts, np.append(starts[1:], len(c["id"])), strict=True):
            for i, j, kind in ball_pairs(c, lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(answers[lo:hi]), radius, ratio, reach):
                ok = c["id"][i] != c["id"][j]
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (c["id"][i], c["id"][j], c["n"][j], kind.astype(np.int32))], names=["a", "b", "w", "kind"])

    return map_sorted_runs(divided, ["leaf", "part"], [], join, "a long, b long, w long, kind int")


def settle(open_pairs: DataFrame, members: DataFrame, radius: float, ratio: float, hot: int = 20_000) -> DataFrame:
    """(a, b, some, none): of open pairs of balls (a, b), whether some members are similar and whether some are not.

    ``members`` has every member (node, id, lo, v) of the balls in question. The members of the smaller ball ``a`` meet
    those of ``b`` in pairs of blocks of at most about ``hot`` members; only two flags leave a task.
    """
    sizes = members.groupBy("node").count().select("node", F.ceil(F.col("count") / hot).cast("long").alias("k"))
    blocks = open_pairs.join(sizes.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    pieces = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    mine = lambda k: F.pmod(F.xxhash64("id"), F.col(k))
    left = blocks.join(members.withColumnRenamed("node", "a"), "a").select("a", "b", mine("ka").alias("i"), pieces("kb").alias("j"), F.lit(0).alias("side"), "lo", "v")
    right = blocks.join(members.withColumnRenamed("node", "b"), "b").select("a", "b", pieces("ka").alias("i"), mine("kb").alias("j"), F.lit(1).alias("side"), "lo", "v")

    def look(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).combine_chunks()
        a, b, side, lo = (col(k).to_numpy() for k in ("a", "b", "side", "lo"))
        v = col("v").flatten().to_numpy().reshape(len(a), -1)
        out = []
        for x, y in zip(starts, np.append(starts[1:], len(a)), strict=True):
            p, q = x + np.flatnonzero(side[x:y] == 0), x + np.flatnonzero(side[x:y] == 1)
            some = none = False
            for at in range(0, len(p), 64):
                for to in range(0, len(q), 8192):
                    i, j = p[at : at + 64], q[to : to + 8192]
                    d2 = ((v[i][:, None] - v[j][None]) ** 2).sum(-1)
                    ok = (d2 <= radius * radius) & (np.maximum(lo[i][:, None], lo[j][None]) <= ratio * np.minimum(lo[i][:, None], lo[j][None]))
                    some, none = some or bool(ok.any()), none or not ok.all()
                if some and none:
                    break
            out.append((a[x], b[x], some, none))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out]) for k in range(4)], names=["a", "b", "some", "none"])

    flags = map_sorted_runs(left.unionByName(right), ["a", "b", "i", "j"], ["side"], look, "a long, b long, some boolean, none boolean", rows=200_000)
    return flags.groupBy("a", "b").agg(F.bool_or("some").alias("some"), F.bool_or("none").alias("none"))


VECTORS = ("e0", "e1", "e2", "e3")
_SPAN = 1 << 30  # the vectors' first entries are whole numbers below this


def power_iterate(nodes: DataFrame, links: DataFrame, rounds: int = 4) -> DataFrame:
    """(id, n, degree, e0 … e3): four random vectors after ``rounds`` products with the row-normalised affinities.

    ``nodes`` (id, n) stand for n records each that are all similar. What is similar to itself and nothing else gets equal
    values: sums are exact in integers, and each round's means are cut to integers. Sets that a few links join keep
    values far apart, for a random walk of a few steps seldom leaves them.
    """
    start = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(_SPAN)).cast("long")
    degrees = links.groupBy("a").agg(F.sum("w").alias("s"))
    first = [start(i + 1).alias(e) for i, e in enumerate(VECTORS)]
    at = stage(nodes.join(degrees, nodes.id == degrees.a, "left").select("id", "n", (F.col("n") + F.coalesce("s", F.lit(0))).alias("degree"), *first), "nodes")
    for _ in range(rounds):
        sums = links.join(at.select(F.col("id").alias("b"), *VECTORS), "b").groupBy("a").agg(*[F.sum(F.col("w") * F.col(e)).alias(f"s{e}") for e in VECTORS])
        moved = [((F.col("n") * F.col(e) + F.coalesce(f"s{e}", F.lit(0))) / F.col("degree")).cast("long").alias(e) for e in VECTORS]
        before, at = at, stage(at.join(sums, at.id == sums.a, "left").select("id", "n", "degree", *moved), "nodes")
        unstage(before)
    return at


def embedding_kmeans(at: DataFrame, least: int, step: float = _SPAN / 256, rounds: int = 3) -> DataFrame:
    """(id, n, degree, centre): k-means on the embedding; every grid cell of it that holds ``least`` records starts a centre.

    A point looks for its nearest centre, by all coordinates, among those whose first two lie in its own square or the
    eight around, so k is unbounded and no point meets all centres. Points with no centre within ``step`` in every
    coordinate are outside all clusters.
    """
    cell = lambda e: F.floor(F.col(e) / step).cast("long")
    mean = lambda e: (F.sum(F.col("n") * F.col(e)) / F.sum("n")).alias(e)
    points = at.select("id", "n", "degree", *VECTORS, cell("e0").alias("q0"), cell("e1").alias("q1"))
    centres = points.groupBy("q0", "q1", cell("e2"), cell("e3")).agg(F.sum("n").alias("size"), F.min("id").alias("centre"), *map(mean, VECTORS)).where(F.col("size") >= least)
    around = F.explode(F.array(*[F.struct((cell("e0") + i).alias("q0"), (cell("e1") + j).alias("q1")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(rounds):
        named = [F.col(e).alias(f"c{e}") for e in VECTORS]
        reach = centres.select("centre", *named, around.alias("q")).select("centre", *[f"c{e}" for e in VECTORS], "q.q0", "q.q1")
        far = reduce(lambda a, b: a + b, [(F.col(e) - F.col(f"c{e}")) ** 2 for e in VECTORS])
        near = reduce(lambda a, b: a & b, [F.abs(F.col(e) - F.col(f"c{e}")) <= step for e in VECTORS])
        assigned = points.join(reach, ["q0", "q1"]).where(near).groupBy("id", "n", "degree", *VECTORS).agg(F.min_by("centre", F.struct(far, "centre")).alias("centre"))
        assigned = stage(assigned, "assigned")
        centres = assigned.groupBy("centre").agg(*map(mean, VECTORS))
    return assigned.select("id", "n", "degree", "centre")


def gather_near(v: np.ndarray, group: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ball of every point, distance from its centre, centre of every ball): points of one ball lie within ``reach`` of its centre and are of one group.

    A set that does not fit into a ball is halved at the median of its widest axis until its parts do, so the work is that
    of a sort, whatever the density.
    """
    ball, dist, centres = np.zeros(len(v), dtype=np.int64), np.zeros(len(v)), []
    order = np.argsort(group, kind="stable")
    todo = np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []
    while todo:
        own = todo.pop()
        x = v[own]
        c = x[0] if len(own) == 1 else x.mean(axis=0)
        d = np.sqrt(((x - c) ** 2).sum(axis=1))
        if d.max() > reach:
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            low = x[:, axis] <= np.median(x[:, axis])
            if low.all():
                low = x[:, axis] < x[:, axis].max()
            todo += [own[low], own[~low]]
            continue
        ball[own], dist[own] = len(centres), d
        centres.append(c)
    return ball, dist, np.array(centres).reshape(len(centres), v.shape[1])


def octave_of(lo: np.ndarray, ratio: float) -> np.ndarray:
    """The power of ``ratio`` that an area lies in, exact at its ends; records of one octave have areas similar to each other."""
    octave = np.where(lo > 0, np.floor(np.log(np.maximum(lo, 1e-300)) / np.log(ratio)), -9999)
    return np.where((lo > 0) & (ratio ** (octave + 1.0) <= lo), octave + 1, np.where((lo > 0) & (ratio**octave > lo), octave - 1, octave)).astype(np.int32)


def draw(rows: DataFrame, sample_rows: int, salt: int, columns: list[str]) -> tuple[list, float]:
    """(a hashed sample of about ``sample_rows`` rows, its share)."""
    share = min(1.0, sample_rows / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(*columns)
    return drawn.limit(2 * sample_rows).collect(), share  # the limit only guards the driver; the hash already bounds the sample


def local_balls(single: DataFrame, radius: float, ratio: float, reach: float, capacity: int = 20_000, sample_rows: int = 30_000, hot: int = 60_000) -> DataFrame:
    """(ball, id, n, s, lo, v, c, r): every row of ``single`` (id, n, s, lo, v) with its ball; c and r, the ball's centre and radius, stand in one row of each ball.

    All rows are brought to the leaf of a k-d tree that holds them, and gathered there, so no cluster's gathering depends
    on whether a sample met it. The sample decides the leaves only; one beyond ``hot`` rows is cut into blocks.
    """
    spark = single.sparkSession
    drawn, share = draw(single, sample_rows, 5, ["v"])
    sample = np.array([r[0] for r in drawn], dtype=float) if drawn else np.zeros((0, 1))
    tree = spark.sparkContext.broadcast(build_tree(sample, 1 / share, capacity, 0.25 * radius))  # bounded by the sample
    schema = "id long, n long, s double, lo double, v array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            row, leaf, _ = leaves_of(tree.value, v, 0.0)
            at = np.zeros(batch.num_rows, dtype=np.int64)
            at[row] = leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "leaf"])

    placed = single.select("id", "n", "s", "lo", "v").mapInArrow(place, f"{schema}, leaf long")
    full = F.broadcast(placed.groupBy("leaf").count().where(F.col("count") > hot).select("leaf", F.ceil(F.col("count") / hot).cast("long").alias("k")))  # bounded by the sample's leaves
    blocks = placed.join(full, "leaf", "left").select(*placed.columns, F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1).cast("long"))).alias("part"))

    def gather(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).combine_chunks()
        ids, lo, s = (col(c).to_numpy() for c in ("id", "lo", "s"))
        v = col("v").flatten().to_numpy().reshape(len(ids), -1)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        group = np.unique(np.stack([run, s, octave_of(lo, ratio)], axis=1), axis=0, return_inverse=True)[1].ravel()
        ball, dist, centres = gather_near(v, group, reach)
        order = np.lexsort((ids, ball))
        first = order[np.unique(ball[order], return_index=True)[1]]  # the row of the ball's least id
        most = np.zeros(len(first))
        np.maximum.at(most, ball, dist)
        single = np.bincount(ball) == 1
        r = pa.array(np.where(single, 0.0, np.maximum(most, _EPS))).take(pa.array(ball))
        names = ids[first][ball]
        is_first = pa.array(np.isin(np.arange(len(ids)), first))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, centres.size + 1, max(1, v.shape[1]), dtype=np.int32)), pa.array(centres.ravel()))
        none = pa.nulls(len(ids), pa.list_(pa.float64()))
        c = pa.compute.if_else(is_first, flat.take(pa.array(ball)), none)
        yield pa.RecordBatch.from_arrays([pa.array(names), col("id"), col("n"), col("s"), col("lo"), col("v"), c, r], names=["ball", "id", "n", "s", "lo", "v", "c", "r"])

    return map_sorted_runs(blocks, ["leaf", "part"], [], gather, f"ball long, {schema}, c array<double>, r double")


def spectral_clusters(
    records: DataFrame, record_id: str, vector: list[str], area: str, size_class: str, radius: float = 1.0, ratio: float = 2.0, least: int = 5, sample_rows: int = 30_000, support: int = 3
) -> DataFrame:
    """(record_id, group_id): clusters of at least ``least`` records that are all similar to each other and to nothing else.

    Similar are records of equal ``size_class`` whose vectors are at most ``radius`` apart and of whose areas the larger is
    at most ``ratio`` times the smaller; group_id is the least id of the cluster.

    Records are first gathered into balls whose members are all similar whatever their number, within half the radius and
    one power of ``ratio`` of area: around the dense places of a bounded sample, without moving a row, and all others, equal
    ones first, among their neighbours in space (``local_balls``). Every record has a ball, and no pairs are made inside one. Affinities join balls: two balls' members are all
    similar, or none is, by their radii; what the radii leave open is settled by the members themselves. The affinities are
    normalised by degree, iterated and clustered by k-means; a cluster so found is kept if every ball's links are exactly
    the other balls of the cluster, all wholly similar. The sample decides only what is gathered, never the result.

    Nulls and NaN in a field keep a record out, as does a negative area, which exceeds its own double; ties and repeated
    rows are records like others; an empty table gives none; extra columns are ignored.
    """
    spark, reach = records.sparkSession, radius / 2 - 1e-6
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*vector, area, size_class]])
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)
    cells = records.where(known & F.col(record_id).isNotNull() & (F.col(area) >= 0)).select(
        F.col(record_id).cast("long").alias("id"), number(size_class).alias("s"), number(area).alias("lo"), F.array(*map(number, vector)).alias("v")
    )
    drawn = draw(cells, sample_rows, 11, ["s", "v"])[0] if sample_rows else []
    centres, kinds = cores_of(np.array([r[1] for r in drawn], dtype=float).reshape(-1, len(vector)), np.array([r[0] for r in drawn], dtype=float), support, reach)
    held = spark.sparkContext.broadcast((centres, kinds))  # bounded by the sample

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            s, lo = batch.column("s").to_numpy(), batch.column("lo").to_numpy()
            core, dist = np.full(len(v), -1, dtype=np.int32), np.zeros(len(v))
            for kind in np.unique(s):
                mine = np.flatnonzero(k == kind)
                rows = np.flatnonzero(s == kind)
                for at in range(0, len(rows) if len(mine) else 0, 2_048):
                    some = rows[at : at + 2_048]
                    d2 = (v[some] ** 2).sum(1)[:, None] + (c[mine] ** 2).sum(1)[None] - 2 * v[some] @ c[mine].T
                    best = mine[d2.argmin(axis=1)]
                    d = np.sqrt(((v[some] - c[best]) ** 2).sum(1))
                    core[some], dist[some] = np.where(d <= reach, best, -1), np.where(d <= reach, d, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("s"), batch.column("lo"), batch.column("v"), pa.array(core), pa.array(octave_of(lo, ratio)), pa.array(dist)],
                names=["id", "s", "lo", "v", "core", "octave", "dist"],
            )

    gathered = cells.mapInArrow(gather, "id long, s double, lo double, v array<double>, core int, octave int, dist double")
    centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "core int, v array<double>")
    narrow = stage(gathered.select("id", "s", "lo", "core", "octave", "dist", F.when(F.col("core") < 0, F.col("v")).alias("v")), "gathered")
    dense = narrow.where("core >= 0").groupBy("core", "octave", "s").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("lo").alias("hi"), F.max("dist").alias("r"))
    dense = stage(dense.join(F.broadcast(centre), "core"), "dense")  # both bounded by the sample's places
    equal = stage(narrow.where("core < 0").groupBy("s", "lo", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "equal")
    single = stage(local_balls(equal, radius, ratio, reach), "single")
    local = single.groupBy("ball").agg(F.sum("n").alias("n"), F.first("s").alias("s"), F.min("lo").alias("lo"), F.max("lo").alias("hi"), F.max("r").alias("r"), F.first("c", True).alias("v"))
    ball = ["id", "n", "s", "lo", "hi", "r", "v"]
    wide = F.when(F.col("r") > 0, F.col("r") + _EPS).otherwise(F.lit(0.0)).alias("r")
    balls = dense.withColumn("r", F.greatest(F.col("r") + _EPS, F.lit(_EPS))).select(*ball).unionByName(local.select(F.col("ball").alias("id"), "n", "s", "lo", "hi", wide, "v"))
    balls = stage(balls, "balls")
    links = stage(similarity_links(balls, radius, ratio, reach), "links")

    count = balls.select("id", "n")
    opened = links.where(F.col("kind") == OPEN).join(count.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").where((F.col("na") < F.col("w")) | ((F.col("na") == F.col("w")) & (F.col("a") < F.col("b")))).select("a", "b")
    opened = stage(opened, "open")
    if not opened.isEmpty():
        asked = opened.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = F.broadcast(dense.join(asked, "id", "left_semi").select("core", "octave", "s", F.col("id").alias("node")))  # bounded by the sample's places
        members = gathered.where("core >= 0").join(wanted, ["core", "octave", "s"]).select("node", "id", "lo", "v").unionByName(
            single.join(asked.withColumnRenamed("id", "ball"), "ball", "left_semi").select(F.col("ball").alias("node"), "id", "lo", "v")
        )
        told = settle(opened, stage(members, "members"), radius, ratio).where("some").select("a", "b", F.when(F.col("none"), MIXED).otherwise(ALL).alias("kind"))
        both = told.unionByName(told.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
        links = links.where(F.col("kind") != OPEN).unionByName(both.join(count.select(F.col("id").alias("b"), F.col("n").alias("w")), "b").select("a", "b", "w", "kind"))
        links = stage(links, "links")
    linked = links.select(F.col("a").alias("id")).distinct()
    nodes = count.join(linked, "id", "left_semi").unionByName(count.where(F.col("n") >= least).join(linked, "id", "left_anti"))
    at = embedding_kmeans(power_iterate(nodes, links), least)
    other = at.select(F.col("id").alias("b"), F.col("centre").alias("other"))
    inner = links.join(other, "b").join(at.select(F.col("id").alias("a"), "centre"), "a").where((F.col("other") == F.col("centre")) & (F.col("kind") == ALL)).groupBy("a").agg(F.sum("w").alias("inside"))
    checked = at.join(inner, at.id == inner.a, "left").select("id", "n", "degree", "centre", (F.col("n") + F.coalesce("inside", F.lit(0))).alias("inside"))
    good = (
        checked.groupBy("centre").agg(F.sum("n").alias("size"), F.min("inside").alias("least_inside"), F.max("degree").alias("most_links"), F.min("id").alias("group_id"))
        .where((F.col("size") >= least) & (F.col("least_inside") == F.col("size")) & (F.col("most_links") == F.col("size"))).select("centre", "group_id")
    )
    found = stage(checked.join(good, "centre").select("id", "group_id"), "clusters")
    in_dense = F.broadcast(dense.join(found, "id").select("core", "octave", "s", "group_id"))  # bounded by the sample's places
    in_single = single.join(found.select(F.col("id").alias("ball"), "group_id"), "ball").select("s", "lo", "v", "group_id")
    return (
        narrow.where("core >= 0").join(in_dense, ["core", "octave", "s"]).select(F.col("id").alias(record_id), "group_id")
        .unionByName(narrow.where("core < 0").join(in_single, ["s", "lo", "v"]).select(F.col("id").alias(record_id), "group_id"))
    )


def typical_members(members: DataFrame, records: DataFrame, record_id: str, vector: list[str], top: int = 3, radius: float = 1.0) -> DataFrame:
    """(group_id, size, typical): every cluster's size and the ids of its ``top`` members of highest internal affinity.

    The affinity of two members is 1 - (distance / radius)^2, so a member's sum over its cluster follows from the cluster's
    sums of vectors and of squares, without pairs. Ties go to the smaller id.
    """
    v = [F.col(c).cast("double") for c in vector]
    rows = members.join(records.select(record_id, *[x.alias(f"v{i}") for i, x in enumerate(v)]), record_id)
    square = reduce(lambda a, b: a + b, [F.col(f"v{i}") * F.col(f"v{i}") for i in range(len(v))])
    sums = rows.groupBy("group_id").agg(F.count("*").alias("size"), F.sum(square).alias("q"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(v))])
    dot = reduce(lambda a, b: a + b, [F.col(f"v{i}") * F.col(f"s{i}") for i in range(len(v))])
    affinity = F.col("size") - (F.col("size") * square - 2 * dot + F.col("q")) / (radius * radius)
    ranked = rows.join(sums, "group_id").withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.round(affinity, 4)), record_id))).where(F.col("rank") <= top)
    return ranked.groupBy("group_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", record_id))), lambda r: r[record_id]).alias("typical"))
