"""Polygons as arrays of vertices: area, boxes, edges, containment with a ring around, overlaps, shift searches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(vertices: Column) -> Column:
    """Array of (ax, ay, bx, by), closing the ring."""
    n = F.size(vertices)
    return F.transform(
        vertices,
        lambda v, i: F.struct(v.x.alias("ax"), v.y.alias("ay"), F.get(vertices, (i + 1) % n).x.alias("bx"), F.get(vertices, (i + 1) % n).y.alias("by")),
    )


def polygon_area(vertices: Column) -> Column:
    """Shoelace area; 0 for fewer than three vertices."""
    return F.abs(F.aggregate(edges(vertices), F.lit(0.0), lambda s, e: s + e.ax * e.by - e.bx * e.ay)) / 2


def bounding_box(vertices: Column, margin: float = 0.0) -> list[Column]:
    axis = lambda k: F.transform(vertices, lambda v: v[k])
    return [(F.array_min(axis("x")) - margin).alias("left"), (F.array_max(axis("x")) + margin).alias("right"), (F.array_min(axis("y")) - margin).alias("up"), (F.array_max(axis("y")) + margin).alias("down")]


def inside(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossings = F.filter(edge_list, lambda e: ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax))
    return F.size(crossings) % 2 == 1


def distance_to(edge_list: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest edge."""

    def to(e):
        dx, dy = e.bx - e.ax, e.by - e.ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - e.ax) * dx + (y - e.ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.sqrt((x - e.ax - t * dx) ** 2 + (y - e.ay - t * dy) ** 2)

    return F.array_min(F.transform(edge_list, to))


def in_cells(points: DataFrame, regions: DataFrame, by: list[str], margin: float, cell: int = 512) -> DataFrame:
    """Candidate pairs of points and regions: those of one plane that share a grid cell, with the region widened by ``margin``.

    A point has one cell and a region the cells of its widened box, so the join is an equi-join whose keys are as many as
    the occupied cells; the box conjuncts follow. ``regions`` needs vertices.
    """
    boxed = regions.select("*", *bounding_box(F.col("vertices"), margin)).where("left IS NOT NULL AND up IS NOT NULL")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    placed = boxed.withColumn("_cx", F.explode(span("left", "right"))).withColumn("_cy", F.explode(span("up", "down")))
    located = points.withColumn("_cx", F.floor(F.col("x") / cell).cast("long")).withColumn("_cy", F.floor(F.col("y") / cell).cast("long"))
    return located.join(placed, [*by, "_cx", "_cy"]).where((F.col("x") >= F.col("left")) & (F.col("x") <= F.col("right")) & (F.col("y") >= F.col("up")) & (F.col("y") <= F.col("down"))).drop("_cx", "_cy")


def ring_split(points: DataFrame, regions: DataFrame, by: list[str], margin: float) -> DataFrame:
    """Points in or near regions with ``polarity``: ``positive`` inside, ``negative`` outside but within ``margin`` of the border."""
    e = edges(F.col("vertices"))
    pairs = in_cells(points, regions.where(F.size("vertices") >= 3), by, margin)
    within = inside(e, F.col("x"), F.col("y"))
    near = distance_to(e, F.col("x"), F.col("y")) <= margin
    return pairs.withColumn("polarity", F.when(within, F.lit("positive")).when(near, F.lit("negative"))).where("polarity IS NOT NULL").drop("left", "right", "up", "down")


def overlaps(boxes: DataFrame, plane: list[str], name: str, cell: int = 1024) -> DataFrame:
    """(plane, a, b): pairs of boxes of one plane that overlap in open intervals of x and y, a < b.

    Boxes carry left, right, up, down. A box has a row for every grid cell it touches, boxes of one cell meet by an
    equi-join, and a pair is reported in the cell of its overlap's upper left corner only.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    placed = boxes.where("left <= right AND up <= down").withColumn("_cx", span("left", "right")).withColumn("_cy", span("up", "down"))
    other = placed.select(*plane, "_cx", "_cy", *[F.col(c).alias(f"{c}2") for c in (name, "left", "right", "up", "down")])
    meet = (F.col(name) < F.col(f"{name}2")) & (F.col("left") < F.col("right2")) & (F.col("left2") < F.col("right")) & (F.col("up") < F.col("down2")) & (F.col("up2") < F.col("down"))
    here = (F.floor(F.greatest("left", "left2") / cell) == F.col("_cx")) & (F.floor(F.greatest("up", "up2") / cell) == F.col("_cy"))
    return placed.join(other, [*plane, "_cx", "_cy"]).where(meet & here).select(*plane, F.col(name).alias("a"), F.col(f"{name}2").alias("b"))


def shift_counts(points: DataFrame, regions: DataFrame, by: list[str], offsets: list[tuple[int, int]], keys: list[str], value: Column | None = None) -> DataFrame:
    """(keys, dx, dy, n, total): how many points, and what sum of ``value``, each region holds when it is moved by each offset.

    Only points in the region's box, widened by the largest shift, take part; the offsets are a short literal list, so a
    point is tested against all shifts of its own regions in one row before it is counted.
    """
    reach = float(max(max(abs(a), abs(b)) for a, b in offsets))
    e = F.col("_edges")
    pairs = in_cells(points, regions.where(F.size("vertices") >= 3).withColumn("_edges", edges(F.col("vertices"))), by, reach)
    shifts = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])
    hit = F.filter(shifts, lambda s: inside(e, F.col("x") - s.dx, F.col("y") - s.dy))
    return pairs.select(*keys, (F.lit(0.0) if value is None else value).alias("_v"), F.explode(hit).alias("s")).groupBy(*keys, "s.dx", "s.dy").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def row_spans(rows, vertices, margin: float):
    """On every row (a y): the polygon's crossings in falling order, -inf for none, and the intervals (low, high) that the polygon with its ring covers, disjoint, inf and -inf for none."""
    import numpy as np

    a, b = vertices, np.roll(vertices, -1, axis=0)

    def crossing(p, q, py, none):
        cut = (p[:, 1] > py) != (q[:, 1] > py)
        rise = np.where(p[:, 1] == q[:, 1], 1.0, q[:, 1] - p[:, 1])
        return np.where(cut, (q[:, 0] - p[:, 0]) * (py - p[:, 1]) / rise + p[:, 0], none)

    within = np.flatnonzero((rows >= a[:, 1].min()) & (rows <= a[:, 1].max()))
    met = np.sort(crossing(a, b, rows[within, None], -np.inf), axis=1)[:, ::-1]
    crossings = np.full((len(rows), max(1, int(np.isfinite(met).sum(axis=1).max(initial=0)))), -np.inf)
    crossings[within] = met[:, : crossings.shape[1]]
    # each edge's capsule cuts the row in one interval, from the discs of its ends and its two long sides
    py = rows[:, None]
    off_row = py - a[:, 1]
    meets = np.abs(off_row) <= margin
    span = np.sqrt(np.maximum(0.0, margin * margin - off_row**2))
    left, right = np.where(meets, a[:, 0] - span, np.inf), np.where(meets, a[:, 0] + span, -np.inf)
    low, high = np.minimum(left, np.roll(left, -1, axis=1)), np.maximum(right, np.roll(right, -1, axis=1))
    along = b - a
    length = np.hypot(along[:, 0], along[:, 1])[:, None]
    off = np.where(length > 0, np.stack([-along[:, 1], along[:, 0]], axis=1) / np.where(length > 0, length, 1.0) * margin, 0.0)
    for p, q in ((a + off, b + off), (b - off, a - off)):
        r = np.flatnonzero((rows >= min(p[:, 1].min(), q[:, 1].min())) & (rows <= max(p[:, 1].max(), q[:, 1].max())))
        at = crossing(p, q, py[r], np.nan)
        low[r], high[r] = np.fmin(low[r], at), np.fmax(high[r], at)
    # edges that meet the row are linked where it meets the disc of their common vertex; the inside ends at edges, so if all are linked there is one interval
    parts = np.isfinite(low).sum(axis=1) - meets.sum(axis=1)
    loose = np.flatnonzero(parts > 1)
    first, last = low.min(axis=1)[:, None], high.max(axis=1)[:, None]
    if len(loose):
        some_first, some_last = merged_spans(crossings[loose], low[loose], high[loose])
        first = np.concatenate([first, np.full((len(rows), some_first.shape[1] - 1), np.inf)], axis=1)
        last = np.concatenate([last, np.full((len(rows), some_last.shape[1] - 1), -np.inf)], axis=1)
        first[loose], last[loose] = some_first, some_last
    return crossings, first, last


def merged_spans(crossings, low, high):
    """The union of each row's intervals and of those between its crossings, as disjoint intervals."""
    import numpy as np

    pairs = crossings[:, : crossings.shape[1] // 2 * 2]
    low = np.concatenate([low, np.where(np.isfinite(pairs[:, 1::2]), pairs[:, 1::2], np.inf)], axis=1)
    high = np.concatenate([high, np.where(np.isfinite(pairs[:, 1::2]), pairs[:, ::2], -np.inf)], axis=1)
    order = np.argsort(low, axis=1)
    low, high = np.take_along_axis(low, order, axis=1), np.maximum.accumulate(np.take_along_axis(high, order, axis=1), axis=1)
    begins = np.isfinite(low)
    begins[:, 1:] &= low[:, 1:] > high[:, :-1]
    which = np.cumsum(begins, axis=1) - 1
    most = max(1, int(which.max()) + 1)
    first, last = np.full((len(low), most), np.inf), np.full((len(low), most), -np.inf)
    r, c = np.nonzero(begins)
    first[r, which[r, c]] = low[r, c]
    r, c = np.nonzero(np.isfinite(low))
    np.maximum.at(last, (r, which[r, c]), high[r, c])
    return first, last


def shift_sums(x, y, z, value, vertices, nx: int, ny: int, step: int, margin: float, sums, bound: int = 8192) -> None:
    """Add to ``sums`` (4, levels, 2 ny + 1, 2 nx + 2) the running differences along x of: points inside, points inside or in the ring, and their sums of ``value``.

    ``z`` is the level of each point. A point and a shift in y meet the polygon on one row; rows repeat, since points differ from them
    by whole steps, so each row's spans are found once, and a span adds two numbers, where its shifts in x begin and end.
    """
    import numpy as np

    wide = 2 * nx + 2
    rest, of = np.unique(np.mod(y, step), return_inverse=True)
    top, bottom = vertices[:, 1].min() - margin, vertices[:, 1].max() + margin
    least, most = int(np.floor(top / step)) - 1, int(np.ceil(bottom / step))
    deep = most - least + 1
    crossings, first, last = row_spans((rest[:, None] + step * np.arange(least, most + 1)[None]).ravel(), vertices, margin)
    shift = np.round((y - np.mod(y, step)) / step).astype("int64")
    shape = sums.shape[1:]

    def add(k, cell, at, v, sign):
        cell = cell * wide + np.clip(at + nx, 0, wide - 1).astype("int64")
        sums[k] += sign * np.bincount(cell, minlength=sums[k].size).reshape(shape)
        sums[k + 2] += sign * np.bincount(cell, v, minlength=sums[k].size).reshape(shape)

    for i in range(0, len(x), bound):  # bounds the arrays
        part = slice(i, i + bound)
        j = shift[part, None] - np.arange(least, most + 1)[None]  # the shift in y that brings the point to each row
        p, k = np.nonzero(np.abs(j) <= ny)
        row, cell, px, v = of[part][p] * deep + k, z[part][p] * shape[1] + j[p, k] + ny, x[part][p], value[part][p]
        for c in range(first.shape[1]):
            a, b = np.ceil((px - last[row, c]) / step), np.floor((px - first[row, c]) / step)  # a > b where there is none
            held = np.flatnonzero((a <= b) & (a <= nx) & (b >= -nx))
            some = cell[held]
            add(1, some, a[held], v[held], 1)
            add(1, some, b[held] + 1, v[held], -1)
        for c in range(crossings.shape[1]):  # every crossing passed turns inside and outside round
            at = crossings[row, c]
            some = np.flatnonzero(at > -np.inf)
            add(0, cell[some], np.floor((px[some] - at[some]) / step) + 1, v[some], -1 if c % 2 else 1)


def shift_search(points: DataFrame, regions: DataFrame, stack: str, section: str, name: str, half: tuple[int, int, int], step: int, margin: float, value: Column | None = None, tile: int = 4096) -> DataFrame:
    """(stack, name, dx, dy, dz, positive, negative, positive_total, negative_total): points, and their sums of ``value``, inside each region and in its ring at every shift.

    Shifts are -half..half steps in x and y and whole sections in z. Shifts that meet no point have no row. A region is counted in one task, that of the
    tile of its upper left corner, and points go to the tiles whose regions reach their neighbourhood; so no pair of point and region is a row, and
    the counts, which are far more than the input, are not shuffled. Regions of one ``name`` are counted together.
    """
    nx, ny, nz = half
    reach, near = margin + step * max(nx, ny), tile // 4
    at = lambda c, size: F.floor(F.col(c) / size).cast("long")
    boxed = regions.where(F.size("vertices") >= 3).where(f"{stack} IS NOT NULL AND {section} IS NOT NULL").select("*", *bounding_box(F.col("vertices"))).where("left IS NOT NULL AND up IS NOT NULL")
    ends = [f(c).alias(c) for c, f in (("left", F.min), ("right", F.max), ("up", F.min), ("down", F.max))]
    named = boxed.groupBy(stack, name).agg(*ends, F.collect_list(F.struct(F.col(section).alias("s"), F.col("vertices").alias("vertices"))).alias("outlines"))
    placed = named.withColumn("_ax", at("left", tile)).withColumn("_ay", at("up", tile))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / near).cast("long"), F.floor((F.col(b) + reach) / near).cast("long")))
    wanted = placed.select(stack, "_ax", "_ay", "up", "down", span("left", "right").alias("_cx")).distinct().select(stack, "_ax", "_ay", "_cx", span("up", "down").alias("_cy")).distinct()
    located = points.where(" AND ".join(f"{c} IS NOT NULL" for c in (stack, section, "x", "y"))).select(
        stack, section, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.lit(0.0) if value is None else value.cast("double")).alias("_v")
    )
    sent = located.withColumn("_cx", at("x", near)).withColumn("_cy", at("y", near)).join(wanted, [stack, "_cx", "_cy"])
    tagged = sent.select(stack, "_ax", "_ay", F.lit(0).alias("_kind"), F.col(section).alias("_z"), "x", "y", "_v", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in (name, "outlines")]).unionByName(
        placed.select(stack, "_ax", "_ay", F.lit(1).alias("_kind"), F.lit(None).cast(located.schema[section].dataType).alias("_z"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "_v")], name, "outlines")
    )
    key = [stack, "_ax", "_ay"]
    tasks = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small partitions are much work here and must not be put together
    ordered = tagged.repartition(tasks, *key).sortWithinPartitions(*key, "_kind", "_z")  # a tile's points come before its regions

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, pieces, sections = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in key]
            kind = batch.column("_kind").to_numpy()
            tiles = list(zip(*columns, strict=True))
            starts = [i for i in range(len(tiles)) if not i or tiles[i] != tiles[i - 1] or kind[i] != kind[i - 1]] + [len(tiles)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if tiles[lo] != held:
                    held, pieces, sections = tiles[lo], [], None
                if not kind[lo]:
                    pieces.append([batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("_z", "x", "y", "_v")])
                    continue
                if sections is None:
                    sections, x, y, v = [np.concatenate(c) for c in zip(*pieces, strict=True)] if pieces else [np.zeros(0)] * 4
                    sections = sections.astype("int64")
                for r in range(lo, hi):
                    met = []
                    for outline in batch.column("outlines")[r].as_py():
                        corners = np.array([[c["x"], c["y"]] for c in outline["vertices"]], dtype=float)
                        a, b = np.searchsorted(sections, [outline["s"] - nz, outline["s"] + nz + 1])
                        (left, up), (right, down) = corners.min(axis=0) - reach, corners.max(axis=0) + reach
                        some = a + np.flatnonzero((x[a:b] >= left) & (x[a:b] <= right) & (y[a:b] >= up) & (y[a:b] <= down))
                        if len(some):
                            met.append((corners, some, sections[some] - outline["s"]))
                    if not met:
                        continue
                    levels = np.unique(np.concatenate([dz for _, _, dz in met]))  # shifts by sections that meet points
                    sums = np.zeros((4, len(levels), 2 * ny + 1, 2 * nx + 2))
                    for corners, some, dz in met:
                        shift_sums(x[some], y[some], np.searchsorted(levels, dz), v[some], corners, nx, ny, step, margin, sums)
                    sums = np.cumsum(sums, axis=3)[..., :-1]
                    k, j, i = np.nonzero(sums[1])
                    if len(i):
                        inside, all_in, inside_total, total = (s[k, j, i] for s in sums)
                        same = pa.array(np.zeros(len(i), "int32"))
                        fixed = [pa.array(batch.column(c).slice(r, 1)).take(same) for c in (stack, name)]
                        ints = [pa.array(c.astype("int32")) for c in ((i - nx) * step, (j - ny) * step, levels[k])]
                        counts = [pa.array(c.astype("int64")) for c in (inside, all_in - inside)]
                        yield pa.RecordBatch.from_arrays([*fixed, *ints, *counts, pa.array(inside_total), pa.array(total - inside_total)], names)

    names = [stack, name, "dx", "dy", "dz", "positive", "negative", "positive_total", "negative_total"]
    kinds = dict(regions.dtypes)
    return ordered.mapInArrow(count, f"{stack} {kinds[stack]}, {name} {kinds[name]}, dx int, dy int, dz int, positive long, negative long, positive_total double, negative_total double")
