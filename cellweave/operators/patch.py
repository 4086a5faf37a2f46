"""Square grey patches as flat arrays: moments, normalisation, orientation, placing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(p: Column, term) -> Column:
    return F.aggregate(F.transform(p, term), F.lit(0.0), lambda s, v: s + v)


def moments(p: Column, side: int) -> dict[str, Column]:
    """Mass, centroid and central second moments of a patch (row-major)."""
    x, y = (lambda i: i % side), (lambda i: F.floor(i / side))
    mass = _sum(p, lambda v, i: v.cast("double"))
    safe = F.nullif(mass, F.lit(0.0))
    cx, cy = _sum(p, lambda v, i: v * x(i)) / safe, _sum(p, lambda v, i: v * y(i)) / safe
    return {
        "mass": mass, "cx": cx, "cy": cy,
        "xx": _sum(p, lambda v, i: v * x(i) * x(i)) / safe - cx * cx, "yy": _sum(p, lambda v, i: v * y(i) * y(i)) / safe - cy * cy, "xy": _sum(p, lambda v, i: v * x(i) * y(i)) / safe - cx * cy,
    }


def orientation(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column]:
    """(angle in degrees, confidence) of the main axis from central second moments."""
    angle = F.degrees(F.atan2(2 * xy, xx - yy)) / 2
    spread = F.sqrt((xx - yy) ** 2 + 4 * xy * xy)
    return angle, F.try_divide(spread, xx + yy)


def wrap_angle(degrees: Column) -> Column:
    """The same angle in (-180, 180]."""
    return degrees - 360.0 * F.ceil((degrees - 180.0) / 360.0)


def grey_normalise(p: Column) -> dict[str, Column]:
    """Mean, population deviation and the patch divided by it; the mean stays, and a flat patch is divided by 1."""
    n = F.size(p)
    mean = _sum(p, lambda v, i: v.cast("double")) / n
    var = _sum(p, lambda v, i: v.cast("double") * v.cast("double")) / n - mean * mean
    std = F.when(var <= 0, F.lit(1.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return {"mean": mean, "std": std, "patch": F.transform(p, lambda v: v.cast("double") / std)}


def flip_needed(m: dict[str, Column], side: int) -> Column:
    """Whether a patch, given its ``moments``, is turned round: its centroid's larger offset from the middle pixel is negative."""
    dx, dy = (m[c] - float(side // 2) for c in ("cx", "cy"))
    return F.when(F.abs(dx) > F.abs(dy), dx < 0).otherwise(dy < 0)


def main_angle(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column]:
    """(angle in degrees, confidence) by which a patch is turned upright, from central second moments, in [-180, 180).

    The confidence is the ratio of the moments' difference to the mixed moment; at 0.1 or less the angle is a quarter turn
    by the mixed moment's sign alone.
    """
    confidence = F.when(xy != 0, F.abs((xx - yy) / xy)).otherwise(F.lit(0.0))
    part = F.when(confidence > 0.1, F.lit(0.5) - F.atan(2 * xy / (xx - yy)) / math.pi).otherwise(F.lit(0.0))
    turned = (F.when(part > 0.5, part - 1).otherwise(part) + F.signum(xy) / 2) * 90
    return F.when(turned >= 180, turned - 360).when(turned < -180, turned + 360).otherwise(turned), confidence


def weighted_width(p: Column, side: int, axis: str = "x") -> Column:
    """Deviation of the mass of a patch along an axis."""
    at = (lambda i: i % side) if axis == "x" else (lambda i: F.floor(i / side))
    mass = F.nullif(_sum(p, lambda v, i: v.cast("double")), F.lit(0.0))
    first, second = _sum(p, lambda v, i: v * at(i)) / mass, _sum(p, lambda v, i: v * at(i) * at(i)) / mass
    return F.sqrt(F.abs(second - first * first))


def pad(p: Column, side: int, to: int) -> Column:
    """The patch in the middle of a square of zeros, its offset cut to whole pixels."""
    off = int((to - side) / 2)
    cell = lambda k: (F.floor(k / to) - off, k % to - off)
    return F.transform(
        F.sequence(F.lit(0), F.lit(to * to - 1)),
        lambda k: F.when((cell(k)[0] >= 0) & (cell(k)[0] < side) & (cell(k)[1] >= 0) & (cell(k)[1] < side), F.get(p, (cell(k)[0] * side + cell(k)[1]).cast("int")).cast("double")).otherwise(0.0),
    )


def circle_radius(w: Column, h: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle around the centroid, rounded to a pixel (halves to the even one), that holds the whole patch: the distance of the farthest corner, rounded up."""
    x, y = F.bround(cx), F.bround(cy)
    far = lambda a, b: F.sqrt(a * a + b * b)
    return F.ceil(F.greatest(far(x, y), far(w - x, y), far(x, h - y), far(w - x, h - y)))


def _by_side(patches: pd.Series, work) -> list:
    """``work`` (array of n patches, side) on all patches of one size at once; null for null and empty ones, and for pixels beyond a square."""
    out: list = [None] * len(patches)
    sides: dict[int, list[int]] = {}
    for i, p in enumerate(patches):
        if p is not None and len(p):
            sides.setdefault(math.isqrt(len(p)), []).append(i)
    for side, rows in sides.items():
        stack = np.stack([np.asarray(patches.iloc[i], dtype=float)[: side * side] for i in rows]).reshape(-1, side, side)
        for i, r in zip(rows, work(stack, side, np.array(rows)), strict=True):
            out[i] = r
    return out


def smoothing_error():
    """Pandas UDF (patch): root of the mean absolute difference between a patch and its 7 x 7 Gaussian smoothing (sigma 1)."""
    g = np.exp(-(np.arange(-3, 4) ** 2) / 2.0)
    g /= g.sum()

    def errors(m: np.ndarray, side: int, rows: np.ndarray) -> np.ndarray:
        wide = np.pad(m, ((0, 0), (3, 3), (3, 3)), mode="reflect" if side > 3 else "edge")
        across = sum(w * wide[:, :, k : k + side] for k, w in enumerate(g))
        return np.sqrt(np.abs(m - sum(w * across[:, k : k + side] for k, w in enumerate(g))).mean(axis=(1, 2)))

    @F.pandas_udf("double")
    def error(patches: pd.Series) -> pd.Series:
        return pd.Series(_by_side(patches, errors), dtype=float)

    return error


def turned(m: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Every patch of (n, side, side) turned about its middle by its own angle, bilinear, with zeros outside."""
    side = m.shape[1]
    c = (side - 1) / 2
    yy, xx = np.mgrid[0:side, 0:side] - c
    cos, sin = (f(np.radians(degrees))[:, None, None] for f in (np.cos, np.sin))
    wide = np.pad(m, ((0, 0), (1, 1), (1, 1)))
    x, y = (np.clip(v + c + 1, 0, side + 1 - 1e-9) for v in (cos * xx + sin * yy, -sin * xx + cos * yy))
    i, j = y.astype(int), x.astype(int)
    u, v, n = y - i, x - j, np.arange(len(m))[:, None, None]
    return (1 - u) * (1 - v) * wide[n, i, j] + (1 - u) * v * wide[n, i, j + 1] + u * (1 - v) * wide[n, i + 1, j] + u * v * wide[n, i + 1, j + 1]


def rotate(side: int):
    """Pandas UDF (patch, degrees): bilinear rotation about the middle, zeros outside."""

    @F.pandas_udf("array<double>")
    def turn(patches: pd.Series, degrees: pd.Series) -> pd.Series:
        known = patches.where(degrees.notna(), None)
        return pd.Series(_by_side(known, lambda m, _, rows: list(turned(m, degrees.to_numpy(dtype=float)[rows]).reshape(len(m), -1))))

    return turn


def _centroids(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cx, cy, xx, yy, xy) of every patch; zeros for an empty one."""
    at = np.arange(m.shape[1])
    mass = m.sum(axis=(1, 2))
    safe = np.where(mass == 0, 1.0, mass)
    cx, cy = (m.sum(axis=1) * at).sum(1) / safe, (m.sum(axis=2) * at).sum(1) / safe
    xx, yy = (m.sum(axis=1) * at * at).sum(1) / safe - cx * cx, (m.sum(axis=2) * at * at).sum(1) / safe - cy * cy
    return cx, cy, xx, yy, (m * at[None, :, None] * at[None, None, :]).sum(axis=(1, 2)) / safe - cx * cy


def _upright(m: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patches, angles, confidences): every patch turned by its main angle, and by a half turn where its weight lies before the middle."""
    _, _, xx, yy, xy = _centroids(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        confidence = np.where(xy != 0, np.abs((xx - yy) / np.where(xy == 0, 1.0, xy)), 0.0)
        part = np.where(confidence > 0.1, 0.5 - np.arctan(2 * xy / np.where(xx == yy, np.nan, xx - yy)) / np.pi, 0.0)
    angle = (np.where(part > 0.5, part - 1, part) + np.sign(xy) / 2) * 90
    angle = np.where(angle >= 180, angle - 360, np.where(angle < -180, angle + 360, angle))
    out = turned(m, angle) * mask
    cx, cy, *_ = _centroids(out)
    dx, dy = cx - m.shape[1] // 2, cy - m.shape[1] // 2
    flip = np.where(np.abs(dx) > np.abs(dy), dx < 0, dy < 0)
    return np.where(flip[:, None, None], out[:, ::-1, ::-1], out) * mask, angle, confidence


NORMALISED = "padded_size int, padded_patch array<double>, rotation double, rotation_confidence double, horiz_std double, vert_std double, mean double, std double"


def normalise(sizes: tuple[int, ...] = (15, 51, 201)):
    """Pandas UDF (patch): a square patch set into the circle around its centroid, its grey values scaled, turned upright in two passes and padded.

    Rotation is the sum of both passes' angles, the confidence that of the second; padded size and patch are null beyond
    the largest size. Patches whose circles have one radius are worked on together.
    """

    def work(m: np.ndarray, side: int, rows: np.ndarray) -> list:
        cx, cy, *_ = _centroids(m)
        x, y = np.rint(cx).astype(int), np.rint(cy).astype(int)
        radius = np.ceil(np.sqrt(np.max([x * x + y * y, (side - x) ** 2 + y * y, x * x + (side - y) ** 2, (side - x) ** 2 + (side - y) ** 2], axis=0))).astype(int)
        done: list = [None] * len(m)
        for r in np.unique(radius):
            own = np.flatnonzero(radius == r)
            size = 2 * r + 1
            circle = np.zeros((len(own), size, size))
            for k, i in enumerate(own):
                circle[k, r - y[i] : r - y[i] + side, r - x[i] : r - x[i] + side] = m[i]
            mean, square = circle.mean(axis=(1, 2)), (circle**2).mean(axis=(1, 2))
            std = np.where(square > mean**2, np.sqrt(np.maximum(square - mean**2, 0)), 1.0)
            off = np.arange(-r, r + 1)
            mask = (np.hypot(off[:, None], off[None]) < r + 0.1).astype(float)
            once, first, _ = _upright(circle / std[:, None, None], mask)
            twice, second, confidence = _upright(once, mask)
            _, _, xx, yy, _ = _centroids(twice)
            to = next((int(s) for s in sizes if size < s), None)
            at = (to - size) // 2 if to else 0
            padded = np.pad(twice, ((0, 0), (at, to - size - at), (at, to - size - at))) if to else None
            for k, i in enumerate(own):
                done[i] = (to, padded[k].ravel() if to else None, first[k] + second[k], confidence[k], math.sqrt(abs(xx[k])), math.sqrt(abs(yy[k])), mean[k], std[k])
        return done

    @F.pandas_udf(NORMALISED)
    def run(patches: pd.Series) -> pd.DataFrame:
        empty = (None,) * 8
        rows = [r or empty for r in _by_side(patches, work)]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in NORMALISED.split(", ")])
        return frame.astype({"padded_size": "Int32"} | {c: float for c in frame.columns[2:]})

    return run
