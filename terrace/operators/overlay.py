"""Areas under unions of polygons, by slabs.

A pond and what covers it are cut into horizontal slabs at every corner and every crossing
of their sides.  Inside a slab no sides cross, so ordered from left to right they bound
trapezoids, and the winding numbers passed on the way tell which lie inside the pond and
under at least one cover.  A point is inside a ring that crosses itself where its winding
number is not zero.

Defined cases: rings of fewer than three points have no area; rings may be open or closed
and run either way; a line of one point is a disc; lines without points have no strip.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners of a quarter of a strip's round ends.
QUARTER = 16
#: Numbers that a kernel's tables of sides by sides, or of slabs by sides by rings, hold at once.
CHUNK = 1 << 20


def _sides(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sides (x0, y0, x1, y1 with y0 < y1, direction) of rings, and the number of each one's ring; level sides do not count."""
    out, owner = [], []
    for k, ring in enumerate(rings):
        if len(ring) < 3:
            continue
        a, b = ring, np.roll(ring, -1, axis=0)
        up = b[:, 1] > a[:, 1]
        low, high = np.where(up[:, None], a, b), np.where(up[:, None], b, a)
        side = np.column_stack([low, high, np.where(up, 1, -1)])[a[:, 1] != b[:, 1]]
        out.append(side)
        owner.append(np.full(len(side), k))
    return (np.vstack(out), np.concatenate(owner)) if out else (np.zeros((0, 5)), np.zeros(0, dtype=int))


def _crossings(s: np.ndarray) -> np.ndarray:
    """The heights at which sides cross."""
    found = [np.zeros(0)]
    slope = (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])
    left, right = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    many = max(1, CHUNK // max(1, len(s)))
    for k in range(0, len(s), many):
        a = slice(k, k + many)
        low, high = np.maximum(s[a, 1, None], s[:, 1]), np.minimum(s[a, 3, None], s[:, 3])
        i, j = np.nonzero((low < high) & (left <= right[a, None]) & (right >= left[a, None]) & (slope != slope[a, None]) & (np.arange(len(s)) > np.arange(k, min(k + many, len(s)))[:, None]))
        p = i + k
        y = (s[j, 0] - slope[j] * s[j, 1] - s[p, 0] + slope[p] * s[p, 1]) / (slope[p] - slope[j])
        found.append(y[(y > low[i, j]) & (y < high[i, j])])
    return np.concatenate(found)


def covered_area(pond: np.ndarray, covers: list[np.ndarray]) -> float:
    """Area of the part of a ring that lies under the union of other rings; points are rows of x and y."""
    sides, owner = _sides([pond, *covers])
    own = sides[owner == 0]
    if not len(own):
        return 0.0
    # Heights are taken from the pond's lowest point, so that small ponds far from zero keep their digits.
    base = np.array([own[:, [0, 2]].min(), own[:, 1].min()])
    sides[:, :4] -= np.tile(base, 2)
    own = sides[owner == 0]
    near = (sides[:, 1] < own[:, 3].max()) & (sides[:, 3] > 0) & (np.minimum(sides[:, 0], sides[:, 2]) <= own[:, [0, 2]].max())
    sides, owner = sides[near], owner[near]
    names, owner = np.unique(owner, return_inverse=True)
    heights = np.unique(np.concatenate([sides[:, 1], sides[:, 3], _crossings(sides)]).clip(0, own[:, 3].max()))
    low, high = heights[:-1], heights[1:]
    turns = (owner[:, None] == np.arange(len(names))) * sides[:, 4, None].astype(np.int32)
    total, many = 0.0, max(1, CHUNK // max(1, turns.size))
    for k in range(0, len(low), many):
        y = ((low + high) / 2)[k : k + many, None]
        at = (sides[:, 1] < y) & (sides[:, 3] > y)
        x = np.where(at, sides[:, 0] + (y - sides[:, 1]) * (sides[:, 2] - sides[:, 0]) / (sides[:, 3] - sides[:, 1]), np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        inside = np.cumsum(np.where(np.take_along_axis(at, order, 1)[..., None], turns[order], 0), axis=1) != 0
        wet = inside[:, :-1, 0] & inside[:, :-1, 1:].any(axis=2)
        x = np.take_along_axis(x, order, 1)
        total += float(((high - low)[k : k + many, None] * np.subtract(x[:, 1:], x[:, :-1], where=wet, out=np.zeros(wet.shape))).sum())
    return total


def line_sides(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """wid, s (its ends a and b) of each side of each line (wid, coords of lon and lat), with the columns ``by``; a line of one point has one side."""
    points = F.filter("coords", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    onward = F.when(F.size(points) > 1, F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    sides = onward.otherwise(F.transform(points, lambda p: F.struct(p.alias("a"), p.alias("b"))))
    return lines.select("wid", *by, F.explode(sides).alias("s"))


def strip(side: Column, width: float, quarter: int = QUARTER) -> Column:
    """Ring of the strip within ``width`` of a side."""
    way = F.atan2(side["b"]["lat"] - side["a"]["lat"], side["b"]["lon"] - side["a"]["lon"])

    def cap(end: str, turn: float) -> Column:
        angle = lambda k: way + turn + k * (math.pi / (2 * quarter))
        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), lambda k: F.struct((side[end]["lon"] + width * F.cos(angle(k))).alias("lon"), (side[end]["lat"] + width * F.sin(angle(k))).alias("lat")))

    return F.concat(cap("b", -math.pi / 2), cap("a", math.pi / 2))


def strips(lines: DataFrame, width: float, quarter: int = QUARTER) -> DataFrame:
    """wid, ring of the strip within ``width`` of each side of each line (wid, coords of lon and lat); the strips of a line overlap at its corners."""
    return line_sides(lines).select("wid", strip(F.col("s"), width, quarter).alias("ring"))


def shared_areas(met: DataFrame, width: float) -> DataFrame:
    """n, shared from rows (n, pond, sides): the part of each pond under the union of the strips within ``width`` of the sides (array of a and b) of a line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shapes = frame[["px", "py", "rx", "ry"]].itertuples(index=False)
            areas = [covered_area(np.column_stack([px, py]), [np.column_stack(r) for r in zip(rx, ry, strict=True)]) for px, py, rx, ry in shapes]
            yield frame[["n"]].assign(shared=np.array(areas, dtype=float))

    axis = lambda ring, name: F.transform(ring, lambda p: p[name].cast("double"))
    drawn = met.select("n", "pond", F.transform("sides", lambda s: strip(s, width)).alias("rings"))
    flat = drawn.select("n", axis("pond", "lon").alias("px"), axis("pond", "lat").alias("py"), F.transform("rings", lambda r: axis(r, "lon")).alias("rx"), F.transform("rings", lambda r: axis(r, "lat")).alias("ry"))
    return flat.mapInPandas(run, "n long, shared double")
