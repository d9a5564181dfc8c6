"""Lines and polygons from rasters, and polygons cut to boxes.

Segments of contour lines and clipping are Column expressions; only thinning needs a
kernel, which sees one line.  Whole lines and outlines are in :mod:`terrace.operators.lines`.

Defined cases: a null ring stays null, an empty one empty; squares with a missing corner
have no segment; a line of two points is not thinned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clip_ring(ring: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """The part of a ring of (lon, lat) structs inside a box, one side of the box after the other; empty if nothing is left.

    Exact for convex rings; a concave ring that falls apart keeps its parts joined along
    the box's sides, with the right area.  A null ring stays null.
    """

    def cut(points: Column, axis: str, other: str, bound: Column, above: bool) -> Column:
        inside = lambda p: p[axis] >= bound if above else p[axis] <= bound

        def crossing(a: Column, b: Column) -> Column:
            rise = F.when(b[axis] != a[axis], b[axis] - a[axis]).otherwise(1.0)
            met = a[other] + (b[other] - a[other]) * (bound - a[axis]) / rise
            lon, lat = (bound, met) if axis == "lon" else (met, bound)
            return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))

        def step(a: Column, b: Column) -> Column:
            return F.array(F.when(inside(a) != inside(b), crossing(a, b)), F.when(inside(b), F.struct(b["lon"].cast("double").alias("lon"), b["lat"].cast("double").alias("lat"))))

        def walked(r: Column) -> Column:
            before = F.transform(r, lambda p, i: F.struct(F.get(r, F.when(i > 0, i - 1).otherwise(F.size(r) - 1)).alias("a"), p.alias("b")))
            return F.filter(F.flatten(F.transform(before, lambda e: step(e["a"], e["b"]))), lambda p: p.isNotNull())

        return let(points, walked)

    for axis, other, bound, above in (("lon", "lat", min_lon, True), ("lon", "lat", max_lon, False), ("lat", "lon", min_lat, True), ("lat", "lon", max_lat, False)):
        ring = cut(ring, axis, other, bound, above)
    return ring


def contour_segments(cells: DataFrame, interval: float, major: int = 5) -> DataFrame:
    """grid_id, level, major, r1, c1, r2, c2: the line of each level through each square of four cell centres.

    A square's side is crossed where one end is at least the level and the other is not.
    Squares with four crossings are split by the mean of their corners.
    """
    rows, cols = Window.partitionBy("grid_id", "r").orderBy("c"), Window.partitionBy("grid_id", "c").orderBy("r")
    wide = cells.select("grid_id", "r", "c", "z", F.lead("z").over(rows).alias("right"))
    wide = wide.select("*", F.lead("z").over(cols).alias("below"), F.lead("right").over(cols).alias("across")).where("right IS NOT NULL AND below IS NOT NULL AND across IS NOT NULL")
    corners = ("z", "right", "across", "below")
    first, last = (F.floor(F.least(*corners) / interval) + 1).cast("long"), F.floor(F.greatest(*corners) / interval).cast("long")
    wide = wide.where(last >= first).withColumn("step", F.explode(F.sequence(first, last))).withColumn("level", F.col("step") * float(interval))

    def side(a: str, b: str, r: Column, c: Column, dr: int, dc: int) -> Column:
        share = (F.col("level") - F.col(a)) / F.when(F.col(a) != F.col(b), F.col(b) - F.col(a)).otherwise(1.0)
        return F.when((F.col(a) >= F.col("level")) != (F.col(b) >= F.col("level")), F.struct((r + share * dr).alias("r"), (c + share * dc).alias("c")))

    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    sides = F.array(side("z", "right", r, c, 0, 1), side("right", "across", r, c + 1, 1, 0), side("below", "across", r + 1, c, 0, 1), side("z", "below", r, c, 1, 0))
    wide = wide.withColumn("p", F.filter(sides, lambda p: p.isNotNull()))
    pair = lambda a, b: F.struct(F.get("p", F.lit(a)).alias("a"), F.get("p", F.lit(b)).alias("b"))
    # In a saddle the corners on the mean's side are joined, so the lines cut off the two others.
    joined = (F.col("z") >= F.col("level")) == ((F.col("z") + F.col("right") + F.col("across") + F.col("below")) / 4 >= F.col("level"))
    lines = F.when(F.size("p") == 2, F.array(pair(0, 1))).when(joined, F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(0, 3), pair(1, 2)))
    out = wide.select("grid_id", "level", (F.col("step") % major == 0).alias("major"), F.explode(lines).alias("s"))
    return out.select("grid_id", "level", "major", F.col("s.a.r").alias("r1"), F.col("s.a.c").alias("c1"), F.col("s.b.r").alias("r2"), F.col("s.b.c").alias("c2"))


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of an open line that keep it within the tolerance (Douglas-Peucker), ends included."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, off = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        most = int(far.argmax())
        if far[most] > tolerance:
            keep[a + 1 + most] = True
            spans += [(a, a + 1 + most), (a + 1 + most, b)]
    return points[keep]


def thin_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring thinned in two halves, from its first point to the farthest and back; not closed."""
    if len(points) < 4:
        return points
    away = int(np.hypot(*(points - points[0]).T).argmax())
    there, back = thin(points[: away + 1], tolerance), thin(np.vstack([points[away:], points[:1]]), tolerance)
    return np.vstack([there, back[1:-1]])
