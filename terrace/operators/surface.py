"""Surfaces from contour vertices: spacing, resolution, triangulation and interpolation.

Vertices are ``(grid_id, lon, lat, z)``, one grid_id for each contour document.  A
document is triangulated by one kernel call, so a task holds one document's vertices
and documents spread over tasks.  Triangles become cells by scan lines in DataFrame
functions: each triangle yields the cells it covers and no others.  Nearest vertices
are found through square buckets that grow until every query is settled.

Defined cases: rows with a null coordinate or elevation are left out; vertices at one
place count as one with their mean elevation; a document whose box has no width or no
height gives no cells; one whose vertices lie on a line has no triangles, so all its
cells take the nearest vertex; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.raster import cut_lineage

# Fixed values.
METRES_PER_DEGREE = 111_320.0
LEAST_SIDE, MOST_SIDE = 64, 2048
SAMPLES_PER_SPACING = 4.0
SPACING_SHARE = 0.25

#: The first buckets split a document's longer side into the root of its number of vertices, at most this many; each round takes buckets four times as wide.
_MOST_BUCKETS = 1024
#: Coordinates are triangulated on a lattice with this many steps a side, where whole numbers decide every test exactly.
_LATTICE = 1 << 30
_EDGE = 1e-9


def vertices(lines: DataFrame, grid_id: Column) -> DataFrame:
    """grid_id, lon, lat, z of every vertex of contour lines (elevation, coords)."""
    points = lines.select(grid_id.cast("long").alias("grid_id"), F.col("elevation").cast("double").alias("z"), F.explode("coords").alias("p"))
    return points.select("grid_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "z")


def _known(points: DataFrame) -> DataFrame:
    return points.select("grid_id", "lon", "lat", "z").dropna()


def extents(points: DataFrame) -> DataFrame:
    """grid_id, min_lon, min_lat, max_lon, max_lat: one row per document."""
    return _known(points).groupBy("grid_id").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def nearest(asked: DataFrame, points: DataFrame, other_level: bool = False) -> DataFrame:
    """The columns of ``asked`` (grid_id, lon, lat, ...), distance and nearest_z of the nearest vertex, in degrees; the lower one on a tie.

    With ``other_level`` only vertices whose z differs from the asked row's count.  Rows
    for which there is no vertex are left out.  A round settles what has a vertex within
    one bucket's width; a document's last buckets are as wide as itself.
    """
    names = asked.columns
    box = extents(points.unionByName(asked.select("grid_id", "lon", "lat", F.lit(0.0).alias("z"))))
    side = box.select("grid_id", F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(1e-12)).alias("side"))
    buckets = F.greatest(F.lit(1.0), F.least(F.lit(float(_MOST_BUCKETS)), F.sqrt(F.count(F.lit(1)))))
    side = cut_lineage(side.join(_known(points).groupBy("grid_id").agg(buckets.alias("buckets")), "grid_id"))
    known = cut_lineage(_known(points).distinct().join(side, "grid_id"))
    left = cut_lineage(asked.dropna(subset=["grid_id", "lon", "lat"]).join(side, "grid_id").withColumn("asked_id", F.monotonically_increasing_id()))
    done, times = [], 1
    while not left.isEmpty():
        width = F.col("side") * F.least(F.lit(1.0), times / F.col("buckets"))
        at = lambda v: F.floor(F.col(v) / width)  # noqa: E731, B023
        near = known.select("grid_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col("z").alias("pz"), at("lon").alias("bx"), at("lat").alias("by"))
        around = lambda v: F.explode(F.sequence(at(v) - 1, at(v) + 1))  # noqa: E731, B023
        pairs = left.withColumn("bx", around("lon")).withColumn("by", around("lat")).join(near, ["grid_id", "bx", "by"])
        if other_level:
            pairs = pairs.where("pz <> z")
        best = pairs.groupBy("asked_id").agg(F.min(F.struct(F.hypot(F.col("plon") - F.col("lon"), F.col("plat") - F.col("lat")).alias("distance"), F.col("pz").alias("z"))).alias("best"))
        found = cut_lineage(left.join(best, "asked_id", "left"))
        whole = F.col("buckets") <= times
        done.append(found.where(F.col("best").isNotNull() & (whole | (F.col("best.distance") <= width))).select(*names, F.col("best.distance").alias("distance"), F.col("best.z").alias("nearest_z")))
        left, times = found.where(~whole & (F.col("best").isNull() | (F.col("best.distance") > width))).drop("best"), times * 4
    if not done:
        return left.select(*names, F.lit(0.0).alias("distance"), F.lit(0.0).alias("nearest_z"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def contour_spacing(points: DataFrame) -> DataFrame:
    """grid_id, spacing_deg: the lower quartile, over all vertices, of the distance to the nearest vertex of another elevation.

    A document with one elevation has no row.
    """
    own = _known(points).groupBy("grid_id", "lon", "lat", "z").agg(F.count(F.lit(1)).alias("n"))
    found = nearest(own, points, other_level=True)
    return found.groupBy("grid_id").agg(F.percentile("distance", F.lit(SPACING_SHARE), F.col("n")).alias("spacing_deg"))


def spacing_m(spacing_deg: Column, min_lat: Column, max_lat: Column) -> Column:
    """Degrees as metres, the mean of both axes at the middle latitude."""
    return spacing_deg * METRES_PER_DEGREE * (F.cos(F.radians((min_lat + max_lat) / 2)) + 1) / 2


def resolution(requested, spacing: Column) -> Column:
    """Metres a cell: what is requested (an error unless positive), else a quarter of the spacing."""
    derived = F.greatest(spacing / SAMPLES_PER_SPACING, F.lit(1e-6))
    if requested is None:
        return derived
    asked = F.lit(requested).cast("double") if not isinstance(requested, Column) else requested
    return F.when(asked <= 0, F.raise_error(F.lit("resolution must be positive")).cast("double")).otherwise(F.coalesce(asked, derived))


def grids(points: DataFrame, requested_m: float | None = None) -> DataFrame:
    """grid_id, box, asked_m, n_rows, n_cols of each document's raster."""
    box = extents(points).where("max_lon > min_lon AND max_lat > min_lat")
    if requested_m is None:
        box = box.join(contour_spacing(points), "grid_id")
    else:
        box = box.withColumn("spacing_deg", F.lit(None).cast("double"))
    box = box.withColumn("asked_m", resolution(requested_m, spacing_m(F.col("spacing_deg"), F.col("min_lat"), F.col("max_lat"))))
    clamp = lambda metres: F.greatest(F.lit(LEAST_SIDE), F.least(F.lit(MOST_SIDE), F.rint(metres / F.col("asked_m")))).cast("int")
    wide = (F.col("max_lon") - F.col("min_lon")) * METRES_PER_DEGREE * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    high = (F.col("max_lat") - F.col("min_lat")) * METRES_PER_DEGREE
    return box.withColumn("n_rows", clamp(high)).withColumn("n_cols", clamp(wide))


def delaunay(x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """Counter-clockwise Delaunay triangles of distinct points with whole coordinates; none if all lie on a line.

    Points go in one by one, in rounds that double in size and run along a Morton curve.
    A point removes every triangle whose circle holds it and is joined to the rim of the
    hole.  A vertex at infinity closes the hull, so no far points are made up.
    """
    n = len(x)
    if n < 3:
        return []

    def turn(a: int, b: int, c: int) -> int:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    order = _insertion_order(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64))
    a, b = order[0], order[1]
    third = next((k for k in order[2:] if turn(a, b, k)), None)
    if third is None:
        return []
    if turn(a, b, third) < 0:
        a, b = b, a
    far, apex = n, {}  # directed edge -> the third corner of the triangle on its left

    def add(i: int, j: int, k: int) -> None:
        apex[i, j], apex[j, k], apex[k, i] = k, i, j

    def drop(i: int, j: int, k: int) -> None:
        del apex[i, j], apex[j, k], apex[k, i]

    def holds(i: int, j: int, k: int, p: int) -> bool:
        if far in (i, j, k):
            while k != far:
                i, j, k = j, k, i
            side = turn(i, j, p)
            if side:
                return side > 0
            return (x[p] - x[i]) * (x[p] - x[j]) + (y[p] - y[i]) * (y[p] - y[j]) < 0
        px, py = x[p], y[p]
        ax, ay, bx, by, cx, cy = x[i] - px, y[i] - py, x[j] - px, y[j] - py, x[k] - px, y[k] - py
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    add(a, b, third)
    for i, j in ((b, a), (third, b), (a, third)):
        add(i, j, far)
    here = (a, b, third)
    for p in order:
        if p in (a, b, third):
            continue
        i, j, k = here
        while far not in (i, j, k):  # walk towards p; a hull edge that is crossed leads to a triangle at infinity
            if turn(i, j, p) < 0:
                i, j, k = j, i, apex[j, i]
            elif turn(j, k, p) < 0:
                i, j, k = k, j, apex[k, j]
            elif turn(k, i, p) < 0:
                i, j, k = i, k, apex[i, k]
            else:
                break
        drop(i, j, k)
        rim, made = [(i, j), (j, k), (k, i)], []
        while rim:
            s, t = rim.pop()
            o = apex[t, s]
            if holds(t, s, o, p):
                drop(t, s, o)
                rim += [(s, o), (o, t)]
            else:
                made.append((s, t))
        for s, t in made:
            add(s, t, p)
            if far not in (s, t):
                here = (s, t, p)
    return [(i, j, k) for (i, j), k in apex.items() if i < j and i < k and far not in (i, j, k)]


def _insertion_order(x: np.ndarray, y: np.ndarray) -> list[int]:
    place = np.random.default_rng(0).permutation(len(x))
    code = np.zeros(len(x), dtype=np.uint64)
    for bit in range(16):
        for shift, v in ((0, x), (1, y)):
            code |= ((v.astype(np.uint64) >> np.uint64(15 + bit)) & np.uint64(1)) << np.uint64(2 * bit + shift)
    return np.lexsort((code, np.log2(place + 1).astype(int))).tolist()


_CORNERS = ", ".join(f"lon{i} double, lat{i} double, z{i} double" for i in (1, 2, 3))


def triangles(points: DataFrame) -> DataFrame:
    """grid_id and the three corners (lon1, lat1, z1, ...) of each document's Delaunay triangles."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lon, lat = frame["lon"].to_numpy(), frame["lat"].to_numpy()
        step = max(np.ptp(lon), np.ptp(lat)) / _LATTICE or 1.0
        lattice = pd.DataFrame({"x": np.rint((lon - lon.min()) / step).astype(np.int64), "y": np.rint((lat - lat.min()) / step).astype(np.int64), "lon": lon, "lat": lat, "z": frame["z"].to_numpy()})
        one = lattice.groupby(["x", "y"], as_index=False).agg({"lon": "min", "lat": "min", "z": "mean"})
        found = np.array(delaunay(one["x"].tolist(), one["y"].tolist()), dtype=np.int64).reshape(-1, 3)
        out = {"grid_id": np.full(len(found), frame["grid_id"].iloc[0])}
        for i in (1, 2, 3):
            for name in ("lon", "lat", "z"):
                out[f"{name}{i}"] = one[name].to_numpy()[found[:, i - 1]]
        return pd.DataFrame(out)

    return _known(points).groupBy("grid_id").applyInPandas(run, f"grid_id long, {_CORNERS}")


def _scanned(faces: DataFrame, frames: DataFrame) -> DataFrame:
    """grid_id, r, c, z of every cell whose centre lies in a triangle."""
    rows = faces.join(frames, "grid_id")
    for i in (1, 2, 3):
        rows = rows.withColumn(f"x{i}", (F.col(f"lon{i}") - F.col("min_lon")) / (F.col("max_lon") - F.col("min_lon")) * (F.col("n_cols") - 1))
        rows = rows.withColumn(f"y{i}", (F.col("max_lat") - F.col(f"lat{i}")) / (F.col("max_lat") - F.col("min_lat")) * (F.col("n_rows") - 1))
    up, down = (lambda v: F.ceil(v - _EDGE).cast("int")), (lambda v: F.floor(v + _EDGE).cast("int"))
    top, low = F.greatest(up(F.least("y1", "y2", "y3")), F.lit(0)), F.least(down(F.greatest("y1", "y2", "y3")), F.col("n_rows") - 1)
    rows = rows.withColumn("top", top).withColumn("low", low).where("low >= top").withColumn("r", F.explode(F.sequence("top", "low")))

    def crossings(i: int, j: int) -> list[Column]:
        (xi, yi), (xj, yj) = ((F.col(f"x{k}"), F.col(f"y{k}")) for k in (i, j))
        met = (F.col("r") >= F.least(yi, yj) - _EDGE) & (F.col("r") <= F.greatest(yi, yj) + _EDGE)
        flat = F.abs(yj - yi) <= _EDGE
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("r") - yi) / F.when(flat, F.lit(1.0)).otherwise(yj - yi)))
        return [F.when(met & flat, xi).when(met, xi + share * (xj - xi)), F.when(met & flat, xj)]

    at = [c for i, j in ((1, 2), (2, 3), (3, 1)) for c in crossings(i, j)]
    rows = rows.withColumn("first", F.greatest(up(F.least(*at)), F.lit(0))).withColumn("last", F.least(down(F.greatest(*at)), F.col("n_cols") - 1))
    rows = rows.where("last >= first").withColumn("c", F.explode(F.sequence("first", "last")))
    area = F.expr("(x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)")
    two, three = F.expr("(c - x1) * (y3 - y1) - (x3 - x1) * (r - y1)") / area, F.expr("(x2 - x1) * (r - y1) - (c - x1) * (y2 - y1)") / area
    rows = rows.where(area != 0).select("grid_id", "r", "c", (F.col("z1") + two * (F.col("z2") - F.col("z1")) + three * (F.col("z3") - F.col("z1"))).alias("z"))
    return rows.groupBy("grid_id", "r", "c").agg(F.min("z").alias("z"))  # a cell on a shared edge has one value up to rounding


def build_surface(points: DataFrame, requested_m: float | None = None, frames: DataFrame | None = None) -> DataFrame:
    """grid_id, r, c, z, inside_hull: linear inside the vertices' hull, the nearest vertex's elevation outside; row 0 is north.

    ``frames`` are the documents' rasters from :func:`grids`, where they are known already.
    """
    points = cut_lineage(_known(points))
    frames = cut_lineage(grids(points, requested_m)) if frames is None else frames
    inside = cut_lineage(_scanned(triangles(points), frames))
    cells = frames.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    lon = F.col("min_lon") + F.col("c") * (F.col("max_lon") - F.col("min_lon")) / (F.col("n_cols") - 1)
    lat = F.col("max_lat") - F.col("r") * (F.col("max_lat") - F.col("min_lat")) / (F.col("n_rows") - 1)
    rest = cells.join(inside, ["grid_id", "r", "c"], "left_anti").select("grid_id", "r", "c", lon.alias("lon"), lat.alias("lat"))
    beyond = nearest(rest, points).select("grid_id", "r", "c", F.col("nearest_z").alias("z"), F.lit(False).alias("inside_hull"))
    return inside.withColumn("inside_hull", F.lit(True)).unionByName(beyond)
