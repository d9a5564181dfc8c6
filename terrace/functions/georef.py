"""Georeferencing as Column expressions: web-Mercator tiles, affine grids, rings and bounding boxes.

Tile grids index pixel corners, affine grids index pixel centres (the step divides by
n - 1).  Degenerate affine grids raise an error when they are evaluated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
MAX_ZOOM = 15
MAX_TILES = 12
#: Metres of a pixel at zoom 0 on the equator, and of a degree (backend and client conventions).
GROUND = 156543.03392804097
METRES_PER_DEGREE = 111_320.0
CLIENT_KM_LAT, CLIENT_KM_LON = 110.574, 111.32


def tile_x(lon: Column, zoom) -> Column:
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom) -> Column:
    r = F.radians(lat)
    return (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)


def tile_lon(x: Column, zoom) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def tile_pixel_lon(col: Column, xmin, zoom) -> Column:
    return tile_lon(xmin + col / TILE, zoom)


def tile_pixel_lat(row: Column, ymin, zoom) -> Column:
    return tile_lat(ymin + row / TILE, zoom)


def tile_pixel_col(lon: Column, xmin, zoom) -> Column:
    return (tile_x(lon, zoom) - xmin) * TILE


def tile_pixel_row(lat: Column, ymin, zoom) -> Column:
    return (tile_y(lat, zoom) - ymin) * TILE


def ground_resolution(zoom, lat: Column) -> Column:
    """Metres of a pixel."""
    return GROUND * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def tile_grid_resolution(ymin, rows, zoom) -> Column:
    """Metres of a pixel at the centre row of a grid of tiles."""
    return ground_resolution(zoom, tile_pixel_lat(rows / 2.0, ymin, zoom))


def tile_range(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom) -> dict[str, Column]:
    """First and last tile of a bounding box; y grows southwards."""
    return {
        "xmin": F.floor(tile_x(min_lon, zoom)),
        "xmax": F.floor(tile_x(max_lon, zoom)),
        "ymin": F.floor(tile_y(max_lat, zoom)),
        "ymax": F.floor(tile_y(min_lat, zoom)),
    }


def exceeds_tile_budget(tiles: dict[str, Column], most: int = MAX_TILES) -> Column:
    return (tiles["xmax"] - tiles["xmin"] + 1 > most) | (tiles["ymax"] - tiles["ymin"] + 1 > most)


def clamped_zoom(zoom: Column) -> Column:
    return F.least(zoom, F.lit(MAX_ZOOM))


def affine_check(rows, cols, min_lon, min_lat, max_lon, max_lat) -> Column:
    """True, or an error for a degenerate box or a grid under 2 x 2."""
    good = (rows >= 2) & (cols >= 2) & (max_lon > min_lon) & (max_lat > min_lat)
    return F.when(good, True).otherwise(F.raise_error(F.lit("degenerate affine grid")).cast("boolean"))


def affine_lon(col: Column, cols, min_lon, max_lon) -> Column:
    return min_lon + col * ((max_lon - min_lon) / (cols - 1))


def affine_lat(row: Column, rows, min_lat, max_lat) -> Column:
    return max_lat - row * ((max_lat - min_lat) / (rows - 1))


def affine_col(lon: Column, cols, min_lon, max_lon) -> Column:
    return (lon - min_lon) / ((max_lon - min_lon) / (cols - 1))


def affine_row(lat: Column, rows, min_lat, max_lat) -> Column:
    return (max_lat - lat) / ((max_lat - min_lat) / (rows - 1))


def affine_resolution(rows, cols, min_lon, min_lat, max_lon, max_lat) -> Column:
    """Mean of the pixel's width and height in metres, at the middle latitude."""
    middle = F.radians((min_lat + max_lat) / 2.0)
    wide = (max_lon - min_lon) / (cols - 1) * METRES_PER_DEGREE * F.cos(middle)
    high = (max_lat - min_lat) / (rows - 1) * METRES_PER_DEGREE
    return (wide + high) / 2.0


def closed(ring: Column) -> Column:
    """A ring of points with its first point appended."""
    return F.concat(ring, F.array(F.get(ring, F.lit(0))))


def edges(ring: Column) -> Column:
    """Pairs of consecutive points of a ring, the last with the first."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring of (lon, lat) structs, in square degrees; 0 under three points."""
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]))
    return F.when(F.size(ring) >= 3, F.abs(twice) / 2.0).otherwise(0.0)


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area with degrees scaled at the ring's mean latitude."""
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    return ring_area(ring) * CLIENT_KM_LAT * CLIENT_KM_LON * F.cos(F.radians(mean_lat))


def bbox_area_km2(min_lon, min_lat, max_lon, max_lat) -> Column:
    middle = F.radians((min_lat + max_lat) / 2.0)
    return F.abs(max_lon - min_lon) * CLIENT_KM_LON * F.cos(middle) * F.abs(max_lat - min_lat) * CLIENT_KM_LAT


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray casting; a null ring contains everything."""

    def crossed(inside: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]).otherwise(1.0)
        left = lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / rise + a["lon"]
        return F.when(spans & left, ~inside).otherwise(inside)

    return F.when(ring.isNull(), True).otherwise(F.aggregate(edges(ring), F.lit(False), crossed))


def polygon_centroid(ring: Column) -> Column:
    """Area-weighted centroid (lon, lat) of a ring; the mean point where the area is zero."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        cross = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
        return F.struct((s["w"] + cross).alias("w"), (s["x"] + (e["a"]["lon"] + e["b"]["lon"]) * cross).alias("x"), (s["y"] + (e["a"]["lat"] + e["b"]["lat"]) * cross).alias("y"))

    def finish(s: Column) -> Column:
        mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / F.size(ring)
        flat = s["w"] == 0.0
        return F.struct(
            F.when(flat, mean("lon")).otherwise(s["x"] / (3.0 * F.when(flat, 1.0).otherwise(s["w"]))).alias("lon"),
            F.when(flat, mean("lat")).otherwise(s["y"] / (3.0 * F.when(flat, 1.0).otherwise(s["w"]))).alias("lat"),
        )

    return F.aggregate(edges(ring), start, add, finish)


def ring_bbox(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"), F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def image_size(min_lon, min_lat, max_lon, max_lat) -> tuple[Column, Column]:
    """Width and height of a 10 m image of a box, truncated and clipped to 256..2048."""
    middle = F.radians((min_lat + max_lat) / 2.0)
    clip = lambda metres: F.greatest(F.lit(256), F.least(F.lit(2048), (metres / 10.0).cast("int")))
    return clip((max_lon - min_lon) * METRES_PER_DEGREE * F.cos(middle)), clip((max_lat - min_lat) * METRES_PER_DEGREE)


def imagery_zoom(min_lon, max_lon, width: int = 1400, otherwise: int = 12) -> Column:
    """Largest zoom up to 18 whose image is at most ``width`` pixels wide."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(18)), lambda z: (max_lon - min_lon) / 360.0 * F.pow(F.lit(2.0), z) * TILE <= width)
    return F.coalesce(F.array_max(fits), F.lit(otherwise))


def parse_bbox(text: Column) -> Column:
    """Four comma-separated numbers as a struct, null if malformed."""
    parts = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("double"))
    good = (F.size(parts) == 4) & ~F.exists(parts, lambda v: v.isNull())
    return F.when(good, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))]))
