"""Contour lines and region outlines of rasters of any size, piece by piece.

Each block (:mod:`terrace.operators.blocks`) follows the lines inside it; pieces that leave
a block are put in order by pointer doubling over pieces.  A contour line runs through the
squares between cell centres with the ground at or above its level on its left, so that
every crossed side is entered once and left once.  A region's ring runs along the sides of
its cells, clockwise around it and counter-clockwise around its holes; a ring's signed area
is the number of cells inside, so that the rings of a region add up to its cells.

Defined cases: squares with a missing or null corner have no line, so lines end there and
at the raster's edge; closed lines repeat no point and are marked; cells without a label
belong to no region; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import raster
from terrace.operators.blocks import BLOCK, SHIFT, SPAN, Window, ranked, with_halo
from terrace.operators.geometry import clip_ring, let, thin, thin_ring

#: Sides of a cell, clockwise from the top, with the direction in which a ring passes each.
_AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
_PIECES = "grid_id long, grp long, start long, next long, loop boolean, keys array<long>, shares array<double>"
#: Shorter lines and smaller outlines are specks.
LEAST_LENGTH_PX, LEAST_AREA_PX = 8.0, 6.0
#: Bands are told apart inside a grid by this many steps on either side of zero, so a grid_id moves by 24 bits.
_STEPS = 1 << 23


def _follow(starts: np.ndarray, nexts: np.ndarray) -> Iterator[tuple[np.ndarray, int | None, bool]]:
    """Lines through links start -> next (each number once on either side): places of the starts in order, what the last leads to, and whether it is a loop."""
    place = {s: k for k, s in enumerate(starts.tolist())}
    onward = [place.get(n, -1) for n in nexts.tolist()]
    entered = np.zeros(len(starts), dtype=bool)
    entered[[k for k in onward if k >= 0]] = True
    seen = bytearray(len(starts))
    for first in (*np.nonzero(~entered)[0].tolist(), *np.argsort(starts, kind="stable").tolist()):
        if seen[first]:
            continue
        line, at = [], first
        while at >= 0 and not seen[at]:
            seen[at] = 1
            line.append(at)
            at = onward[at]
        yield np.array(line), None if at >= 0 else int(nexts[line[-1]]), at >= 0


def _assembled(pieces: DataFrame, tails: bool) -> DataFrame:
    """grid_id, grp, closed, keys and shares of whole lines from the pieces of all blocks; closed lines begin with their least key.

    With tails each piece that is no loop ends with the key that the next one begins with.
    """
    pieces = raster.cut_lineage(pieces)
    rest = pieces.where("NOT loop")
    order = ranked(rest.select("grid_id", "grp", "start", "next"), raster.cut_lineage)
    parts = rest.select("grid_id", "grp", "start", "keys", "shares").join(order, ["grid_id", "grp", "start"])
    own = [F.when(F.col("closed") | (F.col("ahead") > 1), F.slice(n, 1, F.size(n) - 1)).otherwise(F.col(n)).alias(n) if tails else F.col(n) for n in ("keys", "shares")]
    whole = parts.groupBy("grid_id", "grp", "line", "closed").agg(F.array_sort(F.collect_list(F.struct((-F.col("ahead")).alias("o"), *own))).alias("p"))
    whole = whole.select("grid_id", "grp", "closed", F.flatten(F.col("p.keys")).alias("keys"), F.flatten(F.col("p.shares")).alias("shares"))
    first = F.array_position("keys", F.array_min("keys")).cast("int")

    def turned(name: str) -> Column:
        rest_of = F.slice(name, first, F.size(name) - first + 1)
        return F.when(F.col("closed") & (F.size(name) > 0), F.concat(rest_of, F.slice(name, 1, first - 1))).otherwise(F.col(name)).alias(name)

    whole = whole.select("grid_id", "grp", "closed", turned("keys"), turned("shares"))
    return pieces.where("loop").select("grid_id", "grp", F.col("loop").alias("closed"), "keys", "shares").unionByName(whole)


def _crossings(z: np.ndarray, level: float, window: Window) -> tuple[np.ndarray, np.ndarray]:
    """Directed links between the crossed sides of the owned squares: side numbers 2 * cell for the side to the right, 2 * cell + 1 for the side down."""
    corner = [z[:-1, :-1], z[:-1, 1:], z[1:, 1:], z[1:, :-1]]
    whole = window.own[:-1, :-1] & ~np.isnan(corner[0] + corner[1] + corner[2] + corner[3])
    high = [(v >= level) & whole for v in corner]
    crossed = whole & ~((high[0] == high[1]) & (high[1] == high[2]) & (high[2] == high[3]))
    r, c = np.nonzero(crossed)
    if not len(r):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = np.array([x[r, c] for x in high])
    v = np.array([x[r, c] for x in corner])
    # The sides of a square, clockwise from the top; side k is between corners k and k + 1.
    name = np.array([2 * window.key(r, c), 2 * window.key(r, c + 1) + 1, 2 * window.key(r + 1, c), 2 * window.key(r, c) + 1])
    joined = v.mean(axis=0) >= level
    starts, nexts = [], []
    for k in range(4):
        # Going clockwise from high to low the line enters; it leaves where the next side goes from low to high.
        enters = h[k] & ~h[(k + 1) % 4]
        first, second, third = (~h[(k + j) % 4] & h[(k + j + 1) % 4] for j in (1, 2, 3))
        saddle = h[k] & ~h[(k + 1) % 4] & h[(k + 2) % 4] & ~h[(k + 3) % 4]
        # In a saddle whose mean is high the low corner k + 1 is cut off, or else the high corner k.
        leaves = np.where(saddle, np.where(joined, 1, 3), np.where(first, 1, np.where(second, 2, 3)))
        at = np.nonzero(enters)[0]
        starts.append(name[k][at])
        nexts.append(name[(k + leaves[at]) % 4, at])
    return np.concatenate(starts), np.concatenate(nexts)


def contour_lines(cells: DataFrame, interval: float, block: int = BLOCK) -> DataFrame:
    """grid_id, level, closed, points (array of r, c), length_px of every line; a level's lines are all lines of that level."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window = Window(frame, block)
        z, out = window.array("z", np.nan), []
        known = z[np.isfinite(z)]
        if len(known):
            for step in range(int(np.floor(known.min() / interval)), int(np.floor(known.max() / interval)) + 1):
                level = step * interval
                starts, nexts = _crossings(z, level, window)
                for line, goes, loop in _follow(starts, nexts):
                    keys = starts[line] if loop or goes is None else np.append(starts[line], goes)
                    r, c = (keys >> 1) // SPAN - window.r0, (keys >> 1) % SPAN - SHIFT - window.c0
                    down = keys & 1
                    a, b = z[r, c], z[r + down, c + 1 - down]
                    out.append((int(frame["grid_id"].iloc[0]), step, int(starts[line[0]]), goes, loop, keys, (level - a) / (b - a)))
        return pd.DataFrame(out, columns=["grid_id", "grp", "start", "next", "loop", "keys", "shares"]).astype({"next": "Int64"})

    pieces = with_halo(cells.select("grid_id", "r", "c", F.col("z").cast("double").alias("z")), block).groupBy("grid_id", "br", "bc").applyInPandas(run, _PIECES)
    lines = _assembled(pieces, True)

    def point(key: Column, share: Column) -> Column:
        cell, down = F.shiftright(key, 1), key.bitwiseAND(1)
        return F.struct((F.shiftright(cell, 30) + share * down).alias("r"), (F.pmod(cell, F.lit(SPAN)) - SHIFT + share * (1 - down)).alias("c"))

    found = lines.select("grid_id", (F.col("grp") * F.lit(float(interval))).alias("level"), "closed", F.zip_with("keys", "shares", point).alias("points"))
    return found.withColumn("length_px", _length(F.col("points"), F.col("closed")))


def _length(points: Column, closed: Column) -> Column:
    ring = F.when(closed, F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    steps = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.hypot(a["r"] - b["r"], a["c"] - b["c"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def clip_line(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The parts of an open line inside a box (edges included), in order; parts of one point are left out."""
    parts: list[list[np.ndarray]] = []
    joined = False
    for a, b in zip(points[:-1], points[1:]):
        d = b - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(d != 0, (np.array([low, high]) - a) / d, np.where((a >= low) & (a <= high), [[-np.inf], [np.inf]], [[np.inf], [-np.inf]]))
        t0, t1 = max(0.0, t.min(axis=0).max()), min(1.0, t.max(axis=0).min())
        if (d == 0).any() and ((a < low) | (a > high))[d == 0].any() or t0 > t1:
            joined = False
            continue
        p, q = (np.clip(a + t0 * d, low, high) if t0 > 0 else a), (np.clip(a + t1 * d, low, high) if t1 < 1 else b)
        if joined and t0 == 0:
            parts[-1].append(q)
        else:
            parts.append([p, q])
        joined = t1 == 1
    return [np.array(p) for p in parts if (np.array(p) != p[0]).any()]


def drawn_lines(lines: DataFrame, tolerance: float = 1.0, least_length: float = LEAST_LENGTH_PX, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """grid_id, level, lines (array of arrays of r, c): the lines of each level as one feature.

    Lines under ``least_length`` pixels are specks and go; the others are thinned to the
    tolerance, closed ones end where they begin, and what lies outside the box (r0, c0, r1,
    c1) is cut off.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for grid, level, closed, points in frame[["grid_id", "level", "closed", "points"]].itertuples(index=False):
                line = np.array([(p["r"], p["c"]) for p in points], dtype=float)
                if closed:
                    line = thin_ring(line, tolerance)
                    line = np.vstack([line, line[:1]])
                elif len(line) > 2:
                    line = thin(line, tolerance)
                for part in clip_line(line, np.array(box[:2]), np.array(box[2:])) if box else [line]:
                    out.append((grid, level, [{"r": r, "c": c} for r, c in part.tolist()]))
            yield pd.DataFrame(out, columns=["grid_id", "level", "line"])

    parts = lines.where(F.col("length_px") >= least_length).mapInPandas(run, "grid_id long, level double, line array<struct<r:double,c:double>>")
    return parts.groupBy("grid_id", "level").agg(F.collect_list("line").alias("lines"))


def is_major(level: Column, interval: float, every: int = 5) -> Column:
    """Whether a level is a whole number of ``every`` intervals."""
    ratio = level / (interval * every)
    return F.abs(ratio - F.round(ratio)) <= 1e-8 + 1e-5 * F.abs(F.round(ratio))


def level_labels(drawn: DataFrame, interval: float, least_points: int = 12) -> DataFrame:
    """grid_id, level, r, c: where the number of a major level is written, the middle point of each of its lines that has at least ``least_points`` points."""
    line = drawn.where(is_major(F.col("level"), interval)).select("grid_id", "level", F.explode("lines").alias("line")).where(F.size("line") >= least_points)
    middle = F.get("line", F.expr("size(line) div 2"))
    return line.select("grid_id", "level", middle["r"].alias("r"), middle["c"].alias("c"))


def elevation_range(cells: DataFrame, interval: float | None = None) -> DataFrame:
    """grid_id, low, high: the raster's range; with an interval the range of its bands, rounded outward."""
    found = cells.groupBy("grid_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    if interval is None:
        return found
    return found.select("grid_id", (F.floor(F.col("low") / interval) * interval).cast("double").alias("low"), (F.ceil(F.col("high") / interval) * interval).cast("double").alias("high"))


def region_rings(zones: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, label, sides (array of 4 * cell number + side), area of every ring of each 8-connected region (grid_id, r, c, label).

    A ring begins with its first cell row by row; holes have a negative area.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window = Window(frame, block)
        label = np.pad(window.array("label", -1).astype(np.int64), 1, constant_values=-1)
        own = np.pad(window.own, 1)
        inner = own & (label >= 0)
        starts, nexts, groups = [], [], []
        for side, (dr, dc) in enumerate(_AHEAD):
            er, ec = _AHEAD[(side + 3) % 4]  # outward
            r, c = np.nonzero(inner & (np.roll(label, (-er, -ec), (0, 1)) != label))
            mine = label[r, c]
            bent = label[r + dr + er, c + dc + ec] == mine
            ahead = label[r + dr, c + dc] == mine
            to_r = r + np.where(bent, dr + er, np.where(ahead, dr, 0))
            to_c = c + np.where(bent, dc + ec, np.where(ahead, dc, 0))
            to_side = np.where(bent, (side + 3) % 4, np.where(ahead, side, (side + 1) % 4))
            starts.append(4 * window.key(r - 1, c - 1) + side)
            nexts.append(4 * window.key(to_r - 1, to_c - 1) + to_side)
            groups.append(mine)
        starts, nexts, groups = (np.concatenate(x) for x in (starts, nexts, groups))
        out = []
        for line, goes, loop in _follow(starts, nexts):
            keys = starts[line]
            out.append((int(frame["grid_id"].iloc[0]), int(groups[line[0]]), int(keys[0]), goes, loop, keys, np.zeros(len(keys))))
        return pd.DataFrame(out, columns=["grid_id", "grp", "start", "next", "loop", "keys", "shares"]).astype({"next": "Int64"})

    wide = with_halo(zones.select("grid_id", "r", "c", F.col("label").cast("long").alias("label")), block)
    rings = _assembled(wide.groupBy("grid_id", "br", "bc").applyInPandas(run, _PIECES), False)

    def part(key: Column) -> Column:
        row, side = F.shiftright(key, 32), F.pmod(key, F.lit(4))
        return F.when(side == 0, -row).when(side == 2, row + 1).otherwise(F.lit(0)).cast("long")

    # The area by the trapezium rule: only sides that go right or left count.
    area = F.aggregate(F.transform("keys", part), F.lit(0).cast("long"), lambda s, x: s + x)
    return rings.select("grid_id", F.col("grp").alias("label"), F.col("keys").alias("sides"), area.alias("area"))


def ring_corners(sides: Column) -> Column:
    """The corners (array of r, c; cell (r, c) spans r to r + 1) where a ring of cell sides turns, not closed."""

    def corner(key: Column) -> Column:
        cell, side = F.shiftright(key, 2), F.pmod(key, F.lit(4))
        return F.struct((F.shiftright(cell, 30) + F.when(side.isin(2, 3), 1).otherwise(0)).cast("int").alias("r"), (F.pmod(cell, F.lit(SPAN)) - SHIFT + F.when(side.isin(1, 2), 1).otherwise(0)).cast("int").alias("c"))

    turns = lambda s: F.filter(s, lambda k, i: F.pmod(k, F.lit(4)) != F.pmod(F.get(s, F.when(i > 0, i - 1).otherwise(F.size(s) - 1)), F.lit(4)))
    return F.transform(let(sides, turns), corner)


def ring_cells(sides: Column) -> Column:
    """The cells (array of r, c) that a ring passes, each once in a row: the region's border through cell centres, not closed."""
    # What is looked up for each side is computed once a ring, or else the work grows with the square of the ring's length.
    changes = lambda owners: F.filter(owners, lambda k, i: (i == 0) | (k != F.get(owners, i - 1)))
    once = lambda kept: F.when((F.size(kept) > 1) & (F.element_at(kept, 1) == F.element_at(kept, -1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    kept = let(let(F.transform(sides, lambda k: F.shiftright(k, 2)), changes), once)
    return F.transform(kept, lambda k: F.struct(F.shiftright(k, 30).cast("int").alias("r"), (F.pmod(k, F.lit(SPAN)) - SHIFT).cast("int").alias("c")))


def _ring_sum(ring: Column, part) -> Column:
    """Sum of ``part(a, b)`` over the neighbouring points of a ring that is not closed."""
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), part)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def outlines(zones: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, label, ring, perimeter, area (in pixels, through cell centres) of each zone's outer border, clockwise from its first cell row by row."""
    rings = region_rings(zones, block).where("area > 0").select("grid_id", "label", ring_cells(F.col("sides")).alias("ring"))
    perimeter = _ring_sum(F.col("ring"), lambda a, b: F.hypot(a["r"] - b["r"], a["c"] - b["c"]))
    area = F.abs(_ring_sum(F.col("ring"), lambda a, b: (a["c"].cast("double") * b["r"] - b["c"].cast("double") * a["r"]))) / 2
    return rings.select("grid_id", F.col("label").cast("int").alias("label"), "ring", perimeter.alias("perimeter"), area.alias("area"))


def polygons(zones: DataFrame, tolerance: float = 1.0, least_area: float = 0.0, block: int = BLOCK) -> DataFrame:
    """grid_id, label, ring (closed, in pixels, thinned) of each zone's outer border.

    Zones whose outline through cell centres has less than ``least_area`` square pixels are
    specks; they have no polygon, nor have those with under three points.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rings = []
            for points in frame["ring"]:
                ring = thin_ring(np.array([(p["r"], p["c"]) for p in points], dtype=float), tolerance)
                rings.append([{"r": r, "c": c} for r, c in np.vstack([ring, ring[:1]]).tolist()] if len(ring) >= 3 else None)
            yield frame.assign(ring=rings).dropna(subset=["ring"])

    borders = outlines(zones, block).where(F.col("area") >= least_area).select("grid_id", "label", "ring")
    return borders.mapInPandas(run, "grid_id long, label int, ring array<struct<r:double,c:double>>")


def zone_shapes(zones: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """grid_id, label, ring (thinned, not closed), its perimeter and area (in pixels), compactness; zones whose ring has no area are left out."""
    rings = polygons(zones, tolerance).withColumn("ring", F.slice("ring", 1, F.size("ring") - 1))
    perimeter = _ring_sum(F.col("ring"), lambda a, b: F.hypot(a["r"] - b["r"], a["c"] - b["c"]))
    area = F.abs(_ring_sum(F.col("ring"), lambda a, b: a["r"] * b["c"] - b["r"] * a["c"])) / 2
    shapes = rings.select("grid_id", "label", "ring", perimeter.alias("perimeter"), area.alias("area")).where("perimeter > 0 AND area > 0")
    return shapes.withColumn("compactness", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))


def _tagged(grid: Column, step: Column) -> Column:
    return grid * (2 * _STEPS) + step + _STEPS


def _untagged(grid: Column, interval: float) -> tuple[Column, Column]:
    """grid_id and band of a tagged grid."""
    return F.shiftright(grid, 24), (F.pmod(grid, F.lit(2 * _STEPS)) - _STEPS) * float(interval)


def band_regions(cells: DataFrame, interval: float) -> DataFrame:
    """grid_id, band, r, c, label: 8-connected regions of each half-open elevation band, labelled within the band row by row."""
    steps = F.floor(F.col("z") / interval).cast("long")
    found = raster.label_zones(cells.where("z IS NOT NULL").select(_tagged(F.col("grid_id"), steps).alias("grid_id"), "r", "c"))
    grid, band = _untagged(F.col("grid_id"), interval)
    return found.select(grid.alias("grid_id"), band.alias("band"), "r", "c", "label")


def _by_band(regions: DataFrame, interval: float) -> DataFrame:
    return regions.select(_tagged(F.col("grid_id"), F.round(F.col("band") / interval).cast("long")).alias("grid_id"), "label", "r", "c")


def band_rings(cells: DataFrame, interval: float, block: int = BLOCK) -> DataFrame:
    """grid_id, band, label, corners, area of every ring (holes: negative area) of each region of each band."""
    rings = region_rings(_by_band(band_regions(cells, interval), interval), block)
    grid, band = _untagged(F.col("grid_id"), interval)
    return rings.select(grid.alias("grid_id"), band.alias("band"), "label", "sides", "area")


def band_polygons(cells: DataFrame, interval: float, tolerance: float = 1.0, least_area: float = 0.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """grid_id, band, label, ring of each region of each band that has an outline of three points; cut to the box (r0, c0, r1, c1), specks left out."""
    shapes = polygons(_by_band(band_regions(cells, interval), interval), tolerance, least_area)
    grid, band = _untagged(F.col("grid_id"), interval)
    shapes = shapes.select(grid.alias("grid_id"), band.alias("band"), "label", "ring")
    if box is None:
        return shapes
    r0, c0, r1, c1 = (F.lit(float(b)) for b in box)
    ring = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda p: F.struct(p["c"].alias("lon"), p["r"].alias("lat")))
    cut = F.transform(clip_ring(ring, c0, r0, c1, r1), lambda p: F.struct(p["lat"].alias("r"), p["lon"].alias("c")))
    return shapes.withColumn("ring", cut).where(F.size("ring") >= 3).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
