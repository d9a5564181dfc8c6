"""Contour lines and region rings over many blocks against versions that see the whole raster."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.operators import geometry, lines, raster
from terrace.operators.blocks import SHIFT, SPAN, ranked
from terrace.plans.queries import ring_counts


def table(spark, rows, names):
    kinds = {"grid_id": "long", "r": "int", "c": "int", "z": "double", "label": "int"}
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))


def spot(r, c):
    return round(r, 7) + 0.0, round(c, 7) + 0.0


def moore(cells):
    """Outer border through cell centres, clockwise from the first cell row by row."""
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start = min(cells)

    def onward(at, back):
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + around[d][0], at[1] + around[d][1])
            if to in cells:
                return to, (d + 4) % 8

    ring, step = [start], onward(start, 0)
    first = step
    while step:
        at, back = step
        step = onward(at, back)
        if at == start and step == first:
            break
        ring.append(at)
    return ring


@pytest.fixture(scope="module")
def zones(spark):
    full = np.random.default_rng(3).random((19, 26)) < 0.5
    cells = table(spark, [(5, r - 7, c - 9) for r, c in np.argwhere(full).tolist()], ["grid_id", "r", "c"])
    return raster.cut_lineage(raster.label_zones(cells))


@pytest.mark.parametrize("block", [4, 512])
def test_rings_of_regions_over_blocks(spark, zones, block):
    rings = raster.cut_lineage(lines.region_rings(zones, block))
    cells = {}
    for z in zones.collect():
        cells.setdefault(z["label"], set()).add((z["r"], z["c"]))
    counts = {r["label"]: r for r in ring_counts(rings, "label").collect()}
    assert {k: r["cells"] for k, r in counts.items()} == {k: len(v) for k, v in cells.items()}
    outer = rings.where("area > 0").select("label", lines.ring_cells(F.col("sides")).alias("ring"), lines.ring_corners(F.col("sides")).alias("corners"), "area").collect()
    assert {r["label"]: [tuple(p) for p in r["ring"]] for r in outer} == {k: moore(v) for k, v in cells.items()}
    for r in outer:
        corners = [tuple(p) for p in r["corners"]]
        assert sum(b[0] * a[1] - a[0] * b[1] for a, b in zip(corners, corners[1:] + corners[:1])) / 2 in (r["area"], -r["area"])
    labels = {(r, c): k for k, v in cells.items() for r, c in v}
    for k, v in cells.items():
        assert counts[k]["sides"] == sum(labels.get((r + a, c + b)) != k for r, c in v for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_a_region_with_a_hole_and_none(spark):
    ring = [(0, r, c, 1) for r in range(5) for c in range(6) if not (1 <= r <= 2 and 2 <= c <= 4)]
    rings = lines.region_rings(table(spark, ring, ["grid_id", "r", "c", "label"]), 3).collect()
    assert sorted(r["area"] for r in rings) == [-6, 30]
    assert lines.region_rings(table(spark, [], ["grid_id", "r", "c", "label"])).count() == 0
    assert lines.outlines(table(spark, [], ["grid_id", "r", "c", "label"])).count() == 0


@pytest.fixture(scope="module")
def surface():
    r, c = np.mgrid[-11:29, -13:37]
    return r, c, 300 + 5 * np.sin(r / 4) + 5 * np.cos(c / 5) + np.random.default_rng(2).random(r.shape)


@pytest.mark.parametrize("block", [5, 512])
def test_contour_lines_join_all_segments(spark, surface, block):
    r, c, z = surface
    cells = table(spark, [(1, a, b, v) for a, b, v in zip(r.ravel().tolist(), c.ravel().tolist(), z.ravel().tolist())], ["grid_id", "r", "c", "z"])
    segments = {}
    for s in geometry.contour_segments(cells, 2.0).collect():
        segments.setdefault(s["level"], []).append(tuple(sorted((spot(s["r1"], s["c1"]), spot(s["r2"], s["c2"])))))
    found, seen = {}, {}
    for line in lines.contour_lines(cells, 2.0, block).collect():
        points = [spot(p["r"], p["c"]) for p in line["points"]]
        ends = points[:1] if line["closed"] else []
        steps = list(zip(points, points[1:] + ends))
        assert abs(sum(math.dist(a, b) for a, b in steps) - line["length_px"]) < 1e-4
        found.setdefault(line["level"], []).extend(tuple(sorted(s)) for s in steps)
        seen.setdefault(line["level"], []).append(points)
        if not line["closed"]:
            assert all(p[0] in (-11, 28) or p[1] in (-13, 36) for p in (points[0], points[-1]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in segments.items()}
    assert all(len({p for line in v for p in line}) == sum(map(len, v)) for v in seen.values())


def test_lines_end_at_missing_cells_and_flat_ground_has_none(spark):
    rows = [(1, r, c, float(c)) for r in range(6) for c in range(6) if (r, c) != (2, 3)] + [(1, 2, 3, None)]
    found = lines.contour_lines(table(spark, rows, ["grid_id", "r", "c", "z"]), 2.5, 3).collect()
    assert sorted((x["level"], len(x["points"]), x["closed"]) for x in found) == [(2.5, 2, False), (2.5, 3, False), (5.0, 6, False)]
    flat = table(spark, [(1, r, c, 250.3) for r in range(5) for c in range(5)], ["grid_id", "r", "c", "z"])
    assert lines.contour_lines(flat, 2.0).count() == 0
    assert lines.drawn_lines(lines.contour_lines(flat.where("false"), 2.0)).count() == 0


def test_drawn_lines_of_a_cone(spark):
    r, c = np.mgrid[0:60, 0:60]
    z = 300.0 - np.hypot(r - 30, c - 30) * 0.5
    cells = table(spark, [(1, a, b, v) for a, b, v in zip(r.ravel().tolist(), c.ravel().tolist(), z.ravel().tolist())], ["grid_id", "r", "c", "z"])
    found = raster.cut_lineage(lines.contour_lines(cells, 1.0, 16))
    whole = {x["level"]: x["lines"] for x in lines.drawn_lines(found).collect()}
    assert set(whole) == {float(v) for v in range(281, 300)}
    assert 300.0 not in whole and all(x[0] == x[-1] for level, v in whole.items() if level > 286 for x in v)
    cut = lines.drawn_lines(found, box=(15.0, 15.0, 45.0, 45.0)).collect()
    assert cut and all(15 <= p["r"] <= 45 and 15 <= p["c"] <= 45 for x in cut for line in x["lines"] for p in line)
    assert {x["level"] for x in cut if len(x["lines"]) == 4} and min(x["level"] for x in cut) >= 300 - 0.5 * math.hypot(15, 15) - 1
    labels = lines.level_labels(lines.drawn_lines(found, tolerance=0.1), 1.0).collect()
    assert {x["level"] for x in labels} <= {280.0, 285.0, 290.0, 295.0} and labels
    for x in labels:
        assert abs(300 - 0.5 * math.hypot(x["r"] - 30, x["c"] - 30) - x["level"]) < 0.3


def test_clip_line():
    box = np.array([0.0, 0.0]), np.array([2.0, 2.0])
    cut = lambda *p: [x.tolist() for x in lines.clip_line(np.array(p, dtype=float), *box)]
    assert cut((-1, 1), (3, 1)) == [[[0, 1], [2, 1]]]
    assert cut((-1, 1), (1, 1), (1, 3), (1.5, 3), (1.5, 1)) == [[[0, 1], [1, 1], [1, 2]], [[1.5, 2], [1.5, 1]]]
    assert cut((3, 3), (4, 4)) == [] and cut((-1, 2), (3, 2)) == [[[0, 2], [2, 2]]] and cut((2, -1), (3, -1)) == []
    assert cut((-1, 3), (0, 2), (-1, 1)) == []


def test_bands_cut_to_a_box_without_specks(spark):
    z = np.fromfunction(lambda r, c: np.where((r == 3) & (c == 3), 9.0, np.floor(c / 6) * 5), (12, 18))
    cells = table(spark, [(0, r, c, float(z[r, c])) for r in range(12) for c in range(18)], ["grid_id", "r", "c", "z"])
    found = {x["band"]: [tuple(p) for p in x["ring"]] for x in lines.band_polygons(cells, 5.0, least_area=lines.LEAST_AREA_PX, box=(2.0, 1.0, 9.0, 14.0)).collect()}
    assert set(found) == {0.0, 5.0, 10.0}
    assert {b: (min(p[1] for p in v), max(p[1] for p in v), min(p[0] for p in v), max(p[0] for p in v)) for b, v in found.items()} == {0.0: (1, 5, 2, 9), 5.0: (6, 11, 2, 9), 10.0: (12, 14, 2, 9)}
    low = lines.elevation_range(cells, 2.0).first()
    assert (low["low"], low["high"]) == (0.0, 10.0)


def test_pieces_of_open_and_closed_lines_are_ranked(spark):
    rows = [(0, 1, k, k + 1) for k in range(10, 37)] + [(0, 2, 40 - k, 39 - k if k < 20 else 40) for k in range(21)] + [(0, 3, 5, 9), (0, 3, 7, None)]
    got = ranked(spark.createDataFrame(rows, "grid_id long, grp long, start long, next long"), raster.cut_lineage).toPandas()
    first = got[got.grp == 1].sort_values("ahead", ascending=False)
    assert first.start.tolist() == list(range(10, 37)) and not first.closed.any()
    second = got[got.grp == 2].sort_values("ahead", ascending=False)
    assert second.start.tolist() == [20, *range(40, 20, -1)] and second.closed.all() and second.line.nunique() == 1
    assert sorted(got[got.grp == 3][["start", "line", "ahead", "closed"]].itertuples(index=False, name=None)) == [(5, 5, 1, False), (7, 7, 1, False)]
    assert isinstance(got, pd.DataFrame)


def test_long_rings_are_read_in_proportion_to_their_length(spark):
    n = 16_000
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: 4 * (F.shiftright(k, 1) * SPAN + SHIFT) + F.pmod(k, F.lit(4)))
    sides = raster.cut_lineage(spark.range(1).select(keys.alias("sides")))
    began = time.time()
    ring, corners = sides.select(lines.ring_cells(F.col("sides")), lines.ring_corners(F.col("sides"))).first()
    assert [(p["r"], p["c"]) for p in ring] == [(k, 0) for k in range(n // 2)] and len(corners) == n
    assert time.time() - began < 20
