"""Areas under unions of strips and polygons against shapes of known area and fine grids of points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import overlay, screening
from terrace.plans import queries

BOX = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], dtype=float)


def inside(ring, x, y):
    """Non-zero winding numbers of points."""
    winding = np.zeros(x.shape, dtype=int)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        winding += ((ay <= y) & (by > y) & (side > 0)).astype(int) - ((ay > y) & (by <= y) & (side < 0)).astype(int)
    return winding != 0


def test_covered_area_of_known_shapes():
    area = overlay.covered_area
    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], dtype=float)
    assert math.isclose(area(BOX, [square(1, 1, 1)]), 1) and math.isclose(area(BOX, [square(1, 1, 1)[::-1]] * 3), 1)
    assert math.isclose(area(BOX, [square(-1, -1, 2), square(0.5, 0.5, 1)]), 1 + 0.75)
    assert area(BOX, []) == 0 and area(BOX, [square(9, 9, 1)]) == 0 and area(BOX[:2], [square(0, 0, 9)]) == 0 and area(BOX, [BOX[:1]]) == 0
    closed = np.vstack([BOX, BOX[:1]])
    assert math.isclose(area(closed + 7e4, [closed + 7e4]), 12, rel_tol=1e-9)
    star = np.array([(2 + math.cos(t), 1.5 + math.sin(t)) for t in np.arange(5) * 4 * math.pi / 5])
    x, y = np.meshgrid(np.arange(0.0025, 4, 0.005), np.arange(0.0025, 3, 0.005))
    assert abs(area(BOX, [star]) - inside(star, x, y).sum() * 0.005**2) < 2e-3
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], dtype=float)
    assert math.isclose(area(bow, [BOX]), 2.0)


def test_random_covers_against_a_grid_of_points():
    rng = np.random.default_rng(4)
    x, y = np.meshgrid(np.arange(0.005, 4, 0.01), np.arange(0.005, 3, 0.01))
    for _ in range(12):
        pond = rng.uniform((0, 0), (4, 3), (6, 2))
        covers = [rng.uniform((-1, -1), (5, 4), (rng.integers(3, 7), 2)) for _ in range(4)]
        wet = np.zeros(x.shape, dtype=bool)
        for c in covers:
            wet |= inside(c, x, y)
        assert abs(overlay.covered_area(pond, covers) - (wet & inside(pond, x, y)).sum() * 1e-4) < 0.02


def frame(spark, rows, names):
    point = "array<struct<lon:double,lat:double>>"
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} {point}")


def test_strips_of_crossing_lines_over_ponds(spark):
    ponds = frame(spark, [(1, [tuple(p) for p in BOX.tolist()]), (2, [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0)]), (3, []), (4, None)], ("id", "ring"))
    rivers = [(1, [(-1.0, 1.0), (2.0, 1.0), (3.0, 2.5)]), (2, [(1.0, -1.0), (1.0, 5.0)]), (3, [(2.0, 2.0)]), (4, []), (5, None)]
    lines = frame(spark, rivers, ("wid", "coords"))
    got = {(r["id"], r["wid"]): r["shared"] for r in screening.line_overlap(ponds, lines, 1.0, 0.25).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3)}
    x, y = np.meshgrid(np.arange(0.0025, 4, 0.005), np.arange(0.0025, 3, 0.005))

    def near(coords):
        found = np.zeros(x.shape, dtype=bool)
        for (ax, ay), (bx, by) in zip(coords, coords[1:] or coords):
            long = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long, 0, 1) if long else 0
            found |= np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= 0.25
        return found.sum() * 0.005**2

    for wid, coords in rivers[:3]:
        assert abs(got[1, wid] - near(coords)) < 4e-3
    share = {r["id"]: r["osm_water_fraction"] for r in screening.mapped_water_share(ponds, ponds.where("id = 2").withColumnRenamed("id", "wid"), 1.0, lines, 0.25).collect()}
    assert abs(share[1] - sum(got.values()) / 12) < 1e-9 and abs(share[2] - 1) < 1e-9 and share[3] == 0.0 and share[4] == 0.0
    assert overlay.strips(lines.where("false"), 0.1).count() == 0 and screening.line_overlap(ponds.where("false"), lines, 1.0).count() == 0
    assert overlay.strips(lines, 0.1).where(F.size("ring") != 66).count() == 0


def test_equal_ponds_and_equal_waters_are_compared_once_and_count_as_given(spark):
    box = [tuple(p) for p in BOX.tolist()]
    ponds = frame(spark, [(k, box) for k in range(6)] + [(9, None)], ("id", "ring"))
    lines = frame(spark, [(k, [(-1.0, 1.0), (5.0, 1.0)]) for k in (1, 2, 3)] + [(4, [(1.0, -1.0), (1.0, 5.0)]), (4, [(1.0, -1.0), (1.0, 5.0)]), (4, [(1.1, -1.0), (1.1, 5.0)])], ("wid", "coords"))
    water = frame(spark, [(k, [(3.0, 2.0), (4.0, 2.0), (4.0, 3.0)]) for k in (1, 2)], ("wid", "ring"))
    got = {r["id"]: r["osm_water_fraction"] for r in screening.mapped_water_share(ponds, water, 1.0, lines, 0.1).collect()}
    want = (3 * 0.2 * 4 + 0.3 * 3 + 2 * 0.5) / 12
    assert set(got) == {*range(6), 9} and got[9] == 0.0 and all(abs(got[k] - want) < 1e-9 for k in range(6))
    by = {"by": ("m",)}
    parted = screening.mapped_water_share(ponds.withColumn("m", F.col("id") % 3), water.withColumn("m", F.col("wid")), 1.0, lines.withColumn("m", F.col("wid")), 0.1, **by)
    got = {r["id"]: r["osm_water_fraction"] for r in parted.collect()}
    assert [round(got[k] * 12, 9) for k in range(6)] == [0.0, 1.3, 1.3] * 2
    assert len({tuple(r) for r in screening.line_overlap(ponds, lines, 1.0, 0.1).collect()}) == 6 * 4


def test_ponds_at_one_place_meet_their_own_line_only(spark, tmp_path):
    keys = spark.range(40).selectExpr("id AS c_custkey").unionByName(spark.range(78_300, 78_340).selectExpr("id AS c_custkey"))
    keys.write.parquet(f"{tmp_path}/customer.parquet")
    want = {k: 0.0 if k % 4 == 3 else round(2 * 15 / 111320.0 / (0.004 + 0.001 * (k % 3)), 7) for k in (*range(40), *range(78_300, 78_340))}
    assert {r["k"]: r["osm_water_fraction"] for r in queries.QUERIES["line_water_share"](spark, str(tmp_path)).collect()} == want


def test_strips_are_drawn_once_for_equal_ponds_and_lines(spark, monkeypatch):
    box = [tuple(p) for p in BOX.tolist()]
    ponds = frame(spark, [(k, box) for k in range(200)], ("id", "ring")).withColumn("m", F.col("id"))
    lines = frame(spark, [(k, [(-1.0, 1.0), (5.0, 1.0)]) for k in range(200)], ("wid", "coords")).withColumn("m", F.col("wid"))
    drawn, plain = [], overlay.shared_areas
    monkeypatch.setattr(overlay, "shared_areas", lambda met, width: drawn.append(met.count()) or plain(met, width))
    for by in ((), ("m",)):
        got = screening.mapped_water_share(ponds, ponds.limit(0).withColumnRenamed("id", "wid"), 1.0, lines, 0.1, by=by)
        want = 200 * 0.8 / 12 if not by else 0.8 / 12
        assert [round(r["osm_water_fraction"], 9) for r in got.collect()] == [round(min(1.0, want), 9)] * 200
    assert drawn == [1, 1]


def test_equal_rings_are_compared_once(spark):
    box = [tuple(p) for p in BOX.tolist()]
    ponds = frame(spark, [(k, box) for k in range(3000)], ("id", "ring"))
    water = frame(spark, [(k, [(3.0, 2.0), (4.0, 2.0), (4.0, 3.0)]) for k in range(3000)], ("wid", "ring"))
    seen = spark.sparkContext.accumulator(0)
    plain = screening.ring_intersection_area
    count = F.udf(lambda: seen.add(1) or 0.0, "double").asNondeterministic()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(screening, "ring_intersection_area", lambda one, two: plain(one, two) + count())
        got = screening.mapped_water_share(ponds, water, 1.0).collect()
    assert seen.value <= 4 and {r["osm_water_fraction"] for r in got} == {1.0} and len(got) == 3000

