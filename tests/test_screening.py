"""Polygons on rasters, shares of water, recorded answers, and reports on contour maps."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import georef, sizing
from terrace.operators import raster, screening
from terrace.plans import sites
from terrace.sources import feeds, records


def rings_of(spark, rings, key="id", names=("lon", "lat")):
    kind = f"{key} int, grid_id long, ring array<struct<{names[0]}:double,{names[1]}:double>>"
    return spark.createDataFrame([(k, 0, None if r is None else [tuple(map(float, p)) for p in r]) for k, r in rings.items()], kind)


def test_a_polygon_covers_its_inside_and_its_sides(spark):
    shapes = {1: [(1, 1), (1, 5), (4, 5), (4, 1)], 2: [(0.9, 0.2), (2.7, 2.9)], 3: [(3, 3)], 4: [], 5: None, 6: [(-5, -5), (-5, 50), (50, 50), (50, -5)], 7: [(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)]}
    got = {}
    for row in screening.rasterize_rings(rings_of(spark, shapes, names=("r", "c")), 8, 8).collect():
        got.setdefault(row["id"], set()).add((row["r"], row["c"]))
    assert got[1] == {(r, c) for r in range(1, 5) for c in range(1, 6)}
    assert got[2] == {(0, 0), (1, 1), (2, 2)} and got[3] == {(3, 3)} and 4 not in got and 5 not in got
    assert got[6] == {(r, c) for r in range(8) for c in range(8)}
    assert (3, 0) in got[7] and (3, 1) in got[7] and (3, 4) not in got[7] and (0, 6) in got[7] and (1, 3) in got[7]


def inside(x, y, ring):
    hit = np.zeros(x.shape, dtype=bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return hit


@pytest.mark.parametrize("closed", [False, True])
def test_shared_area_of_rings(spark, closed):
    shapes = [
        [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (2, 6), (6, 6), (6, 2)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(1, -1), (5, 2), (1, 3)],
        [(8, 8), (9, 8), (9, 9)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(0, 3), (4, 3.5), (4, 4), (0, 4)],
    ]
    close = lambda r: r + r[:1] if closed else r
    one, two = rings_of(spark, {k: close(r) for k, r in enumerate(shapes)}), rings_of(spark, {k: close(r) for k, r in enumerate(shapes)}, "wid").withColumnRenamed("ring", "other")
    got = {(r["id"], r["wid"]): r["a"] for r in one.crossJoin(two.drop("grid_id")).select("id", "wid", screening.ring_intersection_area(F.col("ring"), F.col("other")).alias("a")).collect()}
    n = 1200
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * 10 - 1, (np.arange(n) + 0.5) / n * 10 - 1)
    masks = [inside(x, y, r) for r in shapes]
    for i, j in got:
        assert got[i, j] == pytest.approx((masks[i] & masks[j]).sum() * (10 / n) ** 2, abs=0.03)
        assert got[i, j] == pytest.approx(got[j, i], abs=1e-9)
    assert got[0, 1] == pytest.approx(4.0) and got[0, 4] == 0.0 and got[2, 2] == pytest.approx(10.0)


def test_screening_by_both_kinds_of_water(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ponds = rings_of(spark, {1: square(0, 0, 1), 2: square(5, 5, 1), 3: square(9, 9, 1), 4: None}, "candidate_id")
    ponds = ponds.drop("grid_id").withColumn("excluded", F.col("candidate_id") == 3).withColumn("exclusion_reason", F.when(F.col("excluded"), "thin"))
    water = rings_of(spark, {7: square(0.5, 0, 1), 8: square(0.5, 0, 1), 9: square(9, 9, 1)}, "wid").drop("grid_id")
    cells = spark.createDataFrame([(k, 0, k, c) for k in (1, 2, 3) for c in range(4)], "id int, grid_id int, r int, c int")
    mask = spark.createDataFrame([(0, 2, 0), (0, 2, 1)], "grid_id int, r int, c int")
    got = {r["candidate_id"]: r for r in screening.screen(ponds, water, mask, cells, 0.7).collect()}
    assert got[1]["osm_water_fraction"] == pytest.approx(1.0) and got[2]["osm_water_fraction"] == 0.0 and got[2]["worldcover_water_fraction"] == 0.5
    assert {k: r["excluded"] for k, r in got.items()} == {1: True, 2: True, 3: True, 4: False} and got[3]["exclusion_reason"] == "thin"
    assert "mapped" in got[1]["exclusion_reason"] and "imaged" in got[2]["exclusion_reason"]


def test_lines_count_as_water_nearby(spark):
    line = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1))])
    points = spark.createDataFrame([(0.5, 0.05), (0.5, 0.2), (1.09, 0.5), (1.0, 1.11), (-0.05, 0.0)], "x double, y double")
    got = [r["n"] for r in points.select(screening.near_line(F.col("x"), F.col("y"), line, 0.1).alias("n")).collect()]
    assert got == [True, False, True, False, True]


def test_recheck_and_disclosure(spark):
    shares = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.9)], "rank int, fraction double")
    assert tuple(screening.recheck_water(shares, 4, 2.0).first()) == ([2, 3], False, False)
    assert tuple(screening.recheck_water(shares.where("rank = 1"), 4, 2.0).first()) == ([], False, True)
    assert tuple(screening.recheck_water(shares.where("rank = 1"), 0, 2.0).first()) == ([], True, False)
    assert screening.recheck_water(shares.where("rank > 9"), 0, 0.0).first()["passed"]
    run = spark.createDataFrame([(True, False, None)], "worldcover_available boolean, swir_available boolean, rainfall_available boolean")
    assert screening.degraded_sources(run).first()["missing"] == ["swir"]


def test_small_pieces(spark):
    rings = rings_of(spark, {1: [(1, 2), (3, 4)], 2: [(0, 9), (2, 1)], 3: None})
    assert tuple(screening.result_bounds(rings).first()) == (0.0, 1.0, 3.0, 9.0)
    cells = spark.createDataFrame([(0, r, c, 10.0 * r + c) for r in range(3) for c in range(3)], "grid_id long, r int, c int, z double")
    asked = spark.createDataFrame([(0, 0.5, 1.5), (0, 1.5, 0.2), (0, 7.0, 0.0)], "grid_id long, row double, col double")
    assert sorted((r["row"], r["z"]) for r in screening.sample_at(asked, cells).where("z IS NOT NULL").collect()) == [(0.5, 2.0), (1.5, 20.0)]
    row = spark.range(1).select(
        sizing.format_km2(F.lit(1234.0)).alias("big"), sizing.format_km2(F.lit(56.0)).alias("small"), sizing.format_ha(F.lit(2.34)).alias("ha"), sizing.escape_html(F.lit("<a & 'b'>")).alias("html"),
        georef.tile_grid_resolution(F.lit(0), F.lit(256), F.lit(0)).alias("m"), *[d.alias(n) for n, d in zip("ab", records.rain_window(F.lit("2024-03-10").cast("date"), F.lit(3)), strict=True)],
    ).first()
    assert (row["big"], row["small"], row["ha"], row["html"]) == ("12.3 km²", "0.56 km²", "2.3 ha", "&lt;a &amp; &#39;b&#39;&gt;")
    assert row["m"] == pytest.approx(georef.GROUND) and (str(row["a"]), str(row["b"])) == ("2021-02-28", "2024-02-29")
    sizes = spark.createDataFrame([(b"",), (b"x",), (b"xxxx",), (None,)], "content binary")
    assert [r["s"] for r in sizes.select(records.upload_status(F.col("content"), 3).alias("s")).collect()] == [400, 200, 413, 400]
    with pytest.raises(ValueError):
        records.check_request(top_n=51)


def test_tile_cache_remembers_absence(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "cache_key string")
    cache = spark.createDataFrame([("a", '{"png_b64":"eA=="}'), ("b", '{"png_b64":null}')], "cache_key string, data string")
    store = spark.createDataFrame([("b", b"late"), ("c", b"y")], "cache_key string, content binary")
    tiles, new = records.read_through(wanted, cache, store)
    got = {r["cache_key"]: None if r["content"] is None else bytes(r["content"]) for r in tiles.collect()}
    assert got == {"a": b"x", "b": None, "c": b"y", "d": None} and tiles.count() == 4
    assert {r["cache_key"]: json.loads(r["data"]) for r in new.collect()} == {"c": {"png_b64": "eQ=="}, "d": {"png_b64": None}}


def test_places(spark):
    found = [
        {"place_id": 1, "name": "Abhanpur", "type": "town", "boundingbox": ["1", "2", "3", "4"], "address": {"county": "Abhanpur", "state": "Chhattisgarh"}},
        {"place_id": 2, "name": "", "display_name": "Foo, Bar", "type": "village", "boundingbox": ["1", "2", "3", "4"], "address": {}},
    ] + [{"place_id": k, "display_name": "x", "boundingbox": []} for k in range(3, 9)]
    got = records.places(spark.createDataFrame([(json.dumps(found),), ("junk",)], "value string")).orderBy("id").collect()
    assert [tuple(r) for r in got[:2]] == [(1, "Abhanpur", "Chhattisgarh", 1.0, 3.0, 2.0, 4.0), (2, "Foo", "village", 1.0, 3.0, 2.0, 4.0)] and len(got) == 6


def test_reports_on_maps(spark):
    line = "<Placemark><name>%s</name><LineString><coordinates>%s</coordinates></LineString></Placemark>"
    area = "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>%s</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    maps = {
        "good": line % (1, "0,0 1,1") + line % (2, "0,0 1,1 2,2") + line % ("x", "0,0 1,1") + line % (3, "0,0") + area % "0,0 1,0 1,1" + area % "0,0 9,0 9,9" + area % "9,9 0,9 0,0",
        "bare": area % "0,0 1,0 1,1", "nameless": line % ("x", "0,0 1,1"), "flat": line % (1, "0,0 1,1") * 2, "short": line % (1, "0,0"), "none": "",
    }
    files = spark.createDataFrame([(k, f"<kml>{v}</kml>".encode()) for k, v in maps.items()], "path string, content binary")
    got = {r["path"]: r for r in feeds.map_report(feeds.placemarks(files)).collect()}
    g = got["good"]
    assert (g["source"], g["lines"], g["vertices"], g["levels"], g["skipped_no_elevation"], g["skipped_degenerate"], g["rejected"]) == ("placemark_name", 2, 5, 2, 1, 1, None)
    assert [(p["lon"], p["lat"]) for p in g["boundary"]] == [(0, 0), (9, 0), (9, 9)]
    assert {k: got[k]["rejected"] for k in maps if k != "good"} == {
        "bare": "no contour lines", "nameless": "no elevation could be resolved", "flat": "only one elevation level", "short": "no line has an elevation and two points", "none": "no placemarks"
    }


def bowls(spark, at, shape=(40, 40)):
    """A slope to the south with bowls."""
    r, c = np.mgrid[0 : shape[0], 0 : shape[1]]
    z = 50.0 - 0.2 * r + 0.001 * np.abs(c - 20)
    for i, j, deep in at:
        z = z - deep * np.exp(-((r - i) ** 2 + (c - j) ** 2) / 18.0)
    return spark.createDataFrame([(0, int(a), int(b), float(v)) for (a, b), v in np.ndenumerate(z)], "grid_id long, r int, c int, z double")


def test_sites_are_found_screened_and_ranked(spark):
    cells = bowls(spark, [(10, 10, 6.0), (26, 28, 6.0), (12, 30, 5.0)])
    wet = spark.createDataFrame([(0, r, c) for r in range(7, 17) for c in range(25, 36)], "grid_id long, r int, c int")
    top, excluded, counters = sites.find_sites(cells, 10.0, 150.0, 0.5, 1.0, wet, F.col("centre_c") < 35)
    got = top.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2] and {(round(r["centre_r"] / 4), round(r["centre_c"] / 4)) for r in got} <= {(2, 2), (3, 2), (6, 7), (7, 7)}
    assert [r["exclusion_reason"][:12] for r in excluded.collect()] == ["imaged water"]
    assert tuple(counters.first()) == (3, 0, 1, 2, 2)
    with pytest.raises(ValueError):
        sites.find_sites(cells, 10.0, 150.0, 0.0)


def test_drawn_ponds_are_traced_to_outlines(spark):
    cells = bowls(spark, [(20, 20, 6.0)])
    flow = raster.cut_lineage(raster.flow_direction(raster.fill(cells, raster.EPSILON)))
    accumulation = raster.cut_lineage(raster.flow_accumulation(flow))
    box = (69.0, -24.039, 69.039, -24.0)
    pond = [(69.018, -24.018), (69.022, -24.018), (69.022, -24.022), (69.018, -24.022)]
    rings = rings_of(spark, {1: pond, 2: [(1, 1), (2, 1), (2, 2)]})
    got = {r["id"]: r for r in sites.trace_rings(flow, accumulation, rings, 40, 40, box).collect()}
    assert got[2]["error"] and got[2]["outline"] is None and got[2]["ratio"] is None
    one = got[1]
    most = accumulation.where("r BETWEEN 18 AND 22 AND c BETWEEN 18 AND 22").agg(F.max("accumulation")).first()[0]
    assert one["error"] is None and one["ratio"] == pytest.approx(most / 25, rel=0.25) and 0 < one["self_overlap_pct"] <= 100
    ring = [(p["lon"], p["lat"]) for p in one["outline"]]
    assert ring[0] == ring[-1] and len(ring) >= 4 and all(69.0 <= x <= 69.0391 and -24.0391 <= y <= -24.0 for x, y in ring)
