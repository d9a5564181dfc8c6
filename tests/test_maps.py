"""Many maps at once: equal to one run a map; screening by imaged and mapped water; documents in, sites out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.plans import maps, sites
from tests.test_screening import bowls, rings_of
from tests.test_surface import points_of

#: Bowls of two maps: west end, bowl's centre, levels' gap.
MAPS = {3: (0.0, (0.006, 0.004), 2.0), 8: (5.0, (5.003, 0.006), 1.0)}
BOX = ((9.0, 9.0), (9.1, 9.0), (9.1, 9.1), (9.0, 9.0))


def bowl_points(grid, side=20):
    west, (x0, y0), gap = MAPS[grid]
    at = np.linspace(0, 0.01, side).tolist()
    return [(grid, west + x, y, float(gap * round((60 + 50 * y - 14 * np.exp(-((west + x - x0) ** 2 + (y - y0) ** 2) / 4e-6)) / gap))) for x in at for y in at]


def document(rows, extra=""):
    lines = {}
    for _, x, y, z in rows:
        lines.setdefault(z, []).append(f"{x!r},{y!r}")
    marks = "".join(f"<Placemark><name>{z}</name><LineString><coordinates>{' '.join(p)}</coordinates></LineString></Placemark>" for z, p in lines.items() if len(p) > 1)
    return f"<kml>{marks}{extra}</kml>".encode()


def test_maps_together_equal_each_map_alone(spark):
    rows = bowl_points(3) + bowl_points(8)
    flat = [(5, x, y, 1.0) for x in (0.0, 0.1) for y in (0.0, 0.1)]  # one level: no map
    ring = [(x + 0.002, y) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01))]
    boundaries = spark.createDataFrame([(3, [dict(lon=x, lat=y) for x, y in ring]), (8, [dict(lon=x, lat=y) for x, y in BOX])], "grid_id long, boundary array<struct<lon:double,lat:double>>")
    together = maps.analyze_maps(points_of(spark, rows + flat + [(3, None, 0.0, 1.0)]), 100.0, 20.0, boundaries=boundaries, n=2).collect()
    names = ["candidate_id", "rank", "lon", "lat", "area_ha", "mean_depth_m", "max_depth_m", "compactness", "catchment_area_m2", "expected_volume_m3", "excluded", "pour_lon", "pour_lat", "traced_m2", "self_overlap_pct"]
    assert {r["grid_id"] for r in together} == {3, 8} and all(0 < r["hull_pct"] <= 100 for r in together)
    for grid in (3, 8):
        corners = ring if grid == 3 else BOX
        boundary = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners])
        alone = sites.analyze_map(points_of(spark, bowl_points(grid)), 100.0, 20.0, boundary=boundary, n=2).collect()
        want, got = ({r["candidate_id"]: r for r in rs} for rs in (alone, [r for r in together if r["grid_id"] == grid]))
        assert want and want.keys() == got.keys()
        for k, row in want.items():
            for name in names:
                assert got[k][name] == (pytest.approx(row[name]) if isinstance(row[name], float) else row[name]), (grid, k, name)
            assert len(got[k]["warnings"]) == len(row["warnings"])
        best = next(r for r in got.values() if r["rank"] == 1)
        assert abs(best["lon"] - MAPS[grid][1][0]) < 5e-4 and abs(best["lat"] - MAPS[grid][1][1]) < 5e-4


def test_documents_become_screened_sites(spark):
    polygon = "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 0.01,0 0.01,0.01 0,0.01 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    files = spark.createDataFrame([("a", document(bowl_points(3), polygon)), ("b", document(bowl_points(8))), ("c", b"<kml><unclosed>"), ("d", b"<kml/>")], "path string, content binary")
    lake = rings_of(spark, {1: [(5.001, 0.004), (5.005, 0.004), (5.005, 0.008), (5.001, 0.008)]}).select(F.col("id").alias("wid"), "ring")
    report, found = maps.analyze_files(files, 100.0, requested_m=20.0, water=lake)
    assert {r["path"] for r in report.where("rejected IS NULL").collect()} == {"a", "b"} and report.count() == 4
    got = found.collect()
    assert {r["path"] for r in got} == {"a", "b"}
    first = {r["path"]: r for r in got if r["rank"] == 1}
    assert abs(first["a"]["lon"] - 0.006) < 5e-4 and not any("not been checked" in w for w in first["a"]["warnings"]) and first["a"]["osm_water_fraction"] == 0
    drowned = [r for r in got if r["path"] == "b" and r["excluded"] and "mapped water" in (r["exclusion_reason"] or "")]
    assert drowned and all(abs(r["lon"] - 5.003) < 1e-3 and r["rank"] is None and r["osm_water_fraction"] > 0 for r in drowned)
    none, nothing = maps.analyze_files(files.where("path > 'b'"), 100.0, requested_m=20.0)
    assert none.count() == 2 and nothing.count() == 0


def test_raster_sites_are_screened_by_mapped_polygons_and_strips(spark):
    cells = bowls(spark, [(10, 10, 6.0), (26, 28, 6.0), (12, 30, 5.0)])
    box = (69.0, -24.0039, 69.0039, -24.0)  # a cell is 0.0001 degrees, about 10 m
    at = lambda r, c: (69.0 + c * 1e-4, -24.0 - r * 1e-4)
    lake = rings_of(spark, {1: [at(7, 7), at(7, 13), at(13, 13), at(13, 7)]}).select(F.col("id").alias("wid"), "ring")
    stream = spark.createDataFrame([(4, [dict(lon=x, lat=y) for x, y in (at(20, 28), at(33, 28))])], "wid long, coords array<struct<lon:double,lat:double>>")
    top, excluded, counters = sites.find_sites(cells, 10.0, 150.0, 0.5, 1.0, box=box, mapped=lake, streams=stream)
    got, out = top.collect(), excluded.collect()
    assert len(got) == 1 and abs(got[0]["lon"] - at(12, 30)[0]) < 1e-4 and abs(got[0]["lat"] - at(12, 30)[1]) < 2e-4
    assert len(out) == 2 and all(r["exclusion_reason"].startswith("mapped water") for r in out)
    assert tuple(counters.first()) == (3, 0, 2, 1, 1)
    with pytest.raises(ValueError):
        sites.find_sites(cells, 10.0, 150.0, 0.5, mapped=lake)
