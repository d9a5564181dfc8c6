"""Surfaces: the Delaunay property, known planes, and brute-force neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import raster, surface
from terrace.plans import sites


def points_of(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "grid_id long, lon double, lat double, z double")


@pytest.mark.parametrize("kind", ["random", "lattice", "line_and_point"])
def test_no_point_lies_in_a_circle_and_triangles_tile_the_hull(kind):
    rng = np.random.default_rng(3)
    if kind == "random":
        p = np.unique(rng.integers(0, 1 << 29, (150, 2)), axis=0)
    elif kind == "lattice":
        p = np.array([(i, j) for i in range(9) for j in range(7)]) << 20
    else:
        p = np.array([(i << 16, 5) for i in range(12)] + [(3, 1 << 25)])
    x, y = p[:, 0].tolist(), p[:, 1].tolist()
    found = surface.delaunay(x, y)
    area = 0
    for i, j, k in found:
        turn = (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])
        assert turn > 0
        area += turn
        for q in range(len(x)):
            m = [(x[t] - x[q], y[t] - y[q]) for t in (i, j, k)]
            (ax, ay), (bx, by), (cx, cy) = m
            assert (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) <= 0
    chain = sorted(zip(x, y, strict=True))

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = half(chain) + half(chain[::-1])
    assert area == sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
    assert {v for t in found for v in t} == set(range(len(x)))


def test_points_on_a_line_have_no_triangles():
    assert surface.delaunay([0, 1, 2, 3], [0, 2, 4, 6]) == [] and surface.delaunay([], []) == []


def test_surface_is_linear_inside_and_nearest_outside(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 0.01, (60, 2))
    rows = [(1, x, y, 100 + 4000 * x - 2000 * y) for x, y in xy.tolist()]
    got = surface.build_surface(points_of(spark, [*rows, (1, None, 0.0, 1.0)]), 20.0).toPandas()
    n_rows, n_cols = got["r"].max() + 1, got["c"].max() + 1
    assert len(got) == n_rows * n_cols and not got.duplicated(["r", "c"]).any()
    lon = xy[:, 0].min() + got["c"] * np.ptp(xy[:, 0]) / (n_cols - 1)
    lat = xy[:, 1].max() - got["r"] * np.ptp(xy[:, 1]) / (n_rows - 1)
    inside = got["inside_hull"].to_numpy()
    assert 0.5 < inside.mean() < 1
    assert np.allclose(got["z"][inside], (100 + 4000 * lon - 2000 * lat)[inside], atol=1e-6)
    away = np.hypot(lon.to_numpy()[:, None] - xy[:, 0], lat.to_numpy()[:, None] - xy[:, 1])
    best = np.array([r[3] for r in rows])[away.argmin(axis=1)]
    assert np.allclose(got["z"][~inside], best[~inside])


def test_spacing_is_the_lower_quartile_of_distances_to_other_levels(spark):
    rng = np.random.default_rng(8)
    xy, z = rng.uniform(0, 1, (80, 2)).round(2), rng.integers(0, 3, 80)
    rows = [(5, x, y, float(v)) for (x, y), v in zip(xy.tolist(), z, strict=True)]
    away = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    away[z[:, None] == z[None, :]] = np.inf
    got = {r["grid_id"]: r["spacing_deg"] for r in surface.contour_spacing(points_of(spark, [*rows, (6, 0.0, 0.0, 1.0), (6, 1.0, 1.0, 1.0)])).collect()}
    assert got.keys() == {5} and got[5] == pytest.approx(np.percentile(away.min(axis=1), 25))


def test_empty_and_flat_documents_have_no_cells(spark):
    assert surface.build_surface(points_of(spark, []), 5.0).count() == 0
    assert surface.build_surface(points_of(spark, [(1, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0)]), 5.0).count() == 0


def test_resolution_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(surface.resolution(F.col("id").cast("double"), F.lit(8.0))).collect()
    assert spark.range(1).select(surface.resolution(None, F.lit(8.0)).alias("m")).first()["m"] == 2.0


def test_a_bowl_is_found_with_its_catchment(spark):
    side = np.linspace(0, 0.01, 24)
    rows = [(3, x, y, float(2 * round((60 - 14 * np.exp(-((x - 0.006) ** 2 + (y - 0.004) ** 2) / 4e-6)) / 2))) for x in side.tolist() for y in side.tolist()]
    found = sites.analyze_map(points_of(spark, rows), 100.0, 20.0, boundary=F.array(*[F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in ((9.0, 9.0), (9.1, 9.0), (9.1, 9.1), (9.0, 9.0))])).collect()
    best = next(r for r in found if r["rank"] == 1)
    assert abs(best["lon"] - 0.006) < 5e-4 and abs(best["lat"] - 0.004) < 5e-4 and 0 < best["self_overlap_pct"] <= 100
    assert best["traced_m2"] <= best["catchment_area_m2"] + 1e-6 and "not been checked" in best["warnings"][-1]
    with pytest.raises(ValueError):
        sites.analyze_map(points_of(spark, []), 100.0, 20.0)


def test_ponds_off_the_raster_have_an_error(spark):
    cells = spark.range(25).select(F.lit(1).cast("long").alias("grid_id"), F.expr("cast(id div 5 as int)").alias("r"), (F.col("id") % 5).cast("int").alias("c"), F.col("id").cast("double").alias("filled"))
    flow = raster.cut_lineage(raster.flow_direction(cells))
    ponds = spark.createDataFrame([(1, 1, 2, 2), (1, 1, 2, 3), (2, 1, 40, 40)], "id int, grid_id long, r int, c int")
    got = {r["id"]: r for r in sites.trace_ponds(flow, raster.flow_accumulation(flow), ponds, 4.0).collect()}
    assert got[2]["error"] and got[2]["pour_r"] is None and got[2]["catchment_area_m2"] is None and got[2]["warnings"] == []
    assert got[1]["error"] is None and got[1]["self_overlap_pct"] > 0


def test_cards_of_sites_without_figures_stay_null(spark):
    kind = "candidate_id int, expected_volume_m3 double, capacity_m3 double, runoff_m3 double, traced_ha double, traced_ratio double, catchment_area_m2 double, area_ha double, fill_ratio double, capture_fraction double"
    rows = [(1, *[None] * 9), (2, None, 5.0, 9.0, None, None, 20_000.0, 0.5, 0.4, 0.25), (3, 250_000.0, 1.0, 1.0, 7.0, 61.0, 20_000.0, 0.5, 2.0, 1.0)]
    got = {r["candidate_id"]: r for r in sites.site_card(spark.createDataFrame(rows, kind)).collect()}
    assert all(v is None for k, v in got[1].asDict().items() if k != "candidate_id")
    assert (got[2]["volume_m3"], got[2]["volume_lakh"], got[2]["kept_pct"], got[2]["catchment_ha"], got[2]["ratio"], got[2]["status"]) == (5.0, None, 25, 2.0, 4, "bad")
    assert (got[3]["volume_lakh"], got[3]["catchment_ha"], got[3]["ratio"], got[3]["note"]) == (2.5, 7.0, 61, None)
