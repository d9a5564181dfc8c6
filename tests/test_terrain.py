"""Terrain operators: invariants on random rasters, known answers, and SQL twins on the smallest tables."""

import heapq
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import georef, sizing
from terrace.operators import geometry, lines, raster, relational
from terrace.plans.queries import QUERIES, SQL
from terrace.sources import feeds

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame_of(spark, z):
    return spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(z)], "grid_id long, r int, c int, z double")


def grid_of(df, name, shape):
    out = np.zeros(shape)
    for r in df.select("r", "c", name).collect():
        out[r["r"], r["c"]] = r[name]
    return out


def flooded(z, epsilon):
    w, heap = np.full(z.shape, np.inf), []
    for (r, c), v in np.ndenumerate(z):
        if r in (0, z.shape[0] - 1) or c in (0, z.shape[1] - 1):
            w[r, c] = v
            heap.append((v, r, c))
    heapq.heapify(heap)
    while heap:
        low, r, c = heapq.heappop(heap)
        for dr, dc in raster.NEIGHBOURS:
            i, j = r + dr, c + dc
            if 0 <= i < z.shape[0] and 0 <= j < z.shape[1] and w[i, j] == np.inf:
                w[i, j] = max(z[i, j], low + epsilon)
                heapq.heappush(heap, (w[i, j], i, j))
    return w


@pytest.mark.parametrize("epsilon", [0.0, 1e-3])
def test_fill_in_blocks_equals_one_heap(spark, epsilon):
    z = np.random.default_rng(4).normal(0, 5, (23, 31)).round(2)
    got = grid_of(raster.fill(frame_of(spark, z), epsilon, block=8), "filled", z.shape)
    assert np.array_equal(got, flooded(z, epsilon)) and (got >= z).all()


def test_flow_reaches_the_border_and_counts_every_cell(spark):
    z = np.random.default_rng(5).normal(0, 5, (14, 17)).round(2)
    flow = raster.cut_lineage(raster.flow_direction(raster.fill(frame_of(spark, z), 1e-3)))
    rows = {(r["r"], r["c"]): r for r in flow.collect()}
    sinks = [k for k, r in rows.items() if r["direction"] < 0]
    assert all(r in (0, 13) or c in (0, 16) for r, c in sinks)
    acc = grid_of(raster.flow_accumulation(flow), "accumulation", z.shape)
    assert sum(acc[k] for k in sinks) == z.size
    top = max(np.ndindex(z.shape), key=lambda k: (acc[k], -k[0], -k[1]))
    pours = spark.createDataFrame([(1, 0, *top), (2, 0, 7, 8)], "pour_id int, grid_id long, r int, c int")
    counts = {r["pour_id"]: r["count"] for r in raster.catchments(flow, pours).groupBy("pour_id").count().collect()}
    assert counts == {1: acc[top], 2: acc[7, 8]}


def test_zones_are_labelled_row_by_row(spark):
    picture = ["X..X", ".X..", "...X", "XX.X"]
    cells = frame_of(spark, np.array([[v == "X" for v in row] for row in picture])).where("z = 1")
    got = {(r["r"], r["c"]): r["label"] for r in raster.label_zones(cells).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (0, 3): 2, (2, 3): 3, (3, 3): 3, (3, 0): 4, (3, 1): 4}


def test_outline_of_a_rectangle(spark):
    cells = spark.createDataFrame([(0, r, c, 1) for r in range(3) for c in range(5)], "grid_id long, r int, c int, label int")
    row = lines.outlines(cells).first()
    assert (row["perimeter"], row["area"], len(row["ring"])) == (12.0, 8.0, 12)


def test_polygons_are_thinned_and_closed(spark):
    block = [(0, r, c, 1) for r in range(3) for c in range(5)] + [(0, 9, 9, 2), (0, 9, 10, 2)]
    got = lines.polygons(spark.createDataFrame(block, "grid_id long, r int, c int, label int")).collect()
    assert [r["label"] for r in got] == [1] and [tuple(p) for p in got[0]["ring"]] == [(0, 0), (0, 4), (2, 4), (2, 0), (0, 0)]


def test_clip_of_rings(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p])
    box = [F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]
    shapes = {"inside": ring((0.5, 0.5), (1, 0.5), (1, 1)), "around": ring((-1, -1), (5, -1), (5, 5), (-1, 5)), "away": ring((7, 7), (8, 7), (8, 8)), "corner": ring((1, 1), (3, 1), (3, 3), (1, 3)), "diamond": ring((1, -1), (3, 1), (1, 3), (-1, 1))}
    row = spark.range(1).select(*[georef.ring_area(geometry.clip_ring(r, *box)).alias(n) for n, r in shapes.items()], geometry.clip_ring(F.lit(None).cast("array<struct<lon:double,lat:double>>"), *box).alias("none")).first()
    assert {n: row[n] for n in shapes} == {"inside": 0.125, "around": 4.0, "away": 0.0, "corner": 1.0, "diamond": 4.0} and row["none"] is None


def test_contour_lines_of_a_cone_are_closed_and_flat_ground_has_none(spark):
    z = np.hypot(*np.mgrid[-8:9, -8:9]) + 0.01
    segments = geometry.contour_segments(frame_of(spark, z), 2.0).collect()
    assert {(r["level"], r["major"]) for r in segments} == {(float(v), v == 10) for v in (2, 4, 6, 8, 10)}
    for level in (2.0, 4.0, 6.0):
        ends = [tuple(round(v, 9) for v in p) for r in segments if r["level"] == level for p in ((r["r1"], r["c1"]), (r["r2"], r["c2"]))]
        assert all(ends.count(p) == 2 for p in ends)
        assert all(abs(np.hypot(a - 8, b - 8) - level) < 0.15 for a, b in ends)
    assert geometry.contour_segments(frame_of(spark, np.full((4, 4), 3.0)), 2.0).count() == 0


def test_band_regions_cover_every_cell_once(spark):
    z = np.array([[0.0, 0.5, 4.9], [-0.1, 5.0, 5.1], [0.2, 9.9, 0.3]])
    got = {(r["r"], r["c"]): (r["band"], r["label"]) for r in lines.band_regions(frame_of(spark, z), 5.0).collect()}
    assert got == {(0, 0): (0.0, 1), (0, 1): (0.0, 1), (0, 2): (0.0, 1), (1, 0): (-5.0, 1), (1, 1): (5.0, 1), (1, 2): (5.0, 1), (2, 0): (0.0, 2), (2, 1): (5.0, 1), (2, 2): (0.0, 3)}


def test_ranking_of_the_known_zones(spark):
    zones = spark.createDataFrame(
        [(1, 0.1, 2.0, 0.8, 10_000.0, False, None), (2, 0.1, 2.0, 0.8, 5_000_000.0, False, None), (3, 0.5, 2.0, 0.8, 200_000.0, False, None), (4, 0.3, 2.0, 0.2, 900_000.0, False, None), (5, 0.9, 2.0, 0.1, 1.0, True, "water")],
        "candidate_id int, area_ha double, mean_depth_m double, compactness double, catchment_area_m2 double, excluded boolean, exclusion_reason string",
    )
    got = {r["candidate_id"]: r for r in relational.rank_by_water(zones, 150.0).collect()}
    assert {k: r["rank"] for k, r in got.items()} == {3: 1, 2: 2, 1: 3, 4: None, 5: None}
    assert [round(got[k]["expected_volume_m3"], 6) for k in (1, 2, 3, 4)] == [270.0, 2100.0, 5400.0, 6300.0]
    assert got[5]["exclusion_reason"] == "water" and "compactness" in got[4]["exclusion_reason"]


def test_rain_ties_and_incomplete_years(spark):
    rows = [("2001-01-01", 5.0), ("2001-01-02", 9.0), ("2001-01-03", None), ("2002-05-05", 9.0)]
    rain = spark.createDataFrame(rows, "day string, mm double").withColumn("day", F.to_date("day"))
    assert tuple(relational.annual_mean(rain).first()) == (11.5, 2)
    assert str(relational.wettest_day(rain).first()["max_single_day_date"]) == "2001-01-02"
    assert tuple(relational.rain_coverage(rain).first()) == (4, 3)


def test_placemarks_and_elevation_rules(spark):
    line = "<Placemark><name>%s</name><description>about %s m</description><LineString><coordinates>1,2,0 3,4,0 x,y</coordinates></LineString></Placemark>"
    good = ("<kml>" + line % ("n", 10) + line % ("12", 12) + line % ("n", 14) + "<Placemark><Point><coordinates>1,1</coordinates></Point></Placemark></kml>").encode()
    files = spark.createDataFrame([("a", good), ("b", b"<kml><unclosed>"), ("c", b"PK\x03\x04junk"), ("d", b"<kml/>")], "path string, content binary")
    marks = feeds.placemarks(files)
    assert {r["path"] for r in marks.where("error IS NOT NULL").collect()} == {"b", "c", "d"}
    lines = feeds.contour_lines(marks).orderBy("n").collect()
    assert [(r["elevation"], r["source"], len(r["coords"])) for r in lines] == [(10.0, "description", 2), (12.0, "description", 2), (14.0, "description", 2)]


def test_png_filters():
    rgb = np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    raw = b"".join(b"\x00" + row.tobytes() for row in rgb[:1]) + b"".join(bytes([2]) + (rgb[y].astype(int) - rgb[y - 1]).astype(np.uint8).tobytes() for y in range(1, 6))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(feeds.decode_png(png), rgb)


def test_small_functions(spark):
    one = spark.range(1)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (2, 0), (2, 1), (0, 1))])
    row = one.select(
        georef.ring_area(ring).alias("area"), georef.polygon_centroid(ring).alias("centre"), georef.parse_bbox(F.lit("1, 2,3,4")).alias("good"), georef.parse_bbox(F.lit("1,2,x,4")).alias("bad"),
        sizing.title_case(F.lit("dadra-nagar (x)")).alias("title"), sizing.elevation_color(F.lit(0.0)).alias("color"), sizing.buffer_pixels(50.0, F.lit(20.0)).alias("pixels"), sizing.fill_ratio(F.lit(0.0), F.lit(3.0)).alias("ratio"),
    ).first()
    assert (row["area"], tuple(row["centre"]), tuple(row["good"]), row["bad"]) == (2.0, (1.0, 0.5), (1.0, 2.0, 3.0, 4.0), None)
    assert (row["title"], row["color"], row["pixels"], row["ratio"]) == ("Dadra-Nagar (X)", "rgb(33, 102, 172)", 2, 0.0)


def test_boundary_is_ignored_when_nothing_is_inside(spark):
    zones = spark.createDataFrame([(1,), (2,)], "k int")
    assert relational.keep_inside(zones, F.col("k") == 1).count() == 1 and relational.keep_inside(zones, F.col("k") == 9).count() == 2


CHEAP = [n for n in SQL if n not in QUERIES or not n.startswith(("raster", "depression", "zone", "d8", "flow", "catchment", "op"))]


@pytest.mark.parametrize("name", CHEAP)
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = c.execute(SQL[name])
    names = [d[0] for d in want.description]
    tidy = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    theirs = sorted((tuple(map(tidy, r)) for r in want.fetchall()), key=repr)
    mine = sorted((tuple(map(tidy, r)) for r in QUERIES[name](spark, SMALL).select(*names).collect()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("shape", [(4, 9), (13, 5), (7, 6), (1, 1)])
def test_resized_masks_take_the_scaled_index(spark, shape):
    m = np.random.default_rng(2).random((7, 6)) < 0.5
    cells = spark.createDataFrame([(0, int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)], "grid_id long, r int, c int")
    got = sorted((x["r"], x["c"]) for x in raster.resize(cells, *m.shape, *shape).collect())
    assert got == [(r, c) for r in range(shape[0]) for c in range(shape[1]) if m[r * 7 // shape[0], c * 6 // shape[1]]]


def test_outline_goes_on_past_a_pinched_start(spark):
    arms = [(0, 5), (1, 4), (1, 6), (2, 3), (2, 7)]  # an inverted V
    cells = spark.createDataFrame([(0, 1, r, c) for r, c in arms], "grid_id long, label int, r int, c int")
    row = lines.outlines(cells).first()
    ring = [(p["r"], p["c"]) for p in row["ring"]]
    assert set(ring) == set(arms) and len(ring) == 8 and row["area"] == 0.0
    assert lines.zone_shapes(cells).count() == 0
    square = spark.createDataFrame([(0, 1, r, c) for r in range(4) for c in range(4)], "grid_id long, label int, r int, c int")
    shape = lines.zone_shapes(square).first()
    assert (shape["perimeter"], shape["area"]) == (12.0, 9.0) and abs(shape["compactness"] - np.pi / 4) < 1e-9


@pytest.mark.parametrize("field", ["elevation", "elev", "level", "contour", "height", "alt", "z", "value"])
def test_elevation_fields(spark, field):
    kml = f"<kml><Placemark><LineString><coordinates>1,2 3,4</coordinates></LineString><ExtendedData><SchemaData><SimpleData name='id'>9</SimpleData><SimpleData name='My_{field.upper()}'>12.5</SimpleData></SchemaData></ExtendedData></Placemark></kml>"
    marks = feeds.placemarks(spark.createDataFrame([("a", kml.encode())], "path string, content binary"))
    assert marks.select(feeds.elevation_from_fields(F.col("fields")).alias("e")).first()["e"] == 12.5


def test_elevation_without_a_field_name(spark):
    kml = b"<kml><Placemark><ExtendedData><SimpleData>7</SimpleData></ExtendedData></Placemark><Placemark><ExtendedData><Data name='foo'><value> 8.5 </value></Data></ExtendedData></Placemark></kml>"
    marks = feeds.placemarks(spark.createDataFrame([("a", kml)], "path string, content binary")).orderBy("n")
    assert [r["e"] for r in marks.select(feeds.elevation_from_fields(F.col("fields")).alias("e")).collect()] == [7.0, 8.5]


@pytest.mark.parametrize(("text", "number"), [("at .5 m", 0.5), ("1e3", 1000.0), ("-12.25e-1x", -1.225), ("+7", 7.0), ("none", None), ("a 3. b", 3.0)])
def test_first_number_of_a_text(spark, text, number):
    assert spark.range(1).select(feeds.elevation_from_text(F.lit(text)).alias("n")).first()["n"] == number


def test_smoothing_in_stripes_equals_a_plain_convolution(spark):
    z = np.random.default_rng(9).normal(0, 5, (37, 5))
    got = grid_of(raster.smooth(frame_of(spark, z), 2.0), "z", z.shape)
    radius, wide = 8, np.pad(z, 8, mode="symmetric")
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 2.0) ** 2)
    w /= w.sum()
    want = sum(w[i] * w[j] * wide[i : i + 37, j : j + 5] for i in range(17) for j in range(17))
    assert np.allclose(got, want)


def test_rank_colors(spark):
    got = spark.createDataFrame([(k,) for k in (1, 2, 5, 9)], "k int").select(sizing.rank_color(F.col("k")).alias("x")).collect()
    assert [r["x"] for r in got] == ["#00e676", "#66dd55", "#f0a020", "#f0a020"]
