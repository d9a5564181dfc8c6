"""Points in regions of many rings, and what a drawn region leaves of a run."""

import numpy as np
from pyspark.sql import functions as F

from terrace.operators import regions

KIND = "region_id int, parts array<array<array<struct<lon:double,lat:double>>>>"


def in_ring(x, y, g):
    hit = False
    for (ax, ay), (bx, by) in zip(g, g[1:] + g[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def contains(parts, x, y):
    return any(in_ring(x, y, rings[0]) and not any(in_ring(x, y, h) for h in rings[1:]) for rings in parts)


def wobbly(rng, x, y, size, n, closed=False):
    angles = np.sort(rng.random(n)) * 2 * np.pi
    ring = [(x + float(r * np.cos(a)), y + float(r * np.sin(a))) for a, r in zip(angles, size * (0.4 + rng.random(n)), strict=True)]
    return ring + ring[:1] if closed else ring


def test_many_points_meet_many_regions(spark):
    rng = np.random.default_rng(4)
    shapes = {}
    for k in range(25):
        x, y = map(float, rng.random(2) * 6 - 3)
        shapes[k] = [[wobbly(rng, x, y, 1.2, 9, k % 2 == 0), wobbly(rng, x, y, 0.3, 5), wobbly(rng, x + 0.2, y, 0.3, 4)], [wobbly(rng, x + 3, y, 0.5, 4)]]
    shapes[99] = [[[(-4.0, -4.0), (9.0, -4.0), (9.0, 4.0), (-4.0, 4.0)]]]
    places = [tuple(map(float, p)) for p in rng.random((400, 2)) * 10 - 5] + [(0.0, -4.0), (0.0, 4.0), (-4.0, 0.0), (9.0, 0.0)]
    want = sorted((k, *p) for k, parts in shapes.items() for p in places if contains(parts, *p))
    points = spark.createDataFrame(places * 2, "lon double, lat double").withColumn("region_id", F.lit(7))
    frame = spark.createDataFrame(list(shapes.items()), KIND)
    for cell, most in ((0.7, 10), (5.0, 100_000)):
        got = regions.points_in_regions(points, frame, cell, per_task=most).collect()
        assert sorted(map(tuple, got)) == want


def test_counting_crossings_needs_no_further_shuffle(spark):
    points = spark.createDataFrame([(0.5, 0.5)], "lon double, lat double")
    frame = spark.createDataFrame([(1, [[[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]]])], KIND)
    adaptive, small = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = regions.points_in_regions(points, frame, 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "Exchange" not in plan.split("Join", 1)[0] and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_rows_of_points_and_regions(spark):
    square, none = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], None
    shapes = [(1, none), (2, []), (3, [[]]), (4, [none, [none], [square[:2]]]), (5, [[square], [[(5.0, 0.0), (None, 1.0), (6.0, 1.0)]]]), (5, [[[(x + 10, y) for x, y in square]]]), (None, [[square]]), (6, [[[(float("nan"), 0.0)] * 4]])]
    frame = spark.createDataFrame(shapes, KIND).withColumn("cx", F.lit("other"))
    places = [(1.0, 1.0), (1.0, 1.0), (11.0, 1.0), (None, 1.0), (float("nan"), 1.0), (1.0, None)]
    points = spark.createDataFrame(places, "lon double, lat double").withColumn("share", F.lit("other"))
    got = regions.points_in_regions(points, frame, 1.0).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, 1.0, 1.0), (5, 11.0, 1.0), (None, 1.0, 1.0)], key=repr)
    assert regions.points_in_regions(points.limit(0), frame, 1.0).count() == 0 and regions.points_in_regions(points, frame.limit(0), 1.0).count() == 0


def test_a_drawn_region_clips_its_run_only(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    frame = spark.createDataFrame([(1, [[square, hole]]), (2, None)], KIND)
    rows = [(1, 0.2, 0.2, "in"), (1, 0.2, 0.2, "again"), (1, 1.0, 1.0, "hole"), (1, 9.0, 9.0, "out"), (1, None, 1.0, "no place"), (2, 9.0, 9.0, "no clip"), (3, 9.0, 9.0, "no region")]
    items = spark.createDataFrame(rows, "region_id int, lon double, lat double, inside string")
    clipped = regions.clip_to_drawn(items.withColumn("name", F.col("inside")), frame)
    got = {r["name"]: r["inside"] for r in clipped.collect()}
    assert got == {"in": True, "again": True, "hole": False, "out": False, "no place": True, "no clip": True, "no region": True}
    counts = regions.clip_counts(clipped).selectExpr("*", "5L AS detected", "CAST(NULL AS BIGINT) AS excluded_by_water", "2L AS excluded_by_shape")
    lines = {r["region_id"]: r["breakdown"] for r in regions.why_no_sites(counts).collect()}
    assert lines[1] == ["Natural hollows checked: 5", "On or next to existing water: 0", "Long and narrow (stream channels): 2", "Outside the shape you drew: 2"]
    assert len(lines[2]) == 3
