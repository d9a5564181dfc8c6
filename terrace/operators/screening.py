"""Polygons on rasters, exact overlap with mapped water, and the checks of a finished run.

Rings are arrays of (lon, lat) structs, or of (r, c) structs on a raster; the closing
point may be given or not.

Defined cases: a null or empty ring has no cells and no overlap; a ring without area
covers the cells under its sides, and its share of water is 0; repeated waters count
as often as they are given, up to a share of 1; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import georef, sizing
from terrace.operators import overlay, raster, relational

#: Degrees within which a mapped water line counts as water (15 m).
LINE_BUFFER_DEG = 15.0 / georef.METRES_PER_DEGREE


def pixel_ring(ring: Column, rows: Column, cols: Column, box: Column) -> Column:
    """A ring on an affine raster of the given box, as (r, c), not rounded."""
    col = lambda p: georef.affine_col(p["lon"], cols, box["min_lon"], box["max_lon"])
    row = lambda p: georef.affine_row(p["lat"], rows, box["min_lat"], box["max_lat"])
    return F.transform(ring, lambda p: F.struct(row(p).alias("r"), col(p).alias("c")))


def rasterize_rings(shapes: DataFrame, rows: int, cols: int) -> DataFrame:
    """id, grid_id, r, c of the cells of each ring (id, grid_id, ring) on a raster of ``rows`` x ``cols``.

    Corners are truncated to whole cells.  A cell is covered if it is inside by the
    even-odd rule or lies under a side; a side covers one cell a step of its longer axis,
    the other coordinate rounded, halves up, from the side's smaller end on.
    """
    corners = F.transform("ring", lambda p: F.struct(p["r"].cast("int").alias("r"), p["c"].cast("int").alias("c")))
    sides = shapes.where(F.size("ring") > 0).select("id", "grid_id", F.explode(georef.edges(corners)).alias("e"))
    sides = sides.select("id", "grid_id", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
    sides = sides.select("id", "grid_id", F.col("a.r").alias("r0"), F.col("a.c").alias("c0"), (F.col("b.r") - F.col("a.r")).alias("dr"), (F.col("b.c") - F.col("a.c")).alias("dc"))

    first, last = F.greatest("r0", F.lit(0)), F.least(F.col("r0") + F.col("dr") - 1, F.lit(rows - 1))
    crossed = sides.where(last >= first).withColumn("r", F.explode(F.sequence(first, last)))
    crossed = crossed.select("id", "grid_id", "r", (F.col("c0") + (F.col("r") - F.col("r0")) * F.col("dc") / F.col("dr")).alias("x"))
    spans = crossed.groupBy("id", "grid_id", "r").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most a ring's sides
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda k: F.struct(F.ceil(F.get("xs", k)).alias("x"), F.floor(F.get("xs", k + 1)).alias("y")))
    spans = spans.select("id", "grid_id", "r", F.explode(pairs).alias("p"))
    spans = spans.select("id", "grid_id", "r", F.greatest("p.x", F.lit(0)).alias("x"), F.least("p.y", F.lit(cols - 1)).alias("y")).where("y >= x")
    inside = spans.select("id", "grid_id", "r", F.explode(F.sequence(F.col("x").cast("int"), F.col("y").cast("int"))).alias("c"))

    steps = F.greatest(F.lit(1), F.col("dr"), F.abs("dc"))
    walked = sides.select("*", steps.alias("n"), F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    at = lambda start, way: (F.col(start) + F.floor(F.col("k") * F.col(way) / F.col("n") + 0.5)).cast("int")
    under = walked.select("id", "grid_id", at("r0", "dr").alias("r"), at("c0", "dc").alias("c"))
    return inside.unionByName(under.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))).distinct()


def ring_intersection_area(one: Column, two: Column) -> Column:
    """Area that two simple rings share, in square degrees; exact, concave rings included.

    A ring is the signed sum of the areas under its sides, so the shared area is the sum,
    over pairs of sides, of the area under the lower of both where their spans meet.
    """
    floor = F.array_min(F.transform(F.concat(one, two), lambda p: p["lat"]))

    def spans(ring: Column) -> Column:
        def span(e: Column) -> Column:
            a, b = e["a"], e["b"]
            wide = b["lon"] - a["lon"]
            slope = (b["lat"] - a["lat"]) / F.when(wide != 0, wide)
            left = F.when(wide > 0, a["lat"]).otherwise(b["lat"])
            return F.struct(F.least(a["lon"], b["lon"]).alias("lo"), F.greatest(a["lon"], b["lon"]).alias("hi"), (left - floor).alias("y"), slope.alias("m"), F.signum(wide).alias("s"))

        return F.filter(F.transform(georef.edges(ring), span), lambda s: s["m"].isNotNull())

    def under(p: Column, q: Column) -> Column:
        lo, hi = F.greatest(p["lo"], q["lo"]), F.least(p["hi"], q["hi"])
        y = lambda s, x: s["y"] + s["m"] * (x - s["lo"])
        d0, d1 = y(p, lo) - y(q, lo), y(p, hi) - y(q, hi)
        apart = F.when(d0 * d1 < 0, (d0 * d0 + d1 * d1) / (F.abs(d0) + F.abs(d1))).otherwise(F.abs(d0 + d1)) / 2
        mean = (y(p, lo) + y(p, hi) + y(q, lo) + y(q, hi)) / 2
        return F.when(hi > lo, p["s"] * q["s"] * (hi - lo) * (mean - apart) / 2).otherwise(0.0)

    def total(ones: Column, twos: Column) -> Column:
        return F.aggregate(ones, F.lit(0.0), lambda s, p: s + F.aggregate(twos, F.lit(0.0), lambda t, q: t + under(p, q)))

    held = F.get(F.transform(F.array(F.struct(spans(one).alias("one"), spans(two).alias("two"))), lambda s: F.abs(total(s["one"], s["two"]))), F.lit(0))
    return F.when((F.size(one) >= 3) & (F.size(two) >= 3), held).otherwise(0.0)


def _boxes(df: DataFrame, key: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    b = df.where(F.size("ring") >= 3).select(F.col(key).alias(f"{p}id"), *by, georef.ring_bbox(F.col("ring")).alias("b"))
    return b.select(f"{p}id", *by, *[F.col(f"b.{n}").alias(f"{p}{k}") for n, k in (("min_lon", "x0"), ("min_lat", "y0"), ("max_lon", "x1"), ("max_lat", "y1"))])


def mapped_water_share(ponds: DataFrame, water: DataFrame, cell: float, lines: DataFrame | None = None, within: float = LINE_BUFFER_DEG, by: tuple[str, ...] = ()) -> DataFrame:
    """id, osm_water_fraction of each pond (id, ring): the areas shared with water polygons (wid, ring), summed, over its own, 1 at most.

    Lines (wid, coords) count as the merged strip within so many degrees of them; what two
    lines, or a line and a polygon, share counts for both.  Boxes meet by an equi-join on grid
    cells of ``cell`` degrees before any ring is compared.  With ``by``, columns of ponds, water
    and lines, a pond meets only the water that is equal in them.  Equal ponds and equal waters
    are compared once and counted as often as they are given.
    """
    key = [*by, "ring"]
    numbered = lambda df, name: raster.cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
    each = numbered(ponds.where(F.size("ring") >= 3).select(*key).distinct(), "id")
    wet = numbered(water.where(F.size("ring") >= 3).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "wid")
    met = relational.bbox_range_join(_boxes(each, "id", "l", by), _boxes(wet, "wid", "r", by), cell, by).select("lid", "rid")
    met = met.join(each.select(F.col("id").alias("lid"), F.col("ring").alias("pond")), "lid").join(wet.select(F.col("wid").alias("rid"), F.col("ring").alias("wet"), "n"), "rid")
    shared = met.select(F.col("lid").alias("id"), (F.col("n") * ring_intersection_area(F.col("pond"), F.col("wet"))).alias("shared"))
    if lines is not None:
        # Lines that share a wid are one line of many parts; of the others, equal ones become one that counts n times.
        parts = lines.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(*by, "wid")) > 1)
        parts = parts.groupBy(*by, "many", F.when(F.col("many"), F.col("wid")).alias("one"), "coords").agg(F.min("wid").alias("wid"), F.count(F.lit(1)).alias("n"))
        parts = parts.select(*by, F.struct("wid", F.when(F.col("many"), 1).otherwise(F.col("n")).alias("n")).alias("wid"), "coords")
        shared = shared.unionByName(line_overlap(each, parts, cell, within, by).select("id", (F.col("wid.n") * F.col("shared")).alias("shared")))
    shared = each.join(shared.groupBy("id").agg(F.sum("shared").alias("shared")), "id").drop("id")
    area = georef.ring_area(F.col("ring"))
    share = F.when(area > 0, F.least(F.lit(1.0), F.coalesce("shared", F.lit(0.0)) / F.when(area > 0, area))).otherwise(0.0)
    return ponds.join(shared, key, "left").select("id", share.alias("osm_water_fraction"))


def line_overlap(ponds: DataFrame, lines: DataFrame, cell: float, within: float = LINE_BUFFER_DEG, by: tuple[str, ...] = ()) -> DataFrame:
    """id, wid, shared: the area of each pond (id, ring) under the merged strip of each line (wid, coords) that comes near it.

    Lines are cut into their sides, and the boxes of sides meet those of ponds, so that a long
    line is never compared as a whole; strips are drawn only where a pond is near.  A pond and
    sides that come again, in whatever map, are compared once.
    """
    side = overlay.line_sides(lines, by)
    low = lambda n: F.least(f"s.a.{n}", f"s.b.{n}") - within
    high = lambda n: F.greatest(f"s.a.{n}", f"s.b.{n}") + within
    boxes = side.select(F.struct("wid", "s").alias("rid"), *by, low("lon").alias("rx0"), low("lat").alias("ry0"), high("lon").alias("rx1"), high("lat").alias("ry1"))
    near = relational.bbox_range_join(_boxes(ponds, "id", "l", by), boxes, cell, by)
    met = near.groupBy(F.col("lid").alias("id"), F.col("rid.wid").alias("wid")).agg(F.sort_array(F.collect_set("rid.s")).alias("sides"))
    met = raster.cut_lineage(met.join(ponds.select("id", F.col("ring").alias("pond")), "id"))
    tasks = int(ponds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = raster.cut_lineage(met.select("pond", "sides").distinct().repartition(tasks).withColumn("n", F.monotonically_increasing_id()))
    areas = each.join(overlay.shared_areas(each.repartition(tasks), within), "n")
    return met.join(areas, ["pond", "sides"]).select("id", "wid", "shared")


def near_line(lon: Column, lat: Column, coords: Column, within=LINE_BUFFER_DEG) -> Column:
    """Whether a point is within so many degrees of a line of (lon, lat) points."""

    def distance(a: Column, b: Column) -> Column:
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / F.when(long > 0, long)))).otherwise(0.0)
        return F.hypot(lon - a["lon"] - t * dx, lat - a["lat"] - t * dy)

    onward = F.concat(F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, F.size(coords), F.lit(1)))
    return F.coalesce(F.exists(F.zip_with(coords, onward, distance), lambda d: d <= within), F.lit(False))


def screen(ponds: DataFrame, water: DataFrame, mask: DataFrame, cells: DataFrame, cell: float, lines: DataFrame | None = None) -> DataFrame:
    """Ponds (candidate_id, ring, ...) with both shares of water and those over the limit excluded; an earlier reason stays.

    ``water`` are mapped polygons (wid, ring), ``lines`` mapped lines (wid, coords), ``mask``
    the imaged water cells and ``cells`` the ponds' own (id, grid_id, r, c).
    """
    mapped = mapped_water_share(ponds.select(F.col("candidate_id").alias("id"), "ring"), water, cell, lines)
    imaged = raster.mask_overlap(cells, mask).withColumnRenamed("fraction", "worldcover_water_fraction")
    shares = mapped.join(imaged, "id", "left").withColumnRenamed("id", "candidate_id")
    return relational.screen_water(ponds.join(shares, "candidate_id", "left"))


def inside_box(lon: Column, lat: Column, box: Column) -> Column:
    """Whether a centre lies in a box, sides included."""
    return lon.between(box["min_lon"], box["max_lon"]) & lat.between(box["min_lat"], box["max_lat"])


def mask_coverage(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """percent of a raster's cells that a mask covers, in one row."""
    return mask.select("r", "c").distinct().agg((100.0 * F.count(F.lit(1)) / (rows * cols)).alias("percent"))


def recheck_water(shares: DataFrame, excluded_by_water: int, coverage_percent: float, limit: float = sizing.WATER_LIMIT) -> DataFrame:
    """One row on returned sites (rank, fraction): on_water (ranks over the limit), unscreened (water is there, yet nothing was excluded) and passed."""
    wet = F.sort_array(F.collect_list(F.when(F.col("fraction") >= limit, F.col("rank"))))  # at most the few returned sites
    unscreened = F.lit(coverage_percent > 0 and excluded_by_water == 0)
    return shares.agg(wet.alias("on_water")).select("on_water", unscreened.alias("unscreened"), ((F.size("on_water") == 0) & ~unscreened).alias("passed"))


def degraded_sources(run: DataFrame) -> DataFrame:
    """missing: the names of sources that a run's flags say did not answer; a null flag is no failure."""
    names = ("worldcover_available", "swir_available", "rainfall_available")
    return run.select("*", F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n.removesuffix("_available"))) for n in names])).alias("missing"))


def result_bounds(rings: DataFrame) -> DataFrame:
    """min_lon, min_lat, max_lon, max_lat over all rings, in one row."""
    b = rings.select(georef.ring_bbox(F.col("ring")).alias("b"))
    return b.agg(F.min("b.min_lon").alias("min_lon"), F.min("b.min_lat").alias("min_lat"), F.max("b.max_lon").alias("max_lon"), F.max("b.max_lat").alias("max_lat"))


def sample_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (grid_id, row, col, as doubles) with z of the nearest cell, halves to even; null outside the raster."""
    at = points.withColumn("r", F.rint("row").cast("int")).withColumn("c", F.rint("col").cast("int"))
    return at.join(cells.select("grid_id", "r", "c", "z"), ["grid_id", "r", "c"], "left").drop("r", "c")
