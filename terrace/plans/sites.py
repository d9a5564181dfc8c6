"""Composites: sites of one contour map, catchments of chosen ponds, site cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import georef, sizing
from terrace.operators import lines, raster, relational, screening, surface
from terrace.operators.tables import numbered

#: Zones below this are no sites.
LEAST_AREA_M2 = 200.0
#: Side in degrees of the grid cells through which sites meet mapped water.
WATER_CELL = 0.01


def trace_ponds(flow: DataFrame, accumulation: DataFrame, ponds: DataFrame, cell_area_m2: float) -> DataFrame:
    """id, pour_r, pour_c, catchment_area_m2, ratio, self_overlap_pct, error, warnings of each pond, given as cells (id, grid_id, r, c).

    A pond without a cell on the raster has an error and nulls.
    """
    return _traced(flow, accumulation, ponds, cell_area_m2)[0]


def trace_rings(flow: DataFrame, accumulation: DataFrame, rings: DataFrame, rows: int, cols: int, box: tuple[float, float, float, float]) -> DataFrame:
    """What ``trace_ponds`` gives for pond outlines (id, grid_id, ring of lon and lat) on an affine raster, with ``outline``: the catchment's border (lon, lat), thinned and closed.

    ``box`` is min_lon, min_lat, max_lon, max_lat.  An outline off the raster has an
    error; a catchment of under three corners has no outline.
    """
    sides = dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), map(F.lit, map(float, box)), strict=True))
    square = F.struct(*[v.alias(k) for k, v in sides.items()])
    high, wide = F.lit(rows), F.lit(cols)
    pixels = rings.select("id", "grid_id", screening.pixel_ring(F.col("ring"), high, wide, square).alias("ring"))
    ponds = raster.cut_lineage(screening.rasterize_rings(pixels, rows, cols))
    metres = rings.sparkSession.range(1).select(georef.affine_resolution(high, wide, *sides.values()).alias("m")).first()["m"]
    found, land = _traced(flow, accumulation, ponds, metres * metres)
    borders = lines.polygons(land.select("grid_id", F.col("id").cast("int").alias("label"), "r", "c"))
    lon, lat = (lambda p: georef.affine_lon(p["c"], wide, sides["min_lon"], sides["max_lon"])), (lambda p: georef.affine_lat(p["r"], high, sides["min_lat"], sides["max_lat"]))
    outline = F.transform("ring", lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat")))
    off = F.when(F.col("found").isNull(), "no cell of the pond is on the raster").otherwise(F.col("error"))
    out = rings.select("id").join(found.withColumn("found", F.lit(True)), "id", "left").withColumn("error", off).drop("found")
    return out.join(borders.select(F.col("label").alias("id"), outline.alias("outline")), "id", "left")


def _traced(flow: DataFrame, accumulation: DataFrame, ponds: DataFrame, cell_area_m2: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``trace_ponds`` and the cells of the catchments (id, grid_id, r, c)."""
    pours = raster.cut_lineage(raster.pour_points(ponds.withColumnRenamed("id", "label"), accumulation).select(F.col("label").alias("pour_id"), "grid_id", "r", "c"))
    land = raster.cut_lineage(raster.catchments(flow, pours).withColumnRenamed("pour_id", "id"))
    size = land.groupBy("id").agg((F.count(F.lit(1)) * cell_area_m2).alias("catchment_area_m2"))
    own = ponds.groupBy("id").agg((F.count(F.lit(1)) * cell_area_m2).alias("pond_m2"))
    out = own.join(pours.select(F.col("pour_id").alias("id"), F.col("r").alias("pour_r"), F.col("c").alias("pour_c")), "id", "left").join(size, "id", "left").join(relational.self_overlap(ponds, land), "id", "left")
    found, ratio = F.col("pour_r").isNotNull(), sizing.catchment_ratio(F.col("catchment_area_m2"), F.col("pond_m2"))
    share = F.when(found, F.col("percent"))
    many = F.when(ratio > sizing.RATIO_WARNING, F.format_string("catchment is %.1f times the pond", ratio))
    rows = out.select(
        "id", "pour_r", "pour_c", "catchment_area_m2", F.when(found, ratio).alias("ratio"), share.alias("self_overlap_pct"),
        F.when(~found, "no cell of the pond is on the raster").alias("error"), F.array_compact(F.array(many, sizing.overlap_warning(share))).alias("warnings"),
    )
    return rows, land


def screen_zones(rows: DataFrame, rings: DataFrame, zones: DataFrame, mask: DataFrame | None = None, water: DataFrame | None = None, streams: DataFrame | None = None, cell: float = WATER_CELL) -> DataFrame:
    """Zones (grid_id, candidate_id, excluded, exclusion_reason, ...) screened against imaged water cells, mapped polygons (wid, ring) and mapped lines (wid, coords), as far as they are given.

    ``rings`` (grid_id, label, ring of lon and lat) are the zones' outlines, ``zones`` their
    cells.  A zone without an outline shares no mapped water; an earlier reason stays.
    """
    spark, key = rows.sparkSession, ["grid_id", "candidate_id"]
    ids = raster.cut_lineage(numbered(rows.select(*key), [F.asc(k) for k in key], "site"))
    labels = ids.withColumnRenamed("candidate_id", "label")
    named = labels.join(rings.select("grid_id", "label", "ring"), ["grid_id", "label"], "left")
    ponds = rows.select(*key, "excluded", "exclusion_reason").join(named.withColumnRenamed("label", "candidate_id"), key)
    ponds = raster.cut_lineage(ponds.select(F.col("site").alias("candidate_id"), "ring", "excluded", "exclusion_reason"))
    own = zones.join(labels, ["grid_id", "label"]).select(F.col("site").alias("id"), "grid_id", "r", "c")
    mask = spark.createDataFrame([], "grid_id long, r int, c int") if mask is None else mask
    water = spark.createDataFrame([], "wid long, ring array<struct<lon:double,lat:double>>") if water is None else water
    found = screening.screen(ponds, water, mask, own, cell, streams)
    found = found.select(F.col("candidate_id").alias("site"), "excluded", "exclusion_reason", "osm_water_fraction", "worldcover_water_fraction")
    return rows.drop("excluded", "exclusion_reason").join(ids, key).join(found, "site").drop("site")


def find_sites(
    cells: DataFrame, resolution_m: float, rain_mm: float, min_depth: float, sigma: float = 5.0, water: DataFrame | None = None, inside: Column | None = None, n: int = 5,
    box: tuple[float, float, float, float] | None = None, mapped: DataFrame | None = None, streams: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites of a raster (grid_id, r, c, z): the ranked first ``n``, the largest excluded ones, and the run's counters.

    The raster is smoothed first.  ``inside`` is a condition on the centres centre_r and
    centre_c (and lon and lat with a box), ``water`` the cells (grid_id, r, c) of imaged water,
    against which zones are screened before they are ranked.  With ``box`` (min_lon, min_lat,
    max_lon, max_lat of the raster) sites have lon and lat, and are screened against mapped
    polygons (``mapped``: wid, ring) and lines (``streams``: wid, coords) too.
    """
    if box is None and not (mapped is None and streams is None):
        raise ValueError("mapped water needs the raster's box")
    if min_depth <= 0 or not 1 <= n <= 50:
        raise ValueError("min_depth must be positive and n within 1 to 50")
    ground = raster.cut_lineage(raster.smooth(cells, sigma))
    depths = raster.cut_lineage(raster.depth(raster.fill(ground, 0.0)))
    zones = raster.cut_lineage(raster.label_zones(depths.where(F.col("depth") > min_depth)))
    accumulation = raster.flow_accumulation(raster.cut_lineage(raster.flow_direction(raster.fill(ground, raster.EPSILON))))
    area = resolution_m * resolution_m
    key = ["grid_id", "label"]
    shapes = raster.cut_lineage(lines.zone_shapes(zones))
    rows = raster.zone_statistics(zones, depths, resolution_m).join(shapes.select(*key, "compactness"), key).join(raster.zone_catchments(zones, accumulation, area), key)
    place, rings = [], shapes.select(*key, F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("ring"))
    if box is not None:
        west, south, east, north = (F.lit(float(v)) for v in box)
        size = raster.cut_lineage(cells.groupBy("grid_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols")))
        lon, lat = (lambda c: georef.affine_lon(c, F.col("n_cols"), west, east)), (lambda r: georef.affine_lat(r, F.col("n_rows"), south, north))
        rows = rows.join(size, "grid_id").withColumn("lon", lon(F.col("centre_c"))).withColumn("lat", lat(F.col("centre_r")))
        rings = shapes.join(size, "grid_id").select(*key, F.transform("ring", lambda p: F.struct(lon(p["c"]).alias("lon"), lat(p["r"]).alias("lat"))).alias("ring"))
        place = ["lon", "lat"]
    if inside is not None:
        rows = rows.where(inside)
    rows = rows.select(
        "grid_id", F.col("label").alias("candidate_id"), "centre_r", "centre_c", *place, (F.col("area_m2") / 10_000.0).alias("area_ha"), "mean_depth_m", "max_depth_m", "compactness", "catchment_area_m2",
        F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("exclusion_reason"),
    )
    if not (water is None and mapped is None and streams is None):
        rows = screen_zones(raster.cut_lineage(rows), rings, zones, water, mapped, streams)
    ranked = raster.cut_lineage(relational.rank_by_water(raster.cut_lineage(rows), rain_mm))
    return relational.top_sites(ranked, n), relational.largest_excluded(ranked), relational.run_counters(ranked, n)


def analyze_map(points: DataFrame, rain_mm: float, requested_m: float | None = None, min_depth: float | None = None, boundary: Column | None = None, water: DataFrame | None = None, n: int = 5) -> DataFrame:
    """Ranked sites of one map, from contour vertices (grid_id, lon, lat, z), with the traced catchment of the first ``n``.

    The depth that makes a depression is the contour interval unless given.  ``boundary``
    is a ring of (lon, lat) that zone centres must lie in, unless none does.  ``water``
    holds the cells (grid_id, r, c) of imaged water; without it nothing is screened.
    """
    points = raster.cut_lineage(points)
    frames = raster.cut_lineage(surface.grids(points, requested_m))
    sides = ("n_rows", "n_cols", "min_lon", "min_lat", "max_lon", "max_lat")
    frame = frames.select(*sides, georef.affine_resolution(*[F.col(s) for s in sides]).alias("m")).take(2)
    if len(frame) != 1:
        raise ValueError("a map needs two levels, an extent and one grid_id")
    frame = frame[0]
    interval = relational.contour_interval(points.select(F.col("z").alias("elevation"))).first()
    deep = min_depth if min_depth is not None else (interval["contour_interval"] if interval else None) or 1.0
    if deep <= 0:
        raise ValueError("min_depth must be positive")

    cells = raster.cut_lineage(surface.build_surface(points, requested_m, frames).select("grid_id", "r", "c", "z"))
    depths = raster.cut_lineage(raster.depth(raster.fill(cells, 0.0)))
    zones = raster.cut_lineage(raster.label_zones(depths.where(F.col("depth") > deep)))
    shapes = lines.zone_shapes(zones).select("grid_id", "label", "compactness")
    flow = raster.cut_lineage(raster.flow_direction(raster.fill(cells, raster.EPSILON)))
    accumulation = raster.cut_lineage(raster.flow_accumulation(flow))
    rows = raster.zone_statistics(zones, depths, frame["m"]).join(shapes, ["grid_id", "label"]).join(raster.zone_catchments(zones, accumulation, frame["m"] ** 2), ["grid_id", "label"])
    lon, lat = (lambda c: georef.affine_lon(c, frame["n_cols"], frame["min_lon"], frame["max_lon"])), (lambda r: georef.affine_lat(r, frame["n_rows"], frame["min_lat"], frame["max_lat"]))
    rows = rows.select(
        "grid_id", F.col("label").alias("candidate_id"), lon(F.col("centre_c")).alias("lon"), lat(F.col("centre_r")).alias("lat"), (F.col("area_m2") / 10_000.0).alias("area_ha"),
        "mean_depth_m", "max_depth_m", "compactness", "catchment_area_m2", F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("exclusion_reason"),
    )
    if boundary is not None:
        rows = relational.keep_inside(raster.cut_lineage(rows), georef.point_in_ring(F.col("lon"), F.col("lat"), boundary))
    if water is not None:
        wet = zones.join(water.select("grid_id", "r", "c").distinct().withColumn("w", F.lit(1)), ["grid_id", "r", "c"], "left").groupBy("grid_id", F.col("label").alias("candidate_id"))
        rows = rows.join(wet.agg((F.count("w") / F.count(F.lit(1))).alias("worldcover_water_fraction")), ["grid_id", "candidate_id"]).withColumn("osm_water_fraction", F.lit(0.0))
        rows = relational.screen_water(rows).drop("worldcover_water_fraction", "osm_water_fraction")
    ranked = raster.cut_lineage(relational.rank_by_water(raster.cut_lineage(rows), rain_mm))
    chosen = relational.top_sites(ranked, n).select("grid_id", F.col("candidate_id").alias("label"))
    ponds = raster.cut_lineage(zones.join(chosen, ["grid_id", "label"]).select(F.col("label").alias("id"), "grid_id", "r", "c"))
    traced = trace_ponds(flow, accumulation, ponds, frame["m"] ** 2).select(
        F.col("id").alias("candidate_id"), lon(F.col("pour_c")).alias("pour_lon"), lat(F.col("pour_r")).alias("pour_lat"), F.col("catchment_area_m2").alias("traced_m2"), "self_overlap_pct", "warnings"
    )
    unchecked = F.lit(None).cast("string") if water is not None else F.lit("sites have not been checked against known water")
    notes = F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(unchecked)))
    return ranked.join(traced, "candidate_id", "left").withColumn("warnings", notes)


def site_card(sites: DataFrame) -> DataFrame:
    """What a site's card shows, by candidate_id; a traced catchment (traced_ha, traced_ratio) wins over the estimate, and nulls stay null."""
    volume = F.coalesce("expected_volume_m3", F.when(F.col("capacity_m3").isNotNull() & F.col("runoff_m3").isNotNull(), F.least("capacity_m3", "runoff_m3")))
    land = F.coalesce(F.col("traced_ha"), F.col("catchment_area_m2") / 10_000.0)
    ratio = F.coalesce(F.col("traced_ratio"), F.when(F.col("area_ha") > 0, land / F.when(F.col("area_ha") > 0, F.col("area_ha"))))
    low = F.when(F.col("fill_ratio") < 1, F.concat(F.lit("One design storm fills only "), F.round(F.col("fill_ratio") * 100).cast("long").cast("string"), F.lit("%: it may never fill")))
    return sites.select(
        "candidate_id", volume.alias("volume_m3"), F.when(volume >= 100_000, volume / 100_000.0).alias("volume_lakh"), F.round(F.col("capture_fraction") * 100).cast("long").alias("kept_pct"),
        land.alias("catchment_ha"), F.round(ratio).cast("long").alias("ratio"), F.when(F.col("fill_ratio").isNotNull(), sizing.fill_status(F.col("fill_ratio"))).alias("status"), low.alias("note"),
    )
