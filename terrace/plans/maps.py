"""Many contour maps at once: from documents or contour vertices to screened, ranked and traced sites of every map.

All figures that differ by map (raster, resolution, depth, boundary) are columns by grid_id, so
that one run takes any number of maps and none of them passes the driver.

Defined cases: a map without two levels or an extent has no sites, nor has one without a
depression; a boundary that holds no site of its map is ignored; a null boundary holds
everything; null coordinates are left out; repeated vertices count once; sites of a map rank by
falling volume, then candidate_id; documents that cannot be read are rows of the report only;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import georef
from terrace.operators import lines, raster, relational, surface
from terrace.operators.tables import numbered
from terrace.plans import sites
from terrace.sources import feeds

KEY = ["grid_id", "candidate_id"]


def contour_intervals(points: DataFrame) -> DataFrame:
    """grid_id, contour_interval of each map: the most frequent gap of adjacent distinct levels (6 places), the smallest on a tie.

    A map has tens of levels, so a window by map holds few rows.
    """
    levels = points.select("grid_id", F.col("z").cast("double").alias("z")).where("z IS NOT NULL").distinct()
    gap = F.round(F.lead("z").over(Window.partitionBy("grid_id").orderBy("z")) - F.col("z"), 6)
    gaps = levels.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("grid_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    return gaps.groupBy("grid_id").agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("b")).select("grid_id", (-F.col("b.g")).alias("contour_interval"))


def keep_inside(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Rows (grid_id, lon, lat, ...) inside their map's boundary (grid_id, boundary); where a map has none inside, its boundary is ignored."""
    marked = rows.join(boundaries.select("grid_id", F.col("boundary").alias("__ring")), "grid_id", "left")
    marked = raster.cut_lineage(marked.withColumn("__inside", F.coalesce(georef.point_in_ring(F.col("lon"), F.col("lat"), F.col("__ring")), F.lit(False))).drop("__ring"))
    some = marked.groupBy("grid_id").agg(F.max("__inside").alias("__some"))
    return marked.join(some, "grid_id").where("__inside OR NOT __some").drop("__inside", "__some")


def rank_by_map(rows: DataFrame, rain_mm: float) -> DataFrame:
    """Sizes, excludes and ranks the zones of every map: rank counts from 1 in each, by falling volume, then candidate_id; excluded zones have none."""
    scored = relational.exclude_shapes(relational.size_zones(rows, rain_mm)).withColumn("score", F.col("expected_volume_m3"))
    placed = raster.cut_lineage(numbered(scored, [F.asc("grid_id"), F.asc("excluded"), F.desc("score"), F.asc("candidate_id")], "place"))
    first = placed.groupBy("grid_id").agg(F.min("place").alias("first"))
    return placed.join(first, "grid_id").withColumn("rank", F.when(~F.col("excluded"), F.col("place") - F.col("first") + 1)).drop("place", "first")


def analyze_maps(
    points: DataFrame, rain_mm: float, requested_m: float | None = None, min_depth: float | None = None, boundaries: DataFrame | None = None,
    mask: DataFrame | None = None, water: DataFrame | None = None, streams: DataFrame | None = None, n: int = 5,
) -> DataFrame:
    """Sites of each map of contour vertices (grid_id, lon, lat, z), the first ``n`` of each with their traced catchments.

    The depth that makes a depression is the map's contour interval unless given (1 where a map
    has none).  ``boundaries`` (grid_id, boundary) are rings that centres must lie in.  ``mask``
    holds cells of imaged water (grid_id, r, c), ``water`` mapped polygons (wid, ring) and
    ``streams`` mapped lines (wid, coords), both in degrees; sites are screened by what is
    given, before they are ranked.  hull_pct is the share of the map's cells inside the hull of
    its vertices.
    """
    if (min_depth is not None and min_depth <= 0) or n < 1:
        raise ValueError("min_depth and n must be positive")
    points = raster.cut_lineage(points.select("grid_id", "lon", "lat", "z"))
    frames = surface.grids(points, requested_m).join(contour_intervals(points), "grid_id")
    deep = F.lit(float(min_depth)) if min_depth is not None else F.when(F.col("contour_interval") > 0, F.col("contour_interval")).otherwise(1.0)
    sides = ("n_rows", "n_cols", "min_lon", "min_lat", "max_lon", "max_lat")
    frames = raster.cut_lineage(frames.withColumn("m", georef.affine_resolution(*[F.col(s) for s in sides])).withColumn("deep", deep))

    built = raster.cut_lineage(surface.build_surface(points, requested_m, frames).select("grid_id", "r", "c", "z", "inside_hull"))
    hull = built.groupBy("grid_id").agg((100.0 * F.avg(F.col("inside_hull").cast("double"))).alias("hull_pct"))
    cells = built.select("grid_id", "r", "c", "z")
    depths = raster.cut_lineage(raster.depth(raster.fill(cells, 0.0)))
    zones = raster.cut_lineage(raster.label_zones(depths.join(frames.select("grid_id", "deep"), "grid_id").where("depth > deep")))
    shapes = raster.cut_lineage(lines.zone_shapes(zones))
    flow = raster.cut_lineage(raster.flow_direction(raster.fill(cells, raster.EPSILON)))
    accumulation = raster.cut_lineage(raster.flow_accumulation(flow))

    lon = lambda c: georef.affine_lon(c, F.col("n_cols"), F.col("min_lon"), F.col("max_lon"))
    lat = lambda r: georef.affine_lat(r, F.col("n_rows"), F.col("min_lat"), F.col("max_lat"))
    square = F.col("m") * F.col("m")
    label = ["grid_id", "label"]
    rows = raster.zone_statistics(zones, depths, 1.0, 0.0).join(shapes.select(*label, "compactness"), label).join(raster.zone_catchments(zones, accumulation, 1.0), label)
    rows = rows.join(frames, "grid_id").where(F.col("cells") * square >= sites.LEAST_AREA_M2).select(
        "grid_id", F.col("label").alias("candidate_id"), lon(F.col("centre_c")).alias("lon"), lat(F.col("centre_r")).alias("lat"), (F.col("cells") * square / 10_000.0).alias("area_ha"),
        "mean_depth_m", "max_depth_m", "compactness", (F.col("catchment_cells") * square).alias("catchment_area_m2"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("exclusion_reason"),
    )
    if boundaries is not None:
        rows = keep_inside(rows, boundaries)
    checked = not (mask is None and water is None and streams is None)
    if checked:
        outline = F.transform("ring", lambda p: F.struct(lon(p["c"]).alias("lon"), lat(p["r"]).alias("lat")))
        rings = shapes.join(frames, "grid_id").select(*label, outline.alias("ring"))
        rows = sites.screen_zones(raster.cut_lineage(rows), rings, zones, mask, water, streams)
    ranked = raster.cut_lineage(rank_by_map(raster.cut_lineage(rows), rain_mm))

    chosen = numbered(relational.top_sites(ranked, n).select(*KEY), [F.asc("grid_id"), F.asc("candidate_id")], "id")
    chosen = raster.cut_lineage(chosen)
    ponds = raster.cut_lineage(zones.join(chosen.withColumnRenamed("candidate_id", "label"), label).select("id", "grid_id", "r", "c"))
    traced = sites.trace_ponds(flow, accumulation, ponds, 1.0).join(chosen, "id").join(frames, "grid_id").select(
        *KEY, lon(F.col("pour_c")).alias("pour_lon"), lat(F.col("pour_r")).alias("pour_lat"), (F.col("catchment_area_m2") * square).alias("traced_m2"), "self_overlap_pct", "warnings"
    )
    unchecked = F.lit(None if checked else "sites have not been checked against known water").cast("string")
    notes = F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(unchecked)))
    return ranked.join(traced, KEY, "left").withColumn("warnings", notes).join(hull, "grid_id")


def read_maps(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of contour documents (path, content): what is known of each, with its grid_id (null if it is rejected), all vertices, and the boundaries."""
    marks = raster.cut_lineage(feeds.placemarks(files))
    report = raster.cut_lineage(feeds.map_report(marks))
    ids = raster.cut_lineage(numbered(report.where("rejected IS NULL").select("path"), [F.asc("path")], "grid_id").withColumn("grid_id", F.col("grid_id").cast("long")))
    points = surface.vertices(feeds.contour_lines(marks).join(ids, "path"), F.col("grid_id"))
    report = report.join(ids, "path", "left")
    return report, points, report.where("grid_id IS NOT NULL").select("grid_id", "boundary")


def analyze_files(files: DataFrame, rain_mm: float, **options) -> tuple[DataFrame, DataFrame]:
    """The report on contour documents (path, content) and the sites of those that are not rejected, with their path; ``options`` as for :func:`analyze_maps`."""
    report, points, boundaries = read_maps(files)
    found = analyze_maps(points, rain_mm, boundaries=boundaries, **options)
    return report, found.join(report.select("grid_id", "path"), "grid_id")
