"""Relational operators: ranking, rainfall, caches, range joins, contour statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import sizing
from terrace.operators.tables import cut_lineage, numbered


def size_zones(zones: DataFrame, rain_mm: float) -> DataFrame:
    """Adds storage, capacity, runoff, fill ratio, capture fraction and expected volume."""
    area = F.col("area_ha") * 10_000.0
    out = zones.withColumn("storage_volume_m3", sizing.storage_m3(area, F.col("mean_depth_m")))
    out = out.withColumn("capacity_m3", sizing.capacity_m3(area)).withColumn("runoff_m3", sizing.runoff_m3(F.col("catchment_area_m2"), rain_mm))
    cap, run = F.col("capacity_m3"), F.col("runoff_m3")
    return out.withColumn("fill_ratio", sizing.fill_ratio(cap, run)).withColumn("capture_fraction", sizing.capture_fraction(cap, run)).withColumn("expected_volume_m3", sizing.expected_m3(cap, run))


def exclude_shapes(zones: DataFrame, least: float = sizing.LEAST_COMPACTNESS) -> DataFrame:
    """Excludes zones under the least compactness; an earlier reason stays."""
    low = F.col("compactness") < least
    was = F.coalesce(F.col("excluded"), F.lit(False))
    why = F.when(was, F.col("exclusion_reason")).when(low, F.format_string("compactness %.3f is under %.3f", "compactness", F.lit(least)))
    return zones.withColumn("exclusion_reason", why).withColumn("excluded", was | low)


def rank_by_water(zones: DataFrame, rain_mm: float, least: float = sizing.LEAST_COMPACTNESS, mode: str = "sufficiency") -> DataFrame:
    """Sizes, excludes and ranks zones: survivors by falling score, then candidate_id; excluded zones have no rank.

    Mode ``water`` scores by runoff, ``sufficiency`` by the volume that is both brought and held.
    """
    if mode not in ("water", "sufficiency"):
        raise ValueError(f"unknown mode {mode}")
    scored = exclude_shapes(size_zones(zones, rain_mm), least).withColumn("score", F.col("runoff_m3" if mode == "water" else "expected_volume_m3"))
    return numbered(scored, [F.asc("excluded"), F.desc("score"), F.asc("candidate_id")]).withColumn("rank", F.when(~F.col("excluded"), F.col("rank")))


def rank_by_shape(zones: DataFrame, least: float = sizing.LEAST_COMPACTNESS) -> DataFrame:
    """The older ranking: storage volume times compactness."""
    scored = exclude_shapes(zones.withColumn("storage_volume_m3", sizing.storage_m3(F.col("area_ha") * 10_000.0, F.col("mean_depth_m"))), least)
    scored = scored.withColumn("score", F.col("storage_volume_m3") * F.col("compactness"))
    return numbered(scored, [F.asc("excluded"), F.desc("score"), F.asc("candidate_id")]).withColumn("rank", F.when(~F.col("excluded"), F.col("rank")))


def top_sites(ranked: DataFrame, n: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def largest_excluded(ranked: DataFrame, n: int = 200) -> DataFrame:
    return ranked.where("excluded").orderBy(F.desc("area_ha"), "candidate_id").limit(n)


def run_counters(ranked: DataFrame, n: int) -> DataFrame:
    """Detected, excluded by shape and by water, eligible and returned zones, in one row."""
    shape = F.col("excluded") & F.coalesce(F.col("exclusion_reason").contains("compactness"), F.lit(False))
    return ranked.agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(shape).alias("excluded_by_shape"), F.count_if(F.col("excluded") & ~shape).alias("excluded_by_water"),
        F.count_if(~F.col("excluded")).alias("eligible"), F.count_if(F.coalesce(F.col("rank") <= n, F.lit(False))).alias("returned"),
    )


def screen_water(zones: DataFrame, limit: float = sizing.WATER_LIMIT) -> DataFrame:
    """Excludes zones whose share of mapped or of imaged water reaches the limit; reasons in that order."""
    osm, cover = F.coalesce(F.col("osm_water_fraction"), F.lit(0.0)), F.coalesce(F.col("worldcover_water_fraction"), F.lit(0.0))
    reason = F.concat_ws("; ", F.when(osm >= limit, F.format_string("mapped water covers %.0f%%", osm * 100)), F.when(cover >= limit, F.format_string("imaged water covers %.0f%%", cover * 100)))
    hit = (osm >= limit) | (cover >= limit)
    was = F.coalesce(F.col("excluded"), F.lit(False))
    return zones.withColumn("exclusion_reason", F.when(was, F.col("exclusion_reason")).when(hit, reason)).withColumn("excluded", was | hit)


def keep_inside(zones: DataFrame, inside: Column) -> DataFrame:
    """Keeps rows inside a boundary; if none is inside, the boundary is ignored."""
    marked = zones.withColumn("__inside", F.coalesce(inside, F.lit(False)))
    some = marked.agg(F.coalesce(F.max("__inside"), F.lit(False)).alias("__some"))  # one row
    return marked.crossJoin(F.broadcast(some)).where("__inside OR NOT __some").drop("__inside", "__some")


def yearly_rain(rain: DataFrame) -> DataFrame:
    """year, total_mm, days_with_data, days_total, complete (365 days with data at least)."""
    by = rain.groupBy(F.year("day").alias("year")).agg(F.sum("mm").alias("total_mm"), F.count("mm").alias("days_with_data"), F.count(F.lit(1)).alias("days_total"))
    return by.withColumn("complete", F.col("days_with_data") >= 365)


def annual_mean(rain: DataFrame) -> DataFrame:
    """annual_mean_mm, years_used: over complete years, or over all if none is."""
    years = yearly_rain(rain).where("days_with_data > 0")
    some = years.agg(F.coalesce(F.max("complete"), F.lit(False)).alias("some"))
    used = years.crossJoin(F.broadcast(some)).where("complete OR NOT some")
    return used.agg(F.avg("total_mm").alias("annual_mean_mm"), F.count(F.lit(1)).alias("years_used"))


def wettest_day(rain: DataFrame) -> DataFrame:
    """max_single_day_mm, max_single_day_date: the earliest day on a tie."""
    best = rain.where("mm IS NOT NULL").agg(F.max(F.struct("mm", (-F.unix_date("day")).alias("d"))).alias("b"))
    return best.select(F.col("b.mm").alias("max_single_day_mm"), F.date_from_unix_date(-F.col("b.d")).alias("max_single_day_date"))


def rain_coverage(rain: DataFrame) -> DataFrame:
    return rain.agg(F.count(F.lit(1)).alias("days_total"), F.count("mm").alias("days_with_data"))


def insert_absent(cache: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append to a cache: the first of each key that the cache does not have."""
    first = new.groupBy(key).agg(F.min(F.struct(*order, F.struct(*[F.col(c) for c in new.columns]).alias("row"))).alias("m")).select("m.row.*")
    return first.join(cache.select(key).distinct(), key, "left_anti")


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Overwrites only those partitions of a table that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def may_cache(worldcover: Column, swir: Column, rainfall: Column) -> Column:
    """A run may be cached only if all three sources answered."""
    return F.coalesce(worldcover & swir & rainfall, F.lit(False))


def contour_interval(levels: DataFrame) -> DataFrame:
    """contour_interval: the most frequent gap of adjacent distinct levels (6 places); the smallest on a tie.

    Levels are few (a map has tens), so one ordered window takes their distinct values.
    """
    gaps = levels.select(F.col("elevation").cast("double").alias("elevation")).where("elevation IS NOT NULL").distinct()
    gaps = gaps.withColumn("gap", F.round(F.lead("elevation").over(Window.orderBy("elevation")) - F.col("elevation"), 6)).where("gap IS NOT NULL")
    return gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("b")).select((-F.col("b.g")).alias("contour_interval"))


def best_elevation_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """source, hits: the column that resolves the most rows, the earliest on a tie."""
    counts = rows.agg(*[F.count(s).alias(s) for s in sources])
    listed = counts.select(F.explode(F.array(*[F.struct(F.col(s).alias("hits"), F.lit(-k).alias("o"), F.lit(s).alias("source")) for k, s in enumerate(sources)])).alias("e"))
    return listed.agg(F.max("e").alias("b")).select("b.source", "b.hits")


def bbox_range_join(left: DataFrame, right: DataFrame, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes that overlap, with the overlap's corners; only boxes meet that are equal in the columns ``by``.

    Boxes (id, x0, y0, x1, y1; ids lid and rid) are put into every grid cell they touch
    and meet there by an equi-join; a pair counts only in the cell that holds the lower
    corner of its overlap, so no distinct is needed.
    """

    def gridded(df: DataFrame, p: str) -> DataFrame:
        at = lambda v: F.floor(F.col(v) / cell)
        wide = df.select("*", F.explode(F.sequence(at(f"{p}x0"), at(f"{p}x1"))).alias("gx"))
        return wide.select("*", F.explode(F.sequence(at(f"{p}y0"), at(f"{p}y1"))).alias("gy"))

    pairs = gridded(left, "l").join(gridded(right, "r"), ["gx", "gy", *by])
    x0, y0, x1, y1 = F.greatest("lx0", "rx0"), F.greatest("ly0", "ry0"), F.least("lx1", "rx1"), F.least("ly1", "ry1")
    pairs = pairs.where((x0 <= x1) & (y0 <= y1) & (F.floor(x0 / cell) == F.col("gx")) & (F.floor(y0 / cell) == F.col("gy")))
    return pairs.select("lid", "rid", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def overlap_fraction(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """lid, fraction: summed overlaps over the left box's area, at most 1 (overlapping right boxes count twice before that); 0 without a hit."""
    pairs = bbox_range_join(left, right, cell)
    hit = pairs.groupBy("lid").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("hit"))
    area = (F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0"))
    return left.join(hit, "lid", "left").select("lid", F.when(area > 0, F.least(F.lit(1.0), F.coalesce("hit", F.lit(0.0)) / F.when(area > 0, area))).otherwise(0.0).alias("fraction"))


def feature_collection(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature per row, the other columns as properties."""
    properties = F.struct(*[F.col(c) for c in df.columns if c != geometry])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), properties.alias("properties"))).alias("feature"))


def site_export(sites: DataFrame, catchments: DataFrame) -> DataFrame:
    """A pond row for each site and a catchment row for each that was traced without error."""
    ponds = sites.select(F.lit("pond").alias("kind"), "rank", F.round("expected_volume_m3").alias("volume_m3"))
    traced = catchments.where("error IS NULL").join(sites.select("rank"), "rank")
    areas = traced.select(F.lit("catchment").alias("kind"), "rank", "area_ha", F.array_join("warnings", " | ").alias("warnings"))
    return ponds.unionByName(areas, allowMissingColumns=True)


def self_overlap(ponds: DataFrame, catchments: DataFrame) -> DataFrame:
    """id, percent: share of each pond's cells (id, grid_id, r, c) inside its own catchment."""
    hit = ponds.join(catchments.select("id", "grid_id", "r", "c").distinct().withColumn("w", F.lit(1)), ["id", "grid_id", "r", "c"], "left")
    return hit.groupBy("id").agg((100.0 * F.count("w") / F.count(F.lit(1))).alias("percent"))
