"""Points in regions of many rings, found by an equi-join of cells instead of a test of every pair.

A region is a list of parts, a part a list of rings of (lon, lat): the outer one first, then its
holes.  A point is in a region if it is in the outer ring of some part and in no hole of that part;
rings are judged by even-odd ray casting to the east.

Every edge is put into the cells it may decide about: the latitude bands that it spans, from the
west end of its ring to its own east end.  A point lies in one cell, so that all edges it has to
see are there, and counting its crossings needs no shuffle after the join.

Defined cases: a point with a null or NaN coordinate is in no region; a null region, part or ring
and a ring under three points contain nothing here (``clip_to_drawn`` takes a null region as no
clip); an edge with a null or NaN coordinate is left out; rings may repeat their first point;
repeated points are judged once; repeated ids of regions join their parts; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import georef

#: More distinct points than this in one cell are spread over several tasks.
POINTS_PER_TASK = 100_000
#: The labels of a run without sites.
BREAKDOWN = {
    "detected": "Natural hollows checked",
    "excluded_by_water": "On or next to existing water",
    "excluded_by_shape": "Long and narrow (stream channels)",
    "outside": "Outside the shape you drew",
}


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def ring_edges(regions: DataFrame) -> DataFrame:
    """region_id, part, ring, west (of the ring), and the ends of each edge that is not level, of regions (region_id, parts)."""
    parts = regions.select("region_id", F.posexplode("parts").alias("part", "rings"))
    rings = parts.select("region_id", "part", F.posexplode("rings").alias("ring", "points")).where(F.size("points") >= 3)
    west = F.array_min(F.filter(F.transform("points", lambda p: p["lon"].cast("double")), _number))
    sides = rings.select("region_id", "part", "ring", west.alias("west"), F.explode(georef.edges(F.col("points"))).alias("e"))
    ends = [F.col(f"e.{p}.{k}").cast("double").alias(f"{p}_{k}") for p in ("a", "b") for k in ("lon", "lat")]
    flat = sides.select("region_id", "part", "ring", "west", *ends)
    whole = _number(F.col("a_lon")) & _number(F.col("a_lat")) & _number(F.col("b_lon")) & _number(F.col("b_lat"))
    return flat.where(whole & (F.col("a_lat") != F.col("b_lat")))


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float, own: bool = False, per_task: int = POINTS_PER_TASK) -> DataFrame:
    """region_id, lon, lat of each distinct point (lon, lat) and each region that contains it.

    ``cell`` is the side of a cell in degrees; an edge is repeated once a cell, so it should not be
    much smaller than a usual region.  With ``own`` points have a region_id and meet that one only.
    Cells with more than ``per_task`` points are split, their edges repeated for each share.
    """
    at = lambda c: F.floor(c / cell)
    names, where = (["region_id"] if own else []), (["region_id"] if own else []) + ["cx", "cy"]
    lon, lat = F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")
    spots = points.select(*names, lon, lat).where(_number(F.col("lon")) & _number(F.col("lat"))).distinct()
    spots = spots.select("*", at(F.col("lon")).alias("cx"), at(F.col("lat")).alias("cy"))
    shares = spots.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("shares")).where("shares > 1")
    spots = spots.join(shares, where, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("lon", "lat"), F.col("shares").cast("long")), F.lit(0)).cast("int")).drop("shares")

    low, high, east = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat"), F.greatest("a_lon", "b_lon")
    sides = ring_edges(regions).withColumn("cy", F.explode(F.sequence(at(low), at(high)))).withColumn("cx", F.explode(F.sequence(at(F.col("west")), at(east))))
    sides = sides.join(shares, where, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))).drop("shares")

    met = spots.join(sides, [*where, "share"])
    spans = (F.col("a_lat") > F.col("lat")) != (F.col("b_lat") > F.col("lat"))
    left = F.col("lon") < (F.col("b_lon") - F.col("a_lon")) * (F.col("lat") - F.col("a_lat")) / (F.col("b_lat") - F.col("a_lat")) + F.col("a_lon")
    keys = [*where, "share", "lon", "lat"] + ([] if own else ["region_id"])
    odd = met.where(spans & left).groupBy(*keys, "part", "ring").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    outer, hole = F.max((F.col("ring") == 0) & F.col("odd")), F.max((F.col("ring") > 0) & F.col("odd"))
    inside = odd.groupBy(*keys, "part").agg((outer & ~hole).alias("inside")).where("inside")
    return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("region_id", "lon", "lat")


def clip_to_drawn(items: DataFrame, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """The items (region_id, lon, lat, ...) with ``inside``: whether each is in the region drawn for its run.

    A run without a region or with a null one is not clipped; an item without a place (a null
    coordinate) is never clipped.  Of a repeated region_id any null region lifts the clip.
    """
    hits = points_in_regions(items, regions, cell, own=True).withColumn("__hit", F.lit(True))
    drawn = regions.groupBy("region_id").agg(F.min(F.col("parts").isNotNull()).alias("__drawn"))
    place = F.col("lon").isNull() | F.col("lat").isNull()
    plain = items.drop("inside").withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})
    joined = plain.join(hits, ["region_id", "lon", "lat"], "left").join(drawn, "region_id", "left")
    return joined.withColumn("inside", place | ~F.coalesce("__drawn", F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit", "__drawn")


def clip_counts(clipped: DataFrame) -> DataFrame:
    """region_id, kept, outside of clipped items."""
    return clipped.groupBy("region_id").agg(F.count_if("inside").alias("kept"), F.count_if(~F.col("inside")).alias("outside"))


def why_no_sites(counters: DataFrame) -> DataFrame:
    """The lines shown for runs without a site: the columns of ``counters`` (run_counters, and optionally outside) and ``breakdown``.

    A count that is null reads as 0; the last line is there only if the drawn shape left sites out.
    """
    line = lambda c: F.concat(F.lit(f"{BREAKDOWN[c]}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    lines = [F.when(F.col(c) > 0, line(c)) if c == "outside" else line(c) for c in BREAKDOWN if c in counters.columns]
    return counters.withColumn("breakdown", F.array_compact(F.array(*lines)))
