"""Recorded answers of network sources: the tile cache, uploads, place search and time windows.

Defined cases: an absent tile is remembered as absent and not asked for again; a
malformed cache payload reads as absent; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_UPLOAD = 64 * 1024 * 1024
ARCHIVE_LAG_DAYS = 10


def tile_key(zoom: Column, x: Column, y: Column) -> Column:
    return F.concat_ws(":", F.lit("terrain"), zoom.cast("string"), x.cast("string"), y.cast("string"))


def encode_image(content: Column) -> Column:
    """Cache payload of an image: JSON with its base64 text, null for an absent one."""
    return F.to_json(F.struct(F.base64(content).alias("png_b64")), {"ignoreNullFields": "false"})


def decode_image(data: Column) -> Column:
    return F.unbase64(F.from_json(data, "png_b64 string")["png_b64"])


def read_through(wanted: DataFrame, cache: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles (cache_key, content) of the wanted keys, and the rows (cache_key, kind, data) to append to the cache.

    Cached keys, absent ones included, are not looked up in ``store`` (cache_key, content);
    what the store lacks is absent.
    """
    keys = wanted.select("cache_key").distinct()
    known = keys.join(cache.select("cache_key", decode_image(F.col("data")).alias("content")), "cache_key")
    asked = keys.join(cache.select("cache_key"), "cache_key", "left_anti").join(store.select("cache_key", "content"), "cache_key", "left")
    new = asked.select("cache_key", F.lit("elevation_tile").alias("kind"), encode_image(F.col("content")).alias("data"))
    return known.unionByName(asked), new


def upload_status(content: Column, most: int = MOST_UPLOAD) -> Column:
    """200, or 400 for an empty upload and 413 for one that is too large."""
    size = F.coalesce(F.length(content), F.lit(0))
    return F.when(size == 0, 400).when(size > most, 413).otherwise(200)


def chosen_upload(contour_map: Column, file: Column) -> Column:
    return F.coalesce(contour_map, file)


def places(payloads: DataFrame) -> DataFrame:
    """id, name, detail, south, west, north, east of place-search answers (JSON text in ``value``), six an answer at most, in their order."""
    kind = "array<struct<place_id:bigint,name:string,display_name:string,type:string,boundingbox:array<string>,address:struct<county:string,state_district:string,state:string>>>"
    found = payloads.select(F.posexplode(F.slice(F.from_json("value", kind), 1, 6)).alias("n", "p"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.coalesce(filled("p.name"), F.get(F.split("p.display_name", ","), F.lit(0)))
    side = lambda k: F.get("p.boundingbox", F.lit(k)).try_cast("double")
    parts = F.array(F.coalesce(filled("p.address.county"), filled("p.address.state_district")), filled("p.address.state"))
    detail = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != name)), ", ")
    return found.select(
        F.col("p.place_id").alias("id"), name.alias("name"), F.when(detail != "", detail).otherwise(F.col("p.type")).alias("detail"),
        side(0).alias("south"), side(2).alias("west"), side(1).alias("north"), side(3).alias("east"),
    )


def rain_window(today: Column, years: Column) -> tuple[Column, Column]:
    """First and last day of the rainfall archive's window; 29 February falls back to the 28th."""
    last = F.date_sub(today, ARCHIVE_LAG_DAYS)
    return F.add_months(last, -12 * years), last


def rain_days(series: DataFrame) -> DataFrame:
    """The days of a rainfall series that have a value."""
    return series.where("mm IS NOT NULL")


def rain_available(series: DataFrame) -> DataFrame:
    return series.agg((F.count("mm") > 0).alias("available"))


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a whole table, as a full refresh does."""
    df.write.mode("overwrite").parquet(path)


def seed_counts(regions: DataFrame) -> DataFrame:
    """rows, states, districts of a seeded table."""
    pair = F.struct("state_name", "district_name")
    return regions.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("state_name").alias("states"), F.countDistinct(pair).alias("districts"))


def check_request(top_n: int = 5, years: int = 10, min_depth: float | None = None, interval: float | None = None, lat: float = 0.0, lon: float = 0.0) -> None:
    """Raises ValueError for a request out of range, before any job starts."""
    for name, good in (("top_n", 1 <= top_n <= 50), ("years", 1 <= years <= 40), ("min_depth", min_depth is None or min_depth > 0), ("interval", interval is None or interval > 0), ("lat", -90 <= lat <= 90), ("lon", -180 <= lon <= 180)):
        if not good:
            raise ValueError(f"{name} is out of range")

