"""Elevation grids from tiles, and layer images, for any number of boxes in one run.

Tiles lie in a folder ``root/zoom/x/y.png`` on any file system that Spark reads, or in a table
(zoom, x, y, content).  A box (area_id, min_lon, min_lat, max_lon, max_lat, zoom) takes the tiles
that it touches at its zoom, 15 at most; its grid hangs over the box up to whole tiles.

Defined cases: a box over 12 tiles on either axis has the status ``too large`` and no cells, one
with a null or an end before its start ``no box``; a missing tile counts as 0 m; a box with a tile
whose content is no 8-bit RGB image of 256 x 256 without interlacing has the status ``not an image``
and no cells; of several contents of one tile the least in byte order is taken; boxes that share an
area_id share its rows; a box without an area_id has a status and no cells; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import georef
from terrace.operators.tables import cut_lineage
from terrace.sources import feeds, records

TILE_KIND = "zoom int, x int, y int, content binary"
#: Signature and header of the images read: 256 x 256, 8 bits, RGB, not interlaced.
SIGNATURE, HEADER = "89504E470D0A1A0A", "00000100000001000802000000"
#: Bytes of an image up to the end of what is_image reads.
HEAD = 29
#: Most wanted tiles, at some 60 bytes, that are sent to every task; more are joined by a shuffle.
WANTED = 500_000
#: Characters of a wrong answer that its error row keeps.
ERROR_CHARS = 200


def box_tiles(boxes: DataFrame) -> DataFrame:
    """area_id, zoom (clamped), xmin, xmax, ymin, ymax, status (ok, too large, no box) of each box."""
    zoom = georef.clamped_zoom(F.col("zoom")).cast("int")
    side = lambda c: F.col(c).cast("double")
    ends = georef.tile_range(side("min_lon"), side("min_lat"), side("max_lon"), side("max_lat"), zoom)
    known = (side("min_lon") <= side("max_lon")) & (side("min_lat") <= side("max_lat")) & F.col("zoom").isNotNull()
    status = F.when(~F.coalesce(known, F.lit(False)), "no box").when(georef.exceeds_tile_budget(ends), "too large").otherwise("ok")
    return boxes.select("area_id", zoom.alias("zoom"), *[c.cast("int").alias(k) for k, c in ends.items()], status.alias("status"))


def wanted_tiles(placed: DataFrame) -> DataFrame:
    """area_id, zoom, x, y, and the tile's first row and col in its grid, of the good boxes: 144 tiles each at most."""
    good = placed.where("status = 'ok'")
    rows = good.withColumn("y", F.explode(F.sequence("ymin", "ymax"))).withColumn("x", F.explode(F.sequence("xmin", "xmax")))
    return rows.select("area_id", "zoom", "x", "y", ((F.col("y") - F.col("ymin")) * georef.TILE).alias("row"), ((F.col("x") - F.col("xmin")) * georef.TILE).alias("col"))


def tile_folder(spark: SparkSession, root: str, min_lon: float, min_lat: float, max_lon: float, max_lat: float, zoom: int) -> DataFrame:
    """zoom, x, y, content of the tiles of one box in a folder; no other file is listed or read.

    Raises ValueError for a box that is too large or none.
    """
    box = spark.range(1).select(F.lit(0).alias("area_id"), *[F.lit(v).alias(k) for k, v in (("min_lon", min_lon), ("min_lat", min_lat), ("max_lon", max_lon), ("max_lat", max_lat), ("zoom", zoom))])
    place = box_tiles(box).first()  # one row, made here
    if place["status"] != "ok":
        raise ValueError(f"the box is {place['status']} at zoom {place['zoom']}: {georef.MAX_TILES} tiles an axis at most")
    listed = lambda a, b: ",".join(str(v) for v in range(place[a], place[b] + 1))
    files = f"{root.rstrip('/')}/{place['zoom']}/{{{listed('xmin', 'xmax')}}}/{{{listed('ymin', 'ymax')}}}.png"
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], TILE_KIND)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    found = spark.read.format("binaryFile").load(files)
    return found.select(part(-3).cast("int").alias("zoom"), part(-2).cast("int").alias("x"), F.split_part(part(-1), F.lit("."), F.lit(1)).cast("int").alias("y"), "content")


def is_image(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, 17, 13))
    return (head[0] == SIGNATURE) & (head[1] == HEADER)


def _contents(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """area_id, row, col, content of the wanted tiles (area_id, zoom, x, y, row, col, and n, the contents of each), content null where there is none.

    Tiles of one content meet the wanted ones where they lie, so that images are neither sent to the driver nor shuffled.
    """
    keys, out = ["zoom", "x", "y"], ["area_id", "row", "col", "content"]
    once, many = wanted.where("n = 1"), wanted.where("n > 1")
    counts = wanted.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()
    images = tiles.where("content IS NOT NULL").select(*keys, "content")
    found = images.join(F.broadcast(once) if counts[0] <= WANTED else once.hint("merge"), keys).select(*out)
    if counts[1]:
        least = images.hint("merge").join(many.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("content").alias("content"))
        found = found.unionByName(many.join(least.hint("merge"), keys).select(*out))
    return found.unionByName(wanted.where("n = 0").select("area_id", "row", "col", F.lit(None).cast("binary").alias("content")))


def elevation_grids(boxes: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The boxes' status rows (area_id, status, zoom, xmin, ymin, rows, cols, missing) and the cells (area_id, row, col, z) of the good ones."""
    placed, keys = cut_lineage(box_tiles(boxes).distinct()), ["zoom", "x", "y"]
    # The head of the least content in byte order is the least head.
    heads = tiles.groupBy(*keys).agg(F.min(F.substring("content", 1, HEAD)).alias("head"), F.count("content").alias("n"))
    wrong = (F.coalesce("n", F.lit(0)) > 0) & ~is_image(F.col("head"))
    found = cut_lineage(wanted_tiles(placed).join(heads, keys, "left").select("area_id", *keys, "row", "col", F.coalesce("n", F.lit(0)).alias("n"), wrong.alias("wrong")))
    seen = found.groupBy("area_id", "zoom").agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if("wrong").alias("wrong"))
    bad = F.coalesce(F.col("wrong"), F.lit(0)) > 0
    joined = cut_lineage(placed.join(seen, ["area_id", "zoom"], "left").withColumn("status", F.when(bad, "not an image").otherwise(F.col("status"))))
    size = lambda a, b: F.when(F.col("status") == "ok", (F.col(b) - F.col(a) + 1) * georef.TILE)
    status = joined.select("area_id", "status", "zoom", "xmin", "ymin", size("ymin", "ymax").alias("rows"), size("xmin", "xmax").alias("cols"), F.when(F.col("status") == "ok", F.col("missing")).alias("missing"))

    kind = found.schema["area_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.arange(georef.TILE, dtype=np.int32)
        for frame in frames:
            for area, row, col, content in zip(frame["area_id"], frame["row"], frame["col"], frame["content"], strict=True):
                z = np.zeros((georef.TILE, georef.TILE))
                if content is not None:
                    rgb = feeds.decode_png(bytes(content)).astype(float)
                    z = rgb[..., 0] * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768
                yield pd.DataFrame({"area_id": area, "row": np.repeat(row + at, georef.TILE), "col": np.tile(col + at, georef.TILE), "z": z.ravel()})

    good = cut_lineage(found.join(joined.where("status = 'ok'").select("area_id", "zoom"), ["area_id", "zoom"], "left_semi"))
    cells = _contents(good, tiles).mapInPandas(run, f"area_id {kind}, row int, col int, z double")
    return status, cells


def layer_requests(boxes: DataFrame, kind: str, layer: str) -> DataFrame:
    """area_id, cache_key, request of one image a box; the request names its box by latitude first."""
    sides = [F.col(c).cast("double") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    width, height = georef.image_size(*sides)
    key = F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *[F.format_string("%.4f", c) for c in sides]), F.format_string(":%dx%d", width, height))
    box = F.concat_ws(",", *[sides[k].cast("string") for k in (1, 0, 3, 2)])
    text = F.concat(F.lit(f"service=WMS&request=GetMap&version=1.3.0&layers={layer}&styles=&format=image/png&crs=EPSG:4326&bbox="), box, F.format_string("&width=%d&height=%d", width, height))
    return boxes.select("area_id", key.alias("cache_key"), text.alias("request"))


def layer_scan(requests: DataFrame, cache: DataFrame, answers: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """area_id, content, available, error of each request, and the rows (cache_key, kind, data) to append to the cache.

    A cached image is taken first; a cache row without an image is asked again. An answer (cache_key,
    content_type, content) that is no image, or none at all, is an error row and is never cached. Of
    several answers of a key an image goes first, then the least in byte order. Boxes that round to one
    key get one image, as the key has four places.
    """
    stored = cache.where(F.col("kind") == kind).select("cache_key", records.decode_image(F.col("data")).alias("stored"))
    stored = stored.where(F.length("stored") > 0).groupBy("cache_key").agg(F.min("stored").alias("stored"))
    image = F.coalesce(F.contains("content_type", F.lit("image")), F.lit(False)) & F.col("content").isNotNull()
    given = answers.select("cache_key", image.alias("image"), "content").groupBy("cache_key").agg(F.min(F.struct((~F.col("image")).alias("wrong"), "content")).alias("a"))
    keys = requests.select("cache_key").distinct().join(stored, "cache_key", "left").join(given, "cache_key", "left")
    fresh = F.col("stored").isNull() & ~F.coalesce(F.col("a.wrong"), F.lit(True))
    content = F.coalesce(F.col("stored"), F.when(fresh, F.col("a.content")))
    text = F.concat(F.lit("non-image response: "), F.left(F.try_validate_utf8(F.col("a.content").cast("string")), F.lit(ERROR_CHARS)))
    error = F.when(content.isNotNull(), None).when(F.col("a").isNull(), "no answer").otherwise(F.coalesce(text, F.lit("non-image response")))
    solved = keys.select("cache_key", content.alias("content"), error.alias("error"), fresh.alias("fresh"))
    rows = requests.join(solved, "cache_key").select("area_id", "content", F.col("content").isNotNull().alias("available"), "error")
    return rows, solved.where("fresh").select("cache_key", F.lit(kind).alias("kind"), records.encode_image(F.col("content")).alias("data"))


def map_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """area_id, available, mirror, error of each area asked, and the elements (area_id, geometry, tags) of the answers taken.

    Answers (area_id, mirror, arrival, area_deg2, value) are JSON texts; the earliest usable one is
    taken, on a tie the first mirror by name. Unusable are null or malformed texts, and an answer
    without elements for a box that is not tiny. Without a usable answer the area has no elements and
    its error lists what each mirror said, in the order of arrival.
    """
    kind = "struct<elements:array<struct<geometry:array<struct<lon:double,lat:double>>,tags:map<string,string>>>>"
    read = answers.withColumn("j", F.from_json("value", kind, {"mode": "PERMISSIVE"}))
    well = F.col("value").isNotNull() & F.get_json_object("value", "$").isNotNull() & F.col("j").isNotNull()
    elements = F.coalesce("j.elements", F.array().cast("array<struct<geometry:array<struct<lon:double,lat:double>>,tags:map<string,string>>>"))
    empty = feeds.looks_empty(F.size(elements), F.col("area_deg2"))
    why = F.when(~well, F.concat(F.col("mirror"), F.lit(": no readable answer"))).when(empty, F.concat(F.col("mirror"), F.lit(": no element over a box that is not tiny")))
    judged = read.select("area_id", "mirror", "arrival", elements.alias("elements"), why.alias("why"))
    order = F.struct("arrival", "mirror")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("arrival", "mirror", "why")))), lambda s: s["why"]), "; ")
    taken = judged.groupBy("area_id").agg(F.min(F.when(F.col("why").isNull(), order)).alias("o"), said.alias("said"))
    available = F.col("o").isNotNull()
    status = taken.select("area_id", available.alias("available"), "o.mirror", F.when(~available, F.col("said")).alias("error"))
    chosen = taken.where(available).select("area_id", "o.arrival", "o.mirror")
    used = judged.where("why IS NULL").join(chosen, ["area_id", "arrival", "mirror"]).select("area_id", F.explode("elements").alias("e"))
    return status, used.select("area_id", "e.geometry", "e.tags")


def closed_buildings(features: DataFrame) -> DataFrame:
    """The buildings that are drawn: closed, four points at least."""
    return features.where("kind = 'building' AND closed")
