"""Tile folders, elevation grids of many boxes, layer images, map answers, and the cache of committed results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import georef
from terrace.operators import relational
from terrace.operators.tables import cut_lineage
from terrace.sources import feeds, records, results, tiles

BOX = "area_id int, min_lon double, min_lat double, max_lon double, max_lat double, zoom int"


def image(n, size=256):
    pixels = np.random.default_rng(n).integers(0, 256, (size, size, 3))
    z = pixels[..., 0] * 256 + pixels[..., 1] + pixels[..., 2] / 256 - 32768
    return feeds.encode_png(pixels), z


def box_of(spark, xs, ys, zoom):
    """The box from within the first tile to within the last."""
    at = lambda f, v: spark.range(1).select(f(F.lit(float(v)), F.lit(zoom))).first()[0]
    return at(georef.tile_lon, xs[0] + 0.3), at(georef.tile_lat, ys[1] + 0.6), at(georef.tile_lon, xs[1] + 0.7), at(georef.tile_lat, ys[0] + 0.4)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, grids = tmp_path_factory.mktemp("tiles"), {}
    for x in range(8, 14):
        for y in range(2, 6):
            content, grids[x, y] = image(100 * x + y)
            (root / f"15/{x}").mkdir(parents=True, exist_ok=True)
            (root / f"15/{x}/{y}.png").write_bytes(content)
    (root / "15/9/3.png").unlink()
    (root / "15/13/5.png").write_bytes(b"<html>busy</html>")
    return str(root), grids


def test_only_the_tiles_of_a_box_are_read(spark, folder):
    root, grids = folder
    found = tiles.tile_folder(spark, root, *box_of(spark, (9, 10), (2, 3), 15), 17)
    assert sorted((r["zoom"], r["x"], r["y"]) for r in found.collect()) == [(15, 9, 2), (15, 10, 2), (15, 10, 3)]
    assert sorted(f.rsplit("/15/", 1)[1] for f in found.inputFiles()) == ["10/2.png", "10/3.png", "9/2.png"]
    cells = feeds.tile_cells(found).where("x = 10 AND y = 3").orderBy("pixel").toPandas()
    assert np.array_equal(cells["z"], grids[10, 3].ravel())
    assert tiles.tile_folder(spark, root, *box_of(spark, (900, 901), (2, 3), 15), 15).count() == 0
    for wrong in (box_of(spark, (0, 12), (2, 3), 15), (1.0, 1.0, 0.0, 2.0)):
        with pytest.raises(ValueError, match="tiles an axis"):
            tiles.tile_folder(spark, root, *wrong, 15)


def test_grids_of_many_boxes(spark, folder):
    root, grids = folder
    good, large, wrong = box_of(spark, (8, 10), (2, 4), 15), box_of(spark, (0, 12), (2, 2), 15), box_of(spark, (12, 13), (5, 5), 15)
    rows = [(1, *good, 16), (2, *good, 15), (3, *large, 15), (4, *wrong, 15), (5, None, 1.0, 2.0, 3.0, 15), (6, *good, None), (1, *good, 16)]
    part = lambda k: F.element_at(F.split("path", "/"), k)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    table = every.select(part(-3).cast("int").alias("zoom"), part(-2).cast("int").alias("x"), F.regexp_extract(part(-1), r"\d+", 0).cast("int").alias("y"), "content")
    boxes = spark.createDataFrame(rows, BOX).withColumn("content", F.lit("other"))
    status, cells = tiles.elevation_grids(boxes, table.unionAll(table).withColumn("row", F.lit("other")))
    got = {r["area_id"]: (r["status"], r["rows"], r["cols"], r["missing"]) for r in status.collect()}
    assert got == {1: ("ok", 768, 768, 1), 2: ("ok", 768, 768, 1), 3: ("too large", None, None, None), 4: ("not an image", None, None, None), 5: ("no box", None, None, None), 6: ("no box", None, None, None)}
    frame = cells.toPandas()
    assert set(frame["area_id"]) == {1, 2} and len(frame) == 2 * 768 * 768
    z = np.full((768, 768), np.nan)
    one = frame[frame["area_id"] == 1]
    z[one["row"], one["col"]] = one["z"]
    want = np.block([[np.zeros((256, 256)) if (x, y) == (9, 3) else grids[x, y] for x in (8, 9, 10)] for y in (2, 3, 4)])
    assert np.array_equal(z, want)
    for a, b in ((boxes.limit(0), table), (boxes, table.limit(0))):
        status, cells = tiles.elevation_grids(a, b)
        assert cells.where("z <> 0").count() == 0 and status.where("missing * 65536 <> rows * cols").count() == 0


def test_layer_answers_that_are_no_image_are_never_cached(spark):
    boxes = spark.createDataFrame([(k, 81.0 + k, 21.0, 81.1 + k, 21.05, 1) for k in range(7)], BOX)
    asked = tiles.layer_requests(boxes.unionAll(boxes.where("area_id = 1").withColumn("area_id", F.lit(9))), "cover", "MAP")
    keys = {r["area_id"]: r["cache_key"] for r in asked.collect()}
    assert keys[0] == "cover:81.0000:21.0000:81.1000:21.0500:1039x556" and keys[1] == keys[9]
    assert "&bbox=21.0,81.0,21.05,81.1&width=1039&height=556" in asked.where("area_id = 0").first()["request"]
    stored = spark.createDataFrame([(keys[0], "cover", "old"), (keys[2], "cover", None), (keys[3], "other", "old")], "cache_key string, kind string, t string")
    cache = stored.select("cache_key", "kind", records.encode_image(F.col("t").cast("binary")).alias("data"))
    told = [(1, "image/png", b"new"), (2, "image/png", b"again"), (3, "text/xml", b"busy" * 99), (3, "text/xml", b"z"), (4, None, b"x"), (5, "text/xml", b"late"), (5, "image/png", b"first"), (0, "image/png", b"unused")]
    answers = spark.createDataFrame([(keys[k], *rest) for k, *rest in told], "cache_key string, content_type string, content binary")
    rows, new = tiles.layer_scan(asked, cache, answers, "cover")
    got = {r["area_id"]: (None if r["content"] is None else bytes(r["content"]), r["available"]) for r in rows.collect()}
    assert got == {0: (b"old", True), 1: (b"new", True), 9: (b"new", True), 2: (b"again", True), 3: (None, False), 4: (None, False), 5: (b"first", True), 6: (None, False)}
    errors = {r["area_id"]: r["error"] for r in rows.collect()}
    assert errors[6] == "no answer" and errors[3] == "non-image response: " + ("busy" * 50) and errors[0] is None
    assert {r["cache_key"] for r in new.collect()} == {keys[1], keys[2], keys[5]}


def test_the_first_usable_answer_is_taken(spark):
    full = '{"elements":[{"geometry":[{"lon":0,"lat":0},{"lon":1,"lat":0},{"lon":1,"lat":1},{"lon":0,"lat":0}],"tags":{"building":"yes"}},{"geometry":[{"lon":0,"lat":0},{"lon":1,"lat":0}],"tags":{"building":"no"}}]}'
    rows = [(1, "b", 2, 1.0, full), (1, "a", 1, 1.0, '{"elements":[]}'), (1, "c", 2, 1.0, full), (2, "a", 1, 1.0, None), (2, "b", 0, 1.0, "busy"), (3, "a", 1, 1e-6, '{"elements":[]}'), (4, "a", 1, 1e-6, "{}")]
    status, elements = tiles.map_answers(spark.createDataFrame(rows, "area_id int, mirror string, arrival int, area_deg2 double, value string"))
    got = {r["area_id"]: (r["available"], r["mirror"], r["error"]) for r in status.collect()}
    assert got[1] == (True, "b", None) and got[3] == got[4] == (True, "a", None)
    assert got[2] == (False, None, "b: no readable answer; a: no readable answer")
    assert [r["area_id"] for r in elements.collect()] == [1, 1]
    drawn = tiles.closed_buildings(feeds.split_features(elements, "area_id")).collect()
    assert [(r["area_id"], len(r["coords"])) for r in drawn] == [(1, 4)]


RESULT = "cache_key string, kind string, data string, n int, good boolean"


def cached(spark, root):
    return {r["cache_key"]: r["data"] for r in results.cached_results(spark, root).collect()}


def test_the_first_writer_of_a_key_wins(spark, tmp_path):
    root, order = str(tmp_path / "cache"), [F.col("n")]
    run = lambda rows: spark.createDataFrame(rows, RESULT)
    assert cached(spark, root) == {}
    first = [("a", "k", "late", 2, True), ("a", "k", "early", 1, True), ("b", "k", "failed", 1, False), ("c", "k", None, 1, True), (None, "k", "x", 1, True), ("d", "k", "unknown", 1, None)]
    assert results.append_results(run(first), root, order, F.col("good")) == 1
    assert cached(spark, root) == {"a": "early"}
    assert results.append_results(run(first), root, order, F.col("good")) is None and len(results.published(spark, root)) == 1
    two = results.stage_results(run([("a", "k", "two", 1, True), ("e", "k", "two", 1, True), ("f", "k", "two", 1, True)]), root, order)
    three = results.stage_results(run([("e", "k", "three", 1, True), ("g", "k", "three", 1, True)]), root, order)
    assert cached(spark, root) == {"a": "early"}
    assert results.publish(spark, root, three) == 2 and results.publish(spark, root, two) == 3
    assert cached(spark, root) == {"a": "early", "e": "three", "f": "two", "g": "three"}


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    folders = [results.stage_results(spark.createDataFrame([("a", "k", str(n), 1, True), (str(n), "k", "own", 1, True)], RESULT), root, [F.col("n")]) for n in range(4)]
    monkeypatch.setattr(results, "published", lambda *_: {})  # all of them start from the same number
    numbers = [results.publish(spark, root, f) for f in folders]
    monkeypatch.undo()
    assert sorted(numbers) == [1, 2, 3, 4] and cached(spark, root) == {"a": "0", "0": "own", "1": "own", "2": "own", "3": "own"}


def test_keys_of_contours(spark):
    value = lambda s: spark.range(1).select(results.contour_key(*[F.lit(float(v)) for v in (1, 2, 3, 4)], F.lit(14), F.lit(2.0), s)).first()[0]
    assert value("bands") == "contours:1.00000:2.00000:3.00000:4.00000:14:2.0:bands-clip" and value("lines").endswith(":14:2.0:lines")
    with pytest.raises(ValueError, match="style"):
        value("dots")
    told = spark.createDataFrame([(True, True, True), (True, None, True), (False, True, True)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in told.select(relational.may_cache(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False]


def test_images_are_not_sent_to_the_driver(spark):
    image = lambda v: feeds.encode_png(np.full((256, 256, 3), v))
    low, high = sorted([image(1), image(2)])
    rows = [(15, 1, 1, high), (15, 1, 1, low), (15, 1, 1, None), (15, 2, 1, image(128)), (15, 3, 1, None), (15, 5, 1, b"busy"), (15, 5, 1, high), (15, 9, 9, high)]
    stored = cut_lineage(spark.createDataFrame(rows, tiles.TILE_KIND))
    side = lambda x: float(x) / 2**15 * 360 - 180
    lat = spark.range(1).select(georef.tile_lat(F.lit(1.5), F.lit(15)).alias("v")).first()["v"]
    boxes = spark.createDataFrame([(k, side(x0 + 0.5), lat, side(x1 + 0.5), lat, 15) for k, x0, x1 in ((1, 1, 3), (2, 4, 5), (3, 2, 2))], "area_id long, min_lon double, min_lat double, max_lon double, max_lat double, zoom int")
    status, cells = tiles.elevation_grids(boxes, stored)
    assert {r["area_id"]: (r["status"], r["missing"]) for r in status.collect()} == {1: ("ok", 1), 2: ("not an image", None), 3: ("ok", 0)}
    got = {(r["area_id"], r["col"] // 256): (r["n"], r["z"]) for r in cells.groupBy("area_id", "col").agg(F.count("z").alias("n"), F.max("z").alias("z")).collect()}
    value = int(feeds.decode_png(low)[0, 0, 0])
    z = lambda v: v * 257 + v / 256 - 32768
    assert got == {(1, 0): (256, z(value)), (1, 1): (256, z(128)), (1, 2): (256, 0.0), (3, 0): (256, z(128))}
    plan = cells._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = [part for part in plan.split("\n\n") if re.match(r"\s*\(\d+\) BroadcastExchange", part)]
    assert sent and not any("content" in part for part in sent)
