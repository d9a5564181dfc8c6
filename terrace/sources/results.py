"""A versioned cache of results that concurrent runs append to.

A run writes its rows into a folder of its own, where no reader looks, and then publishes that folder
by renaming a finished manifest to the next free number. Renaming never replaces a manifest, so one of
two runs that want the same number has to take the next one. Of a key in several manifests the lowest
number counts: the first writer wins, whatever was read before. Runs lost on the way leave rows that
nobody sees. (Renaming without replacing is one step on HDFS; on file systems where it is not, such as
some object stores, one publisher at a time is needed.)

Defined cases: rows without a key, of failed sources or without data are never staged; of the rows that
share a key the first in the given order is; nothing to append publishes nothing; an absent cache
reads as an empty one; extra columns of the results are left out.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import relational

ROW_KIND = "cache_key string, kind string, data string"
#: The suffixes of the keys of the two styles of contours.
CONTOUR_STYLES = {"bands": "bands-clip", "lines": "lines"}


def contour_key(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom: Column, interval: Column, style: str) -> Column:
    """Key of a contour result: a box of five places, zoom, interval and style; bands and lines never share one."""
    if style not in CONTOUR_STYLES:
        raise ValueError(f"style must be one of {', '.join(CONTOUR_STYLES)}")
    sides = [F.format_string("%.5f", c) for c in (min_lon, min_lat, max_lon, max_lat)]
    return F.concat_ws(":", F.lit("contours"), *sides, zoom.cast("string"), interval.cast("double").cast("string"), F.lit(CONTOUR_STYLES[style]))


def _manifests(spark: SparkSession, root: str):
    """The path of the manifests, its file system and its file context."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests")
    conf = spark._jsc.hadoopConfiguration()
    files = path.getFileSystem(conf)
    return path, files, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)


def published(spark: SparkSession, root: str) -> dict[int, str]:
    """Manifest numbers and the folders of rows that they name, in the order of numbers: a row a commit, no results."""
    path, files, _ = _manifests(spark, root)
    if not files.exists(path):
        return {}
    rows = spark.read.text(path.toString()).select(F.col("_metadata.file_name").cast("long").alias("n"), "value").where("n IS NOT NULL")
    return {r["n"]: r["value"] for r in rows.orderBy("n").collect()}


def cached_results(spark: SparkSession, root: str) -> DataFrame:
    """cache_key, kind, data of every published key, by its first writer."""
    known = published(spark, root)
    if not known:
        return spark.createDataFrame([], ROW_KIND)
    rows = spark.read.schema(ROW_KIND).parquet(*[f"{root.rstrip('/')}/rows/{folder}" for folder in known.values()])
    names = spark.createDataFrame([(f, n) for n, f in known.items()], "__folder string, __number long")
    marked = rows.withColumn("__folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(names), "__folder")
    return marked.groupBy("cache_key").agg(F.min_by(F.struct("kind", "data"), "__number").alias("r")).select("cache_key", "r.kind", "r.data")


def stage_results(results: DataFrame, root: str, order: list[Column], complete: Column | None = None) -> str | None:
    """Writes the rows (cache_key, kind, data) that the cache lacks into a folder of their own; its name, or None without any.

    Rows where ``complete`` (may_cache, for instance) is not true stay out.
    """
    spark = results.sparkSession
    good = results.where("cache_key IS NOT NULL AND data IS NOT NULL")
    good = good if complete is None else good.where(F.coalesce(complete, F.lit(False)))
    new = relational.insert_absent(cached_results(spark, root), good, "cache_key", order).select("cache_key", "kind", "data")
    folder = uuid.uuid4().hex
    new.write.parquet(f"{root.rstrip('/')}/rows/{folder}")
    return folder if spark.read.schema(ROW_KIND).parquet(f"{root.rstrip('/')}/rows/{folder}").limit(1).count() else None


def publish(spark: SparkSession, root: str, folder: str) -> int:
    """Publishes a staged folder under the next free number and gives that number."""
    path, files, context = _manifests(spark, root)
    make = spark._jvm.org.apache.hadoop.fs.Path
    ready = make(path, f".{folder}")
    out = files.create(ready, True)
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    never_replace = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    number = max(published(spark, root), default=0) + 1
    while True:
        try:
            context.rename(ready, make(path, f"{number:020d}"), never_replace)
            return number
        except Py4JJavaError as error:
            if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            number += 1


def append_results(results: DataFrame, root: str, order: list[Column], complete: Column | None = None) -> int | None:
    """Stages and publishes the rows that the cache lacks; the manifest's number, or None if there was nothing to append."""
    folder = stage_results(results, root, order, complete)
    return folder and publish(results.sparkSession, root, folder)
