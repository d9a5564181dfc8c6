"""The village table: one state's rows, with their box and centroid, by a pruned scan.

Defined cases: rows without a name, with a blank one or without a geometry are left out; a ring under
three points has a box and the mean of its points as centroid; a state without rows gives none; other
columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import georef

#: The columns of the published table, and what they are called here.
STATE, NAME = "stname", "vilname11"
COLUMNS = {"dtname": "district_name", "sdtname": "subdistrict_name", "block_name": "block_name", "gp_name": "panchayat_name", "vilname11": "village_name", "vil_lgd": "village_code"}


def store_villages(villages: DataFrame, path: str) -> None:
    """Writes a village table in folders by state, so that a scan opens one state's files."""
    villages.write.partitionBy(STATE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def village_scan(spark: SparkSession, path: str, state: str) -> DataFrame:
    """district_name to village_code, geometry (a ring of lon and lat), centroid_lat, centroid_lon and the box of the state's villages."""
    rows = spark.read.parquet(path).where((F.col(STATE) == state) & F.col(NAME).isNotNull() & (F.trim(NAME) != "") & F.col("geometry").isNotNull())
    centre, box = georef.polygon_centroid(F.col("geometry")), georef.ring_bbox(F.col("geometry"))
    kept = rows.select(*[F.col(c).alias(n) for c, n in COLUMNS.items()], "geometry", centre.alias("c"), box.alias("b"))
    return kept.select(*COLUMNS.values(), "geometry", F.col("c.lat").alias("centroid_lat"), F.col("c.lon").alias("centroid_lon"), "b.*")
