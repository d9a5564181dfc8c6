"""Written tables that cut lineage, and total orders numbered without one task seeing all rows.

Defined cases: an empty table is written and read back with its columns; rows that tie in an
order are numbered one after the other in no certain order.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/terrace/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in a total order, from 1, without gathering the rows in one task.

    Range-sorted partitions are numbered each by itself; the counts of the partitions
    before (one row each) are added.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(before, F.lit(0)))
    local = parts.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__k") + F.col("__start")).cast("int")).drop("__part", "__n", "__start", "__k")
