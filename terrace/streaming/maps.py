"""An extension: contour documents that arrive as files, parsed by the batch functions in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrace.sources.feeds import contour_lines, placemarks


def watch_maps(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the contour lines of new files in ``folder`` to the Parquet table ``out``."""

    def write(batch: DataFrame, _: int) -> None:
        contour_lines(placemarks(batch)).write.mode("append").parquet(out)

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
