"""Helpers that the training-data operators share.

Nothing here depends on the rest of the library.  Lineage is cut with Parquet
tables in the folder that the cluster names in ``spark.checkpoint.dir``, which
executors and driver share, so a lost executor never loses intermediate rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words; ``bytes.split()`` uses the same six.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terrace-llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so that later uses neither recompute nor depend on an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, so that extra columns cannot clash."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as empty (DataFrame functions only)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def text_digest(docs: DataFrame) -> Column:
    """SHA-256 of a row's text as it is; null and the empty text differ."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), docs["text"].cast("string")), F.lit("")), 256))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the documents of each component one row, with all its columns.

    ``rows`` has doc_id, digest (:func:`text_digest`) and component of every document;
    equal texts share a component.  The row with the smallest doc_id stays, null loses;
    of rows that share it the smallest digest; of repeated rows one.  A row is found
    again by its text and doc_id together, so a null or shared doc_id costs no other row.
    """
    mark, digest, winner = fresh(docs, "mark"), fresh(docs, "digest"), fresh(docs, "winner")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("w"))
    stay = best.select(F.col("w.digest").alias(digest), F.col("w.doc_id").alias(winner))
    marked = docs.withColumn(mark, text_digest(docs))
    kept = marked.join(stay, (F.col(mark) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(winner)))
    # Only where a row is repeated does a second pass take one of its repeats.
    repeats = rows.groupBy("digest", "doc_id").count().where("count > 1")
    return (kept if repeats.isEmpty() else kept.dropDuplicates([mark])).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumn`` for costly expressions that are used often: the optimizer cannot copy them into their uses."""
    for name, expression in columns.items():
        df = df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(expression)).alias(name))
    return df
