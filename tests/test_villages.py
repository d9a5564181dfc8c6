"""The pruned scan of one state's villages."""

from pyspark.sql import functions as F

from terrace.sources import villages

KIND = "stname string, dtname string, sdtname string, block_name string, gp_name string, vilname11 string, vil_lgd int, geometry array<struct<lon:double,lat:double>>, wide string"
SQUARE = [(80.0, 20.0), (80.2, 20.0), (80.2, 20.4), (80.0, 20.4)]


def rows_of(spark):
    row = lambda state, name, code, ring: (state, "d", "s", None, "g", name, code, ring, "x" * 99)
    rows = [row("A", "one", 1, SQUARE), row("A", "one", 1, SQUARE), row("A", " ", 2, SQUARE), row("A", None, 3, SQUARE), row("A", "four", 4, None), row("A", "five", 5, SQUARE[:2]), row("B", "six", 6, SQUARE), row(None, "seven", 7, SQUARE)]
    return spark.createDataFrame(rows, KIND)


def test_one_state_is_read_and_no_other_column(spark, tmp_path):
    path = str(tmp_path / "villages")
    villages.store_villages(rows_of(spark), path)
    found = villages.village_scan(spark, path, "A")
    got = sorted((r["village_code"], round(r["centroid_lon"], 6), round(r["centroid_lat"], 6), r["min_lon"], r["max_lat"]) for r in found.collect())
    assert got == [(1, 80.1, 20.2, 80.0, 20.4)] * 2 + [(5, 80.1, 20.0, 80.0, 20.0)]
    assert villages.village_scan(spark, path, "Z").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(stname" in scan and "IsNotNull(vilname11)" in scan and "IsNotNull(geometry)" in scan and "wide" not in scan


def test_an_unpartitioned_table_pushes_the_state(spark, tmp_path):
    path = str(tmp_path / "flat")
    rows_of(spark).withColumn("c", F.lit(1)).write.parquet(path)
    found = villages.village_scan(spark, path, "B")
    assert [r["village_code"] for r in found.collect()] == [6] and "EqualTo(stname,B)" in found._jdf.queryExecution().executedPlan().toString()
