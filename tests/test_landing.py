"""Landing progress against the plan of the bars."""

import datetime
import shutil

from pyspark.sql import functions as F

from tessera.plans.catalog import QUERIES
from tessera.plans.views import bars
from tessera.sources import inventory, writers

SF = "/root/testdata/sf0.001"


def test_progress_counts_the_files_of_each_month(spark):
    rows = {r.country: r for r in QUERIES["q24_landing_progress"](spark, SF).collect()}
    b = bars(spark, SF, "sup").groupBy("country").agg(F.count_distinct(F.date_trunc("month", "date")).alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert {c: (r.planned_files, r.files, r.n_rows, r.done) for c, r in rows.items()} == {r.country: (r.m, r.m, r.n, True) for r in b}
    assert all(r.planned_files > 1 for r in rows.values())


def test_a_missing_month_is_not_done(spark, tmp_path):
    days = [(c, datetime.date(2020, m, 1)) for c in ("x", "y") for m in (1, 2, 3)]
    df = spark.createDataFrame(days, "country string, date date")
    path = str(tmp_path / "bars")
    writers.write_by_month(df, path)
    spark.range(1).select(F.lit("2020-01-02").cast("date").alias("date")).write.mode("append").parquet(f"{path}/country=x/month=2020-01")
    shutil.rmtree(f"{path}/country=x/month=2020-03")
    planned = df.select("country", F.date_format("date", "yyyy-MM").alias("month"), F.lit(1).alias("planned_files"))
    landed = spark.read.schema("country string, month string, date date").parquet(path)
    out = {r.country: (r.planned_files, r.files, r.n_rows, r.done) for r in inventory.landing_progress(landed, planned).collect()}
    assert out == {"x": (3, 3, 3, False), "y": (3, 3, 3, True)}
