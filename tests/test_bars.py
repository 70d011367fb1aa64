"""Bars and the flagship on inputs that small tables lack: many ticks of one bar, prices of zero."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.plans import catalog, views
from tests.compare import connect, diff, oracle_rows, spark_rows


def test_bars_do_not_depend_on_the_order_of_ticks(spark):
    """Sums of many ticks of one bar agree to the last bit however the ticks are dealt."""
    ticks = spark.range(4000).select(
        F.lit(1).alias("asset"), F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").alias("k"), (F.col("id") / 7 + 1).alias("price"),
        (F.col("id") % 9 / 10 + 0.1).alias("qty"), (F.pmod(F.xxhash64("id"), F.lit(11)) / 100).alias("discount"), (F.col("id") % 9 / 100).alias("tax"))
    prints = {quality.fingerprint(views._bars(ticks.repartition(n, F.xxhash64("k", F.lit(n))))).first()["hash_sum"] for n in (1, 2, 3, 5, 7, 8)}
    assert len(prints) == 1


def test_sums_of_values_without_a_decimal(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (None,)], "x double")
    row = df.agg(views._exact_sum("x").alias("s"), views._exact_mean("x").alias("m")).first()
    assert row["s"] == row["m"] == float("inf")


def test_flagship_after_a_price_of_zero(spark, tmp_path):
    """The return after a zero price is unknown in the query and in its twin."""
    rows = []
    for user in range(14):
        for d in range(16):
            value = 0.0 if (user, d) == (3, 6) else 10.0 + (user * 7 + d * 5) % 13
            rows.append((len(rows), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=user), user, "view", value, "{}"))
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    pdf["ts"] = pdf.ts.astype("datetime64[us]")
    pdf.to_parquet(tmp_path / "events.parquet", index=False)
    name = "flagship_liquidity_momentum"
    got, want = spark_rows(catalog.QUERIES[name](spark, str(tmp_path))), oracle_rows(connect(str(tmp_path)), catalog.ORACLES[name])
    assert len(got[1]) == 10 and diff(got, want) is None
