"""Distributed ordering helpers equal the plain window, whatever the group sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, half of them tied on one value, plus small groups and nulls."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.5, 1.5, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(n), "w": rng.integers(0, 4, n)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v")))
    return pdf.assign(v=np.where(pdf.id % 17 != 0, pdf.v, np.nan)), df


@pytest.mark.parametrize("range_rows", [3, 40, 500_000])
def test_ordinal(skewed, range_rows):
    pdf, df = skewed
    got = rk.ordinal(df.where("v is not null"), ["g"], ["v", "id"], "r", "n", range_rows=range_rows).toPandas()
    want = pdf.dropna().sort_values(["g", "v", "id"])
    want["r"] = want.groupby("g").cumcount() + 1
    want["size"] = want.groupby("g").id.transform("count")
    both = got.merge(want, on="id")
    assert len(both) == len(want) and (both.r_x == both.r_y).all() and (both.n == both["size"]).all()


@pytest.mark.parametrize("range_rows", [3, 40, 500_000])
def test_average_rank(skewed, range_rows):
    pdf, df = skewed
    got = rk.average_rank(df, ["g"], "v", "r", range_rows=range_rows).toPandas()
    want = pdf.dropna().assign(r=lambda d: d.groupby("g").v.rank())
    both = got.merge(want, on="id")
    assert len(both) == len(got) == len(want) and np.allclose(both.r_x, both.r_y)


@pytest.mark.parametrize("range_rows", [3, 40, 500_000])
def test_quantiles(skewed, range_rows):
    pdf, df = skewed
    got = rk.exact_quantiles(df, ["g"], {"m": ("v", 0.5), "hi": ("v", 0.9), "wid": ("id", 0.25)},
                             range_rows=range_rows).toPandas()
    for _, row in got.iterrows():
        x = pdf[pdf.g == row.g]
        assert np.isclose(row.m, x.v.quantile(0.5)) and np.isclose(row.hi, x.v.quantile(0.9))
        assert np.isclose(row.wid, x.id.quantile(0.25))
    assert len(got) == 4


@pytest.mark.parametrize("range_rows", [3, 40, 500_000])
def test_weighted_global_quantile(skewed, range_rows):
    pdf, df = skewed
    got = rk.exact_quantiles(df, [], {"m": ("v", 0.3)}, weight="w", range_rows=range_rows).toPandas()
    x = pdf.dropna()
    assert np.isclose(got.m[0], np.quantile(np.repeat(x.v, x.w), 0.3))


@pytest.mark.parametrize("range_rows", [2, 25, 500_000])
def test_ranks_of_two_columns_in_one_plan(skewed, range_rows):
    """Positions, sizes and average ranks together; the second ranking takes its cut points from the rows themselves."""
    pdf, df = skewed
    rows = df.where("v is not null")
    got = rk.ordinal(rows, ["g"], ["v", "id"], "p", "n", rank="rv", range_rows=range_rows)
    got = rk.ordinal(got, ["g"], ["w", "id"], "q", rank="rw", source=rows, range_rows=range_rows).toPandas()
    want = pdf.dropna()
    want = want.assign(rv=want.groupby("g").v.rank(), rw=want.groupby("g").w.rank(), n=want.groupby("g").id.transform("count"))
    both = got.merge(want, on="id")
    assert len(both) == len(want) and (both.rv_x == both.rv_y).all() and (both.rw_x == both.rw_y).all() and (both.n_x == both.n_y).all()


def test_ntile_of(spark):
    n = spark.range(10, 40).withColumnRenamed("id", "n")
    got = n.select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i")).withColumn(
        "b", rk.ntile_of("i", "n", 10)).toPandas()
    for k, x in got.groupby("n"):
        want = [b + 1 for b, part in enumerate(np.array_split(np.arange(k), 10)) for _ in part]
        assert x.sort_values("i").b.tolist() == want


def test_many_large_groups(spark):
    """Thousands of groups over several ranges, one with more cut points than a search step."""
    small = spark.range(30_000).select((F.col("id") % 3000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    large = spark.range(30_000, 36_000).select(F.lit(-1).cast("bigint").alias("g"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("v"), "id")
    got = rk.ordinal(small.unionByName(large), ["g"], ["v", "id"], "r", range_rows=5).toPandas()
    want = got.sort_values(["g", "v", "id"])
    assert len(got) == 36_000 and (want.r == want.groupby("g").cumcount() + 1).all()


def test_null_keys_and_no_keys(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 7).alias("w"))
    for keys in (["g"], []):
        got = rk.prefix_sum(df, keys, [-F.col("id")], "w", "s", "all", range_rows=4).toPandas().sort_values("id", ascending=False)
        by = got.groupby(got.g.fillna(-1)) if keys else got.groupby(got.id * 0)
        assert (got.s == by.w.cumsum()).all() and (got["all"] == by.w.transform("sum")).all()


def test_one_lazy_plan(spark):
    """No job runs before the action, and rows are exchanged by (group, range) only."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    ranked = rk.average_rank(rk.ordinal(df, ["g"], ["v", "id"], "r", "n"), ["g"], "v", "a")
    made = rk.exact_quantiles(ranked, ["g"], {"m": ("v", 0.5)})
    assert not tracker.getJobIdsForGroup("lazy")
    assert made.count() == 3 and tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("", "")


def test_only_large_groups_are_cut(spark):
    """A table of many small groups has no cut points, whatever its size; a large group has its own only."""
    df = spark.range(4000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id") % 60).alias("g"), F.struct(F.col("id").alias("o0")).alias("_at"))
    cuts = rk._cut_points(df, ["g"], ["_k0"], 100).collect()
    assert [r["_k0"] for r in cuts] == [-1] and all(c["o0"] < 1000 for c in cuts[0]["_cuts"])
    assert not rk._cut_points(df.where("g >= 0"), ["g"], ["_k0"], 100).count()


def test_quantiles_of_large_groups(spark):
    """Only the ranges that hold a wanted position are kept, and a large group without a value keeps its row."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"),
                                    F.lit(None).cast("double").alias("none"))
    made = rk.exact_quantiles(df, ["g"], {"m": ("v", 0.5), "hi": ("v", 0.9), "no": ("none", 0.5)}, range_rows=100)
    want = df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("hi"))
    got = {r["g"]: r for r in made.collect()}
    for r in want.collect():
        assert abs(got[r["g"]]["m"] - r["m"]) < 1e-6 and abs(got[r["g"]]["hi"] - r["hi"]) < 1e-6 and got[r["g"]]["no"] is None
