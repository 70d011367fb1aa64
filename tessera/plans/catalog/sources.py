"""Queries S01-S14 and Q24: sources, sinks and inventories."""

import uuid

from pyspark.sql import functions as F

from tessera import schema
from tessera.functions.expr import hash_index
from tessera.plans import views as v
from tessera.plans.catalog.ensembles import _h
from tessera.plans.registry import query
from tessera.session import ensure_checkpoint_dir, materialise
from tessera.sources import inventory, readers, writers


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


@query("s01_column_scan", "l_suppkey:i l_shipdate:d l_extendedprice:f2",
       sql="SELECT l_suppkey, l_shipdate, l_extendedprice FROM lineitem")
def s01(spark, sf):
    return readers.read_bars(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_extendedprice"])


@query("s02_filtered_scan", "l_orderkey:i l_suppkey:i l_quantity:f2",
       sql="SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey <= 100")
def s02(spark, sf):
    return readers.read_bars(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity"],
                             "l_returnflag = 'A' AND l_suppkey <= 100")


@query("s03_schema_tolerant", "country asset:i date:d close:f bid:f currency total_return_pct:f", v.bars_sql("sup"),
       """SELECT country, asset, date, close, bid, NULL AS currency, NULL AS total_return_pct FROM bars WHERE country < 'ASIA'
  UNION ALL SELECT country, asset, date, close, NULL, NULL, NULL FROM bars WHERE country >= 'ASIA'""")
def s03(spark, sf):
    b = materialise(v.bars(spark, sf, "sup"))
    one, two = _folder(spark), _folder(spark)
    b.where("country < 'ASIA'").write.parquet(one)
    b.where("country >= 'ASIA'").drop("bid", "ask").write.parquet(two)
    return readers.read_tolerant(spark, [one, two], schema.BARS, ("asset",))


@query("s04_csv_source", "o_orderkey:i o_totalprice:f2 o_orderpriority o_orderdate:d",
       sql="SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders")
def s04(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))
    path = _folder(spark) + ".csv"
    o.write.option("header", True).csv(path)
    return readers.read_table(spark, path, schema.struct("o_orderkey:long o_totalprice:double o_orderpriority:string o_orderdate:date"))


@query("s05_alias_resolution", "date:d asset:i prediction:f",
       sql="SELECT CAST(ts AS DATE) AS date, user_id AS asset, value AS prediction FROM events")
def s05(spark, sf):
    e = readers.resolve(v.table(spark, sf, "events"), {
        "date": ["signal_date", "ts", "date"], "asset": ["instrument", "user_id"], "prediction": ["score", "value"]})
    return e


@query("s06_provider_rename", "asset:i country_id:i balance:f2",
       sql="SELECT s_suppkey AS asset, s_nationkey AS country_id, s_acctbal AS balance FROM supplier")
def s06(spark, sf):
    return readers.canonical(v.table(spark, sf, "supplier"), {
        "s_suppkey": "asset", "s_nationkey": "country_id", "s_acctbal": "balance", "s_unknown": "unused"})


@query("s07_country_sink", "country n_rows:i volume:f2", v.bars_sql("sup"),
       "SELECT country, count(*) AS n_rows, sum(volume) AS volume FROM bars GROUP BY 1")
def s07(spark, sf):
    """Written by country, then read back with partition discovery."""
    path = _folder(spark)
    writers.write_by_country(v.bars(spark, sf, "sup"), path)
    return spark.read.parquet(path).groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume"))


@query("s08_twin_ledger_sink", "copy n_rows:i revenue:f2",
       sql="""SELECT copy, n_rows, revenue FROM (SELECT count(*) AS n_rows, sum(o_totalprice) AS revenue FROM orders)
  CROSS JOIN (VALUES ('parquet'), ('csv')) AS c(copy) UNION ALL SELECT 'empty', 0, NULL""")
def s08(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path, none = _folder(spark), _folder(spark)
    writers.write_ledger(o, path)
    writers.write_ledger(o.where("o_orderkey IS NULL"), none)
    kind = schema.struct("o_orderkey:long o_totalprice:double")
    parts = [("parquet", readers.read_table(spark, path + ".parquet", kind)), ("csv", readers.read_table(spark, path + ".csv", kind)),
             ("empty", readers.read_table(spark, none + ".parquet", kind))]
    out = None
    for name, d in parts:
        t = d.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("revenue")).withColumn("copy", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query("s09_file_manifest", "path bytes:i sha256")
def s09(spark, sf):
    return inventory.file_manifest(spark, sf, "*.parquet")


_MAN = f"""
ex AS (SELECT 'o' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes, sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders),
ac AS (SELECT 'o' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN {_h(7, "'b'", 'o_orderkey')} = 0 THEN 1 ELSE 0 END AS bytes,
  sha256(CAST(o_orderkey AS VARCHAR) || CASE WHEN {_h(5, "'s'", 'o_orderkey')} = 0 THEN 'x' ELSE '' END) AS sha
  FROM orders WHERE {_h(9, "'m'", 'o_orderkey')} <> 0)"""


@query("s10_manifest_check", "path status", _MAN,
       """SELECT ex.path, CASE WHEN ac.bytes IS NULL THEN 'missing' WHEN ac.bytes <> ex.bytes THEN 'bytes_mismatch'
  WHEN ac.sha <> ex.sha THEN 'sha256_mismatch' ELSE 'ok' END AS status FROM ex LEFT JOIN ac USING (path)""")
def s10(spark, sf):
    o = v.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    path, size = F.concat(F.lit("o"), key).alias("path"), F.floor("o_totalprice")
    tag = lambda n, t: hash_index(F.lit(n), t, F.col("o_orderkey"))
    expected = o.select(path, size.alias("bytes"), F.sha2(key, 256).alias("sha256"))
    actual = o.where(tag(9, "m") != 0).select(
        path, (size + F.when(tag(7, "b") == 0, 1).otherwise(0)).alias("bytes"),
        F.sha2(F.concat(key, F.when(tag(5, "s") == 0, F.lit("x")).otherwise("")), 256).alias("sha256"))
    return inventory.check_manifest(expected, actual)


@query("s11_json_reports", "event_type n_rows:i mean_k:f",
       sql="""SELECT event_type, count(*) AS n_rows, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean_k
  FROM events GROUP BY 1""")
def s11(spark, sf):
    e = readers.json_fields(v.table(spark, sf, "events").select("event_type", "props"), "props", {"k": "double"})
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("k").alias("mean_k"))


@query("s12_metric_rows", "event_type metric value:f", sql="""SELECT event_type, metric, value FROM (
  SELECT event_type, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean_value, max(value) AS max_value FROM events GROUP BY 1)
  UNPIVOT (value FOR metric IN (n, mean_value, max_value))""")
def s12(spark, sf):
    e = v.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return readers.to_metrics(e, ["event_type"], ["n", "mean_value", "max_value"])


@query("s13_pending_work", "asset:i date:d", v.panel_sql("sup") + """,
life AS (SELECT asset, country, min(session_id) AS a, max(session_id) AS b FROM panel GROUP BY 1, 2)""",
       """SELECT l.asset, c.date FROM life l JOIN calendar c ON c.country = l.country AND c.session_id BETWEEN a AND b
  WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.asset = l.asset AND p.date = c.date)""")
def s13(spark, sf):
    from tessera.operators import calendar as cal

    p = v.panel(spark, sf, "sup")
    return readers.pending(cal.densify(p, v.calendar(spark, sf, "sup"), []).select("country", "asset", "date"), p, ["country", "asset", "date"])


@query("s14_union_runs", "run scenario asset:i date:d close:f bid:f", v.bars_sql("sup"),
       """SELECT 'first' AS run, 'base' AS scenario, asset, date, close, bid FROM bars
  UNION ALL SELECT 'second', 'no_quotes', asset, date, close, NULL FROM bars""")
def s14(spark, sf):
    b = v.bars(spark, sf, "sup")
    return readers.union_runs([({"run": "first", "scenario": "base"}, b.select("asset", "date", "close", "bid")),
                               ({"run": "second", "scenario": "no_quotes"}, b.select("asset", "date", "close"))])


@query("q24_landing_progress", "country planned_files:i files:i n_rows:i done:b")
def q24(spark, sf):
    path = _folder(spark)
    b = v.bars(spark, sf, "sup")
    writers.write_by_month(b, path)
    expected = b.select("country", F.date_format("date", "yyyy-MM").alias("month")).distinct().withColumn("planned_files", F.lit(1))
    landed = spark.read.schema("country string, month string, asset bigint").parquet(path)
    return inventory.landing_progress(landed, expected)
