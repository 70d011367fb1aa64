"""Queries R01-R06 and Q13."""

from pyspark.sql import functions as F

from tessera.operators import risk
from tessera.plans import views as v
from tessera.plans.catalog.universes import UNI, uni_sup
from tessera.plans.registry import query
from tessera.session import materialise

N, MIN_ASSETS, HALF_LIFE, UNIVERSE = 4, 3, 60, 100
_FR = f"(PARTITION BY country, asset ORDER BY session_id ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
WINDOWS_SQL = f"""
win AS (SELECT w.* FROM (SELECT *, count(ret) OVER {_FR} = {N} AND coalesce(session_id - lag(session_id, {N - 1})
  OVER (PARTITION BY country, asset ORDER BY session_id) = {N - 1}, FALSE) AS valid FROM panel) w
  JOIN uni u ON u.country = w.country AND u.asset = w.asset AND u.universe_month = date_trunc('month', w.date)
  WHERE market_cap_rank <= {UNIVERSE})"""
WIN = v.panel_sql("sup") + "," + v.CAPS_SUP_SQL + "," + UNI + "," + WINDOWS_SQL + f""",
xs AS (SELECT w.country, w.date, w.asset, p.session_id - w.session_id + {N - 1} AS t, p.ret AS r,
  p.ret - avg(p.ret) OVER (PARTITION BY w.country, w.date, w.asset) AS x
  FROM win w JOIN panel p ON p.country = w.country AND p.asset = w.asset
  AND p.session_id BETWEEN w.session_id - {N - 1} AND w.session_id WHERE w.valid),
cov AS (SELECT a.country, a.date, a.asset AS asset_i, b.asset AS asset_j, sum(a.x * b.x) AS m2,
  sum(a.x * a.x * b.x * b.x) AS m4 FROM xs a JOIN xs b ON a.country = b.country AND a.date = b.date AND a.t = b.t
  GROUP BY 1, 2, 3, 4),
lw0 AS (SELECT country, date, count_if(asset_i = asset_j) AS p, sum(CASE WHEN asset_i = asset_j THEN m2 END) / {N} AS tr,
  sum(m2 * m2) / {N * N} AS s2, sum(m4) AS m4 FROM cov GROUP BY 1, 2),
lw1 AS (SELECT *, tr / p AS mu, CASE WHEN p > 1 THEN (s2 - tr * tr / p) / p ELSE 0.0 END AS delta, (m4 / {N} - s2) / (p * {N}) AS b FROM lw0),
lw AS (SELECT *, CASE WHEN delta > 0 THEN least(b, delta) / delta ELSE 0 END AS rho FROM lw1),
shrunk AS (SELECT cov.country, cov.date, asset_i, asset_j,
  (1 - rho) * m2 / {N} + CASE WHEN asset_i = asset_j THEN rho * mu ELSE 0 END AS value
  FROM cov JOIN lw ON lw.country = cov.country AND lw.date = cov.date)"""


def window_rows(spark, sf, panel=None, pool=None):
    """Risk windows of the members; ``panel`` (with every row of a member) and ``pool`` are stage tables of a run that has them."""
    pool = materialise(uni_sup(spark, sf, UNIVERSE)) if pool is None else pool.where(F.col("market_cap_rank") <= UNIVERSE)
    u = pool.select("country", "universe_month", "asset")
    rows = v.panel(spark, sf, "sup") if panel is None else panel
    rows = rows.join(u.select("country", "asset").distinct(), ["country", "asset"], "left_semi")
    w = risk.windows(rows, N).withColumn("universe_month", F.trunc("date", "MM"))
    return materialise(w.join(u, ["country", "universe_month", "asset"], "left_semi").select(
        "country", "date", "session_id", "asset", "valid", "x", "spread_bps"))


@query("r01_risk_window", "country asset:i date:d valid:b", WIN, "SELECT * FROM win")
def r01(spark, sf):
    return window_rows(spark, sf)


@query("r02_sample_covariance", "country date:d asset_i:i asset_j:i value:f9", WIN,
       f"SELECT *, m2 / {N - 1} AS value FROM cov WHERE asset_i <= asset_j")
def r02(spark, sf):
    return risk.covariance(window_rows(spark, sf))


_WTS = [f"({k}, {w!r})" for k, w in enumerate(risk.ewma_weights(N, HALF_LIFE))]


@query("r03_ewma_covariance", "country date:d asset_i:i asset_j:i value:f9", WIN + f""",
wt AS (SELECT * FROM (VALUES {', '.join(_WTS)}) AS w(t, w)),
xe AS (SELECT country, date, asset, t, w, r - sum(r * w) OVER (PARTITION BY country, date, asset) AS x FROM xs JOIN wt USING (t))""",
       """SELECT a.country, a.date, a.asset AS asset_i, b.asset AS asset_j, sum(a.w * a.x * b.x) AS value
  FROM xe a JOIN xe b ON a.country = b.country AND a.date = b.date AND a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2, 3, 4""")
def r03(spark, sf):
    return risk.covariance(window_rows(spark, sf), risk.ewma_weights(N, HALF_LIFE))


@query("r04_shrinkage_constants", "country date:d p:i mu:f9 delta:f12 rho:f", WIN, "SELECT * FROM lw")
def r04(spark, sf):
    return risk.shrinkage(window_rows(spark, sf))


@query("r04_shrunk_covariance", "country date:d asset_i:i asset_j:i value:f9", WIN,
       "SELECT * FROM shrunk WHERE asset_i <= asset_j")
def r04_matrix(spark, sf):
    rows = window_rows(spark, sf)
    return risk.shrunk_covariance(rows, risk.shrinkage(rows))


@query("r05_fallback_covariance", "country date:d asset_i:i asset_j:i value:f9", WIN + """,
cnt AS (SELECT *, count_if(valid) OVER (PARTITION BY country, date) AS n_valid FROM win)""",
       f"""SELECT s.* FROM shrunk s JOIN (SELECT DISTINCT country, date FROM cnt WHERE n_valid >= {MIN_ASSETS}) USING (country, date)
  WHERE asset_i <= asset_j UNION ALL SELECT country, date, asset, asset, 1e-4 FROM cnt WHERE n_valid < {MIN_ASSETS} OR NOT valid""")
def r05(spark, sf):
    rows = window_rows(spark, sf)
    matrix = risk.shrunk_covariance(rows, risk.shrinkage(rows))
    return risk.with_fallback(rows, matrix, MIN_ASSETS)


@query("r06_objective_terms", "country date:d return_term:f risk_term:f9 cost_term:f9 objective:f", WIN + """,
ew AS (SELECT country, date, asset, 1.0 / count(*) OVER (PARTITION BY country, date) AS w FROM win WHERE valid),
pv AS (SELECT s.country, s.date, sum(a.w * b.w * s.value) AS variance FROM shrunk s
  JOIN ew a ON a.country = s.country AND a.date = s.date AND a.asset = s.asset_i
  JOIN ew b ON b.country = s.country AND b.date = s.date AND b.asset = s.asset_j GROUP BY 1, 2),
er AS (SELECT country, date, sum(w * r) AS r FROM ew JOIN (SELECT country, date, asset, r FROM xs WHERE t = 3)
  USING (country, date, asset) GROUP BY 1, 2),
tc AS (SELECT e.country, e.date, sum(w * spread_bps / 20000) AS c FROM ew e JOIN win USING (country, date, asset) GROUP BY 1, 2)""",
       """SELECT pv.country, pv.date, coalesce(r, 0) AS return_term, variance * 5 AS risk_term, coalesce(c, 0) AS cost_term,
  coalesce(r, 0) - variance * 5 - coalesce(c, 0) AS objective FROM pv LEFT JOIN er USING (country, date)
  LEFT JOIN tc USING (country, date)""")
def r06(spark, sf):
    rows = window_rows(spark, sf)
    keys = ["country", "date"]
    valid = rows.where("valid")
    n = valid.groupBy(*keys).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    w = valid.join(n, keys)
    var = risk.portfolio_variance(rows, w, risk.shrinkage(rows))
    er = w.groupBy(*keys).agg(F.sum(F.col("weight") * F.element_at("x", -1)).alias("expected_return"))
    tc = w.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("spread_bps") / 20000).alias("trade_cost"))
    return risk.objective(var, er, tc, 10.0)


@query("q13_risk_window_coverage", "country date:d universe_assets:i valid_assets:i fallback:b", WIN,
       f"""SELECT country, date, count(*) AS universe_assets, count_if(valid) AS valid_assets,
  count_if(valid) < {MIN_ASSETS} AS fallback FROM win GROUP BY 1, 2""")
def q13(spark, sf):
    return window_rows(spark, sf).groupBy("country", "date").agg(
        F.count(F.lit(1)).alias("universe_assets"), F.count_if("valid").alias("valid_assets"),
        (F.count_if("valid") < MIN_ASSETS).alias("fallback"))
