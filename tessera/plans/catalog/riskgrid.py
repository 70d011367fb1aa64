"""Queries R02-R05 and P17 over a grid of windows and kinds, from one store of pair moments (weekly brand bars)."""

from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, compounded
from tessera.operators import calendar as cal
from tessera.operators import moments, portfolio, robustness
from tessera.operators.risk import FALLBACK_VARIANCE
from tessera.plans import views as v
from tessera.plans.catalog.featureset import full
from tessera.plans.catalog.portfolios import CAPPED_PATH, LEDGER_SQL, capped_sql
from tessera.plans.registry import query
from tessera.session import materialise

WINDOWS, HALF_LIFE, MIN_ASSETS = [20, 60, 120, 252], 60, 20
GRID_SQL = v.panel_sql("brand") + f""",
sg AS (SELECT country, max(session_id) AS session_id, max(date) AS date FROM calendar GROUP BY country, date_trunc('month', date)),
ua AS (SELECT sg.*, n, p.asset FROM sg JOIN panel p USING (country, session_id) CROSS JOIN (VALUES {', '.join(f'({n})' for n in WINDOWS)}) AS wn(n)),
x0 AS (SELECT u.country, u.date, u.n, u.asset, u.session_id - p.session_id AS age, p.ret AS r, pow(0.5, (u.session_id - p.session_id) / {HALF_LIFE}.0) AS w
  FROM ua u JOIN panel p ON p.country = u.country AND p.asset = u.asset AND p.session_id > u.session_id - u.n
  AND p.session_id <= u.session_id WHERE p.ret IS NOT NULL),
xs AS (SELECT *, r - avg(r) OVER g AS x, r - sum(w * r) OVER g / sum(w) OVER g AS xe, w / sum(w) OVER g AS share
  FROM x0 WINDOW g AS (PARTITION BY country, date, n, asset) QUALIFY count(*) OVER g = n),
va AS (SELECT DISTINCT country, date, n, asset FROM xs),
cv AS (SELECT a.country, a.date, a.n, a.asset AS asset_i, b.asset AS asset_j, sum(a.x * b.x) AS m2, sum(a.x * a.x * b.x * b.x) AS m4,
  sum(a.share * a.xe * b.xe) AS ewma FROM xs a JOIN xs b ON a.country = b.country AND a.date = b.date AND a.n = b.n AND a.age = b.age
  AND a.asset <= b.asset GROUP BY 1, 2, 3, 4, 5),
l0 AS (SELECT country, date, n, count_if(asset_i = asset_j) AS p, sum(CASE WHEN asset_i = asset_j THEN m2 END) / n / count_if(asset_i = asset_j) AS mu,
  sum(m2 * m2 * CASE WHEN asset_i = asset_j THEN 1 ELSE 2 END) / (n * n) AS s2, sum(m4 * CASE WHEN asset_i = asset_j THEN 1 ELSE 2 END) AS m4 FROM cv GROUP BY 1, 2, 3),
l1 AS (SELECT *, CASE WHEN p > 1 THEN (s2 - p * mu * mu) / p ELSE 0 END AS delta, (m4 / n - s2) / (p * n) AS b FROM l0),
lg AS (SELECT country, date, n, p, mu, delta, CASE WHEN delta > 0 THEN least(b, delta) / delta ELSE 0 END AS rho FROM l1)"""
_KINDS = {"sample": "m2 / (n - 1)", "ewma": "ewma", "shrunk": "(1 - rho) * m2 / n + CASE WHEN asset_i = asset_j THEN rho * mu ELSE 0 END"}
MATRIX_SQL = GRID_SQL + f""",
mx AS ({' UNION ALL '.join(f"SELECT country, date, n, '{k}' AS kind, asset_i, asset_j, {e} AS value FROM cv JOIN lg USING (country, date, n) WHERE p >= {MIN_ASSETS}" for k, e in _KINDS.items())}
  UNION ALL SELECT u.country, u.date, u.n, kind, u.asset, u.asset, {FALLBACK_VARIANCE} FROM ua u LEFT JOIN lg USING (country, date, n)
  LEFT JOIN va ON va.country = u.country AND va.date = u.date AND va.n = u.n AND va.asset = u.asset
  CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in _KINDS)}) AS kd(kind) WHERE coalesce(p, 0) < {MIN_ASSETS} OR va.asset IS NULL)"""


class Store:
    """Stage tables of the pair moments of all month ends and windows."""

    def __init__(self, spark, sf):
        self.panel = materialise(v.panel(spark, sf, "brand").select("country", "asset", "date", "session_id", "close", "ret"))
        self.calendar = materialise(v.calendar(spark, sf, "brand"))
        self.signals = cal.month_end_sessions(self.calendar).select("country", "date").join(self.calendar, ["country", "date"])
        self.assets = materialise(moments.asset_windows(self.panel, self.signals, WINDOWS, HALF_LIFE))
        store = moments.pair_sums(self.panel, self.signals, WINDOWS, HALF_LIFE)
        self.pairs = materialise(moments.pair_windows(store, self.assets, self.signals, WINDOWS, HALF_LIFE))
        self.constants = moments.constants(self.pairs)

    def matrices(self):
        return moments.matrices(self.pairs, materialise(self.constants), self.assets, MIN_ASSETS)


@query("r04_shrinkage_grid", "country date:d n:i p:i mu:f9 delta:f12 rho:f", GRID_SQL, "SELECT * FROM lg")
def r04_grid(spark, sf):
    return Store(spark, sf).constants.withColumnRenamed("window", "n")


@query("r05_covariance_grid", "country date:d n:i kind asset_i asset_j value:g", MATRIX_SQL, "SELECT * FROM mx")
def r05_grid(spark, sf):
    """Sample, exponentially weighted and shrunk matrices of four windows, with the fallback, from one store."""
    return Store(spark, sf).matrices().withColumnRenamed("window", "n")


@query("q13_coverage_grid", "country date:d n:i universe_assets:i valid_assets:i fallback:b", GRID_SQL,
       f"""SELECT u.country, u.date, u.n, count(*) AS universe_assets, count(va.asset) AS valid_assets, count(va.asset) < {MIN_ASSETS} AS fallback
  FROM ua u LEFT JOIN va ON va.country = u.country AND va.date = u.date AND va.n = u.n AND va.asset = u.asset GROUP BY 1, 2, 3""")
def q13_grid(spark, sf):
    n = F.count_if("valid")
    return Store(spark, sf).assets.groupBy("country", "date", F.col("window").alias("n")).agg(
        F.count(F.lit(1)).alias("universe_assets"), n.alias("valid_assets"), (n < MIN_ASSETS).alias("fallback"))


# One dimension at a time; sizes fit a market of 25 names.
BASE = {"k": 10, "cost_bps": 10, "kind": "shrunk", "window": 60, "turnover_cap": 0.4, "max_weight": 0.2}
VARIANTS = portfolio.scenario_grid(BASE, {
    "k": [5, 10, 15], "cost_bps": [0, 5, 10, 20, 30, 50], "kind": ["sample", "ewma", "shrunk"], "window": WINDOWS,
    "turnover_cap": [0.2, 0.4, 0.8], "max_weight": [0.1, 0.2, 0.4]})
_VALUES = ", ".join(f"('{g['variant']}', {g['k']}, {g['cost_bps']}, '{g['kind']}', {g['window']}, {g['turnover_cap']}, {g['max_weight']})" for g in VARIANTS)
_CAPPED = capped_sql("cp", "pk", "mom").replace("BY country, date", "BY variant, country, date").replace("0.05::DOUBLE", "max_weight::DOUBLE")
_FOLD = CAPPED_PATH[CAPPED_PATH.index("cu AS ("):].replace("FROM reb r", "FROM rb r").replace("JOIN reb USING", "JOIN rb USING")
_FROM, _TO = _FOLD.index("CROSS JOIN (VALUES"), _FOLD.index("AS sc(scenario, cap)")
_FOLD = _FOLD[:_FROM] + "JOIN (SELECT variant AS strategy, 'grid' AS scenario, turnover_cap AS cap FROM grid) sc USING (strategy)" + _FOLD[_TO + len("AS sc(scenario, cap)"):]
ROBUST_SQL = "RECURSIVE " + MATRIX_SQL + f""",
mo AS (SELECT *, {full('product(1 + ret)', 'ret', 3)} - 1 AS mom FROM panel),
sig AS (SELECT sg.country, sg.date, sg.session_id, asset, mom, x.session_id AS execution_session FROM sg JOIN mo
  ON mo.country = sg.country AND mo.session_id = sg.session_id JOIN calendar x ON x.country = sg.country AND x.session_id = sg.session_id + 1 WHERE mom IS NOT NULL),
grid(variant, names, cost_bps, kind, lookback, turnover_cap, max_weight) AS (VALUES {_VALUES}),
gs AS (SELECT g.*, s.*, va.asset IS NOT NULL AS valid, mx.value AS var FROM sig s CROSS JOIN grid g
  JOIN mx ON mx.country = s.country AND mx.date = s.date AND mx.n = lookback AND mx.kind = g.kind AND asset_i = s.asset AND asset_j = s.asset
  LEFT JOIN va ON va.country = s.country AND va.date = s.date AND va.n = lookback AND va.asset = s.asset),
pk AS (SELECT * FROM gs WHERE valid QUALIFY row_number() OVER (PARTITION BY variant, country, date ORDER BY mom DESC, asset) <= names),
{_CAPPED.strip()},
nm AS (SELECT gs.variant AS strategy, gs.country, gs.date AS signal_date, gs.execution_session, gs.asset, target_weight AS want, NOT gs.valid AS frozen
  FROM gs LEFT JOIN cp ON cp.variant = gs.variant AND cp.country = gs.country AND cp.date = gs.date AND cp.asset = gs.asset),
rb AS (SELECT *, lead(execution_session) OVER (PARTITION BY strategy, country ORDER BY execution_session) AS next_session
  FROM (SELECT DISTINCT strategy, country, execution_session, signal_date FROM nm WHERE want IS NOT NULL OR frozen)),
{_FOLD},
w AS (SELECT u.strategy, u.country, signal_date, u.execution_session, u.x.a AS asset, u.x.n AS target_weight, cost_bps / 10000.0 AS rate
  FROM (SELECT strategy, country, execution_session, unnest(rows) AS x FROM pr) u JOIN rb ON rb.strategy = u.strategy AND rb.country = u.country
  AND rb.execution_session = u.execution_session JOIN grid ON variant = u.strategy WHERE u.x.n > 0),
""" + LEDGER_SQL[LEDGER_SQL.index("reb AS ("):]


@query("p17_robustness_grid", "variant country sessions:i mean_net:f9 deviation:f executions:i mean_turnover:f total_cost:f9", ROBUST_SQL,
       """SELECT a.strategy AS variant, a.country, sessions, mean_net, deviation, executions, mean_turnover, total_cost FROM (
  SELECT strategy, country, count(*) AS sessions, avg(net_return) AS mean_net, stddev_samp(net_return) AS deviation FROM pnl GROUP BY 1, 2) a
  JOIN (SELECT strategy, country, count(*) AS executions, avg(turnover) AS mean_turnover, sum(cost) AS total_cost FROM tr GROUP BY 1, 2) b
  ON a.strategy = b.strategy AND a.country = b.country""")
def p17_grid(spark, sf):
    """Names, cost, covariance kind and window, turnover cap and largest weight, one at a time, through path and ledger."""
    store = Store(spark, sf)
    variances = store.matrices().where("asset_i = asset_j").select("country", "date", "window", "kind", F.col("asset_i").alias("asset"), F.col("value").alias("variance"))
    p = store.panel.withColumn("mom", compounded("ret", 3, by_asset()))
    s = p.join(F.broadcast(store.signals.select("country", "date")), ["country", "date"], "left_semi").where("mom IS NOT NULL")
    following = store.calendar.select("country", (F.col("session_id") - 1).alias("session_id"), F.col("session_id").alias("execution_session"))
    s = s.join(F.broadcast(following), ["country", "session_id"]).select("country", "date", "asset", "execution_session", "mom")
    names = materialise(robustness.targets(s, store.assets, variances, robustness.table(spark, VARIANTS), "mom"))
    weights = materialise(robustness.path(names, store.panel))
    pnl, trades = robustness.run(weights, store.panel, store.calendar)
    return robustness.summary(pnl, trades)
