"""Queries P01-P19 and A01-A15: weights, ledger and performance."""

from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, compounded, full_frame
from tessera.operators import analytics, calendar as cal, fold, labels, ledger, portfolio, risk, universe
from tessera.plans import views as v
from tessera.plans.catalog.featureset import forward_sql, full
from tessera.plans.catalog.risks import MIN_ASSETS, WINDOWS_SQL, window_rows
from tessera.plans.catalog.universes import UNI, uni_sup
from tessera.plans.registry import query
from tessera.session import materialise

POOL, K, CAP = 100, 5, 0.4
FR3 = "(PARTITION BY country, asset ORDER BY session_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
SIG = v.panel_sql("sup", rf=True) + "," + v.CAPS_SUP_SQL + "," + UNI + "," + forward_sql(1, 5) + f""",
monthly AS (SELECT country, max(date) AS date FROM calendar GROUP BY country, date_trunc('month', date)),
feat AS (SELECT *, {full('product(1 + ret)', 'ret', 3)} - 1 AS mom, {full('var_pop(ret)', 'ret', 3)} AS var FROM fwd),
sig AS (SELECT f.country, f.date, f.session_id, f.asset, mom, var, spread_bps, forward_excess, target, market_cap_rank,
  x.session_id AS execution_session, x.date AS execution_on FROM feat f
  JOIN monthly m ON m.country = f.country AND m.date = f.date
  JOIN uni u ON u.country = f.country AND u.asset = f.asset AND u.universe_month = date_trunc('month', f.date)
  LEFT JOIN calendar x ON x.country = f.country AND x.session_id = f.session_id + 1
  WHERE market_cap_rank <= {POOL} AND mom IS NOT NULL)"""


def staged_panel(spark, sf):
    """The panel columns a ledger run needs, written once."""
    p = v.panel(spark, sf, "sup", rf=True)
    return materialise(p.select("country", "asset", "date", "session_id", "ret", "rf_daily", "spread_bps"))


def staged_pool(spark, sf):
    """The first ``POOL`` ranks of each month: at most that many rows per country and month."""
    return materialise(uni_sup(spark, sf, POOL))


def pool_rows(panel, pool):
    """Every row of the assets that are in the pool of some month; whatever a book reads of one asset is among these."""
    return panel.join(pool.select("country", "asset").distinct(), ["country", "asset"], "left_semi")


def days(panel):
    """The session calendar of a staged panel, which has a row of every session."""
    return materialise(panel.select("country", "date", "session_id").distinct())


def signals(spark, sf, panel=None, pool=None, c=None):
    """Month-end cross-sections with score, variance, spread and forward return; a run passes the stage tables it has."""
    panel = staged_panel(spark, sf) if panel is None else panel
    pool = staged_pool(spark, sf) if pool is None else pool
    c = days(panel) if c is None else c
    ends = cal.month_end_sessions(c).select("country", "date")
    p = labels.forward_excess(pool_rows(panel, pool))
    w = by_asset()
    p = p.withColumn("mom", compounded("ret", 3, w)).withColumn("var", full_frame(F.var_pop, "ret", 3, w))
    p = p.join(F.broadcast(ends), ["country", "date"], "left_semi").where(F.col("mom").isNotNull())
    p = universe.point_in_time(p, pool).where(F.col("market_cap_rank") <= POOL)
    nxt = F.broadcast(c.select("country", (F.col("session_id") - 1).alias("session_id"),
                               F.col("session_id").alias("execution_session"), F.col("date").alias("execution_on")))
    return materialise(p.join(nxt, ["country", "session_id"], "left").select(
        "country", "date", "session_id", "asset", "mom", "var", "spread_bps", "forward_excess", "target",
        "market_cap_rank", "execution_session", "execution_on"))


EW = """
ew AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY country, date) AS target_weight FROM sig WHERE spread_bps IS NOT NULL)"""
TK = f"""
tk AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY country, date) AS target_weight FROM (SELECT *,
  row_number() OVER (PARTITION BY country, date ORDER BY mom DESC, asset) AS pick FROM sig) WHERE pick <= {K})"""
_CAPPED = """
{n}0 AS (SELECT *, coalesce(greatest({score}, 0) / nullif(var, 0), 0) AS s FROM {source}),
{n}1 AS (SELECT *, count(*) OVER g AS n, count_if(s > 0) OVER g AS p,
  row_number() OVER (PARTITION BY country, date ORDER BY s DESC, asset) AS k,
  sum(s) OVER (PARTITION BY country, date ORDER BY s DESC, asset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  greatest(0.05::DOUBLE, 1::DOUBLE / count(*) OVER g) AS c FROM {n}0 WINDOW g AS (PARTITION BY country, date)),
{n}2 AS (SELECT *, CASE WHEN rest > 0 AND (1 - (k - 1) * c) / rest * s <= c + 1e-15 THEN (1 - (k - 1) * c) / rest END AS l FROM {n}1),
{n}3 AS (SELECT *, min(CASE WHEN l IS NOT NULL THEN k END) OVER (PARTITION BY country, date) AS f FROM {n}2),
{n}4 AS (SELECT *, max(CASE WHEN k = f THEN l END) OVER (PARTITION BY country, date) AS lam FROM {n}3),
{n} AS (SELECT *, CASE WHEN p = 0 THEN 1.0 / n WHEN p * c < 1 THEN CASE WHEN s > 0 THEN c ELSE (1 - p * c) / (n - p) END
  ELSE least(c, lam * s) END AS target_weight FROM {n}4)"""


def capped_sql(n, source, score):
    return _CAPPED.format(n=n, source=source, score=score)


CP = capped_sql("cp", "sig", "mom")


@query("p01_equal_weight", "country date:d asset:i target_weight:f", SIG + "," + EW, "SELECT * FROM ew")
def p01(spark, sf):
    return portfolio.equal_weight(signals(spark, sf), F.col("spread_bps").isNotNull())


@query("p03_top_k_equal", "country date:d asset:i target_weight:f", SIG + "," + TK, "SELECT * FROM tk")
def p03(spark, sf):
    return portfolio.top_k_equal(signals(spark, sf), "mom", K)


@query("p04_name_turnover", "country date:d name_turnover:f", SIG + f""",
pk AS (SELECT country, date, asset FROM (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY mom DESC, asset) AS rn
  FROM sig WHERE target IS NOT NULL) WHERE rn <= {K}),
st AS (SELECT *, dense_rank() OVER (PARTITION BY country ORDER BY date) AS step FROM pk),
j AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.step, b.step + 1) AS step, a.asset AS x, b.asset AS y
  FROM st a FULL JOIN st b ON a.country = b.country AND a.asset = b.asset AND a.step = b.step + 1)""",
       f"""SELECT country, date, count_if(x IS NULL OR y IS NULL) / {float(K)} AS name_turnover
  FROM j JOIN (SELECT DISTINCT country, step, date FROM st) USING (country, step) GROUP BY 1, 2""")
def p04(spark, sf):
    s = signals(spark, sf).where(F.col("target").isNotNull())
    picks = universe.top_k(s, ["country", "date"], [F.desc("mom"), F.asc("asset")], K)
    return portfolio.name_turnover(picks, picks.select("country", "date").distinct(), K)


@query("p05_risk_scaled_capped", "country date:d asset:i target_weight:f", SIG + "," + CP, "SELECT * FROM cp")
def p05(spark, sf):
    return portfolio.risk_scaled(signals(spark, sf), "mom", "var")


RATES = """
med AS (SELECT s.country, s.session_id, quantile_cont(p.spread_bps, 0.5) AS q FROM (SELECT DISTINCT country, session_id FROM sig) s
  LEFT JOIN panel p ON p.country = s.country AND p.session_id < s.session_id GROUP BY 1, 2),
own AS (SELECT s.country, s.asset, s.session_id, arg_max(p.spread_bps, p.session_id) AS own_bps FROM sig s LEFT JOIN panel p
  ON p.country = s.country AND p.asset = s.asset AND p.session_id < s.session_id AND p.spread_bps IS NOT NULL GROUP BY 1, 2, 3),
rates AS (SELECT s.*, 0.001 AS c0, greatest(coalesce(q / 20000, 0.001), 0) AS c1,
  greatest(coalesce(own_bps / 20000, q / 20000, 0.001), 0) AS c2 FROM sig s JOIN med USING (country, session_id)
  JOIN own USING (country, asset, session_id))"""


def rates(panel, s):
    return portfolio.cost_rates(s, panel.select("country", "asset", "session_id", "spread_bps"))


@query("p06_cost_rates", "country date:d asset:i c0:f9 c1:f9 c2:f9", SIG + "," + RATES, "SELECT * FROM rates")
def p06(spark, sf):
    panel = staged_panel(spark, sf)
    return rates(panel, signals(spark, sf, panel))


BOOK_WEIGHTS = """,
bk AS (SELECT 'equal' AS strategy, country, asset, session_id, target_weight FROM ew UNION ALL
  SELECT 'topk', country, asset, session_id, target_weight FROM tk UNION ALL
  SELECT 'capped', country, asset, session_id, target_weight FROM cp)"""
LEDGER_SQL = """,
w AS (SELECT strategy, r.country, r.date AS signal_date, execution_session, r.asset, target_weight, c2 AS rate
  FROM bk JOIN rates r USING (country, asset, session_id) WHERE execution_session IS NOT NULL),
reb AS (SELECT *, lead(execution_session) OVER b AS next_session, row_number() OVER b = 1 AS initial
  FROM (SELECT DISTINCT strategy, country, execution_session, signal_date FROM w)
  WINDOW b AS (PARTITION BY strategy, country ORDER BY execution_session)),
held AS (SELECT h.*, target_weight * product(1 + coalesce(ret, 0)) OVER (PARTITION BY strategy, country, execution_session, asset
    ORDER BY session_id ROWS UNBOUNDED PRECEDING) AS value, ret IS NULL AS missing
  FROM (SELECT w.strategy, w.country, w.execution_session, r.next_session, w.asset, w.target_weight, w.rate, c.session_id, p.ret
    FROM w JOIN reb r ON r.strategy = w.strategy AND r.country = w.country AND r.execution_session = w.execution_session
    JOIN calendar c ON c.country = w.country AND c.session_id > w.execution_session
      AND c.session_id <= coalesce(r.next_session, c.session_id)
    LEFT JOIN panel p ON p.country = w.country AND p.asset = w.asset AND p.session_id = c.session_id
    WHERE w.target_weight > 0) h),
drift AS (SELECT strategy, country, next_session AS execution_session, asset, rate AS last_rate,
  value / sum(value) OVER (PARTITION BY strategy, country, next_session) AS pre_weight FROM held WHERE session_id = next_session),
led AS (SELECT strategy, country, execution_session, asset, coalesce(pre_weight, 0) AS pre_weight,
  coalesce(target_weight, 0) AS target_weight, coalesce(target_weight, 0) - coalesce(pre_weight, 0) AS weight_delta,
  abs(coalesce(target_weight, 0) - coalesce(pre_weight, 0)) AS absolute_trade, coalesce(rate, last_rate, 0.001) AS cost_rate,
  CASE WHEN w.target_weight IS NULL THEN 'forced_exit' WHEN pre_weight IS NULL AND w.target_weight > 0 THEN 'forced_entry'
    ELSE 'continuing_name' END AS trade_component
  FROM drift FULL JOIN w USING (strategy, country, execution_session, asset)),
tr AS (SELECT l.strategy, l.country, l.execution_session, any_value(signal_date) AS signal_date, any_value(initial) AS initial,
  sum(CASE WHEN trade_component = 'continuing_name' THEN absolute_trade ELSE 0 END) AS continuing_turnover,
  sum(CASE WHEN trade_component = 'forced_entry' THEN absolute_trade ELSE 0 END) AS entry_turnover,
  sum(CASE WHEN trade_component = 'forced_exit' THEN absolute_trade ELSE 0 END) AS exit_turnover,
  sum(absolute_trade) AS turnover, sum(absolute_trade * cost_rate) AS cost, count_if(target_weight > 0) AS positions
  FROM led l JOIN reb USING (strategy, country, execution_session) GROUP BY 1, 2, 3),
hv AS (SELECT strategy, country, execution_session, session_id, sum(value) AS v, count(*) AS n_held, count_if(missing) AS mv
  FROM held GROUP BY 1, 2, 3, 4),
hg AS (SELECT *, v / lag(v, 1, 1) OVER (PARTITION BY strategy, country, execution_session ORDER BY session_id) - 1 AS g FROM hv),
pnl AS (SELECT d.strategy, d.country, d.session_id, d.date, coalesce(g, 0) AS gross_return, coalesce(cost, 0) AS cost,
  coalesce(g, 0) - coalesce(cost, 0) AS net_return, coalesce(turnover, 0) AS turnover, coalesce(positions, n_held, 0) AS positions,
  coalesce(mv, 0) AS missing_valuations, coalesce(n_held > mv, d.session_id = s0) AS evaluated
  FROM (SELECT f.strategy, s0, c.* FROM (SELECT strategy, country, min(execution_session) AS s0 FROM tr GROUP BY 1, 2) f
    JOIN calendar c ON c.country = f.country AND c.session_id >= s0) d
  LEFT JOIN hg ON hg.strategy = d.strategy AND hg.country = d.country AND hg.session_id = d.session_id
  LEFT JOIN tr ON tr.strategy = d.strategy AND tr.country = d.country AND tr.execution_session = d.session_id)"""
BOOKS = ",".join([SIG, EW, TK, CP, RATES]) + BOOK_WEIGHTS + LEDGER_SQL


# In the twin a book's scenario is a suffix of its strategy, so every statement above applies as it is.
COSTED = BOOKS.replace("SELECT strategy, r.country, r.date AS signal_date, execution_session, r.asset, target_weight, c2 AS rate\n  FROM bk JOIN rates r",
                       """SELECT strategy || ':' || scenario AS strategy, r.country, r.date AS signal_date, execution_session, r.asset, target_weight, rate
  FROM bk JOIN (UNPIVOT (SELECT country, date, asset, session_id, execution_session, CAST(c0 AS DOUBLE) AS C0, c1 AS C1, c2 AS C2 FROM rates)
    ON C0, C1, C2 INTO NAME scenario VALUE rate) r""")
SPLIT = "split_part({0}, ':', 1) AS {1}"
SCENARIO = "split_part({0}, ':', 2)"


def _weights(s, r, costed=False, books=None):
    keep = ["country", "asset", "session_id", "execution_session", F.col("date").alias("signal_date")]
    rate = portfolio.long_scenarios(r, keep) if costed else r.select(*keep, F.col("c2").alias("rate"))
    keep = ["country", "asset", "session_id", "target_weight"]
    books = books(s) if books else [
        ("equal", portfolio.equal_weight(s, F.col("spread_bps").isNotNull())),
        ("topk", portfolio.top_k_equal(s, "mom", K)), ("capped", portfolio.risk_scaled(s, "mom", "var"))]
    out = None
    for name, b in books:
        b = b.select(F.lit(name).alias("strategy"), *keep)
        out = b if out is None else out.unionByName(b)
    return out.join(rate, ["country", "asset", "session_id"]).where(F.col("execution_session").isNotNull()).drop("session_id")


class Books:
    """Stage tables of one ledger run: costs of own quotes, or every cost scenario if ``costed``."""

    def __init__(self, spark, sf, costed=False, books=None):
        self.panel = staged_panel(spark, sf)
        self.pool = staged_pool(spark, sf)
        self.calendar = days(self.panel)
        self.members = materialise(pool_rows(self.panel, self.pool))
        self.signals = signals(spark, sf, self.members, self.pool, self.calendar)
        self.rates = materialise(rates(self.panel, self.signals))
        self.weights = materialise(_weights(self.signals, self.rates, costed, books))
        self.returns = self.members.select("country", "asset", "session_id", "ret")

    def held(self):
        return materialise(ledger.positions(self.weights, self.returns, self.calendar))

    def trades(self, held):
        led = ledger.weight_ledger(self.weights, ledger.drifted(held))
        return led, ledger.turnover(led, self.weights, CAP)

    def pnl(self):
        held = self.held()
        trades = materialise(self.trades(held)[1])
        return materialise(ledger.daily_pnl(held, trades, self.calendar)), trades


@query("p07_target_turnover", "strategy country execution_session:i l1_turnover:f", BOOKS + """,
nx AS (SELECT w.strategy, w.country, next_session AS execution_session, asset, target_weight AS w0 FROM w
  JOIN reb USING (strategy, country, execution_session) WHERE next_session IS NOT NULL)""",
       """SELECT strategy, country, execution_session, sum(abs(coalesce(target_weight, 0) - coalesce(w0, 0))) AS l1_turnover
  FROM w FULL JOIN nx USING (strategy, country, execution_session, asset) GROUP BY 1, 2, 3""")
def p07(spark, sf):
    return ledger.target_turnover(Books(spark, sf).weights)


@query("p08_drifted_weights", "strategy country execution_session:i asset:i pre_weight:f", BOOKS, "SELECT * FROM drift")
def p08(spark, sf):
    return ledger.drifted(Books(spark, sf).held())


_LED = "strategy country execution_session:i asset:i "


@query("p09_weight_ledger", _LED + "pre_weight:f target_weight:f", BOOKS, "SELECT * FROM led")
def p09(spark, sf):
    b = Books(spark, sf)
    return b.trades(b.held())[0]


@query("p10_trade_ledger", _LED + "weight_delta:f absolute_trade:f trade_component", BOOKS, "SELECT * FROM led")
def p10(spark, sf):
    return p09(spark, sf)


@query("p11_cost_ledger", _LED + "cost_rate:f9 transaction_cost:f9", BOOKS,
       "SELECT *, absolute_trade * cost_rate AS transaction_cost FROM led")
def p11(spark, sf):
    return p09(spark, sf)


@query("p12_turnover_decomposition",
       "strategy country execution_session:i continuing_turnover:f entry_turnover:f exit_turnover:f turnover:f rebalance_type cap_utilization:f",
       BOOKS, f"""SELECT *, CASE WHEN initial THEN 'initial_deployment' ELSE 'rebalance' END AS rebalance_type,
  CASE WHEN NOT initial THEN turnover / {CAP} END AS cap_utilization FROM tr""")
def p12(spark, sf):
    b = Books(spark, sf)
    return b.trades(b.held())[1]


@query("p13_daily_pnl",
       "strategy country date:d gross_return:f cost:f9 net_return:f turnover:f positions:i missing_valuations:i", BOOKS,
       "SELECT * FROM pnl")
def p13(spark, sf):
    return Books(spark, sf).pnl()[0]


@query("p13_missing_valuations", "strategy country session_id:i asset:i reason", BOOKS,
       "SELECT *, 'missing_valuation_carried' AS reason FROM held WHERE missing")
def p13_missing(spark, sf):
    return ledger.missing_valuations(Books(spark, sf).held())


PERIOD = BOOKS + """,
per AS (SELECT strategy, w.country, w.signal_date, count(*) AS names, count_if(forward_excess IS NULL) AS missing_names,
  bool_and(forward_excess IS NOT NULL) AS evaluable,
  CASE WHEN bool_and(forward_excess IS NOT NULL) THEN sum(target_weight * forward_excess) END AS period_return
  FROM w LEFT JOIN fwd f ON f.country = w.country AND f.asset = w.asset AND f.date = w.signal_date
  WHERE target_weight > 0 GROUP BY 1, 2, 3)"""


def period(spark, sf):
    b = Books(spark, sf)
    return ledger.period_pnl(b.weights, b.signals, "forward_excess")


@query("p14_period_pnl", "strategy country signal_date:d names:i missing_names:i evaluable:b period_return:f", PERIOD,
       "SELECT * FROM per")
def p14(spark, sf):
    return period(spark, sf)


SCENARIOS = (("tight", 0.4), ("loose", 1.0))
PATHS = BOOKS + "," + WINDOWS_SQL + """,
nm AS (SELECT r.strategy, r.country, r.execution_session, s.asset, CASE WHEN coalesce(v.valid, FALSE) THEN target_weight END AS want,
    NOT coalesce(v.valid, FALSE) AS frozen
  FROM reb r JOIN sig s ON s.country = r.country AND s.date = r.signal_date
  LEFT JOIN win v ON v.country = s.country AND v.date = s.date AND v.asset = s.asset
  LEFT JOIN w ON w.strategy = r.strategy AND w.country = r.country AND w.execution_session = r.execution_session AND w.asset = s.asset),
cu AS (SELECT * FROM nm WHERE want IS NOT NULL OR frozen),
gr AS (SELECT r.strategy, r.country, r.execution_session, p.asset, product(1 + ret) - 1 AS growth FROM reb r JOIN panel p
  ON p.country = r.country AND p.session_id > r.execution_session AND p.session_id <= r.next_session AND ret IS NOT NULL GROUP BY 1, 2, 3, 4),
pv AS (SELECT strategy, country, next_session AS execution_session, asset, growth FROM cu JOIN reb USING (strategy, country, execution_session)
  LEFT JOIN gr USING (strategy, country, execution_session, asset) WHERE next_session IS NOT NULL),
el AS (SELECT strategy, country, execution_session, row_number() OVER (PARTITION BY strategy, country ORDER BY execution_session) AS step, names FROM (
  SELECT strategy, country, execution_session,
    list({'a': CAST(asset AS VARCHAR), 'w': want, 'f': coalesce(frozen, FALSE), 'g': coalesce(growth, 0)} ORDER BY CAST(asset AS VARCHAR)) AS names
  FROM cu FULL JOIN pv USING (strategy, country, execution_session, asset) GROUP BY 1, 2, 3)),
path AS (SELECT strategy, country, scenario, CAST(cap AS DOUBLE) AS cap, 0 AS step, CAST(NULL AS BIGINT) AS execution_session, TRUE AS first,
    CAST([] AS STRUCT(a VARCHAR, p DOUBLE, n DOUBLE)[]) AS rows, CAST(0 AS DOUBLE) AS blend
  FROM (SELECT DISTINCT strategy, country FROM el) CROSS JOIN (VALUES """ + ", ".join(f"('{n}', {c})" for n, c in SCENARIOS) + """) AS sc(scenario, cap)
  UNION ALL
  SELECT strategy, country, scenario, cap, step, execution_session, first AND len([x FOR x IN rows IF x.n > 0]) = 0, rows, blend FROM (
  SELECT *, list_transform(b, lambda x: {'a': x.a, 'p': x.p, 'n': CAST(CASE WHEN x.f THEN x.p WHEN x.w IS NULL THEN 0 ELSE {RULE} END AS DOUBLE)}) AS rows FROM (
  SELECT *, {BLEND} AS blend FROM (
  SELECT *, coalesce(list_sum([abs(x.w / wt * room - x.p / kept * room) FOR x IN b IF x.w IS NOT NULL]), 0) AS dist FROM (
  SELECT *, 1 - coalesce(list_sum([x.p FOR x IN b IF x.f]), 0) AS room, coalesce(list_sum([x.p FOR x IN b IF x.w IS NOT NULL]), 0) AS kept,
    coalesce(list_sum([x.p FOR x IN b IF x.w IS NULL AND NOT x.f]), 0) AS gone, list_sum([x.w FOR x IN b IF x.w IS NOT NULL]) AS wt,
    len([x FOR x IN b IF x.w IS NOT NULL]) AS n FROM (
  SELECT *, [{'a': x.a, 'p': CASE WHEN total > 0 THEN x.p / total ELSE 0 END, 'w': x.w, 'f': x.f} FOR x IN g] AS b FROM (
  SELECT *, list_sum([x.p FOR x IN g]) AS total FROM (
  SELECT p.strategy, p.country, scenario, cap, e.step, e.execution_session, first,
    list_transform(names, lambda x: {'a': x.a, 'p': coalesce(list_extract([o.n FOR o IN p.rows IF o.a = x.a], 1), 0) * (1 + x.g), 'w': x.w, 'f': x.f}) AS g
  FROM path p JOIN el e ON e.strategy = p.strategy AND e.country = p.country AND e.step = p.step + 1)))))))),
pr AS (SELECT *, list_sum([abs(x.n - x.p) FOR x IN rows]) AS turnover FROM path WHERE step > 0)"""
_PATH_ROWS = """SELECT strategy, country, scenario, execution_session, x.a AS asset, x.p AS pre_weight, x.n AS target_weight, turnover, blend, blend < 1 AS capped
  FROM (SELECT *, unnest(rows) AS x FROM pr) WHERE x.p > 0 OR x.n > 0"""


def _path_sql(rule, blend):
    return "RECURSIVE " + PATHS.replace("{RULE}", rule).replace("{BLEND}", blend)


CAPPED_PATH = _path_sql(
    "CASE WHEN first OR kept <= 0 THEN x.w / wt * room ELSE x.p / kept * room + blend * (x.w / wt * room - x.p / kept * room) END",
    "CASE WHEN first OR kept <= 0 OR dist <= 1e-15 THEN 1.0 ELSE least(greatest((cap - 2 * gone) / dist, 0), 1) END")
HELD_PATH = _path_sql("CASE WHEN first THEN x.w / wt * room ELSE x.p + gone / n END", "1.0")


def _fold_input(spark, sf):
    """Names of every book: targets of names with a complete risk window, names without one frozen."""
    b = Books(spark, sf)
    valid = window_rows(spark, sf, b.members, b.pool).select("country", F.col("date").alias("signal_date"), "asset", "valid")
    universe_ = b.signals.select("country", F.col("date").alias("signal_date"), "asset").join(valid, ["country", "signal_date", "asset"], "left")
    books = ledger.rebalances(b.weights).select("strategy", "country", "signal_date", "execution_session")
    names = books.join(universe_, ["country", "signal_date"]).join(
        b.weights.select("strategy", "country", "execution_session", "asset", "target_weight"), ["strategy", "country", "execution_session", "asset"], "left")
    ok = F.coalesce("valid", F.lit(False))
    names = names.withColumn("target_weight", F.when(ok, F.col("target_weight"))).withColumn("frozen", ~ok)
    names = materialise(names.where("target_weight IS NOT NULL OR frozen"))
    t = fold.names_between(names, b.weights, b.returns)
    caps = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("turnover_cap")) for n, c in SCENARIOS])
    return t.select("*", F.inline(caps))


_FOLD = "strategy country scenario execution_session:i asset pre_weight:f target_weight:f turnover:f blend:f capped:b"


@query("p15_turnover_capped_path", _FOLD, CAPPED_PATH, _PATH_ROWS)
def p15(spark, sf):
    """Sequential by nature: each step starts from the weights the last one left."""
    return fold.rebalance(_fold_input(spark, sf))


@query("p02_buy_and_hold", _FOLD, HELD_PATH, _PATH_ROWS)
def p02(spark, sf):
    return fold.buy_and_hold(_fold_input(spark, sf))


@query("p16_schedule", "country scheduled:i skipped_missing_execution:i skipped_empty_signal:i", SIG + """,
pl AS (SELECT m.country, m.date, x.date AS execution_date, (SELECT count(*) FROM sig WHERE sig.country = m.country
  AND sig.date = m.date AND spread_bps IS NOT NULL) AS entries FROM monthly m JOIN calendar c ON c.country = m.country
  AND c.date = m.date LEFT JOIN calendar x ON x.country = c.country AND x.session_id = c.session_id + 1)""",
       """SELECT country, count_if(execution_date IS NOT NULL AND entries > 0) AS scheduled,
  count_if(execution_date IS NULL) AS skipped_missing_execution,
  count_if(execution_date IS NOT NULL AND entries = 0) AS skipped_empty_signal FROM pl GROUP BY 1""")
def p16(spark, sf):
    panel = staged_panel(spark, sf)
    c = days(panel)
    return portfolio.schedule_counts(_plan(c, signals(spark, sf, panel, c=c)))


def _plan(c, s):
    m = cal.session_offset(cal.month_end_sessions(c).join(F.broadcast(c), ["country", "date"]), c, 1, 1)
    return portfolio.schedule(m.withColumnRenamed("entry_date", "execution_date"), s.where(F.col("spread_bps").isNotNull()))


GRID = portfolio.scenario_grid({"k": 5, "cost_bps": 10}, {"k": [3, 5, 10], "cost_bps": [0, 10, 20]})
_GRID_SQL = ", ".join(f"('{g['variant']}', {g['k']}, {float(g['cost_bps'])})" for g in GRID)


@query("p17_scenario_grid", "variant country n_rows:i mean_net:f", SIG + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY mom DESC, asset) AS pick FROM sig
  WHERE forward_excess IS NOT NULL), g(variant, k, cost_bps) AS (VALUES {_GRID_SQL})""",
       """SELECT variant, country, count(*) AS n_rows, avg(forward_excess - cost_bps / 10000) AS mean_net
  FROM r JOIN g ON pick <= k GROUP BY 1, 2""")
def p17(spark, sf):
    s = universe.top_k(signals(spark, sf).where(F.col("forward_excess").isNotNull()), ["country", "date"],
                       [F.desc("mom"), F.asc("asset")], max(g["k"] for g in GRID))
    grid = F.array(*[F.struct(F.lit(g["variant"]).alias("variant"), F.lit(g["k"]).alias("k"),
                              F.lit(float(g["cost_bps"])).alias("cost_bps")) for g in GRID])
    return s.select("*", F.inline(grid)).where("pick <= k").groupBy("variant", "country").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("forward_excess") - F.col("cost_bps") / 10000).alias("mean_net"))


RISK_STATUS = "," + WINDOWS_SQL + f""",
rk AS (SELECT s.country, s.date AS signal_date, coalesce(n, 0) AS valid_assets, coalesce(n, 0) < {MIN_ASSETS} AS fallback
  FROM (SELECT DISTINCT country, date FROM sig) s LEFT JOIN (SELECT country, date, count_if(valid) AS n FROM win GROUP BY 1, 2) USING (country, date))"""
RISKLOG = BOOKS + RISK_STATUS + """,
pl AS (SELECT m.country, m.date AS signal_date, x.date AS execution_date FROM monthly m JOIN calendar c ON c.country = m.country
  AND c.date = m.date LEFT JOIN calendar x ON x.country = c.country AND x.session_id = c.session_id + 1),
en AS (SELECT country, date AS signal_date, count(*) AS entries FROM sig WHERE spread_bps IS NOT NULL GROUP BY 1, 2)"""


def risk_status(spark, sf, b):
    """Valid assets of the covariance window of each signal date, and whether it falls back to the diagonal."""
    return risk.status(window_rows(spark, sf, b.members, b.pool), b.signals, MIN_ASSETS).withColumnRenamed("date", "signal_date")


@query("p18_event_log", "country signal_date:d event detail", RISKLOG,
       """SELECT country, signal_date, 'rebalance' AS event, strategy || ':' ||
  CASE WHEN initial THEN 'initial_deployment' ELSE 'rebalance' END AS detail FROM tr
  UNION ALL SELECT country, signal_date, 'risk_fallback', 'too_few_valid_assets' FROM rk WHERE fallback
  UNION ALL SELECT country, signal_date, 'skipped', CASE WHEN execution_date IS NULL THEN 'missing_execution' ELSE 'empty_signal' END
  FROM pl LEFT JOIN en USING (country, signal_date) WHERE execution_date IS NULL OR coalesce(entries, 0) = 0""")
def p18(spark, sf):
    b = Books(spark, sf)
    plan = _plan(b.calendar, b.signals).withColumnRenamed("date", "signal_date")
    return ledger.event_log(b.trades(b.held())[1], risk_status(spark, sf, b), plan)


@query("p19_observed_cost_rerun", "strategy country n_rebalances:i cost_observed:f9 cost_assumed:f9", BOOKS + """,
obs AS (SELECT country, quantile_cont(spread_bps, 0.5) / 20000 AS half FROM panel GROUP BY 1)""",
       """SELECT strategy, country, count(*) AS n_rebalances, sum(turnover * half) AS cost_observed, sum(turnover * 0.001) AS cost_assumed
  FROM tr JOIN obs USING (country) GROUP BY 1, 2""")
def p19(spark, sf):
    from tessera.functions.ranking import exact_quantiles

    b = Books(spark, sf)
    obs = exact_quantiles(b.panel.where(F.col("spread_bps").isNotNull()), ["country"], {"q": ("spread_bps", 0.5)})
    # a constant rate per country replaces every stored rate
    t = b.trades(b.held())[1].join(F.broadcast(obs), "country")
    return t.groupBy("strategy", "country").agg(
        F.count(F.lit(1)).alias("n_rebalances"), F.sum(F.col("turnover") * F.col("q") / 20000).alias("cost_observed"),
        F.sum(F.col("turnover") * portfolio.DEFAULT_COST).alias("cost_assumed"))


# --- analytics --------------------------------------------------------------------

BK = ["strategy", "country"]
WEALTH = BOOKS + """,
wl AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy, country ORDER BY session_id ROWS UNBOUNDED PRECEDING) AS wealth FROM pnl),
dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY strategy, country ORDER BY session_id ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wl)"""


@query("a01_daily_summary", "strategy country n_periods:i annual_return:f annual_volatility:f sharpe:f", BOOKS,
       """SELECT strategy, country, count(*) AS n_periods, avg(net_return) * 252 AS annual_return,
  stddev_samp(net_return) * sqrt(252) AS annual_volatility,
  avg(net_return) * 252 / (stddev_samp(net_return) * sqrt(252)) AS sharpe FROM pnl GROUP BY 1, 2""")
def a01(spark, sf):
    return analytics.summary(Books(spark, sf).pnl()[0], BK, "net_return", analytics.DAILY)


@query("a02_max_drawdown", "strategy country max_drawdown:f", WEALTH,
       "SELECT strategy, country, min(drawdown) AS max_drawdown FROM dd GROUP BY 1, 2")
def a02(spark, sf):
    return analytics.max_drawdown(Books(spark, sf).pnl()[0], BK, "session_id", "net_return")


@query("a03_turnover_stats", "strategy country mean_turnover:f annual_turnover:f cost_drag:f return_per_turnover:f", BOOKS,
       """SELECT *, annual_return / annual_turnover AS return_per_turnover FROM (
  SELECT strategy, country, mean_turnover, t / (n / 252) AS annual_turnover, cost_drag, annual_return FROM
  (SELECT strategy, country, count(*) AS n, sum(gross_return) - sum(net_return) AS cost_drag, avg(net_return) * 252 AS annual_return
    FROM pnl GROUP BY 1, 2) JOIN (SELECT strategy, country, avg(turnover) AS mean_turnover, sum(turnover) AS t FROM tr GROUP BY 1, 2)
  USING (strategy, country))""")
def a03(spark, sf):
    d, t = Books(spark, sf).pnl()
    return analytics.turnover_stats(d, t, BK)


@query("a04_reliability",
       "strategy country coverage:f rebalances:i mean_assets:f mean_valid_risk_assets:f fallback_rate:f held_asset_days:i missing_events:i missing_rate:f",
       RISKLOG, """SELECT *, missing_events / nullif(held_asset_days, 0) AS missing_rate FROM (SELECT strategy, country, avg(CAST(evaluated AS INT)) AS coverage,
  sum(positions) AS held_asset_days, sum(missing_valuations) AS missing_events FROM pnl GROUP BY 1, 2) JOIN (
  SELECT strategy, tr.country, count(*) AS rebalances, avg(positions) AS mean_assets, avg(valid_assets) AS mean_valid_risk_assets,
  avg(CAST(coalesce(fallback, FALSE) AS INT)) AS fallback_rate FROM tr LEFT JOIN rk USING (country, signal_date) GROUP BY 1, 2)
  USING (strategy, country)""")
def a04(spark, sf):
    b = Books(spark, sf)
    d, t = b.pnl()
    return analytics.reliability(d, t, risk_status(spark, sf, b), BK)


@query("a05_period_summary", "strategy country n_periods:i annual_return:f annual_volatility:f sharpe:f", PERIOD,
       """SELECT strategy, country, count(period_return) AS n_periods, avg(period_return) * 52 AS annual_return,
  stddev_samp(period_return) * sqrt(52) AS annual_volatility,
  avg(period_return) * 52 / nullif(stddev_samp(period_return) * sqrt(52), 0) AS sharpe FROM per GROUP BY 1, 2""")
def a05(spark, sf):
    return analytics.summary(period(spark, sf), BK, "period_return", analytics.WEEKLY)


ECON = WEALTH + """,
qq AS (SELECT strategy, country, quantile_cont(net_return, 0.05) AS q FROM pnl GROUP BY 1, 2),
ec AS (SELECT strategy, country, count(*) AS n_periods, exp(sum(ln(1 + net_return)) * 52 / count(*)) - 1 AS geometric_return,
  avg(net_return) * 52 / (stddev_samp(CASE WHEN net_return < 0 THEN net_return END) * sqrt(52)) AS sortino,
  avg(CASE WHEN net_return <= q THEN net_return END) AS cvar_5, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
  max(net_return) AS best, min(net_return) AS worst, min(drawdown) AS max_drawdown FROM dd JOIN qq USING (strategy, country) GROUP BY 1, 2)"""


def econ(spark, sf):
    return analytics.economics(Books(spark, sf).pnl()[0], BK, "session_id", "net_return")


for _name, _cols in (("a06_geometric_return", "geometric_return:f"), ("a07_sortino", "sortino:f"), ("a08_calmar", "calmar:f"),
                     ("a09_cvar", "cvar_5:f"), ("a11_hit_best_worst", "n_periods:i hit_rate:f best:f worst:f")):
    query(_name, "strategy country " + _cols, ECON,
          "SELECT *, CASE WHEN max_drawdown < 0 THEN geometric_return / abs(max_drawdown) END AS calmar FROM ec")(econ)

_R26 = "(PARTITION BY strategy, country ORDER BY session_id ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)"
_ROLL = BOOKS + f""",
ro AS (SELECT *, CASE WHEN count(*) OVER {_R26} = 26 AND stddev_samp(net_return) OVER {_R26} > 1e-9
  THEN avg(net_return) OVER {_R26} / stddev_samp(net_return) OVER {_R26} * sqrt(52) END AS rs FROM pnl)"""


@query("a10_rolling_sharpe", "strategy country mean_rolling:f min_rolling:f", _ROLL,
       "SELECT strategy, country, avg(rs) AS mean_rolling, min(rs) AS min_rolling FROM ro GROUP BY 1, 2")
def a10(spark, sf):
    r = analytics.rolling_sharpe(Books(spark, sf).pnl()[0], BK, "session_id", "net_return")
    return r.groupBy(*BK).agg(F.avg("rolling_sharpe").alias("mean_rolling"), F.min("rolling_sharpe").alias("min_rolling"))


@query("a12_wealth_index", "strategy country date:d wealth:f drawdown:f", WEALTH, "SELECT * FROM dd")
def a12(spark, sf):
    return analytics.wealth(Books(spark, sf).pnl()[0], BK, "session_id", "net_return")


@query("a13_by_year", "strategy period n_periods:i annual_return:f annual_volatility:f", BOOKS,
       """SELECT strategy, coalesce(CAST(y AS VARCHAR), 'all') AS period, count(*) AS n_periods, avg(net_return) * 252 AS annual_return,
  CASE WHEN count(*) > 1 THEN stddev_samp(net_return) END * sqrt(252) AS annual_volatility
  FROM (SELECT *, year(date) AS y FROM pnl) GROUP BY GROUPING SETS ((strategy), (strategy, y))""")
def a13(spark, sf):
    return analytics.by_period(Books(spark, sf).pnl()[0], "strategy", "date", "net_return", analytics.DAILY)


CK = ["scenario", "country"]


@query("p13_costed_pnl", "strategy scenario country date:d gross_return:f cost:f9 net_return:f", COSTED,
       f"SELECT {SPLIT.format('strategy', 'strategy')}, {SCENARIO.format('strategy')} AS scenario, country, date, gross_return, cost, net_return FROM pnl")
def p13_costed(spark, sf):
    """The ledger under every cost scenario; positions are shared, costs are not."""
    return Books(spark, sf, costed=True).pnl()[0]


@query("a14_incremental_value", "strategy scenario country delta_sharpe:f mean_delta_return:f delta_turnover:f", COSTED + """,
sh AS (SELECT a.strategy, a.country, avg(a.net_return) / stddev_samp(a.net_return) * sqrt(252)
  - avg(b.net_return) / stddev_samp(b.net_return) * sqrt(252) AS delta_sharpe, avg(a.net_return - b.net_return) AS mean_delta_return
  FROM pnl a JOIN pnl b ON a.country = b.country AND a.date = b.date AND b.strategy = 'equal:' || split_part(a.strategy, ':', 2)
  WHERE a.strategy NOT LIKE 'equal:%' GROUP BY 1, 2),
mt AS (SELECT strategy, country, avg(turnover) AS t FROM tr GROUP BY 1, 2)""",
       f"""SELECT {SPLIT.format('sh.strategy', 'strategy')}, {SCENARIO.format('sh.strategy')} AS scenario, sh.country, delta_sharpe, mean_delta_return,
  m.t - b.t AS delta_turnover FROM sh JOIN mt m USING (strategy, country)
  JOIN mt b ON b.country = sh.country AND b.strategy = 'equal:' || split_part(sh.strategy, ':', 2)""")
def a14(spark, sf):
    d, t = Books(spark, sf, costed=True).pnl()
    return analytics.incremental(d, t, "equal", CK)


@query("a15_turnover_reduction", "left_ right_ country turnover_reduction:f", BOOKS + """,
mt AS (SELECT strategy, country, avg(turnover) AS t FROM tr GROUP BY 1, 2)""",
       """SELECT m.strategy AS left_, b.strategy AS right_, m.country, 1 - m.t / b.t AS turnover_reduction FROM mt m JOIN mt b
  ON b.country = m.country AND m.strategy < b.strategy""")
def a15(spark, sf):
    """Every two strategies per country; a cost scenario does not change what is traded."""
    return analytics.turnover_reduction(Books(spark, sf).pnl()[1], ["country"])
