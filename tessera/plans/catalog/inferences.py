"""Queries I01-I12: paired tests, bootstrap intervals and multiplicity."""

from pyspark.sql import functions as F

from tessera.operators import analytics
from tessera.operators import inference as inf
from tessera.plans.catalog.forecasts import BASE, METRICS, forecasts, metrics
from tessera.plans.catalog.portfolios import BOOKS, COSTED, Books
from tessera.plans.registry import query
from tessera.session import materialise

PAIR = ["left", "right"]
LOSS = BASE + """,
diff AS (SELECT a.model AS "left", b.model AS "right", a.date, avg((a.prediction - a.target) * (a.prediction - a.target)
    - (b.prediction - b.target) * (b.prediction - b.target)) AS d, count(*) AS n_assets,
  count_if(abs(a.target - b.target) > 1e-8) AS target_mismatch FROM fc a JOIN fc b
  ON a.country = b.country AND a.date = b.date AND a.asset = b.asset AND a.model < b.model
  WHERE a.target IS NOT NULL GROUP BY 1, 2, 3),
ser AS (SELECT left_, right_, date, d, row_number() OVER (PARTITION BY left_, right_ ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY left_, right_) AS n, avg(d) OVER (PARTITION BY left_, right_) AS m
  FROM (SELECT "left" AS left_, "right" AS right_, date, d FROM diff))"""
_P = "left_ right_ "


def _losses(spark, sf):
    d = inf.loss_difference(inf.paired_rows(forecasts(spark, sf)))
    return materialise(d.withColumnsRenamed({"left": "left_", "right": "right_"}))


LP = ["left_", "right_"]


@query("i01_loss_difference", _P + "date:d d:f3 n_assets:i target_mismatch:i", LOSS,
       'SELECT "left" AS left_, "right" AS right_, date, d, n_assets, target_mismatch FROM diff')
def i01(spark, sf):
    return _losses(spark, sf)


TEST = LOSS + """,
lg AS (SELECT left_, right_, any_value(n) AS n, least(greatest(floor(pow(any_value(n), 1.0 / 3) + 1e-9), 1), 12) AS lag,
  any_value(m) AS mean FROM ser GROUP BY 1, 2),
ac AS (SELECT a.left_, a.right_, a.i - b.i AS k, sum((a.d - a.m) * (b.d - b.m)) / any_value(a.n) AS g FROM ser a JOIN ser b
  ON a.left_ = b.left_ AND a.right_ = b.right_ AND a.i - b.i BETWEEN 0 AND 12 GROUP BY 1, 2, 3),
lr AS (SELECT left_, right_, sum(CASE WHEN k = 0 THEN g WHEN k <= lag THEN 2 * (1 - k / (lag + 1)) * g ELSE 0 END) AS lrv
  FROM ac JOIN lg USING (left_, right_) GROUP BY 1, 2)"""


@query("i02_mean_test", _P + "n:i lag:i mean:f3 long_run_variance:f0 statistic:f", TEST,
       """SELECT *, lrv AS long_run_variance, mean / sqrt(greatest(lrv, 1e-16) / n) * sqrt((n - 1) / n) AS statistic
  FROM lg JOIN lr USING (left_, right_)""")
def i02(spark, sf):
    return inf.mean_test(_losses(spark, sf), LP)


T_SUM = TEST + """,
ts AS (SELECT left_, right_, abs(mean / sqrt(greatest(lrv, 1e-16) / n) * sqrt((n - 1) / n)) AS t, n - 1 AS nu,
  mean / sqrt(greatest(lrv, 1e-16) / n) * sqrt((n - 1) / n) AS statistic FROM lg JOIN lr USING (left_, right_)),
tu AS (SELECT *, nu / (nu + t * t) AS c2, unnest(range(CAST(CASE WHEN nu % 2 = 1 THEN (nu - 1) // 2 ELSE nu // 2 END AS BIGINT))) AS k FROM ts),
tt AS (SELECT left_, right_, statistic, t, nu, product(CASE WHEN k = 0 AND nu % 2 = 1 THEN sqrt(c2) WHEN k = 0 THEN 1.0
  WHEN nu % 2 = 1 THEN 2 * k / (2 * k + 1.0) * c2 ELSE (2 * k - 1) / (2.0 * k) * c2 END)
  OVER (PARTITION BY left_, right_ ORDER BY k ROWS UNBOUNDED PRECEDING) AS term FROM tu),
tp AS (SELECT left_, right_, any_value(statistic) AS statistic, any_value(t) AS t, any_value(nu) AS nu, sum(term) AS total FROM tt GROUP BY 1, 2)"""


@query("i03_student_p_value", _P + "statistic:f p_value:f", T_SUM,
       """SELECT left_, right_, statistic, 1 - CASE WHEN nu % 2 = 1 THEN 2 / pi() * (atan(t / sqrt(nu)) + t / sqrt(nu + t * t) * total)
  ELSE t / sqrt(nu + t * t) * total END AS p_value FROM tp""")
def i03(spark, sf):
    t = inf.mean_test(_losses(spark, sf), LP)
    return t.withColumn("p_value", inf.student_p("statistic", (F.col("n") - 1).cast("double")))


def _h(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT % {n})"


def circular_sql(keys: str) -> str:
    return f"""
dr AS (SELECT {keys}, n, draw, least(12, greatest(4, n // 8)) AS len FROM (SELECT DISTINCT {keys}, n FROM ser), range(2000) AS r(draw)),
bl AS (SELECT *, {_h('n', "'7'", 'draw', 'b')} AS start FROM (SELECT *, unnest(range(CAST(ceil(n / len) AS BIGINT))) AS b FROM dr)),
ix AS (SELECT {keys}, draw, b * len + o AS j, (start + o) % n AS i FROM (SELECT *, unnest(range(CAST(len AS BIGINT))) AS o FROM bl)
  WHERE b * len + o < n)"""


@query("i04_circular_block_interval", _P + "ci_low:f2 ci_high:f2", LOSS + "," + circular_sql("left_, right_"),
       """SELECT left_, right_, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT left_, right_, draw, avg(d) AS m FROM ix JOIN ser USING (left_, right_, i) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def i04(spark, sf):
    s = materialise(inf.indexed(_losses(spark, sf), LP))
    return inf.block_mean_interval(s, LP, "d")


FLIP = LOSS + f""",
fl AS (SELECT left_, right_, draw, abs(avg(CASE WHEN {_h('2', "'7'", 'draw', 'i')} = 0 THEN d ELSE -d END)) AS m, abs(any_value(m)) AS observed
  FROM ser, range(2000) AS r(draw) GROUP BY 1, 2, 3),
pv AS (SELECT left_, right_, avg(CASE WHEN m >= observed THEN 1.0 ELSE 0.0 END) AS p_value FROM fl GROUP BY 1, 2)"""


@query("i05_sign_flip", _P + "p_value:f", FLIP, "SELECT * FROM pv")
def i05(spark, sf):
    return inf.sign_flip(materialise(inf.indexed(_losses(spark, sf), LP)), LP)


@query("i06_holm", _P + "p_value:f holm_p:f", FLIP,
       """SELECT left_, right_, p_value, max(least(1, s)) OVER (ORDER BY p_value, left_, right_ ROWS UNBOUNDED PRECEDING) AS holm_p FROM (
  SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, left_, right_) + 1) * p_value AS s FROM pv)""")
def i06(spark, sf):
    return inf.holm(i05(spark, sf), LP, [])


SER2 = BOOKS + """,
dy AS (SELECT strategy, date, avg(net_return) AS r, avg(turnover) AS t FROM pnl GROUP BY 1, 2),
ser AS (SELECT strategy, date, a, b, ta, tb, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY strategy) AS n FROM (SELECT x.strategy, x.date, x.r AS a, y.r AS b, x.t AS ta, y.t AS tb
  FROM dy x JOIN dy y ON y.date = x.date AND y.strategy = 'equal' WHERE x.strategy <> 'equal'))"""


def _books(spark, sf):
    """Each strategy against equal weight, averaged over countries per date."""
    d = materialise(Books(spark, sf).pnl()[0].groupBy("strategy", "date").agg(
        F.avg("net_return").alias("a"), F.avg("turnover").alias("ta")))
    b = d.where("strategy = 'equal'").select("date", F.col("a").alias("b"), F.col("ta").alias("tb"))
    s = d.where("strategy <> 'equal'").join(F.broadcast(b), "date")
    return materialise(inf.indexed(s, ["strategy"]))


_MEASURES = ("mean", "sharpe", "turnover", "drawdown")


@query("i07_paired_portfolio_bootstrap", "strategy " + " ".join(f"{m}_low:f {m}_high:f" for m in _MEASURES),
       SER2 + "," + circular_sql("strategy") + """,
rs AS (SELECT strategy, draw, j, a, b, ta, tb, product(1 + a) OVER w AS wa, product(1 + b) OVER w AS wb FROM ix
  JOIN ser USING (strategy, i) WINDOW w AS (PARTITION BY strategy, draw ORDER BY j ROWS UNBOUNDED PRECEDING)),
rd AS (SELECT *, wa / max(wa) OVER w - 1 AS da, wb / max(wb) OVER w - 1 AS db FROM rs
  WINDOW w AS (PARTITION BY strategy, draw ORDER BY j ROWS UNBOUNDED PRECEDING)),
ds AS (SELECT strategy, draw, avg(a - b) AS mean, avg(a) / stddev_samp(a) * sqrt(252) - avg(b) / stddev_samp(b) * sqrt(252) AS sharpe,
  avg(ta - tb) AS turnover, min(da) - min(db) AS drawdown FROM rd GROUP BY 1, 2)""",
       "SELECT strategy, " + ", ".join(
           f"quantile_cont({m}, 0.025) AS {m}_low, quantile_cont({m}, 0.975) AS {m}_high" for m in _MEASURES) + " FROM ds GROUP BY 1")
def i07(spark, sf):
    s = _books(spark, sf)
    return inf.portfolio_bootstrap(s, ["strategy"], 252)


# Series per strategy, scenario and country against equal weight, and per two strategies of a scenario and country.
_SERIES = """
ser AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM (
  SELECT split_part(x.strategy, ':', 1) AS left_, split_part(y.strategy, ':', 1) AS right_, split_part(x.strategy, ':', 2) AS scenario,
    x.country, x.date, x.net_return AS a, y.net_return AS b FROM pnl x JOIN pnl y ON y.country = x.country AND y.date = x.date
    AND split_part(x.strategy, ':', 2) = split_part(y.strategy, ':', 2)) WHERE {which})"""
_PK = "left_, right_, scenario, country"
BOOK_PAIR = LP + ["scenario", "country"]
VS_EQUAL = COSTED + "," + _SERIES.format(keys=_PK, which="right_ = 'equal' AND left_ <> 'equal'")
ALL_PAIRS = COSTED + "," + _SERIES.format(keys=_PK, which="left_ < right_")


def _pairs(spark, sf, every):
    """Paired returns under every cost scenario, numbered by date."""
    d = Books(spark, sf, costed=True).pnl()[0].select("strategy", "scenario", "country", "date", "net_return")
    if every:
        s = analytics.strategy_pairs(d, ["scenario", "country"])
    else:
        base = d.where("strategy = 'equal'").select("scenario", "country", "date", F.col("net_return").alias("b"))
        s = d.where("strategy <> 'equal'").select(F.col("strategy").alias("left_"), F.lit("equal").alias("right_"), "scenario", "country", "date",
                                                  F.col("net_return").alias("a")).join(base, ["scenario", "country", "date"])
    return materialise(inf.indexed(s, BOOK_PAIR))


BLOCKS = f"""
fb AS (SELECT *, {_h('CAST(ceil(n / 5) AS BIGINT)', "'7'", 'draw', 'b')} * 5 AS start FROM (SELECT {_PK}, n, draw,
  unnest(range(CAST(ceil(n / least(CASE WHEN n % 5 = 0 THEN 5 ELSE n % 5 END, 5)) AS BIGINT))) AS b
  FROM (SELECT DISTINCT {_PK}, n FROM ser), range(2000) AS r(draw))),
fl AS (SELECT *, least(5, n - start) AS len FROM fb),
fa AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY {_PK}, draw ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM fl),
ix AS (SELECT {_PK}, draw, pos0 + o AS j, start + o AS i FROM (SELECT *, unnest(range(CAST(len AS BIGINT))) AS o FROM fa WHERE pos0 < n)
  WHERE pos0 + o < n)"""


_PC = "left_ right_ scenario country "


@query("i08_fixed_block_interval", _PC + "ci_low:f8 ci_high:f8", VS_EQUAL + "," + BLOCKS,
       f"""SELECT {_PK}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT {_PK}, draw, avg(a - b) AS m FROM ix JOIN ser USING ({_PK}, i) GROUP BY {_PK}, draw) GROUP BY {_PK}""")
def i08(spark, sf):
    s = _pairs(spark, sf, every=False).withColumn("d", F.col("a") - F.col("b"))
    return inf.block_mean_interval(s, BOOK_PAIR, "d", block=5)


_DSHARPE = f"""SELECT {_PK}, quantile_cont(ds, 0.025) AS delta_sharpe_low, quantile_cont(ds, 0.975) AS delta_sharpe_high FROM (
  SELECT {_PK}, draw, CASE WHEN stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN
    avg(a) / stddev_samp(a) * sqrt(252) - avg(b) / stddev_samp(b) * sqrt(252) END AS ds
  FROM ix JOIN ser USING ({_PK}, i) GROUP BY {_PK}, draw) GROUP BY {_PK}"""


@query("i09_fixed_block_sharpe", _PC + "delta_sharpe_low:f delta_sharpe_high:f", VS_EQUAL + "," + BLOCKS, _DSHARPE)
def i09(spark, sf):
    s = _pairs(spark, sf, every=False)
    return inf.block_sharpe_difference(s, BOOK_PAIR, 252, block=5)


IC = METRICS + """,
ic AS (SELECT model, country, date, spearman_ic AS ic FROM dm WHERE rank_defined AND spearman_ic IS NOT NULL)"""


def iid_sql(keys: str) -> str:
    return f"""
ix AS (SELECT {keys}, draw, j, {_h('n', "'7'", 'draw', 'j')} AS i FROM (SELECT {keys}, n, draw, unnest(range(n)) AS j
  FROM (SELECT DISTINCT {keys}, n FROM ser), range(2000) AS r(draw)))"""


def _ics(spark, sf):
    m = metrics(spark, sf).where("rank_defined AND spearman_ic IS NOT NULL")
    return materialise(m.select("model", "country", "date", F.col("spearman_ic").alias("ic")))


MC, LC = ["model", "country"], [*LP, "country"]


@query("i10_ic_interval", "model country ci_low:f ci_high:f", IC + """,
ser AS (SELECT *, row_number() OVER (PARTITION BY model, country ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY model, country) AS n FROM ic),"""
       + iid_sql("model, country"), """SELECT model, country, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT model, country, draw, avg(ic) AS m FROM ix JOIN ser USING (model, country, i) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def i10(spark, sf):
    s = materialise(inf.indexed(_ics(spark, sf), MC))
    return inf.block_mean_interval(s, MC, "ic", block=1)


@query("i11_paired_ic_interval", _P + "country mean_delta:f ci_low:f ci_high:f", IC + """,
ser AS (SELECT *, row_number() OVER (PARTITION BY left_, right_, country ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY left_, right_, country) AS n
  FROM (SELECT a.model AS left_, b.model AS right_, country, date, a.ic - b.ic AS d FROM ic a JOIN ic b USING (country, date) WHERE a.model < b.model)),"""
       + iid_sql("left_, right_, country"),
       """SELECT left_, right_, country, mean_delta, ci_low, ci_high FROM (SELECT left_, right_, country, quantile_cont(m, 0.025) AS ci_low,
  quantile_cont(m, 0.975) AS ci_high FROM (SELECT left_, right_, country, draw, avg(d) AS m FROM ix JOIN ser USING (left_, right_, country, i)
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) JOIN (SELECT left_, right_, country, avg(d) AS mean_delta FROM ser GROUP BY 1, 2, 3)
  USING (left_, right_, country)""")
def i11(spark, sf):
    ic = _ics(spark, sf)
    on = ["country", "date"]
    other = ic.select(*on, F.col("model").alias("right_"), F.col("ic").alias("y"))
    d = ic.select(*on, F.col("model").alias("left_"), F.col("ic").alias("x")).join(other, on).where("left_ < right_")
    s = materialise(inf.indexed(d.select(*LP, *on, (F.col("x") - F.col("y")).alias("d")), LC))
    mean = s.groupBy(*LC).agg(F.avg("d").alias("mean_delta"))
    return mean.join(inf.block_mean_interval(s, LC, "d", block=1), LC)


@query("i12_paired_sharpe_interval", _PC + "delta_sharpe_low:f delta_sharpe_high:f", ALL_PAIRS + "," + iid_sql(_PK), _DSHARPE)
def i12(spark, sf):
    s = _pairs(spark, sf, every=True)
    return inf.block_sharpe_difference(s, BOOK_PAIR, 252, block=1)
