"""Model fits on Spark: ridge, boosted trees and the expanding quarterly refit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.session import ensure_checkpoint_dir, materialise, ship_package

# Ridge penalty and boosting settings.
ALPHA = 10.0
BOOSTING = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 7}
#: Rows of a partition of boosted trees at most.
TREE_ROWS = 250_000
#: Side of a block of the moment matrix, rows from which a partial sum is handed on, tasks whose sums are added at a time, and bytes of
#: the matrices that a task holds.
BLOCK = 64
PARTIAL_ROWS = 100_000
TREE = 64
HELD = 256 * 2**20
KEY = ["country", "origin"]
HEAD, MOMENTS = "country string, origin date, ", "n bigint, sy double, sums array<double>"
FIT = f"{HEAD}rows_used bigint, intercept double, beta array<double>"
PARTIALS = pa.schema([("country", pa.string()), ("origin", pa.date32()), *[(c, pa.int32()) for c in ("part", "i", "j")],
                      ("n", pa.int64()), ("sy", pa.float64()), ("sums", pa.list_(pa.float64()))])


def ridge(train: DataFrame, rows: DataFrame, alpha: float = ALPHA, label: str = "target", width: int | None = None) -> DataFrame:
    """Action: least squares with penalty ``alpha`` on the raw coefficients, intercept free.

    ``features`` are vectors or arrays of ``width`` numbers.  One pass over ``train`` adds up its
    moments, and nothing of its rows is kept.
    """
    ship_package(train.sparkSession)
    known = train.where(F.col(label).isNotNull()).select(F.lit("").alias("country"), F.lit("1970-01-01").cast("date").alias("origin"),
                                                         F.col(label).cast("double").alias("target"), _numbers(train))
    width = width or known.select(F.size("features")).first()[0]
    fit = _moments(known, width).groupBy(*KEY).applyInPandas(_solved(width, alpha), FIT).first()
    if fit is None:
        raise ValueError("ridge: fewer than two rows with a label")
    beta = F.array(*[F.lit(b) for b in fit.beta])
    return rows.withColumn("prediction", F.lit(fit.intercept) + _dot(beta, _numbers(rows)))


def boosted_trees(train: DataFrame, rows: DataFrame, label: str = "target", **settings) -> DataFrame:
    """Action: gradient boosted regression trees; ``features`` are vectors or arrays.

    Trees are grown one after the other, each level in a job over all rows, so what a job
    costs besides its rows counts: the rows are a stage table in as many partitions as there are
    cores, or some times as many where one would hold more than ``TREE_ROWS``.  The checkpoint
    interval keeps the lineage of the running residuals short.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    known = materialise(train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias(label), _numbers(train)))
    known = _few(known, known.count(), TREE_ROWS)
    vectors = array_to_vector("features")
    model = GBTRegressor(featuresCol="features", labelCol=label, **{**BOOSTING, **settings}).fit(known.withColumn("features", vectors))
    return model.transform(rows.withColumn("features", _numbers(rows)).withColumn("features", vectors))


def _few(df: DataFrame, n: int, most: int) -> DataFrame:
    """Its ``n`` rows in as many partitions as there are cores, or the least multiple with ``most`` rows each on average."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores * max(1, -(-n // (cores * most))))


def _numbers(df: DataFrame) -> Column:
    """``features`` as an array."""
    from pyspark.ml.functions import vector_to_array

    is_array = isinstance(df.schema["features"].dataType, ArrayType)
    return (F.col("features") if is_array else vector_to_array("features")).alias("features")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _tiles(width: int) -> list[tuple[int, int]]:
    """Block ids (i, j), i <= j, of the matrix of cross products; (i, -1) holds sums of x and of x times y."""
    k = -(-width // BLOCK)
    return [(i, j) for i in range(k) for j in [-1, *range(i, k)]]


def _partials(width: int):
    """Moments of each (country, origin) of a partition, as dense blocks; they are handed on when they have many rows or fill much memory."""
    def blocks(key, part, n, sy, x_sum, xy, xx):
        for i, j in _tiles(width):
            rows = slice(i * BLOCK, min((i + 1) * BLOCK, width))
            sums = np.concatenate([x_sum[rows], xy[rows]]) if j < 0 else xx[rows, j * BLOCK : min((j + 1) * BLOCK, width)].ravel()
            yield (*key, part, i, j, n, sy, sums)

    def table(key, state):
        rows = blocks(key, TaskContext.get().partitionId(), *state)
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=PARTIALS.names), schema=PARTIALS, preserve_index=False)

    def run(batches):
        states = {}
        for b in batches:
            x_all = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y_all = b.column("target").to_numpy(zero_copy_only=False)
            keys = pd.DataFrame({c: b.column(c).to_pandas() for c in KEY})
            for at, rows in keys.groupby(KEY, sort=False).indices.items():
                if at not in states and (len(states) + 1) * width * width * 8 > HELD:
                    yield from (table(k, states.pop(k)) for k in list(states))
                x, y = x_all[rows], y_all[rows]
                state = states.setdefault(at, [0, 0.0, np.zeros(width), np.zeros(width), np.zeros((width, width))])
                state[0] += len(x)
                state[1] += float(y.sum())
                state[2] += x.sum(axis=0)
                state[3] += y @ x
                state[4] += x.T @ x
                if state[0] >= PARTIAL_ROWS:
                    yield table(at, states.pop(at))
        yield from (table(k, state) for k, state in states.items())

    return run


def _moments(known: DataFrame, width: int) -> DataFrame:
    """Moments by (country, origin) and block, added up in two steps.

    ``known``: country, origin, target and an array ``features``.  Rows are summed where they are, so
    only blocks are exchanged.
    """
    sums = known.select(*KEY, "target", "features").mapInArrow(_partials(width), f"{HEAD}part int, i int, j int, {MOMENTS}")
    for keys, fields in (([*KEY, "i", "j", "part"], "i int, j int, part int, "), ([*KEY, "i", "j"], "i int, j int, ")):
        sums = sums.withColumn("part", F.floor(F.col("part") / TREE).cast("int")) if "part" in keys else sums
        sums = sums.groupBy(*keys).applyInPandas(_added(keys), f"{HEAD}{fields}{MOMENTS}")
    return sums


def _added(columns: list[str]):
    """Sum of the arrays of one group."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        head = [g[c].iloc[0] for c in columns]
        return pd.DataFrame([(*head, int(g["n"].sum()), float(g["sy"].sum()), np.sum(g["sums"].tolist(), axis=0))], columns=[*columns, "n", "sy", "sums"])

    return run


def _running(g: pd.DataFrame) -> pd.DataFrame:
    """Sums up to each origin of one country and block; an origin without new rows repeats the one before."""
    g = g.sort_values("origin")
    arrays = [a for a in g["sums"] if a is not None]
    width = len(arrays[0]) if arrays else 0
    sums = np.cumsum([np.zeros(width) if a is None else a for a in g["sums"]], axis=0)
    return g.assign(n=g["n"].fillna(0).cumsum().astype("int64"), sy=g["sy"].fillna(0.0).cumsum(), sums=list(sums))


def _solved(width: int, alpha: float):
    """Ridge coefficients from the blocks of one origin."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, sy = int(g["n"].iloc[0]), float(g["sy"].iloc[0])
        names = [*KEY, "rows_used", "intercept", "beta"]
        if n < 2:
            return pd.DataFrame([], columns=names)
        sx, sxy, a = np.zeros(width), np.zeros(width), np.zeros((width, width))
        for i, j, sums in zip(g["i"], g["j"], g["sums"]):
            rows = slice(i * BLOCK, min((i + 1) * BLOCK, width))
            if j < 0:
                sx[rows], sxy[rows] = np.split(np.asarray(sums), 2)
            else:
                columns = slice(j * BLOCK, min((j + 1) * BLOCK, width))
                block = np.asarray(sums).reshape(rows.stop - rows.start, -1)
                a[rows, columns], a[columns, rows] = block, block.T
        beta = np.linalg.solve(a - np.outer(sx, sx) / n + alpha * np.eye(width), sxy - sx * sy / n)
        return pd.DataFrame([(g["country"].iloc[0], g["origin"].iloc[0], n, float(sy / n - beta @ sx / n), beta.tolist())], columns=names)

    return run


def walk_forward(rows: DataFrame, origins: DataFrame, width: int, alpha: float = ALPHA) -> DataFrame:
    """Expanding refit: ridge coefficients per origin from labels realised by then.

    Each label enters the moments of the first origin that may use it.  Cross
    products are summed as dense blocks per task, added up by block in two steps and
    summed along the origins of a block; every refit so comes from one pass over
    the data, and no plan has a column per moment.

    ``rows``: country, label_end_date, target, features (an array of ``width`` numbers
    without nulls). ``origins``: country, date.
    """
    ship_package(rows.sparkSession)
    o = origins.select("country", F.col("date").alias("origin")).distinct()
    cuts = F.broadcast(o.groupBy("country").agg(F.sort_array(F.collect_list("origin")).alias("_o")))
    known = rows.where(F.col("target").isNotNull() & F.col("label_end_date").isNotNull() & (F.size("features") == width))
    known = known.join(cuts, "country").withColumn(
        "origin", F.try_element_at("_o", F.size(F.filter("_o", lambda c: c < F.col("label_end_date"))) + 1)).where(
        F.col("origin").isNotNull()).select(*KEY, F.col("target").cast("double").alias("target"), "features")
    sums = _moments(known, width)
    ids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _tiles(width)])
    every = o.select(*KEY, F.inline(ids)).join(sums, [*KEY, "i", "j"], "left")
    upto = every.groupBy("country", "i", "j").applyInPandas(_running, f"{HEAD}i int, j int, {MOMENTS}")
    return upto.groupBy(*KEY).applyInPandas(_solved(width, alpha), FIT)


def predict_walk_forward(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Score each row's ``features`` with the latest fit at or before its date (fits per country are few)."""
    f = F.broadcast(fits.groupBy("country").agg(F.sort_array(F.collect_list(F.struct("origin", "intercept", "beta"))).alias("_f")))
    last = F.element_at(F.filter("_f", lambda x: x.origin <= F.col("date")), -1)
    d = rows.join(f, "country").where(F.exists("_f", lambda x: x.origin <= F.col("date"))).withColumn("_l", last)
    return d.withColumn("prediction", F.col("_l.intercept") + _dot(F.col("_l.beta"), F.col("features"))).withColumn("training_cutoff", F.col("_l.origin")).drop("_f", "_l")
