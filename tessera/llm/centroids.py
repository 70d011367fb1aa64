"""Centroid clustering with progressive search over Walsh-Hadamard coefficients.

Vectors are scaled to integers and transformed once, exactly; squared distances
of coefficients are ``WIDTH`` times those of vectors.  A search adds the squared
coefficient differences level by level, 1, 1, 2, 4, 8, 8, ... of them, coarse to
fine.  After eight, the centroid of the smallest sum so far is finished first; its
distance is the bound.  A sum grows at least by the squared difference of the
remaining norms of vector and centroid, and a centroid whose sum with that is
above the bound is strictly worse and is dropped.  Those left finish all
coefficients, so distances and ties are exact.

Rounds read one staged table.  Tasks return sums per centroid, which are added
up before they reach the driver: at most k * WIDTH numbers.  The broadcast tables
hold k rows.

Defined results: vectors of another length, null ones and those with null or
non-finite components are left out; a null id seeds by ``1:`` alone; seeds of
equal hash are ordered by their components; repeated rows are rows of their own;
with fewer than k vectors there are fewer centroids, with none no rows; scaled
components beyond 2^62 count as 2^62, and a distance or inertia beyond a long
is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, ship_package

WIDTH, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Beyond these, components and coefficients take Python integers in place of 64-bit ones.
PLAIN, LIMIT, LONG = 1 << 23, 1 << 62, 1 << 63


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, coarse (few sign changes per block) to fine."""
    out, half = rows.copy(), WIDTH // 2
    while half:
        x = out.reshape(len(out), -1, 2, half)
        out = np.concatenate([(x[:, :, 0] + x[:, :, 1])[:, :, None], (x[:, :, 0] - x[:, :, 1])[:, :, None]], axis=2).reshape(len(out), WIDTH)
        half //= 2
    return out[:, ORDER]


def _by_scale() -> np.ndarray:
    """Coefficients in order of their finest halving, so that level k only tells blocks of WIDTH / 2^k apart."""
    finest = [WIDTH.bit_length() - (i & -i).bit_length() if i else 0 for i in range(WIDTH)]
    return np.array(sorted(range(WIDTH), key=lambda i: (finest[i], i)))


ORDER = _by_scale()
PLACE = np.argsort(ORDER)
STEP = 8
LEVELS = [(0, 1), (1, 2), (2, 4), (4, STEP), *((a, a + STEP) for a in range(STEP, WIDTH, STEP))]


def inverse(coefficients: list[int]) -> list[int]:
    """Integers of one row of coefficients, exactly."""
    back = np.array(coefficients, dtype=object)[None, PLACE]
    # the transform in natural order is its own inverse up to WIDTH
    return [int(v) // WIDTH for v in transform(back)[0][PLACE]]


def scaled(vectors: pd.Series) -> list[list[int] | None]:
    """floor(SCALE * x) of usable vectors."""
    out: list[list[int] | None] = []
    for v in vectors:
        x = None if v is None or len(v) != WIDTH else np.array([math.nan if c is None else c for c in v], dtype=np.float64)
        if x is None or not np.isfinite(x).all():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            y = np.floor(SCALE * x)
        out.append(np.clip(y, -float(LIMIT), float(LIMIT)).astype(np.int64).tolist())
    return out


def _roots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at most and at least the square roots."""
    if x.dtype == object:
        low = np.array([math.isqrt(int(v)) for v in x], dtype=object)
    else:
        low = np.maximum(np.sqrt(x.astype(np.float64)).astype(np.int64) - 1, 0)
    return low, low + 2


def _starts(r: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest centroid (ties: the smaller), WIDTH times the squared distance, coefficients compared, per row."""
    n, k = len(rows), len(centroids)
    r, c = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part, seen, bound = np.zeros(n * k, dtype=rows.dtype), np.zeros(n, dtype=np.int64), None
    for a, b in LEVELS:
        off = rows[r, a:b] - centroids[c, a:b]
        part = part + (off * off).sum(axis=1)
        seen += np.bincount(r, minlength=n) * (b - a)
        if b < STEP:
            continue
        if bound is None:
            guess = part.reshape(n, k).argmin(axis=1) if part.dtype != object else np.array([min(range(k), key=row.__getitem__) for row in part.reshape(n, k)], dtype=np.int64)
            off = rows - centroids[guess]
            bound = (off * off).sum(axis=1)
        rest_rows, rest_centroids = (rows[:, b:] ** 2).sum(axis=1), (centroids[:, b:] ** 2).sum(axis=1)
        (low_rows, high_rows), (low_centroids, high_centroids) = _roots(rest_rows), _roots(rest_centroids)
        gap = np.maximum(np.maximum(low_rows[r] - high_centroids[c], low_centroids[c] - high_rows[r]), 0)
        alive = part + gap * gap <= bound[r]
        r, c, part = r[alive], c[alive], part[alive]
    best = np.minimum.reduceat(part, _starts(r)) if n else part
    at_best = part == best[r]
    r, c, part = r[at_best], c[at_best], part[at_best]
    first = _starts(r)
    return c[first], part[first], seen


class Centroids:
    """Staged coefficients of a table's usable vectors, and centroids over them."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K):
        ship_package(vectors.sparkSession)

        @F.pandas_udf("array<bigint>")
        def whole(v: pd.Series) -> pd.Series:
            return pd.Series(scaled(v), dtype=object)

        rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), whole(F.col(vector_col).cast("array<double>")).alias("q")).where("q is not null")
        self.rows = materialise(rows)
        seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
        self.points: list[list[int]] = [list(r.q) for r in self.rows.select(seed.alias("seed"), "q").orderBy("seed", "q").limit(k).collect()]

    def _coefficients(self) -> list[list[int]]:
        return [[int(v) for v in transform(np.array([p], dtype=object))[0]] for p in self.points]

    def refine(self) -> None:
        """One round: assign, then move every non-empty centroid to the floored mean of its vectors."""
        centroids = self._coefficients()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[int, list] = {}
            for batch in batches:
                x, c = _coefficients_of(batch["q"], centroids)
                at, _, _ = nearest(x, c)
                for k in np.unique(at):
                    mine = x[at == k]
                    had = totals.setdefault(int(k), [0, [0] * WIDTH])
                    had[0] += len(mine)
                    had[1] = [a + int(b) for a, b in zip(had[1], mine.sum(axis=0))]
            rows = [(k, n, p, Decimal(v)) for k, (n, total) in totals.items() for p, v in enumerate(total)]
            yield pd.DataFrame(rows, columns=["k", "n", "p", "total"])

        parts = self.rows.select("q").mapInPandas(sums, "k int, n bigint, p int, total decimal(38,0)")
        found = parts.groupBy("k", "p").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
        totals: dict[int, dict[int, tuple[int, int]]] = {}
        for r in found:
            totals.setdefault(r.k, {})[r.p] = (int(r.total), r.n)
        for k, by in totals.items():
            n = by[0][1]
            self.points[k] = [v // n for v in inverse([by[p][0] for p in range(WIDTH)])]

    def assign(self) -> DataFrame:
        """One row per usable vector: vec_id, cluster, distance, compared (coefficients looked at)."""
        centroids = self._coefficients()

        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, c = _coefficients_of(batch["q"], centroids)
                at, distance, seen = nearest(x, c)
                exact = [int(d) // WIDTH for d in distance]
                fits = pd.array([d if d < LONG else None for d in exact], dtype="Int64")
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": at, "distance": fits, "compared": seen, "exact": [Decimal(min(d, LONG)) for d in exact]})

        return self.rows.mapInPandas(found, "vec_id bigint, cluster int, distance bigint, compared bigint, exact decimal(38,0)")


def _coefficients_of(q: pd.Series, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array(q.tolist(), dtype=np.int64).reshape(-1, WIDTH)
    if rows.size and np.abs(rows).max() > PLAIN:
        rows = rows.astype(object)
    centres = np.array(centroids, dtype=object).reshape(-1, WIDTH)
    most = max((abs(v) for v in centres.ravel()), default=0)
    x = transform(rows)
    if x.dtype != object and most <= PLAIN * WIDTH:
        return x, centres.astype(np.int64)
    return x.astype(object), centres


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared."""
    model = Centroids(vectors, id_col, vector_col, k)
    for _ in range(rounds):
        model.refine()
    rows = materialise(model.assign())
    own = {r.cluster: int(r.own) for r in rows.groupBy("cluster").agg(F.sum("exact").alias("own")).collect()}
    fitting = lambda v: v if v < LONG else None
    named = [(c, fitting(own.get(c, 0)), fitting(sum(own.values())), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(model.points)]
    sums = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
