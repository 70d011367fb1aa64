"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors at random to ``FOLDS`` groups of eight numbers
and decodes every group to the nearest point of the E8 lattice; the points name
the vector's cell.  A vector is filed under its cell and also visits the cells
next to it, those whose lattice vectors point most along the residual.  Vectors
that meet in a cell, one of them filed there, are compared by cosine in double
precision.

Equal vectors of one label are folded to one node with a count before anything is
decoded, so copies cost what one vector costs.  Cells are cut into blocks, so a
cell of m nodes costs m * m / BLOCK rows and no task holds it whole, and a cell's
blocks are dealt to the tasks in turn.  A pair that meets several times is counted
where it meets first, which both vectors' cells tell, so pairs are counted without
being emitted: a block returns link counts, each partner with its copies, and one
link per node into each connected part.

Defined results: labels that are null, and vectors that are null, empty, zero or
hold null or non-finite components, link with nothing; vectors of unlike length
are unlike; repeated rows are rows of their own, and usable equal vectors link with
each other whatever the threshold; null ids rank above all others; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shingles import mixed
from tessera.session import materialise, ship_package

TABLES, FOLDS, PROBES, SCALE = 6, 2, 3, 2.0
BLOCK = 512


def lattice_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = lattice_neighbours()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd move the worst coordinate."""
    point = np.rint(y)
    off = y - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def nearest_point(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the two cosets of the even integer lattice."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which of them are usable; all of one length."""
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors]).reshape(len(vectors), -1)
    with np.errstate(all="ignore"):
        v = v / np.abs(v).max(axis=1, keepdims=True, initial=0)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    good = np.isfinite(v).all(axis=1) & (v.shape[1] > 0)
    return np.where(good[:, None], v, 0.0), good


def cells(units: np.ndarray, table: int) -> np.ndarray:
    """Cell of each vector in a table, then the cells it visits: (n, 1 + PROBES) hashes."""
    dim = units.shape[1]
    rng = np.random.default_rng([table, dim])
    y = units @ rng.normal(size=(dim, 8 * FOLDS)) * (SCALE / np.sqrt(8)) + rng.uniform(0, 2, 8 * FOLDS)
    code = (rng.integers(0, 1 << 62, 8 * FOLDS) * 2 + 1).astype(np.uint64)
    points, along = np.empty_like(y), []
    for k in range(FOLDS):
        part = slice(8 * k, 8 * k + 8)
        points[:, part] = nearest_point(y[:, part])
        along.append((y[:, part] - points[:, part]) @ NEIGHBOURS.T)
    best = np.argsort(-np.hstack(along), axis=1, kind="stable")[:, :PROBES]
    name = lambda p: mixed(((2 * p).astype(np.int64).astype(np.uint64) * code).sum(axis=1, dtype=np.uint64))
    out = [name(points)]
    for q in range(PROBES):
        moved, fold = points.copy(), best[:, q] // len(NEIGHBOURS)
        for k in range(FOLDS):
            here = np.flatnonzero(fold == k)
            moved[here, 8 * k : 8 * k + 8] += NEIGHBOURS[best[here, q] % len(NEIGHBOURS)]
        out.append(name(moved))
    return np.stack(out, axis=1).view(np.int64)


def all_cells(vectors: pd.Series) -> pd.Series:
    """Cells of usable vectors, table after table; None for the others."""
    out: list = [None] * len(vectors)
    lengths = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        units, good = unit_rows(vectors.iloc[at].tolist())
        found = np.hstack([cells(units, t) for t in range(TABLES)])
        for i, row, ok in zip(at, found, good):
            out[i] = row if ok else None
    return pd.Series(out, dtype=object)


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of cells of one table meet: one's own cell is among the other's."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def _first_here(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether pairs (cells of a, cells of b) meet first in this cell of this table."""
    width = 1 + PROBES
    ok = np.ones(len(a), dtype=bool)
    for t in range(table):
        ok &= ~_met(a[:, t * width : (t + 1) * width], b[:, t * width : (t + 1) * width])
    a, b = a[:, table * width : (table + 1) * width], b[:, table * width : (table + 1) * width]
    own_a, own_b = a[:, 0] == cell, b[:, 0] == cell
    ok &= own_a | own_b
    # where only one is at home, the other's home may also see both; the smaller cell counts
    ok &= ~(own_a & ~own_b & (a == b[:, :1]).any(axis=1) & (b[:, 0] < cell))
    ok &= ~(own_b & ~own_a & (b == a[:, :1]).any(axis=1) & (a[:, 0] < cell))
    return ok


def block_links(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows that each node of a block links with, and the smallest node that it is connected with."""
    block = block.sort_values("node")
    one = block["i"].iat[0] == block["j"].iat[0]
    units, _ = unit_rows(block["vector"].tolist())
    its_cells, names, part, copies = np.stack(block["cells"]), block["node"].to_numpy(), block["part"].to_numpy(), block["copies"].to_numpy()
    close = units @ units.T >= threshold
    close &= block["label"].to_numpy()[:, None] == block["label"].to_numpy()[None, :]
    a, b = np.nonzero(np.triu(close, 1))
    if not one:
        across = part[a] != part[b]
        a, b = a[across], b[across]
    first = _first_here(its_cells[a], its_cells[b], int(block["t"].iat[0]), int(block["cell"].iat[0]))
    a, b = a[first], b[first]
    degree, root = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
    np.add.at(degree, a, copies[b])
    np.add.at(degree, b, copies[a])
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    kept = degree > 0
    return pd.DataFrame({"node": names[kept], "links": degree[kept], "root": names[root[kept]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, stays (one row per group)."""
    ship_package(vectors.sparkSession)

    @F.pandas_udf("array<bigint>")
    def filed(v: pd.Series) -> pd.Series:
        return all_cells(v)

    # shortest decimal forms name a float one to one, so equal digests are equal vectors
    digest = F.unhex(F.sha2(F.array_join(F.col(vector_col).cast("array<string>"), ",", "null"), 256))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).alias("label"), digest.alias("digest"), F.col(vector_col).alias("vector"))
    rows = materialise(rows)
    nodes = rows.where("label is not null and digest is not null").groupBy("label", "digest", "vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    # filtered after the write: a filter on the decoded cells would decode twice
    nodes = materialise(nodes.withColumn("cells", filed("vector"))).where("cells is not null")
    width = 1 + PROBES
    visits = nodes.select("node", "label", F.size("vector").alias("dim"), F.posexplode("cells").alias("p", "cell"))
    visits = visits.select("node", F.floor(F.col("p") / width).cast("int").alias("t"), "cell", "label", "dim", (F.col("p") % width == 0).alias("home"))
    bucket = ["t", "cell", "label", "dim"]
    busy = visits.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    met = materialise(visits.hint("merge").join(busy.drop("any_home"), bucket))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    dealt = met.withColumn("_b", F.explode(pairs)).select(*bucket, "node", "part", "_b.i", "_b.j")
    # blocks cost alike whatever their bytes: a cell's blocks go to the tasks in turn, from a place that its hash gives
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("j").cast("bigint") * (F.col("j") + 1) / 2 + F.col("i")
    dealt = dealt.withColumn("task", F.pmod(F.pmod(F.xxhash64(*bucket), F.lit(tasks)) + number.cast("bigint"), F.lit(tasks)).cast("int"))
    dealt = dealt.hint("merge").join(nodes.select("node", "vector", "cells", "copies"), "node").repartitionById(tasks, F.col("task"))
    found = materialise(dealt.groupBy("task", *bucket, "i", "j").applyInPandas(lambda b: block_links(b, threshold), "node bigint, links bigint, root bigint"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = nodes.select("node", "label", "digest", "copies").join(counts, "node", "left").join(joined, "node", "left").where("copies > 1 or links is not null")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    linked = linked.select("label", "digest", n_links.alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = materialise(rows.select("row", "vec_id", "label", "digest").join(linked, ["label", "digest"]).drop("label", "digest"))
    tops = named.groupBy("component").agg(F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row")).alias("top"))
    named = materialise(named.join(tops, "component").select("row", "n_links", F.col("top.vec_id").alias("component_id"), F.col("top.row").alias("top_row")))
    out = rows.select("row", "vec_id").join(named, "row", "left")
    alone = F.col("top_row").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        (alone | (F.col("top_row") == F.col("row"))).alias("stays"),
    )
