"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

Texts with one shingle set form a node, so copies cost one row from the first
aggregation on.  Nodes that share a band key are candidates:

1. every member of a bucket is paired with the bucket's smallest node; pairs whose
   odd sketches differ in too many bits are dropped, the rest are confirmed on
   full shingle sets, and confirmed links are contracted to components;
2. buckets that still hold several components are compared in blocks: pairs of
   unlike components, each in the first band they share, pass the sketch test and
   then the full sets.  Nothing but confirmed links leaves a block.

So a group of m near-copies costs m pairs, not m * m, and no bucket is capped.
A link at similarity 0.75 is missed by all 32 bands of 4 with probability 5e-6 and
by the sketch test with less than 1e-6; everything reported is exact.

Defined results: null and empty texts have no shingles and link with nothing;
repeated rows belong to one node; ids that are null rank above all others when
the smallest is chosen; of rows with equal ids and texts one ``stays``; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shingles import band_keys, most_odd_bits, odd_sketch, set_digest, shingle_set, signature
from tessera.session import materialise, ship_package

PERCENT = 75
BLOCK = 512


def text_key(id_col: str, text_col: str) -> Column:
    """Number by which a row's text is found again."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col)))


def describe(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Staged row per document: doc_id, row, key, node, n_shingles, bands, sketch."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))

    @F.pandas_udf("node binary, n_shingles bigint, bands array<bigint>, sketch array<bigint>")
    def features(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingle_set(text)
            if len(s):
                sig = signature(s)
                out.append((set_digest(s), len(s), band_keys(sig), odd_sketch(sig)))
            else:
                out.append((None, 0, None, None))
        return pd.DataFrame(out, columns=["node", "n_shingles", "bands", "sketch"])

    full = rows.withColumn("f", features("text"))
    return materialise(full.select("doc_id", "row", "key", "f.*", *(["carried"] if carry else [])))


def similar(inside: int, a: int, b: int) -> bool:
    return 100 * inside >= PERCENT * (a + b - inside)


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            if text in sets:
                sets.move_to_end(text)
                return sets[text]
            sets[text] = s = shingle_set(text)
            if len(sets) > 16:
                sets.popitem(last=False)
            return s

        for one, other in batches:
            out = []
            for x, y in zip(one, other):
                a, b = of(x), of(y)
                out.append(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pd.Series(out, dtype=bool)

    full = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return materialise(full.where(linked("text_a", "text_b")).select("a", "b"))


def _close_pairs(key: int, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of unlike components whose first shared band is ``key`` and whose sketches are near."""
    most = most_odd_bits(PERCENT / 100)
    la, lb = (np.stack(x["sketch"]).view(np.uint64) for x in (left, right))  # bit counts are of magnitudes
    ba, bb = np.stack(left["bands"]), np.stack(right["bands"])
    ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
    place = int(np.flatnonzero(ba[0] == key)[0])
    one, other = [], []
    for i in range(len(left)):
        near = np.bitwise_count(lb ^ la[i]).sum(axis=1) <= most
        near &= cb != ca[i]
        if same:
            near[: i + 1] = False
        j = np.flatnonzero(near)
        if len(j) and place:
            j = j[~(bb[j, :place] == ba[i, :place]).any(axis=1)]
        one.append(np.full(len(j), i))
        other.append(j)
    return np.concatenate(one), np.concatenate(other)


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """Rows of the two parts that meet in a block; one part meets itself."""
    same = block["i"].iat[0] == block["j"].iat[0]
    block = block.sort_values("node")
    return (block, block, True) if same else (block[block["part"] == block["i"]], block[block["part"] == block["j"]], False)


def _active(block: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a block that have a near partner in another component."""
    left, right, same = _sides(block)
    if not len(left) or not len(right):
        return block.iloc[:0][["key", "i", "j", "part", "node"]]
    a, b = _close_pairs(block["key"].iat[0], left, right, same)
    out = pd.concat([left.iloc[np.unique(a)], right.iloc[np.unique(b)]])
    return out[["key", "i", "j", "part", "node"]].drop_duplicates("node")


def _linked(block: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links of a block: each row's set is marked once and counted in all near partners."""
    left, right, same = _sides(block)
    found = []
    if len(left) and len(right):
        a, b = _close_pairs(block["key"].iat[0], left, right, same)
        sets = {n: shingle_set(t) for n, t in zip(block["node"], block["text"])}
        names, others = left["node"].to_numpy(), right["node"].to_numpy()
        for i in np.unique(a):
            js = b[a == i]
            mine, theirs = sets[names[i]], [sets[others[j]] for j in js]
            flat = np.concatenate(theirs)
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            inside = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum([0, *map(len, theirs[:-1])]))
            found += [(names[i], others[j]) for j, k, t in zip(js, inside, theirs) if similar(int(k), len(mine), len(t))]
    return pd.DataFrame(found, columns=["a", "b"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Deal each bucket's rows (with its size ``n``) into blocks of two parts of about BLOCK nodes."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    return rows.withColumn("_m", F.explode(met)).select("*", "_m.i", "_m.j").drop("_m")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, stays (and ``carried``).

    ``component_id`` is the smallest id reachable by links, ``kept`` marks rows that
    have it, and ``stays`` exactly one row per group.
    """
    ship_package(docs.sparkSession)
    rows = describe(docs, id_col, text_col, carry)
    top = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("top")
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(top, F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    bands = nodes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center"), F.expr("bit_xor(xxhash64(node))").alias("members")).where("n > 1")
    met = materialise(bands.hint("merge").join(buckets, "key"))

    wanted = met.select("node").distinct().join(nodes.select("node", "key"), "node")
    source = docs.select(text_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # takes both sides' columns, so it runs on the joined rows and not on every document before the join
    @F.pandas_udf("boolean")
    def is_node(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([set_digest(shingle_set(t)) == n for t, n in zip(texts, names)], dtype=bool)

    found = source.hint("merge").join(wanted, "key").where(is_node("text", "node"))
    texts = materialise(found.groupBy("node").agg(F.any_value("text").alias("text")))

    sketch = nodes.select("node", "sketch")
    pairs = met.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    links = _confirm(pairs.where(bits <= most_odd_bits(PERCENT / 100)).select("a", "b"), texts)

    first = components(links)
    labelled = materialise(met.join(first, "node", "left").select("key", "node", "n", "members", "center", F.coalesce("component", "node").alias("component")))
    mixed = labelled.where("n > 2").groupBy("key", "n", "members", "center").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = mixed.select("key")
    open_rows = labelled.select("key", "node", "n", "component").join(mixed, "key", "left_semi")
    blocks = materialise(_in_blocks(open_rows.join(nodes.select("node", "sketch", "bands"), "node")))
    kind = "key bigint, i int, j int, part int, node binary"
    active = blocks.groupBy("key", "i", "j").applyInPandas(_active, kind)
    full = blocks.drop("part", "n").join(materialise(active), ["key", "i", "j", "node"]).join(texts, "node")
    more = full.groupBy("key", "i", "j").applyInPandas(_linked, "a binary, b binary")
    final = components(links.unionByName(materialise(more)))

    grouped = nodes.select("node", "top", "copies").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = grouped.groupBy("component").agg(F.min("top").alias("top"), F.sum("copies").alias("n")).where("n > 1")
    tops = materialise(grouped.select("node", "component").join(tops, "component").select("node", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("top_row")))
    out = rows.drop("bands", "sketch", "key").hint("merge").join(tops, "node", "left")
    alone = F.col("top_row").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        (alone | (F.col("top_row") == F.col("row"))).alias("stays"),
        *(["carried"] if carry else []),
    )
