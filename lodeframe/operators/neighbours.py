"""Exact nearest neighbours as a partitioned join over a tree of balls.

The tree grows level by level, all its large cells at once: a cell of more than `LEAF` donors gets up to `FAN` pivots, one of its points for
each hash bucket, each donor goes to the nearest, and each new cell knows its centre, radius and size. Cells end when they are small or hold
copies of one point. No pivot set is fixed beforehand, so cells stay bounded whatever the number of donors.

A query first follows the nearest centres to one leaf; its k best there bound the distance it has to look into. Then it descends again into
every cell whose ball comes within that bound and meets the leaves it reaches. Leaves are cut into chunks and the queries of a leaf into
shares, so that neither a point with many copies nor a crowded leaf is one task. Lists of k best are merged once per query. Nothing is
approximate, and no pairs are written beyond the k best.

A column `g` on both sides keeps groups apart: each has a tree of its own in the same tables, and queries look into their own group's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import q
from lodeframe.session import cut

LEAF, FAN, CHUNK = 2_048, 16, 8_192
#: Levels of the tree up to this size go to every task; larger ones are joined.
SHARED_BYTES = 16 << 20
_SLACK = 1e-9


def points(df: DataFrame, key: str, vector: Column, *carry: Column) -> DataFrame:
    """(id, v, ...) with v an array of doubles."""
    return df.select(q(key).alias("id"), vector.cast("array<double>").alias("v"), *carry)


def _grouped(df: DataFrame) -> DataFrame:
    return df if "g" in df.columns else df.withColumn("g", F.lit(0))


def _away(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, one coordinate at a time, so that memory grows with the pairs and not with the dimension."""
    total = np.zeros((len(a), len(b)))
    for j in range(b.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least finite numbers of each row, ties by the first column; only those up to the k-th are sorted."""
    last = np.inf if d.shape[1] <= k else np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    rows, columns = np.nonzero(np.isfinite(d) & ~(d > last))
    order = np.lexsort((d[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], columns[best]


@dataclass
class Tree:
    """`donors` (g, id, v, node) in their leaves, and for each level the divided cells: (g, node, cells), a cell being (node, centre, radius, n)."""

    donors: DataFrame
    levels: list[DataFrame]


def grow(donors: DataFrame, leaf: int = LEAF, fan: int = FAN) -> Tree:
    placed = cut(_grouped(donors).select("g", "id", "v", F.lit(0).cast("long").alias("node")))
    levels = []
    while True:
        sizes = placed.groupBy("g", "node").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("v")).alias("low"), F.max(F.xxhash64("v")).alias("high"))
        big = cut(sizes.where((F.col("n") > leaf) & (F.col("low") != F.col("high"))).select("g", "node"))
        width = big.count()
        if not width:
            return Tree(placed, levels)
        shared = F.broadcast if width * fan * 8 * (placed.select(F.max(F.size("v"))).first()[0] + 4) <= SHARED_BYTES else lambda df: df
        bucket = F.pmod(F.xxhash64("v", "node"), F.lit(fan)).alias("bucket")
        picked = placed.join(shared(big), ["g", "node"]).groupBy("g", "node", bucket).agg(F.min_by("v", F.xxhash64("v", "node", F.lit(1))).alias("centre"))
        pivots = picked.groupBy("g", "node").agg(F.collect_list(F.struct("bucket", "centre")).alias("pivots"))
        near = F.array_min(F.transform("pivots", lambda p: F.struct(_away(F.col("v"), p["centre"]).alias("far"), p["bucket"].alias("bucket"), p["centre"].alias("centre"))))
        moved = placed.join(shared(pivots), ["g", "node"], "left").withColumn("near", F.when(F.col("pivots").isNotNull(), near))
        below = F.when(F.col("near").isNull(), F.col("node")).otherwise(F.xxhash64("node", "near.bucket"))
        moved = cut(moved.select("g", "id", "v", F.col("node").alias("above"), below.alias("node"), "near.far", "near.centre"))
        balls = moved.where("centre is not null").groupBy("g", "above", "node").agg(F.first("centre").alias("centre"), F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        levels.append(cut(balls.groupBy("g", F.col("above").alias("node")).agg(F.collect_list(F.struct("node", "centre", "radius", "n")).alias("cells"))))
        placed = moved.select("g", "id", "v", "node")


def _opened(at: DataFrame, level: DataFrame) -> DataFrame:
    """Rows (g, node, v, ...) with `seen`: the cells below their node, each with its distance, or null where the node is a leaf."""
    met = at.join(level, ["g", "node"], "left")
    seen = F.transform("cells", lambda c: F.struct(_away(F.col("v"), c["centre"]).alias("d"), c["node"].alias("node"), c["radius"].alias("radius"), c["n"].alias("n")))
    return met.withColumn("seen", F.when(F.col("cells").isNotNull(), seen)).drop("cells")


def _home(queries: DataFrame, tree: Tree) -> DataFrame:
    """Each query with the leaf that the nearest centres lead to."""
    at = queries.withColumn("node", F.lit(0).cast("long"))
    for level in tree.levels:
        at = _opened(at, level)
        at = at.withColumn("node", F.coalesce(F.array_min("seen")["node"], F.col("node"))).drop("seen")
    return at


def visits(queries: DataFrame, tree: Tree) -> DataFrame:
    """The queries (g, id, v, bound, ...) once for each leaf that may hold a partner within the bound."""
    at = queries.withColumn("node", F.lit(0).cast("long"))
    reach = F.col("bound") * (1 + _SLACK) + _SLACK
    for level in tree.levels:
        at = _opened(at, level)
        below = F.transform(F.filter("seen", lambda c: c["d"] - c["radius"] * (1 + _SLACK) <= reach), lambda c: c["node"])
        at = at.withColumn("node", F.explode(F.when(F.col("seen").isNull(), F.array("node")).otherwise(below))).drop("seen")
    return at


def _meet(at: DataFrame, donors: DataFrame, chunk: int, work: Callable, schema: str) -> DataFrame:
    """Each chunk of a leaf's donors with each share of the queries that visit it, as one bounded group."""
    held = donors.groupBy("g", "node").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("pieces"))
    load = at.groupBy("g", "node").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("shares"))
    both = held.join(load, ["g", "node"])
    left = at.join(both, ["g", "node"]).withColumn("share", F.pmod(F.xxhash64("id", F.lit(7)), "shares").cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("g", "node", "share", "chunk", "id", "v")
    right = donors.join(both, ["g", "node"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("g", "node", "share", "chunk", "id", "v")
    keys = ["g", "node", "share", "chunk"]
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))  # the sides may share an origin
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, donors: DataFrame, k: int, other: bool = False, leaf: int = LEAF, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest donors of each query, ties by the smaller neighbour id.

    With `other`, a donor of the same id as the query is left out.
    """
    id_type = queries.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, neighbour {id_type}, distance double"

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "neighbour": right["id"][:0], "distance": np.zeros(0)})
        right = right.sort_values("id", kind="stable")
        ids, b = right["id"].to_numpy(), np.array(right["v"].tolist(), dtype=float)
        out = []
        for start in range(0, len(left), 512):
            part = left.iloc[start : start + 512]
            d = _distances(np.array(part["v"].tolist(), dtype=float), b)
            if other:
                d[part["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            rows, order = _least(d, k)
            out.append(pd.DataFrame({"id": part["id"].to_numpy()[rows], "neighbour": ids[order], "distance": d[rows, order]}))
        found = pd.concat(out)
        return found[np.isfinite(found["distance"])]

    asked = _grouped(queries).select("g", "id", "v")
    tree = grow(donors, leaf, fan)
    home = _home(asked, tree)
    if not tree.levels:
        return _first_k(_meet(home, tree.donors, chunk, work, schema), k)
    home = cut(home)
    first = cut(_first_k(_meet(home, tree.donors, chunk, work, schema), k).drop("rank"))
    reached = first.groupBy("id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    bounded = home.withColumnRenamed("node", "home").join(reached, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = visits(bounded, tree).where(F.col("node") != F.col("home"))
    return _first_k(first.unionByName(_meet(rest, tree.donors, chunk, work, schema)), k)


def within(queries: DataFrame, donors: DataFrame, radius: float, leaf: int = LEAF, fan: int = FAN, chunk: int = CHUNK, enough: int | None = None) -> DataFrame:
    """(id, n): how many donors lie within the radius of each query; pairs are counted where they meet, never written.

    A cell whose whole ball lies within counts as it is, without a visit. With `enough`, ids that have as many in their own leaves are not
    looked up further: n is exact below `enough`, and otherwise at least `enough`.
    """
    id_type = queries.schema["id"].dataType.simpleString()

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(len(left), dtype=np.int64)
        if len(left) and len(right):
            b = np.array(right["v"].tolist(), dtype=float)
            for start in range(0, len(left), 512):
                a = np.array(left["v"].iloc[start : start + 512].tolist(), dtype=float)
                counts[start : start + 512] = (_distances(a, b) <= radius).sum(axis=1)
        return pd.DataFrame({"id": left["id"], "n": counts})

    tree = grow(donors, leaf, fan)
    asked, count = _grouped(queries).select("g", "id", "v"), f"id {id_type}, n long"
    served = None
    if enough and tree.levels:
        home = _meet(_home(asked, tree), tree.donors, chunk, work, count).groupBy("id").agg(F.sum("n").alias("n"))
        served = cut(home.where(F.col("n") >= enough))
        asked = asked.join(served.select("id"), "id", "left_anti").select("g", "id", "v")
    at = asked.withColumns({"node": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    inside = lambda c: c["d"] + c["radius"] * (1 + _SLACK) <= F.lit(radius * (1 - _SLACK) - _SLACK)
    for level in tree.levels:
        at = _opened(at, level)
        whole = F.aggregate(F.filter("seen", inside), F.lit(0).cast("long"), lambda s, c: s + c["n"])
        open_ = F.filter("seen", lambda c: ~inside(c) & (c["d"] - c["radius"] * (1 + _SLACK) <= F.lit(radius * (1 + _SLACK) + _SLACK)))
        one = lambda node, n: F.struct(node.alias("node"), n.alias("n"))
        none = F.lit(None).cast("long")
        below = F.concat(F.array(one(none, F.col("n") + whole)), F.transform(open_, lambda c: one(c["node"], F.lit(0).cast("long"))))
        stays = F.array(one(F.col("node"), F.col("n")))
        at = at.withColumn("next", F.explode(F.when(F.col("seen").isNull(), stays).otherwise(below))).select("g", "id", "v", F.col("next.node").alias("node"), F.col("next.n").alias("n"))
    at = cut(at) if tree.levels else at
    found = _meet(at.where("node is not null"), tree.donors, chunk, work, count).unionByName(at.select("id", "n"))
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    counted = counted.unionByName(served) if served else counted
    return queries.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
