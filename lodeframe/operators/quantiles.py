"""Exact quantiles without a sort or an unbounded buffer.

A sketch proposes pivots around each wanted rank, one counting pass tells on which side the rank lies, and the bracket
shrinks by a factor of thousands per round. Once a bracket holds few values they are collected inside the aggregate.
Memory per task stays bounded whatever the number of distinct values, and raw rows are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import as_number, facts, q

SKETCH = 10_000
SMALL = 20_000


@dataclass(frozen=True)
class _Bracket:
    """Values of column x<i> strictly between lo and hi (None: open end); `below` of all values are smaller."""

    i: int
    lo: float | None
    hi: float | None
    below: int
    inside: int

    def values(self) -> Column:
        c = F.col(f"x{self.i}")
        cond = F.lit(True)
        if self.lo is not None:
            cond = cond & (c > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c < F.lit(self.hi))
        return F.when(cond, c)

    def ends(self) -> tuple[float, float]:
        """The same values as a half-open interval."""
        return -math.inf if self.lo is None else math.nextafter(self.lo, math.inf), math.inf if self.hi is None else self.hi


def _in_buckets(table: DataFrame, bounds: dict[int, list[float]]) -> DataFrame:
    """(column, b, v): the bucket of every value among its column's bounds, found by binary search."""
    for i, inner in bounds.items():
        if not inner:
            table = table.withColumn(f"b{i}", F.lit(0))
            continue
        bucketizer = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=f"x{i}", outputCol=f"b{i}", handleInvalid="keep")
        table = bucketizer.transform(table)
    cells = [F.when(F.col(f"x{i}").isNotNull(), F.struct(F.col(f"b{i}").cast("int").alias("b"), F.col(f"x{i}").alias("v"))).alias(f"c{i}") for i in bounds]
    long = table.select(*cells).unpivot([], [f"c{i}" for i in bounds], "column", "cell").where("cell is not null")
    return long.select("column", "cell.b", "cell.v")


def _edges(values: set[float]) -> list[float]:
    return sorted(v for v in values if math.isfinite(v))


def _from_small(table: DataFrame, small: dict[_Bracket, list[int]]) -> dict[tuple[int, int], float]:
    """Values at absolute ranks inside brackets of few values: each bracket is one sorted list of bounded length."""
    bounds = {}
    for i in {b.i for b in small}:
        bounds[i] = _edges({e for b in small if b.i == i for e in b.ends()})
    wanted, order = F.lit(None).cast("array<int>"), {}
    for b, ranks in small.items():
        place = bounds[b.i].index(b.ends()[0]) + 1 if b.lo is not None else 0
        order[(f"c{b.i}", place)] = (b.i, ranks)
        inner = F.array(*[F.lit(r - b.below) for r in ranks])
        wanted = F.when((F.col("column") == f"c{b.i}") & (F.col("b") == place), inner).otherwise(wanted)
    listed = _in_buckets(table, bounds).withColumn("w", wanted).where("w is not null")
    picked = listed.groupBy("column", "b").agg(F.sort_array(F.collect_list("v")).alias("l"), F.first("w").alias("w"))
    found = {}
    for r in picked.select("column", "b", F.transform("w", lambda k: F.get("l", k)).alias("p")).collect():
        i, ranks = order[(r["column"], r["b"])]
        found |= {(i, rank): v for rank, v in zip(ranks, r["p"])}
    return found


def _narrow(table: DataFrame, large: dict[_Bracket, list[int]]) -> tuple[dict, dict]:
    """(found, brackets of the other ranks): pivots from one sketch per bracket, then one count per bucket between them."""
    aggregates, brackets = {}, list(large)
    for k, b in enumerate(brackets):
        shares = {(r - b.below) / (b.inside - 1) for r in large[b]}
        probs = sorted({max(0.0, p - 2.0 / SKETCH) for p in shares} | {min(1.0, p + 2.0 / SKETCH) for p in shares})
        aggregates[f"p{k}"] = F.percentile_approx(b.values(), probs, SKETCH)
    got = facts(table, aggregates)
    pivots: dict[int, set[float]] = {}
    for k, b in enumerate(brackets):
        pivots.setdefault(b.i, set()).update(got[f"p{k}"])
    bounds = {i: _edges(p | {math.nextafter(v, math.inf) for v in p}) for i, p in pivots.items()}
    sizes = {(r["column"], r["b"]): r["n"] for r in _in_buckets(table, bounds).groupBy("column", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, left = {}, {}
    for i, inner in bounds.items():
        counts = [sizes.get((f"c{i}", k), 0) for k in range(len(inner) + 1)]
        before = [sum(counts[: k + 1]) for k in range(len(inner))]
        marks = [(v, before[inner.index(v)], counts[inner.index(v) + 1]) for v in sorted(pivots[i])]
        for b in [b for b in brackets if b.i == i]:
            for rank in large[b]:
                lo, hi, below, end = b.lo, b.hi, b.below, b.below + b.inside
                for v, smaller, equal in marks:
                    if smaller <= rank < smaller + equal:
                        found[(i, rank)] = v
                        break
                    if rank < smaller:
                        if hi is None or v < hi:
                            hi, end = v, smaller
                        break
                    if lo is None or v > lo:
                        lo, below = v, smaller + equal
                if (i, rank) not in found:
                    left[(i, rank)] = _Bracket(i, lo, hi, below, end - below)
    return found, left


def order_statistics(df: DataFrame, wanted: dict[str, dict[int, None]], counts: dict[str, int]) -> dict:
    """{(column, zero-based rank): value} for double columns without NaN."""
    names = list(wanted)
    table = df.select(*[q(c).alias(f"x{i}") for i, c in enumerate(names)])
    open_ranks = {(i, r): _Bracket(i, None, None, 0, counts[c]) for i, c in enumerate(names) for r in wanted[c]}
    found: dict[tuple[int, int], float] = {}
    while open_ranks:
        by_bracket: dict[_Bracket, list[int]] = {}
        for (_, r), b in open_ranks.items():
            by_bracket.setdefault(b, []).append(r)
        small = {b: r for b, r in by_bracket.items() if b.inside <= SMALL}
        large = {b: r for b, r in by_bracket.items() if b.inside > SMALL}
        if small:
            found |= _from_small(table, small)
        open_ranks = {}
        if large:
            exact, open_ranks = _narrow(table, large)
            found |= exact
    return {(names[i], r): v for (i, r), v in found.items()}


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of whole columns, as plain numbers; times come back as seconds."""
    if not cols:
        return {}
    numbers = df.select(*[as_number(df, c).alias(c) for c in cols])
    counts = facts(numbers, {c: F.count(q(c)) for c in cols}).asDict()
    wanted: dict[str, dict[int, None]] = {}
    for c in cols:
        for p in probs if counts[c] else []:
            at = p * (counts[c] - 1)
            wanted.setdefault(c, {}).update({math.floor(at): None, math.ceil(at): None})
    stats = order_statistics(numbers, wanted, counts) if wanted else {}
    result: dict[str, list[float | None]] = {}
    for c in cols:
        result[c] = []
        for p in probs:
            if not counts[c]:
                result[c].append(None)
                continue
            at = p * (counts[c] - 1)
            lo, hi = stats[(c, math.floor(at))], stats[(c, math.ceil(at))]
            result[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return result


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
