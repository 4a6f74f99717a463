"""Medians and deviations of windows of any length that move along an order, in tasks of bounded size.

Rows are cut by position into cells of equal size. All windows around the rows of one cell share the whole cells in their middle, the
core, and differ only in a few cells at both ends, the edges. The edges of a cell go to its task row by row. Of the core the task gets
its count and sums, and only those values that can be a median: windows of one cell differ by at most a few cells of rows, so the ranks
in question lie close together. Counts by cell and value bucket say which buckets hold them, and how many values lie below.
A task so sees some eight cells of rows, whether the window has a thousand rows or a twentieth of the table. Equal values of a cell are
one row with a weight, so one value may fill any part of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import facts
from lodeframe.operators.ordered import BLOCK
from lodeframe.session import cut


def select(sequence: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 0) among sequence[lo:hi] and a fixed bag that has weights[x] of each number x.

    The bits of the answers are found from the highest on, for all queries at once; the sequence is dealt stably by each bit in turn.
    """
    bag = np.concatenate([[0], np.cumsum(weights)])
    found = np.zeros(len(k), np.int64)
    lo, hi, k = lo.copy(), hi.copy(), k.copy()
    for bit in range(max(1, int(len(weights) - 1).bit_length()) - 1, -1, -1):
        one = (sequence >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        below, above = zeros[lo], zeros[hi]
        low = above - below + bag[np.minimum(found + (1 << bit), len(weights))] - bag[np.minimum(found, len(weights))]
        up = k >= low
        k -= np.where(up, low, 0)
        lo, hi = np.where(up, zeros[-1] + lo - below, below), np.where(up, zeros[-1] + hi - above, above)
        found += up.astype(np.int64) << bit
        sequence = np.concatenate([sequence[one == 0], sequence[one == 1]])
    return np.minimum(found, len(weights) - 1)


def _measure(rows: pa.Table, core: pa.Table | None, before: int, after: int, centre: float) -> pa.Table:
    """Median, deviation and size of the window around each home row, from the edges' rows and what is known of the core."""
    rows = rows.sort_by("_pos")
    at, x = rows.column("_pos").to_numpy(), rows.column("value").to_numpy()
    edge, home = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("_edge", "_home"))
    skip = known = 0
    total = squares = 0.0
    values, weights = np.zeros(0), np.zeros(0, np.int64)
    if core is not None and core.num_rows:
        head = core.filter(core.column("value").is_null()).to_pylist()[0]
        skip, known, total, squares = head["w"], head["known"], head["total"], head["squares"]
        rest = core.filter(core.column("value").is_valid())
        values, weights = rest.column("value").to_numpy(), rest.column("w").to_numpy()
    distinct = np.unique(np.concatenate([x[edge], values]))
    bag = np.zeros(max(1, len(distinct)), np.int64)
    np.add.at(bag, np.searchsorted(distinct, values), weights)
    lo, hi = np.searchsorted(at[edge], at[home] - before, "left"), np.searchsorted(at[edge], at[home] + after, "right")
    size = hi - lo + known
    twice = select(np.searchsorted(distinct, x[edge]), bag, np.tile(lo, 2), np.tile(hi, 2), np.concatenate([(size - 1) // 2, size // 2]) - skip)
    middle = distinct[twice].reshape(2, -1).mean(axis=0)
    off = x[edge] - centre
    sums, powers = (np.concatenate([[0.0], np.cumsum(v)]) for v in (off, off * off))
    total, squares = total + sums[hi] - sums[lo], squares + powers[hi] - powers[lo]
    sd = np.sqrt(np.maximum(0.0, (squares - total * total / size) / np.maximum(1, size - 1)))
    return pa.table({"key": rows.column("key").take(pa.array(home)), "value": x[home], "median": middle, "sd": pa.array(sd, mask=size < 2), "size": size})


def _cores(placed: DataFrame, rows_in: int, before: int, after: int, rows: int, inner: range, cut_at: list[float], centre: float) -> DataFrame:
    """(_block, value, w, known, total, squares): for each cell the core's values around the median and, with null for value, its sums."""
    last = -(-rows_in // rows) - 1
    bucket = Bucketizer(splits=[-math.inf, *cut_at, math.inf], inputCol="value", outputCol="_bucket", handleInvalid="keep")
    cells = bucket.transform(placed.select((F.floor(F.col("_pos") / rows)).alias("_cell"), "value")).groupBy("_cell", "_bucket", "value").agg(F.count(F.lit(1)).alias("w"))
    off = F.col("value") - F.lit(centre)
    counted = cells.groupBy("_bucket", "_cell").agg(F.sum("w").alias("n"), F.sum(F.col("w") * off).alias("s"), F.sum(F.col("w") * off * off).alias("s2"))

    def around(part: pa.Table) -> pa.Table:
        cell = part.column("_cell").to_numpy()
        block = np.arange(last + 1)
        first, end = np.maximum(0, block + inner[0]), np.minimum(last, block + inner[-1]) + 1
        sums = {}
        for c in ("n", "s", "s2"):
            running = np.concatenate([[0], np.cumsum(np.bincount(cell, weights=part.column(c).to_numpy(), minlength=last + 1))])
            sums[c] = running[end] - running[first]
        some = np.flatnonzero(sums["n"] > 0)
        return pa.table({"_block": block[some], "_bucket": np.full(len(some), part.column("_bucket")[0].as_py()), "n": sums["n"][some].astype(np.int64), "s": sums["s"][some], "s2": sums["s2"][some]})

    whole = Window.partitionBy("_block")
    core = counted.groupBy("_bucket").applyInArrow(around, "_block long, _bucket double, n long, s double, s2 double").select(
        "_block", "_bucket", "n", (F.sum("n").over(whole.orderBy("_bucket")) - F.col("n")).alias("below"), F.sum("n").over(whole).alias("known"),
        F.sum("s").over(whole).alias("total"), F.sum("s2").over(whole).alias("squares"),
    )
    start, end = F.col("_block") * rows, F.least((F.col("_block") + 1) * rows, F.lit(rows_in)) - 1
    wide = lambda p: F.least(F.lit(rows_in - 1), p + after) - F.greatest(F.lit(0), p - before) + 1
    most = min(rows_in, before + after + 1)
    least_rank = F.floor((F.least(wide(start), wide(end)) - 1) / 2) - (F.lit(most) - F.col("known"))
    needed = core.where((F.col("below") + F.col("n") > least_rank) & (F.col("below") <= most // 2))
    heads = needed.groupBy("_block").agg(F.min("below").alias("w"), *[F.first(c).alias(c) for c in ("known", "total", "squares")])
    members = F.explode(F.sequence(F.greatest(F.lit(0), F.col("_block") + inner[0]), F.least(F.lit(last), F.col("_block") + inner[-1])))
    values = needed.select("_block", "_bucket", members.alias("_cell")).join(cells, ["_bucket", "_cell"]).groupBy("_block", "value").agg(F.sum("w").alias("w"))
    return heads.unionByName(values, allowMissingColumns=True).select("_block", "value", "w", "known", "total", "squares")


def cell_rows(before: int, after: int, rows: int) -> int:
    """Rows of a cell: those asked for, but enough that there are fewer counts by cell and bucket than a quarter of the table's rows.

    A table of n rows has n / rows cells and a window of w rows about 2 * w / rows buckets, so cells of a fixed size would make their
    product grow with the square of the table where the window is a share of it. The floor grows with the window's square root only.
    """
    return max(rows, math.isqrt(8 * (before + after)))


def moving_median(placed: DataFrame, before: int, after: int, rows: int = BLOCK) -> DataFrame:
    """(key, value, median, sd, size) of the window from `before` rows before to `after` rows after each row of (key, value, _pos).

    Positions count from 0 without gaps, values are numbers and not null; windows end with the table. `rows` is the least size of a cell.
    """
    rows = cell_rows(before, after, rows)
    # Cells, counted from a row's own, that every window around the cell holds entirely, and the others that some of them touch.
    whole_before, whole_after = (before + 1) // rows - 1, (after + 1) // rows - 1
    inner = range(-whole_before, whole_after + 1) if whole_before + whole_after >= 0 else range(0)
    edges = [d for d in range(-(-(-before // rows)), -(-after // rows) + 1) if d not in inner]
    placed = placed.select("key", F.col("value").cast("double").alias("value"), F.col("_pos").cast("long").alias("_pos"))
    if inner:
        placed = cut(placed)
    buckets = 2 + 2 * (before + after) // rows
    wanted = {"n": F.count(F.lit(1)), "centre": F.avg("value")}
    if inner:
        wanted["cuts"] = F.percentile_approx("value", [i / buckets for i in range(1, buckets)], max(1000, 20 * buckets))
    known = facts(placed, wanted).asDict()
    n, centre = known["n"], known["centre"] or 0.0
    cell = F.floor(F.col("_pos") / rows)
    to = [F.struct(cell.alias("b"), F.lit(True).alias("h"), F.lit(0 in edges).alias("e"))]
    to += [F.struct((cell - d).alias("b"), F.lit(False).alias("h"), F.lit(True).alias("e")) for d in edges if d]
    last = F.lit(max(0, -(-n // rows) - 1))
    sent = placed.withColumn("_to", F.explode(F.filter(F.array(*to), lambda x: x["b"].between(F.lit(0), last))))
    sent = sent.select("key", "value", "_pos", F.col("_to.b").alias("_block"), F.col("_to.h").alias("_home"), F.col("_to.e").alias("_edge"))
    schema = f"key {placed.schema['key'].dataType.simpleString()}, value double, median double, sd double, size long"
    if not inner or not n:
        return sent.groupBy("_block").applyInArrow(lambda part: _measure(part, None, before, after, centre), schema)
    cores = _cores(placed, n, before, after, rows, inner, sorted(set(known["cuts"])), centre)
    return sent.groupBy("_block").cogroup(cores.groupBy("_block")).applyInArrow(lambda part, core: _measure(part, core, before, after, centre), schema)
