"""Work that needs the global order of rows, cut into value ranges so that no task sees more than its share.

The order column is cut at sketched quantiles of its value as a double; inside a range the column itself decides. A value that fills several ranges by itself (a third of all rows may share
one timestamp) is cut again along the key. The range of a row depends on its values alone, so a lost executor recomputes the
same ranges. Each range is one window partition; what it needs from earlier ranges is a table of one row per range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import as_number, clean, dtype, facts, is_numeric, is_time, q, same
from lodeframe.session import cut

_LAST = 1.7976931348623157e308
_SUBRANGES = 10_000
BLOCK = 100_000
SMALL_GROUP = 1_000_000


def range_count(df: DataFrame) -> int:
    """Twice the shuffle's partitions, so that ranges sharing one partition even out."""
    return max(4, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def with_ranges(df: DataFrame, order: str, key: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds _x (the order value as a double, nulls last) and _range (rising with _x, then with the key)."""
    ranges = ranges or range_count(df)
    df = df.withColumn("_x", F.coalesce(as_number(df, order), F.lit(_LAST)))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = facts(df, {"c": F.percentile_approx("_x", probs, max(1000, 20 * ranges))})["c"] or []
    repeats = {c: cuts.count(c) for c in cuts}
    splits = [-math.inf]
    for c in sorted(repeats):
        if c > splits[-1]:
            splits.append(c)
        if repeats[c] > 1:
            splits.append(math.nextafter(c, math.inf))
    if splits[-1] < math.inf:
        splits.append(math.inf)
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="_x", outputCol="_cut", handleInvalid="keep")
    df = bucketizer.transform(df)
    sub = F.lit(0)
    # Beyond 2^53 several whole numbers share a double; they stay in one range, where they are told apart.
    hot = [c for c in sorted(repeats) if repeats[c] > 1 and (abs(c) < 2**53 or c == _LAST or not isinstance(dtype(df, order), T.IntegralType))]
    if hot and key is not None and (is_numeric(df, key) or is_time(df, key)):
        key_number = as_number(df, key)
        pieces = max(repeats.values()) + 1
        cut_keys = (
            df.where(F.col("_x").isin(hot))
            .groupBy("_x")
            .agg(F.percentile_approx(key_number, [i / pieces for i in range(1, pieces)], 1000).alias("k"))
            .collect()
        )
        chain = None
        for found in cut_keys:
            bounds = sorted(set(found["k"] or []))
            piece = F.lit(0)
            for b in bounds:
                piece = piece + (key_number >= F.lit(b)).cast("int")
            cond = F.col("_x") == F.lit(found["_x"])
            chain = F.when(cond, piece) if chain is None else chain.when(cond, piece)
        if chain is not None:
            sub = F.coalesce(chain.otherwise(F.lit(0)), F.lit(0))
    return df.withColumn("_range", (F.col("_cut") * _SUBRANGES + sub).cast("long")).drop("_cut")


def join_ranges(df: DataFrame, per_range: DataFrame, partition: list[str]) -> DataFrame:
    """Brings the one-row-per-range table back; without partition columns its size is the number of ranges."""
    if not partition:
        return df.join(F.broadcast(per_range), "_range")
    right = per_range.withColumnsRenamed({c: f"_k_{c}" for c in partition}).withColumnRenamed("_range", "_r")
    cond = F.col("_range") == F.col("_r")
    for c in partition:
        cond = cond & same(q(c), q(f"_k_{c}"))
    return df.join(right, cond).drop("_r", *[f"_k_{c}" for c in partition])


def ranged_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt into ranges of a composite order of any sortable types, written: _row rises in that order, _range is the range's number."""
    rows = df.repartitionByRange(range_count(df), *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    return cut(rows).withColumn("_range", F.shiftright("_row", 33))


def _before(partition: list[str], forward: bool = True):
    order = F.col("_range").asc() if forward else F.col("_range").desc()
    w = Window.partitionBy(*[q(c) for c in partition]) if partition else Window
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _inside(partition: list[str], *order: Column):
    return Window.partitionBy(*[q(c) for c in partition], "_range").orderBy(*order)


def bounded_groups(df: DataFrame, partition: list[str] | None, limit: int = BLOCK) -> bool:
    """Whether the rows of each group fit a window of one task, so that the groups need not be cut into ranges."""
    if not partition:
        return False
    sizes = df.groupBy(*[q(c) for c in partition]).agg(F.count(F.lit(1)).alias("_n"))
    return (facts(sizes, {"m": F.max("_n")})["m"] or 0) <= limit


def _in_group(df: DataFrame, order: str, key: str, partition: list[str], forward: bool = True):
    """The window over a whole group in the order that ranges and rows inside a range have together."""
    sides = (F.coalesce(as_number(df, order), F.lit(_LAST)), q(order), q(key))
    return Window.partitionBy(*[q(c) for c in partition]).orderBy(*[x.asc() if forward else x.desc() for x in sides])


def with_position(df: DataFrame, order: str, key: str, partition: list[str] | None = None, bounded: bool | None = None) -> DataFrame:
    """Adds _pos, the zero-based position by (order, key), within the partition columns if any are given.

    Small groups are windows of their own; `bounded` says so where the caller knows."""
    partition = partition or []
    if bounded_groups(df, partition) if bounded is None else bounded:
        return df.withColumn("_pos", F.row_number().over(_in_group(df, order, key, partition)).cast("long") - 1)
    ranged = with_ranges(df, order, key)
    sizes = ranged.groupBy(*[q(c) for c in partition], "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(_before(partition)), F.lit(0))).drop("_n")
    local = F.row_number().over(_inside(partition, F.col("_x"), q(order), q(key))).cast("long")
    placed = join_ranges(ranged.withColumn("_local", local), sizes, partition)
    return placed.withColumn("_pos", F.col("_local") + F.col("_skip") - 1).drop("_local", "_skip", "_range", "_x")


def fill(df, cols: list[str], order: str, key: str, partition: list[str] | None = None, forward: bool = True, bounded: bool | None = None) -> DataFrame:
    """Last known value (forward) or next known value (backward) for each null. Small groups as in `with_position`."""
    partition = partition or []
    names = df.columns
    if bounded_groups(df, partition) if bounded is None else bounded:
        w = _in_group(df, order, key, partition, forward).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.coalesce(q(c), F.last(q(c), True).over(w)).alias(c) if c in cols else q(c) for c in names])
    ranged = with_ranges(df, order, key)
    at = F.struct(F.col("_x"), q(order).alias("_o"), q(key).alias("_k"))
    pick = F.max_by if forward else F.min_by
    carried = ranged.groupBy(*[q(c) for c in partition], "_range").agg(
        *[pick(q(c), F.when(q(c).isNotNull(), at)).alias(f"_carry_{i}") for i, c in enumerate(cols)]
    )
    for i in range(len(cols)):
        carried = carried.withColumn(f"_carry_{i}", F.last(f"_carry_{i}", True).over(_before(partition, forward)))
    sides = (F.col("_x").asc(), q(order).asc(), q(key).asc()) if forward else (F.col("_x").desc(), q(order).desc(), q(key).desc())
    w = _inside(partition, *sides).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({f"_near_{i}": F.last(q(c), True).over(w) for i, c in enumerate(cols)})
    joined = join_ranges(ranged, carried, partition)
    filled = {c: F.coalesce(F.col(f"_near_{i}"), F.col(f"_carry_{i}")) for i, c in enumerate(cols)}
    return joined.select(*[filled[c].alias(c) if c in filled else q(c) for c in names])


def in_blocks(placed: DataFrame, before: int, after: int, partition: list[str] | None = None, rows: int = BLOCK):
    """Cuts rows that carry _pos into equal blocks, each with copies of `before` and `after` rows of its neighbours.

    Returns the frame (with _block and _home) and the window over one block; keep only _home rows afterwards.
    """
    partition = partition or []
    rows = max(rows, before, after, 1)
    block, at = F.floor(F.col("_pos") / rows), F.col("_pos") % rows
    homes = F.array(
        F.struct(block.alias("b"), F.lit(True).alias("h")),
        F.struct(F.when(at >= rows - before, block + 1).alias("b"), F.lit(False).alias("h")),
        F.struct(F.when((at < after) & (block > 0), block - 1).alias("b"), F.lit(False).alias("h")),
    )
    spread = placed.withColumn("_to", F.explode(F.filter(homes, lambda x: x["b"].isNotNull())))
    spread = spread.withColumns({"_block": F.col("_to.b"), "_home": F.col("_to.h")}).drop("_to")
    return spread, Window.partitionBy(*[q(c) for c in partition], "_block").orderBy("_pos")


def cumulative(counts: DataFrame, order: str, measures: list[str], partition: list[str] | None = None) -> DataFrame:
    """Adds cum_<m> (inclusive) and total_<m> per measure in the order of a column that is distinct within the partition columns."""
    partition = partition or []
    ranged = with_ranges(counts, order)
    sums = ranged.groupBy(*[q(c) for c in partition], "_range").agg(*[F.sum(q(m)).alias(f"_s_{m}") for m in measures])
    whole = Window.partitionBy(*[q(c) for c in partition])
    skips = {f"_skip_{m}": F.coalesce(F.sum(f"_s_{m}").over(_before(partition)), F.lit(0)) for m in measures}
    totals = {f"total_{m}": F.sum(f"_s_{m}").over(whole) for m in measures}
    sums = sums.withColumns(skips | totals).drop(*[f"_s_{m}" for m in measures])
    w = _inside(partition, F.col("_x"), q(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({f"cum_{m}": F.sum(q(m)).over(w) for m in measures})
    joined = join_ranges(ranged, sums, partition)
    joined = joined.withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"_skip_{m}") for m in measures})
    return joined.drop("_range", "_x", *[f"_skip_{m}" for m in measures])


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], small: int = SMALL_GROUP) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per name.

    Where the largest group is small each is one aggregation buffer; else groups are spread over the ranges of the value.
    """
    numbers = df.select(*[q(k) for k in keys], as_number(df, value).alias("_v")).where(F.col("_v").isNotNull())
    sizes = numbers.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    if (facts(sizes, {"m": F.max("_n")})["m"] or 0) <= small:
        return numbers.groupBy(*[q(k) for k in keys]).agg(*[F.percentile("_v", F.lit(float(p))).alias(n) for n, p in probs.items()])
    counts = numbers.groupBy(*[q(k) for k in keys], "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative(counts, "_v", ["_n"], keys).withColumnRenamed("total__n", "_total")
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
    aggregates, outputs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (first <= rank) & (rank <= last)
            aggregates.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        part = F.lit(float(p)) * (F.col("_total") - 1)
        outputs.append((lo + (hi - lo) * (part - F.floor(part))).alias(name))
    grouped = ranked.groupBy(*[q(k) for k in keys], "_total").agg(*aggregates)
    return grouped.select(*[q(k) for k in keys], *outputs)


def values_at(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at a long list of zero-based ranks: one pass of value counts with running totals.

    Which wanted ranks a value covers is found by binary search; only those values come to the driver.
    """
    counts = df.select(as_number(df, value).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    running = cumulative(counts, "v", ["n"]).withColumns({
        "first": (F.col("cum_n") - F.col("n")).cast("double") - 0.5, "last": (F.col("cum_n") - 1).cast("double"),
    })
    wanted = sorted(set(ranks))
    splits = [-math.inf, *[float(r) for r in wanted], math.inf]
    for side in ("first", "last"):
        running = Bucketizer(splits=splits, inputCol=side, outputCol=f"{side}_at").transform(running)
    hits = running.where("last_at > first_at").select("v", F.col("first_at").cast("int").alias("a"), F.col("last_at").cast("int").alias("b"))
    return {rank: r["v"] for r in hits.collect() for rank in wanted[r["a"] : r["b"]]}


def many_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Exact linear-interpolation quantiles for a long list of probabilities."""
    total = df.select(as_number(df, value).alias("v")).where("v is not null").count()
    if not total:
        return [math.nan] * len(probs)
    at = [p * (total - 1) for p in probs]
    found = values_at(df, value, [math.floor(x) for x in at] + [math.ceil(x) for x in at])
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]


def value_ranks(df: DataFrame, value: str, also: dict[str, Column] | None = None) -> DataFrame:
    """(value, n, average rank, ...) over the whole table; `also` are extra sums carried along per value."""
    extra = [c.alias(k) for k, c in (also or {}).items()]
    counts = df.where(q(value).isNotNull()).groupBy(as_number(df, value).alias("v")).agg(F.count(F.lit(1)).alias("n"), *extra)
    running = cumulative(counts, "v", ["n"])
    return running.withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2)


def positions_of_values(df: DataFrame, c: str) -> DataFrame:
    """(value, position) for the distinct non-null values of a column of any sortable type, zero-based."""
    values = df.select((clean(df, c)).alias("value")).where("value is not null").distinct()
    if is_numeric(df, c) or is_time(df, c):
        placed = with_position(values.withColumn("_v", F.col("value")), "_v", "_v")
        return placed.select("value", F.col("_pos").alias("position"))
    ranged = values.repartitionByRange(range_count(df), "value").withColumn("_range", F.spark_partition_id().cast("long"))
    ranged = cut(ranged)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(_before([])), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_range").orderBy("value")).cast("long")
    placed = join_ranges(ranged.withColumn("_local", local), sizes, [])
    return placed.select("value", (F.col("_local") + F.col("_skip") - 1).alias("position"))


def steps(df: DataFrame, c: str) -> DataFrame:
    """(start, end, gap) between consecutive distinct values of a number or time column, in its own order."""
    values = df.select(as_number(df, c).alias("end")).where("end is not null").distinct()
    spread, w = in_blocks(with_position(values, "end", "end"), 1, 0)
    lagged = spread.withColumn("start", F.lag("end", 1).over(w)).where("_home").where("start is not null")
    return lagged.select("start", "end", (F.col("end") - F.col("start")).alias("gap"))


def median_step(gaps: DataFrame, distinct: int, rows: int) -> float | None:
    """Median difference of all consecutive values, equal neighbours counting as zero."""
    from lodeframe.operators.quantiles import order_statistics

    zeros, total = rows - distinct, rows - 1
    if total < 1:
        return None
    ranks = sorted({(total - 1) // 2, total // 2})
    beyond = {r - zeros: None for r in ranks if r >= zeros}
    stats = order_statistics(gaps.select("gap"), {"gap": beyond}, {"gap": distinct - 1}) if beyond else {}
    return sum(stats[("gap", r - zeros)] if r >= zeros else 0.0 for r in ranks) / len(ranks)
