"""Duplicate rows, sparse rows, dropped columns and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, is_numeric, no_nan, q, same
from lodeframe.operators.ordered import bounded_groups, fill, with_position
from lodeframe.operators.quantiles import medians


def attach(df: DataFrame, table: DataFrame, keys: list[str], outer: bool = True) -> DataFrame:
    """Null-safe join with a one-row-per-key table; adaptive execution splits a hot key on the left."""
    right = table.withColumnsRenamed({k: f"_a_{i}" for i, k in enumerate(keys)})
    cond = reduce(lambda a, b: a & b, [same(q(k), F.col(f"_a_{i}")) for i, k in enumerate(keys)])
    return df.join(right, cond, "left" if outer else "inner").drop(*[f"_a_{i}" for i in range(len(keys))])


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None, keep: str = "first") -> DataFrame:
    """One row per distinct row (or per distinct subset); first and last are told by the order columns.

    Kept by an aggregate rather than a window, so that a group of copies shrinks before the shuffle.
    """
    keys = subset or df.columns
    if not order or set(keys) >= set(df.columns):
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    kept = pick(F.struct(*[q(c) for c in rest]), F.struct(*[q(c) for c in order])).alias("_kept")
    grouped = df.groupBy(*[q(c) for c in keys]).agg(kept)
    return grouped.select(*[q(c) if c in keys else F.col("_kept").getField(c).alias(c) for c in df.columns])


def flag_duplicates(df: DataFrame) -> DataFrame:
    """Every row of a repeated row is marked. Only the repeated rows, once each, are joined back."""
    names = df.columns
    repeated = df.groupBy(*[q(c) for c in names]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = repeated.select(F.xxhash64(*[q(c) for c in names]).alias("_rh"), *[q(c).alias(f"_r_{i}") for i, c in enumerate(names)])
    cond = F.xxhash64(*[q(c) for c in names]) == F.col("_rh")
    for i, c in enumerate(names):
        cond = cond & same(q(c), F.col(f"_r_{i}"))
    marked = df.join(repeated, cond, "left").withColumn("_is_duplicate", F.col("_rh").isNotNull())
    return marked.select(*[q(c) for c in names], "_is_duplicate")


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [clean(df, c).isNotNull() for c in cols], F.lit(True)))


def sparse_limit(n_columns: int) -> float:
    return 0.6 if n_columns <= 5 else 0.5 if n_columns <= 20 else 0.4


def null_share(df: DataFrame) -> Column:
    return sum((clean(df, c).isNull().cast("int") for c in df.columns), F.lit(0)) / F.lit(float(max(1, len(df.columns))))


def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """Rows whose share of nulls is above a limit that falls with the number of columns."""
    return df.where(null_share(df) <= sparse_limit(len(df.columns)))


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column, the smallest on ties, from counted values."""
    found = {}
    for c in cols:
        counts = df.select(clean(df, c).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
        found[c] = counts.agg(F.min_by(F.col("v"), F.struct(-F.col("n"), F.col("v")))).first()[0]
    return found


def _filled(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced; whole-number columns turn to doubles only when the value has a fraction."""
    out = {}
    for c, v in values.items():
        if v is None:
            continue
        column = clean(df, c)
        if isinstance(v, float) and is_numeric(df, c):
            column = column.cast("double")
        out[c] = F.coalesce(column, F.lit(v))
    return df.withColumns(out) if out else df


def impute(df: DataFrame, cols: list[str], method: str = "mean", value=0) -> DataFrame:
    """mean, median, mode or constant."""
    if method == "mean":
        return _filled(df, facts(df, {c: F.avg(clean(df, c)) for c in cols}).asDict())
    if method == "median":
        return _filled(df, medians(df, cols))
    if method == "mode":
        return _filled(df, modes(df, cols))
    if method == "constant":
        return _filled(df, {c: value for c in cols})
    raise ValueError(f"unknown imputation {method}")


def ffill(df: DataFrame, cols: list[str], order: str, key: str, partition: list[str] | None = None) -> DataFrame:
    return fill(no_nan(df), cols, order, key, partition, forward=True)


def bfill(df: DataFrame, cols: list[str], order: str, key: str, partition: list[str] | None = None) -> DataFrame:
    return fill(no_nan(df), cols, order, key, partition, forward=False)


def interpolate(df: DataFrame, cols: list[str], order: str, key: str, partition: list[str] | None = None) -> DataFrame:
    """Straight lines between known values by row position; leading nulls stay, trailing ones take the last value."""
    names = df.columns
    bounded = bounded_groups(df, partition)
    placed = with_position(no_nan(df), order, key, partition, bounded)
    points = {f"_{side}_{i}": F.when(q(c).isNotNull(), F.struct(F.col("_pos").alias("p"), q(c).cast("double").alias("v")))
              for side in ("a", "b") for i, c in enumerate(cols)}
    placed = placed.withColumns(points)
    placed = fill(placed, [f"_a_{i}" for i in range(len(cols))], "_pos", "_pos", partition, True, bounded)
    placed = fill(placed, [f"_b_{i}" for i in range(len(cols))], "_pos", "_pos", partition, False, bounded)
    out = {}
    for i, c in enumerate(cols):
        a, b, at = F.col(f"_a_{i}"), F.col(f"_b_{i}"), F.col("_pos")
        between = a["v"] + (b["v"] - a["v"]) * (at - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
        out[c] = F.when(q(c).isNotNull(), q(c)).when(a.isNull(), None).when(b.isNull(), a["v"]).otherwise(between)
    return placed.select(*[out[c].alias(c) if c in out else q(c) for c in names])


def add_indicator(df: DataFrame, cols: list[str]) -> DataFrame:
    """<c>_was_null, then the median (numbers) or mode (others) in place of nulls."""
    marked = df.withColumns({f"{c}_was_null": clean(df, c).isNull().cast("int") for c in cols})
    numbers = [c for c in cols if is_numeric(df, c)]
    return _filled(marked, medians(df, numbers) | modes(df, [c for c in cols if c not in numbers]))


def flag_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_null": clean(df, c).isNull().cast("int") for c in cols})
