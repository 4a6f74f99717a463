"""Categories turned into numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, is_numeric, q
from lodeframe.operators.clean.rows import attach
from lodeframe.operators.ordered import positions_of_values

MAX_LEVELS = 1000


def levels(df: DataFrame, c: str, most: int = MAX_LEVELS) -> list:
    """The distinct values in order; refused above `most`, as each becomes a column."""
    values = df.select(clean(df, c).alias("v")).where("v is not null").distinct()
    found = [r["v"] for r in values.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{c} has over {most} values; one column each is too many")
    return sorted(found)


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Position in the sorted list of distinct values."""
    for c in cols:
        codes = positions_of_values(df, c).withColumnRenamed("value", c)
        names = df.columns
        joined = attach(df, codes, [c])
        df = joined.select(*[F.col("position").alias(x) if x == c else q(x) for x in names])
    return df


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = False, most: int = MAX_LEVELS) -> DataFrame:
    """One 0/1 column per level, named <c>_<level>, in place of the column."""
    for c in cols:
        kept = levels(df, c, most)[1 if drop_first else 0 :]
        flags = [F.coalesce(clean(df, c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}_{v}") for v in kept]
        df = df.select(*[q(x) for x in df.columns if x != c], *flags)
    return df


def frequency_encode(df: DataFrame, cols: list[str], proportion: bool = False) -> DataFrame:
    """How often the value occurs, as a count or as a share of the non-null rows."""
    for c in cols:
        counts = df.where(clean(df, c).isNotNull()).groupBy(clean(df, c).alias(c)).agg(F.count(F.lit(1)).alias("_n"))
        value = F.col("_n")
        if proportion:
            value = value / F.lit(float(df.where(clean(df, c).isNotNull()).count() or 1))
        names = df.columns
        joined = attach(df, counts, [c])
        df = joined.select(*[value.alias(x) if x == c else q(x) for x in names])
    return df


def ordinal_encode(df: DataFrame, cols: list[str], order: list | None = None) -> DataFrame:
    """Position in a given order; values outside it become null. Without one, as label_encode."""
    if order is None:
        return label_encode(df, cols)
    out = {}
    for c in cols:
        code: Column = F.lit(None).cast("int")
        for i, v in reversed(list(enumerate(order))):
            code = F.when(q(c) == F.lit(v), F.lit(i)).otherwise(code)
        out[c] = code
    return df.withColumns(out)


def target_encode(df: DataFrame, cols: list[str], target: str, method: str = "loo", key: str | None = None, folds: int = 5) -> DataFrame:
    """Mean target of the value's other rows (loo), or of its rows in the other folds (kfold).

    A group with no other row gets the mean of all rows. Only sums and counts per value are joined back.
    """
    y = clean(df, target).cast("double")
    overall = facts(df, {"m": F.avg(y)})["m"]
    for c in cols:
        names = df.columns
        if method == "loo":
            sums = df.groupBy(clean(df, c).alias(c)).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
            joined = attach(df, sums, [c])
            value = F.try_divide(F.col("_s") - y, F.col("_n") - 1)
        else:
            fold = F.pmod(F.xxhash64(q(key)), F.lit(folds)) if key else F.pmod(F.xxhash64(*[q(x) for x in names]), F.lit(folds))
            folded = df.withColumn("_fold", fold)
            sums = folded.groupBy(clean(df, c).alias(c), "_fold").agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
            whole = sums.groupBy(q(c)).agg(F.sum("_fs").alias("_s"), F.sum("_fn").alias("_n"))
            joined = attach(attach(folded, whole, [c]), sums, [c, "_fold"])
            value = F.try_divide(F.col("_s") - F.coalesce(F.col("_fs"), F.lit(0.0)), F.col("_n") - F.coalesce(F.col("_fn"), F.lit(0)))
        value = F.coalesce(F.when(q(c).isNotNull(), value), F.lit(overall))
        df = joined.select(*[value.alias(x) if x == c else q(x) for x in names])
    return df


def binary_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """The bits of the label code, lowest first; null has code 0."""
    for c in cols:
        n = df.select(F.count_distinct(clean(df, c))).first()[0]
        bits = math.ceil(math.log2(max(n, 2)))
        code = F.coalesce(q(c), F.lit(0)).cast("long")
        coded = label_encode(df, [c])
        flags = [F.shiftright(code, b).bitwiseAND(F.lit(1)).cast("int").alias(f"{c}_bit{b}") for b in range(bits)]
        df = coded.select(*[q(x) for x in df.columns if x != c], *flags)
    return df


def hash_encode(df: DataFrame, cols: list[str], n: int = 32) -> DataFrame:
    """One 0/1 column per hash bucket; null falls into bucket 0. The hash is the same in every run."""
    for c in cols:
        bucket = F.when(clean(df, c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(q(c).cast("string")), F.lit(n)))
        flags = [(bucket == b).cast("int").alias(f"{c}_hash_{b}") for b in range(n)]
        df = df.select(*[q(x) for x in df.columns if x != c], *flags)
    return df


def cyclical_encode(df: DataFrame, c: str, period: float) -> DataFrame:
    x = q(c) if is_numeric(df, c) else q(c).try_cast("double")
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    out = df.withColumns({f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)})
    return out.drop(c)
