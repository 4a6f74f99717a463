"""Fences, winsorising, caps and logarithms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, q
from lodeframe.operators.quantiles import quantiles

# Legal ranges by column name.
BUSINESS_RULES = (
    (r"(age|years_old)", 0, 150, "age"),
    (r"(percent|pct|ratio)", 0, 100, "percentage"),
    (r"(price|cost|amount|salary|income|revenue|fee)", 0, None, "monetary (non-negative)"),
    (r"(count|quantity|qty|num_|number_of)", 0, None, "count (non-negative)"),
    (r"(weight|mass)", 0, None, "weight (non-negative)"),
    (r"(height|length|width|distance)", 0, None, "dimension (non-negative)"),
    (r"(temperature|temp)", -100, 60, "temperature (°C)"),
    (r"(latitude|lat)", -90, 90, "latitude"),
    (r"(longitude|lon|lng)", -180, 180, "longitude"),
    (r"(rating|score|grade)", 0, None, "rating (non-negative)"),
    (r"(probability|prob)", 0, 1, "probability"),
)


def business_rule(column: str) -> tuple[float | None, float | None, str] | None:
    """The first rule whose words are in the column's name."""
    for words, lo, hi, label in BUSINESS_RULES:
        if re.search(words, column, re.IGNORECASE):
            return lo, hi, label
    return None


def fences(df: DataFrame, cols: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Quartiles minus and plus a multiple of their distance; columns without spread are left out."""
    found = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None and q3 > q1:
            found[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return found


def _clip(c: Column, lo, hi) -> Column:
    low = c if lo is None else F.greatest(c, F.lit(float(lo)))
    high = low if hi is None else F.least(low, F.lit(float(hi)))
    return F.when(c.isNotNull(), high)


def flag_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    marks = {}
    for c, (lo, hi) in fences(df, cols).items():
        x = clean(df, c)
        marks[f"{c}_is_outlier"] = F.coalesce((x < lo) | (x > hi), F.lit(False)).cast("int")
    return df.withColumns(marks) if marks else df


def remove_outliers(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """Rows inside the fences; rows with null there go too. Each column's fences see the rows its predecessors left."""
    for c in cols:
        for name, (lo, hi) in fences(df, [c], factor).items():
            x = clean(df, name)
            df = df.where((x >= lo) & (x <= hi))
    return df


def winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    limits = quantiles(df, cols, [lo, hi])
    return df.withColumns({c: _clip(clean(df, c).cast("double"), *limits[c]) for c in cols})


def cap_outliers(df: DataFrame, cols: list[str], rule: bool = False) -> DataFrame:
    """Values moved to the fences, or with `rule` to the legal range that the column's name stands for."""
    if rule:
        limits = {c: business_rule(c)[:2] for c in cols if business_rule(c)}
    else:
        limits = {}
        for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75]).items():
            if q1 is not None:
                limits[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return df.withColumns({c: _clip(clean(df, c).cast("double"), *v) for c, v in limits.items()}) if limits else df


def log_transform(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p, moved up by |min| + 1 where the smallest value is not positive."""
    low = facts(df, {c: F.min(clean(df, c)) for c in cols})
    out = {}
    for c in cols:
        shift = abs(float(low[c])) + 1 if low[c] is not None and low[c] <= 0 else 0.0
        out[c] = F.log1p(clean(df, c) + F.lit(shift))
    return df.withColumns(out)
