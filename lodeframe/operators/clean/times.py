"""Date parts, flags, durations and time-series features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import facts, no_nan, q
from lodeframe.operators.ordered import in_blocks, with_position

SECONDS = {"days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}
LAGS = (1, 3, 7)
MEANS = (7, 14, 30)

PARTS = {
    "year": F.year, "month": F.month, "month_name": lambda c: F.date_format(c, "MMMM"), "quarter": F.quarter, "week": F.weekofyear,
    "day": F.dayofmonth, "dayofweek": F.weekday, "day_name": lambda c: F.date_format(c, "EEEE"), "hour": F.hour, "minute": F.minute,
    "second": lambda c: F.second(c),
}


def _flag(name: str, c: Column) -> Column:
    day = F.to_date(c)
    tomorrow = F.date_add(day, 1)
    tests = {
        "is_weekend": F.weekday(day) >= 5,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": F.dayofmonth(tomorrow) == 1,
        "is_quarter_start": (F.dayofmonth(day) == 1) & (F.month(day) % 3 == 1),
        "is_quarter_end": (F.dayofmonth(tomorrow) == 1) & (F.month(tomorrow) % 3 == 1),
        "is_year_start": F.dayofyear(day) == 1,
        "is_year_end": F.dayofyear(tomorrow) == 1,
    }
    return F.coalesce(tests[name], F.lit(False)).cast("int")


FLAGS = ("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end")


def extract_datetime(df: DataFrame, cols: list[str], parts: list[str] | None = None) -> DataFrame:
    return df.withColumns({f"{c}_{p}": PARTS[p](q(c)) for c in cols for p in parts or list(PARTS)})


def datetime_flags(df: DataFrame, cols: list[str], flags: list[str] | None = None) -> DataFrame:
    return df.withColumns({f"{c}_{f}": _flag(f, q(c)) for c in cols for f in flags or list(FLAGS)})


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def elapsed(df: DataFrame, c: str, unit: str = "days") -> DataFrame:
    """Time since the column's earliest value."""
    first = facts(df, {"m": F.min(F.unix_micros(q(c).cast("timestamp")))})["m"]
    since = (F.unix_micros(q(c).cast("timestamp")) - F.lit(first)) / F.lit(1e6)
    return df.withColumn(f"{c}_elapsed_{unit}", since / F.lit(SECONDS[unit]))


def time_delta(df: DataFrame, a: str, b: str, unit: str = "days") -> DataFrame:
    gap = (F.unix_micros(q(b).cast("timestamp")) - F.unix_micros(q(a).cast("timestamp"))) / F.lit(1e6)
    return df.withColumn(f"{b}_minus_{a}_{unit}", gap / F.lit(SECONDS[unit]))


def ts_features(df: DataFrame, dt: str, cols: list[str], key: str, mode: str = "full", partition: list[str] | None = None) -> DataFrame:
    """Lags 1/3/7, trailing means over 7/14/30 rows and lead 1, in time order.

    Rows are laid out in equal blocks with 30 rows of their predecessors, so the time order never meets in one task.
    Trailing means are left out where the table has no more rows than the window.
    """
    rows = df.count()
    placed = with_position(no_nan(df), dt, key, partition)
    spread, w = in_blocks(placed, max(MEANS) - 1, 1, partition)
    out = {}
    for c in cols:
        if mode in ("full", "lags_only"):
            out |= {f"{c}_lag{k}": F.lag(q(c), k).over(w) for k in LAGS}
        if mode in ("full", "rolling_only"):
            out |= {f"{c}_roll_mean_{k}": F.avg(q(c)).over(w.rowsBetween(1 - k, 0)) for k in MEANS if rows > k}
        if mode == "full":
            out[f"{c}_lead1"] = F.lead(q(c), 1).over(w)
    return spread.withColumns(out).where("_home").drop("_home", "_block", "_pos")
