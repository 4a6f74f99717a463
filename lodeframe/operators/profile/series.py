"""Classical decomposition of a time series into trend, season and rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, q
from lodeframe.operators.clean.rows import interpolate
from lodeframe.operators.ordered import in_blocks

# The calendar step of a series and the length of its season in steps.
STEPS = {"day": (86400, 7), "hour": (3600, 24)}


def resample(df: DataFrame, t: str, v: str, step: str) -> DataFrame:
    """(p, value): means per calendar step, steps without rows filled on straight lines."""
    seconds, _ = STEPS[step]
    means = df.where(clean(df, v).isNotNull()).groupBy(F.date_trunc(step, q(t)).cast("timestamp").alias("p")).agg(F.avg(clean(df, v).cast("double")).alias("value"))
    ends = facts(means, {"lo": F.min(F.unix_seconds("p")), "hi": F.max(F.unix_seconds("p"))})
    if ends["lo"] is None:
        return means
    calendar = df.sparkSession.range(ends["lo"], ends["hi"] + 1, seconds).select(F.timestamp_seconds("id").alias("c"))
    joined = calendar.join(means, F.col("c") == F.col("p"), "left").select(F.col("c").alias("p"), "value")
    return interpolate(joined.withColumn("k", F.unix_seconds("p")), ["value"], "p", "k").drop("k")


def decompose(df: DataFrame, t: str, v: str, step: str | None = None, period: int | None = None) -> DataFrame:
    """(p, value, trend, seasonal, residual): centred moving average, mean per phase, and what is left.

    Days with a weekly season for series of over seventy days, else hours with a daily one. The ends, where the average
    has no full season around it, take the average of what there is.
    """
    if step is None:
        span = facts(df, {"d": (F.max(F.unix_micros(q(t).cast("timestamp"))) - F.min(F.unix_micros(q(t).cast("timestamp")))) / F.lit(86400e6)})["d"]
        step = "day" if (span or 0) > 70 else "hour"
    seconds, usual = STEPS[step]
    period = period or usual
    series = resample(df, t, v, step)
    first = facts(series, {"lo": F.min(F.unix_seconds("p"))})["lo"]
    placed = series.withColumn("_pos", ((F.unix_seconds("p") - F.lit(first)) / seconds).cast("long"))
    half = period // 2
    spread, w = in_blocks(placed, half, half)
    if period % 2:
        trend = F.avg("value").over(w.rowsBetween(-half, half))
    else:
        inner, outer = w.rowsBetween(1 - half, half - 1), w.rowsBetween(-half, half)
        full = F.count("value").over(outer) == period + 1
        weighted = (F.sum("value").over(inner) + F.sum("value").over(outer)) / (2 * period)
        trend = F.when(full, weighted).otherwise(F.avg("value").over(outer))
    smooth = spread.withColumn("trend", trend).where("_home").withColumn("_phase", F.pmod("_pos", F.lit(period)))
    phases = smooth.groupBy("_phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_s"))
    level = phases.agg(F.avg("_s")).first()[0] or 0.0
    seasons = phases.select(F.col("_phase").alias("_ph"), (F.col("_s") - F.lit(level)).alias("seasonal"))
    out = smooth.join(F.broadcast(seasons), F.col("_phase") == F.col("_ph"))
    return out.select("p", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))
