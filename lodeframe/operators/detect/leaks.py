"""Columns that know the target too well."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, correlation, facts, is_numeric, is_string, q, rows, scalar_columns
from lodeframe.operators.detect.features import time_like_columns
from lodeframe.operators.detect.findings import JUDGMENT, Finding
from lodeframe.operators.profile.columns import as_times

# Names that speak of the future, and names of IDs.
FUTURE = (
    r"(outcome|result|disposition|resolution|final|conclusion)", r"(follow[-_]?up|followup|next[-_]?step|response)",
    r"(cancel|churn|return|refund|complaint)[-_]?(date|time|at|ts)", r"(close|closed|resolved|completed|finished)[-_]?(date|time|at|ts)",
    r"(end[-_]?date|end[-_]?time|expiry|expiration)",
)
ID_NAMES = r"^(id|_id|row_?id|index|record_?id|entry_?id|seq|sequence|serial|number)$|([-_]id$|[-_]key$|[-_]num$)"
# Numbers of more values count by those that repeat, as a value that occurs once has one target anyway; these must hold half of the rows.
FEW_VALUES = 50
SCHEMA = "column string, kind string, score double"


def purity(df: DataFrame, c: str, target: str, least: int = 1) -> float | None:
    """Mean over the values of a column that occur `least` times or more of the share of their most frequent target, if they hold half of the rows."""
    cells = df.groupBy(q(c).cast("string").alias("v"), q(target).cast("string").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("v").agg((F.max("n") / F.sum("n")).alias("p"), F.sum("n").alias("rows"))
    enough = F.col("rows") >= least
    got = facts(per, {"p": F.avg(F.when(enough, F.col("p"))), "rows": F.sum("rows"), "counted": F.sum(F.when(enough, F.col("rows")))})
    targets = cells.select("t").distinct().limit(2).count()
    return got["p"] if targets > 1 and 2 * (got["counted"] or 0) >= got["rows"] else None


def perfect_predictors(df: DataFrame, target: str) -> DataFrame:
    """Numbers that correlate with the target at over .95, and columns each of whose values has one target."""
    found = []
    for c in scalar_columns(df):
        if c == target:
            continue
        if is_numeric(df, c) and is_numeric(df, target):
            r = facts(df, {"r": correlation(clean(df, c).cast("double"), clean(df, target).cast("double"))})["r"]
            if r is not None and abs(r) > 0.95:
                found.append((c, "correlation", round(abs(r), 4)))
                continue
        few = is_string(df, c) or facts(df, {"u": F.count_distinct(q(c))})["u"] <= FEW_VALUES
        p = purity(df, c, target, 1 if few else 2)
        if p is not None and p > 0.98:
            found.append((c, "purity", round(p, 4)))
    return rows(df.sparkSession, found, SCHEMA)


def temporal_proxies(df: DataFrame, target: str) -> DataFrame:
    """Times that order the target: a correlation of over .8, or class means more than a day apart."""
    times = [c for c in time_like_columns(df) if c != target]
    found = []
    for c in times if len(times) >= 2 else []:
        seconds = F.unix_micros(as_times(df, c)) / F.lit(1e6)
        if is_numeric(df, target):
            r = facts(df.where(seconds.isNotNull()), {"r": correlation(seconds, clean(df, target).cast("double"))})["r"]
            if r is not None and abs(r) > 0.8:
                found.append((c, "temporal", round(abs(r), 4)))
            continue
        means = df.where(seconds.isNotNull() & q(target).isNotNull()).groupBy(q(target)).agg(F.avg(seconds).alias("m"))
        f = facts(means, {"k": F.count(F.lit(1)), "u": F.count_distinct("m"), "lo": F.min("m"), "hi": F.max("m")})
        if f["k"] >= 2 and f["u"] == f["k"] and f["hi"] - f["lo"] > 86400:
            found.append((c, "temporal", 0.9))
    return rows(df.sparkSession, found, SCHEMA)


def id_leaks(df: DataFrame, target: str) -> DataFrame:
    """Numeric IDs that follow the target."""
    found = []
    for c in scalar_columns(df):
        if c == target or not is_numeric(df, c) or not re.search(ID_NAMES, c, re.IGNORECASE):
            continue
        f = facts(df, {"n": F.count(F.lit(1)), "u": F.count_distinct(q(c))})
        if f["u"] < 0.5 * f["n"]:
            continue
        if is_numeric(df, target):
            r = facts(df, {"r": correlation(q(c).cast("double"), clean(df, target).cast("double"))})["r"]
            if r is not None and abs(r) > 0.3:
                found.append((c, "id", round(abs(r), 4)))
            continue
        means = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.avg(q(c)).alias("m"))
        g = facts(means, {"s": F.stddev_samp("m"), "m": F.avg("m")})
        if g["m"] and g["s"] is not None and g["s"] / g["m"] > 0.1:
            found.append((c, "id", 0.5))
    return rows(df.sparkSession, found, SCHEMA)


def future_named(columns: list[str]) -> list[str]:
    return [c for c in columns if any(re.search(p, c, re.IGNORECASE) for p in FUTURE)]


def leakage(df: DataFrame, target: str) -> DataFrame:
    """(column, kind, score): all of the above, and columns whose names speak of the future."""
    found = perfect_predictors(df, target).unionByName(temporal_proxies(df, target)).unionByName(id_leaks(df, target))
    named = [(c, "future_name", None) for c in future_named(df.columns) if c != target]
    return found.unionByName(rows(df.sparkSession, named, SCHEMA))


def leak_findings(df: DataFrame, target: str | None) -> list[Finding]:
    if target is None:
        return []
    return [Finding([r["column"]], "data_leakage", "drop_leakage", JUDGMENT, f"{r['kind']} {r['score'] or ''}".strip()) for r in leakage(df, target).collect()]
