"""How one version of a table differs from another."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, dtype, facts, is_numeric, rows
from lodeframe.functions.special import kolmogorov_tail
from lodeframe.operators.ordered import cumulative

BINS = 10
FLOOR = 1e-6
PSI_LIMIT = 0.2
LEAST = 5


def schema_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, column, before, after): columns added, removed or of another type, the shapes, and null rates off by over 5 points."""
    common = [c for c in a.columns if c in b.columns]
    got = []
    for df in (a, b):
        got.append(facts(df, {"n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(common)}))
    found = [("rows", None, str(got[0]["n"]), str(got[1]["n"])), ("columns", None, str(len(a.columns)), str(len(b.columns)))]
    found += [("added", c, None, dtype(b, c).simpleString()) for c in sorted(set(b.columns) - set(a.columns))]
    found += [("removed", c, dtype(a, c).simpleString(), None) for c in sorted(set(a.columns) - set(b.columns))]
    found += [("type", c, dtype(a, c).simpleString(), dtype(b, c).simpleString()) for c in common if dtype(a, c) != dtype(b, c)]
    for i, c in enumerate(common):
        rates = [100.0 * (g["n"] - g[f"k{i}"]) / g["n"] if g["n"] else 0.0 for g in got]
        if abs(rates[1] - rates[0]) > 5:
            found.append(("null_pct", c, f"{rates[0]:.2f}", f"{rates[1]:.2f}"))
    return rows(a.sparkSession, found, "change string, column string, before string, after string")


def psi_value(a: DataFrame, b: DataFrame, c: str) -> float | None:
    """Population stability index over ten equal bins of the joint range."""
    ends = [facts(df, {"lo": F.min(clean(df, c)).cast("double"), "hi": F.max(clean(df, c)).cast("double"), "n": F.count(clean(df, c))}) for df in (a, b)]
    if any(e["n"] == 0 for e in ends):
        return None
    lo, hi = min(e["lo"] for e in ends), max(e["hi"] for e in ends)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    shares = []
    for df, e in zip((a, b), ends):
        x = clean(df, c).cast("double")
        at = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))
        counts = {r["b"]: r["n"] for r in df.where(x.isNotNull()).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        shares.append([max(counts.get(i, 0) / e["n"], FLOOR) for i in range(BINS)])
    return sum((q - p) * math.log(q / p) for p, q in zip(*shares))


def psi(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    return rows(a.sparkSession, [(c, psi_value(a, b, c))], "column string, psi double")


def ks_2samp_values(a: DataFrame, b: DataFrame, c: str) -> tuple[float, float]:
    """(largest distance, p) of two samples, from counted values with running totals of both."""
    sides = []
    for side, df in (("a", a), ("b", b)):
        x = clean(df, c).cast("double").alias("v")
        sides.append(df.select(x, F.lit(int(side == "a")).alias("a"), F.lit(int(side == "b")).alias("b")).where("v is not null"))
    counts = sides[0].unionByName(sides[1]).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    running = cumulative(counts, "v", ["a", "b"])
    gap = F.abs(F.col("cum_a") / F.col("total_a") - F.col("cum_b") / F.col("total_b"))
    f = facts(running, {"d": F.max(gap), "na": F.max("total_a"), "nb": F.max("total_b")})
    n = f["na"] * f["nb"] / (f["na"] + f["nb"])
    root = math.sqrt(n)
    return f["d"], min(1.0, max(0.0, kolmogorov_tail((root + 0.12 + 0.11 / root) * f["d"])))


def ks_2samp(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    return rows(a.sparkSession, [(c, *ks_2samp_values(a, b, c))], "column string, statistic double, p_value double")


def distribution_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per common numeric column: stability index, KS test, means and whether it drifted; worst first."""
    found = []
    for c in a.columns:
        if c not in b.columns or not (is_numeric(a, c) and is_numeric(b, c)):
            continue
        means = [facts(df, {"m": F.avg(clean(df, c).cast("double")), "n": F.count(clean(df, c))}) for df in (a, b)]
        if any(m["n"] < LEAST for m in means):
            continue
        index, (d, p) = psi_value(a, b, c), ks_2samp_values(a, b, c)
        ma, mb = means[0]["m"], means[1]["m"]
        found.append((c, round(index, 4), round(d, 4), round(p, 6), index > PSI_LIMIT or p < 0.05, round(ma, 4), round(mb, 4), round(mb - ma, 4)))
    found.sort(key=lambda f: (-f[1], f[0]))
    schema = "column string, psi double, ks_statistic double, ks_pvalue double, drift_detected boolean, mean_a double, mean_b double, mean_shift double"
    return rows(a.sparkSession, found, schema)


def drift_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(section, column, metric, value, text): schema, shape, nulls, distributions and the change of quality."""
    from lodeframe.operators.insight import quality_facts

    found = [("schema", r["column"], r["change"], None, f"{r['before']} to {r['after']}") for r in schema_drift(a, b).collect()]
    for r in distribution_drift(a, b).collect():
        for metric in ("psi", "ks_statistic", "ks_pvalue", "mean_a", "mean_b", "mean_shift"):
            found.append(("distribution", r["column"], metric, r[metric], None))
        found.append(("distribution", r["column"], "drift_detected", float(r["drift_detected"]), None))
    before, after = quality_facts(a), quality_facts(b)
    found.append(("quality", None, "delta", round(after["overall"] - before["overall"], 2), f"{before['grade']} to {after['grade']}"))
    return rows(a.sparkSession, found, "section string, column string, metric string, value double, text string")
