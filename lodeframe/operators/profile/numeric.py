"""Numbers: moments, quantiles, histograms, densities and Q-Q points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import words
from lodeframe.functions.columns import as_number, facts, is_numeric, q, rows
from lodeframe.functions.special import normal_quantile
from lodeframe.operators.ordered import values_at
from lodeframe.operators.quantiles import order_statistics, quantiles

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
BATCH = 6
MAX_BINS = 200
#: Bins of a bandwidth, and bandwidths after which a kernel is nought in doubles.
FINE_BINS, KDE_REACH = 64, 39.0
KDE_POINTS = 200


def number(df: DataFrame, c: str) -> Column:
    """The column as a double; texts lose their thousands separators and dollar signs first."""
    if is_numeric(df, c):
        return as_number(df, c)
    return F.trim(F.regexp_replace(q(c).cast("string"), r"[,$]", "")).try_cast("double")


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[number(df, c).alias(c) for c in cols])


def _batches(cols: list[str]):
    return [cols[i : i + BATCH] for i in range(0, len(cols), BATCH)]


def moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Counts, sums, means and population moments; some columns per aggregate."""
    found: dict[str, dict] = {}
    for batch in _batches(cols):
        aggregates = {}
        for i, c in enumerate(batch):
            x = q(c)
            aggregates |= {
                f"n{i}": F.count(x), f"min{i}": F.min(x), f"max{i}": F.max(x), f"sum{i}": F.sum(x), f"mean{i}": F.avg(x),
                f"sd{i}": F.stddev_samp(x), f"var{i}": F.var_samp(x), f"skew{i}": F.skewness(x), f"kurt{i}": F.kurtosis(x),
                f"logs{i}": F.avg(F.when(x > 0, F.ln(x))), f"inv{i}": F.avg(F.when(x > 0, F.lit(1.0) / x)),
                f"zero{i}": F.count_if(x == 0), f"neg{i}": F.count_if(x < 0), f"pos{i}": F.count_if(x > 0),
                f"whole{i}": F.count_if(x == F.floor(x)),
            }
        got = facts(df, aggregates)
        for i, c in enumerate(batch):
            found[c] = {k: got[f"{k}{i}"] for k in ("n", "min", "max", "sum", "mean", "sd", "var", "skew", "kurt", "logs", "inv", "zero", "neg", "pos", "whole")}
    return found


def adjusted_shape(n: int, skew: float | None, kurt: float | None) -> tuple[float, float]:
    """Sample-adjusted skewness and excess kurtosis from the population forms."""
    if n < 4 or skew is None or math.isnan(skew):
        return 0.0, 0.0
    g1 = skew * math.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return g1, g2


def trimmed_means(df: DataFrame, cols: list[str], counts: dict[str, int], share: float = 0.05) -> dict[str, float | None]:
    """Mean without the smallest and largest share of values, from the two cut values and one pass around them."""
    live = [c for c in cols if counts[c]]
    cut = {c: int(share * counts[c]) for c in live}
    ends = {c: (cut[c], counts[c] - cut[c] - 1) for c in live}
    stats = order_statistics(df, {c: {r: None for r in ends[c]} for c in live}, counts) if live else {}
    aggregates = {}
    for i, c in enumerate(live):
        lo, hi = stats[(c, ends[c][0])], stats[(c, ends[c][1])]
        aggregates |= {
            f"s{i}": F.sum(F.when((q(c) > lo) & (q(c) < hi), q(c))), f"le{i}": F.count_if(q(c) <= lo), f"lt{i}": F.count_if(q(c) < hi),
        }
    got = facts(df, aggregates) if aggregates else {}
    found: dict[str, float | None] = {c: None for c in cols}
    for i, c in enumerate(live):
        lo, hi = stats[(c, ends[c][0])], stats[(c, ends[c][1])]
        n, k = counts[c], cut[c]
        if lo == hi:
            found[c] = lo
            continue
        low, high = got[f"le{i}"] - k, (n - k) - got[f"lt{i}"]
        found[c] = ((got[f"s{i}"] or 0.0) + low * lo + high * hi) / (n - 2 * k)
    return found


def modes_of(df: DataFrame, c: str, most: int = 5) -> list[float]:
    """The most frequent values, smallest first, at most five."""
    counts = df.select(q(c).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    top = facts(counts, {"m": F.max("n")})["m"]
    if top is None:
        return []
    return [r["v"] for r in counts.where(F.col("n") == top).orderBy("v").limit(most).collect()]


def shape_words(skew: float, kurt: float) -> tuple[str, str]:
    size = abs(skew)
    lean = "symmetric" if size < 0.5 else "moderately_skewed" if size < 1.0 else "highly_skewed"
    tail = "mesokurtic" if abs(kurt) < 0.5 else "leptokurtic" if kurt > 0 else "platykurtic"
    return lean, tail


def numeric_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Everything below the plots, per column, as plain numbers."""
    table = numbers(df, cols)
    found = moments(table, cols)
    pct = quantiles(table, cols, [p / 100 for p in PERCENTILES])
    trimmed = trimmed_means(table, cols, {c: found[c]["n"] for c in cols})
    for c in cols:
        f = found[c]
        if not f["n"]:
            continue
        f["range"] = f["max"] - f["min"]
        f["trimmed_mean_5"] = trimmed[c]
        positive = f["pos"] == f["n"]
        f["geometric_mean"] = math.exp(f["logs"]) if positive else None
        f["harmonic_mean"] = 1.0 / f["inv"] if positive else None
        f["cv"] = abs(f["sd"] / f["mean"]) if f["mean"] and f["sd"] is not None else None
        f["skew"] = 0.0 if f["skew"] is None or math.isnan(f["skew"]) else f["skew"]
        f["kurt"] = 0.0 if f["kurt"] is None or math.isnan(f["kurt"]) else f["kurt"]
        f["skew_word"], f["kurt_word"] = shape_words(f["skew"], f["kurt"])
        f["percentiles"] = {f"p{p}": v for p, v in zip(PERCENTILES, pct[c])}
        f["iqr"] = f["percentiles"]["p75"] - f["percentiles"]["p25"]
    return found


METRICS = (
    "n", "min", "max", "range", "sum", "mean", "trimmed_mean_5", "geometric_mean", "harmonic_mean", "sd", "var", "cv", "skew",
    "kurt", "zero", "neg", "pos", "whole", "iqr",
)


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, metric, value) with the percentiles as p1 to p99."""
    found = []
    for c, f in numeric_facts(df, cols).items():
        for metric in METRICS:
            if f.get(metric) is not None:
                found.append((c, metric, float(f[metric])))
        found += [(c, k, v) for k, v in f.get("percentiles", {}).items()]
    return rows(df.sparkSession, found, "column string, metric string, value double")


def numeric_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    table = numbers(df, cols)
    return rows(df.sparkSession, [(c, v) for c in cols for v in modes_of(table, c)], "column string, value double")


def box_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Quartiles, whiskers (furthest values inside the fences) and how many values lie beyond."""
    table = numbers(df, cols)
    quarters = quantiles(table, cols, [0.25, 0.5, 0.75])
    live = [c for c in cols if quarters[c][0] is not None]
    aggregates = {}
    for i, c in enumerate(live):
        q1, _, q3 = quarters[c]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggregates |= {
            f"a{i}": F.min(F.when(q(c) >= lo, q(c))), f"b{i}": F.max(F.when(q(c) <= hi, q(c))),
            f"o{i}": F.count_if((q(c) < lo) | (q(c) > hi)), f"n{i}": F.count(q(c)),
        }
    got = facts(table, aggregates) if aggregates else {}
    return {
        c: {
            "q1": quarters[c][0], "median": quarters[c][1], "q3": quarters[c][2], "whisker_low": got[f"a{i}"],
            "whisker_high": got[f"b{i}"], "outliers": got[f"o{i}"], "n": got[f"n{i}"],
        }
        for i, c in enumerate(live)
    }


def box_plot(df: DataFrame, cols: list[str]) -> DataFrame:
    found = [(c, f["q1"], f["median"], f["q3"], f["whisker_low"], f["whisker_high"], f["outliers"]) for c, f in box_facts(df, cols).items()]
    return rows(df.sparkSession, found, "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long")


def box_outliers(df: DataFrame, c: str, shown: int | None = 100) -> DataFrame:
    """The outlying values to draw: the lowest and highest half of the list when it is long; None: all of them."""
    f = box_facts(df, [c]).get(c)
    x = number(df, c)
    if f is None:
        return df.select(x.alias("value")).where(F.lit(False))
    lo, hi = f["q1"] - 1.5 * (f["q3"] - f["q1"]), f["q3"] + 1.5 * (f["q3"] - f["q1"])
    beyond = df.select(x.alias("value")).where((F.col("value") < lo) | (F.col("value") > hi))
    if shown is None or f["outliers"] <= shown:
        return beyond
    low = beyond.orderBy("value").limit(shown // 2)
    return low.unionByName(beyond.orderBy(F.col("value").desc()).limit(shown - shown // 2))


def _equal_bins(table: DataFrame, c: str, lo: float, hi: float, bins: int) -> Column:
    if hi == lo:
        return F.when(q(c).isNotNull(), F.lit(0))
    at = F.floor((q(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins))
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def fd_histogram(df: DataFrame, c: str) -> DataFrame:
    """Bins by Freedman and Diaconis, at most 200; by Sturges where the quartiles coincide. Empty bins are kept."""
    table = numbers(df, [c])
    q25, q75 = quantiles(table, [c], [0.25, 0.75])[c]
    ends = facts(table, {"n": F.count(q(c)), "lo": F.min(q(c)), "hi": F.max(q(c))})
    n, lo, hi = ends["n"], ends["lo"], ends["hi"]
    schema = "bin int, low double, high double, count long"
    if not n:
        return rows(df.sparkSession, [], schema)
    if q75 > q25:
        bins = min(MAX_BINS, max(1, math.ceil((hi - lo) / (2 * (q75 - q25) * n ** (-1 / 3)))))
    else:
        bins = max(1, math.ceil(math.log2(n) + 1))
    start, stop = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    counts = table.where(q(c).isNotNull()).groupBy(_equal_bins(table, c, start, stop, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    got = {r["bin"]: r["n"] for r in counts.collect()}
    width = (stop - start) / bins
    return rows(df.sparkSession, [(b, start + b * width, start + (b + 1) * width, got.get(b, 0)) for b in range(bins)], schema)


def kde_points(df: DataFrame, c: str, points: int = KDE_POINTS, widen: float = 0.1, fine: int = FINE_BINS) -> list[tuple[float, float]]:
    """Gaussian density by Scott's rule at equally spaced points.

    Values are counted in bins of a small part of the bandwidth, so that far values make no bins coarser; empty ones do not exist. A bin adds
    to the points that its kernel reaches, by its rows' mean and variance.
    """
    table = numbers(df, [c]).where(q(c).isNotNull())
    f = facts(table, {"n": F.count(q(c)), "lo": F.min(q(c)), "hi": F.max(q(c)), "sd": F.stddev_samp(q(c))})
    if f["n"] < 5 or not f["sd"]:
        return []
    h = f["sd"] * f["n"] ** (-1 / 5)
    x = np.linspace(f["lo"] - widen * (f["hi"] - f["lo"]), f["hi"] + widen * (f["hi"] - f["lo"]), points)
    step = (x[-1] - x[0]) / (points - 1)
    cells = table.groupBy(F.floor((q(c) - F.lit(f["lo"])) / F.lit(h / fine)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(q(c)).alias("m"), F.var_pop(q(c)).alias("v"))
    place = lambda at, to: to((at - F.lit(float(x[0]))) / F.lit(step)).cast("int")
    first = F.greatest(F.lit(0), place(F.col("m") - KDE_REACH * h, F.ceil))
    last = F.least(F.lit(points - 1), place(F.col("m") + KDE_REACH * h, F.floor))
    reached = cells.where(first <= last).select("n", "m", "v", F.explode(F.sequence(first, last)).alias("point"))
    u = (F.lit(float(x[0])) + F.col("point") * F.lit(step) - F.col("m")) / F.lit(h)
    term = F.col("n") * F.exp(-0.5 * u * u) * (1 + (u * u - 1) * F.col("v") / F.lit(2 * h * h))
    got = {r["point"]: r["y"] for r in reached.groupBy("point").agg(F.sum(term).alias("y")).collect()}
    # Twelve digits, as the order of a sum must not make peaks.
    return [(float(p), float(f"{got.get(i, 0.0) / (f['n'] * h * math.sqrt(2 * math.pi)):.12g}")) for i, p in enumerate(x)]


def kde(df: DataFrame, c: str) -> DataFrame:
    found = [(i, x, y) for i, (x, y) in enumerate(kde_points(df, c))]
    return rows(df.sparkSession, found, "point int, x double, density double")


def qq(df: DataFrame, c: str, most: int = 500) -> DataFrame:
    """Sorted values against normal quantiles at the usual plotting positions, about 500 to 1000 of them."""
    n = facts(numbers(df, [c]), {"n": F.count(q(c))})["n"]
    schema = "rank long, theoretical double, sample double"
    if n < 20:
        return rows(df.sparkSession, [], schema)
    ranks = list(range(0, n, max(1, n // most)))
    values = values_at(numbers(df, [c]), c, ranks)
    end = 0.5 ** (1 / n)

    def position(i: int) -> float:
        if i in (0, n - 1):
            return end if i else 1 - end
        return (i + 1 - 0.3175) / (n + 0.365)

    return rows(df.sparkSession, [(i, normal_quantile(position(i)), values[i]) for i in ranks], schema)


def format_issues(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many texts of each column hold currency signs, thousands separators or percent signs."""
    got = facts(df, {f"{i}_{k}": F.count_if(q(c).rlike(p)) for i, c in enumerate(cols) for k, p in words.NUMBER_FORMATS.items()})
    found = [(c, k, got[f"{i}_{k}"]) for i, c in enumerate(cols) for k in words.NUMBER_FORMATS if got[f"{i}_{k}"]]
    return rows(df.sparkSession, found, "column string, issue string, count long")
