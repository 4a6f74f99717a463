"""Plans for encoding, dates, scaling, selection and imbalance."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import clean, dtype, facts, is_numeric, is_string, numeric_columns, q, rows, scalar_columns
from lodeframe.operators.clean.scale import components
from lodeframe.operators.clean.times import PARTS
from lodeframe.operators.detect.findings import DEFINITIVE, JUDGMENT, Finding
from lodeframe.operators.ordered import median_step, steps
from lodeframe.operators.profile.columns import as_times, lowered
from lodeframe.operators.profile.numeric import adjusted_shape, box_facts, kde_points, moments, numbers
from lodeframe.operators.profile.relations import as_numbers, mutual_information_values, pearson_pairs, vif_values

# Names of cyclic columns with their periods, and words of ordered scales.
CYCLES = (
    (r"(month|mon)$", 12), (r"(day_of_week|dayofweek|dow|weekday)", 7), (r"(hour|hr)$", 24), (r"(minute|min)$", 60), (r"(second|sec)$", 60),
    (r"(quarter|qtr)$", 4), (r"(bearing|direction|heading|angle)", 360),
)
ORDERED_NAMES = (
    r"(rating|grade|level|tier|rank|stage|priority|severity|quality)", r"(satisfaction|experience|skill|education)", r"(low|medium|high|very|extremely)",
    r"(small|medium|large|xl|xxl)",
)
ORDERED_WORDS = (
    "low", "medium", "high", "very low", "very high", "poor", "fair", "good", "excellent", "outstanding", "none", "basic", "intermediate", "advanced", "expert",
    "small", "large", "xl", "xxl", "1", "2", "3", "4", "5",
)
TARGET_NAMES = ("target", "label", "class", "y", "outcome", "survived", "churn", "default", "fraud", "spam", "category")
SEVERITIES = ((1.5, "balanced"), (5, "mild"), (20, "moderate"), (100, "severe"))


# Encodings of columns with a mark, the first that holds; of others by the most values that an encoding is good for.
MARKED_ENCODINGS = {"cyclic": "cyclical_encode", "binary": "label_encode", "ordered": "ordinal_encode"}
SIZED_ENCODINGS = {20: "one_hot_encode", 100: "frequency_encode", 500: "binary_encode", 5000: "hash_encode"}
LARGE_ENCODING, LARGE_WITH_TARGET = "suggest_embedding", "target_encode"


def _encoding(distinct: int, marks: set[str], target: str | None) -> str:
    named = [e for mark, e in MARKED_ENCODINGS.items() if mark in marks]
    fits = sorted(most for most in SIZED_ENCODINGS if most >= distinct)
    if target and (not fits or fits[0] > 100):
        named.append(LARGE_WITH_TARGET)
    return [*named, *(SIZED_ENCODINGS[most] for most in fits), LARGE_ENCODING][0]


def encoding_plan(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, cardinality, strategy, period): text columns, and whole numbers of up to 20 values."""
    cols = [c for c in scalar_columns(df) if c != target and (is_string(df, c) or isinstance(dtype(df, c), T.IntegralType))]
    aggregates = {}
    for i, c in enumerate(cols):
        aggregates[f"u{i}"] = F.count_distinct(q(c))
        aggregates[f"w{i}"] = F.size(F.collect_set(F.when(lowered(q(c)).isin(*ORDERED_WORDS), lowered(q(c)))))
        if is_numeric(df, c):
            aggregates |= {f"lo{i}": F.min(q(c)), f"hi{i}": F.max(q(c))}
    got = facts(df, aggregates) if cols else {}
    found = []
    for i, c in enumerate(cols):
        u = got[f"u{i}"]
        if u < 2 or (is_numeric(df, c) and u > 20):
            continue
        cycle = next((p for w, p in CYCLES if re.search(w, c, re.IGNORECASE)), None) if is_numeric(df, c) else None
        if cycle and not (got[f"lo{i}"] >= 0 and got[f"hi{i}"] <= cycle):
            cycle = None
        ordered = any(re.search(w, c, re.IGNORECASE) for w in ORDERED_NAMES) or got[f"w{i}"] >= 2
        marks = {mark for mark, holds in {"cyclic": cycle, "binary": u == 2, "ordered": ordered}.items() if holds}
        found.append((c, u, _encoding(u, marks, target), cycle))
    return rows(df.sparkSession, found, "column string, cardinality long, strategy string, period int")


def time_like_columns(df: DataFrame) -> list[str]:
    """Columns of times, and texts of which over four fifths read as one."""
    texts = [c for c in scalar_columns(df) if is_string(df, c)]
    got = facts(df, {f"k{i}": F.count(q(c)) for i, c in enumerate(texts)} | {f"d{i}": F.count(as_times(df, c)) for i, c in enumerate(texts)}) if texts else {}
    parsed = {c for i, c in enumerate(texts) if got[f"k{i}"] and got[f"d{i}"] > 0.8 * got[f"k{i}"]}
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [c for c in scalar_columns(df) if isinstance(dtype(df, c), times) or c in parsed]


def datetime_plan(df: DataFrame) -> DataFrame:
    """(column, kind, name): parts and flags that differ between rows."""
    found = []
    names = ("year", "month", "quarter", "week", "day", "dayofweek", "hour", "minute", "second")
    for c in time_like_columns(df):
        t = as_times(df, c)
        got = facts(df, {p: F.count_distinct(PARTS[p](t)) for p in names} | {"n": F.count(t), "weekend": F.count_if(F.weekday(t) >= 5), "weekday": F.count_if(F.weekday(t) < 5)})
        if got["n"] < 2:
            continue
        parts = [p for p in names if got[p] > 1]
        parts += [n for p, n in (("month", "month_name"), ("dayofweek", "day_name")) if p in parts]
        flags = ["is_weekend"] if got["weekend"] and got["weekday"] else []
        for part, unit in (("month", "month"), ("quarter", "quarter"), ("year", "year")):
            if got[part] > 1:
                flags += [f"is_{unit}_start", f"is_{unit}_end"]
        found += [(c, "part", p) for p in parts] + [(c, "flag", f) for f in flags]
    return rows(df.sparkSession, found, "column string, kind string, name string")


def delta_plan(df: DataFrame, top: int = 3) -> DataFrame:
    """(earlier, later, mean, unit): neighbours among the time columns, ordered by their first value."""
    cols = time_like_columns(df)
    firsts = facts(df, {f"m{i}": F.min(F.unix_micros(as_times(df, c))) for i, c in enumerate(cols)}) if cols else {}
    order = [c for c in sorted(cols, key=lambda c: firsts[f"m{cols.index(c)}"] or 0)]
    found = []
    for a, b in zip(order, order[1:]):
        gap = (F.unix_micros(as_times(df, b)) - F.unix_micros(as_times(df, a))) / F.lit(1e6)
        f = facts(df, {"m": F.avg(gap), "lo": F.min(gap), "hi": F.max(gap)})
        if f["m"] is None or f["lo"] == f["hi"]:
            continue
        size, unit = next(((s, u) for s, u in ((86400.0, "days"), (3600.0, "hours"), (60.0, "minutes")) if abs(f["m"]) > s), (1.0, "seconds"))
        found.append((a, b, f["m"] / size, unit))
    return rows(df.sparkSession, found[:top], "earlier string, later string, mean double, unit string")


# Median steps below which a series has the granularity.
GRANULARITIES = ((2, "sub-second"), (120, "minutes"), (7200, "hours"), (172800, "daily"), (1209600, "weekly"))


def time_series_facts(df: DataFrame, c: str) -> dict | None:
    """Whether a column orders the table in time: at least 20 rows, four fifths of the steps upwards."""
    table = df.select(as_times(df, c).alias("t"))
    f = facts(table, {"n": F.count("t"), "u": F.count_distinct("t")})
    n, u = f["n"], f["u"]
    if n < 20 or (u - 1) / (n - 1) < 0.8:
        return None
    gaps = steps(table, "t")
    median = median_step(gaps, u, n)
    g = facts(gaps, {"s": F.sum("gap"), "s2": F.sum(F.col("gap") * F.col("gap"))})
    m = n - 1
    sd = math.sqrt(max(0.0, (g["s2"] - g["s"] ** 2 / m) / (m - 1)))
    cv = sd / median if median > 0 else math.inf
    grain = next((name for limit, name in GRANULARITIES if median < limit), "monthly+")
    return {"n": n, "rising": (u - 1) / m, "granularity": grain, "median_step": median, "cv": cv, "regular": cv < 0.1}


def is_time_series(df: DataFrame, c: str) -> DataFrame:
    f = time_series_facts(df, c)
    row = (c, f is not None, *([f[k] for k in ("n", "rising", "granularity", "median_step", "cv", "regular")] if f else [None] * 6))
    return rows(df.sparkSession, [row], "column string, time_series boolean, n long, rising double, granularity string, median_step double, cv double, regular boolean")


def peaks(df: DataFrame, c: str, points: int) -> list[float]:
    """Where the density of a column has its peaks, from left to right."""
    curve = kde_points(df, c, points, widen=0.0)
    return [curve[i][0] for i in range(1, len(curve) - 1) if curve[i][1] > curve[i - 1][1] and curve[i][1] > curve[i + 1][1]]


# Scalings by priority, and the ranges (least, most; open ends None, bounds excluded) that a column's measures must lie in.
SCALINGS = (
    ("binarize", {"peaks": (1, None)}), ("minmax_scale", {"below zero": (None, 0.5), "above one": (None, 0.5)}), ("maxabs_scale", {"zeros": (0.3, None)}),
    ("log1p_transform", {"skew": (2, None), "below zero": (None, 0.5)}), ("boxcox_transform", {"skew": (1, None), "least": (0, None)}), ("yeojohnson_transform", {"skew": (1, None)}),
    ("robust_scale", {"beyond": (5, None)}), ("robust_scale", {"kurtosis": (10, None)}), ("standard_scale", {}),
)
PEAK_ROWS, PEAK_VALUES = 20, 5


def _scaling(measures: dict[str, float]) -> str:
    def inside(ranges: dict) -> bool:
        return all((low is None or measures[m] > low) and (high is None or measures[m] < high) for m, (low, high) in ranges.items())

    return next(name for name, ranges in SCALINGS if inside(ranges))


def scaling_plan(df: DataFrame) -> DataFrame:
    """(column, strategy, skewness, kurtosis, outlier_pct) for every numeric column that varies."""
    cols = numeric_columns(df)
    table = numbers(df, cols)
    shapes, boxes = moments(table, cols), box_facts(df, cols)
    distinct = facts(table, {f"u{i}": F.count_distinct(q(c)) for i, c in enumerate(cols)}) if cols else {}
    found = []
    for i, c in enumerate(cols):
        m, u = shapes[c], distinct[f"u{i}"]
        if u < 2:
            continue
        skew, kurt = adjusted_shape(m["n"], m["skew"], m["kurt"])
        beyond = 100.0 * boxes[c]["outliers"] / m["n"] if boxes[c]["q3"] > boxes[c]["q1"] else 0.0
        measures = {
            "peaks": len(peaks(df, c, 100)) if m["n"] >= PEAK_ROWS and u > PEAK_VALUES else 0, "below zero": float(m["min"] < 0), "above one": float(m["max"] > 1),
            "zeros": m["zero"] / m["n"], "skew": abs(skew), "least": m["min"], "beyond": beyond, "kurtosis": kurt,
        }
        found.append((c, _scaling(measures), skew, kurt, beyond))
    return rows(df.sparkSession, found, "column string, strategy string, skewness double, kurtosis double, outlier_pct double")


def variance_plan(df: DataFrame, near: float = 0.95) -> DataFrame:
    """(column, action, top_pct): constant columns, and numbers one value of which holds over 95 % of the rows."""
    cols = scalar_columns(df)
    distinct = facts(df, {f"u{i}": F.count_distinct(clean(df, c)) for i, c in enumerate(cols)})
    found = [(c, "drop_zero_variance", 100.0) for i, c in enumerate(cols) if distinct[f"u{i}"] <= 1]
    live = [c for i, c in enumerate(cols) if distinct[f"u{i}"] > 1 and is_numeric(df, c)]
    if live:
        long = df.select(*[clean(df, c).cast("double").alias(c) for c in live]).unpivot([], live, "column", "value").where("value is not null")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        tops = counts.groupBy("column").agg((F.lit(100.0) * F.max("n") / F.sum("n")).alias("pct")).where(F.col("pct") > 100 * near)
        found += [(r["column"], "drop_near_zero_variance", round(r["pct"], 1)) for r in tops.collect()]
    return rows(df.sparkSession, found, "column string, action string, top_pct double")


def correlation_plan(df: DataFrame, least: float = 0.95, importance: dict[str, float] | None = None) -> DataFrame:
    """(col1, col2, correlation, drop): of two columns that say the same, the less important one."""
    cols = numeric_columns(df)
    known = df.select(*[c.alias(n) for n, c in as_numbers(df, cols).items()]).dropna()
    weight = importance or {}
    found = []
    for (a, b), (r, n) in pearson_pairs(known, {c: q(c) for c in cols}, list(combinations(cols, 2))).items():
        if r is not None and n >= 5 and abs(r) > least:
            found.append((a, b, round(abs(r), 4), b if weight.get(a, 50) >= weight.get(b, 50) else a))
    return rows(df.sparkSession, found, "col1 string, col2 string, correlation double, drop string")


def vif_plan(df: DataFrame, limit: float = 10.0) -> DataFrame:
    found = [(c, v) for c, v in vif_values(df, numeric_columns(df)).items() if v is None or v > limit]
    return rows(df.sparkSession, found, "column string, vif double")


def mi_plan(df: DataFrame, target: str, least: float = 0.01) -> DataFrame:
    """(column, mutual_information): numbers that tell nearly nothing about the target."""
    cols = [c for c in numeric_columns(df) if c != target]
    values = mutual_information_values(df, [*cols, target])
    found = [(c, values[(c, target)]) for c in cols if values[(c, target)] < least]
    return rows(df.sparkSession, found, "column string, mutual_information double")


def pca_plan(df: DataFrame) -> DataFrame:
    """(variance_pct, components, columns): components needed for 90, 95 and 99 % of the variance."""
    cols = numeric_columns(df)
    variances, _, _ = components(df, cols)
    share = np.cumsum(variances) / max(variances.sum(), 1e-300)
    found = [(p, int(np.argmax(share >= p / 100 - 1e-12)) + 1, len(cols)) for p in (90, 95, 99)]
    return rows(df.sparkSession, found, "variance_pct int, components int, columns int")


def feature_clusters(df: DataFrame, cut: float = 0.3) -> DataFrame:
    """(cluster, column, representative): columns joined by average distance 1 - |r| up to the cut.

    Correlations come from the whole table; joining the few columns is done on their matrix.
    """
    cols = numeric_columns(df)
    known = df.select(*[c.alias(n) for n, c in as_numbers(df, cols).items()]).dropna()
    r = pearson_pairs(known, {c: q(c) for c in cols}, list(combinations(cols, 2)))
    far = {frozenset(p): 1 - abs(v[0] or 0.0) for p, v in r.items()}
    groups = [[c] for c in cols]
    mean = lambda a, b: sum(far[frozenset((x, y))] for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        (i, j), d = min(((p, mean(groups[p[0]], groups[p[1]])) for p in combinations(range(len(groups)), 2)), key=lambda x: x[1])
        if d > cut:
            break
        groups[i] = groups[i] + groups.pop(j)
    found = [(k, c, c == g[0]) for k, g in enumerate(sorted((g for g in groups if len(g) > 1), key=lambda g: cols.index(g[0])), 1) for c in g]
    return rows(df.sparkSession, found, "cluster int, column string, representative boolean")


def find_target(df: DataFrame, target: str | None = None) -> str | None:
    """The named target, a column with a target's name, or a last text column of up to ten values."""
    cols = scalar_columns(df)
    named = [target] if target in cols else [c for c in cols if c.lower().strip() in TARGET_NAMES]
    for c in [*named, cols[-1]]:
        u = df.select(F.count_distinct(q(c))).first()[0]
        if c == target and (u <= 20 or not is_numeric(df, c)):
            return c
        if c in named and c != target and u <= 20:
            return c
        if c == cols[-1] and u <= 10 and is_string(df, c):
            return c
    return None


def imbalance_facts(df: DataFrame, target: str | None = None) -> dict | None:
    target = find_target(df, target)
    if target is None:
        return None
    sizes = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.count(F.lit(1)).alias("n"))
    found = facts(sizes, {"classes": F.count(F.lit(1)), "most": F.max("n"), "least": F.min("n"), "rows": F.sum("n")})
    if found["classes"] < 2:
        return None
    ratio = round(found["most"] / found["least"], 2)
    severity = next((name for limit, name in SEVERITIES if ratio < limit), "extreme")
    numeric = any(c != target for c in numeric_columns(df))
    texts = any(is_string(df, c) for c in scalar_columns(df) if c != target)
    strategy = {"extreme": "anomaly_framing", "severe": "smoteenn", "moderate": "smote_nc" if numeric and texts else "smote" if numeric else "random_oversample"}.get(severity, "class_weights")
    return {"target": target, "classes": found["classes"], "ratio": ratio, "severity": severity, "strategy": strategy, "rows": found["rows"]}


def imbalance_plan(df: DataFrame, target: str | None = None) -> DataFrame:
    f = imbalance_facts(df, target)
    found = [(f["target"], f["classes"], f["ratio"], f["severity"], f["strategy"])] if f else []
    return rows(df.sparkSession, found, "target string, classes int, ratio double, severity string, strategy string")


def feature_findings(df: DataFrame, target: str | None = None) -> list[Finding]:
    found = []
    for r in encoding_plan(df, target).collect():
        found.append(Finding([r["column"]], "categorical_encoding", r["strategy"], JUDGMENT, f"{r['cardinality']} values", 0, {"period": r["period"]} if r["period"] else {}))
    plan: dict[tuple, list[str]] = {}
    for r in datetime_plan(df).collect():
        plan.setdefault((r["column"], r["kind"]), []).append(r["name"])
    for (c, kind), names in plan.items():
        found.append(Finding([c], "datetime_engineering", "extract_datetime" if kind == "part" else "derive_datetime_flags", JUDGMENT, ", ".join(names), 0, {"components" if kind == "part" else "flags": names}))
    for r in delta_plan(df).collect():
        found.append(Finding([r["earlier"], r["later"]], "datetime_engineering", "compute_time_deltas", JUDGMENT, f"{r['mean']:.1f} {r['unit']} apart", 0, {"unit": r["unit"]}))
    for c in time_like_columns(df):
        if time_series_facts(df, c):
            found.append(Finding([c], "datetime_engineering", "time_series_features", JUDGMENT, "rows follow each other in time"))
    for r in scaling_plan(df).collect():
        found.append(Finding([r["column"]], "feature_scaling", r["strategy"], JUDGMENT, f"skewness {r['skewness']:.2f}"))
    for r in variance_plan(df).collect():
        sure = r["action"] == "drop_zero_variance"
        found.append(Finding([r["column"]], "feature_selection", r["action"], DEFINITIVE if sure else JUDGMENT, f"one value in {r['top_pct']} % of rows"))
    for r in correlation_plan(df).collect():
        found.append(Finding([r["drop"]], "feature_selection", "drop_high_correlation", JUDGMENT, f"{r['col1']} and {r['col2']} correlate at {r['correlation']}"))
    if len(numeric_columns(df)) > 1:
        for r in vif_plan(df).collect():
            found.append(Finding([r["column"]], "feature_selection", "drop_high_vif", JUDGMENT, f"variance inflation {r['vif']}"))
    f = imbalance_facts(df, target)
    if f and f["severity"] != "balanced":
        found.append(Finding([f["target"]], "class_imbalance", f["strategy"], JUDGMENT, f"{f['ratio']} to 1", f["rows"], {"severity": f["severity"]}))
    return found
