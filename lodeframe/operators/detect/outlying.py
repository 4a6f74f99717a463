"""Outlying values of one column, and outlying rows of many."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, dtype, facts, numeric_columns, q, rows, scalar_columns
from lodeframe.operators.clean.outliers import business_rule
from lodeframe.operators.clean.scale import standardised
from lodeframe.operators.detect.findings import JUDGMENT, Finding
from lodeframe.operators.neighbours import nearest, within
from lodeframe.operators.moving import moving_median
from lodeframe.operators.ordered import BLOCK, with_position
from lodeframe.operators.profile.numeric import adjusted_shape, moments, numbers
from lodeframe.operators.quantiles import medians, quantiles
from lodeframe.session import cut as kept

CONTAMINATION = 0.05
TREES, TREE_ROWS = 100, 256


def column_stats(df: DataFrame, c: str) -> dict:
    m = moments(numbers(df, [c]), [c])[c]
    q1, mid, q3 = quantiles(df, [c], [0.25, 0.5, 0.75])[c]
    skew, kurt = adjusted_shape(m["n"], m["skew"], m["kurt"])
    return m | {"q1": q1, "median": mid, "q3": q3, "skew": skew, "kurt": kurt}


def _found(df: DataFrame, c: str, key: str, method, score) -> DataFrame:
    return df.select(q(key).alias("key"), clean(df, c).cast("double").alias("value"), method.alias("method"), score.alias("score"))


def outliers(df: DataFrame, c: str, method: str, key: str, order: str | None = None, stats: dict | None = None, window: int | None = None) -> DataFrame:
    """(key, value, method, score) by iqr, zscore, mad, envelope or business_rule."""
    x = clean(df, c).cast("double")
    if method == "envelope":
        return envelope(df, c, key, order, window)
    if method == "business_rule":
        lo, hi, label = business_rule(c) or (None, None, None)
        beyond = (x < lo if lo is not None else F.lit(False)) | (x > hi if hi is not None else F.lit(False))
        return _found(df.where(beyond), c, key, F.lit("business_rule"), F.lit(None).cast("double"))
    s = stats or column_stats(df, c)
    if not s["n"]:
        return _found(df.where(F.lit(False)), c, key, F.lit(method), F.lit(0.0))
    if method == "iqr":
        spread = s["q3"] - s["q1"]
        if spread == 0:
            return _found(df.where(F.lit(False)), c, key, F.lit(method), F.lit(0.0))
        beyond = lambda k: (x < s["q1"] - k * spread) | (x > s["q3"] + k * spread)
        name = F.when(beyond(3.0), "iqr_extreme").otherwise("iqr_mild")
        return _found(df.where(beyond(1.5)), c, key, name, F.round(F.abs(x - s["median"]) / spread, 2))
    if method == "zscore":
        z = (x - F.lit(s["mean"])) / F.lit(s["sd"] or None)
        return _found(df.where(F.abs(z) > 3.0), c, key, F.lit("zscore"), F.round(z, 2))
    if method == "mad":
        mad = medians(df.select(F.abs(x - F.lit(s["median"])).alias("d")), ["d"])["d"]
        z = F.lit(0.6745) * (x - F.lit(s["median"])) / F.lit(mad or None)
        return _found(df.where(F.abs(z) > 3.5), c, key, F.lit("modified_zscore"), F.round(z, 2))
    raise ValueError(f"unknown method {method}")


def envelope(df: DataFrame, c: str, key: str, order: str, window: int | None = None, rows: int = BLOCK) -> DataFrame:
    """Values beyond 2.5 deviations from the median of the window around them, in the order of a column.

    The window is a twentieth of the rows, at least seven, unless one is given; `rows` are the least of a cell that a task works on.
    """
    known = df.select(q(key).alias("key"), clean(df, c).cast("double").alias("value"), q(order).alias("at")).where("value is not null")
    window = window or max(7, known.count() // 20)
    found = moving_median(with_position(known, "at", "key"), window // 2, (window - 1) // 2, rows)
    beyond = (F.col("value") > F.col("median") + 2.5 * F.col("sd")) | (F.col("value") < F.col("median") - 2.5 * F.col("sd"))
    return found.where((F.col("size") >= 3) & beyond).select("key", "value", F.lit("envelope").alias("method"), F.lit(None).cast("double").alias("score"))


def all_outliers(df: DataFrame, c: str, key: str, order: str | None = None, stats: dict | None = None) -> DataFrame:
    """Every method that suits the column: z-scores when it is fairly symmetric, modified ones when it is skewed."""
    s = stats or column_stats(df, c)
    found = outliers(df, c, "iqr", key, stats=s)
    found = found.unionByName(outliers(df, c, "zscore" if abs(s["skew"]) < 1 else "mad", key, stats=s))
    if order:
        found = found.unionByName(envelope(df, c, key, order))
    if business_rule(c):
        found = found.unionByName(outliers(df, c, "business_rule", key))
    return found


def score_outliers(df: DataFrame, c: str, key: str, order: str | None = None, stats: dict | None = None) -> DataFrame:
    """(key, value, methods, likelihood, likely_error): the methods of each row merged into one error likelihood.

    The mean of its deviations over ten, the number of methods over four, .8 for a broken rule, and its distance from the
    median over half the range; each of them at most 1.
    """
    s = stats or column_stats(df, c)
    merged = all_outliers(df, c, key, order, s).groupBy("key", "value").agg(
        F.sort_array(F.collect_set("method")).alias("methods"),
        F.max(F.when(F.col("method").startswith("iqr"), F.col("score"))).alias("i"),
        F.max(F.when(F.col("method") == "zscore", F.abs("score"))).alias("z"),
        F.max(F.when(F.col("method") == "modified_zscore", F.abs("score"))).alias("m"),
    )
    parts = [(F.col(k).isNotNull(), F.least(F.col(k) / 10, F.lit(1.0))) for k in ("i", "z", "m")]
    parts.append((F.lit(True), F.least(F.size("methods") / 4, F.lit(1.0))))
    parts.append((F.array_contains("methods", "business_rule"), F.lit(0.8)))
    if s["n"] and s["max"] > s["min"]:
        parts.append((F.lit(True), F.least(2 * F.abs(F.col("value") - F.lit(s["median"])) / F.lit(s["max"] - s["min"]), F.lit(1.0))))
    total = sum(F.when(test, v).otherwise(0.0) for test, v in parts)
    count = sum(test.cast("int") for test, _ in parts)
    likelihood = F.round(total / count, 3)
    return merged.select("key", "value", "methods", likelihood.alias("likelihood"), (likelihood > 0.6).alias("likely_error"))


# Treatments by priority, and between which limits the measures of a column's outliers must lie for each.
NONE, ANY = float("-inf"), float("inf")
TREATMENTS = (
    ("replace_boundary", {"by rule": (0, ANY), "errors": (0.8, ANY)}), ("remove_outlier_rows", {"errors": (0.7, ANY), "share of rows": (NONE, 0.02)}),
    ("winsorize", {"errors": (0.3, ANY)}), ("log_transform", {"skew": (2.0, ANY), "least": (0, ANY)}), ("flag_outlier", {}),
)


def treatment(scored: DataFrame, n: int, stats: dict) -> tuple[str, int]:
    """What to do with the outliers of a column, and how many there are."""
    f = facts(scored, {"t": F.count(F.lit(1)), "e": F.count_if("likely_error"), "r": F.count_if(F.array_contains("methods", "business_rule"))})
    if not f["t"]:
        return "none", 0
    measures = {"by rule": f["r"], "errors": f["e"] / f["t"], "share of rows": f["t"] / n, "skew": stats["skew"], "least": stats["min"]}
    return next(name for name, limits in TREATMENTS if all(low < measures[m] < high for m, (low, high) in limits.items())), f["t"]


# rows of many columns


def vectors(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(id, v): standardised numbers of the rows that know all of them."""
    known = df.where(sum((clean(df, c).isNull().cast("int") for c in cols), F.lit(0)) == 0)
    z = standardised(known, cols)
    return known.select(q(key).alias("id"), F.array(*[z[c] for c in cols]).alias("v"))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """One isolation tree as flat arrays; leaves hold their depth plus the mean depth their rows would still need."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}

    def node(at: np.ndarray, depth: int) -> int:
        i = len(tree["feature"])
        for k in tree:
            tree[k].append(0)
        spread = np.ptp(at, axis=0) if len(at) > 1 else np.zeros(x.shape[1])
        open_columns = np.flatnonzero(spread > 0)
        if depth >= limit or not len(open_columns):
            tree["feature"][i], tree["depth"][i] = -1, depth + _mean_depth(len(at))
            return i
        f = int(rng.choice(open_columns))
        cut = float(rng.uniform(at[:, f].min(), at[:, f].max()))
        below = at[:, f] < cut
        tree["feature"][i], tree["cut"][i] = f, cut
        tree["left"][i] = node(at[below], depth + 1)
        tree["right"][i] = node(at[~below], depth + 1)
        return i

    node(x, 0)
    return tree


def _mean_depth(n: int) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_scores(points: DataFrame, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 42) -> DataFrame:
    """(id, score): how easily random cuts set a row apart.

    Each tree grows in its own task from the 256 rows of least hash; the hundred small trees go to every task that scores rows.
    A share of the rows that should hold them is drawn, and a larger one should a tree get too few.
    """
    n = points.count()
    draw = lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 62))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id"]).head(sample)
        x = np.array(part["v"].tolist(), dtype=float)
        tree = _grow(x, np.random.default_rng(seed + int(part["tree"].iloc[0])), math.ceil(math.log2(max(sample, 2))))
        return pd.DataFrame([{"tree": int(part["tree"].iloc[0]), "rows": len(x), **tree}])

    schema = "tree int, rows int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
    share, grown = 1.5 * sample / max(n, 1), []
    while n and (len(grown) < trees or min(t["rows"] for t in grown) < min(sample, n)):
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(min(1 << 62, int(share * (1 << 62)))))
        drawn = points.withColumn("tree", F.explode(chosen)).withColumn("h", draw(F.col("tree")))
        grown = drawn.select("id", "v", "tree", "h").groupBy("tree").applyInPandas(grow, schema).collect()
        share *= 4
    forest = [{k: np.array(t[k]) for k in ("feature", "cut", "left", "right", "depth")} for t in grown]
    usual = _mean_depth(max((t["rows"] for t in grown), default=2))
    shared = points.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float)
        total = np.zeros(len(x))
        rows_ = np.arange(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = t["feature"][at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows_, np.maximum(f, 0)] < t["cut"][at]
                at = np.where(inner, np.where(below, t["left"][at], t["right"][at]), at)
            total += t["depth"][at]
        return pd.Series(2.0 ** (-total / max(len(shared.value), 1) / max(usual, 1e-12)))

    return points.select("id", score("v").alias("score"))


def _worst(scored: DataFrame, share: float) -> DataFrame:
    """Rows whose score lies above the quantile that leaves that share."""
    scored = kept(scored)  # read by every round of the quantile
    cut = quantiles(scored, ["score"], [1 - share])["score"][0]
    return scored.where(F.col("score") > F.lit(cut))


def isolation_forest(df: DataFrame, cols: list[str], key: str, share: float = CONTAMINATION) -> DataFrame:
    return _worst(isolation_scores(vectors(df, cols, key)), share)


def lof_scores(points: DataFrame, k: int = 20) -> DataFrame:
    """(id, score): how much thinner the surroundings of a row are than those of its neighbours."""
    near = kept(nearest(points, points, k, other=True).select("id", "neighbour", "distance"))
    reach = near.groupBy(F.col("id").alias("neighbour")).agg(F.max("distance").alias("reach"))
    dense = near.join(reach, "neighbour").groupBy("id").agg((1 / (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("density"))
    theirs = dense.select(F.col("id").alias("neighbour"), F.col("density").alias("theirs"))
    mean = near.join(theirs, "neighbour").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    return mean.join(dense, "id").select("id", (F.col("theirs") / F.col("density")).alias("score"))


def lof(df: DataFrame, cols: list[str], key: str, k: int = 20, share: float = CONTAMINATION) -> DataFrame:
    return _worst(lof_scores(vectors(df, cols, key), k), share)


def dbscan_noise(df: DataFrame, cols: list[str], key: str, eps: float = 2.0, least: int = 5) -> DataFrame:
    """Rows with too few rows near them, and none of those near them crowded either."""
    points = vectors(df, cols, key)
    joined = kept(points.join(within(points, points, eps, enough=least), "id"))
    core, thin = joined.where(F.col("n") >= least).select("id", "v"), joined.where(F.col("n") < least).select("id", "v")
    return within(thin, core, eps, enough=1).where("n = 0").select("id")


def multivariate_outliers(df: DataFrame, cols: list[str] | None, key: str) -> DataFrame:
    """(id, methods): rows that at least two of the three methods call outlying."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    found = None
    for name, part in (("isolation_forest", isolation_forest(df, cols, key)), ("lof", lof(df, cols, key)), ("dbscan", dbscan_noise(df, cols, key))):
        named = part.select("id", F.lit(name).alias("method"))
        found = named if found is None else found.unionByName(named)
    return found.groupBy("id").agg(F.sort_array(F.collect_set("method")).alias("methods")).where(F.size("methods") >= 2)


def outlier_findings(df: DataFrame, key: str | None, order: str | None = None) -> list[Finding]:
    """One finding per numeric column with outliers. Without a key column rows cannot be named, so only values count."""
    found, n = [], df.count()
    keyed = df if key else df.withColumn("_key", F.xxhash64(*[q(c) for c in scalar_columns(df)]))
    for c in numeric_columns(df):
        if c == key:
            continue
        stats = column_stats(df, c)
        if stats["n"] < 10:
            continue
        scored = score_outliers(keyed, c, key or "_key", order, stats)
        action, total = treatment(scored, n, stats)
        if total:
            found.append(Finding([c], "outliers", action, JUDGMENT, f"{total} outlying values", total))
    return found


def outlier_plan(df: DataFrame, key: str | None = None) -> DataFrame:
    found = [(f.columns[0], f.action, f.rows) for f in outlier_findings(df, key)]
    return rows(df.sparkSession, found, "column string, action string, outliers long")
