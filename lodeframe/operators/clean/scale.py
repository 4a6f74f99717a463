"""Scaling, power transforms, quantile transforms and principal components."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, is_numeric, q
from lodeframe.operators.ordered import many_quantiles
from lodeframe.operators.quantiles import quantiles

QUANTILES = 1000
_EDGE = 1e-7


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """standard, minmax, maxabs, robust, log1p, boxcox, yeojohnson, quantile_uniform, quantile_normal or binarize."""
    cols = [c for c in cols if is_numeric(df, c)]
    if method in ("boxcox", "yeojohnson"):
        return _power(df, cols, method)
    if method in ("quantile_uniform", "quantile_normal"):
        for c in cols:
            df = _by_quantiles(df, c, method == "quantile_normal")
        return df
    x = {c: clean(df, c).cast("double") for c in cols}
    out: dict[str, Column] = {}
    if method == "standard":
        fit = facts(df, {f"m{i}": F.avg(x[c]) for i, c in enumerate(cols)} | {f"s{i}": F.stddev_samp(x[c]) for i, c in enumerate(cols)})
        out = {c: (x[c] - F.lit(fit[f"m{i}"])) / F.lit(fit[f"s{i}"]) for i, c in enumerate(cols) if (fit[f"s{i}"] or 0) > 0}
    elif method in ("minmax", "maxabs", "log1p"):
        fit = facts(df, {f"a{i}": F.min(x[c]) for i, c in enumerate(cols)} | {f"b{i}": F.max(x[c]) for i, c in enumerate(cols)})
        for i, c in enumerate(cols):
            lo, hi = fit[f"a{i}"], fit[f"b{i}"]
            if lo is None:
                continue
            if method == "minmax" and hi > lo:
                out[c] = (x[c] - F.lit(lo)) / F.lit(hi - lo)
            elif method == "maxabs" and max(abs(lo), abs(hi)) > 0:
                out[c] = x[c] / F.lit(max(abs(lo), abs(hi)))
            elif method == "log1p":
                out[c] = F.log1p(x[c] + F.lit(1.0 - lo if lo < 0 else 0.0))
    elif method == "robust":
        for c, (q1, mid, q3) in quantiles(df, cols, [0.25, 0.5, 0.75]).items():
            if q1 is not None and q3 > q1:
                out[c] = (x[c] - F.lit(mid)) / F.lit(q3 - q1)
    elif method == "binarize":
        for c, (mid,) in quantiles(df, cols, [0.5]).items():
            out[c] = F.coalesce(x[c] >= F.lit(mid), F.lit(False)).cast("int")
    else:
        raise ValueError(f"unknown scaling {method}")
    return df.withColumns(out) if out else df


def boxcox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeojohnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    mirror = 2.0 - lam
    down = -F.log1p(-x) if abs(mirror) < 1e-12 else -(F.pow(1 - x, F.lit(mirror)) - 1) / F.lit(mirror)
    return F.when(x >= 0, up).otherwise(down)


def power_lambda(df: DataFrame, c: str, method: str, rounds: int = 7, points: int = 17) -> float:
    """The lambda of highest likelihood: each round tries a whole grid in one aggregate and closes in on the best."""
    x = clean(df, c).cast("double")
    change = boxcox if method == "boxcox" else yeojohnson
    jacobian = F.ln(x) if method == "boxcox" else F.signum(x) * F.log1p(F.abs(x))
    lo, hi = -5.0, 5.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        got = facts(df, {f"v{i}": F.var_pop(change(x, g)) for i, g in enumerate(grid)} | {"j": F.avg(jacobian)})
        score = [
            (g - 1) * got["j"] - 0.5 * math.log(got[f"v{i}"]) if got[f"v{i}"] and math.isfinite(got[f"v{i}"]) else -math.inf
            for i, g in enumerate(grid)
        ]
        best = max(range(points), key=lambda i: score[i])
        step = (hi - lo) / (points - 1)
        if best in (0, points - 1) and hi - lo >= 10.0 and hi - lo < 1000.0:
            lo, hi = lo * 4, hi * 4
            continue
        lo, hi = grid[best] - step, grid[best] + step
    return (lo + hi) / 2


def _power(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    out = {}
    for c in cols:
        x = clean(df, c).cast("double")
        ends = facts(df, {"lo": F.min(x), "hi": F.max(x)})
        if ends["lo"] is None or ends["lo"] == ends["hi"] or (method == "boxcox" and ends["lo"] <= 0):
            continue
        lam = power_lambda(df, c, method)
        out[c] = (boxcox if method == "boxcox" else yeojohnson)(x, lam)
    return df.withColumns(out) if out else df


def _by_quantiles(df: DataFrame, c: str, normal: bool) -> DataFrame:
    """The share of values below, read off up to 1000 exact quantiles; ties get the middle of their range."""
    n = facts(df, {"n": F.count(clean(df, c))})["n"]
    if not n:
        return df
    probs = np.linspace(0, 1, min(QUANTILES, n)) if n > 1 else np.array([0.0, 1.0])
    marks = np.maximum.accumulate(np.array(many_quantiles(df, c, [float(p) for p in probs])))
    edge = NormalDist().inv_cdf(1 - (_EDGE - np.spacing(1)))

    @F.pandas_udf("double")
    def transform(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=float)
        share = 0.5 * (np.interp(x, marks, probs) - np.interp(-x, -marks[::-1], -probs[::-1]))
        share = np.where(x <= marks[0], 0.0, np.where(x >= marks[-1], 1.0, share))
        if normal:
            inside = np.clip(share, _EDGE, 1 - _EDGE)
            inverse = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
            z = np.where(np.isnan(inside), np.nan, inverse(np.nan_to_num(inside, nan=0.5)).astype(float))
            share = np.where(share <= 0, -edge, np.where(share >= 1, edge, z))
        return pd.Series(np.where(np.isnan(x), np.nan, share))

    x = clean(df, c).cast("double")
    return df.withColumn(c, F.when(x.isNotNull(), transform(x)))


def covariances(df: DataFrame, columns: dict[str, Column], batch: int = 200) -> np.ndarray:
    """The covariance matrix of some expressions; a few hundred entries per aggregate."""
    names = list(columns)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    matrix = np.zeros((len(names), len(names)))
    for start in range(0, len(pairs), batch):
        part = pairs[start : start + batch]
        got = facts(df, {f"c{i}_{j}": F.covar_pop(columns[names[i]], columns[names[j]]) for i, j in part})
        for i, j in part:
            matrix[i, j] = matrix[j, i] = got[f"c{i}_{j}"] or 0.0
    return matrix


def standardised(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Mean 0 and population deviation 1 with nulls read as 0; a constant column becomes 0."""
    x = {c: F.coalesce(clean(df, c).cast("double"), F.lit(0.0)) for c in cols}
    fit = facts(df, {f"m{i}": F.avg(x[c]) for i, c in enumerate(cols)} | {f"s{i}": F.stddev_pop(x[c]) for i, c in enumerate(cols)})
    return {c: (x[c] - F.lit(fit[f"m{i}"] or 0.0)) / F.lit(fit[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def components(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, Column]]:
    """(variances, loadings by row, standardised columns), largest first; the heaviest loading of each is positive."""
    z = standardised(df, cols)
    values, vectors = np.linalg.eigh(covariances(df, z))
    order = np.argsort(values)[::-1]
    loadings = vectors[:, order].T
    signs = np.sign(loadings[np.arange(len(cols)), np.argmax(np.abs(loadings), axis=1)])
    return np.maximum(values[order], 0.0), loadings * np.where(signs == 0, 1.0, signs)[:, None], z


def pca(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The columns replaced by their first n principal components, as plain sums of columns."""
    _, loadings, z = components(df, cols)
    parts = [sum(F.lit(float(w)) * z[c] for c, w in zip(cols, row)).alias(f"PC{i + 1}") for i, row in enumerate(loadings[:n])]
    return df.select(*[q(c) for c in df.columns if c not in cols], *parts)
