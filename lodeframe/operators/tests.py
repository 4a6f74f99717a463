"""Hypothesis tests: the statistics are Spark aggregates, the probabilities one call on the driver."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import special
from lodeframe.functions.columns import clean, facts, is_string, numeric_columns, q, rows, scalar_columns
from lodeframe.operators.clean.rows import attach
from lodeframe.operators.ordered import cumulative, group_quantiles, value_ranks
from lodeframe.operators.profile.relations import between_within, chi_square_facts, group_sums, pearson_pairs, spearman_pairs

RESULT = "test string, statistic double, p_value double, df1 double, df2 double, significant boolean, note string"
ALPHA = 0.05


def _result(df: DataFrame, test: str, statistic: float, p: float, df1=None, df2=None, note: str | None = None) -> DataFrame:
    row = (test, float(statistic), float(p), None if df1 is None else float(df1), None if df2 is None else float(df2), p < ALPHA, note)
    return rows(df.sparkSession, [row], RESULT)


def strength(r: float) -> str:
    return "strong" if abs(r) > 0.7 else "moderate" if abs(r) > 0.4 else "weak"


def normality(df: DataFrame, c: str) -> DataFrame:
    """Jarque and Bera's test over every value; fit for samples of any size, unlike rank-based small-sample tests."""
    x = clean(df, c).cast("double")
    f = facts(df, {"n": F.count(x), "s": F.skewness(x), "k": F.kurtosis(x)})
    if f["n"] < 3:
        raise ValueError("a normality test needs three values")
    jb = f["n"] / 6 * (f["s"] ** 2 + f["k"] ** 2 / 4)
    return _result(df, "jarque_bera", jb, special.chi2_tail(jb, 2), 2)


def _ks_p(d: float, n: float) -> float:
    root = math.sqrt(n)
    return min(1.0, max(0.0, special.kolmogorov_tail((root + 0.12 + 0.11 / root) * d)))


@F.pandas_udf(T.DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(special.normal_cdf)


def ks_normal(df: DataFrame, c: str) -> DataFrame:
    """Largest distance from the normal law of the same mean and population deviation, over the counted values."""
    x = clean(df, c).cast("double")
    f = facts(df, {"n": F.count(x), "m": F.avg(x), "s": F.stddev_pop(x)})
    counts = df.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    running = cumulative(counts, "v", ["n"])
    law = _normal_cdf((F.col("v") - F.lit(f["m"])) / F.lit(f["s"]))
    upper = F.col("cum_n") / F.lit(f["n"]) - law
    lower = law - (F.col("cum_n") - F.col("n")) / F.lit(f["n"])
    d = facts(running, {"d": F.max(F.greatest(upper, lower))})["d"]
    return _result(df, "ks_normal", d, _ks_p(d, f["n"]))


def _two_groups(df: DataFrame, v: str, g: str, groups: tuple | None = None) -> tuple:
    if groups is None:
        found = [r["g"] for r in df.where(q(g).isNotNull()).select(q(g).alias("g")).distinct().limit(3).collect()]
        if len(found) != 2:
            raise ValueError(f"{g} has to have two values; name the groups otherwise")
        groups = tuple(sorted(found))
    return groups


def t_test(df: DataFrame, v: str, g: str, groups: tuple | None = None) -> DataFrame:
    """Student's test with pooled variance."""
    a, b = _two_groups(df, v, g, groups)
    f = {r["g"]: r for r in group_sums(df.where(q(g).isin(a, b)), clean(df, v), q(g)).collect()}
    x, y = f.get(a), f.get(b)
    if x is None or y is None or x["n"] < 2 or y["n"] < 2:
        raise ValueError("each group needs two values")
    dof = x["n"] + y["n"] - 2
    pooled = (x["m2"] + y["m2"]) / dof
    if pooled == 0:
        raise ValueError("both groups are constant")
    t = (x["mean"] - y["mean"]) / math.sqrt(pooled * (1 / x["n"] + 1 / y["n"]))
    return _result(df, "t_test", t, special.t_two_sided(t, dof), dof)


def mann_whitney_values(df: DataFrame, value, flag) -> tuple[float, float] | None:
    """(U, p) of the rows with the flag against the others, from ranks of counted values."""
    table = df.select(value.cast("double").alias("x"), flag.cast("boolean").alias("f")).where("x is not null and f is not null")
    ranks = value_ranks(table, "x", {"a": F.count_if(F.col("f"))})
    n_cubed = F.pow(F.col("n").cast("double"), 3) - F.col("n")
    f = facts(ranks, {"r": F.sum(F.col("a") * F.col("rank")), "na": F.sum("a"), "n": F.sum("n"), "ties": F.sum(n_cubed)})
    if not f["n"] or not f["na"] or f["na"] == f["n"]:
        return None
    n, na = f["n"], f["na"]
    nb = n - na
    u = f["r"] - na * (na + 1) / 2
    spread = na * nb / 12 * (n + 1 - f["ties"] / (n * (n - 1)))
    if spread <= 0:
        return u, 1.0
    z = max(0.0, abs(u - na * nb / 2) - 0.5) / math.sqrt(spread)
    return u, min(1.0, special.normal_two_sided(z))


def mann_whitney(df: DataFrame, v: str, g: str, groups: tuple | None = None) -> DataFrame:
    """U of the first group, two-sided with corrections for ties and continuity."""
    a, b = _two_groups(df, v, g, groups)
    got = mann_whitney_values(df.where(q(g).isin(a, b)), clean(df, v), q(g) == F.lit(a))
    if got is None:
        raise ValueError("each group needs a value")
    return _result(df, "mann_whitney", *got)


def _anova_values(f: dict) -> tuple[float, float, int, int]:
    d1, d2 = f["k"] - 1, f["n"] - f["k"]
    if d1 < 1 or d2 < 1:
        raise ValueError("two groups with values are needed")
    if f["within"] == 0:
        return math.inf, 0.0, d1, d2
    stat = (f["between"] / d1) / (f["within"] / d2)
    return stat, special.f_tail(stat, d1, d2), d1, d2


def anova(df: DataFrame, v: str, g: str) -> DataFrame:
    return _result(df, "anova", *_anova_values(between_within(group_sums(df, clean(df, v), q(g)))))


def levene(df: DataFrame, v: str, g: str) -> DataFrame:
    """Anova of the distances from each group's median."""
    table = df.select(clean(df, v).cast("double").alias("x"), q(g).alias("g")).where("x is not null and g is not null")
    centred = attach(table, group_quantiles(table, ["g"], "x", {"mid": 0.5}), ["g"], outer=False)
    f = between_within(group_sums(centred, F.abs(F.col("x") - F.col("mid")), F.col("g")))
    return _result(df, "levene", *_anova_values(f))


def chi_square_values(df: DataFrame, a: str, b: str) -> tuple[float, float, int, dict]:
    f = chi_square_facts(df, a, b)
    if f["r"] < 2 or f["c"] < 2:
        raise ValueError("both columns need two values")
    dof, stat = (f["r"] - 1) * (f["c"] - 1), f["chi2"]
    if dof == 1:
        stat = _yates(df, a, b)
    return stat, special.chi2_tail(stat, dof), dof, f


def _yates(df: DataFrame, a: str, b: str) -> float:
    """The corrected statistic of a two by two table, from its four counts."""
    from lodeframe.operators.profile.relations import contingency

    cells = {(r["a"], r["b"]): r["n"] for r in contingency(df, a, b).collect()}
    left, right = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    n = sum(cells.values())
    margin_a = {x: sum(cells.get((x, y), 0) for y in right) for x in left}
    margin_b = {y: sum(cells.get((x, y), 0) for x in left) for y in right}
    total = 0.0
    for x in left:
        for y in right:
            expected = margin_a[x] * margin_b[y] / n
            gap = abs(cells.get((x, y), 0) - expected)
            total += (gap - min(0.5, gap)) ** 2 / expected
    return total


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    stat, p, dof, _ = chi_square_values(df, a, b)
    return _result(df, "chi_square", stat, p, dof)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    r, n = pearson_pairs(df, {x: clean(df, x).cast("double"), y: clean(df, y).cast("double")}, [(x, y)])[(x, y)]
    if r is None:
        raise ValueError("a constant column has no correlation")
    return _result(df, "pearson", r, special.correlation_p(r, n), n - 2, note=f"{strength(r)} {'positive' if r > 0 else 'negative'}")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r, n = spearman_pairs(df, [(x, y)])[(x, y)]
    if r is None:
        raise ValueError("a constant column has no correlation")
    return _result(df, "spearman", r, special.correlation_p(r, n), n - 2, note=strength(r))


TESTS = {
    "normality": normality, "ks_normal": ks_normal, "t_test": t_test, "mann_whitney": mann_whitney, "anova": anova, "levene": levene,
    "chi_square": chi_square, "pearson": pearson, "spearman": spearman,
}


def run_test(name: str, df: DataFrame, *columns: str, **kw) -> DataFrame:
    if name not in TESTS:
        raise ValueError(f"unknown test {name}")
    return TESTS[name](df, *columns, **kw)


def suggest_tests(df: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """Tests that the column types allow, with columns to run them on."""
    numbers, texts = numeric_columns(df), [c for c in scalar_columns(df) if is_string(df, c)]
    found: list[tuple[str, tuple[str, ...]]] = [("normality", (c,)) for c in numbers[:1]]
    if len(numbers) > 1:
        found += [(t, tuple(numbers[:2])) for t in ("pearson", "spearman")]
    if numbers and texts:
        found += [(t, (numbers[0], texts[0])) for t in ("t_test", "mann_whitney", "anova", "levene")]
    if len(texts) > 1:
        found.append(("chi_square", tuple(texts[:2])))
    return found


def discover(df: DataFrame, limit: int | None = 10) -> DataFrame:
    """The most telling pairs of columns: correlations of at least .2, and group tests and tables with p up to .1.

    Significant ones first, then by effect size: r squared, eta squared or Cramér's V. Texts of any number of levels take part, unless
    all values differ. `limit` None: all pairs found.
    """
    numbers = numeric_columns(df)
    texts = [c for c in scalar_columns(df) if is_string(df, c)]
    levels = facts(df, {f"u{i}": F.count_distinct(q(c)) for i, c in enumerate(texts)} | {f"k{i}": F.count(q(c)) for i, c in enumerate(texts)}) if texts else {}
    texts = [c for i, c in enumerate(texts) if 2 <= levels[f"u{i}"] < levels[f"k{i}"]]
    found = []
    pairs = list(combinations(numbers, 2))
    strong = {p: v for p, v in pearson_pairs(df, {c: clean(df, c).cast("double") for c in numbers}, pairs).items() if v[0] is not None and v[1] >= 10 and abs(v[0]) >= 0.2}
    ranks = spearman_pairs(df, list(strong)) if strong else {}
    for (a, b), (r, n) in strong.items():
        found.append(("pearson", a, b, r, special.correlation_p(r, n), r * r, ranks[(a, b)][0]))
    for c in texts:
        for x in numbers:
            groups = group_sums(df, clean(df, x), q(c)).where("n >= 3")
            f = between_within(groups)
            if f["k"] < 2 or f["n"] <= f["k"]:
                continue
            stat, p, _, _ = _anova_values(f)
            if p <= 0.1:
                found.append(("anova", c, x, stat, p, f["between"] / (f["between"] + f["within"]) if f["between"] + f["within"] else 0.0, None))
    for a, b in combinations(texts, 2):
        stat, p, _, f = chi_square_values(df, a, b)
        if p <= 0.1:
            found.append(("chi_square", a, b, stat, p, math.sqrt(stat / (f["n"] * (min(f["r"], f["c"]) - 1))), None))
    found.sort(key=lambda f: (f[4] >= ALPHA, -abs(f[5]), f[1], f[2]))
    schema = "test string, column_a string, column_b string, statistic double, p_value double, effect_size double, spearman double"
    return rows(df.sparkSession, found[:limit], schema)
