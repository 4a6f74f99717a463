"""How columns go together: correlations, association, information and collinearity."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, correlation, facts, is_numeric, numeric_columns, q, rows, scalar_columns
from lodeframe.functions.special import correlation_p
from lodeframe.operators.ordered import value_ranks
from lodeframe.operators.quantiles import quantiles

PAIRS_PER_JOB = 100
MI_BINS = 10


def _real(v) -> float | None:
    return None if v is None or math.isnan(v) or math.isinf(v) else float(v)


def pearson_pairs(df: DataFrame, columns: dict[str, Column], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple]:
    """{(a, b): (r, n)} over the rows that know both; a hundred pairs per aggregate."""
    found = {}
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start : start + PAIRS_PER_JOB]
        aggregates = {}
        for i, (a, b) in enumerate(part):
            aggregates[f"r{i}"] = correlation(columns[a], columns[b])
            aggregates[f"n{i}"] = F.count(F.when(columns[a].isNotNull() & columns[b].isNotNull(), 1))
        got = facts(df, aggregates)
        found |= {pair: (_real(got[f"r{i}"]), got[f"n{i}"]) for i, pair in enumerate(part)}
    return found


def as_numbers(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    return {c: clean(df, c).cast("double") for c in cols}


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pairwise-complete Pearson correlations; unknown ones are 0."""
    got = pearson_pairs(df, as_numbers(df, cols), list(combinations(cols, 2)))
    m = np.eye(len(cols))
    for (a, b), (r, _) in got.items():
        i, j = cols.index(a), cols.index(b)
        m[i, j] = m[j, i] = r or 0.0
    return m


def with_rank(df: DataFrame, c: str, name: str, base: DataFrame | None = None) -> DataFrame:
    """The average rank of a column's value over the whole table; one row per distinct value is joined back.

    `base` is the table before other ranks were joined to it, so that theirs are not worked out again.
    """
    ranks = value_ranks(df if base is None else base, c).select(F.col("v").alias(f"_v_{name}"), F.col("rank").alias(name))
    return df.join(ranks, clean(df, c).cast("double") == F.col(f"_v_{name}"), "left").drop(f"_v_{name}")


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple]:
    """Columns without nulls are ranked once; a pair with nulls is ranked over the rows that know both."""
    cols = sorted({c for p in pairs for c in p})
    got = facts(df, {"_n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)})
    full = {c for i, c in enumerate(cols) if got[f"k{i}"] == got["_n"]}
    whole = [p for p in pairs if p[0] in full and p[1] in full]
    found = {}
    if whole:
        used = sorted({c for p in whole for c in p})
        base = ranked = df.select(*[clean(df, c).alias(c) for c in used])
        for i, c in enumerate(used):
            ranked = with_rank(ranked, c, f"_rank_{i}", base.select(q(c)))
        found |= pearson_pairs(ranked, {c: F.col(f"_rank_{i}") for i, c in enumerate(used)}, whole)
    for a, b in [p for p in pairs if p not in whole]:
        both = df.select(clean(df, a).alias("a"), clean(df, b).alias("b")).where("a is not null and b is not null")
        ranked = with_rank(with_rank(both, "a", "_ra", both.select("a")), "b", "_rb", both.select("b"))
        found[(a, b)] = pearson_pairs(ranked, {"a": F.col("_ra"), "b": F.col("_rb")}, [("a", "b")])[("a", "b")]
    return found


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col1, col2, metric, score, p_value, n) for every pair of numeric columns."""
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    found = []
    for metric, got in (("pearson", pearson_pairs(df, as_numbers(df, cols), pairs)), ("spearman", spearman_pairs(df, pairs))):
        found += [(a, b, metric, r, correlation_p(r, n), n) for (a, b), (r, n) in got.items() if r is not None]
    return rows(df.sparkSession, found, "col1 string, col2 string, metric string, score double, p_value double, n long")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).alias("a"), q(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def chi_square_facts(df: DataFrame, a: str, b: str) -> dict:
    """Pearson's statistic from the counted cells and their margins; empty cells need no rows."""
    cells = contingency(df, a, b)
    left = cells.groupBy(F.col("a").alias("ka")).agg(F.sum("n").alias("ra"))
    right = cells.groupBy(F.col("b").alias("kb")).agg(F.sum("n").alias("rb"))
    joined = cells.join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb"))
    share = F.col("n").cast("double") * F.col("n") / (F.col("ra").cast("double") * F.col("rb"))
    got = facts(joined, {"s": F.sum(share), "n": F.sum("n"), "r": F.count_distinct("a"), "c": F.count_distinct("b")})
    n = got["n"] or 0
    return {"chi2": max(0.0, n * ((got["s"] or 0.0) - 1.0)), "n": n, "r": got["r"], "c": got["c"]}


def cramers_v_value(df: DataFrame, a: str, b: str) -> float | None:
    f = chi_square_facts(df, a, b)
    if f["r"] < 2 or f["c"] < 2:
        return None
    return math.sqrt(f["chi2"] / (f["n"] * (min(f["r"], f["c"]) - 1)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return rows(df.sparkSession, [(a, b, cramers_v_value(df, a, b))], "col1 string, col2 string, score double")


def group_sums(df: DataFrame, value: Column, group: Column) -> DataFrame:
    """(g, n, mean, m2) per group: merged map-side, so a hot group costs one row per task."""
    known = df.select(value.cast("double").alias("x"), group.alias("g")).where("x is not null and g is not null")
    return known.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))


def between_within(groups: DataFrame) -> dict:
    """Sums of squares between and within groups, from one row per group."""
    total = facts(groups, {"n": F.sum("n"), "s": F.sum(F.col("n") * F.col("mean")), "k": F.count(F.lit(1)), "w": F.sum("m2")})
    n, k = total["n"] or 0, total["k"]
    if not n:
        return {"n": 0, "k": 0, "between": 0.0, "within": 0.0}
    mean = total["s"] / n
    between = facts(groups, {"b": F.sum(F.col("n") * F.pow(F.col("mean") - F.lit(mean), 2))})["b"]
    return {"n": n, "k": k, "between": between, "within": total["w"]}


def eta_value(df: DataFrame, number: str, group: str) -> float | None:
    f = between_within(group_sums(df, clean(df, number), q(group)))
    if f["n"] < 3 or f["k"] < 2:
        return None
    total = f["between"] + f["within"]
    return 0.0 if total == 0 else min(max(f["between"] / total, 0.0), 1.0)


def eta_squared(df: DataFrame, number: str, group: str) -> DataFrame:
    return rows(df.sparkSession, [(number, group, eta_value(df, number, group))], "col1 string, col2 string, score double")


def point_biserial_value(df: DataFrame, number: str, two: str) -> tuple[float | None, int]:
    """Correlation with a two-valued column; its larger value counts as 1."""
    known = df.select(clean(df, number).cast("double").alias("x"), q(two).alias("b")).where("x is not null and b is not null")
    ends = facts(known, {"lo": F.min("b"), "hi": F.max("b"), "n": F.count(F.lit(1))})
    if not ends["n"] or ends["lo"] == ends["hi"]:
        return None, 0
    got = facts(known, {"r": correlation(F.col("x"), (F.col("b") == F.lit(ends["hi"])).cast("double"))})
    return _real(got["r"]), ends["n"]


def point_biserial(df: DataFrame, number: str, two: str) -> DataFrame:
    r, n = point_biserial_value(df, number, two)
    return rows(df.sparkSession, [(number, two, r, correlation_p(r, n))], "col1 string, col2 string, score double, p_value double")


def levels_of(df: DataFrame, cols: list[str], bins: int = MI_BINS) -> DataFrame:
    """Every column as a level: numbers with many values by quantile bins (nulls by the median), others as they are."""
    distinct = facts(df, {f"u{i}": F.approx_count_distinct(clean(df, c)) for i, c in enumerate(cols)})
    binned = [c for i, c in enumerate(cols) if is_numeric(df, c) and distinct[f"u{i}"] > 2 * bins]
    cuts = quantiles(df, binned, [i / bins for i in range(1, bins)]) if binned else {}
    out = []
    for c in cols:
        if c in binned:
            x = F.coalesce(clean(df, c).cast("double"), F.lit(cuts[c][bins // 2 - 1]))
            level = F.lit(0)
            for cut_at in sorted(set(cuts[c])):
                level = level + (x >= F.lit(cut_at)).cast("int")
            out.append(level.alias(c))
        else:
            out.append(F.coalesce(clean(df, c).cast("string"), F.lit("(null)")).alias(c))
    return df.select(*out)


def mutual_information_values(df: DataFrame, cols: list[str], bins: int = MI_BINS) -> dict[tuple[str, str], float]:
    """Plug-in estimate in nats for every pair, from the entropies of counted levels in one shuffle."""
    table = levels_of(df, cols, bins)
    pairs = list(combinations(range(len(cols)), 2))
    sets = [[q(cols[i]), q(cols[j])] for i, j in pairs] + [[q(c)] for c in cols]
    counts = table.groupingSets(sets, *[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    per = counts.groupBy("g").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s")).collect()
    entropy = {r["g"]: math.log(r["t"]) - r["s"] / r["t"] for r in per}
    everything = (1 << len(cols)) - 1
    at = lambda *kept: everything - sum(1 << (len(cols) - 1 - i) for i in kept)
    return {
        (cols[i], cols[j]): max(0.0, entropy[at(i)] + entropy[at(j)] - entropy[at(i, j)]) for i, j in pairs if at(i, j) in entropy
    }


def mutual_information(df: DataFrame, cols: list[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    cols = cols or scalar_columns(df)
    found = [(a, b, v) for (a, b), v in mutual_information_values(df, cols, bins).items()]
    return rows(df.sparkSession, found, "col1 string, col2 string, score double")


def vif_values(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Diagonal of the inverse correlation matrix over the rows that know all columns; infinite ones are left empty."""
    known = df.select(*[c.alias(n) for n, c in as_numbers(df, cols).items()]).dropna()
    spread = facts(known, {f"s{i}": F.stddev_pop(q(c)) for i, c in enumerate(cols)})
    live = [c for i, c in enumerate(cols) if spread[f"s{i}"]]
    if len(live) < 2:
        return {}
    matrix = correlation_matrix(known, live)
    if np.linalg.cond(matrix) > 1e12:
        found = {}
        for i, c in enumerate(live):
            rest = [j for j in range(len(live)) if j != i]
            r2 = matrix[i, rest] @ np.linalg.pinv(matrix[np.ix_(rest, rest)], rcond=1e-10) @ matrix[rest, i]
            found[c] = None if r2 > 1 - 1e-9 else float(1 / (1 - r2))
        return found
    return {c: float(v) for c, v in zip(live, np.diag(np.linalg.inv(matrix)))}


def vif(df: DataFrame, cols: list[str] | None = None, threshold: float = 5.0) -> DataFrame:
    """(column, vif, high): columns with under a fifth of nulls; an empty vif is beyond measure."""
    cols = cols or numeric_columns(df)
    got = facts(df, {"_n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)})
    cols = [c for i, c in enumerate(cols) if got["_n"] and got[f"k{i}"] > 0.8 * got["_n"]]
    found = [(c, v, v is None or v > threshold) for c, v in vif_values(df, cols).items()] if len(cols) > 1 else []
    return rows(df.sparkSession, found, "column string, vif double, high boolean")


def roles(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical and two-valued columns for association measures; a column whose values all differ is a key, not a category."""
    cols = scalar_columns(df)
    got = facts(df, {"_n": F.count(F.lit(1))} | {f"u{i}": F.count_distinct(clean(df, c)) for i, c in enumerate(cols)} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)})
    numbers, categories, binaries = [], [], []
    for i, c in enumerate(cols):
        u = got[f"u{i}"]
        if is_numeric(df, c) and got["_n"] and got[f"k{i}"] / got["_n"] > 0.4 and u > 1:
            numbers.append(c)
        elif u == 2:
            binaries.append(c)
        elif 1 < u < got[f"k{i}"]:
            categories.append(c)
    return numbers, categories, binaries


def association_pairs(df: DataFrame) -> list[tuple]:
    """(col1, col2, metric, score, p) for every pair that some measure fits."""
    numbers, categories, binaries = roles(df)
    pairs = list(combinations(numbers, 2))
    found = []
    for metric, got in (("pearson", pearson_pairs(df, as_numbers(df, numbers), pairs)), ("spearman", spearman_pairs(df, pairs) if pairs else {})):
        found += [(a, b, metric, r, correlation_p(r, n)) for (a, b), (r, n) in got.items() if r is not None]
    for a, b in combinations(categories, 2):
        found.append((a, b, "cramers_v", cramers_v_value(df, a, b), None))
    for x in numbers:
        found += [(x, c, "eta_squared", eta_value(df, x, c), None) for c in categories]
        for b in binaries:
            r, n = point_biserial_value(df, x, b)
            found.append((x, b, "point_biserial", r, correlation_p(r, n)))
    return [f for f in found if f[3] is not None]


def strongest_pairs(df: DataFrame, top: int | None = 50) -> DataFrame:
    """The best measure of the `top` strongest pairs, strongest first; None: of every pair."""
    best: dict[tuple, tuple] = {}
    for f in association_pairs(df):
        key = tuple(sorted(f[:2]))
        if key not in best or abs(f[3]) > abs(best[key][3]):
            best[key] = f
    ordered = sorted(best.values(), key=lambda f: (-abs(f[3]), f[0], f[1]))[:top]
    return rows(df.sparkSession, ordered, "col1 string, col2 string, metric string, score double, p_value double")


def relationship_graph(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(source, target, value): an edge per pair of numeric columns that correlate."""
    cols = numeric_columns(df)
    got = pearson_pairs(df, as_numbers(df, cols), list(combinations(cols, 2)))
    found = [(a, b, round(r, 3)) for (a, b), (r, _) in got.items() if r is not None and abs(r) >= threshold]
    return rows(df.sparkSession, found, "source string, target string, value double")


def relationship_nodes(df: DataFrame) -> DataFrame:
    """(node, category, value, size): a node per column, larger the more distinct values it has."""
    cols = scalar_columns(df)
    got = facts(df, {"_n": F.count(F.lit(1))} | {f"u{i}": F.count_distinct(clean(df, c)) for i, c in enumerate(cols)} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)})
    found = [
        (c, "numeric" if is_numeric(df, c) else "categorical", got[f"k{i}"], 10 + 40 * got[f"u{i}"] / max(got["_n"], 1)) for i, c in enumerate(cols)
    ]
    return rows(df.sparkSession, found, "node string, category string, value long, size double")
