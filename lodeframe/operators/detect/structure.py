"""Repeated rows, repeated and derived columns, near-equal values and missing data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, dtype, facts, is_numeric, is_string, is_time, numeric_columns, q, rows, same, scalar_columns
from lodeframe.operators.clean.rows import null_share, sparse_limit
from lodeframe.operators.detect.findings import DEFINITIVE, JUDGMENT, Finding
from lodeframe.operators.links import components, near_links
from lodeframe.operators.profile.numeric import adjusted_shape, box_facts, moments, numbers
from lodeframe.operators.profile.relations import as_numbers, pearson_pairs
from lodeframe.operators.tests import mann_whitney_values

SAME_SHARE = 0.98
NEAR = 0.85
FEW_VALUES = 2
PAIRS_PER_JOB = 150
MATRIX_ROWS = 200


def find_duplicates(df: DataFrame) -> list[Finding]:
    """Exact copies of rows beyond the first."""
    n = df.count()
    extra = n - df.select(*[q(c) for c in scalar_columns(df)]).distinct().count()
    if not extra:
        return []
    pct = round(100.0 * extra / n, 2)
    return [Finding([], "duplicates", "remove_exact_duplicates", DEFINITIVE if pct < 5 else JUDGMENT, f"{pct} % of rows are copies", extra, {"pct": pct})]


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(col1, col2, similarity, drop): pairs of one type that agree in at least 98 % of rows."""
    cols = scalar_columns(df)
    pairs = [(a, b) for a, b in combinations(cols, 2) if dtype(df, a) == dtype(df, b)]
    found = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start : start + PAIRS_PER_JOB]
        got = facts(df, {f"s{i}": F.avg(same(clean(df, a), clean(df, b)).cast("double")) for i, (a, b) in enumerate(part)})
        for i, (a, b) in enumerate(part):
            share = got[f"s{i}"]
            if share is not None and share >= SAME_SHARE:
                found.append((a, b, round(share, 4), b if len(a) >= len(b) else a))
    return rows(df.sparkSession, found, "col1 string, col2 string, similarity double, drop string")


def derived_columns(df: DataFrame) -> DataFrame:
    """(col1, col2, slope, intercept, r_squared): col2 is a straight line of col1, over rows that know every number."""
    cols = numeric_columns(df)
    known = df.select(*[c.alias(n) for n, c in as_numbers(df, cols).items()]).dropna()
    pairs = list(combinations(cols, 2))
    strong = [p for p, (r, n) in pearson_pairs(known, {c: q(c) for c in cols}, pairs).items() if r is not None and abs(r) >= 0.999 and n >= 20]
    aggregates = {}
    for i, (a, b) in enumerate(strong):
        aggregates |= {f"a{i}": F.regr_slope(q(b), q(a)), f"b{i}": F.regr_intercept(q(b), q(a)), f"r{i}": F.regr_r2(q(b), q(a))}
    got = facts(known, aggregates) if aggregates else {}
    found = [(a, b, got[f"a{i}"], got[f"b{i}"], got[f"r{i}"]) for i, (a, b) in enumerate(strong) if got[f"r{i}"] >= 0.99]
    return rows(df.sparkSession, found, "col1 string, col2 string, slope double, intercept double, r_squared double")


def _values(df: DataFrame, c: str) -> DataFrame:
    return df.select(q(c).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))


def near_pairs(df: DataFrame, c: str, least: float = NEAR) -> DataFrame:
    """(a, b, similarity): different values of one column, of three or more, that are nearly the same by Jaro and Winkler.

    Blocks of distinct values meet pairwise in tasks; the work grows with the square of the distinct values, its result with the pairs.
    """
    values = _values(df, c).select("v")
    if values.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return rows(df.sparkSession, [], "a string, b string, similarity double")
    return near_links(values, least)


def near_duplicates(df: DataFrame, c: str, least: float = NEAR) -> DataFrame:
    """(cluster, value, rows): values linked through near-equal pairs; the cluster is named by its first value."""
    counts = _values(df, c)
    if counts.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return rows(df.sparkSession, [], "cluster string, value string, rows long")
    named = components(near_links(counts.select("v"), least, spanning=True))
    return counts.join(named, counts.v == named.node).select(F.col("comp").alias("cluster"), F.col("v").alias("value"), F.col("n").alias("rows"))


def null_facts(df: DataFrame) -> tuple[int, dict[str, int]]:
    cols = scalar_columns(df)
    got = facts(df, {"_n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)})
    return got["_n"], {c: got["_n"] - got[f"k{i}"] for i, c in enumerate(cols)}


def mar_values(df: DataFrame) -> dict[tuple[str, str], float]:
    """Correlation of each column's null flag with every other number, nulls there read as 0."""
    _, nulls = null_facts(df)
    numeric = numeric_columns(df)
    flags = {f"?{c}": clean(df, c).isNull().cast("double") for c, n in nulls.items() if n}
    values = {c: F.coalesce(clean(df, c).cast("double"), F.lit(0.0)) for c in numeric}
    pairs = [(f, c) for f in flags for c in numeric if f != f"?{c}"]
    return {(f[1:], c): r for (f, c), (r, _) in pearson_pairs(df, flags | values, pairs).items() if r is not None}


def mar_signals(df: DataFrame, least: float = 0.3) -> DataFrame:
    found = [(a, b, r) for (a, b), r in mar_values(df).items() if abs(r) > least]
    return rows(df.sparkSession, found, "column string, correlated_with string, correlation double")


def missing_pattern(df: DataFrame) -> dict[str, str]:
    n, nulls = null_facts(df)
    values = mar_values(df)
    found = {}
    for c, k in nulls.items():
        if k:
            most = max((abs(r) for (a, _), r in values.items() if a == c), default=0.0)
            found[c] = "mar" if most > 0.3 else "mcar" if k / n < 0.05 else "unknown"
    return found


def mcar_test(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean p of the Mann-Whitney tests of the other numbers between rows that lack the column and rows that have it."""
    _, nulls = null_facts(df)
    found = []
    for c, k in nulls.items():
        if not k:
            continue
        ps = []
        for other in numeric_columns(df):
            if other == c:
                continue
            flag = clean(df, c).isNull()
            sizes = facts(df, {"a": F.count(F.when(flag, clean(df, other))), "b": F.count(F.when(~flag, clean(df, other)))})
            if sizes["a"] < 5 or sizes["b"] < 5:
                continue
            got = mann_whitney_values(df, clean(df, other), flag)
            if got is not None:
                ps.append(got[1])
        if ps:
            mean = sum(ps) / len(ps)
            found.append((c, mean, mean > alpha))
    return rows(df.sparkSession, found, "column string, mean_p double, mcar boolean")


def nullity_matrix(df: DataFrame, n: int | None = MATRIX_ROWS) -> DataFrame:
    """1 for present and 0 for null, on `n` rows picked by hash (None: on all), for the columns that have nulls."""
    _, nulls = null_facts(df)
    cols = [c for c, k in nulls.items() if k]
    picked = df if n is None else df.orderBy(F.xxhash64(*[q(c) for c in scalar_columns(df)])).limit(n)
    return picked.select(*[clean(df, c).isNotNull().cast("int").alias(c) for c in cols])


def null_overlap(df: DataFrame) -> DataFrame:
    """(col1, col2, both): rows in which both columns are null."""
    _, nulls = null_facts(df)
    pairs = list(combinations([c for c, k in nulls.items() if k], 2))
    got = facts(df, {f"b{i}": F.count_if(clean(df, a).isNull() & clean(df, b).isNull()) for i, (a, b) in enumerate(pairs)}) if pairs else {}
    return rows(df.sparkSession, [(a, b, got[f"b{i}"]) for i, (a, b) in enumerate(pairs)], "col1 string, col2 string, both long")


def missing_strategies(df: DataFrame, importance: dict[str, float] | None = None) -> list[tuple]:
    """(column, nulls, pct, strategy, pattern) by null rate, importance, type, order in time, correlation and shape."""
    n, nulls = null_facts(df)
    missing = [c for c, k in nulls.items() if k]
    if not missing:
        return []
    numeric = numeric_columns(df)
    temporal = any(is_time(df, c) for c in scalar_columns(df))
    shapes = moments(numbers(df, numeric), numeric)
    boxes = box_facts(df, [c for c in missing if c in numeric])
    ties = pearson_pairs(df, as_numbers(df, numeric), list(combinations(numeric, 2)))
    close = {c for (a, b), (r, _) in ties.items() if r is not None and abs(r) > 0.6 for c in (a, b)}
    patterns = missing_pattern(df)
    few = {c for c in missing if not is_numeric(df, c)}
    found = []
    for c in missing:
        pct, weight = round(100.0 * nulls[c] / n, 2), (importance or {}).get(c, 50.0)
        if pct > max(30, 70 - 0.4 * weight) and weight < 30:
            strategy = "drop_column"
        elif pct < 2:
            strategy = "drop_rows"
        elif is_time(df, c):
            strategy = "ffill"
        elif c in numeric and temporal and pct < 30:
            strategy = "interpolate"
        elif c in numeric:
            skew, _ = adjusted_shape(shapes[c]["n"], shapes[c]["skew"], shapes[c]["kurt"])
            odd = c in boxes and boxes[c]["outliers"] > 0.05 * boxes[c]["n"]
            strategy = "impute_knn" if c in close and pct < 40 else "impute_median" if abs(skew) > 1 or odd else "impute_mean"
        elif c in few and pct <= 30:
            strategy = "impute_mode"
        else:
            strategy = "add_indicator" if pct > 30 else "impute_mode"
        found.append((c, nulls[c], pct, strategy, patterns[c]))
    return found


def missing_plan(df: DataFrame, importance: dict[str, float] | None = None) -> DataFrame:
    return rows(df.sparkSession, missing_strategies(df, importance), "column string, null_count long, null_pct double, strategy string, pattern string")


def sparse_rows(df: DataFrame) -> list[Finding]:
    """Rows whose share of nulls is above the limit."""
    got = facts(df, {"n": F.count(F.lit(1)), "s": F.count_if(null_share(df) > sparse_limit(len(df.columns)))})
    if not got["s"]:
        return []
    return [Finding([], "missing_values", "drop_sparse_rows", JUDGMENT, f"{round(100.0 * got['s'] / got['n'], 2)} % of rows are mostly empty", got["s"])]


def structure_findings(df: DataFrame) -> list[Finding]:
    found = find_duplicates(df)
    for r in duplicate_columns(df).collect():
        found.append(Finding([r["drop"]], "duplicates", "drop_duplicate_column", DEFINITIVE if r["similarity"] == 1.0 else JUDGMENT, f"{r['col1']} and {r['col2']} agree in {100 * r['similarity']:.1f} %", 0, {"similarity": r["similarity"]}))
    for r in derived_columns(df).collect():
        found.append(Finding([r["col2"]], "duplicates", "drop_derived_column", JUDGMENT, f"a line of {r['col1']}", 0, {"slope": r["slope"], "intercept": r["intercept"]}))
    for c in [c for c in scalar_columns(df) if is_string(df, c)]:
        groups = near_duplicates(df, c).agg(F.count_distinct("cluster").alias("k"), F.sum("rows").alias("n")).first()
        if groups["k"]:
            found.append(Finding([c], "duplicates", "merge_near_duplicates", JUDGMENT, f"{groups['k']} groups of near-equal values", groups["n"]))
    for c, k, pct, strategy, pattern in missing_strategies(df):
        found.append(Finding([c], "missing_values", strategy, JUDGMENT, f"{pct} % null", k, {"pattern": pattern}))
    return found + sparse_rows(df)
