"""Ordered lists of cleaning steps, what-if runs on a sample, and the difference two tables show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, dtype, facts, is_numeric, numeric_columns, q, rows, same
from lodeframe.operators.clean import balance, encode, outliers, scale, text, times, types
from lodeframe.operators.clean import rows as basic
from lodeframe.session import cut

STEPS_PER_CUT = 20

ACTIONS: dict[str, Callable] = {
    "remove_exact_duplicates": lambda d, c, p: basic.flag_duplicates(d) if p.get("keep") == "keep_all" else basic.drop_duplicates(d, p.get("subset"), p.get("order"), "last" if p.get("keep") == "keep_last" else "first"),
    "remove_subset_duplicates": lambda d, c, p: basic.drop_duplicates(d, c, p.get("order"), p.get("keep", "first")),
    "drop_duplicate_column": lambda d, c, p: basic.drop_columns(d, c),
    "drop_derived_column": lambda d, c, p: basic.drop_columns(d, c),
    "drop_column": lambda d, c, p: basic.drop_columns(d, c),
    "drop_raw_text": lambda d, c, p: basic.drop_columns(d, c),
    "drop_leakage": lambda d, c, p: basic.drop_columns(d, c),
    "drop_zero_variance": lambda d, c, p: basic.drop_columns(d, c),
    "drop_near_zero_variance": lambda d, c, p: basic.drop_columns(d, c),
    "drop_high_correlation": lambda d, c, p: basic.drop_columns(d, c),
    "drop_high_vif": lambda d, c, p: basic.drop_columns(d, c),
    "drop_low_mutual_info": lambda d, c, p: basic.drop_columns(d, c),
    "drop_rows": lambda d, c, p: basic.drop_null_rows(d, c),
    "drop_sparse_rows": lambda d, c, p: basic.drop_sparse_rows(d),
    "impute_mean": lambda d, c, p: basic.impute(d, c, "mean"),
    "impute_median": lambda d, c, p: basic.impute(d, c, "median"),
    "impute_mode": lambda d, c, p: basic.impute(d, c, "mode"),
    "impute_constant": lambda d, c, p: basic.impute(d, c, "constant", p.get("fill_value", 0)),
    "impute_knn": lambda d, c, p: balance.impute_knn(d, c, p["key"], p.get("k", 5)),
    "ffill": lambda d, c, p: basic.ffill(d, c, p["order"], p["key"], p.get("partition")),
    "bfill": lambda d, c, p: basic.bfill(d, c, p["order"], p["key"], p.get("partition")),
    "interpolate": lambda d, c, p: basic.interpolate(d, c, p["order"], p["key"], p.get("partition")),
    "add_indicator": lambda d, c, p: basic.add_indicator(d, c),
    "flag_only": lambda d, c, p: basic.flag_nulls(d, c),
    "cap_outliers": lambda d, c, p: outliers.cap_outliers(d, c, p.get("rule", False)),
    "replace_boundary": lambda d, c, p: outliers.cap_outliers(d, c, p.get("rule", False)),
    "winsorize": lambda d, c, p: outliers.winsorize(d, c, p.get("lower_pct", 0.01), p.get("upper_pct", 0.99)),
    "log_transform": lambda d, c, p: outliers.log_transform(d, c),
    "remove_outlier_rows": lambda d, c, p: outliers.remove_outliers(d, c),
    "flag_outlier": lambda d, c, p: outliers.flag_outliers(d, c),
    "parse_dates": lambda d, c, p: types.parse_dates(d, c),
    "parse_currency": lambda d, c, p: types.parse_currency(d, c),
    "standardize_booleans": lambda d, c, p: types.standardize_booleans(d, c),
    "replace_pseudo_nulls": lambda d, c, p: types.replace_pseudo_nulls(d, c),
    "flag_integer_categories": lambda d, c, p: types.as_category(d, c),
    "expand_json": lambda d, c, p: types.expand_json(d, c),
    "normalize_text": lambda d, c, p: text.normalize_text(d, c, p.get("mode", "full")),
    "extract_text_features": lambda d, c, p: text.text_features(d, c, p.get("mode", "all")),
    "tfidf_vectorize": lambda d, c, p: text.tfidf(d, c[0], p["key"], p.get("max_features", 100), tuple(p.get("ngram_range", (1, 2)))),
    "remove_stopwords": lambda d, c, p: text.remove_stopwords(d, c, p.get("language", "en")),
    "stem_lemmatize": lambda d, c, p: text.remove_stopwords(d, c, p.get("language", "en"), True),
    "label_encode": lambda d, c, p: encode.label_encode(d, c),
    "one_hot_encode": lambda d, c, p: encode.one_hot(d, c, p.get("drop_first", False)),
    "ordinal_encode": lambda d, c, p: encode.ordinal_encode(d, c, p.get("custom_order")),
    "frequency_encode": lambda d, c, p: encode.frequency_encode(d, c, p.get("proportion", False)),
    "target_encode": lambda d, c, p: encode.target_encode(d, c, p["target_column"], p.get("method", "loo"), p.get("key")),
    "binary_encode": lambda d, c, p: encode.binary_encode(d, c),
    "hash_encode": lambda d, c, p: encode.hash_encode(d, c, p.get("buckets", 32)),
    "cyclical_encode": lambda d, c, p: encode.cyclical_encode(d, c[0], p.get("cyclical_period", 12)),
    "extract_datetime": lambda d, c, p: times.extract_datetime(d, c, p.get("components")),
    "derive_datetime_flags": lambda d, c, p: times.datetime_flags(d, c, p.get("flags")),
    "compute_elapsed_time": lambda d, c, p: times.elapsed(d, c[0], p.get("unit", "days")),
    "compute_time_deltas": lambda d, c, p: times.time_delta(d, p["col_a"], p["col_b"], p.get("unit", "days")),
    "time_series_features": lambda d, c, p: times.ts_features(d, c[0], c[1:], p["key"], p.get("mode", "full"), p.get("partition")),
    "standard_scale": lambda d, c, p: scale.scale(d, c, "standard"),
    "minmax_scale": lambda d, c, p: scale.scale(d, c, "minmax"),
    "maxabs_scale": lambda d, c, p: scale.scale(d, c, "maxabs"),
    "robust_scale": lambda d, c, p: scale.scale(d, c, "robust"),
    "log1p_transform": lambda d, c, p: scale.scale(d, c, "log1p"),
    "boxcox_transform": lambda d, c, p: scale.scale(d, c, "boxcox"),
    "yeojohnson_transform": lambda d, c, p: scale.scale(d, c, "yeojohnson"),
    "quantile_uniform": lambda d, c, p: scale.scale(d, c, "quantile_uniform"),
    "quantile_normal": lambda d, c, p: scale.scale(d, c, "quantile_normal"),
    "binarize": lambda d, c, p: scale.scale(d, c, "binarize"),
    "suggest_pca": lambda d, c, p: scale.pca(d, c or numeric_columns(d), p["n"]),
    "random_oversample": lambda d, c, p: balance.oversample(d, c[0], p["key"], p.get("seed", 42)),
    "random_undersample": lambda d, c, p: balance.undersample(d, c[0], p["key"], p.get("seed", 42)),
    "smote": lambda d, c, p: balance.smote(d, c[0], p["key"], p.get("k", 5), p.get("seed", 42)),
    "standardize_casing": lambda d, c, p: text.casing(d, c, p.get("mode", "lower")),
    "standardize_whitespace": lambda d, c, p: text.whitespace(d, c),
    "normalize_unicode": lambda d, c, p: text.unicode_nfc(d, c),
    "consolidate_synonyms": lambda d, c, p: text.map_values(d, c[0], p["clusters"]),
    "standardize_email": lambda d, c, p: text.standardize_email(d, c),
    "standardize_precision": lambda d, c, p: text.precision(d, c, int(p.get("dominant_precision", 2))),
}


def apply_step(df: DataFrame, step: dict, mapping: dict[str, str] | None = None) -> DataFrame:
    """One step: {"action", "column" or "columns", "params"}; unknown actions raise."""
    action = step["action"].lower()
    if action not in ACTIONS:
        raise ValueError(f"unknown action {step['action']}")
    to = lambda name: (mapping or {}).get(name, name)
    columns = step.get("columns") or ([step["column"]] if step.get("column") else [])
    params = dict(step.get("params", {}))
    for k in ("target_column", "column", "columns", "key", "order", "col_a", "col_b"):
        if isinstance(params.get(k), str):
            params[k] = to(params[k])
        elif isinstance(params.get(k), list):
            params[k] = [to(v) for v in params[k]]
    present = [to(c) for c in columns if to(c) in df.columns]
    if columns and not present:
        return df
    return ACTIONS[action](df, present, params)


def apply_recipe(df: DataFrame, steps: list[dict], mapping: dict[str, str] | None = None) -> DataFrame:
    """The steps in order; long recipes are written to the shared folder now and then, to keep the plan short."""
    for i, step in enumerate(steps):
        df = apply_step(df, step, mapping)
        if (i + 1) % STEPS_PER_CUT == 0:
            df = cut(df)
    return df


def recipe_report(df: DataFrame, steps: list[dict], mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows and columns before and after every step; each count is one narrow pass over that step's result."""
    found, n = [], df.count()
    for i, step in enumerate(steps):
        before = (n, len(df.columns))
        df = apply_step(df, step, mapping)
        n = df.count()
        found.append((i, step["action"], before[0], n, before[1], len(df.columns)))
    schema = "step int, action string, rows_before long, rows_after long, columns_before int, columns_after int"
    return rows(df.sparkSession, found, schema)


def table_stats(df: DataFrame) -> dict:
    """Rows, columns, nulls, repeats and numeric columns."""
    got = facts(df, {"n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(df.columns)})
    n, cells = got["n"], got["n"] * len(df.columns)
    nulls = sum(n - got[f"k{i}"] for i in range(len(df.columns)))
    repeats = n - df.distinct().count()
    return {
        "rows": n, "columns": len(df.columns), "null_total": nulls, "null_pct": round(100.0 * nulls / max(cells, 1), 2),
        "duplicates": repeats, "numeric_cols": len(numeric_columns(df)),
    }


def readiness_score(df: DataFrame, stats: dict | None = None) -> int:
    """100 less penalties for nulls, few numeric columns, repeats and constant columns."""
    s = stats or table_stats(df)
    numbers = numeric_columns(df)
    spread = facts(df, {f"s{i}": F.stddev_samp(clean(df, c)) for i, c in enumerate(numbers)})
    score = 100.0 - min(100.0 * s["null_total"] / max(s["rows"] * s["columns"], 1) * 2, 30)
    if s["numeric_cols"] / max(s["columns"], 1) < 0.3:
        score -= 15
    score -= min(100.0 * s["duplicates"] / max(s["rows"], 1), 15)
    score -= 3 * sum(1 for i in range(len(numbers)) if spread[f"s{i}"] == 0)
    return max(0, min(100, int(score)))


def readiness(df: DataFrame) -> DataFrame:
    s = table_stats(df)
    return rows(df.sparkSession, [(*s.values(), readiness_score(df, s))],
                "rows long, columns int, null_total long, null_pct double, duplicates long, numeric_cols int, score int")


# Names of the what-if steps and the actions they stand for.
_WHAT_IF = {
    ("fill_nulls", "mean"): "impute_mean", ("fill_nulls", "median"): "impute_median", ("fill_nulls", "mode"): "impute_mode",
    ("fill_nulls", "zero"): "impute_constant", ("fill_nulls", "ffill"): "ffill", "drop_column": "drop_column",
    "drop_duplicates": "remove_exact_duplicates", "normalize": "minmax_scale", "standardize": "standard_scale",
    "encode_categorical": "label_encode",
}


def what_if_step(df: DataFrame, step: dict) -> DataFrame:
    """One what-if step; steps on columns of another kind change nothing."""
    action, column, params = step["action"], step.get("column"), step.get("params", {})
    if column and column not in df.columns:
        return df
    if action == "remove_outliers":
        return outliers.remove_outliers(df, [column], params.get("threshold", 1.5)) if is_numeric(df, column) else df
    if action == "log_transform":
        return df.withColumn(column, F.log1p(F.greatest(q(column), F.lit(0)))) if is_numeric(df, column) else df
    strategy = params.get("strategy", "mean")
    numeric_only = action in ("normalize", "standardize") or (action == "fill_nulls" and strategy in ("mean", "median"))
    if numeric_only and not is_numeric(df, column):
        return df
    name = _WHAT_IF.get((action, strategy)) or _WHAT_IF.get(action)
    if name is None:
        return df
    return apply_step(df, {"action": name, "column": column, "params": params})


def hash_sample(df: DataFrame, pct: int) -> DataFrame:
    """The rows whose hash falls into the first `pct` hundredths: the same rows however the table is partitioned, and without a sort."""
    return df if pct >= 100 else df.where(F.pmod(F.xxhash64(*[q(c) for c in df.columns]), F.lit(10_000)) < 100 * pct)


def simulate(df: DataFrame, steps: list[dict], pct: int = 10) -> DataFrame:
    """The table's statistics and readiness before and after the steps, on `pct` per cent of its rows (100: all)."""
    sample = hash_sample(df, pct)
    after = commit(sample, steps)
    a, b = table_stats(sample), table_stats(after)
    a["readiness"], b["readiness"] = readiness_score(sample, a), readiness_score(after, b)
    found = [(k, float(a[k]), float(b[k]), round(float(b[k]) - float(a[k]), 4)) for k in a]
    return rows(df.sparkSession, found, "metric string, before double, after double, delta double")


def commit(df: DataFrame, steps: list[dict]) -> DataFrame:
    """The same steps on the whole table."""
    for step in steps:
        df = what_if_step(df, step)
    return df


def table_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(column, change, n): rows and columns added or removed, types, cells and nulls changed; rows meet by key."""
    common = [c for c in a.columns if c in b.columns]
    left = a.select(q(key).alias("_ka"), *[q(c).alias(f"a_{i}") for i, c in enumerate(common)])
    right = b.select(q(key).alias("_kb"), *[q(c).alias(f"b_{i}") for i, c in enumerate(common)])
    both = left.join(right, F.col("_ka") == F.col("_kb"), "full")
    matched = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    counts = {"gone": F.count_if(F.col("_kb").isNull()), "new": F.count_if(F.col("_ka").isNull())}
    for i, c in enumerate(common):
        x, y = F.col(f"a_{i}").cast("string"), F.col(f"b_{i}").cast("string")
        counts[f"d{i}"] = F.count_if(matched & ~same(x, y))
        counts[f"x{i}"] = F.count_if(F.col("_ka").isNotNull() & F.col(f"a_{i}").isNull())
        counts[f"y{i}"] = F.count_if(F.col("_kb").isNotNull() & F.col(f"b_{i}").isNull())
    got = facts(both, counts)
    found = [(None, "rows_removed", got["gone"]), (None, "rows_added", got["new"])]
    found += [(c, "column_removed", 1) for c in a.columns if c not in b.columns]
    found += [(c, "column_added", 1) for c in b.columns if c not in a.columns]
    for i, c in enumerate(common):
        if dtype(a, c) != dtype(b, c):
            found.append((c, f"type {dtype(a, c).simpleString()} to {dtype(b, c).simpleString()}", 1))
        found += [(c, "values_changed", got[f"d{i}"]), (c, "nulls_before", got[f"x{i}"]), (c, "nulls_after", got[f"y{i}"])]
    return rows(a.sparkSession, found, "column string, change string, n long")


def apply_repairs(df: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """Approved repairs (key, column, value as text) written into their cells."""
    names = [r["column"] for r in repairs.select("column").distinct().collect()]
    names = [c for c in df.columns if c in names]
    if not names:
        return df
    wide = repairs.groupBy(q("key").alias("_k")).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_v_{i}") for i, c in enumerate(names)])
    joined = df.join(wide, q(key) == F.col("_k"), "left")
    fixed = {c: F.coalesce(F.col(f"_v_{i}").try_cast(dtype(df, c)), q(c)) for i, c in enumerate(names)}
    return joined.select(*[fixed[c].alias(c) if c in fixed else q(c) for c in df.columns])
