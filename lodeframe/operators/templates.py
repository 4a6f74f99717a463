"""Prepared analysis queries: audits, distributions, trends, funnels, cohorts, scorecards and rankings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, is_numeric, no_nan, q, scalar_columns
from lodeframe.operators.quantiles import quantiles

# The words that give a column its role.
ROLE_WORDS = {
    "date": r"(date|time|timestamp|created|updated|modified|at$|_at$|_on$)",
    "id": r"(^id$|_id$|_key$|_code$|^pk$)",
    "user": r"(user|customer|client|member|subscriber|patient|employee|student)",
    "event": r"(event|action|activity|status|step|stage|funnel|type)",
    "amount": r"(amount|price|cost|revenue|salary|total|fee|charge|payment|spend|value)",
    "geo": r"(city|state|country|region|zip|postal|lat|lon|address|location)",
    "name": r"(name|title|label|description|category|brand|product)",
    "metric": r"(score|rating|count|quantity|views|clicks|impressions|conversion|rate)",
}
LOW_CARDINALITY = 20
HIGH_CARDINALITY = 100
PERIODS = ("day", "week", "month", "quarter", "year")


def column_roles(columns: list[dict]) -> dict[str, list[str]]:
    """Roles of columns from their names and types; `columns` are rows of the column catalogue."""
    roles: dict[str, list[str]] = {r: [] for r in (*ROLE_WORDS, "numeric", "text", "boolean", "category", "low", "high")}
    by_type = {"integer": "numeric", "float": "numeric", "text": "text", "boolean": "boolean", "categorical": "category"}
    for c in columns:
        name, kind = c["column"], c["ui_type"]
        if kind in by_type:
            roles[by_type[kind]].append(name)
        if (c.get("distinct") or 0) <= LOW_CARDINALITY:
            roles["low"].append(name)
        elif c["distinct"] > HIGH_CARDINALITY:
            roles["high"].append(name)
        for role, words in ROLE_WORDS.items():
            named = re.search(words, name, re.IGNORECASE) is not None
            if role == "date":
                named = kind == "datetime" or (named and kind != "boolean")
            if named:
                roles[role].append(name)
    return roles


def suggest_templates(columns: list[dict], others: dict[str, list[str]] | None = None) -> list[tuple[str, dict]]:
    """(operator name, arguments) for every prepared query that fits the table."""
    r = column_roles(columns)
    names = [c["column"] for c in columns]
    found: list[tuple[str, dict]] = [("null_counts", {}), ("duplicate_rows", {}), ("completeness", {}), ("rows_missing", {})]
    found += [("count_by_period", {"d": d}) for d in r["date"][:1]]
    found += [("value_range", {"c": c}) for c in r["numeric"][:3]]
    found += [("top_rows", {"c": c}) for c in r["numeric"][:3]]
    found += [("value_frequency", {"c": c}) for c in r["low"][:3]]
    found += [("histogram", {"c": c}) for c in r["numeric"][:2]]
    if r["category"] and r["numeric"]:
        found += [("top_per_group", {"cat": r["category"][0], "m": r["numeric"][0]})]
        found += [("rank_groups", {"cat": r["category"][0], "m": r["numeric"][0]})]
    metric = (r["amount"] or r["numeric"] or [None])[0]
    if r["date"] and metric:
        found += [(t, {"d": r["date"][0], "m": metric}) for t in ("trend", "growth", "rolling")]
    if r["amount"] and r["category"]:
        found += [("scorecard", {"cat": r["category"][0], "m": r["amount"][0]})]
    if r["event"] and r["user"]:
        found += [("funnel", {"ev": r["event"][0], "user": r["user"][0]})]
    if r["user"] and r["date"]:
        found += [("cohort_retention", {"user": r["user"][0], "d": r["date"][0]})]
    found += [("zscore_outliers", {"c": c}) for c in r["amount"][:2]]
    found += [("segment", {"g": g, "m": (r["amount"] or [None])[0]}) for g in r["geo"][:2]]
    for other, cols in list((others or {}).items())[:3]:
        common = [c for c in names if c in cols]
        if common:
            found += [(t, {"other": other, "key": common[0]}) for t in ("natural_join", "orphans")]
    return found


def _period(d: str, unit: str):
    if unit not in PERIODS:
        raise ValueError(f"unknown period {unit}")
    return F.date_trunc(unit, q(d))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: total rows and the nulls of every column."""
    return no_nan(df).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(q(c).isNull()).alias(f"{c}_nulls") for c in df.columns]
    )


def duplicate_rows(df: DataFrame, limit: int = 100) -> DataFrame:
    """Rows that occur more than once, most frequent first; the rows themselves break ties."""
    grouped = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("dup_count"))
    order = [F.col("dup_count").desc(), *[q(c).asc_nulls_last() for c in scalar_columns(df)]]
    return grouped.where("dup_count > 1").orderBy(*order).limit(limit)


def count_by_period(df: DataFrame, d: str, unit: str = "month") -> DataFrame:
    grouped = df.groupBy(_period(d, unit).alias("period")).agg(F.count(F.lit(1)).alias("record_count"))
    return grouped.orderBy(F.col("period").asc_nulls_last())


def value_range(df: DataFrame, c: str) -> DataFrame:
    """Min, quartiles, mean, max and sample deviation in one row."""
    p25, median, p75 = quantiles(df, [c], [0.25, 0.5, 0.75])[c]
    x = clean(df, c)
    return df.agg(
        F.min(x).alias("min_val"), F.lit(p25).alias("p25"), F.lit(median).alias("median"), F.avg(x).alias("mean"),
        F.lit(p75).alias("p75"), F.max(x).alias("max_val"), F.stddev_samp(x).alias("std_dev"),
    )


def share_of_total(df: DataFrame, cols: list[str], count: str, share: str, digits: int = 2) -> DataFrame:
    """Group sizes and their percentage of all rows; the total is one number, counted beside the groups."""
    total = df.count()
    grouped = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias(count))
    return grouped.withColumn(share, F.round(F.lit(100.0) * F.col(count) / F.lit(total), digits))


def value_frequency(df: DataFrame, c: str) -> DataFrame:
    return share_of_total(df, [c], "frequency", "pct").orderBy(F.col("frequency").desc(), q(c).asc_nulls_last())


def histogram(df: DataFrame, c: str, buckets: int = 20) -> DataFrame:
    """Equal widths from min to max; the max itself falls into bucket number `buckets`, a constant into null."""
    x = clean(df, c)
    ends = facts(df, {"lo": F.min(x), "hi": F.max(x)})
    width = None if ends["lo"] is None else (float(ends["hi"]) - float(ends["lo"])) / buckets or None
    lo = None if ends["lo"] is None else float(ends["lo"])
    bucket = F.floor((x.cast("double") - F.lit(lo)) / F.lit(width)).cast("long")
    return df.where(x.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("freq")).orderBy("bucket")


def rows_missing(df: DataFrame, min_nulls: int = 3, limit: int | None = 100) -> DataFrame:
    """Rows with at least that many nulls, emptiest first."""
    nulls = sum((clean(df, c).isNull().cast("int") for c in df.columns), F.lit(0))
    found = df.withColumn("null_count", nulls).where(F.col("null_count") >= min_nulls)
    ties = [q(c).asc_nulls_last() for c in scalar_columns(df)]
    return found if limit is None else found.orderBy(F.col("null_count").desc(), *ties).limit(limit)


def completeness(df: DataFrame) -> DataFrame:
    """Share of nulls per column in percent."""
    rows = F.count(F.lit(1))
    shares = [
        F.round(F.try_divide(F.lit(100.0) * F.count_if(clean(df, c).isNull()), rows), 2).alias(c) for c in df.columns
    ]
    return df.agg(rows.alias("total_rows"), *shares)


def trend(df: DataFrame, d: str, m: str, unit: str = "month") -> DataFrame:
    grouped = df.groupBy(_period(d, unit).alias("period")).agg(
        F.sum(q(m)).alias("total"), F.avg(q(m)).alias("average"), F.count(F.lit(1)).alias("records")
    )
    return grouped.orderBy(F.col("period").asc_nulls_last())


def growth(df: DataFrame, d: str, m: str, unit: str = "month") -> DataFrame:
    """Change against the period before, in percent; the window runs over period rows only."""
    periods = df.groupBy(_period(d, unit).alias("p")).agg(F.sum(q(m)).alias("total"))
    before = F.lag("total").over(Window.orderBy(F.col("p").asc_nulls_last()))
    pct = F.round(F.try_divide(F.lit(100.0) * (F.col("total") - F.col("prev_total")), F.col("prev_total")), 2)
    return periods.withColumn("prev_total", before).withColumn("growth_pct", pct).orderBy(F.col("p").asc_nulls_last())


def rolling(df: DataFrame, d: str, m: str, unit: str = "day", n: int = 7) -> DataFrame:
    """Mean of the period means over the current and the n periods before it (n + 1 rows)."""
    periods = df.groupBy(_period(d, unit).alias("p")).agg(F.avg(q(m)).alias("avg_val"))
    w = Window.orderBy(F.col("p").asc_nulls_last()).rowsBetween(-n, 0)
    return periods.withColumn("rolling_avg", F.avg("avg_val").over(w)).orderBy(F.col("p").asc_nulls_last())


def top_rows(df: DataFrame, c: str, n: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(q(c).desc_nulls_last(), *[q(t) for t in ties]).limit(n)


def top_per_group(df: DataFrame, cat: str, m: str, n: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """First n rows per group with their rank; Spark's group limit keeps n rows per group and task before the shuffle."""
    w = Window.partitionBy(q(cat)).orderBy(q(m).desc_nulls_last(), *[q(t) for t in ties])
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def scorecard(df: DataFrame, cat: str, m: str) -> DataFrame:
    grouped = df.groupBy(q(cat)).agg(
        F.count(F.lit(1)).alias("count"), F.sum(q(m)).alias("total"), F.avg(q(m)).alias("average"),
        F.min(q(m)).alias("min_val"), F.max(q(m)).alias("max_val"),
    )
    return grouped.orderBy(F.col("total").desc_nulls_last())


def funnel(df: DataFrame, ev: str, user: str) -> DataFrame:
    """Distinct users per step, largest first."""
    grouped = df.groupBy(q(ev)).agg(F.count_distinct(q(user)).alias("unique_users"))
    return grouped.orderBy(F.col("unique_users").desc(), q(ev).asc_nulls_last())


def did_not(df: DataFrame, ev: str, user: str, a: str, b: str, limit: int | None = 100) -> DataFrame:
    """Users seen with step a and never with step b."""
    did = df.where(q(ev) == a).select(q(user)).where(q(user).isNotNull()).distinct()
    other = df.where(q(ev) == b).select(q(user).alias("_u")).distinct()
    found = did.join(other, q(user) == F.col("_u"), "left_anti")
    return found if limit is None else found.orderBy(q(user)).limit(limit)


def cohort_retention(df: DataFrame, user: str, d: str) -> DataFrame:
    """Active users per cohort month and months since.

    Rows shrink to one per user and month before the cohort is attached to them.
    """
    activity = df.where(q(user).isNotNull()).groupBy(q(user).alias("u")).agg(F.collect_set(F.date_trunc("month", q(d))).alias("months"))
    activity = activity.withColumn("cohort_month", F.array_min("months"))
    active = activity.select("u", "cohort_month", F.explode("months").alias("m"))
    months = 12 * (F.year("m") - F.year("cohort_month")) + F.month("m") - F.month("cohort_month")
    grouped = active.groupBy("cohort_month", months.cast("long").alias("months_since"))
    return grouped.agg(F.count("u").alias("active_users")).orderBy("cohort_month", "months_since")


def zscore_outliers(df: DataFrame, c: str, threshold: float = 3.0, limit: int | None = 100) -> DataFrame:
    fit = facts(df, {"mu": F.avg(clean(df, c)), "sd": F.stddev_samp(clean(df, c))})
    sd = fit["sd"] or None
    z = F.abs((clean(df, c) - F.lit(fit["mu"])) / F.lit(sd))
    found = df.where(z > threshold).withColumn("z_score", F.round(z, 2))
    ties = [q(x).asc_nulls_last() for x in scalar_columns(df)]
    return found if limit is None else found.orderBy(F.col("z_score").desc(), *ties).limit(limit)


def segment(df: DataFrame, g: str, m: str | None = None, limit: int = 50) -> DataFrame:
    measures = [F.sum(q(m)).alias("total"), F.avg(q(m)).alias("average")] if m else []
    grouped = df.groupBy(q(g)).agg(F.count(F.lit(1)).alias("count"), *measures)
    return grouped.orderBy(F.col("count").desc(), q(g).asc_nulls_last()).limit(limit)


def rank_groups(df: DataFrame, cat: str, m: str, n: int = 20) -> DataFrame:
    """Groups by falling total; the rank window sees one row per group, cut to the first n by total and its ties."""
    grouped = df.groupBy(q(cat)).agg(F.sum(q(m)).alias("total"), F.avg(q(m)).alias("average"))
    first = grouped.orderBy(F.col("total").desc_nulls_last(), q(cat).asc_nulls_last()).limit(n)
    w = Window.orderBy(F.col("total").desc_nulls_last())
    return first.withColumn("rank", F.rank().over(w).cast("long")).orderBy("rank", q(cat))


def column_stats(df: DataFrame, c: str) -> DataFrame:
    """Counts, distinct values and, for numbers, min, max, mean, median and sample deviation."""
    x = clean(df, c)
    outputs = [
        F.count(F.lit(1)).alias("count"), F.count(x).alias("non_null"), F.count_if(x.isNull()).alias("null_count"),
        F.count_distinct(x).alias("unique"),
    ]
    if is_numeric(df, c):
        outputs += [
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.lit(quantiles(df, [c], [0.5])[c][0]).alias("median"),
            F.stddev_samp(x).alias("std"),
        ]
    return df.agg(*outputs)


def natural_join(left: DataFrame, right: DataFrame, limit: int | None = 100, key: str | None = None) -> DataFrame:
    """Left join on the first column the two tables share."""
    from lodeframe.plans.spec import join_tables

    key = key or next(c for c in left.columns if c in right.columns)
    joined = join_tables(left, right, "LEFT", [(key, key)])
    return joined if limit is None else joined.limit(limit)


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str, limit: int | None = 100) -> DataFrame:
    """Rows of the left table whose key the right one does not have."""
    keys = right.select(q(right_key).alias("_k")).distinct()
    found = left.join(keys, q(left_key) == F.col("_k"), "left_anti")
    return found if limit is None else found.limit(limit)
