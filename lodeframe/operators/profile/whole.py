"""The whole profile of a table: shared facts per column, and the scores that follow from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodeframe.functions.columns import is_numeric, is_string, rows, scalar_columns
from lodeframe.operators.profile import columns as C
from lodeframe.operators.profile import numeric as N
from lodeframe.operators.profile import relations as R
from lodeframe.operators.profile import semantics as S

CATEGORIES = ("categorical_nominal", "categorical_ordinal", "id_key", "hashed", "binary_encoded", "unknown")
TEXTS = ("free_text", "email", "url", "phone", "ip_address")


def profile_facts(df: DataFrame) -> dict[str, dict]:
    """Per column: counts, semantic type, and the facts that fit the type."""
    cols = scalar_columns(df)
    found = C.universal_facts(df, cols)
    kinds = S.semantic_facts(df, cols)
    for c in cols:
        found[c]["semantic"], found[c]["confidence"] = kinds[c]
    numbers = [c for c in cols if kinds[c][0] in S.NUMERIC_TYPES or (kinds[c][0] == "unknown" and is_numeric(df, c))]
    for c, f in (N.numeric_facts(df, numbers) if numbers else {}).items():
        found[c]["numeric"] = f
    texts = [c for c in numbers if is_string(df, c)]
    issues: dict[str, int] = {}
    for r in N.format_issues(df, texts).collect() if texts else []:
        issues[r["column"]] = issues.get(r["column"], 0) + 1
    for c in numbers:
        found[c]["numeric"]["format_issues"] = issues.get(c, 0)
    for c, f in C.categorical_facts(df, [c for c in cols if kinds[c][0] in CATEGORIES and c not in numbers]).items():
        found[c]["categorical"] = f
    for c, f in C.text_facts(df, [c for c in cols if kinds[c][0] in TEXTS]).items():
        found[c]["text"] = f
    for c in cols:
        if kinds[c][0] == "datetime":
            found[c]["datetime"] = C.datetime_facts(df, c)
            found[c]["datetime"]["mixed"] = is_string(df, c) and C.date_formats(df, c).count() > 1
    return found


def quality_of(f: dict) -> tuple[float, list[str]]:
    """100 less penalties for nulls, inconsistent categories, number formats, odd dates and risky texts."""
    score, issues = 100.0, []

    def charge(points: float, what: str) -> None:
        nonlocal score
        score -= points
        issues.append(what)

    for limit, points in ((50, 30), (20, 15), (5, 5)):
        if f["null_pct"] > limit:
            charge(points, "nulls")
            break
    if cat := f.get("categorical"):
        if cat["case_variants"]:
            charge(min(3 * min(cat["case_variants"], 20), 15), "case")
        if cat["whitespace_issues"]:
            charge(5, "white space")
        if cat["special_issues"]:
            charge(10, "special characters")
    if num := f.get("numeric"):
        if num["format_issues"]:
            charge(5 * num["format_issues"], "number formats")
    if when := f.get("datetime"):
        if when["future"]:
            charge(5, "future dates")
        if when["implausible"]:
            charge(10, "implausible dates")
        if when["mixed"]:
            charge(5, "mixed date formats")
    if text := f.get("text"):
        if text["personal"] or text["personal_name"]:
            charge(10, "personal data")
        if text["html"]:
            charge(5, "markup")
    return round(max(0.0, min(100.0, score)), 1), issues


def column_quality(df: DataFrame, known: dict[str, dict] | None = None) -> DataFrame:
    known = known or profile_facts(df)
    found = [(c, *quality_of(f)) for c, f in known.items()]
    return rows(df.sparkSession, found, "column string, quality_score double, issues array<string>")


def profile(df: DataFrame, known: dict[str, dict] | None = None) -> DataFrame:
    """One row per column: type, counts, centre, spread and quality."""
    known = known or profile_facts(df)
    found = []
    for c, f in known.items():
        n = f.get("numeric", {})
        quality, issues = quality_of(f)
        found.append((c, f["semantic"], f["confidence"], f["rows"], f["null_count"], f["null_pct"], f["distinct"], n.get("mean"), n.get("sd"), n.get("min"), n.get("max"), quality, issues))
    schema = (
        "column string, semantic_type string, confidence double, rows long, null_count long, null_pct double, distinct long, mean double, sd double, "
        "min double, max double, quality_score double, issues array<string>"
    )
    return rows(df.sparkSession, found, schema)


def explain_column(df: DataFrame, c: str, others: int = 5) -> DataFrame:
    """(fact, value, text): counts and, for numbers, sample-adjusted shape and its strongest correlations; else the top values."""
    from lodeframe.functions.columns import clean, facts, numeric_columns
    from lodeframe.operators.quantiles import medians
    from pyspark.sql import functions as F

    x = clean(df, c)
    f = facts(df, {"count": F.count(F.lit(1)), "non_null": F.count(x), "unique": F.count_distinct(x)})
    nulls = f["count"] - f["non_null"]
    found = [
        ("count", float(f["count"]), None), ("non_null", float(f["non_null"]), None), ("null_count", float(nulls), None),
        ("null_pct", round(100.0 * nulls / max(f["count"], 1), 2), None), ("unique", float(f["unique"]), None),
        ("unique_ratio", round(f["unique"] / max(f["non_null"], 1), 4), None),
    ]
    if is_numeric(df, c):
        m = N.moments(N.numbers(df, [c]), [c])[c]
        skew, kurt = N.adjusted_shape(m["n"], m["skew"], m["kurt"])
        found += [
            ("mean", round(m["mean"], 4), None), ("median", round(medians(df, [c])[c], 4), None), ("std", round(m["sd"], 4), None), ("min", m["min"], None),
            ("max", m["max"], None), ("skewness", round(skew, 4), None), ("kurtosis", round(kurt, 4), None), ("zeros", float(m["zero"]), None), ("negatives", float(m["neg"]), None),
        ]
        rest = [o for o in numeric_columns(df) if o != c]
        got = R.pearson_pairs(df, R.as_numbers(df, [c, *rest]), [(c, o) for o in rest])
        strong = sorted(((o, r) for (_, o), (r, _) in got.items() if r is not None and abs(r) > 0.3), key=lambda p: -abs(p[1]))
        found += [("correlation", round(r, 3), o) for o, r in strong[:others]]
    else:
        found += [("top_value", float(r["count"]), r["value"]) for r in C.frequencies(df, c).orderBy(F.col("count").desc(), "value").limit(10).collect()]
    return rows(df.sparkSession, found, "fact string, value double, text string")


def profile_frames(df: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every part of the profile by name; a part that fails becomes a warning and the others go on."""
    from lodeframe.operators import keys

    parts: dict[str, Callable[[], DataFrame]] = {
        "table": lambda: C.table_meta(df),
        "columns": lambda: profile(df),
        "values": lambda: C.column_profile(df),
        "numbers": lambda: N.numeric_profile(df, [c for c in scalar_columns(df) if is_numeric(df, c)]),
        "keys": lambda: keys.primary_keys(df),
        "foreign_keys": lambda: keys.foreign_keys(df),
        "ids": lambda: keys.id_columns(df),
        "pairs": lambda: R.strongest_pairs(df),
        "target": lambda: S.detect_target(df),
        "domain": lambda: S.detect_domain(df),
        "places": lambda: S.geo_regions(df),
    }
    frames, warnings = {}, {}
    for name, build in parts.items():
        try:
            frames[name] = build()
        except Exception as e:  # one failing part must not cost the others
            warnings[name] = str(e).splitlines()[0]
    return frames, warnings
