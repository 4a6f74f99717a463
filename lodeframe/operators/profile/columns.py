"""Facts about any column: counts, frequencies, categories, booleans, texts, times and personal data."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import words
from lodeframe.functions.columns import clean, dtype, facts, is_numeric, is_string, is_time, q, rows, scalar_columns, value_counts
from lodeframe.functions.dates import parsed_time
from lodeframe.operators.ordered import median_step, steps
from lodeframe.workspace import ui_type

BATCH = 8


def lowered(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def table_meta(df: DataFrame) -> DataFrame:
    """Rows, columns, share of filled cells and the span of the first time column."""
    cols = df.columns
    times = [c for c in cols if is_time(df, c)]
    aggregates = {"n": F.count(F.lit(1))} | {f"k{i}": F.count(clean(df, c)) for i, c in enumerate(cols)}
    if times:
        aggregates |= {"lo": F.min(q(times[0])).cast("timestamp_ntz"), "hi": F.max(q(times[0])).cast("timestamp_ntz")}
    got = facts(df, aggregates)
    n = got["n"]
    filled = sum(got[f"k{i}"] for i in range(len(cols)))
    span = (got["hi"] - got["lo"]).days if times and got["lo"] is not None else None
    row = (n, len(cols), round(100.0 * filled / (n * len(cols)), 2) if n and cols else 0.0, times[0] if times else None,
           got["lo"] if times else None, got["hi"] if times else None, span)
    return rows(df.sparkSession, [row], "rows long, columns int, completeness double, time_column string, earliest timestamp_ntz, latest timestamp_ntz, span_days long")


def value_kind(c: Column) -> Column:
    """What a text reads as: integer, float, boolean, date or text."""
    text = F.trim(c.cast("string"))
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), "integer").when(text.try_cast("double").isNotNull(), "float")
        .when(F.lower(text).isin("true", "false"), "boolean").when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").otherwise("text")
    )


def type_consistency(df: DataFrame) -> DataFrame:
    """Share of a column's values that read as its most common kind; columns of other types are consistent by nature."""
    texts = [c for c in scalar_columns(df) if is_string(df, c)]
    found = []
    if texts:
        kinds = df.select(*[F.when(q(c).isNotNull(), value_kind(q(c))).alias(c) for c in texts])
        long = kinds.unpivot([], texts, "column", "kind").where("kind is not null")
        counts = long.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(
            F.max_by("kind", F.struct("n", "kind")).alias("kind"), (F.lit(100.0) * F.max("n") / F.sum("n")).alias("pct")
        )
        by_column = {r["column"]: (r["kind"], r["pct"]) for r in best.collect()}
        found = [(c, *by_column.get(c, (None, 100.0))) for c in texts]
    found += [(c, dtype(df, c).simpleString(), 100.0) for c in scalar_columns(df) if c not in texts]
    return rows(df.sparkSession, found, "column string, kind string, consistency_pct double")


def universal_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Rows, nulls and distinct values per column."""
    found = {}
    for start in range(0, len(cols), BATCH):
        batch = cols[start : start + BATCH]
        aggregates = {"n": F.count(F.lit(1))}
        for i, c in enumerate(batch):
            aggregates |= {f"k{i}": F.count(clean(df, c)), f"u{i}": F.count_distinct(clean(df, c))}
        got = facts(df, aggregates)
        for i, c in enumerate(batch):
            n, k, u = got["n"], got[f"k{i}"], got[f"u{i}"]
            found[c] = {
                "rows": n, "null_count": n - k, "null_pct": round(100.0 * (n - k) / n, 2) if n else 0.0, "non_null": k, "distinct": u,
                "distinct_pct": round(100.0 * u / k, 2) if k else 0.0, "ui_type": ui_type(dtype(df, c), u),
            }
    return found


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: nulls, distinct values, the most and least frequent value with their counts, and ten values by hash.

    One pass counts the values of all columns; nothing larger than the counted values is shuffled.
    """
    cols = cols or scalar_columns(df)
    total = df.count()
    counts = value_counts(df, cols)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    order = F.struct(F.col("n"), F.col("value"))
    grouped = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(known), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("most_frequent"),
        F.max(known).alias("most_count"),
        F.min_by("value", F.when(F.col("value").isNotNull(), order)).alias("least_frequent"),
        F.min(known).alias("least_count"),
    )
    pct = lambda part, whole: F.round(F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)), 2)
    return grouped.withColumns({
        "null_pct": pct(F.col("null_count"), F.lit(total)), "distinct_pct": pct(F.col("distinct"), F.col("non_null")),
        "most_pct": pct(F.col("most_count"), F.col("non_null")), "least_pct": pct(F.col("least_count"), F.col("non_null")),
    })


def sample_values(df: DataFrame, c: str, n: int = 10, seed: int = 42) -> DataFrame:
    """A few values picked by hash."""
    values = df.select(q(c).cast("string").alias("value")).where("value is not null")
    return values.orderBy(F.xxhash64("value", F.lit(seed)), "value").limit(n)


def cardinality_class(distinct: int, n: int) -> str:
    ratio = distinct / n if n else 0.0
    if distinct == 2:
        return "binary"
    if ratio == 1.0:
        return "unique"
    if ratio > 0.95:
        return "near_unique"
    for limit, name in ((10, "low"), (50, "medium"), (500, "high")):
        if distinct < limit:
            return name
    return "very_high"


def frequencies(df: DataFrame, c: str) -> DataFrame:
    counts = df.select(q(c).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("value").alias("count"))
    total = facts(counts, {"t": F.sum("count")})["t"] or 0
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("count") / F.lit(max(total, 1)), 2))


def categorical_profile(df: DataFrame, c: str, top: int = 20, bottom: int = 5) -> DataFrame:
    """(part, value, count, pct): the most and the least frequent values."""
    counts = frequencies(df, c)
    most = counts.orderBy(F.col("count").desc(), "value").limit(top).withColumn("part", F.lit("top"))
    least = counts.orderBy("count", F.col("value").desc()).limit(bottom).withColumn("part", F.lit("bottom"))
    return most.unionByName(least)


def word_counts(df: DataFrame, c: str, top: int = 100) -> DataFrame:
    """The most frequent words of two or more characters."""
    found = F.explode(F.regexp_extract_all(F.lower(q(c).cast("string")), F.lit(r"(?U)(\b\w+\b)"), 1))
    counts = df.select(found.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.char_length("word") > 1).orderBy(F.col("count").desc(), "word").limit(top)


def case_variants(df: DataFrame, c: str) -> DataFrame:
    """Values that differ only in case or outer white space."""
    values = df.select(q(c).cast("string").alias("v")).where("v is not null").distinct()
    grouped = values.groupBy(lowered(F.col("v")).alias("normalized")).agg(F.count(F.lit(1)).alias("variant_count"), F.min("v").alias("first"), F.max("v").alias("last"))
    return grouped.where("variant_count > 1")


def categorical_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Case variants, padding, control characters and ordered scales, for many columns at once."""
    if not cols:
        return {}
    texts = df.select(*[q(c).cast("string").alias(c) for c in cols])
    counts = texts.unpivot([], cols, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    norm = counts.withColumn("norm", lowered(F.col("value")))
    variants = norm.groupBy("column", "norm").agg(F.count(F.lit(1)).alias("v")).where("v > 1").groupBy("column").agg(F.count(F.lit(1)).alias("case_variants"))
    scale = [F.min(F.col("norm").isin(*o).cast("int")).alias(f"o{i}") for i, o in enumerate(words.ORDINALS)]
    weigh = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    per = norm.groupBy("column").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top_count"),
        weigh(F.col("value").rlike(r"^\s+")).alias("leading"), weigh(F.col("value").rlike(r"(?s)\s+$")).alias("trailing"),
        weigh(F.col("value").rlike(r"[\x00-\x1f\x7f-\x9f]")).alias("control"), weigh(F.col("value").contains("�")).alias("replacement"), *scale,
    )
    found = {c: {"non_null": 0, "distinct": 0, "top_count": 0, "leading": 0, "trailing": 0, "control": 0, "replacement": 0, "ordinal": None, "case_variants": 0} for c in cols}
    for r in per.collect():
        f = found[r["column"]]
        f |= {k: r[k] for k in ("non_null", "distinct", "top_count", "leading", "trailing", "control", "replacement")}
        f["ordinal"] = next((o for i, o in enumerate(words.ORDINALS) if r[f"o{i}"] == 1), None)
    for r in variants.collect():
        found[r["column"]]["case_variants"] = r["case_variants"]
    for f in found.values():
        f["cardinality"] = cardinality_class(f["distinct"], f["non_null"])
        f["whitespace_issues"] = int(f["leading"] > 0) + int(f["trailing"] > 0)
        f["special_issues"] = int(f["control"] > 0) + int(f["replacement"] > 0)
    return found


def categorical_issues(df: DataFrame, cols: list[str]) -> DataFrame:
    found = [
        (c, f["distinct"], f["cardinality"], f["case_variants"], f["leading"], f["trailing"], f["control"], f["replacement"], list(f["ordinal"]) if f["ordinal"] else None)
        for c, f in categorical_facts(df, cols).items()
    ]
    return rows(df.sparkSession, found, "column string, distinct long, cardinality string, case_variants long, leading long, trailing long, control long, replacement long, ordinal array<string>")


# Steps of regular series in seconds.
FREQUENCIES = (("hourly", 3600.0), ("daily", 86400.0), ("weekly", 604800.0), ("monthly", 2592000.0), ("yearly", 31536000.0))
MONTH_LIMIT = 21.0


def as_times(df: DataFrame, c: str) -> Column:
    if is_time(df, c):
        return q(c).cast("timestamp")
    return parsed_time(q(c).cast("string"))


def datetime_facts(df: DataFrame, c: str, now: dt.datetime | None = None) -> dict:
    """Span, density, step between values, gaps, odd dates and uneven months."""
    table = df.select(as_times(df, c).alias("t"))
    now = F.lit(now) if now else F.current_timestamp()
    f = facts(table, {
        "n": F.count("t"), "u": F.count_distinct("t"), "lo": F.min(F.unix_micros("t")), "hi": F.max(F.unix_micros("t")),
        "future": F.count_if(F.col("t") > now), "implausible": F.count_if((F.year("t") < 1900) | (F.year("t") > 2100)),
        **{f"m{m}": F.count_if(F.month("t") == m) for m in range(1, 13)},
    }).asDict()
    found = {"n": f["n"], "distinct": f["u"], "future": f["future"], "implausible": f["implausible"], "gaps": 0, "frequency": None, "median_step": None, "span_days": None, "density": None}
    if not f["n"]:
        return found
    found["lo"], found["hi"] = f["lo"] / 1e6, f["hi"] / 1e6
    found["span_days"] = (f["hi"] - f["lo"]) / 1e6 / 86400
    found["density"] = f["n"] / found["span_days"] if found["span_days"] > 0 else None
    if f["n"] >= 2:
        gaps = steps(table, "t")
        median = median_step(gaps, f["u"], f["n"])
        near = {k: F.count_if(F.abs(F.col("gap") - s) < 0.3 * s) for k, s in FREQUENCIES}
        g = facts(gaps, near | {"wide": F.count_if(F.col("gap") > 3 * median)})
        found["median_step"], found["gaps"] = median, g["wide"]
        found["frequency"] = "irregular"
        for k, s in FREQUENCIES:
            if median < 1.5 * s and g[k] / (f["n"] - 1) > 0.2:
                found["frequency"] = k
                break
    months = [f[f"m{m}"] for m in range(1, 13)]
    present = [m for m in months if m]
    found["seasonal"] = None
    if found["span_days"] > 365 and len(present) >= 4:
        expected = f["n"] / 12
        found["month_chi2"] = sum((m - expected) ** 2 / expected for m in present)
        found["seasonal"] = found["month_chi2"] > MONTH_LIMIT
    return found


def datetime_profile(df: DataFrame, c: str, now: dt.datetime | None = None) -> DataFrame:
    f = datetime_facts(df, c, now)
    row = (c, f["n"], f.get("lo"), f.get("hi"), f["span_days"], f["density"], f["median_step"], f["frequency"], f["gaps"], f["future"], f["implausible"], f.get("month_chi2"), f.get("seasonal"))
    return rows(df.sparkSession, [row], "column string, n long, earliest double, latest double, span_days double, density double, median_step double, frequency string, gaps long, future long, implausible long, month_chi2 double, seasonal boolean")


def datetime_gaps(df: DataFrame, c: str) -> DataFrame:
    """Every interval longer than three times the median one, in seconds since 1970."""
    table = df.select(as_times(df, c).alias("t"))
    f = facts(table, {"n": F.count("t"), "u": F.count_distinct("t")})
    gaps = steps(table, "t")
    median = median_step(gaps, f["u"], f["n"]) or 0.0
    return gaps.where(F.col("gap") > 3 * median).withColumn("duration_days", F.round(F.col("gap") / 86400, 2))


def date_formats(df: DataFrame, c: str) -> DataFrame:
    """Formats that over a tenth of the texts begin with."""
    text = q(c).cast("string")
    got = facts(df, {"n": F.count(text)} | {f"f{i}": F.count_if(text.rlike(p)) for i, (p, _) in enumerate(words.DATE_SHAPES)})
    found = [(name, got[f"f{i}"]) for i, (_, name) in enumerate(words.DATE_SHAPES) if got["n"] and got[f"f{i}"] > 0.1 * got["n"]]
    return rows(df.sparkSession, found, "format string, count long")


def boolean_profile(df: DataFrame, c: str) -> DataFrame:
    """Counts of true and false for booleans, 0/1 numbers and known pairs of words; else of the two values there are."""
    kind = dtype(df, c).simpleString()
    schema = "column string, true_value string, false_value string, true_count long, false_count long, true_ratio double, false_ratio double, disguised boolean"
    x = lowered(clean(df, c).cast("double")) if is_numeric(df, c) else lowered(q(c))
    pairs = [("1.0", "0.0")] if is_numeric(df, c) else [(a, b) if a in words.POSITIVE or b not in words.POSITIVE else (b, a) for a, b in words.BOOLEAN_PAIRS]
    got = facts(df, {"n": F.count(x)} | {f"a{i}": F.count_if(x == a) for i, (a, _) in enumerate(pairs)} | {f"b{i}": F.count_if(x == b) for i, (_, b) in enumerate(pairs)})
    n = got["n"]
    match = next(((a, b, got[f"a{i}"], got[f"b{i}"]) for i, (a, b) in enumerate(pairs) if n and got[f"a{i}"] + got[f"b{i}"] == n), None)
    if match is None:
        counts = df.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
        two = counts.orderBy(F.col("n").desc(), "v").limit(3).collect()
        if len(two) != 2:
            return rows(df.sparkSession, [], schema)
        match = (two[0]["v"], two[1]["v"], two[0]["n"], two[1]["n"])
    a, b, na, nb = match
    return rows(df.sparkSession, [(c, a, b, na, nb, round(na / n, 4), round(nb / n, 4), kind != "boolean")], schema)


def _holds(t: Column, needed: str) -> Column:
    """Whether a text holds a single character, which is told from its bytes, or a pattern."""
    return t.contains(needed) if len(needed) == 1 else t.rlike(needed)


#: Bytes that are no letter of the first script.
_NO_LETTER = bytes(b for b in range(256) if b > 127 or not re.match(words.SCRIPTS["English"], chr(b)))


@F.pandas_udf(T.StructType([T.StructField("letters", T.LongType()), T.StructField("tokens", T.LongType())]))
def _letters_and_tokens(texts: pd.Series) -> pd.DataFrame:
    """Letters of the first script and words between ASCII white space; null for null."""
    raw = texts.map(str.encode, na_action="ignore")
    return pd.DataFrame({
        "letters": raw.map(lambda b: len(b.translate(None, _NO_LETTER)), na_action="ignore").astype("Int64"),
        "tokens": raw.map(lambda b: len(b.split()), na_action="ignore").astype("Int64"),
    })


def text_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Lengths, words, scripts, mentions, markup and personal data over every text.

    A long pattern is looked for only in texts that hold what it needs. All scripts but the first are looked for beyond ASCII, which is
    taken once out of the texts that have other characters; a script's characters are what is left without the others.
    """
    found = {}
    for c in cols:
        t = q(c).cast("string")
        beyond = F.when(F.octet_length(t) > F.char_length(t), F.regexp_replace(t, r"[\x00-\x7F]+", ""))
        texts = df.select(t.alias("t"), beyond.alias("beyond"), _letters_and_tokens(t).alias("counts"))
        t = F.col("t")
        able = lambda kind: F.when(_holds(t, words.NEEDED[kind]), t) if kind in words.NEEDED else t
        of_script = lambda k, p: F.col("counts.letters") if k == "English" else F.char_length(F.regexp_replace("beyond", f"[^{p[1:-1]}]+", ""))
        aggregates = {
            "n": F.count(t), "avg_length": F.avg(F.char_length(t)), "min_length": F.min(F.char_length(t)), "max_length": F.max(F.char_length(t)),
            "chars": F.sum(F.char_length(t)), "avg_tokens": F.avg("counts.tokens"),
            **{f"s_{k}": F.sum(of_script(k, p)) for k, p in words.SCRIPTS.items()},
            **{f"e_{k}": F.sum(F.regexp_count(able(k), F.lit(p))) for k, (p, _) in words.ENTITIES.items()},
            **{f"m_{k}": F.count_if(able(k).rlike(p)) for k, p in words.MARKUP.items()},
            **{f"p_{k}": F.count_if(able(k).rlike(p)) for k, p in words.PERSONAL.items()},
        }
        got = facts(texts, aggregates).asDict()
        n = got["n"]
        scripts = {k: got[f"s_{k}"] or 0 for k in words.SCRIPTS}
        best = max(scripts, key=lambda k: scripts[k]) if any(scripts.values()) else "unknown"
        total = (got["chars"] or 0) + max(0, n - 1)
        f = {k: got[k] for k in ("n", "avg_length", "min_length", "max_length", "avg_tokens")}
        f["language"] = best
        f["language_confidence"] = min(2 * scripts.get(best, 0) / total, 0.99) if total else 0.0
        f["entities"] = [k for k, (_, least) in words.ENTITIES.items() if (got[f"e_{k}"] or 0) > least]
        f["html"], f["markdown"] = (n > 0 and got[f"m_{k}"] > 0.05 * n for k in ("html", "markdown"))
        f["personal"] = {k: got[f"p_{k}"] for k in words.PERSONAL if got[f"p_{k}"]}
        f["personal_name"] = c.lower().strip() in words.NAME_COLUMNS or any(w in c.lower() for w in ("name", "person"))
        found[c] = f
    return found


def text_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    found = [
        (c, f["n"], f["avg_length"], f["min_length"], f["max_length"], f["avg_tokens"], f["language"], f["language_confidence"], f["entities"], f["html"], f["markdown"])
        for c, f in text_facts(df, cols).items()
    ]
    return rows(df.sparkSession, found, "column string, n long, avg_length double, min_length int, max_length int, avg_tokens double, language string, language_confidence double, entities array<string>, html boolean, markdown boolean")


def masked(c: Column) -> Column:
    """The first and last two characters with stars between; short texts become four stars."""
    n = F.char_length(c)
    return F.when(n <= 4, F.lit("****")).otherwise(F.concat(F.substring(c, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(c, -2, 2)))


def pii_scan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, kind, count, pct, confidence, example): texts with personal data, the example masked."""
    cols = cols or [c for c in scalar_columns(df) if is_string(df, c)]
    tests = [(c, k) for c in cols for k in words.PERSONAL]
    hits = df.select(
        *[q(c).isNotNull().alias(f"k{i}") for i, c in enumerate(cols)],
        *[F.when(q(c).rlike(words.PERSONAL[k]), F.struct(F.xxhash64(q(c)).alias("h"), masked(q(c)).alias("m"))).alias(f"t{i}") for i, (c, k) in enumerate(tests)],
    )
    aggregates = {f"n{i}": F.count_if(F.col(f"k{i}")) for i in range(len(cols))}
    for i in range(len(tests)):
        aggregates |= {f"c{i}": F.count(f"t{i}"), f"x{i}": F.min(f"t{i}")}
    got = facts(hits, aggregates)
    found = []
    for i, c in enumerate(cols):
        if c.lower().strip() in words.NAME_COLUMNS or any(w in c.lower() for w in ("name", "person")):
            found.append((c, "personal_name", None, None, "medium", None))
    for i, (c, k) in enumerate(tests):
        n, hits = got[f"n{cols.index(c)}"], got[f"c{i}"]
        if hits:
            found.append((c, k, hits, round(100.0 * hits / n, 2), "high" if hits / n > 0.1 else "medium", got[f"x{i}"]["m"]))
    return rows(df.sparkSession, found, "column string, kind string, count long, pct double, confidence string, example string")
