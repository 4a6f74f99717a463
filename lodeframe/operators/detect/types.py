"""Columns stored as another type than they hold, and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import words
from lodeframe.functions.columns import dtype, facts, is_string, q, rows, scalar_columns, value_counts
from lodeframe.functions.dates import parsed_time
from lodeframe.operators.clean.types import currency_value
from lodeframe.operators.detect.findings import DEFINITIVE, JUDGMENT, Finding
from lodeframe.operators.profile.columns import lowered

SHAPES = {"url": words.URL, "email": words.EMAIL, "ip_address": words.IP, "uuid": words.UUID}
SECONDS_SINCE, MILLIS_SINCE = (1e9, 2e10), (1e12, 2e13)


def _texts(df: DataFrame) -> list[str]:
    return [c for c in scalar_columns(df) if is_string(df, c)]


def type_shares(df: DataFrame) -> dict[str, dict]:
    """Per text column how many values read as a date, money, a boolean, JSON, a link and so on.

    Values are counted first, so every test runs once per distinct value, and once for all columns together.
    """
    cols = _texts(df)
    if not cols:
        return {}
    t = F.trim("value")
    low, number = lowered(F.col("value")), t.try_cast("double")
    epoch = ((number > SECONDS_SINCE[0]) & (number < SECONDS_SINCE[1])) | ((number > MILLIS_SINCE[0]) & (number < MILLIS_SINCE[1]))
    tests = {
        "n": F.lit(True),
        "date": parsed_time(t).isNotNull() | F.coalesce(epoch, F.lit(False)),
        "currency": F.when(t.rlike(words.CURRENCY), currency_value(t).isNotNull()),
        "boolean": low.isin(*words.TRUE_WORDS, *words.FALSE_WORDS),
        "json": F.when(t.rlike(r"^[\[{]"), F.try_parse_json(t).isNotNull()),
        "pseudo_null": low.isin(*words.PSEUDO_NULLS),
        "number": number.isNotNull(),
        "word": number.isNull() & ~low.isin(*words.PSEUDO_NULLS),
        **{k: t.rlike(p) for k, p in SHAPES.items()},
    }
    counts = value_counts(df, cols).where("value is not null")
    got = counts.groupBy("column").agg(
        *[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(k) for k, test in tests.items()], F.approx_count_distinct(low).alias("u")
    )
    found = {r["column"]: r.asDict() for r in got.collect()}
    return {c: found.get(c, {"n": 0, "pseudo_null": 0, "number": 0, "word": 0}) for c in cols}


def _type_of(f: dict) -> tuple[str, float] | None:
    n = f["n"]
    if not n:
        return None
    if f["date"] / n > 0.7:
        return "datetime", f["date"] / n
    if f["currency"] / n > 0.7:
        return "currency", f["currency"] / n
    if f["u"] <= 10 and f["boolean"] / n > 0.8:
        return "boolean", f["boolean"] / n
    for kind in ("json", "url", "email", "ip_address", "uuid"):
        if f[kind] / n > 0.7:
            return kind, f[kind] / n
    return None


def integer_categories(df: DataFrame) -> dict[str, int]:
    """Whole-number columns of 2 to 20 values none of which is above 20."""
    whole = [c for c in scalar_columns(df) if isinstance(dtype(df, c), T.IntegralType)]
    got = facts(df, {f"u{i}": F.count_distinct(q(c)) for i, c in enumerate(whole)} | {f"m{i}": F.max(q(c)) for i, c in enumerate(whole)}) if whole else {}
    return {c: got[f"u{i}"] for i, c in enumerate(whole) if 2 <= got[f"u{i}"] <= 20 and got[f"m{i}"] <= 20}


def detect_types(df: DataFrame) -> DataFrame:
    """(column, detected, share, rows_affected): dates, money, booleans, structured texts, codes, placeholders and mixtures."""
    found = []
    for c, f in type_shares(df).items():
        kind = _type_of(f)
        if kind:
            found.append((c, kind[0], round(kind[1], 3), f["n"]))
        if f["pseudo_null"]:
            found.append((c, "pseudo_null", round(f["pseudo_null"] / f["n"], 3), f["pseudo_null"]))
        if f["number"] and f["word"]:
            share = min(f["number"], f["word"]) / (f["number"] + f["word"])
            if share > 0.05:
                found.append((c, "mixed", round(share, 3), min(f["number"], f["word"])))
    found += [(c, "integer_category", 1.0, u) for c, u in integer_categories(df).items()]
    return rows(df.sparkSession, found, "column string, detected string, share double, rows_affected long")


def text_facts(df: DataFrame) -> dict[str, dict]:
    """Free-text columns: many different values of over three words, or long ones."""
    found = {}
    for c in _texts(df):
        t = q(c)
        tests = {
            "html": t.rlike(words.HTML_TAG), "markdown": t.rlike(words.MARKDOWN), "special": t.rlike(r"(?U)[^\w\s.,!?\-'\"()]"), "emoji": t.rlike(words.EMOJI), "url": t.rlike(words.URL_INSIDE),
        }
        f = facts(df, {"n": F.count(t), "u": F.count_distinct(t), "len": F.avg(F.char_length(t)), "words": F.avg(F.regexp_count(t, F.lit(r"(?U)\S+")))} | {k: F.count_if(v) for k, v in tests.items()}).asDict()
        if not f["n"]:
            continue
        unique = f["u"] / f["n"]
        if not ((unique > 0.3 and f["words"] > 3) or (f["len"] > 50 and f["words"] > 5)):
            continue
        marks = {"html": f["html"] > 0, "markdown": f["markdown"] > 0.3 * f["n"], "special": f["special"] > 0.2 * f["n"], "emoji": f["emoji"] > 0, "url": f["url"] > 0}
        actions = []
        if marks["html"] or marks["markdown"]:
            actions.append("normalize_text")
        for least, action in ((3, "extract_text_features"), (10, "remove_stopwords"), (10, "stem_lemmatize"), (20, "tfidf_vectorize")):
            if f["words"] > least:
                actions.append(action)
        found[c] = {"n": f["n"], "avg_tokens": f["words"], "avg_chars": f["len"], "unique_ratio": unique, "actions": actions, **marks}
    return found


def text_columns(df: DataFrame) -> DataFrame:
    found = [
        (c, round(f["avg_tokens"], 1), round(f["avg_chars"], 1), round(f["unique_ratio"], 3), f["html"], f["markdown"], f["special"], f["emoji"], f["url"], f["actions"])
        for c, f in text_facts(df).items()
    ]
    schema = "column string, avg_tokens double, avg_chars double, unique_ratio double, html boolean, markdown boolean, special boolean, emoji boolean, url boolean, actions array<string>"
    return rows(df.sparkSession, found, schema)


_ACTIONS = {"datetime": "parse_dates", "currency": "parse_currency", "boolean": "standardize_booleans", "json": "expand_json", "pseudo_null": "replace_pseudo_nulls", "integer_category": "flag_integer_categories"}


def type_findings(df: DataFrame) -> list[Finding]:
    found = []
    for r in detect_types(df).collect():
        if r["detected"] in _ACTIONS:
            sure = r["detected"] == "pseudo_null" or (r["detected"] in ("datetime", "currency", "boolean") and r["share"] > 0.95)
            found.append(Finding([r["column"]], "type_correction", _ACTIONS[r["detected"]], DEFINITIVE if sure else JUDGMENT, f"{100 * r['share']:.1f} % read as {r['detected']}", r["rows_affected"]))
    for c, f in text_facts(df).items():
        found += [Finding([c], "text_preprocessing", a, JUDGMENT, f"{f['avg_tokens']:.1f} words on average", f["n"]) for a in f["actions"]]
    return found
