"""Texts and numbers written in several ways, and single cells to repair."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, dtype, facts, is_string, numeric_columns, q, rows, scalar_columns
from lodeframe.operators.clean.text import unicode_nfc
from lodeframe.operators.detect.features import peaks
from lodeframe.operators.detect.findings import DEFINITIVE, JUDGMENT, Finding
from lodeframe.operators.edits import near_texts
from lodeframe.session import cut

REPAIRS = 200

# Short and long forms of one thing.
ABBREVIATIONS = (
    ("usa", "us"), ("united states", "us"), ("united states of america", "usa"), ("uk", "united kingdom"), ("gb", "great britain"), ("ca", "california"),
    ("ny", "new york"), ("mr", "mister"), ("mrs", "missus"), ("dr", "doctor"), ("jan", "january"), ("feb", "february"), ("mar", "march"),
)
# Ratios of units that get mixed.
UNIT_RATIOS = (
    (2.2046, "kg/lbs"), (0.4536, "lbs/kg"), (2.54, "inches/cm"), (0.3937, "cm/inches"), (1.6093, "miles/km"), (0.6214, "km/miles"), (33.814, "liters/oz"),
    (0.02957, "oz/liters"), (1.8, "celsius/fahrenheit"),
)
# Names of columns with a format of their own.
FORMAT_COLUMNS = {
    "phone": r"(phone|tel|mobile|fax|cell|contact_number)", "email": r"(email|e[-_]?mail|mail_address)", "url": r"(url|link|website|homepage|webpage|uri)",
}
# Domains of throw-away addresses.
DISPOSABLE = ("mailinator.com", "tempmail.com", "guerrillamail.com")
FULL_WIDTH = r"[\x{FF01}-\x{FF5E}]"


def _texts(df: DataFrame) -> list[str]:
    return [c for c in scalar_columns(df) if is_string(df, c)]


def _case_of(c: Column) -> Column:
    letters = c.rlike(r"\p{L}")
    return (
        F.when(letters & (c == F.upper(c)), "upper").when(letters & (c == F.lower(c)), "lower")
        .when(letters & c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{L}\p{Lu}") & ~c.rlike(r"(^|[^\p{L}])\p{Ll}"), "title").otherwise("mixed")
    )


def text_consistency(df: DataFrame) -> DataFrame:
    """(column, issue, count): several casings among the distinct values, padding, and characters of odd forms."""
    found = []
    for c in _texts(df):
        values = df.select(q(c).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
        normal = unicode_nfc(values, ["v"]).select("v")
        wide = values.withColumn("case", _case_of(F.col("v")))
        weigh = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        got = facts(wide, {
            "n": F.coalesce(F.sum("n"), F.lit(0)), "u": F.count(F.lit(1)), **{k: F.count_if(F.col("case") == k) for k in ("upper", "lower", "title", "mixed")},
            "leading": weigh(F.col("v").rlike(r"(?U)^\s")), "trailing": weigh(F.col("v").rlike(r"(?sU)\s$")), "multiple": weigh(F.col("v").rlike(r"(?U)\s{2,}")),
            "full_width": weigh(F.col("v").rlike(FULL_WIDTH)), "mixed_script": weigh(F.col("v").rlike(r"\p{IsLatin}") & F.col("v").rlike(r"\p{IsCyrillic}")),
        })
        if got["n"] < 3:
            continue
        cases = {k: got[k] for k in ("upper", "lower", "title", "mixed") if got[k]}
        odd = sum(cases.values()) - max(cases.values(), default=0)
        if len(cases) > 1 and odd >= 2:
            found.append((c, "casing", odd))
        spaces = got["leading"] + got["trailing"] + got["multiple"]
        if spaces >= 2:
            found.append((c, "whitespace", spaces))
        composed = values.where(F.col("v").rlike(r"[^\x00-\x7F]"))
        changed = composed.join(normal.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left_anti")
        unusual = (facts(changed, {"n": F.coalesce(F.sum("n"), F.lit(0))})["n"]) + got["full_width"] + got["mixed_script"]
        if unusual:
            found.append((c, "unicode", unusual))
    return rows(df.sparkSession, found, "column string, issue string, count long")


def synonyms(df: DataFrame, c: str) -> DataFrame:
    """(canonical, variant, rows): values equal but for case and marks, or known short forms, under the most frequent one, in columns of three values or more."""
    counts = df.select(q(c).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    schema = "canonical string, variant string, rows long"
    if counts.limit(3).count() < 3:
        return rows(df.sparkSession, [], schema)
    low = F.regexp_replace(F.lower("v"), r"^\.+|\.+$", "")
    groups: dict[str, str] = {}
    for a, b in ABBREVIATIONS:
        root = groups.get(a) or groups.get(b) or f"~{a}"
        groups[a] = groups[b] = root
    core = F.regexp_replace(F.lower("v"), "[^a-z0-9]", "")
    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    keyed = counts.withColumn("c0", core).withColumn("core", F.coalesce(F.element_at(known, low), F.element_at(known, F.col("c0")), F.col("c0")))
    best = keyed.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("canonical")).where("k > 1")
    return keyed.join(best, "core").select("canonical", F.col("v").alias("variant"), F.col("n").alias("rows"))


def _phone(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when(F.regexp_replace(s, r"[\s\-()]", "").rlike(r"^\+\d{8,17}$"), "e164").when(s.rlike(r"^\(\d{3}\)\s?\d{3}[-.]?\d{4}$"), "us_parens")
        .when(s.rlike(r"^\d{3}[-.]?\d{3}[-.]?\d{4}$"), "us_dashed").when(s.startswith("+"), "intl").otherwise("other")
    )


def _currency(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^[$€£¥₹₽₩]"), F.substring(s, 1, 1)).when(s.rlike(r"[A-Z]{3}$"), F.regexp_extract(s, r"([A-Z]{3})$", 1))


def _email(c: Column) -> list[Column]:
    domain = F.substring_index(F.lower(F.trim(c)), "@", -1)
    return [
        F.when(c.rlike("[A-Z]"), "upper_case"), F.when(c.rlike(r"\s"), "white_space"), F.when(~c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid"),
        F.when(c.contains("@") & domain.isin(*DISPOSABLE), "disposable"),
    ]


def _url(c: Column) -> list[Column]:
    return [
        F.when(c.startswith("http://"), "http"), F.when(c.startswith("https://"), "https"), F.when(c.endswith("/"), "trailing_slash"),
        F.when(c.contains("utm_"), "tracking"), F.when(c.rlike("%[0-9a-fA-F]{2}"), "encoded"),
    ]


def format_mix(df: DataFrame, c: str, kind: str | None = None) -> DataFrame:
    """(format, count) of phone numbers, addresses, links or currencies; the kind is told by the column's name."""
    kind = kind or next((k for k, w in FORMAT_COLUMNS.items() if re.search(w, c, re.IGNORECASE)), "currency")
    t = q(c).cast("string")
    marks = {"phone": lambda: [_phone(t)], "currency": lambda: [_currency(t)], "email": lambda: _email(t), "url": lambda: _url(t)}[kind]()
    named = df.where(t.isNotNull()).select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("format"))
    return named.groupBy("format").agg(F.count(F.lit(1)).alias("count"))


def precision_mix(df: DataFrame, c: str) -> DataFrame:
    """(decimals, count): how many places the numbers are written with."""
    text = F.regexp_replace(F.format_string("%.15f", F.round(clean(df, c).cast("double"), 12)), r"0+$", "")
    places = F.char_length(F.element_at(F.split(text, r"\."), 2))
    return df.where(clean(df, c).isNotNull()).groupBy(places.cast("long").alias("decimals")).agg(F.count(F.lit(1)).alias("count"))


def unit_mix(df: DataFrame, c: str) -> DataFrame:
    """(column, peaks, ratio, suspected): two peaks of the density whose places differ by a known ratio of units."""
    at = peaks(df, c, 200)
    schema = "column string, peaks int, ratio double, suspected string"
    if len(at) < 2:
        return rows(df.sparkSession, [], schema)
    ratio = at[0] / at[1] if at[1] else 0.0
    inverse = at[1] / at[0] if at[0] else 0.0
    unit = next((u for r, u in UNIT_RATIOS if 0.9 < ratio / r < 1.1 or 0.9 < inverse / r < 1.1), None)
    return rows(df.sparkSession, [(c, len(at), round(ratio, 4), unit)], schema)


# repairs of single cells

REPAIR = "key string, column string, current string, suggested string, confidence double, kind string"


def _edits(a: Column, b: Column) -> Column:
    """The edits allowed between texts of two lengths."""
    return F.floor(F.greatest(F.lit(2.0), F.greatest(a, b, F.lit(1)) * 0.3))


def repair_typos(df: DataFrame, c: str, key: str) -> DataFrame:
    """Values seen once that are a few letters off a frequent one: two, or three tenths of the longer one's length.

    Of the frequent values within reach a rare one keeps the nearest, then the most frequent. Values two edits off are looked for first, as
    their pieces are long and shared by few; only rare values without any go on to the wider search.
    """
    counts = df.select(q(c).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    rare, frequent = counts.where("n = 1").select("v"), counts.where("n > 1").select(F.col("v").alias("f"), F.col("n").alias("uses"))

    def nearest_of(found: DataFrame) -> DataFrame:
        best = found.join(frequent, "f").groupBy("v").agg(F.min(F.struct("d", (-F.col("uses")).alias("less"), "f")).alias("b"))
        return best.select("v", "b.d", "b.f")

    wide = lambda n: F.sequence(F.greatest(F.lit(0), F.least(n - 2, F.ceil(n * 0.7).cast("int"))), F.greatest(n + 2, F.floor((n + 0.001) / 0.7).cast("int")))
    close = cut(nearest_of(near_texts(rare, frequent, lambda a, b: F.lit(2), lambda n: F.sequence(F.greatest(F.lit(0), n - 2), n + 2))))
    best = close.unionByName(nearest_of(near_texts(rare.join(close, "v", "left_anti"), frequent, _edits, wide))).where("d > 0")
    longest = F.greatest(F.char_length("v"), F.char_length("f"), F.lit(1))
    once = df.select(q(key).cast("string").alias("key"), q(c).alias("v")).join(best, "v")
    sure = F.round(F.greatest(F.lit(0.5), 1 - F.col("d") / longest), 2)
    return once.select("key", F.lit(c).alias("column"), F.col("v").alias("current"), F.col("f").alias("suggested"), sure.alias("confidence"), F.lit("typo").alias("kind"))


def repair_numeric(df: DataFrame, c: str, key: str) -> DataFrame:
    """Numbers over four deviations out: a tenth, hundredth or thousandth if that is usual, else the mean."""
    x = clean(df, c).cast("double")
    f = facts(df, {"n": F.count(x), "m": F.avg(x), "s": F.stddev_samp(x)})
    if f["n"] < 10 or not f["s"]:
        return rows(df.sparkSession, [], REPAIR)
    z = F.abs(x - F.lit(f["m"])) / F.lit(f["s"])
    usual = lambda v: F.abs(v - F.lit(f["m"])) < 2 * f["s"]
    fixed = F.coalesce(*[F.when((x != 0) & usual(x / k) & (F.round(x / k, 2) != 0), F.round(x / k, 2)) for k in (10, 100, 1000)], F.lit(round(f["m"], 2)))
    sure = F.round(F.greatest(F.lit(0.5), 1 - 1 / z), 2)
    return df.where(z > 4).select(
        q(key).cast("string").alias("key"), F.lit(c).alias("column"), x.cast("string").alias("current"), fixed.cast("string").alias("suggested"),
        sure.alias("confidence"), F.lit("outlier").alias("kind"),
    )


# Date formats told apart for repairs.
REPAIR_FORMATS = (("us", r"^\d{1,2}/\d{1,2}/\d{2,4}$"), ("eu", r"^\d{1,2}-\d{1,2}-\d{2,4}$"), ("iso", r"^\d{4}-\d{2}-\d{2}"))


def repair_dates(df: DataFrame, c: str, key: str) -> DataFrame:
    """Dates in a format under three tenths as frequent as the usual one."""
    text = F.trim(q(c).cast("string"))
    kind = F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in REPAIR_FORMATS])
    got = facts(df, {k: F.count_if(kind == k) for k, _ in REPAIR_FORMATS}).asDict()
    seen = {k: n for k, n in got.items() if n}
    if len(seen) < 2:
        return rows(df.sparkSession, [], REPAIR)
    usual = max(seen, key=lambda k: seen[k])
    odd = [k for k, n in seen.items() if k != usual and n < 0.3 * seen[usual]]
    return df.where(kind.isin(*odd) if odd else F.lit(False)).select(
        q(key).cast("string").alias("key"), F.lit(c).alias("column"), q(c).cast("string").alias("current"), F.lit(f"as {usual}").alias("suggested"),
        F.lit(0.7).alias("confidence"), F.lit("date_format").alias("kind"),
    )


def cell_repairs(df: DataFrame, key: str, top: int | None = REPAIRS) -> DataFrame:
    """The `top` suggestions, the surest first; None: all."""
    found = rows(df.sparkSession, [], REPAIR)
    for c in scalar_columns(df):
        if c == key:
            continue
        if is_string(df, c):
            found = found.unionByName(repair_typos(df, c, key)).unionByName(repair_dates(df, c, key))
        elif c in numeric_columns(df):
            found = found.unionByName(repair_numeric(df, c, key))
    return found if top is None else found.orderBy(F.col("confidence").desc(), "column", "key").limit(top)


_FIXES = {"casing": "standardize_casing", "whitespace": "standardize_whitespace", "unicode": "normalize_unicode"}


def consistency_findings(df: DataFrame) -> list[Finding]:
    found = []
    for r in text_consistency(df).collect():
        sure = r["issue"] in ("whitespace", "unicode")
        found.append(Finding([r["column"]], "data_standardization", _FIXES[r["issue"]], DEFINITIVE if sure else JUDGMENT, f"{r['count']} values", r["count"]))
    for c in _texts(df):
        groups: dict[str, list] = {}
        for r in synonyms(df, c).collect():
            groups.setdefault(r["canonical"], []).append(r)
        if groups:
            clusters = [{"canonical": k, "variants": sorted(r["variant"] for r in v)} for k, v in sorted(groups.items())]
            found.append(Finding([c], "data_standardization", "consolidate_synonyms", JUDGMENT, f"{len(groups)} groups", sum(r["rows"] for v in groups.values() for r in v), {"clusters": clusters}))
        kind = next((k for k, w in FORMAT_COLUMNS.items() if re.search(w, c, re.IGNORECASE)), None)
        if kind:
            mix = {r["format"]: r["count"] for r in format_mix(df, c, kind).collect()}
            if len(mix) > 1:
                found.append(Finding([c], "data_standardization", f"standardize_{kind}", JUDGMENT, f"{len(mix)} formats", sum(mix.values()), {"formats": mix}))
    for c in numeric_columns(df):
        if dtype(df, c).simpleString() in ("double", "float"):
            mix = {r["decimals"]: r["count"] for r in precision_mix(df, c).collect()}
            usual = max(mix, key=lambda k: mix[k], default=None)
            if usual is not None and sum(mix.values()) - mix[usual] >= 3:
                found.append(Finding([c], "data_standardization", "standardize_precision", JUDGMENT, f"{len(mix)} precisions", sum(mix.values()) - mix[usual], {"dominant_precision": usual}))
    return found
