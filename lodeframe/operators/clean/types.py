"""Texts turned into dates, numbers, booleans and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import words
from lodeframe.functions.columns import facts, q
from lodeframe.functions.dates import parsed_time
from lodeframe.sources.nested import flatten


def parse_dates(df: DataFrame, cols: list[str], formats: tuple[str, ...] = words.DATE_FORMATS) -> DataFrame:
    """The first format that fits each value; none fits: null."""
    return df.withColumns({c: parsed_time(q(c).cast("string"), formats) for c in cols})


def currency_value(c: Column) -> Column:
    """Symbols, thousands, brackets or a minus for negatives, percent, and K/M/B/T multiples."""
    text = F.trim(c)
    bracketed = text.rlike(r"^\(.*\)$")
    text = F.when(bracketed, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
    negative = bracketed | text.startswith("-")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "^-", ""), f"[{words.CURRENCY_SYMBOLS}]", ""))
    percent = text.endswith("%")
    last = F.upper(F.substring(text, -1, 1))
    scale = F.lit(1.0)
    for letter, factor in words.SUFFIXES.items():
        scale = F.when(last == letter, F.lit(factor)).otherwise(scale)
    body = F.when(percent, F.regexp_replace(text, "%$", "")).otherwise(F.regexp_replace(text, "(?i)[kmbt]$", ""))
    number = F.trim(F.regexp_replace(body, ",", "")).try_cast("double")
    number = F.when(percent, number / 100).otherwise(number * scale)
    return F.when(negative, -number).otherwise(number)


def parse_currency(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: currency_value(q(c).cast("string")) for c in cols})


def standardize_booleans(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of nothing but known words become boolean; in others the known words become 'true' and 'false'."""
    word = {c: F.lower(F.trim(q(c).cast("string"))) for c in cols}
    known = words.TRUE_WORDS + words.FALSE_WORDS
    strange = facts(df, {c: F.count_if(w.isNotNull() & ~w.isin(*known)) for c, w in word.items()})
    out = {}
    for c, w in word.items():
        if strange[c]:
            out[c] = F.when(w.isin(*words.TRUE_WORDS), "true").when(w.isin(*words.FALSE_WORDS), "false").otherwise(q(c).cast("string"))
        else:
            out[c] = F.when(w.isNotNull(), w.isin(*words.TRUE_WORDS))
    return df.withColumns(out)


def replace_pseudo_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Placeholders become null; the column becomes numeric when all that is left are numbers."""
    left = {c: F.when(~F.lower(F.trim(q(c).cast("string"))).isin(*words.PSEUDO_NULLS), q(c).cast("string")) for c in cols}
    texts = facts(df, {c: F.count_if(v.isNotNull() & v.try_cast("double").isNull()) for c, v in left.items()})
    return df.withColumns({c: v if texts[c] else v.try_cast("double") for c, v in left.items()})


def as_category(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers that are labels, as strings."""
    return df.withColumns({c: q(c).cast("string") for c in cols})


def json_schema(df: DataFrame, c: str) -> str:
    """One schema that holds every object of the column, merged by Spark over the whole table."""
    objects = F.when(q(c).rlike(r"^\s*\{"), F.try_parse_json(q(c)))
    found = facts(df.where(objects.isNotNull()), {"s": F.schema_of_variant_agg(objects)})["s"]
    return (found or "").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def expand_json(df: DataFrame, cols: list[str]) -> DataFrame:
    """<c>_<field> for every field of the objects in a JSON text column."""
    for c in cols:
        schema = json_schema(df, c)
        if not schema.startswith("STRUCT<"):
            continue
        parsed = df.select("*", F.from_json(q(c), schema).alias("_json"))
        fields = parsed.select("_json.*").schema.fieldNames()
        flat = flatten(parsed.select(F.struct("_json.*").alias("_j"))).columns if fields else []
        parsed = parsed.select(*[q(x) for x in df.columns if x != c], *[F.col("_json").getField(f).alias(f"{c}_{f}") for f in fields])
        df = flatten(parsed, only=[f"{c}_{f}" for f in fields]) if any("." in f or "[" in f for f in flat) else parsed
    return df
