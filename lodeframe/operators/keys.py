"""Join keys: suggestions between tables, cardinality, foreign keys, primary keys and ID columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import clean, dtype, facts, is_numeric, is_string, q, rows, scalar_columns

HUGE_PRODUCT = 10_000_000
#: Keys are first looked for duplicates in one of so many parts of the rows.
PARTS = 64
MANY_TO_MANY = "Many-to-many join may multiply rows; remove duplicates first."
LARGE_PRODUCT = "Large product of distinct keys; the join may be slow."


def _comparable(df: DataFrame, c: str) -> Column:
    """Values as text under their kind, so that only compatible types can meet."""
    if is_numeric(df, c):
        return F.concat(F.lit("n:"), clean(df, c).cast("double").cast("string"))
    kind = "s" if is_string(df, c) else dtype(df, c).simpleString()
    return F.concat(F.lit(kind + ":"), q(c).cast("string"))


def _distinct_values(df: DataFrame, side: str, cols: list[str]) -> DataFrame:
    long = df.select(*[_comparable(df, c).alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return long.where("value is not null").distinct().withColumn("side", F.lit(side))


def _overlaps(values: DataFrame) -> DataFrame:
    """(left, right, overlap): per value only the few columns that hold it meet, never rows."""
    holders = values.groupBy("value").agg(
        F.collect_set(F.when(F.col("side") == "l", F.col("column"))).alias("ls"),
        F.collect_set(F.when(F.col("side") == "r", F.col("column"))).alias("rs"),
    )
    pairs = holders.where((F.size("ls") > 0) & (F.size("rs") > 0)).select(F.explode("ls").alias("left"), "rs")
    pairs = pairs.select("left", F.explode("rs").alias("right"))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("overlap"))


def _relationship(left_rows: int, left_unique: int, right_rows: int, right_unique: int) -> tuple[str, str | None]:
    left_once, right_once = left_unique >= left_rows, right_unique >= right_rows
    kind = {(True, True): "1:1", (True, False): "1:N", (False, True): "N:1", (False, False): "N:M"}[(left_once, right_once)]
    if kind == "N:M":
        return kind, MANY_TO_MANY
    return kind, LARGE_PRODUCT if left_unique * right_unique > HUGE_PRODUCT else None


def join_cardinality(left: DataFrame, right: DataFrame, lc: str, rc: str) -> DataFrame:
    a = facts(left, {"n": F.count(F.lit(1)), "u": F.count_distinct(clean(left, lc))})
    b = facts(right, {"n": F.count(F.lit(1)), "u": F.count_distinct(clean(right, rc))})
    kind, warning = _relationship(a["n"], a["u"], b["n"], b["u"])
    return rows(
        left.sparkSession, [(kind, a["u"], b["u"], warning)],
        "relationship string, left_unique long, right_unique long, warning string",
    )


def suggest_joins(left: DataFrame, right: DataFrame, top: int = 10) -> DataFrame:
    """Column pairs that may join the two tables: same name with common values, or other names with a wide overlap."""
    lcols, rcols = scalar_columns(left), scalar_columns(right)
    values = _distinct_values(left, "l", lcols).unionByName(_distinct_values(right, "r", rcols))
    unique = {(r["side"], r["column"]): r["n"] for r in values.groupBy("side", "column").agg(F.count("value").alias("n")).collect()}
    ln, rn = left.count(), right.count()
    found = []
    for r in _overlaps(values).collect():
        a, b, overlap = r["left"], r["right"], r["overlap"]
        lu, ru = unique[("l", a)], unique[("r", b)]
        if lu < 2 or ru < 2:
            continue
        share = overlap / (lu + ru - overlap)
        if a == b:
            kind, confidence = "exact_name", round(min(share, 1.0), 2)
        elif lu <= ln * 0.95 and overlap >= 0.3 * max(lu, ru):
            kind, confidence = "value_overlap", round(share / 2, 2)
        else:
            continue
        relationship, _ = _relationship(ln, lu, rn, ru)
        found.append((a, b, confidence, kind, overlap, round(100 * share, 1), lu, ru, relationship))
    found.sort(key=lambda f: (-f[2], f[3], f[0], f[1]))
    schema = (
        "left_column string, right_column string, confidence double, match_type string, overlap_count long, "
        "overlap_pct double, left_unique long, right_unique long, relationship string"
    )
    return rows(left.sparkSession, found[:top], schema)


def foreign_keys(df: DataFrame, top: int = 10) -> DataFrame:
    """Columns of one table whose distinct values are at least 95 % contained in another column."""
    cols = scalar_columns(df)
    values = _distinct_values(df, "l", cols)
    unique = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("value").alias("n")).collect()}
    n = df.count()
    eligible = [c for c in cols if 2 < unique.get(c, 0) < 0.8 * n]
    some = values.where(F.col("column").isin(eligible)) if eligible else values.where(F.lit(False))
    found = []
    for r in _overlaps(some.unionByName(some.withColumn("side", F.lit("r")))).collect():
        a, b, overlap = r["left"], r["right"], r["overlap"]
        if cols.index(a) >= cols.index(b):
            continue
        if overlap / unique[a] >= 0.95:
            found.append((a, b, overlap / unique[a]))
        elif overlap / unique[b] >= 0.95:
            found.append((b, a, overlap / unique[b]))
    found.sort(key=lambda f: (cols.index(f[0]), cols.index(f[1])))
    return rows(df.sparkSession, found[:top], "column string, references string, containment double")


# What marks the name of a key column, and the size below which only such names count.
KEY_PARTS = ("id", "uuid", "guid", "pk", "key", "code", "slug", "no", "num")
FEW_ROWS = 50


def _named_key(c: str) -> bool:
    return any(p in c.lower() for p in KEY_PARTS)


def _with_duplicates(df: DataFrame, sets: list[tuple[str, ...]], parts: int) -> set[int]:
    """Which sets of columns have a value twice, looked for in one of `parts` classes of the rows by the set's hash; one pass for all.

    A duplicate is proof that a set is no key, whatever the class; with one class, none is proof that it is one. Values are told apart by 128 bits.
    """
    entry = lambda i, s: F.struct(F.lit(i).alias("i"), F.xxhash64(*map(q, s)).alias("a"), F.xxhash64(F.lit(1), *map(q, s)).alias("b"))
    entries = F.array(*[F.when(F.pmod(F.xxhash64(F.lit(2), *map(q, s)), F.lit(parts)) == 0, entry(i, s)) for i, s in enumerate(sets)])
    seen = df.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    return {r["i"] for r in seen.where("n > 1").select("e.i").distinct().collect()}  # a row for each set


def unique_sets(df: DataFrame, sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The sets of columns that tell all rows apart: most others fall in a small part of the rows, the rest is decided over all."""
    for parts in (PARTS, 1):
        if sets:
            fallen = _with_duplicates(df, sets, parts)
            sets = [s for i, s in enumerate(sets) if i not in fallen]
    return sets


def primary_keys(df: DataFrame, pairs: bool = True) -> DataFrame:
    """Single columns, then pairs, that tell all rows apart; nothing is ruled out without a duplicate."""
    cols = [c for c in scalar_columns(df) if not isinstance(dtype(df, c), (T.DoubleType, T.FloatType))]
    known = facts(df, {"_n": F.count(F.lit(1))} | {f"k{i}": F.count(q(c)) for i, c in enumerate(cols)})
    n = known["_n"]
    whole = [c for i, c in enumerate(cols) if n and known[f"k{i}"] == n]
    tiny = n < FEW_ROWS
    single = [c for (c,) in unique_sets(df, [(c,) for c in whole])]
    found = [(c, 1, 1.0) for c in single if not tiny or _named_key(c) or isinstance(dtype(df, c), T.IntegralType)]
    found.sort(key=lambda f: not _named_key(f[0]))
    if pairs and n >= 20 and not found:
        sizes = facts(df, {f"u{i}": F.count_distinct(q(c)) for i, c in enumerate(whole)})
        size = {c: sizes[f"u{i}"] for i, c in enumerate(whole) if sizes[f"u{i}"] > 1}
        found = [(f"{a}, {b}", 2, 1.0) for a, b in unique_sets(df, [(a, b) for a, b in combinations(size, 2) if size[a] * size[b] >= n])]
    return rows(df.sparkSession, found, "columns string, width int, uniqueness double")


# What marks the name of an ID column.
ID_PARTS = ("_id", "id_", "guid", "uuid", "key", "index")
ID_NAMES = ("id", "pk", "rowid", "row_id")


def _steps_of_one(df: DataFrame, c: str, n: int, distinct: int) -> bool:
    """Whether the median step between sorted values is one, from counts of values whose successor is there too."""
    if n <= 10:
        return False
    values = df.select(q(c).cast("long").alias("v")).where("v is not null").distinct()
    ones = values.select(F.explode(F.array("v", F.col("v") + 1)).alias("v")).groupBy("v").count().where("count = 2").count()
    zeros, steps = n - distinct, n - 1
    lower, upper = (steps - 1) // 2, steps // 2
    return zeros <= lower and upper < zeros + ones


def id_columns(df: DataFrame) -> DataFrame:
    """Columns named as IDs that are nearly unique or sequential, and columns that are both whatever their name."""
    cols = scalar_columns(df)
    whole = [c for c in cols if isinstance(dtype(df, c), T.IntegralType)]
    aggregates = {"_n": F.count(F.lit(1))}
    for i, c in enumerate(cols):
        aggregates[f"k{i}"] = F.count(clean(df, c))
    got = facts(df, aggregates)
    n, found = got["_n"], []
    for i, c in enumerate(cols):
        name = c.lower()
        named = name in ID_NAMES or any(p in name for p in ID_PARTS)
        if not n or not (named or c in whole):  # without a name only whole numbers can count through the rows
            continue
        distinct = df.select(F.count_distinct(clean(df, c))).first()[0]
        unique = distinct / n > 0.95
        sequential = c in whole and (named or (unique and n > 20)) and _steps_of_one(df, c, got[f"k{i}"], distinct)
        if (named and (unique or sequential)) or (unique and sequential and n > 20):
            found.append((c, distinct / n, sequential, named))
    return rows(df.sparkSession, found, "column string, uniqueness double, sequential boolean, named boolean")
