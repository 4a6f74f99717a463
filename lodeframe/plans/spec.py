"""Declarative query specs, built as a chain of DataFrame calls.

A spec names its tables, joins, conditions, groups, aggregates, windows, order and limits in plain dicts. Everything is
expressed on DataFrames, so that Catalyst sees the whole query.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.columns import facts, same
from lodeframe.operators.ordered import group_quantiles
from lodeframe.operators.quantiles import medians
from lodeframe.plans.windows import add_window

CROSS_JOIN_ROWS = 100_000
#: Result rows of a task where an inner join is dealt by its result, and how much larger than both sides that has to be.
JOINED_ROWS, JOINED_GROWTH = 5_000_000, 10

_JOIN_TYPES = {
    "INNER": "inner",
    "LEFT": "left",
    "RIGHT": "right",
    "FULL": "full",
    "FULL OUTER": "full",
    "CROSS": "cross",
    "SEMI": "left_semi",
    "ANTI": "left_anti",
}

_COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "≠": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "AFTER": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "BEFORE": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "≥": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "≤": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "NOT LIKE": lambda c, v: ~c.like(v),
    "STARTS WITH": lambda c, v: c.startswith(str(v)),
    "ENDS WITH": lambda c, v: c.endswith(str(v)),
    "CONTAINS": lambda c, v: c.contains(str(v)),
    "DOES NOT CONTAIN": lambda c, v: ~c.contains(str(v)),
    "MATCHES REGEX": lambda c, v: c.rlike(v),
}


class SpecError(ValueError):
    """The spec cannot be built as written."""


def run_spec(
    spark: SparkSession,
    spec: dict,
    tables: dict[str, DataFrame] | None = None,
    as_of: dt.date | None = None,
    global_filters: list[dict] | None = None,
) -> DataFrame:
    """The DataFrame of a spec. `as_of` stands for today in relative date conditions."""
    return _Builder(spark, dict(tables or {}), as_of).build(spec, global_filters or [])


def join_tables(
    left: DataFrame, right: DataFrame, how: str, on: list[tuple[str, str]] | None = None, max_rows: int | None = None
) -> DataFrame:
    """Joins two tables; names found on both sides get _left and _right, a shared key of one name is kept once."""
    kind = _JOIN_TYPES[how.upper()]
    on = on or []
    if kind == "cross":
        return _guarded_cross(left, right, max_rows)
    if not on:
        raise SpecError("a join needs at least one pair of columns")
    shared_keys = [a for a, b in on if a == b]
    if kind in ("left_semi", "left_anti"):
        a, b = left.alias("_l"), right.alias("_r")
        cond = reduce(lambda x, y: x & y, [F.col(f"_l.`{x}`") == F.col(f"_r.`{y}`") for x, y in on])
        return a.join(b, cond, kind)
    clash = (set(left.columns) & set(right.columns)) - set(shared_keys)
    lefts = {c: f"{c}_left" if c in clash else c for c in left.columns}
    rights = {c: f"{c}_right" if c in clash else c for c in right.columns}
    a = left.withColumnsRenamed(lefts)
    b = right.withColumnsRenamed(rights | {k: f"_right_{k}" for k in shared_keys})
    cond = reduce(
        lambda x, y: x & y,
        [F.col(f"`{lefts[x]}`") == F.col(f"`_right_{y}`" if x == y else f"`{rights[y]}`") for x, y in on],
    )
    joined = a.join(b, cond, kind)
    if kind == "inner":
        pairs = [(lefts[x], f"_right_{y}" if x == y else rights[y]) for x, y in on]
        parts, tasks = _parts(a, b, pairs)
        if parts:
            joined = _dealt(a, b, pairs, cond, parts, tasks)
    if kind in ("right", "full"):
        keys = {k: F.coalesce(F.col(f"`{k}`"), F.col(f"`_right_{k}`")) for k in shared_keys}
        joined = joined.withColumns(keys) if keys else joined
    return joined.drop(*[f"_right_{k}" for k in shared_keys])


def _parts(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> tuple[int, int]:
    """Into how many parts the longer side of an inner join is cut, negative for the right one, and the tasks for the result; 0 to leave it to Spark.

    Rough counts of keys, without a shuffle, tell where the result cannot outgrow what is read; only beyond are keys counted.
    """
    keys = [[F.col(f"`{pair[i]}`") for pair in on] for i in (0, 1)]
    n, m = (facts(df, {"n": F.count(F.lit(1)), "u": F.approx_count_distinct(F.struct(*k))}) for df, k in zip((a, b), keys, strict=True))
    least = max(JOINED_ROWS, JOINED_GROWTH * (n["n"] + m["n"]))
    if n["n"] * m["n"] <= least * max(1, min(n["u"], m["u"])):
        return 0, 0
    left, right = (df.groupBy(*[c.alias(f"_{i}") for i, c in enumerate(k)]).agg(F.count(F.lit(1)).cast("double").alias("n")).alias(side) for df, k, side in ((a, keys[0], "x"), (b, keys[1], "y")))
    both = left.join(right, reduce(lambda x, y: x & y, [F.col(f"x._{i}") == F.col(f"y._{i}") for i in range(len(on))]))
    got = facts(both, {"all": F.sum(F.col("x.n") * F.col("y.n")), "most": F.max(F.col("x.n") * F.col("y.n"))})
    if (got["all"] or 0) <= least:
        return 0, 0
    return math.ceil(got["most"] / JOINED_ROWS) * (1 if n["n"] >= m["n"] else -1), math.ceil(got["all"] / JOINED_ROWS)


def _dealt(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], cond: Column, parts: int, tasks: int) -> DataFrame:
    """An inner join dealt by the size of its result: Spark deals it by what is read, so a key of few rows and many pairs would be one task.

    A row of the longer side is in one part, by the hash of its values, so a lost task deals it alike; the other side is copied to each.
    """
    whole = a if parts > 0 else b
    part = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in whole.schema if "map<" not in f.dataType.simpleString()]), F.lit(abs(parts)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(abs(parts) - 1).cast("long")))
    a = a.withColumn("_part_left", part if parts > 0 else every).repartition(tasks, *[F.col(f"`{x}`") for x, _ in on], "_part_left")
    b = b.withColumn("_part_right", every if parts > 0 else part).repartition(tasks, *[F.col(f"`{y}`") for _, y in on], "_part_right")
    return a.join(b.hint("merge"), cond & (F.col("_part_left") == F.col("_part_right")), "inner").drop("_part_left", "_part_right")


def _guarded_cross(left: DataFrame, right: DataFrame, most: int | None = None) -> DataFrame:
    """Every pair, refused above `most` result rows (`max_rows` of the join); the counts decide before anything is paired."""
    n, m, most = left.count(), right.count(), most or CROSS_JOIN_ROWS
    if n * m > most:
        raise SpecError(f"a cross join of {n} and {m} rows is over {most} result rows; add conditions")
    return left.crossJoin(right)


def column_ref(name: str) -> Column:
    """`table.column` or `column`."""
    if name == "*":
        return F.col("*")
    if "." in name:
        table, column = name.split(".", 1)
        return F.col(f"`{table}`.`{column}`")
    return F.col(f"`{name}`")


def sort_key(column: Column, direction: str = "ASC", nulls: str = "") -> Column:
    """Nulls come last in both directions unless the spec says otherwise."""
    first = nulls.upper().replace("NULLS", "").strip() == "FIRST"
    if direction.upper() == "DESC":
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()


class _Builder:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], as_of: dt.date | None):
        self.spark = spark
        self.tables = tables
        self.as_of = as_of
        self._marks = 0

    def build(self, spec: dict, extra: list[dict] | None = None) -> DataFrame:
        if not spec.get("from"):
            raise SpecError("the spec names no table in 'from'")
        scope = _Builder(self.spark, dict(self.tables), self.as_of)
        for cte in spec.get("ctes", []):
            scope.tables[cte["name"]] = scope.build(cte["query"])
        return scope._select(spec, extra or [])

    def _table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.table(f"`{name}`")

    def _source(self, spec: dict) -> DataFrame:
        source = spec["from"]
        if isinstance(source, str):
            source = {"table": source}
        df = self._table(source["table"]).alias(source.get("alias") or source["table"])
        for join in spec.get("joins", []):
            kind = _JOIN_TYPES.get(join.get("type", "INNER").upper(), "inner")
            right = self._table(join["table"]).alias(join.get("alias") or join["table"])
            pairs = join.get("on", [])
            if kind == "cross" or not pairs:
                df = _guarded_cross(df, right, join.get("max_rows"))
                continue
            cond = [column_ref(p["left"]) == column_ref(p["right"]) for p in pairs]
            df = df.join(right, reduce(lambda a, b: a & b, cond), kind)
        return df

    # conditions

    def _where(self, df: DataFrame, conditions: list[dict]) -> DataFrame:
        """Top-level AND terms with a sub-query become semi or anti joins, the rest one predicate."""
        if not conditions:
            return df
        if all(c.get("logic", "AND").upper() == "AND" for c in conditions[1:]):
            plain = []
            for c in conditions:
                if c.get("subquery") and c.get("op", "=").upper().replace("_", " ") in ("IN", "NOT IN"):
                    df = self._in_subquery(df, c)
                else:
                    plain.append(c)
            conditions = plain
        keep = df.columns
        df, predicate = self._predicate(df, conditions)
        if predicate is None:
            return df
        df = df.where(predicate)
        marks = [c for c in df.columns if c.startswith("_mark") and c not in keep]
        return df.drop(*marks)

    def _in_subquery(self, df: DataFrame, cond: dict) -> DataFrame:
        column = column_ref(cond["column"])
        values = self._members(cond)
        if cond["op"].upper() == "IN":
            return df.join(values, column == F.col("_member"), "left_semi")
        size = facts(values, {"n": F.count(F.lit(1)), "known": F.count("_member")})
        if size["n"] == 0:
            return df
        if size["n"] > size["known"]:
            return df.where(F.lit(False))
        return df.where(column.isNotNull()).join(values, column == F.col("_member"), "left_anti")

    def _members(self, cond: dict) -> DataFrame:
        sub = self.build(cond["subquery"])
        return sub.select(sub[sub.columns[0]].alias("_member")).distinct()

    def _predicate(self, df: DataFrame, conditions: list[dict]) -> tuple[DataFrame, Column | None]:
        """AND binds tighter than OR: the chain is an OR of AND runs."""
        runs: list[list[Column]] = []
        for cond in conditions:
            if "group" in cond:
                df, term = self._predicate(df, cond["group"])
                if term is None:
                    continue
            else:
                df, term = self._term(df, cond)
            if runs and cond.get("logic", "AND").upper() == "AND":
                runs[-1].append(term)
            else:
                runs.append([term])
        if not runs:
            return df, None
        return df, reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, run) for run in runs])

    def _term(self, df: DataFrame, cond: dict) -> tuple[DataFrame, Column]:
        op = cond.get("op", "=").upper()
        op = op.replace("_", " ") if op not in _COMPARISONS else op
        c = column_ref(cond["column"])
        if op in ("IS NULL", "IS NOT NULL"):
            return df, c.isNull() if op == "IS NULL" else c.isNotNull()
        if op in ("IS TRUE", "IS FALSE"):
            return df, c == F.lit(op == "IS TRUE")
        if op == "BETWEEN":
            low, high = (list(cond.get("values") or []) + [None, None])[:2]
            return df, c.between(F.lit(low), F.lit(high))
        if op in ("IN", "NOT IN"):
            if cond.get("subquery"):
                df, member = self._mark(df, c, cond)
            else:
                member = c.isin(*cond.get("values", []))
            return df, member if op == "IN" else ~member
        relative = self._relative(op, cond.get("value"))
        if relative is not None:
            return df, c >= relative
        if op not in _COMPARISONS:
            raise SpecError(f"unknown operator {op}")
        value = cond.get("value")
        if cond.get("subquery"):
            sub = self.build(cond["subquery"])
            found = sub.limit(2).collect()
            if len(found) > 1:
                raise SpecError("a sub-query in a comparison may give one row only")
            value = F.lit(found[0][0] if found else None)
        return df, _COMPARISONS[op](c, value)

    def _mark(self, df: DataFrame, column: Column, cond: dict) -> tuple[DataFrame, Column]:
        """Three-valued membership for sub-queries inside OR chains."""
        self._marks += 1
        mark = f"_mark{self._marks}"
        values = self._members(cond)
        size = facts(values, {"n": F.count(F.lit(1)), "known": F.count("_member")})
        side = values.where(F.col("_member").isNotNull()).withColumn(mark, F.lit(True))
        member = f"_mark{self._marks}_value"
        df = df.join(side.withColumnRenamed("_member", member), column == F.col(member), "left").drop(member)
        missing = F.lit(None).cast("boolean") if size["n"] > size["known"] else F.lit(False)
        if size["n"] == 0:
            return df, F.lit(False)
        found = F.when(column.isNull(), F.lit(None)).when(F.col(mark), F.lit(True)).otherwise(missing)
        return df, found.cast("boolean")

    def _relative(self, op: str, value) -> Column | None:
        today = F.lit(self.as_of).cast("date") if self.as_of else F.current_date()
        if op == "IN LAST N DAYS":
            return F.date_sub(today, int(value) if value else 7)
        if op == "IN LAST N MONTHS":
            return F.add_months(today, -(int(value) if value else 1))
        if op in ("THIS WEEK", "THIS MONTH", "THIS YEAR"):
            return F.date_trunc(op.split()[1].lower(), today)
        return None

    # select list

    def _select(self, spec: dict, extra: list[dict]) -> DataFrame:
        df = self._where(self._source(spec), list(spec.get("where", [])))
        for cond in extra:
            df = self._where(df, [cond])
        items = spec.get("columns", [])
        group_by = spec.get("group_by", [])
        if group_by or any("aggregate" in i for i in items) or _all_aggregate_expressions(items):
            df, names = self._aggregate(df, items, group_by)
        else:
            df, names = self._project(df, items)
        having = spec.get("having", [])
        if having:
            df = self._where(df, having)
        df = self._order(df, spec.get("order_by", []))
        if names is not None:
            df = df.select(*[F.col(f"`{n}`") for n in names])
        if spec.get("offset"):
            df = df.offset(int(spec["offset"]))
        if spec.get("limit") is not None:
            df = df.limit(int(spec["limit"]))
        return df

    def _project(self, df: DataFrame, items: list[dict]) -> tuple[DataFrame, list[str] | None]:
        """Plain columns, expressions and windows; the ORDER BY may still name columns of the source."""
        if not items:
            return df, None
        plain = []
        for i, item in enumerate(items):
            if "window" in item:
                name = item.get("alias") or f"window_{i}"
                df = add_window(df, item["window"], name)
                plain.append((name, F.col(f"`{name}`")))
            elif "expression" in item:
                if item["expression"].strip() == "*":
                    return df, None
                plain.append((item.get("alias") or item["expression"], F.expr(item["expression"])))
            else:
                ref = f"{item['table']}.{item['column']}" if item.get("table") else item["column"]
                if ref == "*":
                    return df, None
                plain.append((item.get("alias") or item["column"], column_ref(ref)))
        return df.select(*[c.alias(n) for n, c in plain]), None

    def _aggregate(self, df: DataFrame, items: list[dict], group_by: list[str]) -> tuple[DataFrame, list[str]]:
        keys = [g.split(".", 1)[-1] for g in group_by]
        key_of = dict(zip(group_by, keys))
        aggregates, special, windows, names = [], [], [], []
        for i, item in enumerate(items):
            if "window" in item:
                name = item.get("alias") or f"window_{i}"
                windows.append((name, item["window"]))
                names.append(name)
            elif "aggregate" in item:
                name = item.get("alias") or f"{item['aggregate'].lower()}_{item.get('column', '*')}"
                function = item["aggregate"].upper()
                if function in ("MEDIAN", "MODE"):
                    special.append((name, function, item["column"]))
                else:
                    aggregates.append(aggregate_column(function, item.get("column", "*"), item.get("distinct")).alias(name))
                names.append(name)
            elif "expression" in item:
                name = item.get("alias") or item["expression"]
                aggregates.append(F.expr(item["expression"]).alias(name))
                names.append(name)
            else:
                ref = f"{item['table']}.{item['column']}" if item.get("table") else item["column"]
                name = item.get("alias") or item["column"]
                if ref in key_of or item["column"] in keys:
                    if name != item["column"]:
                        aggregates.append(column_ref(ref).alias(name))
                    names.append(name)
                else:
                    raise SpecError(f"{item['column']} is neither grouped nor aggregated")
        base = df.groupBy(*[column_ref(g).alias(key_of[g]) for g in group_by])
        grouped = base.agg(*aggregates) if aggregates else df.select(
            *[column_ref(g).alias(key_of[g]) for g in group_by]
        ).distinct()
        if not aggregates and not group_by:
            grouped = self.spark.range(1).select()
        for name, function, column in special:
            grouped = _with_special(df, grouped, group_by, key_of, name, function, column)
        for name, window in windows:
            grouped = add_window(grouped, window, name)
        return grouped, names or keys

    def _order(self, df: DataFrame, order_by: list[dict]) -> DataFrame:
        if not order_by:
            return df
        keys = []
        for o in order_by:
            column = F.expr(o["column"]) if o.get("is_expression") else column_ref(o["column"])
            keys.append(sort_key(column, o.get("direction", "ASC"), o.get("nulls", "")))
        return df.orderBy(*keys)


def aggregate_column(function: str, column: str = "*", distinct: bool | None = False) -> Column:
    if function == "COUNT DISTINCT":
        function, distinct = "COUNT", True
    c = F.lit(1) if column == "*" else column_ref(column)
    plain = {
        "COUNT": F.count,
        "SUM": F.sum,
        "AVG": F.avg,
        "MIN": F.min,
        "MAX": F.max,
        "STDDEV": F.stddev_samp,
        "VARIANCE": F.var_samp,
    }
    if function not in plain:
        raise SpecError(f"unknown aggregate {function}")
    if distinct and function == "COUNT":
        return F.count_distinct(column_ref(column))
    if distinct and function == "SUM":
        return F.sum_distinct(c)
    if distinct and function == "AVG":
        name = ".".join(f"`{p}`" for p in column.split(".", 1))
        return F.expr(f"avg(DISTINCT {name})")
    return plain[function](c)


def _all_aggregate_expressions(items: list[dict]) -> bool:
    """A select list of raw expressions that are all aggregate calls makes one group of the whole table."""
    calls = ("count(", "sum(", "avg(", "min(", "max(", "median(", "stddev(", "variance(", "mode(")
    texts = [i.get("expression", "").strip().lower() for i in items]
    return bool(texts) and all(t.startswith(calls) and " over " not in t and " over(" not in t for t in texts)


def _with_special(df, grouped, group_by, key_of, name, function, column) -> DataFrame:
    """MEDIAN and MODE from counted values: a group of any size is spread over tasks."""
    keys = [f"_key{i}" for i in range(len(group_by))]
    source = df.select(*[column_ref(g).alias(k) for g, k in zip(group_by, keys)], column_ref(column).alias("_value"))
    if function == "MEDIAN" and not keys:
        return grouped.withColumn(name, F.lit(medians(source, ["_value"])["_value"]))
    if function == "MEDIAN":
        found = group_quantiles(source, keys, "_value", {"_found": 0.5})
    else:
        counts = source.where("_value is not null").groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
        best = F.min_by(F.col("_value"), F.struct(-F.col("_n"), F.col("_value")))
        found = counts.groupBy(*keys).agg(best.alias("_found"))
    if not keys:
        return grouped.withColumn(name, F.lit(found.first()["_found"]))
    cond = reduce(lambda a, b: a & b, [same(F.col(f"`{key_of[g]}`"), F.col(k)) for g, k in zip(group_by, keys)])
    return grouped.join(found, cond, "left").withColumnRenamed("_found", name).drop(*keys)
