"""Window functions of the query spec.

A window whose largest group is small runs as it is. A larger group (no PARTITION BY at all, or one hot key) is cut into ranges of its
order, by any number of columns of any sortable type, so that no task sorts it alone; what a range needs from the others is a row for each
range. Rows that tie are told apart by a hash of all their columns on both ways, so the answer does not depend on the table's size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import q, same
from lodeframe.operators.ordered import in_blocks, join_ranges, ranged_rows

GROUP_ROWS = 5_000_000

_RANKING = ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE")
_TOTALS = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max}


def _bound(text: str) -> int:
    text = text.strip().upper()
    if text == "UNBOUNDED PRECEDING":
        return Window.unboundedPreceding
    if text == "UNBOUNDED FOLLOWING":
        return Window.unboundedFollowing
    if text == "CURRENT ROW":
        return Window.currentRow
    count, side = text.split()
    return -int(count) if side == "PRECEDING" else int(count)


def frame_bounds(frame: str) -> tuple[str, int, int]:
    """'ROWS BETWEEN a AND b' (or a lone start) as (kind, start, end)."""
    kind, rest = frame.strip().split(None, 1)
    between = re.fullmatch(r"BETWEEN\s+(.+?)\s+AND\s+(.+)", rest.strip(), re.IGNORECASE)
    start, end = between.groups() if between else (rest, "CURRENT ROW")
    return kind.upper(), _bound(start), _bound(end)


def _orders(window: dict) -> list[tuple[str, bool]]:
    found = []
    for o in window.get("order_by", []):
        if isinstance(o, str):
            found.append((o, False))
        else:
            found.append((o["column"], o.get("direction", "ASC").upper() == "DESC"))
    return found


def _sorted(orders: list[tuple[str, bool]]) -> list[Column]:
    return [q(c).desc_nulls_last() if desc else q(c).asc_nulls_last() for c, desc in orders]


def _window_spec(window: dict):
    w = Window.partitionBy(*[q(c) for c in window.get("partition_by", [])])
    keys = _sorted(_orders(window))
    return w.orderBy(*keys) if keys else w


def _tie(df: DataFrame) -> Column:
    """Tells rows apart by all their columns; maps and variants by what they hold."""

    def plain(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.MapType):
            return F.array_sort(F.transform(F.map_entries(q(f.name)), lambda e: F.to_json(F.struct(e.alias("e")))))
        return F.to_json(F.struct(q(f.name).alias("x"))) if any(x in f.dataType.json() for x in ('"map"', '"variant"')) else q(f.name)

    return F.xxhash64(*[plain(f) for f in df.schema])


def _framed(w, window: dict):
    if not window.get("frame"):
        return w
    kind, start, end = frame_bounds(window["frame"])
    return w.rowsBetween(start, end) if kind == "ROWS" else w.rangeBetween(start, end)


def _call(window: dict) -> Column:
    function, n = window.get("func", "ROW_NUMBER").upper(), window.get("n")
    column = q(window["column"]) if window.get("column") else F.lit(1)
    if function == "ROW_NUMBER":
        return F.row_number()
    if function == "RANK":
        return F.rank()
    if function == "DENSE_RANK":
        return F.dense_rank()
    if function == "NTILE":
        return F.ntile(int(n or 4))
    if function in ("LAG", "LEAD"):
        shift = F.lag if function == "LAG" else F.lead
        return shift(column, int(window.get("offset", 1)), window.get("default_value"))
    if function == "FIRST_VALUE":
        return F.first(column)
    if function == "LAST_VALUE":
        return F.last(column)
    if function == "NTH_VALUE":
        return F.nth_value(column, int(n or 1))
    if function in _TOTALS:
        return _TOTALS[function](column)
    raise ValueError(f"unknown window function {function}")


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    sizes = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def add_window(df: DataFrame, window: dict, name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The frame with one more column."""
    function = window.get("func", "ROW_NUMBER").upper()
    keys, orders = window.get("partition_by", []), _orders(window)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    if function in _TOTALS and (frame_bounds(window["frame"])[1:] == whole if window.get("frame") else not orders):
        return _whole_group(df, window, function, keys, name)
    if orders and not window.get("distinct") and _largest_group(df, keys) > group_rows:
        split = _split(df, window, function, keys, orders, name)
        if split is not None:
            return split
    if window.get("distinct") and function in _TOTALS:
        return _distinct_running(df, window, function, keys, name)
    if not orders or function in ("RANK", "DENSE_RANK") or (function in _TOTALS and _frame(window)[0] == "RANGE"):
        result = _call(window).over(_window_spec(window) if function in _RANKING else _framed(_window_spec(window), window))
        return df.withColumn(name, result.cast("long") if function in _RANKING else result)
    groups, tied = [q(k) for k in keys], df.withColumn("_tie", _tie(df))
    w = Window.partitionBy(*groups).orderBy(*_sorted(orders), "_tie")
    kind, start, end = _frame(window)
    if function in ("ROW_NUMBER", "NTILE"):
        result = _call(window).over(w).cast("long")
    elif function in ("LAG", "LEAD"):
        result = _call(window).over(w)
    elif kind == "ROWS":
        result = _call(window).over(w.rowsBetween(start, end))
    else:
        result = _by_peers(window, function, groups, orders, w, start, end)
        if result is None:
            return df.withColumn(name, _call(window).over(_framed(_window_spec(window), window)))
    return tied.withColumn(name, result).drop("_tie")


def _frame(window: dict) -> tuple[str, int, int]:
    return frame_bounds(window["frame"]) if window.get("frame") else ("RANGE", Window.unboundedPreceding, Window.currentRow)


def _by_peers(window: dict, function: str, groups: list[Column], orders: list, w, start: int, end: int) -> Column | None:
    """FIRST, LAST and NTH of a RANGE frame from the group's start: whole peers count, and ties decide which of them comes first."""
    if start != Window.unboundedPreceding or end not in (Window.currentRow, Window.unboundedFollowing):
        return None
    column, whole = q(window["column"]), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if function == "FIRST_VALUE":
        return F.first(column).over(whole)
    if function == "LAST_VALUE":
        peers = Window.partitionBy(*groups, *[q(c) for c, _ in orders]).orderBy("_tie").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.last(column).over(whole if end == Window.unboundedFollowing else peers)
    n = int(window.get("n") or 1)
    reached = F.count(F.lit(1)).over(Window.partitionBy(*groups).orderBy(*_sorted(orders))) if end == Window.currentRow else F.lit(n)
    return F.when(reached >= n, F.nth_value(column, n).over(whole))


def _whole_group(df, window, function, keys, name) -> DataFrame:
    """An aggregate over the whole group: grouped map-side and joined back, no sort of the rows."""
    column = q(window["column"]) if window.get("column") else F.lit(1)
    if window.get("distinct"):
        distinct = {"COUNT": F.count_distinct, "SUM": F.sum_distinct}.get(function)
        call = distinct(column) if distinct else F.expr(f"{function.lower()}(DISTINCT `{window['column']}`)")
    else:
        call = _TOTALS[function](column)
    totals = df.groupBy(*[q(k).alias(f"_w_{k}") for k in keys]).agg(call.alias(name))
    if not keys:
        return df.withColumn(name, F.lit(totals.first()[0]))
    cond = F.lit(True)
    for k in keys:
        cond = cond & same(q(k), q(f"_w_{k}"))
    return df.join(totals, cond, "left").drop(*[f"_w_{k}" for k in keys])


def _distinct_running(df, window, function, keys, name) -> DataFrame:
    """DISTINCT in a growing frame counts a value where it first appears; a sliding frame looks at its own rows."""
    kind, start, end = frame_bounds(window.get("frame") or "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    column = q(window["column"])
    if end == Window.unboundedFollowing and start == Window.currentRow:
        turned = [{"column": c, "direction": "ASC" if desc else "DESC"} for c, desc in _orders(window)]
        frame = f"{kind} BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return _distinct_running(df, {**window, "order_by": turned, "frame": frame}, function, keys, name)
    if start != Window.unboundedPreceding:
        values = F.collect_set(column).over(_framed(_window_spec(window), window))
        if function == "COUNT":
            return df.withColumn(name, F.size(values).cast("long"))
        total = F.aggregate(values, F.lit(0).cast("double"), lambda a, x: a + x)
        results = {"SUM": total, "AVG": total / F.size(values), "MIN": F.array_min(values), "MAX": F.array_max(values)}
        return df.withColumn(name, results[function])
    first = Window.partitionBy(*[q(k) for k in keys], column).orderBy(
        *[q(c).desc_nulls_last() if desc else q(c).asc_nulls_last() for c, desc in _orders(window)]
    )
    df = df.withColumn("_new", F.when(F.row_number().over(first) == 1, column))
    w = _framed(_window_spec(window), window)
    return df.withColumn(name, _TOTALS[function](F.col("_new")).over(w)).drop("_new")


def _positions(df: DataFrame, keys: list[str], orders: list[tuple[str, bool]], tie: bool = True) -> DataFrame:
    """Adds _row (rising in the order), _range and _pos, the zero-based position in the group by (order, tie)."""
    tied = df.withColumn("_tie", _tie(df)) if tie else df
    rows = ranged_rows(tied, [*[q(k).asc_nulls_first() for k in keys], *_sorted(orders), *([F.col("_tie").asc()] if tie else [])]).drop("_tie")
    sizes = rows.groupBy(*[q(k) for k in keys], "_range").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return join_ranges(rows, sizes, keys).withColumn("_pos", F.col("_row") - F.col("_from") + F.col("_skip")).drop("_from", "_skip")


def _join_group(df: DataFrame, right: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Brings back a table of one row for each value of the columns, nulls included."""
    if not columns:
        return df.join(F.broadcast(right), how=how, on=F.lit(True))  # one row
    cond = F.lit(True)
    for i, c in enumerate(columns):
        cond = cond & same(q(c), F.col(f"_j{i}"))
    named = right.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(columns)})
    return df.join(named, cond, how).drop(*[f"_j{i}" for i in range(len(columns))])


#: How a running value is made inside a range, for a range, and from both.
_MERGE = {"SUM": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "COUNT": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "MIN": (F.min, F.least), "MAX": (F.max, F.greatest)}


def _running(rows: DataFrame, keys: list[str], parts: dict[str, str]) -> DataFrame:
    """Adds run_<c> for columns c of ranged rows: sums, minima or maxima from the group's start to the row, by ranges and what lies before them."""
    groups = [q(k) for k in keys]
    per = rows.groupBy(*groups, "_range").agg(*[_MERGE[kind][0](c).alias(f"_p_{c}") for c, kind in parts.items()])
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*groups, "_range", *[_MERGE[kind][0](f"_p_{c}").over(before).alias(f"_c_{c}") for c, kind in parts.items()])
    inside = Window.partitionBy(*groups, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{c}": _MERGE[kind][0](c).over(inside) for c, kind in parts.items()})
    both = join_ranges(local, per, keys)
    both = both.withColumns({f"run_{c}": _MERGE[kind][1](F.col(f"_l_{c}"), F.col(f"_c_{c}")) for c, kind in parts.items()})
    return both.drop(*[f"{p}_{c}" for p in ("_l", "_c") for c in parts])


def _total(function: str, prefix: str = "run_") -> Column:
    if function == "AVG":
        return F.try_divide(F.col(f"{prefix}_sum"), F.col(f"{prefix}_count"))
    if function == "COUNT":
        return F.coalesce(F.col(f"{prefix}_count"), F.lit(0).cast("long"))
    return F.col(f"{prefix}_{function.lower()}")


def _parts(function: str) -> dict[str, str]:
    return {"_sum": "SUM", "_count": "COUNT"} if function == "AVG" else {f"_{function.lower()}": function}


def _measured(function: str, value: Column) -> dict[str, Column]:
    """The columns that `_parts` sums up, for single rows."""
    single = {"_sum": value, "_count": value.isNotNull().cast("long"), "_min": value, "_max": value}
    return {c: single[c] for c in _parts(function)}


def _split(df, window, function, keys, orders, name) -> DataFrame | None:
    """The same result with every group cut into ranges; None where the function has no such form."""
    names, by = [q(c) for c in df.columns], [c for c, _ in orders]
    kind, start, end = _frame(window)
    growing = start == Window.unboundedPreceding and end == Window.currentRow
    value = q(window["column"]) if window.get("column") else F.lit(1)
    peers = [*keys, *[c for c in dict.fromkeys(by) if c not in keys]]
    if function in ("RANK", "DENSE_RANK") or (function in _TOTALS and kind == "RANGE"):
        turned = start == Window.currentRow and end == Window.unboundedFollowing
        if function in _TOTALS and not growing and not turned:
            return None
        if turned:  # read backwards, nulls first
            sort = [q(c).asc_nulls_first() if desc else q(c).desc_nulls_first() for c, desc in orders]
        else:
            sort = _sorted(orders)
        whole = {"_one": F.lit(1).cast("long"), "_rows": F.count(F.lit(1))} if function not in _TOTALS else {"_sum": F.sum(value), "_count": F.count(value), "_min": F.min(value), "_max": F.max(value)}
        parts = {"_one": "SUM", "_rows": "SUM"} if function not in _TOTALS else _parts(function)
        tied = df.groupBy(*[q(c) for c in peers]).agg(*[F.max(c).alias(m) if m == "_one" else c.alias(m) for m, c in whole.items() if m in parts])
        running = _running(ranged_rows(tied, [*[q(k).asc_nulls_first() for k in keys], *sort]), keys, parts)
        result = {"RANK": F.col("run__rows") - F.col("_rows") + 1, "DENSE_RANK": F.col("run__one")}.get(function) if function not in _TOTALS else _total(function)
        found = running.select(*[q(c) for c in peers], result.alias("_result"))
        return _join_group(df, found, peers).select(*names, F.col("_result").alias(name))
    sliding = kind == "ROWS" and start > -(2**31) and end < 2**31
    if not (function in ("ROW_NUMBER", "NTILE", "LAG", "LEAD") or sliding or growing or end == Window.unboundedFollowing and start == Window.unboundedPreceding):
        return None
    placed = _positions(df, keys, orders)
    if function == "ROW_NUMBER":
        return placed.select(*names, (F.col("_pos") + 1).alias(name))
    if function == "NTILE":
        sizes = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_size"))
        n = int(window.get("n") or 4)
        small, extra = F.floor(F.col("_size") / n), F.col("_size") % n
        edge = extra * (small + 1)
        bucket = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(extra + F.floor(F.try_divide(F.col("_pos") - edge, small)))
        return _join_group(placed, sizes, keys).select(*names, (bucket + 1).cast("long").alias(name))
    if function in ("LAG", "LEAD"):
        k = int(window.get("offset", 1))
        spread, w = in_blocks(placed, k if function == "LAG" else 0, k if function == "LEAD" else 0, keys)
        return spread.withColumn(name, _call(window).over(w)).where("_home").select(*names, q(name))
    if sliding and (start, end) != (0, 0):
        spread, w = in_blocks(placed, max(0, -start), max(0, end), keys)
        return spread.withColumn(name, _call(window).over(w.rowsBetween(start, end))).where("_home").select(*names, q(name))
    if function in _TOTALS:
        if sliding:
            return None
        running = _running(placed.withColumns(_measured(function, value)), keys, _parts(function))
        return running.select(*names, _total(function).alias(name))
    if sliding:
        return None
    n = 1 if function == "FIRST_VALUE" else int(window.get("n") or 1)
    to_end = end == Window.unboundedFollowing
    if function == "LAST_VALUE":
        if kind == "ROWS" and not to_end:
            return placed.select(*names, value.alias(name))
        among = keys if to_end else peers
        last = placed.groupBy(*[q(c) for c in among]).agg(F.max_by(F.struct(value.alias("v")), "_pos").alias("_last"))
        return _join_group(placed, last, among).select(*names, F.col("_last.v").alias(name))
    at = placed.where(F.col("_pos") == n - 1).select(*[q(k) for k in keys], value.alias("_nth"), F.lit(True).alias("_there"))
    if not keys:  # a row even where the group is shorter
        at = at.agg(F.first("_nth").alias("_nth"), F.count("_there").alias("_there"))
    found = _join_group(placed, at, keys)
    if function == "FIRST_VALUE" or to_end:
        return found.select(*names, F.col("_nth").alias(name))
    if kind == "ROWS":
        return found.select(*names, F.when(F.col("_pos") >= n - 1, F.col("_nth")).alias(name))
    ends = placed.groupBy(*[q(c) for c in peers]).agg(F.max("_pos").alias("_end"))
    return _join_group(found, ends, peers).select(*names, F.when(F.col("_end") >= n - 1, F.col("_nth")).alias(name))
