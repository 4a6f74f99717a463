"""Chart configs turned into query specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans.spec import run_spec

SIZED = ("scatter", "treemap")
TIME_SORTED = ("line", "area")


def _measure(column: str, aggregation: str, alias: str) -> dict:
    if aggregation == "none":
        return {"column": column, "alias": alias}
    return {"aggregate": aggregation.upper(), "column": column, "alias": alias}


def chart_spec(config: dict, table: str) -> dict:
    """Config keys: type, x, y, y2, series, size, aggregation, filters, sort_by, direction, limit."""
    kind, aggregation = config["type"], config.get("aggregation", "none")
    x, y, series = config.get("x"), config.get("y"), config.get("series")
    columns, groups = [], []
    if kind == "kpi":
        columns.append(_measure(y, aggregation, "value") if y else {"aggregate": "COUNT", "column": "*", "alias": "value"})
    else:
        dimensions = [c for c in dict.fromkeys([x, series]) if c]
        columns += [{"column": c} for c in dimensions]
        groups = dimensions if aggregation != "none" else []
        measures = [y, config.get("y2") if kind != "table" else None, config.get("size") if kind in SIZED else None]
        columns += [_measure(m, aggregation, m) for m in dict.fromkeys(measures) if m]
        if kind == "table" and x and y and series:
            columns = [columns[0], columns[2], columns[1]]
    spec: dict = {"from": table, "columns": columns}
    if groups:
        spec["group_by"] = groups
    if config.get("filters"):
        spec["where"] = list(config["filters"])
    if config.get("sort_by"):
        spec["order_by"] = [{"column": config["sort_by"], "direction": config.get("direction", "asc")}]
    elif x and kind in TIME_SORTED:
        spec["order_by"] = [{"column": x, "direction": "asc"}]
    if config.get("limit"):
        spec["limit"] = config["limit"]
    return spec


def chart_data(
    spark: SparkSession, config: dict, table: str, tables: dict[str, DataFrame] | None = None, global_filters: list[dict] | None = None
) -> DataFrame:
    return run_spec(spark, chart_spec(config, table), tables, global_filters=global_filters)
