"""Nested records flattened to dotted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import facts, q


def _lists_of_objects(schema: T.StructType, at: Column | None = None, path: str = "") -> dict[str, Column]:
    found = {}
    for f in schema:
        here = q(f.name) if at is None else at.getField(f.name)
        name = f"{path}{f.name}"
        if isinstance(f.dataType, T.StructType):
            found |= _lists_of_objects(f.dataType, here, f"{name}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            found[name] = here
    return found


def flatten(df: DataFrame, sep: str = ".", only: list[str] | None = None) -> DataFrame:
    """Objects to a.b, lists of objects to a[0].b (as many as the longest list), lists of values to JSON text.

    The longest lists are found in one aggregate; nested lists of objects inside lists become JSON text.
    """
    wanted = only or df.columns
    lists = {n: c for n, c in _lists_of_objects(df.schema).items() if n.split(".")[0] in wanted}
    sizes = facts(df, {f"m{i}": F.max(F.size(c)) for i, c in enumerate(lists.values())}).asDict() if lists else {}
    longest = {n: max(0, sizes[f"m{i}"] or 0) for i, n in enumerate(lists)}
    out: list[Column] = []

    def walk(column: Column, kind: T.DataType, name: str, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(column.getField(f.name), f.dataType, f"{name}{sep}{f.name}", f"{path}.{f.name}")
        elif path in longest:
            for i in range(longest[path]):
                walk(F.get(column, F.lit(i)), kind.elementType, f"{name}[{i}]", f"{path}[{i}]")
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.when(F.size(column) > 0, F.to_json(column)).alias(name))
        else:
            out.append(column.alias(name))

    for f in df.schema:
        if f.name in wanted:
            walk(q(f.name), f.dataType, f.name, f.name)
        else:
            out.append(q(f.name))
    return df.select(*out)


def explode_main_array(df: DataFrame) -> DataFrame:
    """The longest list of objects in the table, one row per object, flattened."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not lists:
        return flatten(df)
    sizes = facts(df, {c: F.max(F.size(q(c))) for c in lists})
    main = max(lists, key=lambda c: sizes[c] or 0)
    return flatten(df.select(F.explode(q(main)).alias("_row")).select("_row.*"))
