"""Tables stacked and compared."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compare_schemas(schemas: dict[str, T.StructType]) -> dict:
    """Mean pairwise overlap of the column sets, and whether shared columns disagree in type."""
    names = {k: {f.name for f in s} for k, s in schemas.items()}
    scores = [len(names[a] & names[b]) / max(1, len(names[a] | names[b])) for a, b in combinations(schemas, 2)]
    score = sum(scores) / len(scores) if scores else 1.0
    types: dict[str, set[str]] = {}
    for s in schemas.values():
        for f in s:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    clash = sorted(c for c, kinds in types.items() if len(kinds) > 1)
    verdict = "same" if score >= 0.8 else "mixed" if score > 0.3 else "different"
    return {"similarity": score, "verdict": verdict, "type_clashes": clash, "confidence": score * (0.9 if clash else 1.0)}


def merge_tables(tables: dict[str, DataFrame], tag: str = "__source_file__") -> DataFrame:
    """All rows of all tables by column name, missing columns null, each row tagged with its table."""
    clashes = compare_schemas({k: d.schema for k, d in tables.items()})["type_clashes"]
    merged = None
    for name, df in tables.items():
        same_types = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in clashes if c in df.columns})
        tagged = same_types.withColumn(tag, F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def compare_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two results and how many rows only one of them has, duplicates counted."""
    counts = a.agg(F.count(F.lit(1)).alias("rows_a"))
    others = {
        "rows_b": b.count(),
        "only_a": a.exceptAll(b).count(),
        "only_b": b.exceptAll(a).count(),
    }
    same_columns = a.columns == b.columns
    result = counts.select("rows_a", *[F.lit(v).cast("long").alias(k) for k, v in others.items()])
    return result.withColumn("same_columns", F.lit(same_columns))
