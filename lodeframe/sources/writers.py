"""Sinks: files of several formats, Arrow files and SQL scripts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import dtype, q
from lodeframe.plans.spec import run_spec
from lodeframe.workspace import run_sql


# Quotes inside a field are doubled, and white space at its ends stays.
CSV_TEXT = {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """csv, json, parquet, feather or sql; one file per partition."""
    if fmt == "csv":
        df.write.mode(mode).options(header=True, **CSV_TEXT).csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "feather":
        write_feather(df, path)
    elif fmt == "sql":
        write_sql_inserts(df, path, "data")
    else:
        raise ValueError(f"unknown format {fmt}")


def write_one_text(lines: DataFrame, path: str, before: str, after: str) -> None:
    """One text file of `before`, the lines (value) and `after`, written by many tasks at their own places.

    Each partition's bytes, one row on the driver, tell where it begins; a task that runs again writes the same bytes to the same place, and
    one with other lines than were counted fails. Needs a folder that all executors share as files; elsewhere one task writes.
    """
    spark = lines.sparkSession
    lines = lines.select(F.coalesce(F.encode("value", "UTF-8"), F.lit(b"")).alias("value"))
    folder = path.removeprefix("file:")
    if "://" in folder:
        line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
        line(before).union(lines.select(F.col("value").cast("string")).coalesce(1)).union(line(after)).coalesce(1).write.text(path)
        return
    sizes = lines.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("value") + 1).alias("n")).collect()
    at, begins = len(f"{before}\n".encode()), {}
    for r in sorted(sizes, key=lambda r: r["part"]):
        begins[r["part"]] = (at, at + r["n"])
        at += r["n"]
    name = os.path.join(folder, "part-00000.txt")
    os.makedirs(folder)
    with open(name, "wb") as f:
        f.write(f"{before}\n".encode())
        f.seek(at)
        f.write(f"{after}\n".encode())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end = begins.get(TaskContext.get().partitionId(), (0, 0))
        place = start
        with open(name, "r+b") as f:
            f.seek(start)
            for batch in batches:
                for value in batch.column("value"):
                    text = value.as_py() + b"\n"
                    place += len(text)
                    if place > end:
                        raise ValueError("the lines differ from those counted before")
                    f.write(text)
        if place != end:
            raise ValueError("the lines differ from those counted before")
        yield pa.RecordBatch.from_pydict({"bytes": [place - start]})

    lines.mapInArrow(save, "bytes long").write.format("noop").mode("overwrite").save()


def write_feather(df: DataFrame, path: str) -> DataFrame:
    """One Arrow file per partition in a folder all executors share; returns (file, rows).

    A file gets its name only when it is complete, and the name depends on the partition alone, so a task that runs again
    replaces what a lost one left.
    """
    folder = path.removeprefix("file:")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"part-{context.partitionId():05d}.feather")
        unfinished = f"{name}.{context.taskAttemptId()}"
        writer, count = None, 0
        for batch in batches:
            if writer is None:
                writer = pa.ipc.new_file(unfinished, batch.schema)
            writer.write_batch(batch)
            count += batch.num_rows
        if writer is not None:
            writer.close()
            os.replace(unfinished, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [count]})

    files = df.mapInArrow(save, "file string, rows long").collect()
    return df.sparkSession.createDataFrame(files, "file string, rows long")


def sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "VARCHAR"


def _literal(df: DataFrame, c: str) -> Column:
    kind, text = dtype(df, c), q(c).cast("string")
    if isinstance(kind, T.BooleanType):
        shown = F.upper(text)
    elif isinstance(kind, T.NumericType):
        shown = text
    else:
        shown = F.concat(F.lit("'"), F.regexp_replace(text, "'", "''"), F.lit("'"))
    return F.coalesce(shown, F.lit("NULL"))


def sql_inserts(df: DataFrame, table: str) -> DataFrame:
    """(value): one INSERT per row."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    values = F.concat_ws(", ", *[_literal(df, c) for c in df.columns])
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), values, F.lit(");")).alias("value"))


def write_sql_inserts(df: DataFrame, path: str, table: str) -> None:
    """A script in parts: CREATE TABLE leads the first one, each row is one INSERT."""
    columns = ",\n".join(f'    "{c}" {sql_type(dtype(df, c))}' for c in df.columns)
    head = df.sparkSession.createDataFrame([(f'CREATE TABLE IF NOT EXISTS "{table}" (\n{columns}\n);',)], "value string").coalesce(1)
    head.union(sql_inserts(df, table)).write.mode("errorifexists").text(path)


def export_query(spark: SparkSession, query: str | dict, path: str, fmt: str, tables: dict[str, DataFrame] | None = None) -> None:
    """The result of a statement or a spec, written."""
    df = run_spec(spark, query, tables) if isinstance(query, dict) else run_sql(spark, query)
    write(df, path, fmt)
