"""Watching a folder of arriving files: each batch is judged against a baseline and the verdict kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.functions.columns import rows
from lodeframe.operators.insight import quality_facts

QUALITY_DROP = 10.0
FILES = "path string, modificationTime timestamp, length long, content binary"
HISTORY = "batch long, files long, rows long, columns int, quality double, quality_drop double, schema_changed boolean, status string, reason string, checked_at timestamp"


def judge(baseline: dict, df: DataFrame) -> tuple:
    """(rows, columns, quality, drop, schema changed, status, reason) of a table against the baseline's facts."""
    got = quality_facts(df)
    drop = round(baseline["overall"] - got["overall"], 2)
    changed = set(df.columns) != set(baseline["columns"])
    warn = changed or drop >= QUALITY_DROP
    reason = "columns differ" if changed else f"quality fell by {drop:.1f}" if warn else None
    return df.count(), len(df.columns), got["overall"], drop, changed, "warning" if warn else "ok", reason


def baseline_of(df: DataFrame) -> dict:
    return {"columns": df.columns, "overall": quality_facts(df)["overall"]}


def monitor(
    spark: SparkSession, folder: str, baseline: DataFrame, history: str, checkpoint: str, read: Callable[[SparkSession, list[str]], DataFrame] | None = None,
    files_per_batch: int = 100, **trigger,
) -> StreamingQuery:
    """A stream over the files that arrive in a folder. Every micro-batch appends one row to the history table.

    The stream itself carries only file names, so files of any columns can arrive; `read` opens the files of one batch
    (Parquet unless given). Trigger options are passed on, for example availableNow=True.
    """
    known = baseline_of(baseline)
    open_files = read or (lambda s, paths: s.read.option("mergeSchema", True).parquet(*paths))
    arrivals = (
        spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(folder).select("path")
    )

    def check(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())
        if not paths:
            return
        session = batch.sparkSession
        verdict = judge(known, open_files(session, paths))
        row = rows(session, [(number, len(paths), *verdict, None)], HISTORY).withColumn("checked_at", F.current_timestamp())
        row.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return arrivals.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_history(spark: SparkSession, history: str) -> DataFrame:
    return spark.read.option("basePath", history).parquet(f"{history}/batch=*").drop("batch")


def check_once(baseline: DataFrame, source: DataFrame) -> DataFrame:
    """The same verdict for one table, without a stream."""
    n, columns, quality, drop, changed, status, reason = judge(baseline_of(baseline), source)
    schema = "rows long, columns int, quality double, quality_drop double, schema_changed boolean, status string, reason string"
    return rows(source.sparkSession, [(n, columns, quality, drop, changed, status, reason)], schema)
