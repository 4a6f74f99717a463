"""Numbered lines of text files, and lines joined that a quoted text runs across, whatever way files are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.session import stored


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str | None = None) -> DataFrame:
    """(file, row_number, value), counted from 1 within each file; `sep` ends a line if that isn't the line break.

    Every split of a file counts its own lines; only one number per split is needed to place them.
    """
    reader = spark.read if encoding.lower() in ("utf-8", "utf8") else spark.read.option("encoding", encoding)
    reader = reader.option("lineSep", sep) if sep else reader
    text = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at")
    )
    sizes = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    joined = text.join(F.broadcast(placed), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return joined.select("file", (F.col("_at") - F.col("first") + F.col("skip") + 1).alias("row_number"), "value")


def joined_lines(lines: DataFrame, opens: Column, stays: Column, glue: str, longest: int | None = None, stretch: int = 100_000) -> DataFrame:
    """Numbered lines with those joined that a quoted text runs across; a record keeps the number of its first line.

    Every line is read under both states: does a quoted text go on after it if the line begins outside of one (`opens`), or inside of one
    (`stays`)? Some lines settle the state, the others keep or swap it. Stretches of a file's lines sum that up in one row each; a pass
    over those rows tells the state at each stretch's start, and so each line's. The states are kept in the shared folder and worked on
    without the lines' text, which joins them at the end. With `longest`, the lines of a record that never ends, or
    not within so many lines, stand for themselves, and `unclosed` marks those of them that open a text: a stray quote gathers nothing.
    """
    file = Window.partitionBy("file").orderBy("_stretch")
    part = Window.partitionBy("file", "_stretch").orderBy("row_number")
    before_stretch, before, so_far = file.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select("file", "row_number", "value")
    states = stored(lines.select("file", "row_number", opens.cast("int").alias("_open"), stays.cast("int").alias("_stay")))
    states = states.withColumn("_stretch", F.floor((F.col("row_number") - 1) / stretch))
    states = states.withColumn("_swap", ((F.col("_open") == 1) & (F.col("_stay") == 0)).cast("int"))
    settles = F.when(F.col("_open") == F.col("_stay"), F.col("_open"))

    def state(settled: Column, swaps: Column, start: Column) -> Column:
        return F.coalesce((settled["s"] + swaps - settled["n"]) % 2, (start + swaps) % 2)

    counted = states.withColumn("_n", F.sum("_swap").over(so_far))
    counted = counted.withColumn("_set", F.when(settles.isNotNull(), F.struct(settles.alias("s"), F.col("_n").alias("n"))))
    sums = counted.groupBy("file", "_stretch").agg(F.sum("_swap").alias("_n"), F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("row_number"))).alias("_set"))
    sums = sums.withColumn("_total", F.sum("_n").over(file.rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set.s").alias("s"), (F.col("_total") - F.col("_n") + F.col("_set.n")).alias("n")))
    start = state(F.last(reached, True).over(before_stretch), F.coalesce(F.sum("_n").over(before_stretch), F.lit(0)), F.lit(0))
    placed = counted.join(sums.select("file", "_stretch", start.alias("_start")), ["file", "_stretch"])
    placed = placed.withColumn("_after", state(F.last("_set", True).over(so_far), F.col("_n"), F.col("_start")))
    placed = placed.withColumn("_first", F.when(F.coalesce(F.lag("_after").over(part), F.col("_start")) == 0, F.col("row_number")))
    firsts = placed.groupBy("file", "_stretch").agg(F.max("_first").alias("_f"))
    carried = firsts.select("file", "_stretch", F.max("_f").over(before_stretch).alias("_carry"))
    numbered = placed.join(carried, ["file", "_stretch"]).withColumn("_record", F.coalesce(F.last("_first", True).over(so_far), F.col("_carry")))
    numbered = numbered.select("file", "_record", "row_number", "_after", "_open")
    broken = F.max_by("_after", "row_number") == 1
    if longest is not None:
        broken |= F.count(F.lit(1)) > longest
        ends = numbered.groupBy("file", "_record").agg(broken.alias("_broken")).where("_broken")
        numbered = numbered.join(ends, ["file", "_record"], "left").withColumn("unclosed", F.col("_broken").isNotNull() & (F.col("_open") == 1))
        numbered = numbered.withColumn("_record", F.when(F.col("_broken").isNotNull(), F.col("row_number")).otherwise(F.col("_record")))
    else:
        numbered = numbered.withColumn("unclosed", F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("row_number", "value")))
    records = lines.join(numbered, ["file", "row_number"]).groupBy("file", F.col("_record").alias("row_number")).agg(parts.alias("_p"), F.max("unclosed").alias("unclosed"))
    return records.select("file", "row_number", F.array_join(F.transform("_p", lambda x: x["value"]), glue).alias("value"), "unclosed")
