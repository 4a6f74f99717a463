"""Long JSON documents and SQL scripts, cut into records by many tasks.

A file is split at closing brackets (arrays of values: at commas) instead of line breaks. Pieces that a text in quotes runs across are
joined, then every piece tells how far its brackets go up and down. Sums of that over stretches of a file's pieces, one row each, give the
depth at each stretch's start, and so after each piece. A record ends where the depth is back at that of the records: one inside a JSON
array's bracket, else none. Pieces and records are kept once in the shared folder, so that this is worked out on a few numbers of each.
Only a record is ever one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import facts
from lodeframe.session import new_folder, stored
from lodeframe.sources.lines import joined_lines, numbered_lines

#: Pieces or records of a file that are summed up in one row.
STRETCH = 100_000
_OBJECTS, _VALUES = "}", ","


def _letters(text: Column, kinds: str) -> Column:
    return F.char_length(F.regexp_replace(text, rf"[^{kinds}]+", ""))


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def _cut_at_depth(pieces: DataFrame, stretch: int) -> DataFrame:
    """Pieces (file, row_number, _step, _begins) with _record, the number of records of the file that end before, _whole where one ends, and _base, the depth of its records.

    `_step` is how much deeper a piece ends than it begins, `_begins` the depth of the records as the file's first piece tells it.
    """
    file = Window.partitionBy("file").orderBy("_stretch")
    part = Window.partitionBy("file", "_stretch").orderBy("row_number")
    before_stretch, before, so_far = file.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("row_number") == 1, F.col("_begins"))
    pieces = pieces.withColumns({"_stretch": F.floor((F.col("row_number") - 1) / stretch), "_first": first})
    sums = pieces.groupBy("file", "_stretch").agg(F.sum("_step").alias("_sum"), F.max("_first").alias("_first"))
    starts = sums.select(
        "file", "_stretch", F.coalesce(F.sum("_sum").over(before_stretch), F.lit(0)).alias("_start"), F.max("_first").over(Window.partitionBy("file")).alias("_base")
    )
    deep = pieces.drop("_first").join(starts, ["file", "_stretch"]).withColumn("_whole", (F.col("_start") + F.sum("_step").over(so_far) == F.col("_base")).cast("int"))
    deep = deep.withColumn("_n", F.coalesce(F.sum("_whole").over(before), F.lit(0)))
    ends = deep.groupBy("file", "_stretch").agg(F.sum("_whole").alias("_ends"))
    carried = ends.select("file", "_stretch", F.coalesce(F.sum("_ends").over(before_stretch), F.lit(0)).alias("_carry"))
    return deep.join(carried, ["file", "_stretch"]).withColumn("_record", F.col("_carry") + F.col("_n"))


def bracketed(spark: SparkSession, path: str, sep: str, quote: str, up: str, down: str, begins: Column, stretch: int = STRETCH) -> DataFrame:
    """(file, record, value, whole, base): a file's text cut where the depth of brackets is back at that of its records.

    `sep` ends a piece; a closing bracket as `sep` counts as one. `up` and `down` are the insides of character classes. The last record of a
    file is what is left and not `whole`. A quote that never closes joins the rest of its file.
    """
    odd = _letters(_unescaped(F.col("value")), quote) % 2 == 1
    pieces = joined_lines(numbered_lines(spark, path, sep=sep), odd, ~odd, sep, stretch=stretch)
    bare = F.regexp_replace(_unescaped(F.col("value")), f"{quote}[^{quote}]*{quote}", "")
    step = _letters(bare, up) - _letters(bare, down) - F.lit(0 if sep == _VALUES else 1)
    pieces = stored(pieces.select("file", "row_number", "value", step.alias("_step"), begins.alias("_begins")))
    parts = F.array_sort(F.collect_list(F.struct("row_number", "value")))
    placed = _cut_at_depth(pieces.drop("value"), stretch).select("file", "row_number", "_record", "_whole", "_base")
    placed = pieces.select("file", "row_number", "value").join(placed, ["file", "row_number"]).groupBy("file", F.col("_record").alias("record"))
    grouped = placed.agg(parts.alias("p"), (F.max("_whole") == 1).alias("whole"), F.max("_base").alias("base"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), sep)
    text = F.when(F.col("record") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    closed = text if sep == _VALUES else F.when(F.col("whole"), F.concat(text, F.lit(sep))).otherwise(text)
    return grouped.select("file", "record", closed.alias("value"), "whole", "base")


def json_records(spark: SparkSession, path: str, sep: str = _OBJECTS, stretch: int = STRETCH) -> DataFrame:
    """(file, record, array, value): the text of each record, counted from 0 within its file; `array` tells that the document is an array.

    What is left at a file's end is a record too, broken or not, if it isn't blank.
    """
    in_array = F.col("value").rlike(r"^[\ufeff\s]*\[").cast("int")
    records = bracketed(spark, path, sep, '"', r"\[{", r"\]}", in_array, stretch)
    array, text = F.col("base") == 1, F.col("value")
    text = F.when(array & (F.col("record") == 0), F.regexp_replace(text, r"^\s*\[", "")).when(array & F.lit(sep == _OBJECTS), F.regexp_replace(text, r"^\s*,", "")).otherwise(text)
    text = F.when(array & ~F.col("whole"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return records.select("file", "record", array.alias("array"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("value")).where("value <> ''")


def json_values(spark: SparkSession, path: str) -> DataFrame | None:
    """(value): the values of documents that are all arrays of values, nested ones as JSON text; None for any other documents."""
    head = spark.read.option("lineSep", _VALUES).text(path).where(F.col("_metadata.file_block_start") == 0)
    head = head.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    firsts = head.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    kinds = facts(firsts, {"v": F.count_if(F.col("value").rlike(r"^[\ufeff\s]*\[\s*[^\s{\]]")), "n": F.count(F.lit(1))})
    if not kinds["n"] or kinds["v"] < kinds["n"]:
        return None
    found = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")
    return json_records(spark, path, _VALUES).select(F.explode(found).alias("value"))


def json_lines(spark: SparkSession, path: str) -> str:
    """A new shared folder with the records of the documents, one in a line, below the partition folders of the path."""
    kept = [c for c in spark.read.text(path).columns if c != "value"]
    records = json_records(spark, path)
    if kept:
        files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), *kept).distinct()
        records = records.join(files, "file")
    line = F.regexp_replace("value", r"[\r\n]+", " ")
    folder = new_folder(spark)
    lines = records.select(*kept, F.when(F.col("array"), F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("value"))
    # Else every task would write a file into every partition folder.
    (lines.hint("rebalance", *kept).write.partitionBy(*kept) if kept else lines.write).text(folder)
    return folder


def script_records(spark: SparkSession, path: str, statements: dict[str, str], stretch: int = STRETCH) -> DataFrame:
    """(file, record, kind, value): the parts of SQL statements that end with a bracket at depth none, as the columns or one row of an INSERT.

    A part's kind is the first of `statements` (kind: pattern) that the beginning of its own statement, up to the first bracket, fits; null
    for others. The beginning is left in the statement's first part only, and what stands before its semicolon is not.
    """
    records = bracketed(spark, path, ")", "'", "(", ")", F.lit(0), stretch)
    text = F.regexp_replace("value", r"(?s)^(?:(?:[^'(;]++|'[^']*+')*+;)+", "")
    opens = (F.col("record") == 0) | (F.char_length(text) < F.char_length("value"))
    begin = F.regexp_extract(text, r"(?s)^[^(]*\(?", 0)
    kind = F.coalesce(*[F.when(begin.rlike(p), F.lit(k)) for k, p in statements.items()], F.lit(""))
    records = stored(records.select("file", "record", "whole", text.alias("value"), F.when(opens, kind).alias("_kind")))
    kinds = records.drop("value").withColumn("_stretch", F.floor(F.col("record") / stretch))
    last = kinds.groupBy("file", "_stretch").agg(F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("record"))).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "_stretch", F.last("_last", True).over(earlier).alias("_carry"))
    so_far = Window.partitionBy("file", "_stretch").orderBy("record").rowsBetween(Window.unboundedPreceding, 0)
    known = kinds.join(carried, ["file", "_stretch"]).withColumn("kind", F.nullif(F.coalesce(F.last("_kind", True).over(so_far), F.col("_carry")), F.lit("")))
    return known.where("whole").select("file", "record", "kind").join(records.select("file", "record", "value"), ["file", "record"])
