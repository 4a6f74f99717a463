"""Delimited, JSON, XML, Parquet, Arrow, SQL-script and archive sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.columns import facts, is_string, q, rows, scalar_columns
from lodeframe.functions.dates import parsed_time
from lodeframe.sources.documents import json_lines, json_values, script_records
from lodeframe.sources.lines import joined_lines, numbered_lines
from lodeframe.sources.nested import flatten

DELIMITERS = (",", ";", "\t", "|")
#: Lines that a quoted field may run across before its quote counts as a stray one.
LONGEST = 10_000


def _regex(sep: str) -> str:
    return "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep


def outside_quotes(line: Column) -> Column:
    """The line with quoted parts emptied, so that delimiters in them are not counted."""
    return F.regexp_replace(line, '"[^"]*"', "")


def field_count(line: Column, sep: str) -> Column:
    return F.size(F.split(outside_quotes(line), _regex(sep)))


def _quoting_states(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted field goes on after a line that begins outside of one, and after one that begins inside.

    Quotes open a field at its start only, and end it before a delimiter or the end of the line; doubled ones are letters.
    """
    begin, end = rf"(^|{_regex(sep)})[ \t]*", rf"[ \t]*({_regex(sep)}|$)"
    single = F.replace(line, F.lit('""'), F.lit(""))

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, rf'{begin}"[^"]*"', "$1x").rlike(rf'{begin}"')

    closed = single.rlike(f'"{end}')
    return opens(single), F.when(closed, opens(F.regexp_replace(single, rf'^.*?"(?={end})', "x"))).otherwise(F.lit(True))


def numbered_records(spark: SparkSession, path: str, encoding: str = "utf-8", multiline: bool = False, sep: str = ",", longest: int = LONGEST) -> DataFrame:
    """The numbered lines of a delimited file or, with `multiline`, its records, whose quoted fields may hold line breaks; `unclosed` marks
    lines with a quoted field that does not end."""
    lines = numbered_lines(spark, path, encoding)
    return joined_lines(lines, *_quoting_states(F.col("value"), sep), "\n", longest) if multiline else lines.withColumn("unclosed", F.lit(False))


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(delimiter, score) best first: mean number of fields, less where lines disagree; space counts only if nothing else splits."""
    lines = spark.read.option("encoding", encoding).text(path).where(F.trim("value") != "")
    counts = {d: F.size(F.split("value", _regex(d))) for d in (*DELIMITERS, " ")}
    got = facts(lines, {f"m{i}": F.avg(c) for i, c in enumerate(counts.values())} | {f"s{i}": F.stddev_pop(c) for i, c in enumerate(counts.values())})
    found = []
    for i, d in enumerate(counts):
        mean = got[f"m{i}"] or 0.0
        score = mean * (1 - min(got[f"s{i}"] / mean, 1.0)) if mean > 1 else 0.0
        found.append((d, score))
    primary = [f for f in found if f[0] != " "]
    ranked = primary if any(s > 1 for _, s in primary) else found
    ranked = sorted(ranked, key=lambda f: -f[1])
    return rows(spark, [(d, s, i == 0 and s > 0) for i, (d, s) in enumerate(ranked)], "delimiter string, score double, chosen boolean")


def delimiter_of(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    return next((r["delimiter"] for r in detect_delimiter(spark, path, encoding).collect() if r["chosen"]), ",")


# Quotes inside a quoted field are doubled.
QUOTING = {"quote": '"', "escape": '"', "emptyValue": "", "maxCharsPerColumn": "-1"}


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    return spark.read.options(header=True, sep=sep, encoding=encoding, enforceSchema=False, **QUOTING).csv(path).columns


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8", strict: bool = False, multiline: bool = False) -> DataFrame:
    """Every field as text, empty ones as empty text. `strict` keeps only records with as many fields as the header.

    Files are split by Spark, so size makes no difference; a codec is told by the file's suffix. Quoted fields may hold the delimiter and
    doubled quotes; with `multiline` line breaks too, wherever the file is split.
    """
    sep = sep or delimiter_of(spark, path, encoding)
    if strict or multiline:
        return read_numbered(spark, path, sep, encoding, strict, multiline).drop("file", "row_number")
    df = spark.read.options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE", **QUOTING).csv(path)
    return df.select(*[F.coalesce(q(c), F.lit("")).alias(c) for c in df.columns])


def read_numbered(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", strict: bool = False, multiline: bool = False) -> DataFrame:
    """As read_delimited, with file and row_number (the header is line 1), for joins with a report on lines."""
    header = _header(spark, path, sep, encoding)
    lines = numbered_records(spark, path, encoding, multiline, sep).where("row_number > 1").where(F.trim("value") != "")
    if strict:
        lines = lines.where((field_count(F.col("value"), sep) == len(header)) & ~F.col("unclosed"))
    schema = ", ".join(f"`{h}` STRING" for h in header)
    parsed = lines.withColumn("_row", F.from_csv("value", schema, {"sep": sep, "multiLine": "true", **QUOTING}))
    return parsed.select("file", "row_number", *[F.coalesce(F.col("_row").getField(h), F.lit("")).alias(h) for h in header])


def malformed_rows(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", most: int | None = None, multiline: bool = False) -> DataFrame:
    """(file, row_number, raw, issue, severity): records whose fields do not match the header, quotes without an end, undecodable characters.

    Up to two fields off is a warning, more an error. In the order of the file; `most` cuts it for display.
    """
    expected = len(_header(spark, path, sep, encoding))
    lines = numbered_records(spark, path, encoding, multiline, sep).where("row_number > 1").withColumn("raw", F.trim("value")).where("raw <> ''")
    off = field_count(F.col("raw"), sep) - F.lit(expected)
    count = F.when(off != 0, F.struct(
        F.when(off > 0, F.concat(off.cast("string"), F.lit(" extra"))).otherwise(F.concat((-off).cast("string"), F.lit(" missing"))).alias("issue"),
        F.when(F.abs(off) <= 2, "warning").otherwise("error").alias("severity"),
    ))
    coded = F.when(F.col("raw").contains("\ufffd"), F.struct(F.lit("replacement characters").alias("issue"), F.lit("warning").alias("severity")))
    stray = F.when(F.col("unclosed"), F.struct(F.lit("unclosed quote").alias("issue"), F.lit("error").alias("severity")))
    found = lines.withColumn("_i", F.explode(F.filter(F.array(F.when(~F.col("unclosed"), count), stray, coded), lambda x: x.isNotNull())))
    found = found.select("file", "row_number", "raw", "_i.issue", "_i.severity").orderBy("file", "row_number")
    return found if most is None else found.limit(most)


def drop_malformed(numbered: DataFrame, report: DataFrame) -> DataFrame:
    """A numbered table without the lines that a report calls errors."""
    errors = report.where("severity = 'error'").select("file", "row_number").distinct()
    return numbered.join(errors, ["file", "row_number"], "left_anti")


def malformed_comparison(spark: SparkSession, path: str, numbered: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """Raw lines beside what they were parsed to; lines that were dropped have no fields."""
    raw = numbered_lines(spark, path, encoding).where("row_number > 1").where(F.trim("value") != "")
    return raw.withColumnRenamed("value", "raw").join(numbered, ["file", "row_number"], "left")


# Sequences that a wrong encoding leaves behind, with what accented letters turn into.
# An accented capital alone is a letter; what follows it shows that it was the first of two bytes.
_SECOND = "[\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
ARTEFACTS = {"Ã": f"Ã{_SECOND}", "Â": f"Â{_SECOND}", "â€": "â€", "�": "�"}


def structural_issues(df: DataFrame, empty_share: float = 0.9) -> DataFrame:
    """(column, issue, count): repeated names, empty and nearly empty columns, traces of a wrong encoding."""
    names = df.columns
    found = [(c, "duplicate_name", names.count(c)) for c in sorted({c for c in names if names.count(c) > 1})]
    cols = [c for c in scalar_columns(df) if names.count(c) == 1]
    texts = [c for c in cols if is_string(df, c)]
    blank = lambda c: q(c).isNull() | (F.trim(q(c).cast("string")) == "")
    aggregates = {"n": F.count(F.lit(1))} | {f"b{i}": F.count_if(blank(c)) for i, c in enumerate(cols)} | {f"k{i}": F.count_if(q(c).isNull()) for i, c in enumerate(cols)}
    for i, c in enumerate(texts):
        aggregates |= {f"a{i}_{j}": F.count_if(q(c).rlike(a)) for j, a in enumerate(ARTEFACTS.values())}
    got = facts(df, aggregates)
    for i, c in enumerate(cols):
        if got["n"] and got[f"b{i}"] == got["n"]:
            found.append((c, "empty", got["n"]))
        elif got["n"] and got[f"k{i}"] / got["n"] > empty_share:
            found.append((c, "mostly_null", got[f"k{i}"]))
    for i, c in enumerate(texts):
        hit = next(((a, got[f"a{i}_{j}"]) for j, a in enumerate(ARTEFACTS) if got[f"a{i}_{j}"]), None)
        if hit:
            found.append((c, f"encoding {hit[0]}", hit[1]))
    return rows(df.sparkSession, found, "column string, issue string, count long")


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns turned into numbers, else times, where no filled value fails to convert. One aggregate decides for all."""
    texts = [c for c in scalar_columns(df) if is_string(df, c)]
    filled = {c: F.when(F.trim(q(c)) != "", F.trim(q(c))) for c in texts}
    moment = {c: parsed_time(v) for c, v in filled.items()}
    aggregates = {}
    for i, c in enumerate(texts):
        v = filled[c]
        aggregates |= {
            f"n{i}": F.count(v), f"x{i}": F.count_if(v.isNotNull() & v.try_cast("double").isNull()), f"w{i}": F.count_if(v.isNotNull() & ~v.rlike(r"^[+-]?\d{1,18}$")),
            f"t{i}": F.count_if(v.isNotNull() & moment[c].isNull()),
        }
    got = facts(df, aggregates)
    out = {}
    for i, c in enumerate(texts):
        if not got[f"n{i}"]:
            continue
        if got[f"x{i}"] == 0:
            out[c] = filled[c].try_cast("long" if got[f"w{i}"] == 0 else "double")
        elif got[f"t{i}"] == 0:
            out[c] = moment[c]
    return df.withColumns(out) if out else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents that are an array of objects, one object or several after another, or an array of values (column `value`).

    Long documents are cut into records by many tasks; a broken record is a row of `_corrupt_record` and leaves the others alone.
    """
    values = json_values(spark, path)
    return spark.read.json(json_lines(spark, path)) if values is None else infer_types(values)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines)."""
    plain = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    fields = [f for f in plain if f.name != "_corrupt_record"]
    schema = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "")
    parsed = parsed.withColumn("_r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*[F.col("_r").getField(f.name).alias(f.name) for f in fields]), parsed.where(bad).select("value")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Arrow files, one after another within a task and many over the cluster; the schema is that of the first file."""
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        first = files.orderBy("path").select("content").first()["content"]
        with pa.ipc.open_file(io.BytesIO(first)) as reader:
            empty = reader.schema.empty_table()
        schema = spark.createDataFrame(empty).schema

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with pa.ipc.open_file(pa.py_buffer(content.as_py())) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    return files.select("content").mapInArrow(tables, schema)


def row_tag_of(spark: SparkSession, path: str) -> str:
    """The most frequent element that has elements inside."""
    text = spark.read.text(path, wholetext=True)
    tags = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.\-]*)[^<>]*[^/<>]?>\s*(?=<[A-Za-z_])"), 1)).alias("tag"))
    best = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").first()
    if best is None:
        raise ValueError("no repeated element in the document")
    return best["tag"]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """One row per repeated element, flattened; attributes start with @ and mixed text is #text."""
    row_tag = row_tag or row_tag_of(spark, path)
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "#text").load(path)
    return flatten(df)


# One value of an INSERT: a quoted text with doubled quotes, or anything up to the comma.
_SQL_VALUE = r"\s*('[^']*+(?:''[^']*+)*+'|[^,']+)\s*(?:,|$)"


def read_sql_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table from its INSERT statements, as text; NULL is null. Names come from CREATE TABLE, else from the INSERT.

    Short rows are filled with null and long ones cut. Statements end with a semicolon outside quoted texts, in which quotes are doubled or
    escaped; one with many rows is read by many tasks.
    """
    name = rf'[`"\[]?{table}[`"\]]?'
    insert = rf"(?is)\binsert\s+into\s+{name}[\s(]"
    parts = script_records(spark, path, {"insert": insert, "create": rf"(?is)\bcreate\s+table\s+(if\s+not\s+exists\s+)?{name}\s*\("})
    made = parts.where("kind = 'create'").limit(1).select(F.col("value").alias("s")).collect()
    inserts = parts.where("kind = 'insert'")
    if made:
        body = made[0]["s"].split("(", 1)[1].rsplit(")", 1)[0]
        parts, depth, part = [], 0, ""
        for letter in body:
            depth += (letter == "(") - (letter == ")")
            if letter == "," and depth == 0:
                parts.append(part)
                part = ""
            else:
                part += letter
        words = [p.strip().split(None, 1)[0] for p in [*parts, part] if p.strip()]
        columns = [w.strip('`"[]') for w in words if w.upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "KEY", "CONSTRAINT", "CHECK", "INDEX")]
    else:
        heads = inserts.select(F.regexp_extract("value", rf"(?is)^[^(]*\binsert\s+into\s+{name}\s*\(([^)]*)\)", 1).alias("c")).where("c <> ''")
        first = heads.first()
        columns = [c.strip().strip('`"[]') for c in (first["c"] if first else "").split(",") if c.strip()]
    row = rf"(?is)^(?:[^(]*\binsert\s+into\s+{name}\s+values|\s*values|\s*,)\s*\((.*)\)$"
    # Exploding a list of one keeps the values from being matched again for each column.
    fields = inserts.where(F.col("value").rlike(row)).select(F.explode(F.array(F.regexp_extract_all(F.regexp_extract("value", row, 1), F.lit(_SQL_VALUE), 1))).alias("f"))

    def value(i: int) -> Column:
        raw = F.trim(F.get("f", F.lit(i)))
        text = F.regexp_replace(F.regexp_replace(raw, r"(?s)^'(.*)'$", "$1"), "''", "'")
        return F.when(F.upper(raw) != "NULL", F.when(raw.startswith("'"), text).otherwise(raw))

    return fields.select(*[value(i).alias(c) for i, c in enumerate(columns)])


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line_number, line) of the text files in archives; one archive per task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith("/") or member.startswith("__MACOSX"):
                            continue
                        with io.TextIOWrapper(z.open(member), encoding="utf-8", errors="replace") as text:
                            part: list[tuple] = []
                            for i, line in enumerate(text, 1):
                                part.append((archive, member, i, line.rstrip("\r\n")))
                                if len(part) == 10_000:
                                    yield pd.DataFrame(part, columns=["archive", "member", "line_number", "line"])
                                    part = []
                            if part:
                                yield pd.DataFrame(part, columns=["archive", "member", "line_number", "line"])

    return files.mapInPandas(lines, "archive string, member string, line_number long, line string")


def zip_table(lines: DataFrame, member: str, sep: str = ",") -> DataFrame:
    """One delimited or JSON-lines member of the archives as a table."""
    mine = lines.where((F.col("member") == member) & (F.trim("line") != ""))
    if member.lower().endswith((".jsonl", ".ndjson")):
        found = facts(mine, {"s": F.schema_of_variant_agg(F.try_parse_json("line"))})["s"]
        return mine.select(F.from_json("line", found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")).alias("r")).select("r.*")
    header = mine.where("line_number = 1").select("line").first()["line"].split(sep)
    schema = ", ".join(f"`{h.strip(chr(34))}` STRING" for h in header)
    return mine.where("line_number > 1").select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")
