"""What kinds of files a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of file formats.
MAGIC = (("504B0304", "compressed"), ("1F8B", "compressed"), ("50415231", "parquet"), ("4152524F5731", "feather"), ("D0CF11E0A1B11AE1", "excel"))
# Byte order marks.
MARKS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"), ("EFBBBF", "utf-8-sig"))
# File suffixes.
SUFFIXES = {
    "csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "xml": "xml", "parquet": "parquet", "pq": "parquet",
    "feather": "feather", "arrow": "feather", "sql": "sql", "xlsx": "excel", "xlsm": "excel", "xls": "excel", "zip": "compressed", "gz": "compressed",
}


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, format, encoding): by first bytes, else suffix, else content; by byte order mark, else by what decodes."""
    files = spark.read.format("binaryFile").load(path)
    start = F.hex(F.substring("content", 1, 8))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    office = suffix.isin("xlsx", "xlsm")
    by_bytes = F.lit(None).cast("string")
    for signature, name in reversed(MAGIC):
        found = F.when(office, "excel").otherwise(name) if signature == "504B0304" else F.lit(name)
        by_bytes = F.when(start.startswith(signature), found).otherwise(by_bytes)
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), suffix)
    text = F.trim(F.make_valid_utf8(F.col("content").cast("string")))
    upper = F.upper(text)
    by_content = (
        F.when(text == "", "unknown").when(text.rlike(r"^[{\[]"), "json").when(text.startswith("<") & text.rlike("</|/>"), "xml")
        .when(upper.rlike(r"CREATE TABLE|INSERT INTO|DROP TABLE"), "sql").otherwise("csv")
    )
    encoding = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        encoding = F.when(start.startswith(mark), name).otherwise(encoding)
    plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("unknown")
    return files.select(
        "path", F.col("length").alias("bytes"), F.coalesce(by_bytes, by_suffix, by_content).alias("format"), F.coalesce(encoding, plain).alias("encoding")
    )
