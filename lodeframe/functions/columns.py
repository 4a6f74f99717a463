"""Small helpers over columns and schemas that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_time(df, c)]


def scalar_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    c = q(name)
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def no_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean(df, c) for c in floats}) if floats else df


def as_number(df: DataFrame, name: str) -> Column:
    """A double that sorts as the column does; times become seconds."""
    if is_time(df, name):
        return F.unix_micros(q(name).cast("timestamp")) / F.lit(1e6)
    return clean(df, name).cast("double")


def facts(df: DataFrame, aggregates: dict[str, Column]) -> Row:
    """One row of fitted values on the driver: one job, one row, whatever the table's size."""
    if not aggregates:
        return Row()
    return df.agg(*[c.alias(k) for k, c in aggregates.items()]).first()


def rows(spark, values: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of findings about columns; its size follows the schema, never the data."""
    return spark.createDataFrame(list(values), schema)


def long_values(df: DataFrame, cols: list[str], cast: str = "string") -> DataFrame:
    """(column, value) for the named columns, one pass."""
    return df.select(*[clean(df, c).cast(cast).alias(c) for c in cols]).unpivot([], cols, "column", "value")


def value_counts(df: DataFrame, cols: list[str], cast: str = "string") -> DataFrame:
    """(column, value, n): counted map-side before the shuffle, so a hot value costs one row per task."""
    return long_values(df, cols, cast).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over the rows that know both; null, not an error, where one of them is constant."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
