"""Reading and writing KPI tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clean import parse_time, require
from tidemark.functions.kpi import KPIS, LABEL, TIMESTAMP


def kpi_schema(label: bool = True, extra: Sequence[T.StructField] = ()) -> T.StructType:
    """Columns of a KPI file; numbers are read as text and cleaned later."""
    fields = [T.StructField(TIMESTAMP, T.StringType()), *[T.StructField(c, T.StringType()) for c in KPIS], *extra]
    return T.StructType(fields + ([T.StructField(LABEL, T.IntegerType())] if label else []))


def first_readable(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> str:
    """The first of ``paths`` that exists."""
    for path in paths:
        try:
            spark.read.format(fmt).schema("value string").load(path)
            return path
        except AnalysisException:
            continue
    raise FileNotFoundError(", ".join(paths))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, ts: str = TIMESTAMP) -> DataFrame:
    """Read a KPI file and keep rows with a readable time.

    Without a schema all columns are text. Order and positions come from
    :func:`tidemark.operators.order.timeline`.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        # Match columns by the header's names, not by their place.
        names = reader.csv(path).columns
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        by_name = {f.name: f for f in wanted.fields}
        full = T.StructType([by_name.get(n, T.StructField(n, T.StringType())) for n in names])
        df = reader.schema(full).csv(path)
    else:
        df = reader.csv(path)
    require(df, [ts])
    return parse_time(df, ts)


def load_table(spark: SparkSession, parquet: str | None, csv: str | None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read the parquet table, or the CSV one if there is none."""
    if parquet:
        try:
            return spark.read.parquet(parquet)
        except AnalysisException:
            pass
    if csv:
        try:
            reader = spark.read.option("header", True)
            return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(csv)
        except AnalysisException:
            pass
    raise FileNotFoundError("no scored table")


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _plain(df).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
