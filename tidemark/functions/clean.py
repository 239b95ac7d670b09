"""Column expressions for cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(col: str | Column) -> Column:
    """Double, or null where the text is no number or not a number."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_time(col: str | Column) -> Column:
    """Timestamp, or null where the text cannot be read. Timestamps pass through unchanged.

    Text without an offset is UTC, whatever the session's time zone; an offset or zone in the text wins.
    """
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    zoned = text.rlike(r"\d:\d{2}(:\d{2}(\.\d*)?)?\s*([+-]\d|[A-Za-z])")
    utc = F.concat(text.try_cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    return F.when((F.typeof(c) == "string") & ~zoned, utc).otherwise(c.try_cast("timestamp"))


def parse_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Coerce ``ts`` and drop the rows where that fails; without such a column, no change."""
    if ts not in df.columns:
        return df
    if not isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(ts, to_time(ts))
    return df.where(F.col(ts).isNotNull())


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in cols})


def require(df: DataFrame, cols: list[str]) -> None:
    """Fail before planning when columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def is_leak(name: str) -> bool:
    return name.startswith("anomaly_")


def drop_leaks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_leak(c)])


def feature_columns(df: DataFrame, label: str = "anomaly", ts: str = "timestamp", also: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that may be used as features: no label, time, leak or target column."""
    skip = {label, ts, "idx", *also}
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in skip
        and not is_leak(f.name)
        and "target" not in f.name.lower()
    ]


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep only rows with no null in any column; NaN counts as null."""
    return df.na.drop("any")


def drop_constant(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Remove columns with at most one distinct value (one aggregate over the table); null and NaN are none."""

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    varies = df.agg(*[(F.min(value(f)) < F.max(value(f))).alias(f.name) for f in df.schema.fields]).first()
    constant = [c for c in df.columns if not varies[c]]
    return df.drop(*constant), constant
