"""Data audit."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def audit(df: DataFrame, label: str = "anomaly") -> DataFrame:
    """One row: ``rows, cols, label_rate`` (null without a label) and ``string_cols``."""
    rate = F.avg(F.col(label).cast("double")) if label in df.columns else F.lit(None).cast("double")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = F.array(*[F.lit(t) for t in texts]) if texts else F.array().cast("array<string>")
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("cols"),
        rate.alias("label_rate"),
        F.array_join(F.first(names), ",").alias("string_cols"),
    )


def missing_top(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` columns with the largest share of missing values (one aggregate)."""
    shares = df.agg(*[F.avg(_missing(df, c).cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], [f"`{c}`" for c in df.columns], "column", "missing")
    return long.orderBy(F.desc("missing"), "column").limit(k)


def class_histogram(df: DataFrame, value: str, label: str = "anomaly", bins: int = 30) -> DataFrame:
    """``bins`` equal bins over each class's own range, empty bins included."""
    known = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    low, high = F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))
    one = F.when(high > low, F.lit(0.0)).otherwise(0.5)
    ranges = known.groupBy(label).agg((low - one).alias("__lo"), (high + one - (low - one)).alias("__width"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) / F.col("__width") * bins)).cast("int")
    # Values are counted before the join, so a class that holds most rows sends its different values only.
    seen = known.groupBy(label, value).count()
    counts = seen.join(ranges, label).groupBy(label, place.alias("bin")).agg(F.sum("count").alias("count"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    start = F.col("__lo") + F.col("__width") * F.col("bin") / bins
    return grid.join(counts, [label, "bin"], "left").select(label, "bin", start.alias("bin_start"), F.coalesce("count", F.lit(0)).alias("n"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, pairwise complete, in one aggregate: ``a, b, corr``."""
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    both = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            both.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"p{i}").alias("corr")))
    return row.select(F.inline(F.array(*both)))
