"""Scaling and class weights, always fitted on a training slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import exact_quantiles

Scale = dict[str, tuple[float, float]]  # column -> (centre, spread)


def fit_robust(train: DataFrame, cols: Sequence[str]) -> Scale:
    """Median and interquartile range; a spread of zero becomes 1."""
    q = exact_quantiles(train, cols, [0.25, 0.5, 0.75])
    return {c: (v[1] or 0.0, ((v[2] - v[0]) if v[1] is not None else 0.0) or 1.0) for c, v in q.items()}


def fit_standard(train: DataFrame, cols: Sequence[str]) -> Scale:
    """Mean and population standard deviation; a spread of zero becomes 1."""
    row = train.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def scaled(df: DataFrame, scale: Scale) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def l2_norm(cols: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(f"`{c}`") * F.col(f"`{c}`")
    return F.sqrt(total)


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Negatives and positives."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return row["neg"], row["pos"]


def balanced_weight(label: str, neg: int, pos: int) -> Column:
    """``n / (2 * rows of the class)``."""
    n = neg + pos
    return F.when(F.col(label) == 1, F.lit(n / (2.0 * pos) if pos else 0.0)).otherwise(F.lit(n / (2.0 * neg) if neg else 0.0))


def ratio_weight(label: str, neg: int, pos: int) -> Column | None:
    """``neg / pos`` for positives and 1 for the rest; None if a class is missing."""
    if not neg or not pos:
        return None
    return F.when(F.col(label) == 1, F.lit(neg / pos)).otherwise(F.lit(1.0))
