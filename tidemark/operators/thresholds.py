"""Alert thresholds. Ties always go to the lowest threshold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as fs
from tidemark.operators.metrics import curve, pr_curve, with_rates
from tidemark.operators.quantile import exact_quantiles

# The quantiles tried by the F1 sweep, and what is returned without any score.
SWEEP = [float(q) for q in np.linspace(0.80, 0.995, 50)]
NO_SCORES = 0.5

POINT = ("threshold", "precision", "recall", "f2")


def _best(points: DataFrame, by: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The point that is largest in ``by``, then lowest in threshold, per group."""
    order = F.struct(*[b.alias(f"b{i}") for i, b in enumerate(by)], (-F.col("threshold")).alias("low"))
    return points.groupBy(*keys).agg(F.max_by(F.struct(*POINT), order).alias("p")).select(*keys, "p.*")


def best_f2(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F2."""
    best = _best(with_rates(points), [F.col("f2")], keys)
    return best.withColumns(
        {"threshold": F.coalesce("threshold", F.lit(NO_SCORES))}
        | {c: F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall", "f2")}
    )


def recall_floor_f2(points: DataFrame, floor: float = 0.70, keys: Sequence[str] = ()) -> DataFrame:
    """Largest F2 among thresholds that keep recall; null when none does."""
    kept = with_rates(points).withColumn("f2", F.when(F.col("recall") >= floor, F.col("f2")))
    usable = kept.withColumns({c: F.when(F.col("f2").isNotNull(), F.col(c)) for c in POINT})
    order = F.struct("f2", (-F.col("threshold")).alias("low"))
    return usable.groupBy(*keys).agg(
        F.max_by(F.struct(*POINT), F.when(F.col("f2").isNotNull(), order)).alias("p")
    ).select(*keys, "p.*")


def recall_floor_precision(points: DataFrame, floor: float = 0.90, keys: Sequence[str] = ()) -> DataFrame:
    """Largest precision among thresholds that keep recall; else the lowest threshold."""
    rated = with_rates(points)
    keeps = F.col("recall") >= floor
    best = _best(rated, [keeps, F.when(keeps, F.col("precision")).otherwise(F.col("recall"))], keys)
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(NO_SCORES)))


def precision_floor(points: DataFrame, floor: float = 0.8, keys: Sequence[str] = ()) -> DataFrame:
    """Largest recall among points that keep precision.

    The curve's closing point (precision 1, recall 0) has no threshold of its own and stands for
    the highest one, so there is always a result.
    """
    ends = pr_curve(points, keys)
    usable = F.when(F.col("precision") >= floor, F.struct("recall", (-F.col("threshold")).alias("low")))
    best = ends.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "precision", "recall"), usable).alias("p"), F.max("threshold").alias("top")
    )
    return best.select(*keys, F.coalesce("p.threshold", "top").alias("threshold"), "p.precision", "p.recall")


def quantile_threshold(df: DataFrame, score: str, q: float) -> float | None:
    return exact_quantiles(df, [score], [q])[score][0]


def alert_budget(df: DataFrame, score: str, rate: float = 0.05) -> float | None:
    return quantile_threshold(df, score, 1.0 - rate)


def median_threshold(per_fold: Sequence[float], labels: DataFrame | None = None, label: str = "y") -> float | None:
    """Median of the folds' thresholds; without folds, the 0.99 quantile of the labels."""
    if per_fold:
        return float(np.median(per_fold))
    return quantile_threshold(labels, label, 0.99) if labels is not None else None


def sweep_counts(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, tp, fp, fn, tn`` for each candidate.

    Rows are first counted by how many candidates they reach, so only one small group per
    candidate is left for the running sums.
    """
    ladder = sorted(set(thresholds))
    reached = F.lit(0)
    for t in ladder:
        reached = reached + (F.col(score) >= F.lit(t)).cast("int")
    steps = df.where(F.col(score).isNotNull()).groupBy(reached.alias("step")).agg(
        F.count("*").alias("n_at"), F.sum(F.col(label).cast("bigint")).alias("tp_at")
    )
    spark = df.sparkSession
    every = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ladder])], "step int, threshold double")
    w = Window.orderBy(F.desc("step"))
    filled = every.join(steps, "step", "left").na.fill(0, ["n_at", "tp_at"])
    sums = filled.select(
        "threshold",
        F.sum("n_at").over(w).alias("hit"),
        F.sum("tp_at").over(w).alias("tp"),
        F.sum("n_at").over(Window.partitionBy()).alias("n"),
        F.sum("tp_at").over(Window.partitionBy()).alias("pos"),
    ).where("threshold is not null")
    hit, tp = F.col("hit"), F.col("tp")
    return sums.select(
        "threshold", "tp", (hit - tp).alias("fp"), (F.col("pos") - tp).alias("fn"),
        (F.col("n") - F.col("pos") - (hit - tp)).alias("tn"),
    )


def best_f1_sweep(df: DataFrame, score: str = "score", label: str = "y", probs: Sequence[float] = SWEEP) -> DataFrame:
    """Largest F1 among the score quantiles ``probs``."""
    candidates = [t for t in exact_quantiles(df, [score], probs)[score] if t is not None]
    counts = sweep_counts(df, score, label, candidates).withColumns(
        {"f1": fs.fbeta(1.0), "precision": fs.precision(), "recall": fs.recall()}
    )
    return counts.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1", "precision", "recall")


def operating_points(val: DataFrame, test: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Three named thresholds chosen on ``val`` with their metrics on ``test``."""
    points = curve(val, score, label)
    chosen = {
        "f2_opt": best_f2(points).first()["threshold"],
        "high_recall": recall_floor_precision(points).first()["threshold"],
        "alert_budget_5p": alert_budget(val, score),
    }
    chosen = {name: NO_SCORES if t is None else t for name, t in chosen.items()}
    counts = sweep_counts(test, score, label, list(chosen.values()))
    spark = val.sparkSession
    names = spark.createDataFrame(list(chosen.items()), "name string, threshold double")
    rated = names.join(counts, "threshold").withColumns(fs.rates())
    return rated.select(
        "name", "threshold", "precision", "recall", "f2", "alert_rate",
        (F.col("alert_rate") * 1000.0).alias("alerts_per_1000"),
    )
