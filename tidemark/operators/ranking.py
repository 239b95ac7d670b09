"""Choosing rows, configurations and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_hits(df: DataFrame, k: int = 3, score: str = "score", label: str = "y", alert: str = "is_alert",
             tie: str = "idx", dedupe: bool = False) -> DataFrame:
    """The ``k`` best-scored true and false positives, marked in ``kind``.

    Rows pooled from overlapping folds may repeat; ``dedupe`` keeps the best score per ``tie``.
    """
    hits = df.where(F.col(alert))
    if dedupe:
        rest = [c for c in hits.columns if c != tie]
        best = F.max_by(F.struct(*rest), F.col(score)).alias("r")
        hits = hits.groupBy(tie).agg(best).select(tie, "r.*")
    out = None
    for kind, value in (("tp", 1), ("fp", 0)):
        top = hits.where(F.col(label) == value).orderBy(F.desc(score), F.desc(tie)).limit(k).withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out


def top_rows(df: DataFrame, by: Sequence[str], k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows largest in ``by``."""
    return df.orderBy(*[F.desc(c) for c in by], *tie).limit(k)


def best_row(df: DataFrame, by: Sequence[str], place: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row largest in ``by``; the smallest ``place`` wins ties."""
    order = F.struct(*by, (-F.col(place)).alias("early"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def rank_models(df: DataFrame, by: Sequence[str], tie: str = "model") -> DataFrame:
    """Models in order of ``by``; those without a usable first metric are left out."""
    first = F.col(by[0])
    return df.where(first.isNotNull() & ~F.isnan(first)).orderBy(*[F.desc(c) for c in by], tie)


def latest(df: DataFrame, ts: str, keys: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """The last row per series, as a partial aggregate.

    With a single ordering column (which must be unique in a series) fixed-width columns stay in a
    hash aggregate.
    """
    rest = [c for c in df.columns if c not in keys]
    if tie is None:
        return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.col(ts)).alias(c) for c in rest])
    order = F.struct(ts, tie)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def collapse_folds(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """One row per position of overlapping folds: largest score and label."""
    return df.groupBy("idx").agg(F.max(score).alias("anomaly_score"), F.max(label).alias("y_true"))


def resolve_alerts(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Set ``anomaly_score`` and ``is_alert`` from what a scored table offers.

    The score may be called ``score``. A chosen threshold wins over a stored ``is_alert``, that
    over ``pred_label``; without any of them nothing is an alert.
    """
    if "anomaly_score" not in df.columns:
        if "score" not in df.columns:
            raise ValueError("no anomaly_score or score column")
        df = df.withColumn("anomaly_score", F.col("score"))
    if threshold is not None:
        flag = F.col("anomaly_score") >= F.lit(float(threshold))
    elif "is_alert" in df.columns:
        flag = F.col("is_alert").cast("boolean")
    elif "pred_label" in df.columns:
        flag = F.col("pred_label").cast("boolean")
    else:
        flag = F.lit(False)
    return df.withColumn("is_alert", flag)


# Fixed values of the early-stop rule.
MIN_GAIN, PATIENCE, MAX_CONFIGS = 0.005, 20, 60


def early_stop(f2s: Sequence[float], min_gain: float = MIN_GAIN, patience: int = PATIENCE,
               limit: int = MAX_CONFIGS) -> tuple[int, str | None]:
    """How many configurations a search evaluates, and why it stops.

    A checkpoint holds the best F2 at some configuration. It moves when the running best has gained
    ``min_gain`` over it; the search stops once ``patience`` configurations passed without that.
    """
    best = held = held_at = None
    for done, f2 in enumerate(f2s, 1):
        if done > limit:
            return limit, "max_configs_reached"
        best = f2 if best is None else max(best, f2)
        if held is None or best - held >= min_gain:
            held, held_at = best, done
        elif done - held_at >= patience:
            return done, f"no_f2_improvement_{patience}"
    return len(f2s), None
