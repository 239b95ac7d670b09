"""Ranking metrics, exact for any number of distinct scores.

Everything is read from one table with a row per group and distinct score. Its running counts come
from :func:`order.running_totals`, so neither a group nor the whole table has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as fs
from tidemark.functions.kpi import TOP_SHARES
from tidemark.operators import quantile
from tidemark.operators.order import running_totals, timeline

BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast join only if ``df`` has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys``, keeping the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def curve(df: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """One row per group and distinct score, with counts of ``score >= threshold``.

    Columns: keys, ``threshold, n_at, tp_at`` (rows and positives at this score), ``n_above,
    tp_above`` (at this score or higher), ``n, pos`` (whole group).
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    grouped = rows.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count("*").alias("n_at"), F.sum(F.col(label).cast("bigint")).alias("tp_at")
    )
    line = timeline(grouped, [F.desc("threshold")], keys=keys, unique=True)
    return running_totals(
        line, {"n_above": F.col("n_at"), "tp_above": F.col("tp_at")}, {"n_above": "n", "tp_above": "pos"}
    ).drop("idx")


def with_rates(points: DataFrame) -> DataFrame:
    """Add precision, recall and F2 to :func:`curve` rows; recall is 1 when there are no positives."""
    tp, fp = F.col("tp_above"), F.col("n_above") - F.col("tp_above")
    return points.withColumns(
        {
            "precision": fs.precision(tp, fp),
            "recall": F.when(F.col("pos") > 0, tp / F.col("pos")).otherwise(F.lit(1.0)),
            "f2": fs.fbeta(2.0, tp, fp, F.col("pos") - tp),
        }
    )


def pr_curve(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per threshold, closed by the point (1, 0) without a threshold."""
    body = with_rates(points).select(*keys, "threshold", "precision", "recall")
    end = points.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return body.unionByName(end)


def roc_curve(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate per threshold, opened by (0, 0); null when a class is missing."""
    neg = F.col("n") - F.col("pos")
    body = points.select(
        *keys,
        "threshold",
        F.when(neg > 0, (F.col("n_above") - F.col("tp_above")) / neg).alias("fpr"),
        F.when(F.col("pos") > 0, F.col("tp_above") / F.col("pos")).alias("tpr"),
    )
    start = points.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return body.unionByName(start)


def average_precision() -> Column:
    """Aggregate over :func:`curve` rows: step-wise area under the PR curve, 0 without positives."""
    step = F.when(F.col("pos") > 0, F.col("tp_at") / F.col("pos") * (F.col("tp_above") / F.col("n_above")))
    return F.coalesce(F.sum(step), F.lit(0.0))


def roc_auc() -> Column:
    """Aggregate over :func:`curve` rows: ties count half; null when a class is missing."""
    fp_at, tp_before = F.col("n_at") - F.col("tp_at"), F.col("tp_above") - F.col("tp_at")
    pairs = F.col("pos").cast("double") * (F.col("n") - F.col("pos"))
    return F.sum(F.when(pairs > 0, fp_at * (tp_before + F.col("tp_at") / 2.0) / pairs))


def confusion_at(points: DataFrame, threshold: str | Column | float) -> dict[str, Column]:
    """Aggregates over :func:`curve` rows: tp, fp, fn, tn at ``threshold``."""
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else (
        F.col(threshold) if isinstance(threshold, str) else threshold)
    hit = F.col("threshold") >= thr
    tp, all_hit = F.sum(F.when(hit, F.col("tp_at")).otherwise(0)), F.sum(F.when(hit, F.col("n_at")).otherwise(0))
    return {
        "tp": tp,
        "fp": all_hit - tp,
        "fn": F.max("pos") - tp,
        "tn": F.max("n") - F.max("pos") - (all_hit - tp),
    }


def metric_bundle(
    df: DataFrame,
    thresholds: DataFrame | float,
    score: str = "score",
    label: str = "y",
    keys: Sequence[str] = (),
    points: DataFrame | None = None,
) -> DataFrame:
    """Precision, recall, F1, F2, step AP, ROC-AUC, the four counts and alert rate per group.

    ``thresholds`` is one number or a table with ``keys`` and ``thr``.
    """
    points = curve(df, score, label, keys) if points is None else points
    if isinstance(thresholds, DataFrame):
        joined = match_keys(points, small_side(thresholds.select(*keys, "thr")), keys)
    else:
        joined = points.withColumn("thr", F.lit(float(thresholds)))
    rows = joined.groupBy(*keys).agg(
        F.max("thr").alias("used"),
        *[c.alias(n) for n, c in confusion_at(joined, "thr").items()],
        average_precision().alias("pr_auc"),
        roc_auc().alias("roc_auc"),
    )
    return rows.select(
        *keys,
        F.col("used").alias("threshold"),
        *[c.alias(n) for n, c in fs.rates().items()],
        "pr_auc",
        "roc_auc",
        "tp",
        "fp",
        "fn",
        "tn",
    )


def at_top(
    df: DataFrame,
    score: str = "score",
    label: str = "y",
    keys: Sequence[str] = (),
    shares: Sequence[float] = TOP_SHARES,
    tie: str = "idx",
) -> DataFrame:
    """``precision_at_<k>p`` and ``recall_at_<k>p`` of the best ``max(1, int(n * share))`` rows.

    Rows with equal scores rank by ``tie`` descending.
    """
    rows = df.select(*keys, F.col(score).alias("__s"), F.col(label).cast("bigint").alias("__y"), F.col(tie).alias("__t"))
    rows = rows.where(F.col("__s").isNotNull())
    by = [F.desc("__s"), F.desc("__t")]
    if not keys:
        # Only rows that can be among the best need sorting; the others only count.
        n, pos = rows.agg(F.count(F.when(~F.isnan(F.col("__s").cast("double")), 1)), F.sum("__y")).first()
        if n:
            low = n - max(1, int(n * max(shares)))
            cut = quantile.values_at(rows, {"__s": [low]}, {"__s": n})["__s"][low]
            rows = rows.where(F.col("__s") >= cut)
        ranked = timeline(rows, by).df.withColumns({"rank": F.col("idx"), "n": F.lit(n).cast("bigint"), "pos": F.lit(pos).cast("bigint")})
        return ranked.agg(*_top_aggregates(shares))
    line = timeline(rows, by, keys=keys)
    ranked = running_totals(line, {"rank": F.lit(1).cast("bigint"), "pos_so_far": F.col("__y")}, {"rank": "n", "pos_so_far": "pos"})
    return ranked.withColumn("rank", F.col("rank") - 1).groupBy(*keys).agg(*_top_aggregates(shares))


def _top_aggregates(shares: Sequence[float]) -> list[Column]:
    out = []
    for share in shares:
        size = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") * F.lit(share)).cast("bigint"))
        best = F.col("rank") < size
        name = f"{int(share * 100)}p"
        out.append((F.sum(F.when(best, F.col("__y"))) / F.count_if(best)).alias(f"precision_at_{name}"))
        out.append((F.sum(F.when(best, F.col("__y"))) / F.greatest(F.lit(1), F.max("pos"))).alias(f"recall_at_{name}"))
    return out


def fold_summary(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``<metric>_mean`` and population ``<metric>_std`` over folds."""
    return df.groupBy(*keys).agg(
        *[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    )


def alert_stats(df: DataFrame, alert: str = "is_alert", label: str | None = None) -> DataFrame:
    """Alert rate, alerts per 1000 rows and, with a label, the positive rate."""
    rate = F.avg(F.col(alert).cast("int"))
    extra = [F.avg(F.col(label).cast("int")).alias("positive_rate")] if label else []
    return df.agg(rate.alias("alert_rate"), (rate * 1000.0).alias("alerts_per_1000"), *extra)
