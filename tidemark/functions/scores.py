"""Expressions on confusion counts. Every zero division gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: str | Column, bottom: str | Column) -> Column:
    top, bottom = _col(top), _col(bottom)
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def precision(tp: str | Column = "tp", fp: str | Column = "fp") -> Column:
    return ratio(tp, _col(tp) + _col(fp))


def recall(tp: str | Column = "tp", fn: str | Column = "fn") -> Column:
    return ratio(tp, _col(tp) + _col(fn))


def fbeta(beta: float, tp: str | Column = "tp", fp: str | Column = "fp", fn: str | Column = "fn") -> Column:
    b2 = beta * beta
    weighted = _col(tp) * (1.0 + b2)
    return ratio(weighted, weighted + _col(fn) * b2 + _col(fp))


def confusion(score: str | Column, label: str | Column, threshold: str | Column | float) -> dict[str, Column]:
    """Aggregates ``tp, fp, fn, tn`` of ``score >= threshold``; always four counts."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else _col(threshold)
    alert, positive = _col(score) >= thr, _col(label) == 1
    return {
        "tp": F.count_if(alert & positive),
        "fp": F.count_if(alert & ~positive),
        "fn": F.count_if(~alert & positive),
        "tn": F.count_if(~alert & ~positive),
    }


def rates() -> dict[str, Column]:
    """Precision, recall, F1, F2 and alert rate from columns ``tp, fp, fn, tn``."""
    return {
        "precision": precision(),
        "recall": recall(),
        "f1": fbeta(1.0),
        "f2": fbeta(2.0),
        "alert_rate": ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
    }
