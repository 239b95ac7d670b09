"""Lag, difference and rolling features.

Expression builders take the window of one chunk, so that a whole family shares one sort. The
families:

====== ============================================================ =========
family columns per KPI                                               look-back
====== ============================================================ =========
``A``  diff1, mean and std of the last 10 rows (inclusive)          9
``B``  diff1, mean and std of the last 5 rows (inclusive)           4
``C``  lags 1-3, diff1; mean, std, median, q10, q90 of 5 and 10     9
``D``  lags 1-3, delta1; mean and std of the 3 and 6 rows before    6
====== ============================================================ =========

Family D's ``delta1`` and the KPI itself use the current row: it suits detection, not forecasting.
Filling looks ahead for A (leading gaps) and B, C (interpolation); ``fill="causal"`` does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.clean import numbers, require
from tidemark.operators.fill import apply_fill
from tidemark.operators.order import Timeline, edges, windowed


def lags(c: str, w: WindowSpec, steps: Sequence[int] = (1, 2, 3)) -> dict[str, Column]:
    return {f"{c}__lag{k}": F.lag(c, k).over(w) for k in steps}


def delta(c: str, w: WindowSpec) -> dict[str, Column]:
    return {f"{c}__delta1": F.col(c) - F.lag(c).over(w)}


def diff(c: str, w: WindowSpec) -> dict[str, Column]:
    return {f"{c}__diff1": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))}


def past(c: str, w: WindowSpec, sizes: Sequence[int] = (3, 6)) -> dict[str, Column]:
    """Mean and sample std of the ``size`` rows before the current one."""
    out = {}
    for size in sizes:
        frame = w.rowsBetween(-size, -1)
        out[f"{c}__roll{size}_mean"] = F.avg(c).over(frame)
        out[f"{c}__roll{size}_std"] = F.stddev_samp(c).over(frame)
    return out


def inclusive(c: str, w: WindowSpec, size: int) -> dict[str, Column]:
    """Mean and sample std (0 when undefined) of the last ``size`` rows with the current one."""
    frame = w.rowsBetween(-(size - 1), 0)
    return {
        f"{c}__roll{size}_mean": F.avg(c).over(frame),
        f"{c}__roll{size}_std": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)),
    }


def quantiles(rows: DataFrame, cols: Sequence[str], w: WindowSpec, sizes: Sequence[int] = (5, 10)) -> DataFrame:
    """Median, q10 and q90 of the last ``size`` rows with the current one, nulls skipped.

    Each frame is collected and sorted once; a ``percentile`` aggregate would build a table of
    values for every row and quantile.
    """
    held = {f"{c}__last{s}": F.collect_list(c).over(w.rowsBetween(-(s - 1), 0)) for c in cols for s in sizes}
    rows = rows.withColumns(held).withColumns({name: F.sort_array(name) for name in held})
    named = {
        f"{c}__roll{s}_{k}": _at_share(F.col(f"{c}__last{s}"), q)
        for c in cols for s in sizes for k, q in (("median", 0.5), ("q10", 0.1), ("q90", 0.9))
    }
    return rows.withColumns(named).drop(*held)


def _at_share(values: Column, q: float) -> Column:
    """Linear interpolation at share ``q`` of a sorted array."""
    spot = F.lit(q) * (F.size(values) - 1)
    low = F.floor(spot).cast("int")
    first, second = F.get(values, low), F.get(values, F.ceil(spot).cast("int"))
    return F.when(F.size(values) > 0, first + (second - first) * (spot - low))


def full_mean(c: str, w: WindowSpec, size: int) -> Column:
    """Mean of the last ``size`` values, null until the frame holds that many."""
    frame = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(c).over(frame) == size, F.avg(c).over(frame))


def _family_a(c: str, w: WindowSpec) -> dict[str, Column]:
    return diff(c, w) | inclusive(c, w, 10)


def _family_b(c: str, w: WindowSpec) -> dict[str, Column]:
    return diff(c, w) | inclusive(c, w, 5)


def _family_c(c: str, w: WindowSpec) -> dict[str, Column]:
    out = lags(c, w) | diff(c, w)
    for size in (5, 10):
        out |= inclusive(c, w, size)
    return out


def _family_d(c: str, w: WindowSpec) -> dict[str, Column]:
    return lags(c, w) | delta(c, w) | past(c, w)


# family -> (expressions, look-back, fill)
FAMILIES = {
    "A": (_family_a, 9, "both"),
    "B": (_family_b, 4, "linear"),
    "C": (_family_c, 9, "linear"),
    "D": (_family_d, 6, None),
}


def add_features(tl: Timeline, kpis: Sequence[str], family: str, fill: str | None = "default") -> Timeline:
    """Clean ``kpis`` to numbers, fill their gaps and add one family's features.

    Rows with gaps left are kept; families B and C are meant to be followed by
    :func:`tidemark.functions.clean.drop_incomplete`.
    """
    require(tl.df, list(kpis))
    build, lookback, default_fill = FAMILIES[family]
    method = default_fill if fill == "default" else fill
    clean = tl.with_df(numbers(tl.df, list(kpis)))

    def frame(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if method:
            rows = apply_fill(tl, rows, kpis, method)
        made: dict[str, Column] = {}
        for c in kpis:
            made |= build(c, w)
        rows = rows.withColumns(made)
        return quantiles(rows, kpis, w) if family == "C" else rows

    carry = edges(clean, kpis, lookback) if method else None
    return tl.with_df(windowed(clean, lookback, frame, carry))


def family_columns(kpis: Sequence[str], family: str) -> list[str]:
    """KPIs with their feature columns, in a fixed order."""
    suffixes = {
        "A": ["__diff1", "__roll10_mean", "__roll10_std"],
        "B": ["__diff1", "__roll5_mean", "__roll5_std"],
        "C": ["__lag1", "__lag2", "__lag3"]
        + [f"__roll{s}_{k}" for s in (5, 10) for k in ("mean", "std", "median", "q10", "q90")]
        + ["__diff1"],
        "D": ["__lag1", "__lag2", "__lag3", "__delta1"]
        + [f"__roll{s}_{k}" for s in (3, 6) for k in ("mean", "std")],
    }[family]
    return [c + s for c in kpis for s in ["", *suffixes]]
