"""Gap filling along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import Timeline, edges, windowed

METHODS = ("both", "causal", "linear")


def apply_fill(tl: Timeline, rows: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """Fill ``cols`` inside one chunk frame that carries the columns of :func:`order.edges`.

    ``both`` is forward fill, then backward fill of what leads; ``causal`` is forward fill only;
    ``linear`` interpolates by row position and repeats the nearest value at the ends.
    """
    if method not in METHODS:
        raise ValueError(f"unknown fill: {method}")
    w = tl.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if method == "linear":
        ahead = tl.window(descending=True).rowsBetween(Window.unboundedPreceding, 0)
        # Both orders share a partitioning: the second one costs a sort, not a shuffle.
        prev, following = {}, {}
        for c in cols:
            at = F.when(F.col(c).isNotNull(), F.col("idx"))
            prev[f"{c}__prev"] = F.coalesce(F.last(c, True).over(so_far), F.col(f"{c}__before"))
            prev[f"{c}__prev_idx"] = F.coalesce(F.max(at).over(so_far), F.col(f"{c}__before_idx"))
            following[f"{c}__next"] = F.coalesce(F.last(c, True).over(ahead), F.col(f"{c}__after"))
            following[f"{c}__next_idx"] = F.coalesce(F.min(at).over(ahead), F.col(f"{c}__after_idx"))
        rows = rows.withColumns(prev).withColumns(following)
        return rows.withColumns({c: _between(c) for c in cols}).drop(*prev, *following)
    forward = {c: F.coalesce(F.last(c, True).over(so_far), F.col(f"{c}__before")) for c in cols}
    if method == "causal":
        return rows.withColumns(forward)
    # Only leading nulls are left after the forward fill, so the first value is the next one.
    return rows.withColumns(
        {c: F.coalesce(f, F.first(c, True).over(whole), F.col(f"{c}__after")) for c, f in forward.items()}
    )


def _between(c: str) -> Column:
    """Value on the line between the known neighbours; the nearest one at the ends."""
    prev, following, start = F.col(f"{c}__prev"), F.col(f"{c}__next"), F.col(f"{c}__prev_idx")
    slope = (following - prev) / (F.col(f"{c}__next_idx") - start)
    return F.coalesce(F.col(c), prev + slope * (F.col("idx") - start), prev, following)


def fill(tl: Timeline, cols: Sequence[str], method: str = "both") -> DataFrame:
    return windowed(tl, 0, lambda rows, w: apply_fill(tl, rows, cols, method), edges(tl, cols, 0))
