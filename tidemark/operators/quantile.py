"""Exact quantiles of any number of columns by narrowing brackets.

All columns go through the same few aggregates: count them, cut the open brackets at sketched values just below and above each
wanted rank, count the parts, and keep the part that holds the rank, until a bracket has few rows; those are sorted. The
number of jobs depends on the rows (each round divides a bracket by some thousand), not on the columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 100_000  # rows of one bracket that one task sorts
SKETCH = 10_000
MARGIN = 2 / SKETCH  # of a bracket's rows, between a wanted rank and the cuts around it: twice the sketch's error

Bracket = tuple[float | None, float | None]  # open on both sides; None: no end


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; nulls and NaN are skipped (``None`` if nothing is left)."""
    cols = list(dict.fromkeys(cols))
    df = df.select(*[_known(c).alias(c) for c in cols])
    counts = df.agg(*[F.expr(f"count(`{c}`)").alias(f"n{i}") for i, c in enumerate(cols)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(cols)}
    spots = {c: [p * (n - 1) for p in probs] for c, n in sizes.items() if n}
    found = values_at(df, {c: sorted({r for s in at for r in (math.floor(s), math.ceil(s))}) for c, at in spots.items()}, sizes, few)

    def between(c: str, spot: float) -> float:
        low, high = found[c][math.floor(spot)], found[c][math.ceil(spot)]
        return low if low == high else low + (high - low) * (spot - math.floor(spot))

    return {c: [between(c, s) for s in spots[c]] if c in spots else [None] * len(probs) for c in cols}


def _known(c: str) -> Column:
    return F.expr(f"nullif(double(`{c}`), double('NaN'))")


def values_at(df: DataFrame, ranks: dict[str, Sequence[int]], sizes: dict[str, int], few: int = FEW) -> dict[str, dict[int, float]]:
    """Values at 0-based ``ranks`` of the sorted columns; ``sizes`` counts the values of each."""
    names = [c for c in ranks if ranks[c]]
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    if not names:
        return found
    known = df.select(*[_known(c).alias(f"v{i}") for i, c in enumerate(names)])
    cells = ", ".join(f"named_struct('c', {i}, 'v', v{i})" for i in range(len(names)))
    values = known.selectExpr(f"inline(array({cells}))").where("v is not null")
    # Open brackets by column: the wanted ranks inside (less the rows before the bracket) and the number of rows.
    todo: dict[tuple[int, Bracket], tuple[list[tuple[int, int]], int]] = {
        (i, (None, None)): ([(r, r) for r in ranks[c]], sizes[c]) for i, c in enumerate(names)}
    while large := {k: v for k, v in todo.items() if v[1] > few}:
        cuts = _cuts(known, large)
        # Place 2k lies between two cuts, k of them below; 2k + 1 is on a cut.
        place = " ".join(f"when {b} then {_place(own)}" for b, own in enumerate(cuts))
        counts = _tagged(values, list(large)).groupBy("b", F.expr(f"case b {place} end").alias("place")).count().collect()
        for b, (key, (wanted, _)) in enumerate(large.items()):
            del todo[key]
            before = 0
            for r in sorted((r for r in counts if r["b"] == b), key=lambda r: r["place"]):
                below, on = divmod(r["place"], 2)
                here = [(rank, at - before) for rank, at in wanted if before <= at < before + r["count"]]
                low = cuts[b][below - 1] if below else key[1][0]
                high = cuts[b][below] if below < len(cuts[b]) else key[1][1]
                if here and on:
                    found[names[key[0]]].update({rank: high for rank, _ in here})
                elif here:
                    todo[key[0], (low, high)] = (here, r["count"])
                before += r["count"]
    if todo:
        upto = F.sum("count").over(Window.partitionBy("b").orderBy("v"))
        spans = _tagged(values, list(todo)).groupBy("b", "v").count().select("b", "v", (upto - F.col("count")).alias("start"), upto.alias("stop"))
        wanted = ", ".join("array(" + ", ".join(f"{at}L" for _, at in w) + ")" for w, _ in todo.values())
        hits = spans.selectExpr("b", "v", f"explode(filter(get(array({wanted}), b), i -> i >= start and i < stop)) as at").collect()
        got = {(r["b"], r["at"]): r["v"] for r in hits}
        for b, ((i, _), (w, _)) in enumerate(todo.items()):
            found[names[i]].update({rank: got[b, at] for rank, at in w})
    return found


# Texts, since building these expressions column by column takes seconds.


def _double(x: float) -> str:
    return f"double('{x!r}')"  # also inf


def _inside(v: str, bracket: Bracket) -> str:
    ends = [f"{v} {side} {_double(x)}" for side, x in zip("><", bracket) if x is not None]
    return " and ".join([f"{v} is not null", *ends])


def _cuts(known: DataFrame, large: dict[tuple[int, Bracket], tuple[list[tuple[int, int]], int]]) -> list[list[float]]:
    """Ascending values of each bracket, around the shares of its rows that the wanted ranks lie at."""
    made = []
    for b, ((i, bracket), (wanted, size)) in enumerate(large.items()):
        shares = sorted({min(max((at + 0.5) / size + side, 0.0), 1.0) for _, at in wanted for side in (-MARGIN, MARGIN)})
        inside = f"case when {_inside(f'v{i}', bracket)} then v{i} end"
        made.append(F.expr(f"percentile_approx({inside}, array({', '.join(map(_double, shares))}), {SKETCH})").alias(f"b{b}"))
    return [sorted(set(cuts)) for cuts in known.agg(*made).first()]


def _place(cuts: Sequence[float], low: int = 0) -> str:
    """Twice the number of cuts below ``v``, and one more if it is on a cut, by halving."""
    if not cuts:
        return str(2 * low)
    mid = len(cuts) // 2
    at = _double(cuts[mid])
    return f"case when v < {at} then {_place(cuts[:mid], low)} when v = {at} then {2 * (low + mid) + 1} else {_place(cuts[mid + 1:], low + mid + 1)} end"


def _tagged(values: DataFrame, brackets: Sequence[tuple[int, Bracket]]) -> DataFrame:
    """Rows inside a bracket of their column, with its number ``b``."""
    own = " ".join(f"when c = {i} and {_inside('v', bracket)} then {b}" for b, (i, bracket) in enumerate(brackets))
    return values.select(F.expr(f"case {own} end").alias("b"), "v").where("b is not null")


def median_fill(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the median of ``train``; a column without a train value stays null.

    Filled columns are doubles, since a median may lie between two integers.
    """
    medians = exact_quantiles(train, cols, [0.5])
    known = {c: m[0] for c, m in medians.items() if m[0] is not None}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(m))) for c, m in known.items()})
