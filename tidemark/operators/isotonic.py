"""Isotonic regression of 0/1 labels, for any number of distinct scores.

The pooled means are the slopes of the lower hull of the running counts (rows, positives) over ascending scores. Each chunk of scores
keeps the corners of its own hull. Where these are too many for one task, directions cut the hull: the lowest point in a direction is a
corner of the whole hull, found by one aggregate, and between two such corners only points inside, whose own
slopes lie between the two directions, matter. Counts are whole and compared as such, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators.fill import fill
from tidemark.operators.order import running_totals, timeline
from tidemark.session import materialize

#: Distinct scores whose hull is found in one task.
CHUNK = 65_536
#: Corners that one task takes; more are cut by directions.
HULL_POINTS = 1 << 18
#: Steps up to which tasks get the whole curve; a longer one is sorted together with the rows.
STEPS = 65_536

POINT = "at bigint, x double, w bigint, s bigint"
CORNER = f"{POINT}, low double, high double"
BLOCK = "first bigint, last bigint, hi double, value double"
SLACK = 1e-9


def hull(w: list[int], s: list[int]) -> list[int]:
    """Places of the corners of the lower hull of points with ascending ``w``."""
    kept: list[int] = []
    for i in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (s[b] - s[a]) * (w[i] - w[b]) < (s[i] - s[b]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


def _corners(points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("at")
    return points.iloc[hull(points["w"].tolist(), points["s"].tolist())]


def _chunk_corners(points: pd.DataFrame) -> pd.DataFrame:
    """Corners with the slopes of the edges on either side."""
    out = _corners(points)[["at", "x", "w", "s"]]
    slopes = np.diff(out["s"]) / np.diff(out["w"])
    return out.assign(low=np.append(-np.inf, slopes), high=np.append(slopes, np.inf))


def _blocks(points: pd.DataFrame) -> pd.DataFrame:
    """Positions from ``first`` to ``last`` between two corners, the last score and the mean label."""
    c = _corners(points)
    value = np.diff(c["s"]) / np.diff(c["w"])
    return pd.DataFrame({"first": c["at"].to_numpy()[:-1] + 1, "last": c["at"].to_numpy()[1:], "hi": c["x"].to_numpy()[1:], "value": value})


def _cut(corners: DataFrame, count: int, most: int) -> DataFrame:
    """``corners`` with a ``part``: the hull of all is that of the parts, one behind the other."""
    parts = -(-count // max(1, most // 4))
    probs = [i / parts for i in range(1, parts)]
    edges = corners.where(F.col("high") < float("inf"))
    found = edges.agg(F.percentile_approx("high", probs, 100 * parts)).first()[0] or []
    directions = sorted({Fraction(float(m)).limit_denominator(10**9) for m in found})
    slopes = np.array([float(m) for m in directions])

    def touching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start, stop = np.searchsorted(slopes, b["low"] - SLACK), np.searchsorted(slopes, b["high"] + SLACK, "right")
            each = b.loc[b.index.repeat(stop - start), ["at", "w", "s"]]
            yield each.assign(k=np.concatenate([np.arange(i, j) for i, j in zip(start, stop)] or [np.zeros(0, int)]))

    known = corners.sparkSession.createDataFrame([(k, m.numerator, m.denominator) for k, m in enumerate(directions)], "k bigint, p bigint, q bigint")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    height = whole("s") * whole("q") - whole("w") * whole("p")
    lowest = corners.mapInPandas(touching, "at bigint, w bigint, s bigint, k bigint").join(known, "k").groupBy("k").agg(F.min(F.struct(height.alias("h"), "at")).alias("c"))
    ends = np.array([r["at"] for r in lowest.select("k", "c.at").orderBy("k").collect()], np.int64)
    lows, highs = np.append(-np.inf, slopes) - SLACK, np.append(slopes, np.inf) + SLACK

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start, stop = np.searchsorted(ends, b["at"]), np.searchsorted(ends, b["at"], "right")
            each = b.loc[b.index.repeat(stop - start + 1)]
            part = np.concatenate([np.arange(i, j + 1) for i, j in zip(start, stop)] or [np.zeros(0, int)])
            corner = np.repeat(stop > start, stop - start + 1)  # a corner closes one part and opens the next
            matters = corner | ((each["low"].to_numpy() <= highs[part]) & (each["high"].to_numpy() >= lows[part]))
            yield each.assign(part=part)[matters]

    return corners.mapInPandas(placed, f"{CORNER}, part bigint")


class Isotonic:
    """A non-decreasing curve over one score: means of pooled scores, lines between them, constant beyond the fitted range.

    ``steps`` holds one row per pooled range: scores from ``lo`` to ``hi``, its ``value``, and where the next one begins. Labels are 0 or 1;
    rows with a null label, or without a score that is a number, have no say. Without any other row there are no steps, and the result is null.
    """

    def __init__(self, df: DataFrame, score: str = "score", label: str = "y", chunk: int = CHUNK, points: int = HULL_POINTS):
        x, y = F.nanvl(F.col(score).cast("double"), F.lit(None)), F.col(label).cast("bigint")
        # -0.0 and 0.0 are one score.
        rows = df.select((x + F.lit(0.0)).alias("x"), y.alias("y")).where("x is not null and y is not null")
        line = timeline(rows.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("p")), ["x"], unique=True)
        sums = running_totals(line, {"w": F.col("n"), "s": F.col("p")}).select(F.col("idx").alias("at"), "x", "w", "s")
        origin = df.sparkSession.createDataFrame([(-1, None, 0, 0)], POINT)
        chunked = sums.unionByName(origin).groupBy(F.expr(f"greatest(at, 0) div {int(chunk)}").alias("chunk"))
        corners = materialize(chunked.applyInPandas(_chunk_corners, CORNER), "corners")
        count = corners.count()
        parts = _cut(corners, count, points) if count > points else corners.withColumn("part", F.lit(0))
        blocks = materialize(parts.groupBy("part").applyInPandas(_blocks, BLOCK), "blocks")
        lows = line.df.select(F.col("idx").alias("first"), F.col("x").alias("lo"))
        made = materialize(blocks.join(lows, "first"), "blocks")
        following = made.select((F.col("first") - 1).alias("last"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
        self.steps = materialize(made.join(following, "last", "left").select("lo", "hi", "value", "next_lo", "next_value"), "steps")
        self.count = self.steps.count()

    def transform(self, df: DataFrame, score: str = "score", name: str = "calibrated", steps: int = STEPS) -> DataFrame:
        """``df`` with the curve's value; null without a score that is a number, or without steps."""
        if not self.count:
            return df.withColumn(name, F.lit(None).cast("double"))
        return self._looked_up(df, score, name) if self.count <= steps else self._merged(df, score, name)

    def _looked_up(self, df: DataFrame, score: str, name: str) -> DataFrame:
        known = self.steps.select("lo", "hi", "value").orderBy("lo").toPandas()
        knots, values = known[["lo", "hi"]].to_numpy().ravel(), np.repeat(known["value"].to_numpy(), 2)

        @pandas_udf("double")
        def curve(x: pd.Series) -> pd.Series:
            # Infinite scores take the curve's ends.
            at = x.clip(knots[0], knots[-1])
            return pd.Series(np.where(x.isna(), None, np.interp(at.fillna(0.0), knots, values)), dtype="Float64")

        return df.withColumn(name, curve(F.col(score).cast("double")))

    def _merged(self, df: DataFrame, score: str, name: str) -> DataFrame:
        """Rows and steps sorted together; each row sees the last step that begins at or before it."""
        lowest = self.steps.agg(F.min("value")).first()[0]
        rows = df.select(F.struct("*").alias("row"), F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("x"))
        steps = self.steps.select(F.col("lo").alias("x"), F.struct("hi", "value", "next_lo", "next_value").alias("step"))
        line = timeline(rows.unionByName(steps, allowMissingColumns=True), ["x", F.col("step").isNull()])
        filled = fill(line, ["step"], "causal").where("row is not null")
        x, step = F.col("x"), F.col("step")
        share = (x - step["hi"]) / (step["next_lo"] - step["hi"])
        between = step["value"] + (step["next_value"] - step["value"]) * share
        value = F.when(x.isNull(), None).when(step.isNull(), lowest).when((x <= step["hi"]) | step["next_lo"].isNull(), step["value"]).otherwise(between)
        return filled.select("row", value.alias("value")).select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], F.col("value").alias(name))
