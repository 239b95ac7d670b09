"""Which KPIs make a row unusual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY_STD = 1e-9


def contributions(df: DataFrame, kpis: Sequence[str], size: int = 10) -> DataFrame:
    """``contrib_<kpi>``: distance from the rolling mean in rolling standard deviations."""
    out = {}
    for c in kpis:
        std = F.col(f"{c}__roll{size}_std")
        floor = F.when(std == 0.0, F.lit(TINY_STD)).otherwise(std)
        out[f"contrib_{c}"] = F.abs((F.col(c) - F.col(f"{c}__roll{size}_mean")) / floor)
    return df.withColumns(out)


def top_contributors(kpis: Sequence[str], k: int = 3) -> Column:
    """The ``k`` largest ``contrib_<kpi>`` as array<struct<kpi,value>>; ties keep the list order."""
    entries = F.array(
        *[
            F.struct((-F.col(f"contrib_{c}")).alias("low"), F.lit(i).alias("place"), F.lit(c).alias("kpi"))
            for i, c in enumerate(kpis)
        ]
    )
    # A missing contribution sorts last.
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(
        F.coalesce(e["low"], F.lit(0.0)).alias("low"), e["place"].alias("place"), e["kpi"].alias("kpi"))))
    return F.transform(
        F.slice(ranked, 1, k), lambda e: F.struct(e["kpi"].alias("kpi"), (-e["low"]).alias("value"))
    )


def explanation(kpis: Sequence[str], k: int = 3) -> Column:
    """Text naming the ``k`` KPIs farthest from their recent level; needs family D's columns."""
    entries = []
    for i, c in enumerate(kpis):
        value, level, step = F.col(c), F.col(f"{c}__roll3_mean"), F.col(f"{c}__delta1")
        entries.append(
            F.struct(
                (-(F.abs(value - level) + F.abs(step))).alias("low"),
                F.lit(i).alias("place"),
                F.format_string(f"{c}: value=%.3f, roll3_mean=%.3f, delta1=%.3f", value, level, step).alias("text"),
            )
        )
    usable = F.filter(F.array(*entries), lambda e: e["low"].isNotNull())
    best = F.transform(F.slice(F.array_sort(usable), 1, k), lambda e: e["text"])
    return F.when(F.size(best) > 0, F.array_join(best, "; ")).otherwise(F.lit("n/a"))
