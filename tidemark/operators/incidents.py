"""Runs of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import require
from tidemark.operators.order import Timeline, chunk_of


def group_incidents(tl: Timeline, gap_rows: int = 0, ts: str = "timestamp", alert: str = "is_alert") -> DataFrame:
    """Merge alerts with at most ``gap_rows`` other rows between them into incidents.

    Returns ``[series,] incident_id, start_ts, end_ts, n_rows, max_score``; ids count from 0 per
    series, and ``n_rows`` counts alerts only. Each chunk first finds its own breaks; the last
    alert and the number of breaks of earlier chunks come from a table with a row per chunk, so
    an incident may span chunks and hold any share of the alerts.
    """
    require(tl.df, [ts, alert])
    keys = list(tl.keys)
    has_score = "anomaly_score" in tl.df.columns
    score = F.col("anomaly_score").cast("double") if has_score else F.lit(None).cast("double")
    alerts = tl.df.where(F.col(alert)).select(
        chunk_of(tl.chunk).alias("__chunk"), *keys, "idx", F.col(ts).alias("ts"), score.alias("score")
    )
    in_chunk = Window.partitionBy("__chunk", *keys).orderBy("idx")
    steps = Window.partitionBy(*keys).orderBy("__chunk")

    # The first alert of a chunk has no predecessor yet: its break is decided below.
    local = alerts.withColumn("prev", F.lag("idx").over(in_chunk)).withColumn(
        "run",
        F.sum((F.col("idx") - F.col("prev") > gap_rows + 1).cast("bigint")).over(
            in_chunk.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    # One row per run inside a chunk.
    runs = local.groupBy("__chunk", *keys, F.coalesce("run", F.lit(0)).alias("run")).agg(
        F.min("idx").alias("head"),
        F.max("idx").alias("tail"),
        F.min_by("ts", "idx").alias("start_ts"),
        F.max_by("ts", "idx").alias("end_ts"),
        F.count("*").alias("n_rows"),
        F.max("score").alias("max_score"),
    )
    chunks = runs.groupBy("__chunk", *keys).agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.max("run").alias("breaks")
    )
    opened = chunks.withColumn(
        "opens", (F.col("head") - F.lag("tail").over(steps) > gap_rows + 1).cast("bigint")
    )
    # Runs numbered before this chunk's first run, counting whether that run starts a new incident.
    numbered = opened.select(
        F.col("__chunk").alias("__c"),
        *[F.col(k).alias(f"__{k}") for k in keys],
        (
            F.sum(F.coalesce("opens", F.lit(0))).over(steps.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("breaks").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("base"),
    )
    same = F.col("__chunk") == F.col("__c")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        runs.join(numbered, same)
        .groupBy(*keys, (F.col("base") + F.col("run")).alias("incident_id"))
        .agg(
            F.min_by("start_ts", "head").alias("start_ts"),
            F.max_by("end_ts", "tail").alias("end_ts"),
            F.sum("n_rows").alias("n_rows"),
            F.max("max_score").alias("max_score"),
        )
    )
