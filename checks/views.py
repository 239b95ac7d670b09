"""Test tables seen as KPI series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order import Timeline, timeline

WIDE_KPIS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_key"),
        "ts",
        "event_id",
        "value",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps and unreadable text in ``value``."""
    return events(spark, sf_dir).withColumn(
        "value",
        F.when(F.col("event_id") % 11 == 0, "bad")
        .when(F.col("event_id") % 7 == 0, F.lit(None))
        .otherwise(F.col("value").cast("string")),
    )


def events_line(spark: SparkSession, sf_dir: str) -> Timeline:
    return timeline(events(spark, sf_dir), ["ts", "event_id"])


def raw_line(spark: SparkSession, sf_dir: str) -> Timeline:
    return timeline(raw_events(spark, sf_dir), ["ts", "event_id"])


def users_line(spark: SparkSession, sf_dir: str) -> Timeline:
    return timeline(events(spark, sf_dir), ["ts", "event_id"], keys=["series_key"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *WIDE_ORDER, *WIDE_KPIS, (F.col("l_returnflag") == "R").cast("int").alias("anomaly")
    )


def wide_line(spark: SparkSession, sf_dir: str) -> Timeline:
    return timeline(wide(spark, sf_dir), WIDE_ORDER)


E_SQL = """e as (select user_id as series_key, ts, event_id, value,
  cast(event_type = 'error' as int) as label,
  row_number() over (order by ts, event_id) - 1 as idx from events)"""

# The raw view: text is read back as a number, unreadable text is null.
RAW_SQL = """r as (select user_id as series_key, ts, event_id,
  case when event_id % 11 = 0 or event_id % 7 = 0 then null else value end as value,
  cast(event_type = 'error' as int) as label,
  row_number() over (order by ts, event_id) - 1 as idx from events)"""

U_SQL = """u as (select user_id as series_key, ts, event_id, value,
  cast(event_type = 'error' as int) as label,
  row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)"""

WIDE_SQL = f"""x as (select {', '.join(WIDE_ORDER)}, {', '.join(WIDE_KPIS)},
  cast(l_returnflag = 'R' as int) as anomaly,
  row_number() over (order by {', '.join(WIDE_ORDER)}) - 1 as idx from lineitem)"""
