"""Streaming queries, driven to completion over the event table in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import events
from tidemark.session import new_path
from tidemark.streaming.incidents import stream_incidents_rows, use_state_store
from tidemark.streaming.score import stream_incidents, stream_score

SCHEMA = "series_key bigint, ts timestamp_ntz, event_id bigint, value double, label int"


FILES = 4


def _arrivals(spark, d, parts: int = 4) -> str:
    """The events as consecutive time spans of ``FILES`` files each, written one after the other."""
    path = new_path(spark, "arrivals")
    rows = events(spark, d)
    cuts = [None, *rows.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.01), None]
    for low, high in zip(cuts, cuts[1:]):
        span = rows
        if low is not None:
            span = span.where(F.col("event_id") >= low)
        if high is not None:
            span = span.where(F.col("event_id") < high)
        span.repartition(FILES).write.mode("append").parquet(path)
    return path


@query("stream_score", """select event_id, round(avg(value) over w, 6) as value__roll10_mean,
  round(abs((value - avg(value) over w) / case when coalesce(stddev_samp(value) over w, 0) = 0 then 1e-9 else stddev_samp(value) over w end), 4) as anomaly_score
  from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)""")
def _(spark, d):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).parquet(_arrivals(spark, d))
    out = new_path(spark, "stream")
    score = lambda df: df.withColumn("anomaly_score", F.col("contrib_value"))
    stream_score(source, out, score, ["value"], ["series_key"], "ts", ["event_id"]).awaitTermination()
    scored = spark.read.parquet(f"{out}/scores")
    return scored.select("event_id", F.round("value__roll10_mean", 6).alias("value__roll10_mean"), F.round("anomaly_score", 4).alias("anomaly_score"))


@query("stream_incidents", """with a as (select ts, value from events where value >= 100),
  s as (select *, case when ts - lag(ts) over (order by ts) < interval 2 hours then 0 else 1 end as b from a),
  g as (select *, sum(b) over (order by ts rows between unbounded preceding and current row) as id from s),
  i as (select min(ts) as start_ts, max(ts) as end_ts, count(*) as n_rows, max(value) as max_score from g group by id)
  select * from i where end_ts + interval 2 hours <= (select max(ts) - interval 10 minutes from a)""")
def _(spark, d):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).parquet(_arrivals(spark, d))
    alerts = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("anomaly_score"), (F.col("value") >= 100).alias("is_alert"))
    out = new_path(spark, "incidents")
    found = stream_incidents(alerts, "2 hours", "10 minutes", ts="ts")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n_rows", "max_score")


@query("stream_incidents_rows", """with e as (select user_id as series_key, ts, event_id, value, value >= 60 as alert, row_number() over (partition by user_id order by ts, event_id) as pos from events),
  a as (select *, pos - lag(pos) over (partition by series_key order by pos) - 1 as between_ from e where alert),
  g as (select *, sum(case when between_ <= 2 then 0 else 1 end) over (partition by series_key order by pos) - 1 as incident_id from a),
  i as (select series_key, cast(incident_id as bigint) as incident_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_rows, max(value) as max_score, max(pos) as pos from g group by all),
  l as (select user_id as series_key, count(*) as n, max(ts) as last from events group by user_id)
  select series_key, incident_id, start_ts, end_ts, n_rows, max_score, cast(0 as bigint) as late_rows from i join l using (series_key)
  where n - pos > 2 or last + interval 2 hours <= (select max(ts) - interval 10 minutes from events)""")
def _(spark, d):
    use_state_store(spark)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).parquet(_arrivals(spark, d))
    alerts = source.select("series_key", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("anomaly_score"), (F.col("value") >= 60).alias("is_alert"))
    out = new_path(spark, "incidents")
    found = stream_incidents_rows(alerts, ["series_key"], 2, "2 hours", "10 minutes", ts="ts", tie="event_id")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")]
    return spark.read.parquet(out).select("series_key", "incident_id", *ends, "n_rows", "max_score", "late_rows")
