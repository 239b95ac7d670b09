"""Incidents of a stream by row gap, with the open incident of each series in the state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.clean import require

#: The state store that keyed state processors need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Of a series: rows and late rows so far, the last row's order, and the open incident (n_rows 0: none). Incidents are numbered.
STATE = "rows bigint, late bigint, last_ts bigint, last_tie bigint, incidents bigint, start_ts bigint, end_ts bigint, n_rows bigint, max_score double, last_row bigint"
EMPTY = (0, 0, None, None, 0, None, None, 0, None, 0)


def use_state_store(spark: SparkSession) -> None:
    """Let stateful queries started from now on keep their state in RocksDB."""
    spark.conf.set(PROVIDER, STORE)


def interval_ms(spark: SparkSession, text: str) -> int:
    """Milliseconds of an interval such as ``1 hour``."""
    day = "timestamp '1970-01-02 00:00:00'"
    return int(spark.sql(f"select unix_millis({day} + interval {text}) - unix_millis({day})").first()[0])


class RowGapIncidents(StatefulProcessor):
    """Merges alerts of a series with at most ``gap_rows`` other rows between them.

    An incident is emitted by the first row past its gap, or by a timer once the watermark is ``idle_ms`` past the newest row of its
    series. Rows that come before the newest one of earlier batches are late: they take no place and are counted.
    """

    def __init__(self, keys: list[str], gap_rows: int, idle_ms: int):
        self.keys, self.gap, self.idle = keys, gap_rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, late, last_ts, last_tie, made, start, end, count, most, at = self.state.get() if self.state.exists() else EMPTY
        batch = pd.concat(rows, ignore_index=True).sort_values(["at", "tie"], kind="stable")
        out, due = [], None if last_ts is None else last_ts // 1000 + self.idle
        for ts, tie, alert, score in zip(batch["at"].tolist(), batch["tie"].tolist(), batch["alert"].tolist(), batch["score"].tolist(), strict=True):
            if last_ts is not None and (ts, tie) < (last_ts, last_tie):
                late += 1
                continue
            n, last_ts, last_tie = n + 1, ts, tie
            if count and n - at > self.gap + (1 if alert else 0):
                out.append((made, start, end, count, most, late))
                made, count, most = made + 1, 0, None
            if alert:
                start, end, at, count = ts if not count else start, ts, n, count + 1
                if score == score and score is not None:
                    most = score if most is None else max(most, score)
        if due is not None:
            self.handle.deleteTimer(due)
        if last_ts is not None:
            self.handle.registerTimer(last_ts // 1000 + self.idle)
        self.state.update((n, late, last_ts, last_tie, made, start, end, count, most, at))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, late, last_ts, last_tie, made, start, end, count, most, at = self.state.get()
        out = [(made, start, end, count, most, late)] if count else []
        # The series goes on counting rows; its next alert opens an incident.
        self.state.update((n, late, last_ts, last_tie, made + bool(count), None, None, 0, None, at))
        yield self.frame(key, out)

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["incident_id", "__start", "__end", "n_rows", "max_score", "late_rows"])
        rows["max_score"] = rows["max_score"].astype(float)
        rows["start_ts"], rows["end_ts"] = (pd.to_datetime(rows[c], unit="us") for c in ("__start", "__end"))
        for i, name in enumerate(self.keys):
            rows[name] = [key[i]] * len(rows)
        return rows[[*self.keys, "incident_id", "start_ts", "end_ts", "n_rows", "max_score", "late_rows"]]

    def close(self) -> None:
        pass


def stream_incidents_rows(rows: DataFrame, keys: Sequence[str], gap_rows: int = 0, idle: str = "1 hour", delay: str = "10 minutes", ts: str = "timestamp",
                          tie: str | None = None, alert: str = "is_alert", score: str = "anomaly_score") -> DataFrame:
    """``keys, incident_id, start_ts, end_ts, n_rows, max_score, late_rows`` of a stream: ``group_incidents`` by series.

    Alerts of a series with at most ``gap_rows`` other rows between them are one incident; rows are ordered by ``ts`` and the
    integer ``tie``. ``idle`` and ``delay`` are intervals: an incident still open is emitted once the watermark, ``delay`` behind the newest row of the
    stream, is ``idle`` past the last row of its series. ``late_rows`` counts the rows of the series that came too late so far; rows behind
    the watermark never reach the series and are counted in the query's progress. Rows with a null time have no place. A series needs a key, which may be null; a batch's rows of one series are sorted in one task. Start the
    query after ``use_state_store``.
    """
    if not keys:
        raise ValueError("name the columns that tell series apart")
    require(rows, [ts, alert, *keys])
    length = interval_ms(rows.sparkSession, idle)
    has_score = score in rows.columns
    own = rows.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    # Plain names of their own: the processor gets columns by names that begin with a letter.
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    shaped = own.select(
        *named, F.col(ts).alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("tie"),
        F.coalesce(F.col(alert), F.lit(False)).alias("alert"), (F.col(score).cast("double") if has_score else F.lit(None).cast("double")).alias("score"))
    schema = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL("incident_id bigint, start_ts timestamp, end_ts timestamp, n_rows bigint, max_score double, late_rows bigint").fields])
    return shaped.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(RowGapIncidents(list(keys), gap_rows, length), schema, "Append", "EventTime")
