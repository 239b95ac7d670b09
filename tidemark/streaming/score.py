"""Scoring a stream of KPI rows, and incidents from a stream of alerts.

Each micro-batch runs the batch operators on its rows together with the last few rows of their series. Those are kept by
series in the state store: a batch reads and writes the state of its own series only, idle series cost nothing, and the
checkpoint of the query holds the state, so a restart goes on where it ended. Without series the last few rows of the stream are one small
table a batch. Batch ids make reruns overwrite themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappush, heappushpop

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.clean import numbers, parse_time, require
from tidemark.functions.explain import contributions
from tidemark.operators.features import FAMILIES, add_features
from tidemark.operators.order import timeline
from tidemark.streaming.incidents import PROVIDER, STORE, interval_ms

Score = Callable[[DataFrame], DataFrame]


class LastRows(StatefulProcessor):
    """Sends the rows of a series on, behind the last rows that earlier batches brought, and keeps the last ones for later batches.

    Rows pass one by one, so a task holds ``lookback`` rows of a series, however many of them a batch brings. A row that comes before the newest one of
    earlier batches is late: it is marked and not kept. Rows without a place in time are no rows of a series and must be removed before.
    """

    def __init__(self, names: list[str], keys: list[str], order: list[str], kept: T.StructType, lookback: int, ttl_ms: int | None):
        self.names, self.keys, self.order = names, keys, order
        self.kept, self.lookback, self.ttl_ms = kept, lookback, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.kept, self.ttl_ms)
        self.make = Row(*self.names, "is_new", "is_late")

    def place(self, row: dict) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)  # nulls first

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = dict(zip(self.keys, key, strict=True))
        held = [dict(zip(self.kept.names, r, strict=True)) for r in self.rows.get()] if self.rows.exists() else []
        last: list[tuple] = []
        for n, row in enumerate(held):
            heappush(last, (self.place(row), n - len(held), row))
            yield self.make(*(own[c] if c in own else row.get(c) for c in self.names), False, False)
        newest = max((x[0] for x in last), default=None)
        for n, given in enumerate(rows):
            row = given.asDict(recursive=False)
            place = self.place(row)
            late = newest is not None and place < newest
            if not late:
                entry = (place, n, {c: row[c] for c in self.kept.names})
                heappush(last, entry) if len(last) < self.lookback else heappushpop(last, entry)
            yield self.make(*(own[c] if c in own else row[c] for c in self.names), True, late)
        self.rows.put([tuple(x[2][c] for c in self.kept.names) for x in sorted(last, key=lambda x: x[:2])])

    def close(self) -> None:
        pass


#: Times travel through Python as microseconds, so that no time zone has a say.
_TO_MICROS = {
    T.TimestampType(): F.unix_micros,
    T.TimestampNTZType(): lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c),
}
_FROM_MICROS = {
    T.TimestampType(): F.timestamp_micros,
    T.TimestampNTZType(): lambda c: F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01").cast("timestamp_ntz")),
}


def with_last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], lookback: int, keep: str | None = None) -> DataFrame:
    """The rows of a stream with ``__new`` and ``__late``, and before them the last ``lookback`` rows of their series (``__new`` false).

    Those hold ``keys``, ``order`` and ``values`` only, other columns are null. ``keep`` is an interval after which the state of a series
    that gets no rows is dropped; by default it stays.
    """
    fields = rows.schema.fields
    short = {f.name: f"c{i}" for i, f in enumerate(fields)}  # state and Python rows want plain names
    through: dict[str, Callable[[Column], Column]] = {f.name: _TO_MICROS.get(f.dataType, lambda c: c) for f in fields}
    back: dict[str, Callable[[Column], Column]] = {f.name: _FROM_MICROS.get(f.dataType, lambda c: c) for f in fields}
    plain = rows.select(*[through[c](F.col(f"`{c}`")).alias(n) for c, n in short.items()])
    kept = T.StructType([T.StructField(short[c], plain.schema[short[c]].dataType) for c in dict.fromkeys([*order, *values])])
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in plain.schema], T.StructField("is_new", T.BooleanType()), T.StructField("is_late", T.BooleanType())])
    ttl = None if keep is None else interval_ms(rows.sparkSession, keep)
    processor = LastRows(list(short.values()), [short[k] for k in keys], [short[c] for c in order], kept, lookback, ttl)
    made = plain.groupBy(*[short[k] for k in keys]).transformWithState(processor, out, "Append", "None" if ttl is None else "ProcessingTime")
    return made.select(*[back[c](F.col(n)).alias(c) for c, n in short.items()], F.col("is_new").alias("__new"), F.col("is_late").alias("__late"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _with_last_of_stream(batch: DataFrame, batch_id: int, path: str, order: Sequence[str]) -> DataFrame:
    """``batch`` and the last rows of the stream, as ``with_last_rows`` gives them, where there are no series."""
    fresh = batch.withColumn("__new", F.lit(True))
    every = _read(batch.sparkSession, path)
    before = None if every is None else every.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
    if before is None:
        return fresh.withColumn("__late", F.lit(False))
    held = every.where(F.col("batch") == before).drop("batch")
    newest = held.select(F.max(F.struct(*order))).scalar()
    late = F.coalesce(F.struct(*order) < newest, F.lit(False))
    return fresh.withColumn("__late", late).unionByName(held.withColumns({"__new": F.lit(False), "__late": F.lit(False)}), allowMissingColumns=True)


def score_batch(batch: DataFrame, batch_id: int, path: str, score: Score, kpis: Sequence[str], keys: Sequence[str],
                ts: str, tie: Sequence[str], family: str = "A") -> None:
    """Feature and score one micro-batch: rows of ``with_last_rows``, or of a stream without series.

    Writes ``<path>/scores`` (new rows) and ``<path>/late`` (rows older than their series' last one, which get no
    score), without series also ``<path>/state``. ``<path>/work`` holds the rows of the latest batch.
    """
    spark = batch.sparkSession
    order = [ts, *tie]
    part = f"batch={batch_id}"
    rows = batch if keys else _with_last_of_stream(batch, batch_id, f"{path}/state", order)
    schema = rows.schema
    rows.write.mode("overwrite").parquet(f"{path}/work")  # the state is read and written once
    rows = spark.read.schema(schema).parquet(f"{path}/work")
    rows.where("__late").drop("__late", "__new").write.mode("overwrite").parquet(f"{path}/late/{part}")
    line = timeline(rows.where("not __late").drop("__late"), order, keys=keys)
    made = add_features(line, kpis, family, "causal").df
    explained = contributions(made, kpis) if family == "A" else made
    new = explained.where("__new").drop("__new", "idx")
    score(new).write.mode("overwrite").parquet(f"{path}/scores/{part}")
    if not keys:
        tail = made.orderBy(F.desc("idx")).limit(FAMILIES[family][1]).select(*order, *kpis)
        tail.write.mode("overwrite").parquet(f"{path}/state/{part}")
        _remove_versions(spark, f"{path}/state", batch_id - 1)


def _remove_versions(spark: SparkSession, path: str, before: int) -> None:
    """Remove the versions of the state that no batch, rerun or not, will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for item in place.listStatus(folder) if place.exists(folder) else []:
        name = item.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < before:
            place.delete(item.getPath(), True)


def stream_score(rows: DataFrame, path: str, score: Score, kpis: Sequence[str], keys: Sequence[str] = (), ts: str = "timestamp",
                 tie: Sequence[str] = (), family: str = "A", keep: str | None = None, **trigger) -> StreamingQuery:
    """Start scoring a stream into ``path``; ``trigger`` is passed on (default ``availableNow=True``).

    ``score`` adds ``anomaly_score`` (and ``is_alert``), for instance ``Scorer.transform``. ``keep`` is an interval after which
    the last rows of a series without new ones are dropped (default: never). Rows without a readable time are dropped.
    """
    require(rows, [ts, *kpis, *keys, *tie])
    rows = numbers(parse_time(rows, ts), list(kpis))
    if keys:
        rows = with_last_rows(rows, keys, [ts, *tie], kpis, FAMILIES[family][1], keep)

    def each(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, path, score, kpis, keys, ts, tie, family)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/progress")
    # The query takes these along when it starts. State with an end would ask for batches without rows for ever.
    spark, own = rows.sparkSession, {PROVIDER: STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_incidents(rows: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes", keys: Sequence[str] = (),
                     ts: str = "timestamp", alert: str = "is_alert", score: str = "anomaly_score") -> DataFrame:
    """Alerts of a stream merged while less than ``gap`` of time lies between them.

    The gap is time here, not rows. An incident is emitted when the watermark, ``delay`` behind
    the newest alert, has passed its end; later alerts for it are dropped.
    """
    alerts = rows.where(F.col(alert)).withWatermark(ts, delay)
    session = F.session_window(ts, gap)
    # Streaming sessions need a key: without series, one that is the same for all rows.
    by = list(keys) or [F.pmod(F.hash(ts), F.lit(1)).alias("__all")]
    return alerts.groupBy(*by, session).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"), F.max(score).alias("max_score")
    ).drop("session_window", "__all")
