"""Steps shared by the entry points."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import drop_incomplete, drop_leaks, feature_columns, parse_time, require
from tidemark.operators import metrics, thresholds
from tidemark.operators.features import add_features
from tidemark.operators.models import Scorer
from tidemark.operators.order import Timeline, reindex, timeline
from tidemark.operators.splits import Fold
from tidemark.session import materialize
from tidemark.sources.runs import Runs, new_run_id

PARALLEL_FITS = 4


@dataclass
class Result:
    """Tables and models an entry point returns; unused parts stay None or empty."""

    scores: DataFrame | None = None
    metrics: DataFrame | None = None
    incidents: DataFrame | None = None
    scorer: Scorer | None = None
    threshold: float | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)


def publish(runs: Runs, tag: str, result: Result, run_id: str | None = None) -> str:
    """Save a result's tables, notes and model as one run, and commit it last; the run's id."""
    run_id = run_id or new_run_id()
    parts = {"scores": result.scores, "metrics": result.metrics, "incidents": result.incidents, **result.tables}
    notes = {**result.notes, "threshold": result.threshold}
    parts["notes"] = runs.spark.createDataFrame([(json.dumps(notes, default=str),)], "notes string")
    saved = {name: "parquet" for name, df in parts.items() if df is not None}
    for name in saved:
        runs.save(parts[name], name, tag, run_id)
    if result.scorer is not None:
        result.scorer.save(runs.spark, f"{runs.path('model')}/tag={tag}/run_id={run_id}")
    runs.commit(tag, run_id, saved)
    return run_id


def saved_as(tag: str) -> Callable[[Callable[..., Result]], Callable[..., Result]]:
    """Give an entry point the argument ``runs``: where its result is saved under ``tag``, with the id in ``notes["run_id"]``."""
    def wrap(plan: Callable[..., Result]) -> Callable[..., Result]:
        @functools.wraps(plan)
        def run(*args, runs: Runs | None = None, **kwargs) -> Result:
            result = plan(*args, **kwargs)
            if runs is not None:
                result.notes["run_id"] = publish(runs, tag, result)
            return result

        return run

    return wrap


@dataclass
class Prepared:
    """A featured series: dense ``idx``, features stored once, feature names."""

    line: Timeline
    feature_cols: list[str]
    label: str | None
    ts: str

    @property
    def df(self) -> DataFrame:
        return self.line.df

    @property
    def n(self) -> int:
        return self.line.n

    def slice(self, start: int, stop: int) -> DataFrame:
        return self.df.where((F.col("idx") >= start) & (F.col("idx") < stop))


def prepare(
    df: DataFrame,
    kpis: Sequence[str],
    family: str,
    label: str | None = "anomaly",
    ts: str = "timestamp",
    tie: Sequence[str] = (),
    feature_cols: Sequence[str] | None = None,
    complete: bool = False,
    fill: str | None = "default",
) -> Prepared:
    """Order, clean and feature a KPI table.

    ``tie`` names columns that make the time order unique. ``complete`` drops rows with any null
    and numbers the rest anew. Without ``feature_cols`` every numeric column that is no label,
    time, leak or target column is a feature.
    """
    require(df, [ts, *kpis, *([label] if label else [])])
    line = timeline(parse_time(drop_leaks(df) if complete else df, ts), [ts, *tie])
    made = add_features(line, kpis, family, fill)
    line = reindex(made, drop_incomplete(made.df)) if complete else made.with_df(materialize(made.df, "features"))
    names = list(feature_cols) if feature_cols else feature_columns(line.df, label or "", ts, tuple(tie))
    return Prepared(line, names, label, ts)


def in_parallel(tasks: Sequence[Callable[[], object]], workers: int = PARALLEL_FITS) -> list[object]:
    """Submit Spark jobs from a few driver threads; results in order."""
    if workers <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        return list(pool.map(lambda t: t(), [wrap(t) for t in tasks]))


def score_fold(data: Prepared, fold: Fold, fit_on: Callable[[DataFrame], Scorer]) -> tuple[Scorer, DataFrame]:
    """Fit on the fold's training rows; validation and test rows as ``fold, role, idx, y, score``."""
    model = fit_on(data.slice(0, fold.train_end))
    held = data.slice(fold.train_end, fold.test_end)
    role = F.when(F.col("idx") < fold.val_end, "val").otherwise("test")
    scored = model.transform(held, "score").select(
        F.lit(fold.fold).alias("fold"), role.alias("role"), "idx", F.col(data.label).cast("int").alias("y"), "score"
    )
    return model, scored


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


METRICS = ["precision", "recall", "f1", "f2", "pr_auc", "alert_rate"]


def fold_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: the best-F2 threshold on validation rows and the metrics on test rows.

    Adds ``val_f2`` and, from the same thresholds, ``val_recall``.
    """
    val = metrics.curve(scored.where("role = 'val'"), keys=keys)
    best = materialize(thresholds.best_f2(val, keys), "thresholds")
    test = metrics.metric_bundle(scored.where("role = 'test'"), best.withColumn("thr", F.col("threshold")), keys=keys)
    chosen = best.select(*keys, F.col("f2").alias("val_f2"), F.col("recall").alias("val_recall"))
    return materialize(metrics.match_keys(test, chosen, keys), "fold-metrics")


def choose(select_on: str) -> tuple[str, str]:
    """Columns that decide between models: validation by default, test for parity."""
    if select_on not in ("val", "test"):
        raise ValueError("select_on is 'val' or 'test'")
    return ("val_f2", "val_recall") if select_on == "val" else ("f2", "recall")
