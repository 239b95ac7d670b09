"""Results kept per run: ``<root>/<table>/tag=<tag>/run_id=<id>``, visible once the run is committed."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which run's scores are shown first.
SOURCE_PRIORITY = ["timecv_tune_gb", "timecv_models", "train", "eval"]
INCIDENT_PRIORITY = ["eval", "train"]

MANIFEST = "manifest"


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


class Runs:
    """Run results below one folder. Partition values keep runs apart, and readers prune by them.

    A run counts once :meth:`commit` has written its manifest, which lists its tables with their rows. Readers go by manifests, so
    they see a run whole or not at all; what a failed run left behind is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _target(self, table: str, tag: str, run_id: str) -> str:
        return f"{self.path(table)}/tag={tag}/run_id={run_id}"

    def save(self, df: DataFrame, table: str, tag: str, run_id: str, fmt: str = "parquet") -> str:
        """Write one table of one run; a run's table is never overwritten."""
        if table == MANIFEST:
            raise ValueError(f"{MANIFEST} is written by commit")
        target = self._target(table, tag, run_id)
        writer = df.write.mode("errorifexists")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(target)
        return target

    def _read(self, table: str, tag: str, run_id: str, fmt: str) -> DataFrame:
        reader = self.spark.read.option("header", True) if fmt == "csv" else self.spark.read
        rows = reader.format(fmt).load(self._target(table, tag, run_id))
        return rows.withColumns({"tag": F.lit(tag), "run_id": F.lit(run_id)})

    def commit(self, tag: str, run_id: str, tables: Mapping[str, str]) -> None:
        """Make a run visible: its ``tables`` (name to format) with their rows, in one file written last."""
        listed = [(name, fmt, self._read(name, tag, run_id, fmt).count()) for name, fmt in tables.items()]
        made = self.spark.createDataFrame(listed, "table_name string, format string, n_rows bigint").coalesce(1)
        made.write.mode("errorifexists").parquet(self._target(MANIFEST, tag, run_id))

    def committed(self) -> DataFrame | None:
        """``tag, run_id, table_name, format, n_rows`` of the tables of all committed runs."""
        try:
            # Run ids start with a date and must stay text.
            kinds = "table_name string, format string, n_rows bigint, tag string, run_id string"
            return self.spark.read.schema(kinds).parquet(self.path(MANIFEST)).select("tag", "run_id", "table_name", "format", "n_rows")
        except AnalysisException:
            return None

    def table(self, table: str, tag: str, run_id: str) -> DataFrame | None:
        """A table of a committed run, with ``tag`` and ``run_id``; raises ``ValueError`` if rows are missing."""
        listed = self.committed()
        entry = None if listed is None else listed.where((F.col("tag") == tag) & (F.col("run_id") == run_id) & (F.col("table_name") == table)).first()
        if entry is None:
            return None
        rows = self._read(table, tag, run_id, entry["format"])
        if rows.count() != entry["n_rows"]:
            raise ValueError(f"{table} of run {run_id} has lost rows")
        return rows

    def latest(self, table: str, tag: str) -> DataFrame | None:
        """``table`` of the last committed run of ``tag``; none if that run has no such table."""
        listed = self.committed()
        newest = None if listed is None else listed.where(F.col("tag") == tag).agg(F.max("run_id")).first()[0]
        return None if newest is None else self.table(table, tag, newest)


def latest_runs(runs: DataFrame) -> DataFrame:
    """``tag, run_id``: the last run of each tag (ids sort by time)."""
    return runs.groupBy("tag").agg(F.max("run_id").alias("run_id"))


def incident_run(runs: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """The latest run of the first tag in ``priority`` that has a run at all, with scores or without: ``tag, run_id``."""
    order = F.array(*[F.lit(t) for t in (priority or INCIDENT_PRIORITY)])
    placed = latest_runs(runs).withColumn("place", F.array_position(order, F.col("tag"))).where("place > 0")
    return placed.orderBy("place").limit(1).select("tag", "run_id")


def resolve_source(runs: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """The latest run of the first tag in ``priority`` that has scores: ``tag, run_id``.

    ``runs`` has one row per run with ``tag, run_id, has_scores``. Only a tag's last run counts.
    """
    order = F.array(*[F.lit(t) for t in (priority or SOURCE_PRIORITY)])
    last = runs.groupBy("tag").agg(F.max_by(F.struct("run_id", "has_scores"), F.col("run_id")).alias("r"))
    usable = last.where("r.has_scores").withColumn("place", F.array_position(order, F.col("tag"))).where("place > 0")
    return usable.agg(F.min_by(F.struct("tag", "r.run_id"), "place").alias("s")).select("s.tag", "s.run_id")
