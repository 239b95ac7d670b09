"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tidemark-")
    return _local_dir


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside when the block ends; results must be written or collected before."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _made[start:]


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as parquet to shared storage and read it back.

    Cuts the lineage, survives the loss of executors, and later reads still prune columns
    and push filters down.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
