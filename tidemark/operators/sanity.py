"""Negative controls: permutations that must destroy a model's skill.

Orders come from a hash of the row's position and a seed, so a rerun gives the same permutation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import timeline


def shuffle_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts], F.lit(str(seed))))


def shuffle_column(df: DataFrame, col: str, seed: int = 42) -> DataFrame:
    """Hand the values of ``col`` out in hash order; ``idx`` must be dense from 0."""
    moved = timeline(df.select(F.col("idx").alias("__from"), F.col(col).alias("__v")),
                     [shuffle_key(seed, F.col("__from")), "__from"], unique=True).df
    rest = [c for c in df.columns if c != col]
    return df.select(*rest).join(moved.select("idx", F.col("__v").alias(col)), "idx").select(*df.columns)


def shuffle_blocks(df: DataFrame, cols: Sequence[str], block: int = 50, seed: int = 42, start: int = 0) -> DataFrame:
    """Shuffle the rows of ``cols`` together inside blocks of ``block`` positions; the rest stays.

    A block is one small group: its rows are laid beside its shuffled rows, with a single shuffle.
    """
    rest = [c for c in df.columns if c not in cols and c != "idx"]
    stay = F.collect_list(F.struct("idx", *rest))
    move = F.collect_list(F.struct(shuffle_key(seed, F.col("idx")).alias("k"), F.col("idx").alias("i"), F.struct(*cols).alias("v")))
    pairs = df.groupBy(F.floor((F.col("idx") - start) / block).alias("__block")).agg(
        F.arrays_zip(F.sort_array(stay).alias("a"), F.sort_array(move).alias("b")).alias("pairs")
    )
    one = pairs.select(F.explode("pairs").alias("p"))
    return one.select("p.a.*", "p.b.v.*").select(*df.columns)


def shuffle_features(df: DataFrame, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Shuffle every column of ``cols`` on its own; ``idx`` must be dense from 0.

    One ordered pass over (column, value) pairs serves all columns. Every column has as many rows, so a place in
    its order is the position in that pass less the columns before it, without a running count.
    """
    cells = df.select("idx", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["idx"], [f"`{c}`" for c in cols], "__col", "__v").withColumnRenamed("idx", "__from")
    order = [shuffle_key(seed, F.col("__from"), F.col("__col")), "__from"]
    placed = timeline(cells, order, keys=["__col"], unique=True)
    wide = placed.df.groupBy((F.col("idx") % max(1, placed.n // len(cols))).alias("idx")).agg(
        *[F.max(F.when(F.col("__col") == c, F.col("__v"))).alias(c) for c in cols]
    )
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest).join(wide, "idx").select(*df.columns)


def shift_rows(df: DataFrame, cols: Sequence[str], n: int, by: int = 1) -> DataFrame:
    """Move ``cols`` ``by`` positions on, the last ones to the front; the rest stays."""
    moved = df.select(((F.col("idx") + by) % n).alias("idx"), *cols)
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest).join(moved, "idx").select(*df.columns)
