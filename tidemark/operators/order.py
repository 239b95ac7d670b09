"""Row positions, windows and running totals that never need one global partition.

A table is range-partitioned and sorted once; each row's position ``idx`` is its partition's
offset plus its place in that partition. After that, a chunk of the series is plain arithmetic
on ``idx``. Windows run per chunk, with the last ``lookback`` rows of a chunk repeated at the
head of the next one; open-ended windows take what precedes the chunk from a summary table with
one row per chunk. One series may therefore hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

CHUNK = 2_048
MAX_CHUNKS = 1_000_000
RANGE_BYTES = 256 << 20  # of one sorted range, by the planner's estimate of the table
WIDENED = 8  # times the tables read that an estimate counts for at most
_PART, _PLACE, _CHUNK, _SERIES = "__part", "__place", "__chunk", "__series"
_ROW_BITS = (1 << 33) - 1  # row part of monotonically_increasing_id()


def chunk_rows(n: int, lookback: int = 0) -> int:
    """Rows per chunk: few enough for a window's in-memory buffer (4,096 rows by default), unless
    the summary table, with its one row per chunk, would pass ``MAX_CHUNKS`` rows.
    """
    return max(CHUNK, -(-n // MAX_CHUNKS), 2 * lookback + 1)


@dataclass(frozen=True)
class Timeline:
    """An ordered table: ``df`` has a dense 0-based ``idx``; rows of one series are contiguous."""

    df: DataFrame
    n: int
    chunk: int
    keys: tuple[str, ...] = ()

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    def window(self, descending: bool = False) -> WindowSpec:
        """Window over one chunk of one series; only valid on the rows given to a ``build``."""
        by = [_CHUNK, _SERIES] if self.keys else [_CHUNK]
        return Window.partitionBy(*by).orderBy(F.desc("idx") if descending else "idx")


def timeline(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    partitions: int | None = None,
    chunk: int | None = None,
    unique: bool = False,
) -> Timeline:
    """Sort ``df`` by series and ``order`` and number its rows.

    Unless ``order`` is known to be ``unique``, rows equal in it are ordered by a hash of the whole
    row: the order is the same in every run, and a crowd of rows at one time is still split.
    Without ``partitions`` the number of ranges is left to adaptive execution, which only merges them; tables
    too large for the session's number of partitions get one for every ``RANGE_BYTES``. The sorted rows are
    written once to shared storage, so positions do not change when a lost partition is recomputed.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    if not unique:
        by.append(F.xxhash64(*[_hashable(f) for f in df.schema.fields]))
    partitions = partitions or _ranges(df)
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    stored = materialize(
        ranged.sortWithinPartitions(*by)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "timeline",
    )
    sizes = {r[_PART]: r["count"] for r in stored.groupBy(_PART).count().collect()}
    offsets, n = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(n)
        n += sizes.get(part, 0)
    starts = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")
    numbered = stored.withColumn("idx", F.get(starts, F.col(_PART)) + F.col(_PLACE)).drop(_PART, _PLACE)
    return Timeline(numbered, n, chunk or chunk_rows(n), tuple(keys))


def _ranges(df: DataFrame) -> int | None:
    """Ranges for a table that the session's shuffle partitions would cut too coarsely, else none."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    # Estimates of plans with joins multiply the sizes of both sides, so what is read is the measure.
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    wanted = -(-min(int(plan.stats().sizeInBytes()), WIDENED * read) // RANGE_BYTES)
    # Beyond a petabyte, as for rows that come from no table, estimates say nothing.
    return wanted if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < wanted < (1 << 50) // RANGE_BYTES else None


def _hashable(field: T.StructField) -> Column:
    """The column, or its JSON text where it holds maps, which have no hash."""
    col = F.col(f"`{field.name}`")
    return F.to_json(F.struct(col)) if "map<" in field.dataType.simpleString() else col


def from_indexed(
    df: DataFrame, n: int | None = None, keys: Sequence[str] = (), chunk: int | None = None
) -> Timeline:
    """Use a table that already has ``idx`` (dense, series contiguous)."""
    if n is None:
        last = df.agg(F.max("idx")).first()[0]
        n = 0 if last is None else last + 1
    return Timeline(df, n, chunk or chunk_rows(n), tuple(keys))


def chunk_of(size: int) -> Column:
    return F.expr(f"idx div {int(size)}")


def windowed(
    tl: Timeline,
    lookback: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    carry: DataFrame | None = None,
) -> DataFrame:
    """Run ``build`` on chunks that start with ``lookback`` rows of the chunk before.

    ``build`` gets the repeated rows too and must keep every row; they are removed afterwards.
    ``carry`` (one row per chunk and series, from :func:`last_before` and its kin) is joined first.
    """
    if lookback >= tl.chunk:
        raise ValueError("lookback must be smaller than a chunk")
    home = chunk_of(tl.chunk)
    if lookback:
        in_tail = F.col("idx") % tl.chunk >= tl.chunk - lookback
        homes = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
        rows = tl.df.withColumn(_CHUNK, F.explode(homes))
    else:
        rows = tl.df.withColumn(_CHUNK, home)
    drop = [_CHUNK]
    if tl.keys:
        # A struct of the keys is never null, so the join and the windows agree on the partitioning.
        rows, drop = rows.withColumn(_SERIES, F.struct(*tl.keys)), [_CHUNK, _SERIES]
    if carry is not None:
        rows, more = _join_carry(rows, carry, tl.keys)
        drop += more
    done = build(rows, tl.window())
    if lookback:
        done = done.where(F.col(_CHUNK) == home)
    return done.drop(*drop)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Left join on chunk and series; a null series key matches itself."""
    on = [_CHUNK, _SERIES] if keys else [_CHUNK]
    if keys:
        carry = carry.withColumn(_SERIES, F.struct(*keys)).drop(*keys)
    return rows.join(carry, on, "left"), [c for c in carry.columns if c not in on]


def edges(tl: Timeline, cols: Sequence[str], lookback: int) -> DataFrame:
    """Per chunk and series: the nearest non-null value on either side of the rows that
    :func:`windowed` shows that chunk, and its position.

    Columns ``<col>__before, <col>__before_idx, <col>__after, <col>__after_idx``. One hash aggregate
    over the rows gives one summary row per chunk and series; the rest runs on that summary.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.col("idx")) for c in cols}
    in_tail = F.col("idx") % tl.chunk >= tl.chunk - lookback
    made = []
    for c in cols:
        # "body" leaves out the rows that the next chunk sees as its look-back.
        body = F.when(~in_tail, known[c]) if lookback else known[c]
        for name, at, pick, edge in (("all", known[c], F.max_by, F.max), ("body", body, F.max_by, F.max), ("first", known[c], F.min_by, F.min)):
            made += [pick(F.col(c), at).alias(f"{c}__{name}"), edge(at).alias(f"{c}__{name}_idx")]
    summary = tl.df.withColumn(_CHUNK, chunk_of(tl.chunk)).groupBy(_CHUNK, *tl.keys).agg(*made)
    up = Window.partitionBy(*tl.keys).orderBy(_CHUNK)
    # The mirrored order keeps the "what follows" frame linear.
    later = Window.partitionBy(*tl.keys).orderBy(F.desc(_CHUNK)).rangeBetween(Window.unboundedPreceding, -1)
    earlier, previous = up.rangeBetween(Window.unboundedPreceding, -2), up.rangeBetween(-1, -1)
    out = []
    for c in cols:
        old, old_at = F.last(f"{c}__all", True).over(earlier), F.max(f"{c}__all_idx").over(earlier)
        out += [
            F.coalesce(F.last(f"{c}__body", True).over(previous), old).alias(f"{c}__before"),
            F.coalesce(F.max(f"{c}__body_idx").over(previous), old_at).alias(f"{c}__before_idx"),
            F.last(f"{c}__first", True).over(later).alias(f"{c}__after"),
            F.min(f"{c}__first_idx").over(later).alias(f"{c}__after_idx"),
        ]
    return summary.select(_CHUNK, *tl.keys, *out)


def running_totals(tl: Timeline, totals: dict[str, Column], whole: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums along each series.

    ``whole`` maps names of ``totals`` to columns for the series' full sum. It comes from the same
    summary table, so that a large series is never joined by its key.
    """
    per_chunk = (
        tl.df.withColumn(_CHUNK, chunk_of(tl.chunk))
        .groupBy(_CHUNK, *tl.keys)
        .agg(*[F.sum(v).alias(f"{name}__sum") for name, v in totals.items()])
    )
    w = Window.partitionBy(*tl.keys)
    earlier = w.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole or {}
    carry = per_chunk.select(
        _CHUNK,
        *tl.keys,
        *[F.sum(f"{name}__sum").over(earlier).alias(f"{name}__carry") for name in totals],
        *[F.sum(f"{name}__sum").over(w).alias(f"{name}__whole") for name in whole],
    )

    def build(rows: DataFrame, frame: WindowSpec) -> DataFrame:
        so_far = frame.rowsBetween(Window.unboundedPreceding, 0)
        sums = {
            name: F.sum(v).over(so_far) + F.coalesce(F.col(f"{name}__carry"), F.lit(0))
            for name, v in totals.items()
        }
        return rows.withColumns(sums | {to: F.col(f"{name}__whole") for name, to in whole.items()})

    return windowed(tl, 0, build, carry)


def positions(tl: Timeline, name: str = "pos") -> DataFrame:
    """0-based position of each row inside its series (``idx`` itself without series)."""
    if not tl.keys:
        return tl.df.withColumn(name, F.col("idx"))
    return running_totals(tl, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)


def reindex(tl: Timeline, kept: DataFrame) -> Timeline:
    """Number the rows left of a timeline anew, in the same order, without sorting it again."""
    stored = materialize(kept, "kept")
    # Positions run over all series, so the count does too.
    dense = running_totals(Timeline(stored, tl.n, tl.chunk), {"__at": F.lit(1).cast("bigint")})
    return replace(tl, df=dense.withColumn("idx", F.col("__at") - 1).drop("__at"), n=stored.count())
