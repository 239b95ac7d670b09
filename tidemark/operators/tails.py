"""The newest rows of every series, without sorting the others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import numbers
from tidemark.operators.order import _hashable

#: Rows a task holds before it drops the old ones.
HELD = 65_536


def newest(table: pa.Table, keys: Sequence[str], order: Sequence[str], kpis: Sequence[str], rows: int) -> pa.Table:
    """The last ``rows`` of each series, and of those before them the last with a value of each KPI."""
    at = pc.sort_indices(table.select(order), [(c, "ascending") for c in order], null_placement="at_start").to_numpy()
    series = table.select(keys).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(at), int)
    own = pd.Series(series[at])
    old = (own.groupby(own).cumcount(ascending=False) >= rows).to_numpy()
    keep = ~old
    for c in kpis:
        known = np.flatnonzero(old & table.column(c).is_valid().to_numpy()[at])
        keep[known[~own.iloc[known].duplicated(keep="last").to_numpy()]] = True
    return table.take(pa.array(np.sort(at[keep])))


def last_rows(df: DataFrame, order: Sequence[str], kpis: Sequence[str], rows: int, keys: Sequence[str] = (), columns: Sequence[str] = (),
              held: int = HELD) -> DataFrame:
    """At least the last ``rows`` rows of each series, and older ones from which ``kpis`` are filled forward.

    ``order`` is made unique by ``__tie``, a hash of the whole row. KPIs become numbers; other ``columns`` come along. Tasks drop what a
    later row of the series makes needless, before and after rows meet by series: a series of any length sends a few
    rows a task. Which more rows are kept depends on partitions, and has no effect on the last rows or their filled values.
    """
    names = list(dict.fromkeys([*keys, *order, *kpis, *columns]))
    small = numbers(df.withColumn("__tie", F.xxhash64(*[_hashable(f) for f in df.schema.fields])), list(kpis)).select(*names, "__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            state.append(batch)
            count += batch.num_rows
            if count > held:
                kept = newest(pa.Table.from_batches(state), keys, [*order, "__tie"], kpis, rows)
                if kept.num_rows > held // 2:  # many series: leave them to the task that meets the rest
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                state, count = kept.to_batches(), kept.num_rows
        if count:
            yield from newest(pa.Table.from_batches(state), keys, [*order, "__tie"], kpis, rows).to_batches()

    first = small.mapInArrow(run, small.schema)
    return first.repartition(*keys).mapInArrow(run, small.schema) if keys else first
