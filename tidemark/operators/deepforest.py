"""Random forests of deep classification trees, each grown whole in one task.

Every task holds the bins of all training rows, one byte a value, and grows trees of its own from them: a tree draws as many rows as there are, with
replacement, and each node looks at as many columns as the square root of their number. A level of a tree takes a few sorts of its
open rows, or counts by (node, bin) while the nodes are few; closed nodes cost nothing. Rows are put in order by what they hold, so
partitions and reruns give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators import histboost as hb

#: Trees deeper than this are grown here, others by MLlib, which keeps the sums of all open nodes.
DEEP = 12
BINS = 255
LEAF = 255
SETTINGS = {"numTrees", "maxDepth", "minInstancesPerNode", "seed"}
MODEL = "tree int, feature binary, cut binary, child binary, value binary, gains binary"
KINDS = {"feature": np.uint8, "cut": np.uint8, "child": np.int32, "value": np.float32, "gains": np.float64}


def deep(params: dict) -> bool:
    return params.get("maxDepth", 5) > DEEP and set(params) <= SETTINGS


def _purity(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Weight of a node times the sum of its squared shares; 0 for none."""
    total = pos + neg
    return np.divide(pos * pos + neg * neg, total, out=np.zeros_like(total), where=total > 0)


def _best(key: np.ndarray, nodes: int, pos: np.ndarray, neg: np.ndarray, all_pos: np.ndarray, all_neg: np.ndarray, weights: Sequence[float],
          least: int, dense: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cut of the best split of each node by one column; ``key`` is node * 256 + bin, ``pos`` and ``neg`` are drawn rows. Ties: the lowest cut."""
    if dense if dense is not None else nodes * 256 <= 2 * len(key):
        left_pos = np.cumsum(np.bincount(key, pos, nodes * 256).reshape(nodes, 256), axis=1)
        left_neg = np.cumsum(np.bincount(key, neg, nodes * 256).reshape(nodes, 256), axis=1)
        gain = _gain(left_pos, left_neg, all_pos[:, None], all_neg[:, None], weights, least)
        cut = gain.argmax(axis=1)
        return gain[np.arange(nodes), cut], cut
    order = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    place, key = (order & np.uint64(0xFFFFFFFF)).astype(np.int64), (order >> np.uint64(32)).astype(np.int64)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    node, cut = key[ends] >> 8, key[ends] & 255
    first = np.searchsorted(node, np.arange(nodes))
    earlier = lambda every: (np.cumsum(every) - every)[node]
    left_pos, left_neg = np.cumsum(pos[place])[ends] - earlier(all_pos), np.cumsum(neg[place])[ends] - earlier(all_neg)
    gain = _gain(left_pos, left_neg, all_pos[node], all_neg[node], weights, least)
    most = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == most[node])
    return most, cut[hit[np.searchsorted(node[hit], np.arange(nodes))]]


def _gain(left_pos: np.ndarray, left_neg: np.ndarray, all_pos: np.ndarray, all_neg: np.ndarray, weights: Sequence[float], least: int) -> np.ndarray:
    w0, w1 = weights
    right_pos, right_neg = all_pos - left_pos, all_neg - left_neg
    gain = _purity(left_pos * w1, left_neg * w0) + _purity(right_pos * w1, right_neg * w0) - _purity(all_pos * w1, all_neg * w0)
    return np.where((left_pos + left_neg >= least) & (right_pos + right_neg >= least), gain, -np.inf)


def grow(bins: np.ndarray, y: np.ndarray, times: np.ndarray, weights: Sequence[float], depth: int, least: int, rng: np.random.Generator,
         dense: bool | None = None) -> dict[str, np.ndarray]:
    """One tree from ``bins`` (columns, rows) and how often each row was drawn: per node its column (``LEAF`` for none), cut, left child and share of label 1.

    Nodes are numbered level by level; the right child follows the left one.
    """
    columns, n = bins.shape
    flat, tries = bins.reshape(-1), math.ceil(math.sqrt(columns))
    own = np.flatnonzero(times)
    size = np.array([len(own)])
    pos, neg = (times * y).astype(float), (times * (1 - y)).astype(float)
    levels: list[tuple[np.ndarray, ...]] = []
    gains, below = np.zeros(columns), 1
    for level in range(depth + 1):
        start = np.cumsum(size) - size
        all_pos, all_neg = np.add.reduceat(pos[own], start), np.add.reduceat(neg[own], start)
        value = all_pos * weights[1] / (all_pos * weights[1] + all_neg * weights[0])
        feature, cut, child = np.full(len(size), LEAF, np.uint8), np.zeros(len(size), np.uint8), np.zeros(len(size), np.int32)
        levels.append((feature, cut, child, value))
        mixed = (all_pos > 0) & (all_neg > 0) & (all_pos + all_neg >= 2 * least)
        if level == depth or not mixed.any():
            break
        opened, own = np.flatnonzero(mixed), own[np.repeat(mixed, size)]
        size, all_pos, all_neg = size[opened], all_pos[opened], all_neg[opened]
        node = np.repeat(np.arange(len(opened)), size)
        own_pos, own_neg = pos[own], neg[own]
        chosen = rng.random((len(opened), columns)).argsort(axis=1)[:, :tries]
        best, best_cut, best_column = np.full(len(opened), -np.inf), np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64)
        for j in range(tries):
            key = node * 256 + flat.take((chosen[:, j] * n)[node] + own)
            gain, at = _best(key, len(opened), own_pos, own_neg, all_pos, all_neg, weights, least, dense)
            better = gain > best
            best, best_cut, best_column = np.where(better, gain, best), np.where(better, at, best_cut), np.where(better, chosen[:, j], best_column)
        split = best > 1e-12 * (all_pos * weights[1] + all_neg * weights[0])
        if not split.any():
            break
        gains += np.bincount(best_column[split], best[split], columns)
        where = opened[split]
        feature[where], cut[where] = best_column[split], best_cut[split]
        child[where] = below + 2 * np.arange(len(where))
        below += 2 * len(where)
        # Rows of a split node: those of the left child first, in their order.
        keep = split[node]
        own, node = own[keep], (np.cumsum(split) - 1)[node[keep]]
        size = size[split]
        left = flat.take((best_column[split] * n)[node] + own) <= best_cut[split][node]
        start = np.cumsum(size) - size
        lefts = np.add.reduceat(left.astype(np.int64), start)
        rank = np.cumsum(left) - left - (np.cumsum(lefts) - lefts)[node]
        to = np.where(left, start[node] + rank, lefts[node] + np.arange(len(own)) - rank)
        moved = np.empty_like(own)
        moved[to] = own
        own, size = moved, np.stack([lefts, size - lefts], axis=1).reshape(-1)
    made = {k: np.concatenate([x[i] for x in levels]).astype(KINDS[k]) for i, k in enumerate(("feature", "cut", "child", "value"))}
    return made | {"gains": gains / gains.sum() if gains.any() else gains}


def shares(bins: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Share of label 1 in the leaves that rows of ``bins`` (columns, rows) end in."""
    flat, n = bins.reshape(-1), bins.shape[1]
    node, live = np.zeros(n, np.int64), np.arange(n)
    while len(live):
        at = node[live]
        column = tree["feature"][at]
        inner = column != LEAF
        live, at, column = live[inner], at[inner], column[inner]
        node[live] = tree["child"][at] + (flat.take(column.astype(np.int64) * n + live) > tree["cut"][at])
    return tree["value"][node].astype(float)


@dataclass
class DeepForest:
    cuts: list[np.ndarray]
    trees: list[dict[str, np.ndarray]]

    @classmethod
    def fit(cls, rows: DataFrame, label: str, numTrees: int, maxDepth: int, minInstancesPerNode: int = 1, seed: int = 42, weight: str | None = None) -> DeepForest:
        """Trees of ``rows`` (``features``, a 0/1 ``label`` and, if named, a ``weight`` that depends on the label only). Raises ``ValueError`` on other labels."""
        of_class = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("double")).agg(F.max(weight) if weight else F.lit(1.0)).collect()}
        if not of_class or not set(of_class) <= {0.0, 1.0}:
            raise ValueError(f"labels are 0 or 1, not null: {list(of_class)}")
        weights = (float(of_class.get(0.0, 1.0)), float(of_class.get(1.0, 1.0)))
        width = rows.select(F.size("features")).first()[0]
        cuts = hb.column_cuts(rows, width, BINS)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = hb.as_bins(hb._matrix(batch.column(0), width), cuts)
                    y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                    yield pa.RecordBatch.from_pylist([{"held": np.column_stack([bins, y]).tobytes()}], pa.schema([("held", pa.binary())]))

        held = [np.frombuffer(r["held"], np.uint8).reshape(-1, width + 1) for r in rows.select("features", F.col(label).cast("int")).mapInArrow(blocks, "held binary").collect()]
        every = np.ascontiguousarray(np.concatenate(held))
        every = every[np.argsort(every.view(f"V{width + 1}").reshape(-1), kind="stable")]
        bins, y = np.ascontiguousarray(every[:, :width].T), every[:, width].astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    rng = np.random.default_rng([seed, i])
                    times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
                    tree = grow(bins, y, times, weights, maxDepth, minInstancesPerNode, rng)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([tree[k].tobytes()], pa.binary()) for k in KINDS]], names=["tree", *KINDS])

        parts = min(numTrees, 8 * rows.sparkSession.sparkContext.defaultParallelism)
        return cls(cuts, cls._read(rows.sparkSession.range(0, numTrees, 1, parts).mapInArrow(run, MODEL)))

    @staticmethod
    def _read(table: DataFrame) -> list[dict[str, np.ndarray]]:
        return [{k: np.frombuffer(r[k], kind) for k, kind in KINDS.items()} for r in sorted(table.collect(), key=lambda r: r["tree"])]

    def score(self) -> Column:
        """Mean share of label 1 over the trees; needs ``features``."""
        cuts, trees = self.cuts, [{k: t[k] for k in ("feature", "cut", "child", "value")} for t in self.trees]

        @pandas_udf("double")
        def run(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            bins = np.ascontiguousarray(hb.as_bins(np.stack(features.to_numpy()).astype(float), cuts).T)
            total = np.zeros(bins.shape[1])
            for tree in trees:
                total += shares(bins, tree)
            return pd.Series(total / len(trees))

        return run("features")

    def importances(self) -> np.ndarray:
        """Shares of the trees' falls in impurity."""
        total = np.mean([t["gains"] for t in self.trees], axis=0)
        return total / total.sum() if total.any() else total

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *[t[k].tobytes() for k in KINDS]) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, MODEL).write.parquet(f"{path}/trees")
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.cuts)], "column int, cuts array<double>").write.parquet(f"{path}/cuts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DeepForest:
        cuts = [np.array(r["cuts"], float) for r in spark.read.parquet(f"{path}/cuts").orderBy("column").collect()]
        return cls(cuts, cls._read(spark.read.parquet(f"{path}/trees")))
