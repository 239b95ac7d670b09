"""Boosted trees on binned columns, grown level by level from histograms.

Columns are cut once into at most 255 bins at their quantiles, with one more bin for missing values. A level of a tree needs the sums of first
and second derivatives and the number of rows by (node, column, bin), of the smaller child of each split only: its sibling is
the parent less it. Tasks sum blocks of rows, and the driver sees sums only, whose number depends on columns, bins,
nodes and tasks (of many tasks they are added up before). The rows' scores so far are kept by the executors, so that a tree is applied once. Derivatives are whole multiples of 2^-24, so sums do not depend on their order: partitions and reruns give
the same trees, and a table that fits a task is boosted there with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.session import materialize, new_path

#: Binned values that one task holds to boost a whole table.
TASK_VALUES = 1 << 22
#: Rows whose second derivatives and number add up in one double, side by side.
PACKED = 1 << 15
BLOCK = 4_096
#: Rows of the blocks that tasks keep while trees grow, and of a task at most, if there are enough cores.
KEPT = 65_536
TASK_ROWS = 1 << 21
#: Trees after which the scores of the rows are written; those in between are kept by the executors.
REWRITE = 16
#: Partitions whose sums the driver adds up by itself.
DIRECT = 32
MISSING = 255
UNIT = float(1 << 24)
LEAST_HESSIAN = 1e-3

Nodes = Sequence[int]
Source = Callable[[list["Tree"], "Tree", Nodes], np.ndarray]


class Tree:
    """Nodes by heap number: the children of i are 2i and 2i + 1, the root is 1, a leaf has feature -1."""

    def __init__(self, depth: int):
        size = 2 << depth
        self.depth = depth
        self.feature = np.full(size, -1, np.int32)
        self.cut = np.zeros(size, np.int32)
        self.threshold = np.zeros(size)
        self.missing_left = np.zeros(size, bool)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)

    def leaves(self, x: np.ndarray, missing: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The node that each row ends in; values up to a node's ``cut`` go left."""
        node, at = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            value = x[at, np.maximum(f, 0)]
            left = np.where(missing[at, np.maximum(f, 0)], self.missing_left[node], value <= cut[node])
            node = np.where(f >= 0, 2 * node + ~left, node)
        return node

    def spread(self, bins: np.ndarray, rows: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """Numbers of the rows of ``bins`` (columns, rows) by the node that they end in, as far as the tree has grown; ``rows`` gives where they are."""
        todo = list((rows if rows is not None else {1: np.arange(bins.shape[1])}).items())
        out = {}
        while todo:
            node, own = todo.pop()
            if self.feature[node] < 0:
                out[node] = own
                continue
            value = bins[self.feature[node]].take(own)
            left = value <= self.cut[node]
            if self.missing_left[node]:
                left |= value == MISSING
            todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]
        return out

    def add_to(self, raw: np.ndarray, rows: dict[int, np.ndarray]) -> None:
        """Add the values of the nodes to the scores of their rows."""
        for node, own in rows.items():
            raw[own] += self.value[node]


def derivatives(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in whole units."""
    p = 1.0 / (1.0 + np.exp(-raw))
    return np.rint(w * (p - y) * UNIT), np.rint(w * p * (1.0 - p) * UNIT)


def sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums (column, bin, [g, h, rows]) over the numbered rows of ``bins`` (columns, rows)."""
    out = np.zeros((len(bins), 256, 3), np.int64)
    for at in range(0, len(rows), PACKED):
        part = rows[at:at + PACKED]
        gs, hs = g[part], h[part]
        unit = 2.0 ** int(hs.sum()).bit_length()
        # Whole numbers below 2^53 are exact: the number of rows may stand above their second derivatives.
        packed = hs + unit if hs.min() >= 0 and unit * (len(part) + 1) <= 2.0**53 else None
        for j, column in enumerate(bins):
            place = column.take(part).astype(np.intp)
            out[j, :, 0] += np.bincount(place, gs, 256).astype(np.int64)
            if packed is None:
                out[j, :, 1] += np.bincount(place, hs, 256).astype(np.int64)
                out[j, :, 2] += np.bincount(place, minlength=256)
            else:
                both = np.bincount(place, packed, 256)
                count = np.floor(both / unit)
                out[j, :, 1] += (both - count * unit).astype(np.int64)
                out[j, :, 2] += count.astype(np.int64)
    return out


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, wanted: Nodes) -> np.ndarray:
    """Sums (node, column, bin, [g, h, rows]) over the rows of the wanted nodes; ``bins`` is (rows, columns)."""
    columns = np.ascontiguousarray(bins.T)
    return np.stack([sums(columns, g, h, np.flatnonzero(node == n)) for n in wanted])


@dataclass(frozen=True)
class Settings:
    """300 trees of depth 5, rate 0.1, 20 rows in a leaf, no penalty."""

    trees: int = 300
    depth: int = 5
    rate: float = 0.1
    least_rows: int = 20
    penalty: float = 0.0
    bins: int = 255

    def __post_init__(self):
        if self.trees < 1 or not 1 <= self.depth <= 16 or self.rate <= 0 or self.least_rows < 1 or self.penalty < 0 or not 2 <= self.bins <= 255:
            raise ValueError(f"no such boosting: {self}")

    def value(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.penalty) if h + self.penalty > 0 else 0.0


def best_split(hist: np.ndarray, s: Settings) -> tuple[float, int, int, bool, np.ndarray] | None:
    """(gain, column, cut, missing left, sums of the left side) of a node's best split; ties: first column, cut, missing right."""
    total = hist[0].sum(0)
    below = np.cumsum(hist[:, :MISSING], axis=1)
    missing = hist[:, MISSING]
    left = np.stack([below, below + missing[:, None]], axis=2)  # column, cut, missing side
    right = total - left
    scale = lambda x: (x[..., 0] / UNIT, x[..., 1] / UNIT)
    (gl, hl), (gr, hr), (g, h) = scale(left), scale(right), scale(total)
    fits = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - g**2 / (h + s.penalty), -np.inf)
    at = int(np.argmax(gain))
    column, cut, side = np.unravel_index(at, gain.shape)
    if not gain[column, cut, side] > 0:
        return None
    own = left[column, cut, side]
    # Without missing values here, later ones follow the larger side.
    to_left = bool(side) if missing[column, 2] else bool(own[2] > total[2] - own[2])
    return float(gain[column, cut, side]), int(column), int(cut), to_left, own


def divide(tree: Tree, node: int, split: tuple, total: np.ndarray, cuts: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Write a split found by :func:`best_split` into the tree; the sums of both sides."""
    gain, column, cut, to_left, left = split
    tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = column, cut, to_left, gain
    tree.threshold[node] = cuts[column][cut] if cut < len(cuts[column]) else math.inf
    right = total - left
    for child, sums in ((2 * node, left), (2 * node + 1, right)):
        tree.value[child] = s.value(sums[0] / UNIT, sums[1] / UNIT)
    return left, right


def grow(source: Source, trees: list[Tree], cuts: list[np.ndarray], s: Settings) -> tuple[Tree, float]:
    """The tree after ``trees``, and the fewest rows on a side of its splits; without a split where the rows cannot be split any more."""
    tree, fewest = Tree(s.depth), math.inf
    hists = {1: source(trees, tree, [1])[0]}
    for depth in range(s.depth):
        small, parents = [], []
        for node, hist in sorted(hists.items()):
            found = best_split(hist, s)
            if found is None:
                continue
            left, right = divide(tree, node, found, hist[0].sum(0), cuts, s)
            fewest = min(fewest, int(left[2]), int(right[2]))
            small.append(2 * node + int(right[2] < left[2]))
            parents.append(node)
        if not small or depth == s.depth - 1:
            break
        got = source(trees, tree, small)
        hists = {n: x for child, parent, own in zip(small, parents, got, strict=True) for n, x in ((child, own), (child ^ 1, hists[parent] - own))}
    return tree, fewest


def boost(source: Source, cuts: list[np.ndarray], s: Settings) -> list[Tree]:
    """Trees from histograms; ends early when the rows cannot be split any more."""
    trees: list[Tree] = []
    while len(trees) < s.trees:
        tree, _ = grow(source, trees, cuts, s)
        if tree.feature[1] < 0:
            break
        trees.append(tree)
    return trees


class InTask:
    """Histograms of rows at hand, of which ``drawn`` (by the number of the tree) tells those a tree is grown from; rows stay sorted by node while it grows."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray | float, raw: np.ndarray, drawn: Callable[[int], np.ndarray] | None = None, applied: int = 0):
        self.bins, self.y, self.w, self.raw, self.drawn, self.applied = bins, y, w, raw, drawn, applied
        self.tree: Tree | None = None
        self.rows: dict[int, np.ndarray] = {}
        self.rest: np.ndarray | None = None

    def __call__(self, trees: list[Tree], tree: Tree, wanted: Nodes) -> np.ndarray:
        if tree is not self.tree:
            self._start(trees, tree)
        self.rows = tree.spread(self.bins, self.rows)
        return np.stack([sums(self.bins, self.g, self.h, self.rows[n]) for n in wanted])

    def _start(self, trees: list[Tree], tree: Tree) -> None:
        for t in trees[self.applied:]:
            if t is self.tree:
                t.add_to(self.raw, t.spread(self.bins, self.rows))
                if self.rest is not None:
                    t.add_to(self.raw, t.spread(self.bins, {1: self.rest}))
            else:
                t.add_to(self.raw, t.spread(self.bins))
        self.applied, self.tree = len(trees), tree
        self.g, self.h = derivatives(self.raw, self.y, self.w)
        live = None if self.drawn is None else self.drawn(len(trees))
        self.rows = {1: np.arange(len(self.y)) if live is None else np.flatnonzero(live)}
        self.rest = None if live is None else np.flatnonzero(~live)

    def fork(self) -> InTask:
        """The same rows as they were before the tree that grows now."""
        return InTask(self.bins, self.y, self.w, self.raw.copy(), self.drawn, self.applied)


BLOCKS = "rows int, bins binary, y binary, w binary, raw binary"


def _unpack(block: dict, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y, w, raw = (np.frombuffer(block[c]) for c in ("y", "w", "raw"))
    return np.frombuffer(block["bins"], np.uint8).reshape(-1, columns), y, w, raw


class Kept:
    """Blocks of rows whose scores change with every tree: kept by the executors, written now and then to cut the lineage."""

    def __init__(self, spark: SparkSession, blocks: RDD):
        self.spark = spark
        self.now, self.before, self.steps = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, 0

    def step(self, change: Callable[[list], list]) -> None:
        """Change each block; the next job does it."""
        self.steps += 1
        self._drop()
        self.before, self.now = self.now, self.now.map(change)
        if self.steps % REWRITE == 0:
            path = new_path(self.spark, "boosted")
            self.now.saveAsPickleFile(path, 1)
            # Files may be read in more parts than were written.
            self.now = self.spark.sparkContext.pickleFile(path, 1).coalesce(self.now.getNumPartitions())
        self.now.persist(StorageLevel.MEMORY_AND_DISK)

    def _drop(self) -> None:
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def close(self) -> None:
        self._drop()
        self.now.unpersist()


def kept_blocks(blocks: DataFrame, rows: int, join: Callable[[list], object], most: int = KEPT) -> Kept:
    """The blocks, dealt evenly; ``join`` makes one of several of about ``most`` rows together."""
    def joined(part: Iterator) -> Iterator:
        held, size = [], 0
        for block in part:
            held.append(block)
            size += block["rows"]
            if size >= most:
                yield join(held)
                held, size = [], 0
        if held:
            yield join(held)

    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return Kept(blocks.sparkSession, blocks.repartition(parts).rdd.mapPartitions(joined))


def applied(raw: np.ndarray, tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Scores with a tree's values added."""
    raw = raw.copy()
    tree.add_to(raw, tree.spread(bins))
    return raw


def on_blocks(blocks: DataFrame, columns: int, rows: int) -> tuple[Source, Kept]:
    """Histograms of a table of blocks: one job each, in which tasks sum their own blocks."""

    def join(held: list) -> tuple:
        bins, *rest = (np.concatenate(x) for x in zip(*[_unpack(b, columns) for b in held], strict=True))
        return np.ascontiguousarray(bins.T), *rest

    kept = kept_blocks(blocks, rows, join)
    state = {"done": 0}

    def source(trees: list[Tree], tree: Tree, wanted: Nodes) -> np.ndarray:
        for t in trees[state["done"]:]:
            kept.step(lambda block, t=t: (*block[:3], applied(block[3], t, block[0])))
        state["done"] = len(trees)

        def run(part: Iterator) -> Iterator[np.ndarray]:
            total = None
            for bins, y, w, raw in part:
                (g, h), rows = derivatives(raw, y, w), tree.spread(bins)
                own = np.stack([sums(bins, g, h, rows[n]) for n in wanted])
                total = own if total is None else total + own
            if total is not None:
                yield total

        found = kept.now.mapPartitions(run)
        return found.treeReduce(np.add) if found.getNumPartitions() > DIRECT else sum(found.collect())

    return source, kept


MODEL = "tree int, node int, feature int, cut int, threshold double, missing_left boolean, value double, gain double"


def _as_rows(trees: list[Tree]) -> pa.RecordBatch:
    """The nodes that a row can reach."""
    parts = []
    for i, t in enumerate(trees):
        reached = [n for n in range(1, len(t.feature)) if n == 1 or t.feature[n >> 1] >= 0]
        parts.append(pd.DataFrame({"tree": i, "node": reached, **{c: getattr(t, c)[reached] for c in ("feature", "cut", "threshold", "missing_left", "value", "gain")}}))
    frame = pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in MODEL.split(", ")})
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(frame[c.split()[0]], kinds[c.split()[1]]) for c in MODEL.split(", ")], names=[c.split()[0] for c in MODEL.split(", ")])


def column_cuts(rows: DataFrame, columns: int, bins: int) -> list[np.ndarray]:
    """Ascending different values at ``bins - 1`` quantiles of each column, from one mergeable sketch a column."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda i: F.nanvl(F.get("features", F.lit(i)), F.lit(None).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(i), probs, 10_000).alias(f"c{i}") for i in range(columns)]).first()
    return [np.unique(np.array(c, float)) if c is not None else np.zeros(0) for c in found]


def as_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
    bins[np.isnan(x)] = MISSING
    return bins


def _matrix(lists: pa.Array, columns: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, columns)


@dataclass
class HistBoost:
    """Fitted trees. Their number of nodes depends on the settings, not on the data."""

    trees: list[Tree]
    start: float
    columns: int

    @classmethod
    def fit(cls, rows: DataFrame, label: str, settings: Settings | None = None, weight: str | None = None, task_values: int | None = None) -> HistBoost:
        """Boost over ``features`` (array of doubles; null and NaN are missing) for a 0/1 ``label``.

        Rows with a null label or weight, or without features, have no say. Raises ``ValueError`` unless both classes have rows.
        """
        s = settings or Settings()
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = rows.select("features", F.col(label).cast("double").alias("y"), w.alias("w")).where("features is not null and y is not null and w is not null")
        rows = materialize(rows, "train")
        # Whole units, as sums of fractions depend on their order.
        unit = lambda c: F.sum(F.round(c * UNIT).cast("decimal(30,0)")).cast("double")
        got = rows.agg(F.count("*").alias("n"), unit(F.col("w")).alias("w"), unit(F.col("w") * F.col("y")).alias("p"), F.max(F.size("features")).alias("columns")).first()
        if not got["n"] or not 0 < got["p"] < got["w"]:
            raise ValueError("both classes need rows")
        columns, start = got["columns"], math.log(got["p"] / (got["w"] - got["p"]))
        cuts = column_cuts(rows, columns, s.bins)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    y, w = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                    bins = as_bins(_matrix(part.column(0), columns), cuts)
                    row = {"rows": len(y), "bins": bins.tobytes(), "y": y.tobytes(), "w": w.tobytes(), "raw": np.full(len(y), start).tobytes()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("rows", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "w", "raw")]]))

        made = materialize(rows.mapInArrow(blocks, BLOCKS), "blocks")
        if got["n"] * columns > (TASK_VALUES if task_values is None else task_values):
            source, kept = on_blocks(made, columns, got["n"])
            try:
                return cls(boost(source, cuts, s), start, columns)
            finally:
                kept.close()

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [_unpack(b, columns) for batch in batches for b in batch.to_pylist()]
            if held:
                bins, y, w, _ = (np.concatenate(x) for x in zip(*held, strict=True))
                yield _as_rows(boost(InTask(np.ascontiguousarray(bins.T), y, w, np.full(len(y), start)), cuts, s))

        return cls.of_rows(made.coalesce(1).mapInArrow(whole, MODEL).toPandas(), start, columns)

    @classmethod
    def of_rows(cls, frame: pd.DataFrame, start: float, columns: int) -> HistBoost:
        trees = []
        for _, nodes in frame.groupby("tree"):
            tree = Tree(max(int(nodes["node"].max()).bit_length() - 1, 1))
            for c in ("feature", "cut", "threshold", "missing_left", "value", "gain"):
                getattr(tree, c)[nodes["node"].to_numpy()] = nodes[c].to_numpy()
            trees.append(tree)
        return cls(trees, start, columns)

    def _over(self, kind: str, what: Callable[[HistBoost, np.ndarray], np.ndarray]) -> Column:
        model = self

        @pandas_udf(kind)
        def run(features: pd.Series) -> pd.Series:
            known = features.notna()
            x = np.full((len(features), model.columns), np.nan)
            if known.any():
                x[known.to_numpy()] = np.array([np.asarray(v, float) for v in features[known]])
            return pd.Series(list(what(model, x)))

        return run("features")

    def score(self, trees: int | None = None) -> Column:
        """Probability of label 1 from ``features``, by the first ``trees`` trees; a row without features counts as all missing."""
        def raw(model: HistBoost, x: np.ndarray) -> np.ndarray:
            missing, total = np.isnan(x), np.full(len(x), model.start)
            for t in model.trees[:trees]:
                total = total + t.value[t.leaves(x, missing, t.threshold)]
            return 1.0 / (1.0 + np.exp(-total))

        return self._over("double", raw)

    def leaf_ids(self) -> Column:
        """The leaf of each tree that a row ends in."""
        return self._over("array<bigint>", lambda model, x: np.stack([t.leaves(x, np.isnan(x), t.threshold) for t in model.trees], axis=1))

    def importances(self) -> np.ndarray:
        """Share of each column in the gain of all splits."""
        total = np.zeros(self.columns)
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return total / total.sum() if total.sum() else total

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = spark.createDataFrame(pa.Table.from_batches([_as_rows(self.trees)]))
        nodes.withColumns({"start": F.lit(self.start), "columns": F.lit(self.columns)}).write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HistBoost:
        frame = spark.read.parquet(path).toPandas()
        return cls.of_rows(frame, float(frame["start"].iloc[0]), int(frame["columns"].iloc[0]))
