"""Isolation forests of samples of any size.

Node i has the children 2i and 2i + 1, and what it splits on is a function of (seed, tree, i) and the ranges of its rows. So a tree is
the same whether one task grows it from its rows or all tasks grow it level by level, where a level needs one
aggregate of least and largest values per node. Trees whose sample fits into a task are grown there. Equal rows go the same
way, so samples are counts of different vectors, and each of these is scored once. A model of
up to ``MODEL_NODES`` nodes is sent to all tasks; a larger one stays a table, and blocks of rows meet its trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators.metrics import small_side
from tidemark.operators.quantile import exact_quantiles
from tidemark.session import materialize

#: Values (rows times features) that one task holds to grow a tree.
TASK_VALUES = 1 << 20
#: Nodes of a model that is sent to all tasks.
MODEL_NODES = 1 << 20
#: Rows of a block that meets trees.
BLOCK = 4_096
#: Rows of a block from which trees are drawn.
DRAWN = 65_536
#: Depth up to which a tree is laid out in full while rows go down.
FULL = 12
#: Counts (tree, vector) and nodes that a task holds for its trees.
PART_COUNTS = 1 << 24
PART_NODES = 1 << 21

NODES = "tree int, node bigint, feature int, cut double, path double"
TREES = "tree int, n bigint, node binary, feature binary, cut binary, path binary"
KINDS = {"node": np.int64, "feature": np.int32, "cut": np.float64, "path": np.float64}


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3.0)
    long = 2.0 * (np.log(many - 1.0) + np.euler_gamma) - 2.0 * (many - 1.0) / many
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def draws(seed: int, tree: np.ndarray, node: np.ndarray, which: int) -> np.ndarray:
    """A number in [0, 1) for each (tree, node)."""
    with np.errstate(over="ignore"):
        x = np.asarray(node).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(tree).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed * 2 + which)
        for _ in range(2):
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SHARES = 1 << 40


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _with_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of a bigint, on top of the hash of what precedes it."""
    h = seed + _P5 + np.uint64(8) ^ _turned(np.asarray(x).astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    return _mixed(_turned(h, 27) * _P1 + _P4)


def _with_int(x: int, seed: np.ndarray) -> np.ndarray:
    """The same of an int."""
    h = seed + _P5 + np.uint64(4) ^ np.uint64(x & 0xFFFFFFFF) * _P1
    return _mixed(_turned(h, 23) * _P2 + _P3)


def row_hash(idx: np.ndarray, seed: int) -> np.ndarray:
    """``xxhash64(seed, idx)``, to which :func:`in_share` adds the tree."""
    with np.errstate(over="ignore"):
        start = np.full(1, 42, np.uint64)
        first = _with_int(seed, start) if -(1 << 31) <= seed < 1 << 31 else _with_long(np.array([seed]), start)
        return _with_long(idx, first)


def in_share(own: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether rows with the hashes ``own`` are in the tree: the draw of :meth:`IsolationForest.shared`."""
    with np.errstate(over="ignore"):
        return (_with_int(tree, own) & np.uint64(SHARES - 1)) < np.uint64(int(share * SHARES))


def splits(seed: int, tree: np.ndarray, node: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: a leaf), cut and path length of nodes, from the number and the ranges of their rows."""
    open_ = high > low
    some = open_.sum(1)
    leaf = (depth >= limit) | (count <= 1) | (some == 0)
    place = np.minimum((draws(seed, tree, node, 0) * some).astype(int), np.maximum(some - 1, 0))
    feature = np.argmax((np.cumsum(open_, 1) == place[:, None] + 1) & open_, axis=1)
    at = np.arange(len(feature))
    lo, hi = low[at, feature], high[at, feature]
    # Below the largest value, so that both sides have rows.
    cut = np.minimum(lo + (hi - lo) * draws(seed, tree, node, 1), np.nextafter(hi, lo))
    return np.where(leaf, -1, feature), np.where(leaf, 0.0, cut), np.where(leaf, depth + mean_path(count), 0.0)


def grow(x: np.ndarray, tree: int, seed: int, limit: int, times: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """One tree from its rows, each there as many ``times``, all nodes of a level at once; nodes ascend."""
    node, live = np.ones(len(x), np.int64), np.arange(len(x))
    parts: dict[str, list[np.ndarray]] = {c: [] for c in KINDS}
    for depth in range(limit + 1):
        if not len(live):
            break
        live = live[np.argsort(node[live], kind="stable")]
        ids, starts, counts = np.unique(node[live], return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(x[live], starts, axis=0), np.maximum.reduceat(x[live], starts, axis=0)
        held = counts if times is None else np.add.reduceat(times[live], starts)
        feature, cut, path = splits(seed, np.full(len(ids), tree), ids, held, low, high, depth, limit)
        for name, values in zip(KINDS, (ids, feature, cut, path), strict=True):
            parts[name].append(values.astype(KINDS[name]))
        f, c = np.repeat(feature, counts), np.repeat(cut, counts)
        live, f, c = live[f >= 0], f[f >= 0], c[f >= 0]
        node[live] = 2 * node[live] + (x[live, f] > c)
    return {c: np.concatenate(v) for c, v in parts.items()}


def grow_levels(rows: DataFrame, seed: int, limit: int) -> DataFrame:
    """The nodes of all trees from rows (idx, tree, features), level by level: one aggregate and one join a level."""
    spark = rows.sparkSession
    width = rows.select(F.size("features")).first()[0]
    at = materialize(rows.select("idx", F.col("tree").cast("int").alias("tree"), "features", F.lit(1).cast("bigint").alias("node")), "forest-rows")
    levels = []
    for depth in range(limit + 1):
        ranges = [f(F.col("features")[j]).alias(f"{c}{j}") for j in range(width) for c, f in (("l", F.min), ("h", F.max))]
        stats = at.groupBy("tree", "node").agg(F.count("*").alias("n"), *ranges)
        stats = stats.select("tree", "node", "n", F.array(*[f"l{j}" for j in range(width)]).alias("low"), F.array(*[f"h{j}" for j in range(width)]).alias("high"))

        def choose(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    tree, node, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "node", "n"))
                    low, high = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(n), width) for c in ("low", "high"))
                    feature, cut, path = splits(seed, tree, node, n, low, high, depth, limit)
                    yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("node"), pa.array(feature.astype(np.int32)), pa.array(cut), pa.array(path)], names=["tree", "node", "feature", "cut", "path"])

        level = materialize(stats.mapInArrow(choose, NODES), "forest-level")
        levels.append(level)
        inner = level.where("feature >= 0").select("tree", "node", "feature", "cut")
        if depth == limit or inner.isEmpty():
            break
        right = (F.element_at("features", F.col("feature") + 1) > F.col("cut")).cast("bigint")
        at = materialize(at.join(small_side(inner), ["tree", "node"]).select("idx", "tree", "features", (2 * F.col("node") + right).alias("node")), "forest-rows")
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], NODES)


def _laid_out(tree: dict[str, np.ndarray]) -> None:
    """Add to the tree what :func:`walked` reads: a leaf leads to itself, so all rows go down together."""
    node, feature, cut, path = (tree[c] for c in KINDS)
    tree["depth"] = depth = int(node[-1]).bit_length() - 1
    if depth > FULL:
        leaf = feature < 0
        tree["left"] = np.where(leaf, np.arange(len(leaf)), np.searchsorted(node, 2 * node))
        tree["column"], tree["most"], tree["ends"] = np.where(leaf, 0, feature).astype(np.int64), np.where(leaf, np.inf, cut), path
        return
    # A full tree, by heap number: below a leaf all is like it.
    column, most, ends = np.zeros(2 << depth, np.int64), np.full(2 << depth, np.inf), np.zeros(2 << depth)
    inner = feature >= 0
    column[node[inner]], most[node[inner]] = feature[inner], cut[inner]
    for n, p in zip(node[~inner].tolist(), path[~inner].tolist()):
        below = depth + 1 - n.bit_length()
        ends[n << below:n + 1 << below] = p
    tree["left"], tree["column"], tree["most"], tree["ends"] = None, column, most, ends


def walked(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Path length of each row in one tree."""
    if "ends" not in tree:
        _laid_out(tree)
    flat, rows = np.ascontiguousarray(x).ravel(), np.arange(0, x.size, max(1, x.shape[1]))
    at = np.full(len(x), int(tree["left"] is None))
    for _ in range(tree["depth"]):
        right = flat.take(tree["column"].take(at) + rows) > tree["most"].take(at)
        at = at + at if tree["left"] is None else tree["left"].take(at)
        at += right
    return tree["ends"].take(at)


def unpacked(row) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], kind) for c, kind in KINDS.items()}


@dataclass
class IsolationForest:
    """Trees in memory (``trees``), as a table with a row for each (``table``), or with a row for each node (``nodes``)."""

    trees: list[dict[str, np.ndarray]] | None
    sample: int
    size: int
    offset: float = 0.0
    table: DataFrame | None = None
    nodes: DataFrame | None = None

    @classmethod
    def fit(cls, df: DataFrame, n: int, trees: int = 400, max_samples: int | float | str = "auto",
            contamination: float | str = 0.01, seed: int = 42, task_values: int = TASK_VALUES, model_nodes: int = MODEL_NODES) -> IsolationForest:
        """Grow trees on random rows of ``df``, which has ``features`` and dense ``idx`` in [0, n).

        ``max_samples`` is a number of rows, a share of them or "auto" (at most 256). A number of rows is drawn exactly; a
        share, of which there is no limit, takes each row by a hash of (idx, tree). With a ``contamination`` share,
        scores are shifted so that this share of ``df`` lies above 0.
        """
        if n <= 0:
            raise ValueError("no training rows")
        width = df.select(F.size("features")).first()[0]
        share = max_samples if isinstance(max_samples, float) else None
        sample = min(256, n) if max_samples == "auto" else max(1, int(share * n)) if share is not None else min(int(max_samples), n)
        limit = max(1, math.ceil(math.log2(max(sample, 2))))
        # Half as much again leaves room for the spread of a share.
        in_task = 3 * sample * max(1, width) <= 2 * task_values
        if share is None and in_task:
            forest = cls._grown_in_tasks(cls.drawn(df, n, trees, sample, seed), trees, sample, seed, limit, model_nodes)
        else:
            part = share if share is not None else sample / n
            vectors = materialize(df.select("features").distinct(), "forest-vectors")
            if (many := vectors.count()) * max(1, width) <= task_values:
                table = cls._grown_from_counts(df, vectors, many, width, trees, part, seed, limit)
                forest = cls._of_table(table, trees, sample, model_nodes)
            else:
                nodes = materialize(grow_levels(cls.shared(df, trees, part, seed), seed, limit), "forest-nodes")
                forest = cls(None, sample, trees, nodes=nodes)
        if contamination != "auto":
            scores = forest.transform(df.select("features"), "s", raw=True).select("s")
            forest.offset = exact_quantiles(materialize(scores, "forest-scores"), ["s"], [1.0 - float(contamination)])["s"][0]
        else:
            forest.offset = 0.5
        return forest

    @staticmethod
    def drawn(df: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
        """(idx, tree, features): exactly ``sample`` rows of each tree."""

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for t in pdf["tree"]:
                    rows = np.random.default_rng([seed, int(t)]).choice(n, size=sample, replace=False)
                    yield pd.DataFrame({"tree": int(t), "idx": rows.astype("int64")})

        ids = df.sparkSession.range(trees).withColumnRenamed("id", "tree")
        return df.select("idx", "features").join(ids.mapInPandas(draw, "tree long, idx long"), "idx")

    @staticmethod
    def shared(df: DataFrame, trees: int, share: float, seed: int) -> DataFrame:
        """(idx, tree, features): each row in each tree with this chance, by a hash, so that it is the same wherever it is asked."""
        place = lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col("idx").cast("bigint"), t), F.lit(SHARES))
        held = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < int(share * SHARES))
        return df.select("idx", "features", F.explode(held).alias("tree"))

    @staticmethod
    def share_sizes(df: DataFrame, trees: int, share: float, seed: int) -> DataFrame:
        """(tree, count) of the rows that :meth:`shared` gives."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(trees, np.int64)
            for batch in batches:
                own = row_hash(batch.column(0).to_numpy(), seed)
                total += [np.count_nonzero(in_share(own, t, share)) for t in range(trees)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), pa.array(total)], names=["tree", "count"])

        counts = df.select(F.col("idx").cast("bigint")).mapInArrow(count, "tree int, count bigint")
        return counts.groupBy("tree").agg(F.sum("count").alias("count")).where("count > 0")

    @staticmethod
    def _grown_from_counts(df: DataFrame, vectors: DataFrame, many: int, width: int, trees: int, share: float, seed: int, limit: int) -> DataFrame:
        """All trees as a table: each task counts how often its trees draw each of the different vectors, and grows them from that."""
        spark = df.sparkSession
        numbered = materialize(vectors.coalesce(1).select("features", F.monotonically_increasing_id().cast("int").alias("vec")), "forest-numbered")
        keyed = df.select(F.col("idx").cast("bigint").alias("idx"), "features").join(small_side(numbered), "features").select("idx", "vec")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            blank = pa.schema([("idx", pa.binary()), ("vec", pa.binary())])

            def packed() -> pa.RecordBatch:
                table = pa.Table.from_batches(held)
                return pa.RecordBatch.from_pylist([{c: np.ascontiguousarray(table[c].to_numpy()).tobytes() for c in ("idx", "vec")}], blank)

            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= DRAWN:
                    yield packed()
                    held, size = [], 0
            if size:
                yield packed()

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches), pa.schema([("features", pa.list_(pa.float64())), ("vec", pa.int32())]))
            x = np.empty((many, width))
            if table.num_rows:
                x[table["vec"].to_numpy()] = np.array(table["features"].to_pylist(), float).reshape(-1, width)
                yield pa.RecordBatch.from_pylist([{"idx": None, "vec": x.tobytes()}], pa.schema([("idx", pa.binary()), ("vec", pa.binary())]))

        kind = "idx binary, vec binary"
        doubles = numbered.select(F.col("features").cast("array<double>").alias("features"), "vec").coalesce(1)
        blocks = materialize(keyed.mapInArrow(pack, kind).unionByName(doubles.mapInArrow(one, kind)), "forest-blocks")
        parts = min(trees, max(2 * spark.sparkContext.defaultParallelism, -(-trees * many // PART_COUNTS)))

        def build(p: int, rows: Iterator) -> Iterator[tuple]:
            counts = {t: np.zeros(many, np.int64) for t in range(p, trees, parts)}
            for _, (idx, vec) in rows:
                if idx is None:
                    x = np.frombuffer(vec).reshape(many, width)
                    continue
                own, vec = row_hash(np.frombuffer(idx, np.int64), seed), np.frombuffer(vec, np.int32)
                for t, total in counts.items():
                    total += np.bincount(vec[in_share(own, t, share)], minlength=many)
            for t, total in counts.items():
                at = np.flatnonzero(total)
                if len(at):
                    made = grow(x[at], t, seed, limit, total[at])
                    yield (t, len(made["node"]), *[made[c].tobytes() for c in KINDS])

        dealt = blocks.rdd.flatMap(lambda b: [(p, (b["idx"], b["vec"])) for p in range(parts)]).partitionBy(parts, int)
        return materialize(spark.createDataFrame(dealt.mapPartitionsWithIndex(build), TREES), "forest")

    @classmethod
    def _grown_in_tasks(cls, members: DataFrame, trees: int, sample: int, seed: int, limit: int, model_nodes: int) -> IsolationForest:
        def build(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("idx").combine_chunks()
            x = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), float) for c in rows["features"].chunks]).reshape(rows.num_rows, -1)
            t = int(rows["tree"][0].as_py())
            made = grow(x, t, seed, limit)
            return pa.table({"tree": pa.array([t], pa.int32()), "n": pa.array([len(made["node"])], pa.int64()), **{c: pa.array([made[c].tobytes()], pa.binary()) for c in KINDS}})

        return cls._of_table(materialize(members.groupBy("tree").applyInArrow(build, TREES), "forest"), trees, sample, model_nodes)

    @classmethod
    def _of_table(cls, table: DataFrame, trees: int, sample: int, model_nodes: int) -> IsolationForest:
        whole = table.agg(F.sum("n")).first()[0] or 0
        if whole > model_nodes:
            return cls(None, sample, trees, table=table)
        return cls([unpacked(r) for r in table.orderBy("tree").collect()], sample, trees)

    def _score(self, paths: Column) -> Column:
        return F.pow(F.lit(2.0), -paths / F.lit(self.size * (float(mean_path(self.sample)) or 1.0)))

    def raw_score(self, spark: SparkSession) -> Column:
        """Score in (0, 1) from ``features``; for a model in memory."""
        if self.trees is None:
            raise ValueError("the model is a table: use transform")
        shared = spark.sparkContext.broadcast(self.trees)

        @pandas_udf("double")
        def paths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forest = [dict(t) for t in shared.value]
            for col in batches:
                total = np.zeros(len(col))
                if len(col):
                    x = np.stack(col.to_numpy())
                    for t in forest:
                        total += walked(t, x)
                yield pd.Series(total)

        return self._score(paths("features"))

    def score(self, spark: SparkSession) -> Column:
        """Score relative to the contamination cut: above 0 is an outlier; for a model in memory."""
        return self.raw_score(spark) - F.lit(self.offset)

    def transform(self, df: DataFrame, name: str = "anomaly_score", raw: bool = False) -> DataFrame:
        """``df`` (with ``features``) and its score, whatever the size of the model."""
        off = F.lit(0.0 if raw else self.offset)
        if self.trees is not None:
            return df.withColumn(name, self.raw_score(df.sparkSession) - off)
        rows = materialize(df, "forest-scored")
        asked = materialize(rows.select("features").distinct().withColumn("__row", F.monotonically_increasing_id()), "forest-vectors")
        paths = self._by_level(asked) if self.nodes is not None else self._by_tree(asked)
        paths = small_side(materialize(asked.join(paths, "__row").select("features", "__paths"), "forest-paths"))
        return rows.join(paths, "features").withColumn(name, self._score(F.col("__paths")) - off).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)

    def _by_tree(self, rows: DataFrame) -> DataFrame:
        """Blocks of rows meet the trees of each part, which a task holds; the sums over the parts meet by block."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    ids = batch.column("__row").slice(at, BLOCK).to_numpy()
                    x = np.stack(batch.column("features").slice(at, BLOCK).to_pylist()).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

        spark = rows.sparkSession
        whole = self.table.agg(F.sum("n")).first()[0] or 0
        parts = min(self.size, max(2 * spark.sparkContext.defaultParallelism, -(-whole // PART_NODES)))
        trees = self.table.rdd.map(lambda r: ((r["tree"] % parts, 0), r.asDict()))
        blocks = rows.mapInArrow(pack, "ids binary, x binary").rdd.flatMap(lambda b: [((p, 1), b.asDict()) for p in range(parts)])

        def run(met: Iterator) -> Iterator[tuple[bytes, np.ndarray]]:
            forest = []
            for (_, kind), row in met:
                if kind == 0:
                    forest.append(unpacked(row))
                    continue
                x = np.frombuffer(row["x"]).reshape(len(row["ids"]) // 8, -1)
                total = np.zeros(len(x))
                for tree in forest:
                    total += walked(tree, x)
                yield row["ids"], total

        # Trees come before blocks.
        dealt = trees.union(blocks).repartitionAndSortWithinPartitions(parts, lambda key: key[0])
        sums = dealt.mapPartitions(run).reduceByKey(np.add, parts).map(lambda s: (s[0], s[1].tobytes()))

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(p))], names=["__row", "__paths"])

        return spark.createDataFrame(sums, "ids binary, p binary").mapInArrow(unpack, "__row bigint, __paths double")

    def _by_level(self, rows: DataFrame) -> DataFrame:
        """All rows go down all trees together, a join a level; for trees that no task could hold."""
        at = rows.select("__row", "features", F.explode(F.sequence(F.lit(0), F.lit(self.size - 1))).alias("tree"), F.lit(1).cast("bigint").alias("node"))
        ended = []
        while True:
            met = materialize(at.join(self.nodes, ["tree", "node"]), "forest-walk")
            ended.append(met.where("feature < 0").select("__row", "path"))
            on = met.where("feature >= 0")
            if on.isEmpty():
                break
            right = (F.element_at("features", F.col("feature") + 1) > F.col("cut")).cast("bigint")
            at = on.select("__row", "features", "tree", (2 * F.col("node") + right).alias("node"))
        return reduce(DataFrame.unionByName, ended).groupBy("__row").agg(F.sum("path").alias("__paths"))

    def save(self, spark: SparkSession, path: str) -> None:
        kind = "memory" if self.trees is not None else "table" if self.table is not None else "nodes"
        meta = [(kind, self.sample, self.size, self.offset)]
        spark.createDataFrame(meta, "kind string, sample bigint, size bigint, offset double").write.mode("errorifexists").parquet(f"{path}/meta")
        if self.trees is not None:
            rows = [(i, len(t["node"]), *[t[c].tobytes() for c in KINDS]) for i, t in enumerate(self.trees)]
            trees = spark.createDataFrame(rows, TREES)
        else:
            trees = self.table if self.table is not None else self.nodes
        trees.write.mode("errorifexists").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta, trees = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/trees")
        out = cls(None, meta["sample"], meta["size"], meta["offset"])
        if meta["kind"] == "memory":
            out.trees = [unpacked(r) for r in trees.orderBy("tree").collect()]
        elif meta["kind"] == "table":
            out.table = trees
        else:
            out.nodes = trees
        return out
