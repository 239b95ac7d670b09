"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Edges that one task joins up by itself.
TASK_EDGES = 1 << 16


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (a, b) of a whole graph."""
    above: dict = {}

    def top(node):
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            above[top(a)] = top(b)
    if above:
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(top, nodes), kind)], names=["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share a root.

    Each round points every node to its neighbour of least hash, replaces the ends of all edges by what they point
    to, and drops loops and repeats. A constant share of the nodes goes in each round, so there are logarithmically
    many, on ever smaller tables; once ``task_edges`` are left, one task joins those up. Pointers come from an aggregate with partial sums, and the joins of edges with
    pointers may be split where one node has most of the edges. Null ends are left out; an empty table gives none.
    """
    left = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    steps, seed = [], 0
    while n := left.count():
        if n <= task_edges:
            kind = left.schema["a"].dataType.simpleString()
            steps.append(materialize(left.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}"), "pointers"))
            break
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), rank("b").alias("r")), F.struct(F.col("b").alias("node"), rank("a").alias("r")))).alias("x")).select("x.*")
        own = F.struct(F.xxhash64(F.lit(seed), F.col("node")).alias("h"), F.col("node").alias("to"))
        step = materialize(ends.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", own)["to"].alias("root")), "pointers")
        steps.append(step)
        mapped = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = materialize(mapped.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a != b").distinct(), "edges")
    if not steps:
        kind = left.schema["a"].dataType.simpleString()
        return left.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return materialize(out, "roots") if len(steps) > 1 else out
