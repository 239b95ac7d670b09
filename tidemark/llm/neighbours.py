"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more dimension that gives them all the same length, so that the largest inner product is the
smallest distance, and are rotated at random, so that a prefix of the dimensions estimates the whole distance.
Lists hold rotated vectors in blocks; a query scans its nearest lists in blocks of columns and, after each block, gives up
the candidates whose estimate fails a hypothesis test against its current k-th distance. What is left is scored
exactly in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize

#: Bounds of the fit: vectors sampled, queries among them, and lists.
SAMPLE = 16_384
PROBES = 256
MAX_LISTS = 4_096
#: Columns per block of the scan, and width of the test in standard deviations.
COLUMNS = 16
EPSILON = 2.1
#: Vectors in one block of a list, queries in one block.
BLOCK = 2_048
QUERIES = 256
SALTS = 64


@dataclass(frozen=True)
class Index:
    """Fitted parts of the index: all bounded by the sample and the dimension."""

    dimension: int
    longest: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def turn(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Rotated vectors with the added dimension, which is zero for queries (their length does not matter)."""
        if queries:
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * self.longest
            extra = np.zeros(len(vectors))
        else:
            extra = np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(1)))
        return np.column_stack([vectors, extra]) @ self.rotation

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(1) - 2 * turned @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with a key whose vector has finite components only, some not zero, as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good & some, F.lit(False)))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        ends = np.searchsorted(near[order], np.arange(lists + 1))
        for i in range(lists):
            own = order[ends[i]:ends[i + 1]]
            centres[i] = sample[own].mean(0) if len(own) else sample[rng.integers(len(sample))]
    return centres


def fit(distinct: DataFrame, k: int, recall: float = 0.97, seed: int = 1) -> Index | None:
    """Index over different vectors (h, v): centres from a hash sample of ``SAMPLE`` of them, about the square root of all
    many lists, and the fewest probed lists that find ``recall`` of the neighbours within the sample."""
    top = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not top["n"]:
        return None
    share = F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.2 * SAMPLE / top["n"]))
    rows = distinct.where(share).select("h", "v").limit(2 * SAMPLE).toArrow()
    rows = rows.take(np.argsort(rows.column("h").to_numpy(), kind="stable")[:SAMPLE]).combine_chunks()
    d, longest = top["d"], math.sqrt(top["m"])
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d + 1, d + 1)))
    plain = matrix(rows.column("v").combine_chunks(), d) if rows.num_rows else np.ones((1, d))
    part = Index(d, longest, rotation, np.zeros((1, d + 1)), 1)
    sample = part.turn(plain)
    lists = max(1, min(MAX_LISTS, len(sample) // 4, math.isqrt(top["n"])))
    index = Index(d, longest, rotation, kmeans(sample, lists, seed=seed), lists)
    asked = plain[:: max(1, len(plain) // PROBES)][:PROBES]
    order = index.nearest(index.turn(asked, True), lists)
    place = np.argsort(order, axis=1)
    own = index.nearest(sample, 1)[:, 0]
    best = np.argsort(-(asked @ plain.T), axis=1, kind="stable")[:, 1:k + 1]
    # The lists that hold the neighbours, by how near they are to the query.
    at = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    probes = int(at[min(len(at) - 1, math.ceil(recall * len(at)))]) + 1 if len(at) else 1
    return Index(d, longest, rotation, index.centres, min(lists, probes))


def packed(rows: DataFrame, queries: bool, block: int) -> DataFrame:
    """Rows (list, block, h, v, turned, bound) gathered into one row per list and block of bounded size."""
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    cut = rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / block)))
    side = "q" if queries else "c"
    return cut.groupBy("list", F.col("block").alias(side)).agg(F.collect_list(F.struct("h", "v", "turned", "bound")).alias(f"{side}s"))


def scan(index: Index, k: int):
    """Candidates of each query in one list block: (query hash, vector hash, exact score), k at most for each."""
    width = index.dimension + 1
    steps = [*range(COLUMNS, width, COLUMNS), width]

    def side(column: pa.Array, row: int):
        values = column[row].values
        h = values.field("h").to_numpy(zero_copy_only=False)
        return h, matrix(values.field("v"), index.dimension), matrix(values.field("turned"), width), values.field("bound").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qh, qv, qt, bound = side(batch.column("qs"), row)
                ch, cv, ct, _ = side(batch.column("cs"), row)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i in range(len(qh)):
                    limit, first = bound[i], 0
                    if not np.isfinite(limit) and len(ch) > k:
                        # No bound yet: the k-th distance among the first candidates of the block.
                        near = ((ct[: 4 * k] - qt[i]) ** 2).sum(1)
                        limit = np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1]
                    alive, partial = np.arange(len(ch)), np.zeros(len(ch))
                    for at in steps:
                        partial = partial + ((ct[alive, first:at] - qt[i, first:at]) ** 2).sum(1)
                        first = at
                        slack = (1 + EPSILON / math.sqrt(at)) ** 2 if at < width else 1 + 1e-9
                        stay = partial * (width / at) <= limit * slack
                        alive, partial = alive[stay], partial[stay]
                        if not len(alive):
                            break
                    if len(alive) > k:
                        # Equal distances all stay, so that ties go by id later on.
                        cut = np.partition(partial, k - 1)[k - 1]
                        alive = alive[partial <= cut * (1 + 1e-9)]
                    if len(alive):
                        out.append((np.full(len(alive), qh[i]), ch[alive], cv[alive] @ qv[i]))
                if out:
                    q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["q", "c", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` rows of largest inner product among ``rows``.

    A row is no neighbour of itself (equal keys). Ties go to the smaller key. Rows with a null key take no part, nor
    do vectors that are null, zero or hold a null or non-finite component; of vectors of different lengths only the
    most frequent length takes part (ties: the longest). Equal vectors are one entry of the index and one query, with
    their k + 1 smallest keys beside it, so copies cost nothing and lose nothing. Repeated rows count once. An empty
    table, or no query, gives an empty result.
    """
    spark = rows.sparkSession
    every, asked = usable(rows, key, vector), usable(queries, key, vector)
    sizes = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = rows.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if sizes is None:
        return empty
    named = lambda df: df.where(F.size("v") == sizes["d"]).withColumn("h", F.xxhash64("v")).distinct()
    every, asked = materialize(named(every), "vectors"), materialize(named(asked).select("id", "h", "v"), "asked")
    # The k + 1 smallest keys of each vector, in two steps so that no task holds all copies of one.
    salted = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(W.partitionBy("h", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)
    members = materialize(few.select("h", "id"), "members")
    distinct = materialize(every.groupBy("h").agg(F.first("v").alias("v")), "distinct")
    texts = asked.groupBy("h").agg(F.first("v").alias("v"))
    index = fit(distinct, k)
    if index is None:
        return empty
    shared = spark.sparkContext.broadcast(index)
    d = index.dimension

    def place(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                turned = own.turn(matrix(part.column("v"), d), queries)
                lists = own.nearest(turned, own.probes if queries else 1)
                n = lists.shape[1]
                take = np.repeat(np.arange(part.num_rows), n)
                rank = np.tile(np.arange(n), part.num_rows)
                whole = pa.ListArray.from_arrays(np.arange(0, (len(take) + 1) * (d + 1), d + 1, dtype=np.int32), turned[take].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel()), pa.array(rank), part.column("h").take(take), part.column("v").take(take), whole], names=["list", "rank", "h", "v", "turned"])

    schema = "list bigint, rank bigint, h bigint, v array<double>, turned array<double>"
    stored = distinct.select("h", "v").mapInArrow(lambda b: place(b, False), schema).withColumn("bound", F.lit(0.0))
    blocks = materialize(packed(stored, False, BLOCK), "lists")
    probed = materialize(texts.select("h", "v").mapInArrow(lambda b: place(b, True), schema), "probes")

    def ask(part: DataFrame) -> DataFrame:
        units = packed(part, True, QUERIES).join(blocks, "list").select("qs", "cs")
        return materialize(units.mapInArrow(lambda b: scan(shared.value, k + 1)(b), "q bigint, c bigint, score double"), "found")

    first = ask(probed.where("rank = 0").withColumn("bound", F.lit(float("inf"))))
    # A bound on the k-th distance after the nearest list: 2 longest^2 - 2 longest / |q| * score.
    kth = first.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") == k + 1).select(F.col("q").alias("h"), F.col("score").alias("kth"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    far = 2 * index.longest**2 - 2 * index.longest * F.col("kth") / norm
    rest = probed.where("rank > 0").join(kth, "h", "left").withColumn("bound", F.coalesce(far * (1 + 1e-9) + 1e-12, F.lit(float("inf")))).drop("kth")
    found = first.unionByName(ask(rest))
    # Different vectors with one score compare by id, so all that reach the k + 1 best scores stay.
    ranked = found.withColumn("n", F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k + 1).drop("n")
    lists = ranked.join(members, ranked["c"] == members["h"]).select("q", "score", F.col("id").alias("vec_id"))
    top = lists.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    answers = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    joined = asked.select(F.col("id").alias("query_id"), F.col("h").alias("q")).join(answers, "q")
    own = joined.select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    out = own.select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


@query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
