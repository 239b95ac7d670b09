"""Exact top-k search by inner product: tiles of queries and shards, partial selection, tree merging.

Vectors are packed into shards and queries into blocks, both of bounded size, as integer matrices of the narrowest type that
holds them. Every group of shards meets every query block; each pair is a tile, scored by one matrix product, of which the k
best per query are kept. The top lists of a query block over one group are merged as its tiles go by, and those of
the groups by a tree of bounded fan-in, so no task holds more than a few blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize

SCALE = 1024
#: Rows of a shard and of a query block at most, and bytes of a shard.
SHARD = 4_096
QUERIES = 512
SHARD_BYTES = 1 << 22
#: Shards in a group at most (about), and top lists merged at once.
GROUP = 32
FAN = 16
TYPES = (np.int8, np.int16, np.int32, np.int64)
#: Scores end here; an empty place of a top list is below.
LAST = (1 << 63) - 2
EMPTY = -LAST - 1

Block = tuple[np.ndarray, np.ndarray]  # ids in ascending order and a matrix with a row for each
Tops = tuple[np.ndarray, np.ndarray]  # ids and scores of the best, a row for each query


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as 64-bit integers; null if a component is null or not finite."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(x * float(scale))))


def rows_of_shard(d: int, size: int) -> int:
    return max(1, min(size, SHARD_BYTES // (8 * max(1, d))))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as blocks (block, d, kind, ids, matrix) of one dimension; made where the rows are, without a shuffle."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def made(number: int, d: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        low, high = values.min(initial=0), values.max(initial=0)
        kind = next(i for i, t in enumerate(TYPES) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        row = (number, d, kind, ids[order].tobytes(), values[order].astype(TYPES[kind]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "d", "kind", "ids", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[Block]] = {}
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                most = rows_of_shard(d, size)
                for at in range(0, len(own), most):
                    some = own[at:at + most]
                    values = flat[starts[some, None] + np.arange(d)] if d else np.zeros((len(some), 0), np.int64)
                    held.setdefault(d, []).append((ids[some], values))
                    if sum(len(x) for x, _ in held[d]) >= most:
                        every, matrix = (np.concatenate(x) for x in zip(*held[d], strict=True))
                        yield made(number, d, every[:most], matrix[:most])
                        held[d] = [(every[most:], matrix[most:])]
                        number += 1
        for d, parts in held.items():
            every, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(every):
                yield made(number, d, every, matrix)
                number += 1

    return rows.mapInArrow(run, "block bigint, d int, kind int, ids binary, matrix binary")


def unpacked(ids: bytes, matrix: bytes, kind: int, d: int) -> Block:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(matrix, TYPES[kind]).reshape(len(keys), d)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products. Doubles hold them up to 2 ** 53, 64-bit integers up to 2 ** 62; beyond, Python's integers are
    used, and a product that passes 64 bits counts as the last number."""
    size = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    most = size(q) * size(c) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, -LAST, LAST).astype(np.int64)


def tile(q: Block, c: Block, k: int) -> Tops:
    """The k best of a shard for each query of a block: largest score, then smallest id. Rows of the query's id have no place."""
    (qids, qv), (cids, cv) = q, c
    scores, n = products(qv, cv), len(cids)
    low, high = np.searchsorted(cids, qids), np.searchsorted(cids, qids, side="right")
    own = np.flatnonzero(low < high).tolist()
    wide = max(int(scores.max(initial=0)), -int(scores.min(initial=0))) >= (1 << 62) // n
    # One number that orders by score, then by column; no two are equal, so a partial selection is enough.
    key = scores if wide else scores * n - np.arange(n)
    for i in own:
        key[i, low[i]:high[i]] = EMPTY
        scores[i, low[i]:high[i]] = EMPTY
    if n <= k:
        at = np.tile(np.arange(n), (len(qids), 1))
    elif wide:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    else:
        at = np.argpartition(key, n - k, axis=1)[:, n - k:]
    return cids[at], np.take_along_axis(scores, at, 1)


def merged(parts: list[Tops], k: int) -> Tops:
    """One top list for each query from several."""
    ids, scores = (np.concatenate(x, 1) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


TOPS = "block bigint, d int, part bigint, queries binary, ids binary, scores binary"


def tops_row(block: int, d: int, part: int, queries: bytes, tops: Tops) -> pa.RecordBatch:
    row = (block, d, part, queries, np.ascontiguousarray(tops[0]).tobytes(), np.ascontiguousarray(tops[1]).tobytes())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "d", "part", "queries", "ids", "scores"])


def tops_of(queries: bytes, ids: bytes, scores: bytes) -> Tops:
    n = len(queries) // 8
    return np.frombuffer(ids, np.int64).reshape(n, -1), np.frombuffer(scores, np.int64).reshape(n, -1)


def score_tiles(k: int):
    """Tiles (query block beside shard) to one top list for each query block and group in a row of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tops, asked = None, None, b""
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                key = (row["block"], row["d"], row["part"])
                if key != at:
                    if tops is not None:
                        yield tops_row(*at, asked, tops)
                    at, tops, asked = key, None, row["ids"]
                found = tile(unpacked(row["ids"], row["matrix"], row["kind"], row["d"]), unpacked(row["cids"], row["cmatrix"], row["ckind"], row["d"]), k)
                tops = merged([tops, found] if tops is not None else [found], k)
        if tops is not None:
            yield tops_row(*at, asked, tops)

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` rows of largest integer inner product among ``rows``.

    Components x become floor(scale * x). Ties go to the smaller key. A query's own rows, those of its key, are no
    candidates; other repeated rows each count. Rows with a null key take no part, nor do vectors that are null or hold a
    null or non-finite component; vectors meet those of their own dimension only. Fewer candidates than ``k`` give a shorter
    list, none give no row. Scores beyond 64 bits count as the last number. Keys are integers.
    """
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), whole(F.col(f"`{vector}`"), scale).alias("v"))
        return own.where("id is not null and v is not null")

    shards = materialize(packed(usable(rows), SHARD), "shards")
    asked = usable(queries)
    blocks = materialize(packed(asked.repartition(max(1, math.ceil(asked.count() / QUERIES))), QUERIES), "blocks")
    held = shards.count()
    parts = max(math.ceil(held / GROUP), min(held, 4 * spark.sparkContext.defaultParallelism), 1)
    sent = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    kept = shards.select("d", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.col("kind").alias("ckind"), F.col("ids").alias("cids"), F.col("matrix").alias("cmatrix"))
    tops = sent.join(kept, ["d", "part"]).mapInArrow(score_tiles(k), TOPS)

    def merge(found: pa.Table) -> pa.Table:
        lists = [tops_of(q.as_py(), i.as_py(), s.as_py()) for q, i, s in zip(found["queries"], found["ids"], found["scores"], strict=True)]
        first = found.slice(0, 1).to_pylist()[0]
        return pa.Table.from_batches([tops_row(first["block"], first["d"], first["part"], first["queries"], merged(lists, k))])

    while True:
        tops = tops.withColumn("part", F.expr(f"part div {FAN}")).groupBy("block", "d", "part").applyInArrow(merge, TOPS)
        parts = math.ceil(parts / FAN)
        if parts == 1:
            break

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, i, s in zip(batch.column("queries"), batch.column("ids"), batch.column("scores"), strict=True):
                asked_ids, (ids, scores) = np.frombuffer(q.as_py(), np.int64), tops_of(q.as_py(), i.as_py(), s.as_py())
                there = scores > EMPTY
                rank = np.broadcast_to(np.arange(1, ids.shape[1] + 1, dtype=np.int32), ids.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, there.sum(1))), pa.array(rank[there]), pa.array(ids[there]), pa.array(scores[there])], names=["query_id", "rank", "vec_id", "score"])

    return tops.mapInArrow(listed, "query_id bigint, rank int, vec_id bigint, score bigint")


OP12_SQL = """with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(1024 * x)) as f from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.f, c.f) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
  qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10"""


@query("op12_topk", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where("vec_id % 100 = 0"))
