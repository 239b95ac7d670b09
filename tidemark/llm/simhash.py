"""SimHash near-duplicates by covering locality-sensitive hashing.

A random map sends each of the 64 bits to a vector of radius + 1 bits; mask v keeps the bits whose vector has an odd
product with v. For any radius bits there is a non-zero v with an even product with all their vectors, so two
fingerprints that differ there only are equal under mask v: each pair within the radius meets in one of the
2^(radius+1) - 1 tables, always. Fingerprints of one bucket are compared by differing bits in blocks, and only a
spanning forest of the links leaves a block, so copies and dense buckets never become pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.paragraphs import shingles
from tidemark.llm.registry import query, table
from tidemark.session import materialize

SEED = 42
BLOCK = 16_384
CHUNK = 65_536


def masks(radius: int, bits: int = 64, seed: int = 1) -> list[int]:
    """Bit masks such that any ``radius`` of the bits are all left out by one of them; as signed 64-bit values."""
    rng = random.Random(seed)
    # Every vector is used about equally often, so all masks keep about half of the bits.
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    rng.shuffle(vectors)
    found = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def majority(hashes: np.ndarray) -> int:
    """64-bit value whose bits are set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_print(words: list[bytes], size: int = 3, seed: int = SEED) -> int:
    one = xxhash.xxh64_intdigest
    return majority(np.fromiter((one(s, seed) for s in shingles(words, size)), np.uint64))


def contract_print(text: bytes) -> int:
    """Three-word shingles of the lower-cased text."""
    return shingle_print(text.lower().split())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, print) per row: the 64-bit fingerprint and its bytes. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [contract_print(t.as_py() or b"") for t in batch.column("text")]
            values = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array([v.to_bytes(8, "little") for v in made], pa.binary())], names=["key", "value", "print"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, value bigint, print binary")


def forest(prints: list[bytes], radius: int) -> Iterator[tuple[bytes, bytes]]:
    """Spanning forest of the links among fingerprints: at most ``radius`` bits apart."""
    if len(prints) == 2:
        if bits_apart(*prints) <= radius:
            yield prints[0], prints[1]
        return
    words = np.frombuffer(b"".join(prints), np.uint64)
    rest = np.arange(len(prints))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(words[rest] ^ words[at]) <= radius
            if near.any():
                yield from ((prints[at], prints[i]) for i in rest[near])
                queue += list(rest[near])
                rest = rest[~near]


def bits_apart(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``prints`` holds each (value, print) once.

    Buckets of up to ``BLOCK`` fingerprints are one unit of work; larger ones are cut into blocks, and each pair of
    blocks is a unit. Nothing is left out.
    """
    held = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("value").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks(radius))])).alias("x")
    spread = prints.select("print", held).select("x.*", "print")
    full = spread.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = spread.join(full, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))))
    rows = rows.withColumn("own", own).withColumn("other", other)
    units = rows.groupBy("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("print").alias("prints"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for unit in batch.column("prints") for pair in forest(unit.as_py(), radius)]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return units.select("prints").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, component_id) per row: rows whose fingerprints are linked, directly or over others, share the
    smallest key among them.

    A null text counts as empty; texts without words have fingerprint zero and link like others. Null keys take
    part, but are never the smallest while another is there. Repeated rows repeat in the result. An empty table
    gives an empty result. Copies meet in one fingerprint, so only different fingerprints are compared.
    """
    made = materialize(fingerprints(docs, key, text), "prints")
    first = materialize(made.groupBy("value", "print").agg(F.min("key").alias("first")), "first")
    roots = components(links(first, radius))
    grouped = first.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("print", "component_id")
    return made.join(named, "print").select("key", "value", "component_id")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: one document of each group of near copies, the one with the smallest doc_id.

    Groups are those of ``near_duplicates``: fingerprints of three-word shingles at most 3 bits apart, directly or over others. Rows
    with a null doc_id or one that occurs twice are told apart by their text; of equal rows one stays. A null doc_id stays only
    where no other row of its group has one.
    """
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("h")))
    found = near_duplicates(keyed, key="__key")
    kept = found.where("key = component_id").select(F.col("key").alias("__key")).distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select([F.col(f"`{c}`") for c in docs.columns])


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")
