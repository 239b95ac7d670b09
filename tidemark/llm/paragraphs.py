"""Removal of repeated paragraphs: MinHash banding, exact Jaccard, components.

Bands are chosen for a wanted recall at the threshold. Paragraphs that collide in a band form units, which are compared exactly
by their five-word shingles; a spanning forest of the verified links goes on to the components, and of
each component the paragraph of the smallest document stays.

Beside paragraphs, which are lines of some words, two more parts of a text are compared for equality: shorter lines, and
stretches of words at hash-chosen places of the whole text. The stretches find a passage that is wrapped otherwise or
lies inside a longer paragraph in one of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.registry import query, table
from tidemark.session import materialize

WORDS = 5
SIMILAR = 0.8
RECALL = 0.995
MOST_HASHES = 48
#: A line of so many words is a paragraph.
MIN_WORDS = 20
#: Words of a stretch, and how many places there are for each that a stretch begins at.
STRETCH = 20
EVERY = 16
PARAGRAPH, SHORT_LINE, STRETCHES = 0, 1, 2
#: A unit of comparison holds two blocks at most, each of about so many paragraphs or shingles, whichever is reached first.
BLOCK = 2_048
BLOCK_SHINGLES = 1 << 21

Split = Callable[[bytes], Iterator[tuple[int, list[bytes]]]]


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Every run of ``size`` words, repeats included; fewer words: all of them; none: nothing."""
    if 0 < len(words) < size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))


def tune_bands(threshold: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows per band): the longest bands with which pairs at the threshold collide with at least this chance."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands is None:
            break
        best = (bands, rows)
    return best


def paragraphs(text: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """(position, lower-cased words) of each line of at least ``min_words`` words."""
    for at, line in enumerate(text.split(b"\n")):
        words = line.lower().split()
        if len(words) >= min_words:
            yield at, words


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The different hashes of a paragraph's shingles, sorted."""
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((one(s) for s in shingles(words, WORDS)), np.uint64))


def band_keys(hashes: np.ndarray, bands: int, rows: int, mix: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the MinHash signature."""
    with np.errstate(over="ignore"):
        least = np.full(bands * rows, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 4096):
            h = hashes[at:at + 4096, None] * mix[0]
            h ^= h >> np.uint64(29)
            h *= mix[1]
            least = np.minimum(least, h.min(0))
        keys = least.reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            out = (out ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def mixers(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def identity(words: list[bytes]) -> bytes:
    """128 bits, equal for paragraphs of equal words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def stretches(words: list[bytes], size: int = STRETCH, every: int = EVERY) -> list[int]:
    """First words of stretches of the lower-cased words of a text, whatever its lines. Where one begins depends on two words
    only, so equal passages have equal stretches; about one place in ``every`` is chosen."""
    if len(words) < size:
        return []
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        mixed = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    return np.flatnonzero(mixed[: len(words) - size + 1] % np.uint64(every) == 0).tolist()


def equal_parts(lines: list[list[bytes]], min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, at, identity) of the short lines and the stretches of a text."""
    for at, line in enumerate(lines):
        if 0 < len(line) < min_words:
            yield SHORT_LINE, at, identity(line)
    words = [w for line in lines for w in line]
    for at in stretches(words):
        yield STRETCHES, at, identity(words[at:at + STRETCH])


def unequal_match(size: int, similar: float) -> bool:
    """Whether a set of this size can reach the similarity with any other set than itself."""
    return size >= similar * (size + 1)


def signatures(docs: DataFrame, key: str, text: str, min_words: int, bands: int, rows: int, similar: float, exact: bool = True) -> DataFrame:
    """(kind, key, at, h, again, size, keys) for each paragraph, and for short lines and stretches if ``exact``.

    ``again`` tells that the text has an equal part of the kind before. Only the first of equal paragraphs of a batch has
    size and keys, and no other part has. Sets too small to be similar to another set meet in one key over the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = mixers(bands * rows)
        for batch in batches:
            out, seen = [], set()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = [line.split() for line in t.as_py().lower().split(b"\n")]
                here = set()
                for kind, at, h in equal_parts(lines, min_words) if exact else ():
                    out.append((kind, k, at, h, (kind, h) in here, None, None))
                    here.add((kind, h))
                for at, words in enumerate(lines):
                    if len(words) < max(1, min_words):
                        continue
                    h = identity(words)
                    if h in seen:
                        out.append((PARAGRAPH, k, at, h, False, None, None))
                        continue
                    seen.add(h)
                    hashes = shingle_hashes(words)
                    if unequal_match(len(hashes), similar):
                        keys = band_keys(hashes, bands, rows, mix)
                    else:
                        keys = [xxhash.xxh64_intdigest(hashes.tobytes(), 2) - (1 << 63)]
                    out.append((PARAGRAPH, k, at, h, False, len(hashes), keys))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.int8(), batch.schema.field(0).type, pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "key", "at", "h", "again", "size", "keys"])

    rows_ = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).where("key is not null and text is not null")
    return rows_.mapInArrow(run, f"kind tinyint, key {rows_.schema['key'].dataType.simpleString()}, at int, h binary, again boolean, size int, keys array<bigint>")


def forest(ids: list[bytes], sets: list[np.ndarray], similar: float) -> Iterator[tuple[bytes, bytes]]:
    """Spanning forest of the pairs whose sets have at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    rest = np.arange(len(ids))
    built = 0
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            if not built or len(rest) <= built // 2:
                # Which of the rest hold a shingle: sorted by shingle, made anew as the rest halves.
                joined = np.concatenate([sets[i] for i in rest])
                holder = np.repeat(np.arange(len(rest)), sizes[rest])
                order = np.argsort(joined, kind="stable")
                joined, holder, base, built = joined[order], holder[order], rest, len(rest)
            low, high = np.searchsorted(joined, sets[at]), np.searchsorted(joined, sets[at], side="right")
            n = high - low
            hits = holder[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(base))[np.searchsorted(base, rest)]
            near = common >= similar * (sizes[rest] + sizes[at] - common)
            if near.any():
                yield from ((ids[at], ids[i]) for i in rest[near])
                queue += rest[near].tolist()
                rest = rest[~near]
        built = 0


def links(docs: DataFrame, marked: DataFrame, key: str, text: str, split: Split, similar: float) -> DataFrame:
    """Verified links (a, b) between different paragraphs that connect all similar pairs that collide in a band."""
    held = marked.where("keys is not null").select("h", "size", F.explode("keys").alias("bucket"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    full = held.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high"), blocks.alias("blocks")).where("low < high")
    rows = held.drop("size").join(full.select("bucket", "blocks"), "bucket").distinct()
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own")))))
    units = rows.groupBy("bucket", F.least("own", "other"), F.greatest("own", "other")).agg(F.sort_array(F.collect_set("h")).alias("hs")).where("size(hs) > 1")
    # The same paragraphs often collide in several bands: one unit for them.
    units = materialize(units.select("hs").groupBy("hs").agg(F.lit(1)).select(F.xxhash64("hs").alias("unit"), "hs"), "units")
    asked = units.select(F.explode("hs").alias("h")).distinct()
    # One document for each paragraph, found before the join: a paragraph may be in most of them.
    where = marked.groupBy("h").agg(F.min("key").alias("key")).join(asked, "h")
    wanted = where.groupBy("key").agg(F.collect_list("h").alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, hs in zip(batch.column(0), batch.column(1), strict=True):
                left = set(hs.as_py())
                for _, words in split(t.as_py()):
                    h = identity(words)
                    if h in left:
                        left.remove(h)
                        out.append((h, shingle_hashes(words).tobytes()))
            h, s = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(s, pa.binary())], names=["h", "shingles"])

    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")
    sets = texts.join(wanted, "key").select("text", "hs").mapInArrow(run, "h binary, shingles binary").dropDuplicates(["h"])
    whole = units.select("unit", F.explode("hs").alias("h")).join(sets, "h").groupBy("unit").agg(F.collect_list(F.struct("h", "shingles")).alias("members"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit in batch.column(0):
                members = unit.values
                ids = members.field("h").to_pylist()
                out += forest(ids, [np.frombuffer(s.as_py(), np.uint64) for s in members.field("shingles")], similar)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return whole.select("members").mapInArrow(verify, "a binary, b binary")


def repeated_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR, recall: float = RECALL, exact: bool = True) -> DataFrame:
    """(kind, key, at, class_id, shared, removed) for each part that is in a class of two or more.

    ``PARAGRAPH``: lines of at least ``min_words`` words; a class holds those linked by a Jaccard similarity of at least
    ``similar`` over five-word shingles, copies included. ``SHORT_LINE``: other lines with a word; a class holds equal ones, but for case and
    blanks. ``STRETCHES``: stretches of the words of the whole text, in classes of equal ones. ``at`` is the line, or
    for stretches the first word. ``class_id`` is the smallest key in the class; the first part of that document
    stays, all others are removed. ``shared`` tells whether the class lies in several documents. Rows with a null key or text have no
    parts; rows of one key are one document's. An empty table gives an empty result. Without ``exact`` there are paragraphs only.
    """
    bands, rows = tune_bands(similar, recall)
    every = materialize(signatures(docs, key, text, min_words, bands, rows, similar, exact), "paragraphs")
    marked = every.where(F.col("kind") == PARAGRAPH)
    roots = components(links(docs, marked, key, text, partial(paragraphs, min_words=min_words), similar))
    # One place for each different paragraph first: a paragraph may be in most documents.
    different = marked.groupBy("h").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n"), F.max("key").alias("last"))
    linked = different.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    classes = linked.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("last").alias("last")).where("n > 1")
    named = linked.select("h", "root").join(classes, "root").select("h", "first", "last")
    removed = F.struct("key", "at") != F.col("first")
    found = marked.select("kind", "key", "at", "h").join(named, "h").select("kind", "key", "at", F.col("first.key").alias("class_id"), (F.col("first.key") < F.col("last")).alias("shared"), removed.alias("removed"))
    if not exact:
        return found
    others = every.where(F.col("kind") != PARAGRAPH).select("kind", "key", "at", "h", "again")
    equal = others.groupBy("kind", "h").agg(F.min("key").alias("class_id"), F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1")
    met = others.join(equal, ["kind", "h"])
    return found.unionByName(met.select("kind", "key", "at", "class_id", (F.col("class_id") < F.col("last")).alias("shared"), ((F.col("key") != F.col("class_id")) | F.col("again")).alias("removed")))


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(key, at, class_id, removed) for each paragraph that is in a class of two or more, see ``repeated_parts``."""
    return repeated_parts(docs, key, text, min_words, similar, recall, exact=False).select("key", "at", "class_id", "removed")


def remove_paragraphs(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed paragraphs of ``found``; all rows and columns stay."""
    gone = found.where("removed").groupBy(F.col("key").alias("__key")).agg(F.collect_list("at").alias("__gone"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    joined = docs.join(gone, docs[key] == F.col("__key"), "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    return joined.select(docs.columns)


@query("op4_paragraphs")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its removed paragraphs (lines), the classes that its paragraphs and stretches share with other
    documents, its short lines that repeat earlier ones, and the word spans of passages that a smaller document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lists = lambda kind, when, what: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & when, F.col(what))))
    found = repeated_parts(docs).groupBy(F.col("key").alias("doc_id")).agg(
        lists(PARAGRAPH, F.col("removed"), "at").alias("removed"), lists(SHORT_LINE, F.col("removed"), "at").alias("short_removed"),
        F.sort_array(F.collect_set(F.when((F.col("kind") != SHORT_LINE) & F.col("shared"), F.col("class_id")))).alias("class_ids"),
        lists(STRETCHES, F.col("class_id") < F.col("key"), "at").alias("at"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    none = F.array().cast("array<int>")
    at = F.coalesce("at", none)
    # Stretches that overlap or touch are one span.
    starts = F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > STRETCH))
    ends = F.transform(F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > STRETCH)), lambda x: x + STRETCH)
    return out.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed", none).alias("removed"),
                      F.coalesce("class_ids", F.array().cast("array<bigint>")).alias("class_ids"), F.coalesce("short_removed", none).alias("short_removed"),
                      F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("passages"))
