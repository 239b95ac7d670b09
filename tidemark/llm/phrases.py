"""Collocations: phrases whose words occur together more often than apart, found by best-first branch-and-bound growth.

No phrase that begins or ends with x scores more than floor(scale * n / f(x)), since one part of some cut of it is x and the other is
no rarer than the phrase. Each round opens the counted phrases of the highest such bounds: one pass over the texts
counts every phrase one word longer that begins or ends with an opened one. A candidate's score needs the counts of its parts only, and
whether it is dropped needs the phrases one word longer only. The search ends once no unopened phrase has a bound that reaches the
last place's score among the candidates not dropped: those are then all opened, and everything unknown scores less.

Passes select positions by bitmaps of a fixed size over hashes of phrases, so what is broadcast does not grow. A false hit
counts more phrases than asked for, and is remembered as such by the same bitmaps; counts are of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize

LONGEST = 5
LEAST = 100
MOST = 2_000
SHARE = 100
SCALE = 1_000
#: A round opens what may reach place AHEAD * MOST, which saves passes over the texts.
AHEAD = 4
#: Size of a bitmap.
BITS = 1 << 24
#: Bytes of text worked on together.
SLICE = 1 << 21
#: Bytes of text hashed at once.
BLOCK = 1 << 16
SALTS = 64
#: A-Z to a-z, ends of pieces to full stops, tabs to blanks.
LOWER = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a stretch and the word behind it."""
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + following
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def language_hash(lang: str) -> np.ndarray:
    return np.full(1, xxhash.xxh64_intdigest(lang.encode()), np.uint64)


class Bitmap:
    """A set of hashes; may hold more than was put in, never less."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits, self.packed = bits, np.zeros(bits // 8, np.uint8) if packed is None else packed
        self.empty = not self.packed.any()

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(h), bool)
        at = (h % np.uint64(self.bits)).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def __or__(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.bits, self.packed | other.packed)


def bitmaps(phrases: DataFrame, bits: int, levels: int) -> dict[int, Bitmap]:
    """Bitmap for each number of words 1 to ``levels`` of (lang, m, phrase); of a fixed size whatever the table's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                words = spans(phrase.encode())[3]
                at.append(int(reduce(folded, [words[i:i + 1] for i in range(len(words))], language_hash(lang))[0] % np.uint64(bits)))
            at = np.array(at, np.int64)
            # As signed words of 64 bits.
            bit = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("m"), pa.array(at >> 6), pa.array(bit)], names=["m", "word", "bit"])

    rows = phrases.select("lang", "m", "phrase").mapInArrow(run, "m int, word bigint, bit bigint").groupBy("m", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    m, word, value = (rows.column(c).to_numpy() for c in ("m", "word", "bits"))
    out = {}
    for level in range(1, levels + 1):
        packed = np.zeros(bits // 64, np.int64)
        packed[word[m == level]] = value[m == level]
        out[level] = Bitmap(bits, packed.view(np.uint8))
    return out


def slices(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased text with a full stop for each end of a piece) of about ``SLICE`` bytes."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        raw = text.as_py()
        held.setdefault(lang, []).append(raw.translate(LOWER))
        size[lang] = size.get(lang, 0) + len(raw)
        if size[lang] >= SLICE:
            yield lang, b".".join(held.pop(lang))
            size.pop(lang)
    for lang, parts in held.items():
        yield lang, b".".join(parts)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    odd = 0x9E3779B97F4A7C15
    if n <= BLOCK:
        return tuple(x[:n] for x in _powers(BLOCK, odd))
    return _powers.__wrapped__(n, odd)


@cache
def _powers(n: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))[:n] for x in (odd, pow(odd, -1, 1 << 64)))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, number of the piece and hash of each word."""
    chars = np.frombuffer(data, np.uint8)
    stop = chars == ord(".")
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = ~stop & (chars != ord(" "))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(stop, dtype=np.int32)[start]
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        # Words of about BLOCK bytes: what is held for each byte stays small.
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK)))
        low, high = int(start[at]), int(end[to - 1])
        up, down = powers(high - low)
        with np.errstate(over="ignore"):
            # A polynomial over the bytes of a word: differences of running sums, brought to one exponent.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(down * chars[low:high])])
            h[at:to] = folded((sums[end[at:to] - low] - sums[start[at:to] - low]) * up[start[at:to] - low], (end[at:to] - start[at:to]).astype(np.uint64))
        at = to
    return start, end, piece, h


COUNTS = "lang string, m int, phrase binary, f bigint"


def rows_of(lang: str, m: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, m, np.int32)), phrases, pa.array(counts.astype(np.int64))], names=["lang", "m", "phrase", "f"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words as the phrase null."""
    for batch in batches:
        for lang, data in slices(batch):
            coded = pa.array(data.replace(b".", b" ").split(), pa.binary()).dictionary_encode()
            yield rows_of(lang, 1, coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
            yield rows_of(lang, 1, pa.nulls(1, pa.binary()), np.array([len(coded)]))


def counter(opened: dict[int, Bitmap], before: dict[int, Bitmap], frequent: dict[int, Bitmap]):
    """Counts of phrases that begin or end with one just opened, unless one opened before has had them counted, or their
    parts are known to be rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in slices(batch):
                start, end, piece, word = spans(data)
                h = folded(language_hash(lang), word)
                usable = frequent[1].has(h)
                for m in range(1, len(opened) + 1):
                    # Here h and usable are of the m words from each position on; usable leaves out what is known to be rare.
                    if len(h) < 2:
                        break
                    both = usable[:-1] & usable[1:] & (piece[m:] == piece[:-m])
                    # Most positions end here; the bitmaps are asked for the others.
                    at = np.flatnonzero(both)
                    old = before[m].has(h[at]) | before[m].has(h[at + 1])
                    taken = at[~old & (opened[m].has(h[at]) | opened[m].has(h[at + 1]))]
                    longer = np.zeros(len(h) - 1, np.uint64)
                    longer[at] = folded(h[at], word[at + m])
                    if len(taken):
                        yield grouped(lang, m + 1, data, start, end, taken, longer[taken])
                    if m < len(opened):
                        rare = at[old]
                        both[rare[~frequent[m + 1].has(longer[rare])]] = False
                    h, usable = longer, both

    return run


def grouped(lang: str, m: int, data: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Counts of the phrases of m words from the given positions on. Hashes only sort; words decide what is equal."""
    at = at[np.argsort(h, kind="stable")]
    asked = np.zeros(len(start), bool)
    for j in range(m):
        asked[at + j] = True
    some = np.flatnonzero(asked)
    coded = pa.array([data[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)], pa.binary()).dictionary_encode()
    ids = np.zeros(len(start), np.int32)
    ids[some] = coded.indices.to_numpy()
    new = np.ones(len(at), bool)
    new[1:] = False
    for j in range(m):
        new[1:] |= ids[at[1:] + j] != ids[at[:-1] + j]
    first = np.flatnonzero(new)
    phrases = pc.binary_join_element_wise(*[coded.dictionary.take(pa.array(ids[at[first] + j])) for j in range(m)], pa.scalar(b" ", pa.binary()))
    return rows_of(lang, m, phrases, np.diff([*first, len(at)]))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "m", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of the candidates of which all parts are counted: the cut of the lowest score."""
    cuts = known.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), "n", F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("first", part(F.col("words"), F.lit(1), F.col("k"))).withColumn("rest", part(F.col("words"), F.col("k") + 1, F.col("m") - F.col("k"))).drop("words")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cuts.join(left, ["lang", "first"], "left").join(right, ["lang", "rest"], "left")
    # Up to 10 ** 17 occurrences: products stay within 38 digits.
    cut = cut.withColumn("score", F.expr(f"(cast({SCALE} as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    lowest = cut.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.count_if(F.col("score").isNull()).alias("unknown"))
    return lowest.where("unknown = 0").select("lang", "phrase", "m", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def left_over(candidates: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """The candidates that no phrase one word longer has ``share`` percent of the occurrences of; one that holds more words is
    no more frequent than the one in between."""
    words = F.split("phrase", " ")
    inner = F.explode(F.array(part(words, F.lit(1), F.col("m") - 1), part(words, F.lit(2), F.col("m") - 1)))
    longer = known.where("m > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("covered"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("covered") < share * F.col("a"), F.lit(True))).drop("covered")


def first_places(candidates: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank; first within salts, so that no task sorts all of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE, ahead: int = AHEAD, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases by score, occurrences and phrase.

    Texts are lower-cased (A-Z), split into pieces at .,;:!? and line ends, and those into words at blanks and tabs. Candidates are phrases of 2 to
    ``longest`` words that occur ``least`` times or more (a) within pieces, overlaps included; of the cuts into two parts
    that occur l and r times, the one of the lowest score floor(1000 a n / (l r)) counts, ties to the shortest first part; n counts all words of
    the language. Candidates inside a longer one that has ``share`` percent of their occurrences are dropped. A null
    text has no words, a null language is ``und``; an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")
    sums = materialize(summed(rows.mapInArrow(count_words, COUNTS)).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals = sums.where("phrase is null").select("lang", F.col("f").alias("n"))
    known = sums.where("phrase is not null").join(totals, "lang")
    empty = Bitmap(bits)
    before = {m: empty for m in range(1, longest)}
    spark = docs.sparkSession
    done = None  # phrases opened so far
    while True:
        left = materialize(left_over(scored(known), known, share), "candidates")
        places = materialize(first_places(left, ahead * most).select("lang", "rank", "score"), "places")
        last = lambda place: places.where(F.col("rank") == place).select("lang", F.col("score").alias("last"))
        bound = known.where(F.col("m") < longest).withColumn("bound", F.expr(f"(cast({SCALE} as decimal(4,0)) * cast(n as decimal(17,0))) div cast(f as decimal(17,0))"))
        if done is not None:
            bound = bound.join(done, ["lang", "phrase"], "left_anti")
        reach = lambda place: bound.join(last(place), "lang", "left").where(F.coalesce(F.col("bound") >= F.col("last"), F.lit(True)))  # noqa: E731, B023
        if reach(most).isEmpty():
            break
        opening = materialize(reach(ahead * most).select("lang", "m", "phrase"), "opening")
        opened, frequent = bitmaps(opening, bits, longest - 1), bitmaps(known, bits, longest - 1)
        shared = spark.sparkContext.broadcast((opened, before, frequent))
        found = summed(rows.mapInArrow(lambda b: counter(*shared.value)(b), COUNTS)).where(F.col("f") >= least)  # noqa: B023
        known = materialize(known.unionByName(found.join(totals, "lang")), "known")
        shared.unpersist()
        before = {m: before[m] | opened[m] for m in before}
        keys = opening.select("lang", "phrase")
        done = keys if done is None else materialize(done.unionByName(keys), "opened")
    return first_places(left, most).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = """with d as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
  p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
  w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
  s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
  g as (select lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) as m from s),
  f as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*) as f from g group by all),
  t as (select lang, sum(f) as n from f where m = 1 group by lang),
  c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1 and f >= 100),
  k as (select *, unnest(range(1, m)) as k from c),
  q as (select k.lang, k.phrase, k.m, k.a, k.k, x.f as l, y.f as r, t.n, (1000::hugeint * k.a * t.n) // (x.f::hugeint * y.f) as score from k join t on t.lang = k.lang
    join f x on x.lang = k.lang and x.phrase = array_to_string(k.ws[1:k.k], ' ') and x.m = k.k join f y on y.lang = k.lang and y.phrase = array_to_string(k.ws[k.k + 1:], ' ') and y.m = k.m - k.k),
  b as (select * from q qualify row_number() over (partition by lang, phrase order by score, k) = 1),
  o as (select * from b where not exists (select 1 from c where c.lang = b.lang and c.m > b.m and c.a * 100 >= 100 * b.a and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from o
  qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""


@query("op13_phrases", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
