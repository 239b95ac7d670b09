"""Language identification by compression.

Every language has a raw-content dictionary of sampled text. A text is compressed piece by piece with each
dictionary; the language whose dictionary gives the fewest bytes wins, and a narrow margin rejects the decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table, wider

UNKNOWN = "und"
#: Bound of the fit: bytes of sampled text kept for each language, and the most taken from one text.
DICT_BYTES = 65_536
SLICE_CHARS = 512
#: Pieces of this many bytes are compressed by themselves, so that a dictionary counts as much at the end of a long
#: text as at its start.
PIECE_BYTES = 4_096
LEVEL = 6
#: Bytes saved against the next best language, as a share of that one's bytes, below which a decision is rejected.
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the most frequent language first (ties of size go to it)."""

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", dict_bytes: int = DICT_BYTES) -> Model:
    """Sample up to ``dict_bytes`` of text for each language of ``rows``; null texts and languages teach nothing.

    One aggregate counts the different texts of each language; a hash of the text then picks about as many as fill
    a dictionary, so copies count once, and every row of a language has the same chance at any table size. Only
    the bounded sample reaches the driver. Without usable rows the model knows no language.
    """
    known = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null and length(text) > 0")
    known = known.withColumn("h", F.xxhash64("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("d")).collect()
    if not counts:
        return Model((), ())
    wanted = 4 * max(1, dict_bytes // SLICE_CHARS)
    # Hashes lie evenly in 2^32 slots: the first slots of a language hold about ``wanted`` different texts.
    slots = {r["lang"]: min(2**32, int(2**32 * wanted / max(1, r["d"])) + 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
    slot = F.shiftrightunsigned("h", 32)
    at = F.pmod(F.col("h"), F.greatest(F.length("text") - SLICE_CHARS, F.lit(0)) + 1).cast("int") + 1
    picked = known.where(slot < limit[F.col("lang")]).select("lang", "h", F.lower(F.substring(F.col("text"), at, F.lit(SLICE_CHARS))).alias("part"))
    kept: dict[str, list[tuple[int, str]]] = {}
    for r in picked.groupBy("lang", "h").agg(F.min("part").alias("part")).toLocalIterator():
        kept.setdefault(r["lang"], []).append((r["h"], r["part"]))
    langs, dictionaries = [], []
    for r in sorted(counts, key=lambda r: (-r["n"], r["lang"])):
        data = b"\n".join(part.encode() for _, part in sorted(kept.get(r["lang"], [])))
        if data:
            langs.append(r["lang"])
            dictionaries.append(data[:dict_bytes])
    return Model(tuple(langs), tuple(dictionaries))


class Classifier:
    """The model's compressors in one worker process."""

    def __init__(self, model: Model, level: int = LEVEL):
        self.langs = model.langs
        self.parts = []
        for data in model.dictionaries:
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.parts.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.parts]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (a half, and half the margin more) and margin."""
        if not text or not self.langs or LETTER.search(text) is None:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.langs[best], 0.5 + margin / 2, margin


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and accepted.

    ``lang_pred`` is the language of the fewest bytes; it is not accepted where the margin is narrow. A null text and
    one without a letter give `und`, score 0, not accepted; so does a model without languages. Rows are classified
    one by one from the whole text, so repeated rows get equal results. Columns of those names are replaced. The
    broadcast model is bounded by the languages times ``DICT_BYTES``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "margin", "accepted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            made = [classify(t.as_py()) for t in batch.column(text)]
            lang, score, gap = zip(*made, strict=True) if made else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64())]
            columns.append(pa.array([x != UNKNOWN and g >= margin for x, g in zip(lang, gap, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "margin", "accepted"])

    return docs.mapInArrow(run, wider(docs, "lang_pred string, score double, margin double, accepted boolean"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(docs.where("not held_out"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")
