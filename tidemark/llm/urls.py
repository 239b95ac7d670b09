"""URL filters: rules, and a classifier over segmented host names for what no rule fits.

Host labels are cut into words by a unigram Viterbi search; a multinomial naive Bayes model over the words of host
and path, fitted on the urls that rules decide, judges the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize

SUBSTRINGS = 50_000  # of labels, held by a task at once
@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def after(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(after(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1), capitals, capitals.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(name, verdict) of the longest rule that fits host or a domain above it and the start of the path, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): counts of the lower-cased letter runs between the tags of all rows."""
    bare = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """Words of the cheapest split; a letter that starts no known word costs ``unknown``. Ties: longer last words."""
    best = [(0.0, 0)]
    lengths = sorted({1, *map(len, cost)})
    for end in range(1, len(label) + 1):
        choices = []
        for n in lengths:
            start = end - n
            if start < 0:
                break
            price = cost.get(label[start:end], unknown if n == 1 else None)
            if price is not None:
                choices.append((best[start][0] + price, start))
        best.append(min(choices))
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for each different non-empty label, cut into words by the unigram counts.

    Only the substrings of a label meet the counts, by a join, so the vocabulary is never sent around; they have the lengths that
    occur among the words, whatever those are. Copies of a label are segmented once. Letters that belong to no known word stay together.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels = labels.select("label").where("label <> ''").distinct().withColumn("id", F.md5("label"))
    longest = labels.agg(F.coalesce(F.max(F.length("label")), F.lit(0))).first()[0]
    # Different lengths, not words: as many as the longest label has letters at most.
    lengths = sorted(r[0] for r in counts.select(F.length("word").alias("k")).where(F.col("k") <= longest).distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for key, label in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                for start in range(len(label)):
                    found.update((key, label[start:start + n]) for n in lengths if start + n <= len(label))
                    if len(found) >= SUBSTRINGS:
                        yield as_batch(found)
                        found = set()
            yield as_batch(found)

    def as_batch(found: set[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["id", "word"])

    parts = labels.mapInArrow(cut, "id string, word string")
    known = parts.join(counts, "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    rows = labels.join(known, "id", "left").select("label", "known")
    unknown = math.log(total + 1) + 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for label, found in zip(*batch.columns, strict=True):
                cost = {w: math.log(total / n) for w, n in found.as_py() or ()}
                parts: list[str] = []
                for known_, run_ in groupby(viterbi(label.as_py(), cost, unknown), cost.__contains__):
                    parts += run_ if known_ else ["".join(run_)]
                words.append(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    return rows.mapInArrow(run, "label string, words array<string>")


def labels_of(host: Column) -> Column:
    return F.filter(F.split(host, "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    """Lower-cased tokens of a path; digits all count as `0`, so that numbers share a token by length."""
    parts = F.split(F.regexp_replace(F.lower(path), r"\p{N}", "0"), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))


def judge(urls: DataFrame, counts: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    The longest fitting rule decides. Other rows go to the naive Bayes model over segmented host words and path
    tokens, fitted on all rows that a rule decided (copies count as often as they occur); add-one smoothing, equal
    scores allow, and so does a table in which no rule fits. A null url, or one without `://`, has an empty host and
    path and falls to the priors. Scores are computed once for each different pair of host and path. Columns of the
    names host, path, rule and verdict are replaced.
    """
    rows = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    # Numbers share a token by length, so urls that differ in them only are judged together.
    rows = rows.withColumn("__shape", F.concat_ws(" ", path_tokens(F.col("path")))).withColumn("__found", rule_of(F.col("host"), F.col("path"), rules))
    shapes = materialize(rows.groupBy("host", F.col("__shape").alias("shape"), F.col("__found.verdict").alias("verdict")).agg(F.count("*").alias("n")), "shapes")
    cut = materialize(segment(shapes.select(F.explode(labels_of(F.col("host"))).alias("label")), counts), "segments")
    pairs = shapes.select("host", "shape").distinct()
    host_words = shapes.select("host").distinct().select("host", F.explode(labels_of(F.col("host"))).alias("label")).join(cut, "label")
    host_words = host_words.groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    whole = pairs.join(host_words, "host", "left").select("host", "shape", F.concat(F.coalesce("words", F.array().cast("array<string>")), F.filter(F.split("shape", " "), lambda x: x != "")).alias("tokens"))
    tokens = materialize(whole.select("host", "shape", F.explode_outer("tokens").alias("token")).groupBy("host", "shape", "token").agg(F.count("token").alias("times")), "tokens")
    taught = tokens.join(shapes.where("verdict is not null"), ["host", "shape"]).where("token is not null").groupBy("token").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("times") * F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
    taught = materialize(taught, "taught")
    sums = taught.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("words")).first()
    prior = {r["verdict"]: r["n"] for r in shapes.where("verdict is not null").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    start = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1))
    size = {v: (sums[v] or 0) + sums["words"] + 1 for v in ("allow", "block")}
    gain = F.log((F.coalesce("block", F.lit(0)) + 1) / F.lit(float(size["block"]))) - F.log((F.coalesce("allow", F.lit(0)) + 1) / F.lit(float(size["allow"])))
    asked = shapes.where("verdict is null").select("host", "shape").distinct()
    score = tokens.join(asked, ["host", "shape"]).join(taught, "token", "left").groupBy("host", "shape").agg(
        F.round(F.sum(F.when(F.col("token").isNotNull(), F.col("times") * gain).otherwise(0.0)) + start, 9).alias("score"))
    score = score.select("host", F.col("shape").alias("__shape"), F.when(F.col("score") > 0, "block").otherwise("allow").alias("__judged"))
    out = rows.join(score, ["host", "__shape"], "left")
    return out.select(*[F.col(f"`{c}`") for c in urls.drop("host", "path", "rule", "verdict").columns], "host", "path", F.col("__found.rule").alias("rule"), F.coalesce("__found.verdict", "__judged").alias("verdict"))


@query("op8_urls")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    counts = materialize(word_counts(pages), "words")
    return judge(pages.select("page_id", "url"), counts).select("page_id", "host", "path", "rule", "verdict")
