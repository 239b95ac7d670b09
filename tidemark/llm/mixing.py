"""Mixing to target weights with soft domains.

A classifier fitted on a labelled table gives every document a posterior over domains. Projected gradient steps then fit
nonnegative document rates by least squares, so that the expected tokens of each domain, summed over rate times
posterior times length, come as near to the targets as nonnegative rates allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.quality import words_of
from tidemark.llm.registry import query, table, wider
from tidemark.session import materialize

#: Bound of the fit: about this many labelled rows, an equal number of each domain, picked by a hash of the text.
SAMPLE_ROWS = 8_000
#: More domains than this are no domains.
MOST_DOMAINS = 1_000
FEATURES = 1 << 13
STEPS = 60
DONE = 1e-4
TARGETS = {"good": 0.80, "poor": 0.12, "toxic": 0.08}
#: Weights of the pipeline, in which documents that are most likely of this domain stay once at least.
KEPT_TARGETS = {"good": 0.95, "poor": 0.01, "toxic": 0.04}
KEPT_DOMAIN = "good"


@dataclass(frozen=True)
class Domains:
    """Fitted classifier: the pipeline over a column ``words``, and the domains by class number."""

    model: PipelineModel | None
    names: tuple[str, ...]


def words(text: str) -> Column:
    return words_of(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def domain_counts(rows: DataFrame) -> dict[str, int]:
    """Rows of each domain; over ``MOST_DOMAINS`` domains are an error."""
    counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().limit(MOST_DOMAINS + 1).collect()}
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"over {MOST_DOMAINS} domains")
    return counts


def by_domain(values: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("domain") == n, F.lit(float(v))) for n, v in values.items()])


def sampled(rows: DataFrame, key: str, counts: dict[str, int], size: int) -> DataFrame:
    """About ``size`` of ``rows`` picked by a hash of ``key``, with the weight of each, the rows that it stands for.

    Every domain gives the same number of rows, all of them if it has little more, so that a rare domain is not missed."""
    each = max(1, size // max(1, len(counts)))
    shares = {n: 1.0 if c <= 4 * each else each / c for n, c in counts.items()}
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 40))
    share = by_domain(shares)
    return rows.where(place < share * float(1 << 40)).withColumn("weight", 1.0 / share)


def fit_domains(labelled: DataFrame, text: str = "text", domain: str = "domain", rows: int = SAMPLE_ROWS) -> Domains:
    """Fit on about ``rows`` of the rows that have a domain, or on all where a column ``weight`` tells that they are a sample.

    A hash of the text picks them, so copies stay together; see ``sampled``. Rows count by their weight, so posteriors keep
    the table's shares. With one domain, or none, there is nothing to fit: every document belongs to it with certainty.
    """
    known = labelled.select(F.col(f"`{domain}`").alias("domain"), F.col(f"`{text}`").alias("text"), *(["weight"] if "weight" in labelled.columns else [])).where("domain is not null")
    counts = domain_counts(known)
    names = tuple(sorted(counts))
    if len(names) < 2:
        return Domains(None, names)
    picked = known if "weight" in known.columns else sampled(known, "text", counts, rows)
    sample = materialize(picked.select(words("text").alias("words"), by_domain({n: i for i, n in enumerate(names)}).alias("label"), "weight"), "sample")
    held = [int(r["label"]) for r in sample.select("label").distinct().collect()]
    if len(held) < 2:
        return Domains(None, tuple(names[i] for i in held) or names[:1])
    stages = [
        HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="counts", binary=True), IDF(inputCol="counts", outputCol="weighed", minDocFreq=2),
        Normalizer(inputCol="weighed", outputCol="features"), LogisticRegression(family="multinomial", regParam=1e-4, maxIter=25, weightCol="weight"),
    ]
    return Domains(Pipeline(stages=stages).fit(sample), names)


def posteriors(docs: DataFrame, domains: Domains, text: str = "text") -> DataFrame:
    """``docs`` with tokens (words of the text; a null text has none) and p, the posterior of each domain."""
    rows = docs.withColumn("words", words(text))
    tokens = F.size("words").cast("bigint")
    if domains.model is None:
        return rows.withColumns({"tokens": tokens, "p": F.array(*[F.lit(1.0)] * max(1, len(domains.names)))}).drop("words")
    out = domains.model.transform(rows)
    # Domains behind the last that the sample has have no chance. The probability is used once, so that it is computed once.
    rest = len(domains.names) - domains.model.stages[-1].numClasses
    p = F.concat(vector_to_array("probability"), F.array(*[F.lit(0.0)] * rest).cast("array<double>"))
    return out.withColumns({"tokens": tokens, "p": p}).drop("words", "counts", "weighed", "features", "rawPrediction", "probability", "prediction")


class Fit(NamedTuple):
    """Rows with their rate; steps taken, whether the last one hardly changed the error, and the relative error of all domains."""

    rows: DataFrame
    steps: int
    converged: bool
    error: float


def stepped(batch: pa.RecordBatch, errors: list[list[float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and posteriors of the rows (tokens, p, __least), and their rates after a step for each of ``errors``, from one on."""
    tokens = batch.column("tokens").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    least = batch.column("__least").to_numpy(zero_copy_only=False)
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), k)
    rate = np.ones(len(tokens))
    for error in errors:
        slope = np.zeros(len(tokens))
        for i, e in enumerate(error):
            slope += p[:, i] * e
        rate = np.where(tokens == 0, rate, np.maximum(least, rate - slope))
    return tokens, p, rate


def fit_rates(rows: DataFrame, targets: list[float], least: float | Column = 0.0, steps: int = STEPS) -> Fit:
    """``rows`` (with tokens and p) and their rate of at least ``least`` (one for all or a column), by projected gradient descent.

    ``targets`` are the wanted tokens of each domain. Squared errors are weighed by the domain's tokens at rate one
    and steps by the document's, which makes one the largest curvature, so that full steps descend. A step needs only
    the domains' totals, one small aggregate. A row's rate follows from the errors of all steps so far, so nothing is written
    between steps and the plan of a step does not grow. Documents without tokens keep rate one. Domains without tokens have no say.
    """
    k = len(targets)
    rows = rows.withColumn("__least", (least if isinstance(least, Column) else F.lit(least)).cast("double"))
    errors: list[list[float]] = []

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k)
        for batch in batches:
            tokens, p, rate = stepped(batch, errors, k)
            found += (tokens[:, None] * p * rate[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], names=[f"s{i}" for i in range(k)])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["__least"]).append_column("rate", pa.array(stepped(batch, errors, k)[2]))

    def reached() -> list[float]:
        parts = rows.select("tokens", "p", "__least").mapInArrow(totals, ", ".join(f"s{i} double" for i in range(k)))
        now = parts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).first()
        return [now[f"s{i}"] or 0.0 for i in range(k)]

    base = now = reached()
    worst = None
    while True:
        error = [(now[i] - targets[i]) / base[i] if base[i] else 0.0 for i in range(k)]
        size = sum(e * e * b for e, b in zip(error, base, strict=True))
        converged = worst is not None and worst - size <= DONE * DONE * max(1.0, worst)
        if converged or len(errors) == steps:
            break
        worst = size
        errors.append(error)
        now = reached()

    whole = sum(targets)
    missed = sum(abs(now[i] - t) for i, t in enumerate(targets) if base[i])
    return Fit(rows.mapInArrow(rated, wider(rows.drop("__least"), "rate double")), len(errors), converged, missed / whole if whole else 0.0)


class Mixture(NamedTuple):
    """Rows (key, tokens, p, rate, copies), the domains, and the fit of the rates (none where no weight is left)."""

    rows: DataFrame
    domains: Domains
    fit: Fit | None


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None, key: str = "doc_id", text: str = "text", kept: str | None = None) -> Mixture:
    """(key, tokens, p, rate, copies) for each row of ``docs``, with the domains and the fit.

    ``targets`` are weights of the domains of ``labelled`` (text, domain); weights of domains that do not occur are
    dropped and the others scaled to one; no weight left means rates of one. ``tokens`` is the size of the mixture,
    the table's own by default. ``copies`` is the rate rounded up or down by a hash of key and text, so that its
    mean is the rate; repeated rows get equal copies. Documents most likely of the domain ``kept`` have a rate of at least one, all
    others of at least zero. Null keys and texts are rows like others; an empty table gives an
    empty result.
    """
    domains = fit_domains(labelled)
    rows = posteriors(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), domains)
    rows = materialize(rows.withColumn("u", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)).drop("text"), "posteriors")
    weights = [max(0.0, targets.get(n, 0.0)) for n in domains.names]
    fit = None
    if sum(weights) > 0:
        whole = float(tokens if tokens is not None else rows.agg(F.sum("tokens")).first()[0] or 0)
        least = F.when(F.col("p")[domains.names.index(kept)] >= F.array_max("p"), 1.0).otherwise(0.0) if kept in domains.names else 0.0
        fit = fit_rates(rows, [whole * w / sum(weights) for w in weights], least)
        rows = fit.rows
    else:
        rows = rows.withColumn("rate", F.lit(1.0))
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return Mixture(rows.select("key", "tokens", "p", "rate", copies.cast("int").alias("copies")), domains, fit)


def labelled_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, domain, weight): a sample of the documents with quality and toxicity labels, equal labels once.

    Labels are sampled before texts are looked up, so the texts of other documents are not moved. The sample is counted, and
    sent to all tasks if it is as small as expected.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    known = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").distinct()
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    picked = materialize(sampled(known, "doc_id", domain_counts(known), rows), "picked")
    few = F.broadcast(picked) if picked.count() <= 8 * rows else picked
    return docs.select("doc_id", "text").join(few, "doc_id").select("text", "domain", "weight")


def repeat_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the weights in ``KEPT_TARGETS`` ask for; those most likely good stay once at least,
    others may go.

    The mixture is a tenth larger than the documents, which leaves room for the copies.
    """
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    size = docs.agg(F.sum(F.size(words("text")))).first()[0] or 0
    found = mix(keyed, labelled_documents(docs, table(spark, sf_dir, "labels")), KEPT_TARGETS, tokens=1.1 * size, key="__key", kept=KEPT_DOMAIN).rows
    other = found.where("copies != 1").select(F.col("key").alias("__key"), "copies").distinct()
    again = keyed.join(other, "__key", "left").withColumn("__n", F.coalesce("copies", F.lit(1))).where("__n > 0")
    again = again.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return again.select([F.col(f"`{c}`") for c in docs.columns])


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, domains, _ = mix(docs, labelled_documents(docs, table(spark, sf_dir, "labels")), TARGETS)
    parts = [F.round(F.col("p")[i], 6).alias(f"p_{n}") for i, n in enumerate(domains.names)]
    return found.select(F.col("key").alias("doc_id"), "tokens", *parts, F.round("rate", 6).alias("rate"), "copies")
