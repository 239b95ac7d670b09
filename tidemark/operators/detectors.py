"""Unsupervised detectors: isolation forest, kernel mean and PCA reconstruction.

All score rows of ``features`` (array<double>); larger means more unusual.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators.forest import IsolationForest  # noqa: F401
from tidemark.operators.quantile import exact_quantiles
from tidemark.session import materialize


def feature_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


@dataclass
class KernelMean:
    """Distance from the mean of the training rows under a Gaussian kernel.

    Random Fourier features turn the kernel into a dot product, so the model is one mean vector.
    It takes the role of a one-class support vector machine; numbers differ.
    """

    weights: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    offset: float = 0.0

    @classmethod
    def fit(cls, df: DataFrame, gamma: float | str = "scale", nu: float = 0.1, size: int = 512, seed: int = 42) -> KernelMean:
        cells = df.select(F.explode("features").alias("v"))
        width = df.select(F.size("features")).first()[0]
        if gamma == "scale":
            spread = cells.agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (width * spread) if spread else 1.0
        rng = np.random.default_rng(seed)
        weights = rng.normal(0.0, math.sqrt(2.0 * float(gamma)), (width, size))
        shift = rng.uniform(0.0, 2.0 * math.pi, size)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(size), 0
            for pdf in batches:
                if len(pdf):
                    total += np.cos(np.stack(pdf["features"].to_numpy()) @ weights + shift).sum(axis=0)
                    n += len(pdf)
            yield pd.DataFrame({"total": [total], "n": [n]})

        parts = df.select("features").mapInPandas(sums, "total array<double>, n long")
        summed = parts.select(F.posexplode("total").alias("at", "v"), "n").groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        rows = {r["at"]: r["v"] / r["n"] for r in summed.collect()}
        model = cls(weights, shift, np.array([rows[i] for i in range(size)]) * 2.0 / size)
        scores = materialize(df.select(model._similarity().alias("s")), "kernel-scores")
        model.offset = exact_quantiles(scores, ["s"], [nu])["s"][0]
        return model

    def _similarity(self) -> Column:
        weights, shift, mean = self.weights, self.shift, self.mean

        @pandas_udf("double")
        def similarity(col: pd.Series) -> pd.Series:
            if not len(col):
                return pd.Series([], dtype=float)
            return pd.Series(np.cos(np.stack(col.to_numpy()) @ weights + shift) @ mean)

        return similarity("features")

    def score(self) -> Column:
        """Above 0 for the share ``nu`` of training rows with the least similarity."""
        return F.lit(self.offset) - self._similarity()


class Reconstruction:
    """Mean squared error of rebuilding a row from the first principal components."""

    def __init__(self, df: DataFrame, components: int = 10):
        width = df.select(F.size("features")).first()[0]
        row = df.agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(width)]).first()
        self.width, self.k = width, min(components, width)
        self.mean = [row[f"m{i}"] for i in range(width)]
        centred = df.select(array_to_vector(self._centred()).alias("x"))
        self.model = PCA(k=self.k, inputCol="x", outputCol="p").fit(centred)

    def _centred(self) -> Column:
        return F.zip_with("features", F.array(*[F.lit(m) for m in self.mean]), lambda v, m: v - m)

    def transform(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        def square(c: Column) -> Column:
            return F.aggregate(c, F.lit(0.0), lambda total, v: total + v * v)

        x = df.withColumn("x", array_to_vector(self._centred()))
        kept = self.model.transform(x)
        error = (square(vector_to_array("x")) - square(vector_to_array("p"))) / self.width
        return kept.withColumn(name, F.greatest(F.lit(0.0), error)).drop("x", "p")
