"""Probability calibration of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import Scorer, fit
from tidemark.operators.splits import equal_slices
from tidemark.session import materialize


class Sigmoid:
    """A logistic curve over one score."""

    def __init__(self, df: DataFrame, score: str = "score", label: str = "y", regularised: bool = True):
        rows = self._vector(df, score).withColumn("__y", F.col(label).cast("double"))
        n = df.count()
        reg = 1.0 / n if regularised and n else 0.0
        lr = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=1000, regParam=reg, standardization=False)
        self.model: LogisticRegressionModel = lr.fit(rows)

    @staticmethod
    def _vector(df: DataFrame, score: str) -> DataFrame:
        return VectorAssembler(inputCols=[score], outputCol="__x").transform(df)

    def transform(self, df: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
        # One coefficient and an intercept: a plain expression scores rows.
        a, b = float(self.model.coefficients[0]), float(self.model.intercept)
        return df.withColumn(name, 1.0 / (1.0 + F.exp(-(F.col(score) * a + b))))


class CrossCalibrated:
    """Models of three expanding slices, each with a sigmoid fitted on the rows behind it, averaged."""

    def __init__(self, train: DataFrame, n: int, kind: str, feature_cols: Sequence[str], label: str = "anomaly",
                 params: dict | None = None, folds: int = 3):
        self.members: list[tuple[Scorer, Sigmoid]] = []
        idx = F.col("idx")
        for f in equal_slices(n, folds):
            base = fit(train.where(idx < f.train_end), kind, feature_cols, label, params)
            held = train.where((idx >= f.train_end) & (idx < f.val_end))
            scored = materialize(base.transform(held, "score").select("score", F.col(label).alias("y")), "calibration")
            if scored.agg(F.count_distinct("y")).first()[0] == 2:
                self.members.append((base, Sigmoid(scored, regularised=False)))
        if not self.members:
            raise ValueError("no slice has both classes")

    def transform(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        out, parts = df, []
        for i, (base, curve) in enumerate(self.members):
            out = curve.transform(base.transform(out, f"__s{i}"), f"__s{i}", f"__c{i}")
            parts.append(F.col(f"__c{i}"))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return out.withColumn(name, total / len(parts)).drop(*[f"__{k}{i}" for k in "sc" for i in range(len(parts))])
