"""Classifiers: build, fit, score, save and load. All but the forest of outliers, deep random forests and histogram boosting are MLlib's."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scale as sc
from tidemark.operators.deepforest import DeepForest, deep
from tidemark.operators.detectors import IsolationForest, feature_array
from tidemark.operators.histboost import HistBoost, Settings
from tidemark.operators.quantile import exact_quantiles

# Settings of the model kinds.
DEFAULTS = {
    "LogisticRegression": {"maxIter": 2000},
    "RandomForest": {"numTrees": 400, "maxDepth": 30, "minInstancesPerNode": 1, "seed": 42},
    "GradientBoosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "seed": 42},
    "HistGradientBoosting": {"maxIter": 300, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20, "maxBins": 255},
    "IsolationForest": {"trees": 400, "contamination": 0.01, "seed": 42},
}
WEIGHTED = ("LogisticRegression", "RandomForest")  # balanced class weights unless told otherwise


def estimator(kind: str, params: dict, label: str, weight: str | None, total_weight: float | None = None) -> Estimator:
    common = {"featuresCol": "features_vec", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if kind == "LogisticRegression":
        # The penalty 1 of a sum over rows is 1 / (sum of weights) of a mean over rows.
        reg = 1.0 / total_weight if total_weight else 0.0
        return LogisticRegression(**common, **{"regParam": reg, "elasticNetParam": 0.0, "standardization": False, **params})
    if kind == "RandomForest":
        return RandomForestClassifier(**common, **{"featureSubsetStrategy": "sqrt", "cacheNodeIds": False, **params})
    if kind == "GradientBoosting":
        return GBTClassifier(**common, **params)
    raise ValueError(f"unknown model: {kind}")


def hist_settings(params: dict) -> Settings:
    """Settings of histogram boosting from parameters under the names of the other kinds."""
    known = {"maxIter": "trees", "stepSize": "rate", "maxDepth": "depth", "minInstancesPerNode": "least_rows", "maxBins": "bins", "penalty": "penalty"}
    if unknown := set(params) - {*known, "seed"}:  # nothing is drawn, so a seed has no effect
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return Settings(**{known[k]: v for k, v in params.items() if k != "seed"})


@dataclass
class Scorer:
    """A fitted model with all it needs to score raw feature rows."""

    kind: str
    feature_cols: list[str]
    params: dict = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    scale: sc.Scale = field(default_factory=dict)
    threshold: float | None = None
    model: PipelineModel | None = None
    forest: IsolationForest | None = None
    boosted: HistBoost | None = None
    bagged: DeepForest | None = None

    def inputs(self, df: DataFrame) -> DataFrame:
        """Model inputs under their own names, so that the row keeps its raw features."""
        made = {}
        for i, c in enumerate(self.feature_cols):
            value = F.col(f"`{c}`").cast("double")
            value = F.when(~F.isnan(value), value)
            if c in self.medians or self.kind != "HistGradientBoosting":  # which has a side for missing values
                value = F.coalesce(value, F.lit(float(self.medians.get(c, 0.0))))
            if c in self.scale:
                centre, spread = self.scale[c]
                value = (value - F.lit(centre)) / F.lit(spread)
            made[f"__f{i}"] = value
        return df.withColumns(made)

    def input_names(self) -> list[str]:
        return [f"__f{i}" for i in range(len(self.feature_cols))]

    def transform(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """``df`` with the score, and ``is_alert`` if a threshold is set."""
        rows = self.inputs(df)
        if self.kind == "IsolationForest":
            rows = rows.withColumn("features", feature_array(self.input_names()))
            out = self.forest.transform(rows, name).drop("features")
        elif self.kind == "HistGradientBoosting":
            rows = rows.withColumn("features", feature_array(self.input_names()))
            out = rows.withColumn(name, self.boosted.score()).drop("features")
        elif self.bagged is not None:
            rows = rows.withColumn("features", feature_array(self.input_names()))
            out = rows.withColumn(name, self.bagged.score()).drop("features")
        else:
            out = self.model.transform(rows).withColumn(name, vector_to_array("probability")[1])
            out = out.drop("features_vec", "rawPrediction", "probability", "prediction")
        out = out.drop(*self.input_names())
        return out if self.threshold is None else out.withColumn("is_alert", F.col(name) >= F.lit(self.threshold))

    def importances(self) -> dict[str, float]:
        if self.boosted is not None:
            return dict(zip(self.feature_cols, map(float, self.boosted.importances())))
        if self.bagged is not None:
            return dict(zip(self.feature_cols, map(float, self.bagged.importances())))
        stage = self.model.stages[-1] if self.model else None
        if stage is None or not hasattr(stage, "featureImportances"):
            return {}
        return dict(zip(self.feature_cols, map(float, stage.featureImportances.toArray())))

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"kind": self.kind, "feature_cols": self.feature_cols, "params": self.params, "medians": self.medians,
                "scale": self.scale, "threshold": self.threshold}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("errorifexists").parquet(f"{path}/meta")
        if self.forest is not None:
            self.forest.save(spark, f"{path}/forest")
        elif self.boosted is not None:
            self.boosted.save(spark, f"{path}/boosted")
        elif self.bagged is not None:
            self.bagged.save(spark, f"{path}/bagged")
        else:
            self.model.write().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        meta["scale"] = {c: tuple(v) for c, v in meta["scale"].items()}
        out = cls(**meta)
        if out.kind == "IsolationForest":
            out.forest = IsolationForest.load(spark, f"{path}/forest")
        elif out.kind == "HistGradientBoosting":
            out.boosted = HistBoost.load(spark, f"{path}/boosted")
        elif out.kind == "RandomForest" and deep(out.params):
            out.bagged = DeepForest.load(spark, f"{path}/bagged")
        else:
            out.model = PipelineModel.load(f"{path}/model")
        return out


def slice_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the columns that have values."""
    return {c: m[0] for c, m in exact_quantiles(train, cols, [0.5]).items() if m[0] is not None}


def fit(
    train: DataFrame,
    kind: str,
    feature_cols: Sequence[str],
    label: str = "anomaly",
    params: dict | None = None,
    scale: str | None = None,
    balanced: bool | None = None,
    ratio: bool = False,
    impute: bool = True,
    medians: dict[str, float] | None = None,
) -> Scorer:
    """Fit one model on a training slice.

    Missing values become the slice's exact medians, or the given ``medians``. ``scale`` is "robust", "standard" or None.
    ``balanced`` weights classes inversely to their size (default: logistic regression and random
    forest); ``ratio`` multiplies positives by negatives / positives on top of it.
    The isolation forest needs ``idx`` dense from 0 and no label.
    """
    params = {**DEFAULTS[kind], **(params or {})}
    cols = list(feature_cols)
    if medians is None:
        medians = slice_medians(train, cols) if impute else {}
    scorer = Scorer(kind, cols, params, medians)
    if scale:
        found = (sc.fit_robust if scale == "robust" else sc.fit_standard)(scorer.inputs(train), scorer.input_names())
        scorer.scale = {c: found[name] for c, name in zip(cols, scorer.input_names())}
    rows = scorer.inputs(train)
    if kind == "IsolationForest":
        data = rows.select("idx", feature_array(scorer.input_names()).alias("features"))
        n = data.count()
        scorer.forest = IsolationForest.fit(data, n, **params)
        return scorer
    use_balance = kind in WEIGHTED if balanced is None else balanced
    weight = total = None
    if use_balance or ratio:
        neg, pos = sc.class_counts(train, label)
        if neg and pos:
            value = sc.balanced_weight(label, neg, pos) if use_balance else F.lit(1.0)
            value = value * sc.ratio_weight(label, neg, pos) if ratio else value
            rows, weight = rows.withColumn("__w", value), "__w"
    if kind == "LogisticRegression":
        total = rows.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    if kind == "HistGradientBoosting":
        own = rows.select(feature_array(scorer.input_names()).alias("features"), label, *([weight] if weight else []))
        scorer.boosted = HistBoost.fit(own, label, hist_settings(params), weight)
        return scorer
    if kind == "RandomForest" and deep(params):
        own = rows.select(feature_array(scorer.input_names()).alias("features"), label, *([weight] if weight else []))
        scorer.bagged = DeepForest.fit(own, label, weight=weight, **params)
        return scorer
    keep = [*scorer.input_names(), label, *([weight] if weight else [])]
    rows = rows.select(*keep).withColumn(label, F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=scorer.input_names(), outputCol="features_vec")
    # The caller's table is read many times while trees grow: keep the assembled slice.
    ready = assembler.transform(rows).select("features_vec", label, *([weight] if weight else [])).persist()
    try:
        fitted = estimator(kind, params, label, weight, total).fit(ready)
    finally:
        ready.unpersist()
    scorer.model = PipelineModel([assembler, fitted])
    return scorer
