"""Detectors, classifiers, calibration and entry points on the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import RAW_SQL, events, events_line, raw_events, table
from tidemark.operators import detectors as det
from tidemark.operators import scale, splits
from tidemark.operators.calibrate import CrossCalibrated, Sigmoid
from tidemark.operators.features import family_columns
from tidemark.operators.isotonic import Isotonic
from tidemark.operators.knn import local_outlier_factor
from tidemark.operators.models import Scorer, fit
from tidemark.operators.order import timeline, windowed
from tidemark.plans import compare, detect, tuning
from tidemark.plans.common import prepare
from tidemark.plans.train import evaluate, latest_features, score_latest, train
from tidemark.session import materialize, new_path

KPI = ["value"]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("int").alias("y")
    )


def _cut(df) -> int:
    return int(df.count() * 0.7)


LOF_SQL = """with v as (select vec_id as id, cast(embedding as double[]) as f from embeddings), n as (select floor(count(*) * 0.7) as cut from v),
  tr as (select id, f from v, n where id < cut), te as (select id, f from v, n where id >= cut),
  p as (select a.id as q, b.id as r, list_distance(a.f, b.f) as d from tr a join tr b on a.id <> b.id),
  k as (select *, row_number() over (partition by q order by d, r) as i from p qualify i <= 20),
  kd as (select q as id, max(d) as kd from k group by q),
  lrd as (select k.q as id, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) as lrd from k join kd on kd.id = k.r group by k.q),
  p2 as (select a.id as q, b.id as r, list_distance(a.f, b.f) as d from te a, tr b),
  k2 as (select *, row_number() over (partition by q order by d, r) as i from p2 qualify i <= 20)
  select k2.q as idx, round(avg(lrd.lrd) * (avg(greatest(k2.d, kd.kd)) + 1e-10), 6) as anomaly_score
  from k2 join kd on kd.id = k2.r join lrd on lrd.id = k2.r group by k2.q"""


@query("lof", LOF_SQL)
def _(spark, d):
    rows = _vectors(spark, d)
    cut = _cut(rows)
    return rounded(local_outlier_factor(rows.where(F.col("idx") < cut), rows.where(F.col("idx") >= cut), "idx", 20))


@query("iforest")
def _(spark, d):
    rows = _vectors(spark, d)
    cut = _cut(rows)
    forest = det.IsolationForest.fit(rows.where(F.col("idx") < cut), cut)
    return forest.transform(rows).select("idx", "anomaly_score")


@query("iforest_share", """select row_number() over (order by ts, event_id) - 1 as idx, true as in_range, true as share_alerts, true as share_of_rows, true as outliers_first from events""")
def _(spark, d):
    line = events_line(spark, d)
    rows = line.df.select("idx", "value", det.feature_array(["value", "label"]).alias("features"))
    per_tree = det.IsolationForest.share_sizes(rows, 800, 0.8, 42).agg(F.avg("count"), F.max("count"), F.min("count")).first()
    # Rows of a tree are drawn one by one: their number keeps within six standard deviations of the share.
    spread = 6 * (line.n * 0.16) ** 0.5
    share = abs(per_tree[0] - 0.8 * line.n) <= spread / 800**0.5 and max(per_tree[1] - 0.8 * line.n, 0.8 * line.n - per_tree[2]) <= spread
    forest = det.IsolationForest.fit(rows, line.n, trees=800, max_samples=0.8, contamination=0.05)
    scored = materialize(forest.transform(rows, "s").select("idx", "value", "s"), "scored")
    # With ties on the cut fewer rows than the share lie above it, never more.
    above = scored.where("s > 0").count() <= 0.05 * line.n + 1
    # The largest and the smallest value are easier to cut off than the mean row.
    ends = scored.agg(F.max_by("s", "value"), F.min_by("s", "value"), F.avg("s")).first()
    first = ends[0] > ends[2] and ends[1] > ends[2]
    return scored.select("idx", F.col("s").between(-1.0, 1.0).alias("in_range"), F.lit(above).alias("share_alerts"), F.lit(share).alias("share_of_rows"), F.lit(first).alias("outliers_first"))


@query("kernel_outlier")
def _(spark, d):
    rows = _vectors(spark, d)
    return rows.select("idx", det.KernelMean.fit(rows.where(F.col("idx") < _cut(rows))).score().alias("anomaly_score"))


@query("pca_recon")
def _(spark, d):
    rows = _vectors(spark, d)
    return det.Reconstruction(rows.where(F.col("idx") < _cut(rows))).transform(rows).select("idx", "anomaly_score")


def _data(spark, d, family="D"):
    return prepare(events(spark, d).withColumnRenamed("label", "anomaly"), KPI, family, "anomaly", "ts", ["event_id"], family_columns(KPI, family))


def _fit_score(spark, d, kind, params, scale=None):
    data = _data(spark, d)
    split = splits.chrono_split(data.n)
    model = fit(data.slice(0, split.train_end), kind, data.feature_cols, params=params, scale=scale)
    return model.transform(data.df).select("idx", "anomaly", "anomaly_score")


@query("rf")
def _(spark, d):
    return _fit_score(spark, d, "RandomForest", {"numTrees": 20, "maxDepth": 10, "minInstancesPerNode": 2})


@query("gbt")
def _(spark, d):
    return _fit_score(spark, d, "GradientBoosting", {})


@query("hist_gbt")
def _(spark, d):
    return _fit_score(spark, d, "HistGradientBoosting", {})


@query("hist_gbt_rules", """select row_number() over (order by ts, event_id) - 1 as idx, true as in_range, true as loss_falls, true as leaf_sizes, true as gain_shares, true as missing_scored from events""")
def _(spark, d):
    data = _data(spark, d)
    train = data.slice(0, splits.chrono_split(data.n).train_end)
    model = fit(train, "HistGradientBoosting", data.feature_cols, impute=False)
    rows = lambda df: model.inputs(df).withColumn("features", det.feature_array(model.input_names()))
    steps = [0, 1, 10, 100, len(model.boosted.trees)]
    own = materialize(rows(train).select("anomaly", *[model.boosted.score(k).alias(f"p{k}") for k in steps], model.boosted.leaf_ids().alias("leaves")), "staged")
    loss = own.agg(*[F.avg(-F.log(F.when(F.col("anomaly") == 1, F.col(f"p{k}")).otherwise(1 - F.col(f"p{k}")))) for k in steps]).first()
    falls = len(model.boosted.trees) == 300 and all(a > b for a, b in zip(loss, loss[1:]))
    least = own.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().agg(F.min("count")).first()[0]
    shares = model.boosted.importances()
    whole = abs(shares.sum() - 1) < 1e-9 and (shares >= 0).all()
    scored = model.transform(data.df).select("idx", F.col("anomaly_score").between(0.0, 1.0).alias("in_range"))
    empty = model.transform(data.df.limit(1).withColumns({c: F.lit(None).cast("double") for c in data.feature_cols})).first()["anomaly_score"]
    flags = {"loss_falls": falls, "leaf_sizes": least >= 20, "gain_shares": bool(whole), "missing_scored": 0 < empty < 1}
    return scored.withColumns({k: F.lit(v) for k, v in flags.items()})


@query("logreg")
def _(spark, d):
    return _fit_score(spark, d, "LogisticRegression", {}, "robust")


def _held(spark, d):
    data = _data(spark, d)
    split = splits.chrono_split(data.n)
    model = fit(data.slice(0, split.train_end), "LogisticRegression", data.feature_cols, scale="robust")
    scored = model.transform(data.slice(split.train_end, data.n), "score").select("idx", F.col("anomaly").alias("y"), "score")
    return scored, scored.where(F.col("idx") < split.val_end)


@query("platt")
def _(spark, d):
    scored, val = _held(spark, d)
    return Sigmoid(val).transform(scored).select("idx", "score", "calibrated")


@query("isotonic")
def _(spark, d):
    scored, val = _held(spark, d)
    return Isotonic(val).transform(scored).select("idx", "score", "calibrated")


@query("cv_sigmoid")
def _(spark, d):
    data = _data(spark, d)
    split = splits.chrono_split(data.n)
    model = CrossCalibrated(data.slice(0, split.train_end), split.train_end, "LogisticRegression", data.feature_cols, "anomaly")
    return model.transform(data.slice(split.train_end, data.n)).select("idx", "anomaly", "anomaly_score")


@query("save_load", "select row_number() over (order by ts, event_id) - 1 as idx, true as same, true as flagged_alike from events")
def _(spark, d):
    data = _data(spark, d)
    model = fit(data.slice(0, int(data.n * 0.7)), "LogisticRegression", data.feature_cols, scale="robust")
    model.threshold = 0.5
    path = new_path(spark, "model")
    model.save(spark, path)
    again = Scorer.load(spark, path)
    a = model.transform(data.df).select("idx", F.col("anomaly_score").alias("saved"))
    b = again.transform(data.df).select("idx", F.col("anomaly_score").alias("loaded"), "is_alert")
    return a.join(b, "idx").select("idx", (F.abs(F.col("saved") - F.col("loaded")) < 1e-12).alias("same"), (F.col("is_alert") == (F.col("saved") >= 0.5)).alias("flagged_alike"))


def _labelled(spark, d):
    return events(spark, d).withColumnRenamed("label", "anomaly")


SMALL = {
    "LogisticRegression": {"maxIter": 50},
    "RandomForest": {"numTrees": 10, "maxDepth": 6},
    "GradientBoosting": {"maxIter": 5},
}
ARGS = {"label": "anomaly", "ts": "ts", "tie": ["event_id"]}
D_COLS, B_COLS, C_COLS = (family_columns(KPI, f) for f in "DBC")


@query("train_labelled")
def _(spark, d):
    settings = {"IsolationForest": {"trees": 50}, "RandomForest_full": {"numTrees": 10, "maxDepth": 6}, "RandomForest_base": {"numTrees": 10, "maxDepth": 6}}
    return train(_labelled(spark, d), KPI, candidates=settings, **ARGS).metrics


@query("train_unlabelled")
def _(spark, d):
    out = train(_labelled(spark, d).drop("anomaly"), KPI, label=None, ts="ts", tie=["event_id"], candidates={"IsolationForest": {}})
    return out.incidents


@query("evaluate_saved")
def _(spark, d):
    rows = _labelled(spark, d)
    out = train(rows, KPI, label=None, ts="ts", tie=["event_id"], candidates={"IsolationForest": {}})
    path = new_path(spark, "model")
    out.scorer.save(spark, path)
    return evaluate(rows, Scorer.load(spark, path), KPI, **ARGS).metrics


@query("score_latest")
def _(spark, d):
    rows = _labelled(spark, d)
    out = train(rows, KPI, label=None, ts="ts", tie=["event_id"], candidates={"IsolationForest": {}})
    return score_latest(rows, out.scorer, KPI, "ts", ["series_key"], ["event_id"])


@query("latest_features", f"""with {RAW_SQL}, f as (select series_key, ts, event_id, idx,
    coalesce(last_value(value ignore nulls) over up, first_value(value ignore nulls) over (partition by series_key order by ts, event_id rows between current row and unbounded following)) as value
    from r window up as (partition by series_key order by ts, event_id rows between unbounded preceding and current row)),
  w as (select series_key, ts, event_id, value, coalesce(value - lag(value) over v, 0) as d, avg(value) over t as m, coalesce(stddev_samp(value) over t, 0) as s,
    count(*) over (partition by series_key) as n, row_number() over (partition by series_key order by ts desc, event_id desc) as k from f
    window v as (partition by series_key order by ts, event_id), t as (partition by series_key order by ts, event_id rows between 9 preceding and current row))
  select series_key, ts, event_id, round(value, 6) as value, round(d, 6) as value__diff1, round(m, 6) as value__roll10_mean, round(s, 6) as value__roll10_std, n as window_rows_used
  from w where k = 1""")
def _(spark, d):
    last = latest_features(raw_events(spark, d), KPI, "ts", ["series_key"], ["event_id"])
    return rounded(last.select("series_key", "ts", "event_id", "value", "value__diff1", "value__roll10_mean", "value__roll10_std", "window_rows_used"))


@query("optimize")
def _(spark, d):
    return compare.optimize(_labelled(spark, d), KPI, feature_cols=D_COLS, params=SMALL, **ARGS).metrics


@query("shift_rescore")
def _(spark, d):
    return detect.sanity_checks(_labelled(spark, d), KPI, feature_cols=B_COLS, **ARGS).metrics


@query("calibrate")
def _(spark, d):
    return compare.calibrate(_labelled(spark, d), KPI, feature_cols=D_COLS, params=SMALL, **ARGS).tables["calibrated"]


@query("timecv")
def _(spark, d):
    return compare.timecv(_labelled(spark, d), KPI, feature_cols=D_COLS, params=SMALL, **ARGS).metrics


@query("timecv5")
def _(spark, d):
    return compare.timecv5(_labelled(spark, d), KPI, feature_cols=D_COLS, **ARGS).tables["summary"]


@query("model_compare")
def _(spark, d):
    return compare.timecv_models(_labelled(spark, d), KPI, feature_cols=D_COLS, **ARGS).tables["calibrated_summary"]


def _grid(spark, d):
    return tuning.tune_gb(_labelled(spark, d), KPI, feature_cols=D_COLS, **ARGS)


@query("grid_gbt")
def _(spark, d):
    return _grid(spark, d).metrics


@query("importances")
def _(spark, d):
    return _grid(spark, d).tables["importances"]


@query("random_search")
def _(spark, d):
    trials = [("IsolationForest", {"trees": 50, "contamination": 0.05}), ("KernelMean", {"gamma": "scale", "nu": 0.1}), ("PCA", {"components": 2}),
              ("RandomForest", {"numTrees": 10, "maxDepth": 6, "minInstancesPerNode": 2})]
    return tuning.random_search(_labelled(spark, d), KPI, feature_cols=B_COLS, trials=trials, **ARGS).metrics


@query("detector_bench")
def _(spark, d):
    return detect.benchmark(_labelled(spark, d), KPI, feature_cols=C_COLS, **ARGS).metrics


@query("baseline_eval", """with e as (select value, cast(event_type = 'error' as int) as y, row_number() over (order by ts, event_id) - 1 as idx from events),
  n as (select floor(count(*) * 0.7) as cut, floor(count(*) * 0.85) as test from e),
  q as (select quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as s from e, n where idx < cut),
  z as (select idx, y, abs((value - m) / s) as score from e, q), t as (select quantile_cont(score, 0.99) as thr from z, n where idx < cut),
  c as (select count(*) filter (where score >= thr and y = 1) as tp, count(*) filter (where score >= thr and y = 0) as fp,
  count(*) filter (where score < thr and y = 1) as fn, count(*) filter (where score < thr and y = 0) as tn, max(thr) as thr from z, t, n where idx >= test)
  select round(thr, 6) as threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
  round(2.0 * tp / (2.0 * tp + fp + fn), 6) as f1 from c""")
def _(spark, d):
    table_ = detect.baseline(_labelled(spark, d), KPI, **ARGS).metrics
    return rounded(table_.select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"))


@query("robust_threshold")
def _(spark, d):
    return tuning.robust_threshold(_labelled(spark, d), "RandomForest", {"numTrees": 10, "maxDepth": 6}, KPI, feature_cols=B_COLS, **ARGS).metrics


@query("finalize")
def _(spark, d):
    out = tuning.robust_threshold(_labelled(spark, d), "RandomForest", {"numTrees": 10, "maxDepth": 6}, KPI, feature_cols=B_COLS, finalize=True, **ARGS)
    return out.scores.select("idx", "event_id", "anomaly", "anomaly_score", "is_alert", "model_used")


# Scores have no SQL; these queries check what must hold for every row, with the operators' own settings.

VECTOR_ROWS = "select vec_id as idx, true as in_range, true as share_alerts from embeddings"
HELD_ROWS = """with e as (select row_number() over (order by ts, event_id) - 1 as idx from events), n as (select floor(count(*) * 0.7) as cut from e)
  select idx, true as in_range, true as monotone from e, n where idx >= cut"""


def _share_holds(scored, cut: int, share: float) -> bool:
    """Whether the training rows above 0 are the share, up to one row of interpolation."""
    above = scored.where((F.col("idx") < cut) & (F.col("s") > 0)).count()
    return abs(above - share * cut) <= 1


@query("iforest_rules", VECTOR_ROWS)
def _(spark, d):
    rows = _vectors(spark, d)
    cut = _cut(rows)
    forest = det.IsolationForest.fit(rows.where(F.col("idx") < cut), cut)
    scored = materialize(forest.transform(rows, "s").select("idx", "s"), "scored")
    return scored.select("idx", (F.col("s") + forest.offset).between(0.0, 1.0).alias("in_range"), F.lit(_share_holds(scored, cut, 0.01)).alias("share_alerts"))


@query("kernel_rules", VECTOR_ROWS)
def _(spark, d):
    rows = _vectors(spark, d)
    cut = _cut(rows)
    model = det.KernelMean.fit(rows.where(F.col("idx") < cut))
    scored = materialize(rows.select("idx", model.score().alias("s")), "scored")
    # A dot product with a mean of feature vectors: features lie within sqrt(2 / size).
    return scored.select("idx", (F.col("s") - model.offset).between(-2.0, 2.0).alias("in_range"), F.lit(_share_holds(scored, cut, 0.1)).alias("share_alerts"))


@query("pca_rules", "select vec_id as idx, true as in_range, true as none_left from embeddings")
def _(spark, d):
    rows = _vectors(spark, d)
    train = rows.where(F.col("idx") < _cut(rows))
    some, every = det.Reconstruction(train), det.Reconstruction(train, 64)
    most = F.aggregate(some._centred(), F.lit(0.0), lambda s, v: s + v * v) / some.width
    out = every.transform(some.transform(rows).withColumn("most", most), "whole")
    return out.select("idx", F.col("anomaly_score").between(0.0, F.col("most") + 1e-9).alias("in_range"), (F.col("whole") < 1e-9).alias("none_left"))


def _calibration_rules(scored, rising: bool = True):
    """In [0, 1], and moving one way only along the scores."""
    line = timeline(scored.select("idx", "score", "calibrated").withColumnRenamed("idx", "row"), ["score", "row"], unique=True)

    def build(rows, frame):
        step = F.col("calibrated") - F.lag("calibrated").over(frame)
        return rows.withColumn("monotone", F.coalesce(step * (1 if rising else -1) >= -1e-12, F.lit(True)))

    out = windowed(line, 1, build)
    return out.select(F.col("row").alias("idx"), F.col("calibrated").between(0.0, 1.0).alias("in_range"), "monotone")


@query("platt_rules", HELD_ROWS)
def _(spark, d):
    scored, val = _held(spark, d)
    curve = Sigmoid(val)
    return _calibration_rules(curve.transform(scored), float(curve.model.coefficients[0]) >= 0)


@query("isotonic_rules", HELD_ROWS)
def _(spark, d):
    scored, val = _held(spark, d)
    return _calibration_rules(Isotonic(val).transform(scored))


@query("logreg_rules", """with e as (select row_number() over (order by ts, event_id) - 1 as idx from events) select idx, true as in_range, true as balanced from e""")
def _(spark, d):
    data = _data(spark, d)
    split = splits.chrono_split(data.n)
    train = data.slice(0, split.train_end)
    model = fit(train, "LogisticRegression", data.feature_cols, scale="robust")
    scored = materialize(model.transform(data.df).select("idx", "anomaly", "anomaly_score"), "scored")
    neg, pos = scale.class_counts(train, "anomaly")
    weight = scale.balanced_weight("anomaly", neg, pos)
    # At the optimum the intercept's part of the gradient is zero.
    slope = scored.where(F.col("idx") < split.train_end).agg(F.sum(weight * (F.col("anomaly_score") - F.col("anomaly"))) / F.sum(weight)).first()[0]
    return scored.select("idx", F.col("anomaly_score").between(0.0, 1.0).alias("in_range"), F.lit(abs(slope) < 1e-3).alias("balanced"))
