"""Detectors, classifiers, calibration, entry points, storage and streams on planted anomalies."""

import hashlib
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.explain import contributions, explanation, top_contributors
from tidemark.functions.kpi import KPIS
from tidemark.operators import detectors as det
from tidemark.operators import deepforest, forest
from tidemark.operators import histboost, knn, metrics, ranking, sanity, scale, searchboost, tails
from tidemark.operators.calibrate import Sigmoid
from tidemark.operators.incidents import group_incidents
from tidemark.operators.isotonic import Isotonic
from tidemark.operators.features import add_features
from tidemark.operators.models import Scorer, fit
from tidemark.operators.order import from_indexed, timeline
from tidemark.operators.ranking import latest
from tidemark.plans import compare, detect, tuning
from tidemark.plans.common import prepare, publish
from tidemark.plans.train import evaluate, latest_features, score_latest, train
from tidemark.sources import runs, tables
from tidemark.streaming.incidents import stream_incidents_rows, use_state_store
from tidemark.streaming.score import stream_score


# Queries that compare models on rolling splits, with the models.
ROLLING = {"timecv5": ["GradientBoosting"], "model_compare": ["LogisticRegression", "RandomForest", "GradientBoosting"]}


def network(n=600, seed=0):
    """Six KPIs of one day with spikes, labelled."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.08).astype(int)
    pdf = pd.DataFrame({c: rng.normal(10, 1, n) for c in KPIS})
    pdf["bandwidth"] = 2.0
    pdf.loc[y == 1, "latency"] += 12
    pdf.loc[y == 1, "throughput"] -= 6
    pdf["timestamp"] = pd.date_range("2024-01-01", periods=n, freq="40s")
    pdf["anomaly"] = y
    pdf["anomaly_latency"] = y
    return pdf


@pytest.fixture(scope="module")
def kpis(spark):
    return spark.createDataFrame(network())


def ap(df):
    return metrics.curve(df).agg(metrics.average_precision()).first()[0]


def points(spark, n=300, seed=1, width=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(2)
    x[: n // 3] = x[0]  # a third of the rows are copies
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>")


@pytest.mark.parametrize("pivots,block", [(1, 4096), (9, 16)])
def test_neighbours_are_exact(spark, pivots, block):
    x, df = points(spark)
    rng = np.random.default_rng(2)
    q = rng.normal(size=(40, 3)).round(2)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "vid long, features array<double>")
    refs = knn.distinct_vectors(df, "idx").withColumnRenamed("vid", "vid")
    got = knn.neighbours(queries, refs, 5, pivots, block).toPandas()
    first = {tuple(r): i for i, r in reversed(list(enumerate(x)))}
    ids = np.array(sorted(first.values()))
    for i in range(len(q)):
        d = np.sqrt(((q[i] - x[ids]) ** 2).sum(axis=1))
        best = ids[np.lexsort((ids, d))[:5]]
        mine = got[got["qid"] == i].sort_values(["dist", "rid"])
        assert mine["rid"].tolist() == best.tolist()


@pytest.mark.parametrize("crowded", [0.0, 1.0])
def test_neighbours_in_cells_and_without(spark, crowded):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 20)), np.full((1, 20), 1e8), 1e6 + rng.integers(0, 2, (99, 20))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, features array<double>")
    got = knn.neighbours(df, df, 7, 30, 128, crowded).toPandas().sort_values(["qid", "dist", "rid"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got["rid"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :7].ravel().tolist()
    assert got["dist"].tolist() == np.sort(d, axis=1)[:, :7].ravel().tolist()


@pytest.mark.parametrize("crowded,block", [(0.0, 50), (1.0, 50), (0.0, None), (1.0, 7)])
def test_references_that_would_travel_much_are_read_by_tasks(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(knn, "TRAVEL", 0)
    sent = []
    monkeypatch.setattr(knn, "_read_by_tasks", lambda *a, own=knn._read_by_tasks: sent.append(a) or own(*a))
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 4)), np.full((1, 4), 1e8), 1e3 + rng.integers(0, 3, (1_800, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, features array<double>")
    got = knn.neighbours(df, df, 9, 20, block, crowded).toPandas().sort_values(["qid", "dist", "rid"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :9]
    assert len(sent) == 1 and (sent[0][4] is None) == (crowded == 0.0)
    assert got["qid"].tolist() == np.repeat(np.arange(len(x)), 9).tolist() and got["rid"].tolist() == near.ravel().tolist()
    assert got["dist"].tolist() == np.take_along_axis(d, near, 1).ravel().tolist()


def test_batch_of_references_is_sent_in_bounded_parts(spark, monkeypatch):
    """Every row may go to every cell: the rows sent at a time stay few."""
    monkeypatch.setattr(knn, "VALUES", 4_096)
    x = np.random.default_rng(6).normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, features array<double>")
    seen, frame = [], type(df)
    real = frame.mapInPandas

    def watched(self, func, schema, *args, **kwargs):
        seen.append(func)
        return real(self, func, schema, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInPandas", watched)
    knn.neighbours(df, df, 5, 32, 128, 1.0)
    sent = next(f for f in seen if f.__name__ == "to_targets")
    batch = pd.DataFrame({"vid": np.arange(600), "features": list(x)})
    sizes = [len(p) for p in sent(iter([batch]))]
    assert max(sizes) * 16 <= 4_096 and sum(sizes) > 10_000


def test_local_outlier_factor_with_copies(spark):
    x, df = points(spark)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(20, 3)).round(2)
    rows[0] = x[0]
    k = 10
    new = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "idx long, features array<double>")
    got = knn.local_outlier_factor(df, new, "idx", k, pivots=7, block=32).toPandas().sort_values("idx")["anomaly_score"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1) + 1e-10)
    dq = np.sqrt(((rows[:, None] - x[None]) ** 2).sum(axis=2))
    nq = np.argsort(dq, axis=1, kind="stable")[:, :k]
    lrd_q = 1 / (np.maximum(np.take_along_axis(dq, nq, 1), kd[nq]).mean(axis=1) + 1e-10)
    assert got == pytest.approx(lrd[nq].mean(axis=1) / lrd_q, rel=1e-6)


def test_isolation_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    x[:5] += 8
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>")
    forest = det.IsolationForest.fit(df, 400, trees=50, contamination=0.02)
    again = det.IsolationForest.fit(df.repartition(7), 400, trees=50, contamination=0.02)
    raw = df.select("idx", forest.raw_score(spark).alias("s"), forest.score(spark).alias("d")).toPandas().sort_values("idx")
    assert raw["s"].between(0, 1).all() and set(raw.nlargest(5, "s")["idx"]) == set(range(5))
    assert (raw["d"] > 0).sum() == 8
    other = df.select("idx", again.raw_score(spark).alias("s")).toPandas().sort_values("idx")
    assert np.allclose(raw["s"].to_numpy(), other["s"].to_numpy())


def test_forests_of_a_share(spark, tmp_path):
    """Grown in tasks or level by level, kept in memory or as a table: the same trees and scores."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)).round(2)
    x[:4] += 9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>")
    args = {"trees": 6, "max_samples": 0.6, "contamination": 0.01}
    memory = det.IsolationForest.fit(df, 3000, **args)
    table = det.IsolationForest.fit(df, 3000, model_nodes=10, **args)
    levels = det.IsolationForest.fit(df, 3000, task_values=100, **args)
    assert memory.trees and table.table is not None and levels.nodes is not None and {f.sample for f in (memory, table, levels)} == {1800}
    found = [f.transform(df, "s").orderBy("idx").toPandas()["s"].to_numpy() for f in (memory, table, levels)]
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2]) and set(np.argsort(-found[0])[:4]) == set(range(4))
    nodes = {(r["tree"], r["node"]): (r["feature"], r["cut"], r["path"]) for r in levels.nodes.collect()}
    for t, tree in enumerate(memory.trees):
        for i in range(len(tree["node"])):
            assert nodes.pop((t, int(tree["node"][i]))) == pytest.approx((tree["feature"][i], tree["cut"][i], tree["path"][i]))
    assert not nodes
    # The rows of a tree follow the share, and shares differ.
    sizes = {s: [r["count"] for r in det.IsolationForest.shared(df, 40, s, 1).groupBy("tree").count().collect()] for s in (0.6, 0.8)}
    assert all(abs(n - s * 3000) < 6 * (3000 * s * (1 - s)) ** 0.5 for s, ns in sizes.items() for n in ns) and len(sizes[0.6]) == 40
    for i, f in enumerate((memory, table, levels)):
        f.save(spark, f"{tmp_path}/{i}")
        again = det.IsolationForest.load(spark, f"{tmp_path}/{i}").transform(df, "s").orderBy("idx").toPandas()["s"].to_numpy()
        assert np.allclose(again, found[0])


def test_forests_of_a_share_count_equal_rows(spark):
    """Many rows with few different vectors fit a task; draws and trees are those of the rows."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 15, size=(2000, 2)) / 4
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>").repartition(5)
    for seed in (1, -7, 1 << 40):
        rows = det.IsolationForest.shared(df, 9, 0.7, seed).groupBy("tree").count()
        assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in det.IsolationForest.share_sizes(df, 9, 0.7, seed).collect()}
    few = det.IsolationForest.fit(df, 2000, 5, 0.7, task_values=600, model_nodes=10)
    assert few.table is not None and few.nodes is None
    drawn = det.IsolationForest.shared(df, 5, 0.7, 42).toPandas()
    total = np.zeros(2000)
    for r in few.table.collect():
        own = np.stack(drawn.loc[drawn["tree"] == r["tree"], "features"])
        want, got = forest.grow(own, r["tree"], 42, 11), forest.unpacked(r)
        assert all(np.allclose(got[c], want[c]) for c in forest.KINDS)
        total += forest.walked(want, x)
    s = few.transform(df, "s", raw=True).orderBy("idx").toPandas()["s"].to_numpy()
    assert np.allclose(s, 2.0 ** (-total / (5 * float(forest.mean_path(1400)))))


def test_unlabelled_training_scores_rows_once(spark, kpis, monkeypatch):
    """The cut and the threshold come from the scores that are returned, which are those of the kept model."""
    passes, transform = [], forest.IsolationForest.transform
    monkeypatch.setattr(forest.IsolationForest, "transform", lambda *a, **k: passes.append(1) or transform(*a, **k))
    out = train(kpis.drop("anomaly", "anomaly_latency"), label=None, candidates={"IsolationForest": {"trees": 5, "contamination": 0.05}})
    assert len(passes) == 1 and out.scorer.params["contamination"] == 0.05
    rows = out.scores.withColumnRenamed("anomaly_score", "had").withColumnRenamed("is_alert", "alert")
    got = out.scorer.transform(rows).select("had", "anomaly_score", "alert", "is_alert").toPandas()
    assert np.allclose(got["had"], got["anomaly_score"]) and (got["alert"] == got["is_alert"]).all()
    assert abs((got["had"] > 0).sum() - 0.05 * len(got)) <= 1


def test_kernel_mean_and_reconstruction(spark):
    rng = np.random.default_rng(5)
    line = rng.normal(size=300)
    x = np.c_[line, 2 * line + rng.normal(scale=0.01, size=300), rng.normal(scale=0.01, size=300)]
    x[7] = [0.0, 9.0, 0.0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx long, features array<double>")
    km = det.KernelMean.fit(df, nu=0.1)
    scores = df.select("idx", km.score().alias("s")).toPandas()
    assert scores.nlargest(1, "s")["idx"].iloc[0] == 7 and (scores["s"] > 0).sum() == 30
    rec = det.Reconstruction(df, 1).transform(df).toPandas()
    assert rec.nlargest(1, "anomaly_score")["idx"].iloc[0] == 7
    centred = x - x.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:1]
    want = ((centred - centred @ v.T @ v) ** 2).mean(axis=1)
    assert np.allclose(rec.sort_values("idx")["anomaly_score"], want, atol=1e-8)
    assert det.Reconstruction(df, 10).transform(df).agg(F.max("anomaly_score")).first()[0] == pytest.approx(0, abs=1e-9)


def test_scaling_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    assert scale.fit_robust(df, ["a", "b"]) == {"a": (2.5, 3.0), "b": (5.0, 1.0)}
    assert scale.fit_standard(df, ["b"]) == {"b": (5.0, 1.0)}
    assert scale.ratio_weight("y", 5, 0) is None


@pytest.mark.parametrize("kind,params,scaling", [
    ("LogisticRegression", {}, "robust"),
    ("RandomForest", {"numTrees": 20, "maxDepth": 8}, None),
    ("GradientBoosting", {"maxIter": 5}, None),
    ("IsolationForest", {"trees": 50}, "standard"),
])
def test_models_have_skill_and_survive_storage(spark, kpis, tmp_path, kind, params, scaling):
    data = prepare(kpis, KPIS, "D")
    assert "anomaly_latency" not in data.feature_cols and "anomaly" not in data.feature_cols
    # Lags repeat a spike on the rows behind it, which a detector without labels cannot tell apart.
    cols = list(KPIS) if kind == "IsolationForest" else data.feature_cols
    model = fit(data.slice(0, 400), kind, cols, params=params, scale=scaling)
    model.threshold = 0.5
    test = model.transform(data.slice(400, 600), "score").select("idx", F.col("anomaly").alias("y"), "score", "is_alert").cache()
    skill = ap(test)
    shuffled = ap(sanity.shuffle_column(test.withColumn("idx", F.col("idx") - 400), "y"))
    assert skill > 0.8 and skill > shuffled + 0.3
    model.save(spark, str(tmp_path / "m"))
    again = Scorer.load(spark, str(tmp_path / "m")).transform(data.slice(400, 600), "score").select("idx", "score")
    a, b = (d.toPandas().sort_values("idx")["score"].to_numpy() for d in (test, again))
    assert np.allclose(a, b)


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, y int")
    grid = spark.createDataFrame([(0.1,), (0.75,), (0.95,)], "score double")
    iso = [r["calibrated"] for r in Isotonic(df).transform(grid).orderBy("score").collect()]
    assert iso == pytest.approx([0.0, 0.5, 1.0])
    sig = [r["calibrated"] for r in Sigmoid(df).transform(grid).orderBy("score").collect()]
    assert sig == sorted(sig) and all(0 < s < 1 for s in sig)


def test_controls_are_permutations(spark):
    df = spark.range(237).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).cast("double").alias("b"), F.lit(1).alias("y"))
    one = sanity.shuffle_column(df, "a").toPandas()
    assert sorted(one["a"]) == list(range(0, 474, 2)) and (one["a"] != one["idx"] * 2).any() and (one["b"] == one["idx"] * 3).all()
    blocks = sanity.shuffle_blocks(df, ["a", "b"]).toPandas()
    assert len(blocks) == 237 and (blocks["a"] * 3 == blocks["b"] * 2).all() and (blocks["a"] // 100 == blocks["idx"] // 50).all()
    both = sanity.shuffle_features(df, ["a", "b"]).toPandas()
    assert sorted(both["a"]) == list(range(0, 474, 2)) and (both["a"] * 3 != both["b"] * 2).any()
    moved = sanity.shift_rows(df, ["a"], 237).toPandas().sort_values("idx")["a"].tolist()
    assert moved == [472, *range(0, 472, 2)]


def test_shuffled_features_need_no_running_count(spark):
    rows = spark.createDataFrame([(i, float(i), None if i % 3 else -float(i), i % 2) for i in range(50)], "idx bigint, a double, b double, y int")
    out = sanity.shuffle_features(rows, ["a", "b"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.orderBy("idx").collect()
    for c in "ab":
        order = sorted(range(50), key=lambda i: (hashlib.md5(f"{i}-{c}-42".encode()).hexdigest(), i))
        assert [r[c] for r in got] == [None if c == "b" and i % 3 else float(i) if c == "a" else -float(i) for i in order]
    assert [r["y"] for r in got] == [i % 2 for i in range(50)]


def test_incidents(spark):
    flags = [1, 1, 0, 1, 0, 0, 1] + [0] * 20 + [1] * 30
    df = spark.createDataFrame([(i, i, bool(f), float(i)) for i, f in enumerate(flags)], "idx long, timestamp long, is_alert boolean, anomaly_score double")
    for chunk in (3, 1000):
        line = from_indexed(df, chunk=chunk)
        rows = lambda gap: [tuple(r) for r in group_incidents(line, gap).orderBy("incident_id").collect()]
        assert rows(0) == [(0, 0, 1, 2, 1.0), (1, 3, 3, 1, 3.0), (2, 6, 6, 1, 6.0), (3, 27, 56, 30, 56.0)]
        assert rows(1) == [(0, 0, 3, 3, 3.0), (1, 6, 6, 1, 6.0), (2, 27, 56, 30, 56.0)]
        assert rows(2) == [(0, 0, 6, 4, 6.0), (1, 27, 56, 30, 56.0)]
        assert group_incidents(line.with_df(df.withColumn("is_alert", F.lit(False)))).count() == 0
    with pytest.raises(ValueError):
        group_incidents(from_indexed(df.drop("timestamp")))


def test_explanations(spark):
    df = spark.createDataFrame([(1.0, 4.0, 4.0, 2.0), (None, None, None, None)], "contrib_a double, contrib_b double, contrib_c double, contrib_d double")
    top = df.select(top_contributors(["a", "b", "c", "d"]).alias("t")).collect()
    assert [(e["kpi"], e["value"]) for e in top[0]["t"]] == [("b", 4.0), ("c", 4.0), ("d", 2.0)]
    row = spark.createDataFrame([(5.0, 1.0, 2.0, 7.0, None, 1.0)], "a double, a__roll3_mean double, a__delta1 double, b double, b__roll3_mean double, b__delta1 double")
    assert row.select(explanation(["a", "b"]).alias("t")).first()["t"] == "a: value=5.000, roll3_mean=1.000, delta1=2.000"
    assert row.select(explanation(["b"]).alias("t")).first()["t"] == "n/a"


FAST = {"LogisticRegression": {"maxIter": 50}, "RandomForest": {"numTrees": 10, "maxDepth": 6}, "GradientBoosting": {"maxIter": 4}, "HistGradientBoosting": {"maxIter": 4}}


def test_train_evaluate_and_score(spark, kpis, tmp_path):
    settings = {"IsolationForest": {"trees": 30}, "RandomForest_base": {"numTrees": 10, "maxDepth": 6}}
    out = train(kpis, candidates=settings)
    assert out.notes["model"] in settings and out.metrics.first()["pr_auc"] > 0.7
    assert out.scores.count() == 600 and "contrib_latency" in out.scores.columns
    out.scorer.save(spark, str(tmp_path / "m"))
    checked = evaluate(kpis, Scorer.load(spark, str(tmp_path / "m")))
    row = checked.metrics.first()
    assert row["f1"] == pytest.approx(out.metrics.first()["f1"])
    assert row["alert_rate_pred"] == pytest.approx(out.scores.agg(F.avg(F.col("is_alert").cast("int"))).first()[0])
    last = score_latest(kpis, out.scorer).first()
    assert last["window_rows_used"] == 600 and len(last["top_contributors"]) == 3
    alone = train(kpis.drop("anomaly", "anomaly_latency"), label=None, candidates={"IsolationForest": {"trees": 30}})
    assert alone.scores.where("is_alert").count() == 6 and alone.incidents.agg(F.sum("n_rows")).first()[0] == 6


def test_compare_falls_back_when_a_model_fails(kpis):
    out = compare.optimize(kpis, params={**FAST, "HistGradientBoosting": {"maxDepth": -1}})
    status = {r["model"]: r["status"] for r in out.tables["status"].collect()}
    assert status["HistGradientBoosting"].startswith("failed") and status["GradientBoosting_fallback"] == "ok"
    controls = {r["control"]: r["pr_auc"] for r in out.tables["sanity"].collect()}
    best = out.metrics.where(F.col("model") == out.notes["model"]).first()["pr_auc"]
    assert best > controls["labels_shuffled"] + 0.2 and best > controls["rows_shuffled"] + 0.2
    assert out.scores.count() == 90


def test_deep_trees_split_like_brute_force():
    rng = np.random.default_rng(0)
    bins, y, times = rng.integers(0, 6, (1, 60)).astype(np.uint8), rng.integers(0, 2, 60), rng.integers(0, 3, 60)
    weights, least = (0.7, 2.5), 3

    def impurity(own):
        pos, neg = (times * y)[own].sum() * weights[1], (times * (1 - y))[own].sum() * weights[0]
        return (pos + neg) * (1 - (pos**2 + neg**2) / (pos + neg) ** 2)

    cuts = {c: impurity(bins[0] <= c) + impurity(bins[0] > c) for c in range(6)
            if min(times[bins[0] <= c].sum(), times[bins[0] > c].sum()) >= least}
    tree = deepforest.grow(bins, y, times, weights, 1, least, rng)
    assert tree["cut"][0] == min(cuts, key=cuts.get) and list(tree["child"]) == [1, 0, 0]
    right = bins[0] > tree["cut"][0]
    pos, neg = (times * y)[right].sum() * weights[1], (times * (1 - y))[right].sum() * weights[0]
    assert tree["value"][2] == pytest.approx(pos / (pos + neg)) and deepforest.shares(bins, tree)[right] == pytest.approx(pos / (pos + neg))


def test_deep_trees_are_the_same_by_counts_and_by_sorts():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 40, (5, 700)).astype(np.uint8), rng.integers(0, 2, 700)
    times = np.bincount(rng.integers(0, 700, 700), minlength=700)
    made = [deepforest.grow(bins, y, times, (1.0, 3.0), 30, 1, np.random.default_rng(2), dense) for dense in (True, False, None)]
    for other in made[1:]:
        assert all((made[0][k] == other[k]).all() for k in deepforest.KINDS)
    # Grown out: drawn rows with different values get their own label back.
    drawn = times > 0
    assert (deepforest.shares(bins, made[0])[drawn].round() == y[drawn]).all() and len(made[0]["value"]) > 200


def test_deep_forest_has_all_trees_and_survives_storage(spark, kpis, tmp_path):
    train = kpis.withColumn("anomaly", F.col("anomaly").cast("int"))
    model = fit(train, "RandomForest", KPIS, params={"numTrees": 40})
    assert model.params["maxDepth"] == 30 and len(model.bagged.trees) == 40
    again = fit(train.repartition(3), "RandomForest", KPIS, params={"numTrees": 40})
    model.save(spark, f"{tmp_path}/deep")
    loaded = Scorer.load(spark, f"{tmp_path}/deep")
    key = lambda m: [r[0] for r in m.transform(train).orderBy("timestamp").select("anomaly_score").collect()]
    assert key(model) == key(loaded) == key(again)
    rows = model.transform(train.where("anomaly is not null")).select(F.col("anomaly_score").alias("score"), F.col("anomaly").alias("y"))
    assert ap(rows) > 0.99
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["latency"] > shares["bandwidth"] == 0
    with pytest.raises(ValueError, match="labels"):
        fit(train.withColumn("anomaly", F.when(F.col("latency") < 15, F.col("anomaly"))), "RandomForest", KPIS, params={"numTrees": 1})


def test_rolling_comparisons_run_at_full_settings(spark, tmp_path, monkeypatch):
    from checks.registry import QUERIES
    import checks.models  # noqa: F401

    rows = [(i, i % 7, datetime(2024, 1, 1) + timedelta(minutes=i), float(i % 11), "error" if i % 5 == 0 else "view") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    seen = {}

    def cut(data, folds, models, params):
        seen.update(folds=len(folds), models=list(models), params=params)
        raise InterruptedError

    monkeypatch.setattr(compare, "_rolling", cut)
    for name, models in ROLLING.items():
        with pytest.raises(InterruptedError):
            QUERIES[name](spark, str(tmp_path))
        assert seen == {"folds": 5, "models": models, "params": None}


def test_grid_search(kpis):
    configs = [{"maxIter": 3, "stepSize": 0.1, "maxDepth": d, "minInstancesPerNode": 5, "subsamplingRate": 1.0} for d in (2, 3, 2)]
    out = tuning.tune_gb(kpis, configs=configs, folds=2, min_pos=1, limit=2)
    assert out.notes["stopped"] == "max_configs_reached" and out.metrics.count() == 2
    names = {r["name"] for r in out.tables["operating_points"].collect()}
    assert names == {"f2_opt", "high_recall", "alert_budget_5p"}
    assert out.scores.count() == out.scores.select("idx").distinct().count()
    assert len(tuning.grid()) == 162 and len(tuning.draws()) == 55 and tuning.draws() == tuning.draws()
    with pytest.raises(ValueError):
        tuning.robust_threshold(kpis, "LOF", {})


def test_detectors_and_controls(kpis):
    out = detect.benchmark(kpis, detectors={"IsolationForest": {"trees": 30}, "LOF": {"k": 10}, "PCA": {}})
    assert {"bandwidth"} <= set(out.notes["constant"])
    table = out.metrics.toPandas()
    assert set(table["model"]) == {"IsolationForest", "LOF", "PCA"} and table["pr_auc"].is_monotonic_decreasing
    checks = {r["control"]: r["pr_auc"] for r in detect.sanity_checks(kpis, params={"trees": 30}).metrics.collect()}
    assert checks["baseline"] > max(checks["random_labels"], checks["shuffled_features"], checks["time_shift"])
    assert detect.baseline(kpis).metrics.first()["roc_auc"] > 0.9


def test_tables_and_runs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,latency,anomaly\n2024-01-02T00:00:00Z,1.5,0\nbad,2,1\n2024-01-01T00:00:00Z,x,1\n")
    path = str(tmp_path / "a.csv")
    df = tables.load_csv(spark, path, "anomaly int, latency string")
    assert df.count() == 2 and dict(df.dtypes)["anomaly"] == "int"
    (tmp_path / "b.csv").write_text("time,latency\n1,2\n")
    with pytest.raises(ValueError):
        tables.load_csv(spark, str(tmp_path / "b.csv"))
    assert tables.first_readable(spark, [str(tmp_path / "none.csv"), path]) == path
    with pytest.raises(FileNotFoundError):
        tables.first_readable(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    store = runs.Runs(spark, str(tmp_path / "runs"))
    assert store.latest("scores", "train") is None and store.committed() is None
    for tag, run in (("train", "20240101_000000"), ("train", "20240102_000000"), ("eval", "20240103_000000")):
        store.save(spark.range(3).withColumn("run", F.lit(run)), "scores", tag, run)
        store.commit(tag, run, {"scores": "parquet"})
    # Not committed, so not there, however new.
    store.save(spark.range(3).withColumn("run", F.lit("half")), "scores", "train", "20240109_000000")
    assert {r["run"] for r in store.latest("scores", "train").collect()} == {"20240102_000000"}
    assert store.latest("incidents", "train") is None and store.table("scores", "train", "20240109_000000") is None
    with pytest.raises(Exception):
        store.save(spark.range(1), "scores", "train", "20240101_000000")
    with pytest.raises(Exception):
        store.commit("train", "20240101_000000", {"scores": "parquet"})
    with pytest.raises(ValueError):
        store.save(spark.range(1), "manifest", "train", "20240101_000000")
    spark.range(2).withColumn("run", F.lit("")).write.mode("overwrite").parquet(str(tmp_path / "runs/scores/tag=eval/run_id=20240103_000000"))
    with pytest.raises(ValueError):
        store.latest("scores", "eval")
    store.save(spark.range(2), "scores", "csv", "20240101_000000", "csv")
    store.commit("csv", "20240101_000000", {"scores": "csv"})
    assert store.latest("scores", "csv").count() == 2
    known = store.committed().select("tag", "run_id", F.lit(True).alias("has_scores")).distinct()
    assert runs.resolve_source(known.where("tag <> 'csv'")).first()["tag"] == "train"
    tables.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


@pytest.mark.parametrize("keys", [["k"], []])
def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path, keys):
    rows = [(i % 3 if i > 40 else 0, i, float(i % 7)) for i in range(90)]
    for part, span in enumerate((rows[:30], rows[30:60], [(0, 5, 99.0), *rows[60:]])):
        spark.createDataFrame(span, "k int, t long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, t long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # The time column may be any ordered type once it is parsed.
    timed = source.withColumn("ts", F.timestamp_seconds("t"))
    score = lambda df: df.withColumn("anomaly_score", F.col("contrib_v"))
    stream_score(timed, str(tmp_path / "out"), score, ["v"], keys, "ts", ["t"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/scores")).orderBy("t").toPandas()
    late = spark.read.parquet(str(tmp_path / "out/late")).collect()
    assert [r["v"] for r in late] == [99.0]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    g = pdf.groupby("k")["v"] if keys else pdf["v"]
    want = g.transform(lambda s: s.rolling(10, min_periods=1).mean()) if keys else g.rolling(10, min_periods=1).mean()
    assert len(got) == 90 and np.allclose(got["v__roll10_mean"], want)


def _boost_rows(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, size=(n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.15] = np.nan
    lean = np.where(np.isnan(x[:, 0]), 2.0, -1.0) + np.where(np.nan_to_num(x[:, 1]) > 20, 1.5, -0.5)
    y = (rng.random(n) < 1 / (1 + np.exp(-lean))).astype(int)
    return x, y


def test_boosting_splits_like_brute_force():
    """Every cut and side of missing values tried one by one, over rows instead of histograms."""
    for seed in range(6):
        x, y = _boost_rows(200, seed)
        s = histboost.Settings(least_rows=(1, 20)[seed % 2], penalty=(0.0, 2.0)[seed // 3])
        cuts = [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
        w = np.where(y == 1, 2.0, 1.0)
        g, h = histboost.derivatives(np.linspace(-1, 1, len(y)), y, w)
        bins = histboost.as_bins(x, cuts)
        hist = histboost.histogram(bins, g, h, np.where(np.arange(len(y)) < 150, 3, 2), [3])[0]
        gain, column, cut, to_left, sums = histboost.best_split(hist, s)
        best = []
        part = lambda rows: (g[:150][rows].sum() / histboost.UNIT, h[:150][rows].sum() / histboost.UNIT, int(rows.sum()))
        value = lambda t: t[0] ** 2 / (t[1] + s.penalty)
        for c in range(3):
            v = x[:150, c]
            for k, at in enumerate(cuts[c]):
                for side in (False, True):
                    left = np.where(np.isnan(v), side, v <= at)
                    a, b = part(left), part(~left)
                    if min(a[2], b[2]) >= s.least_rows and min(a[1], b[1]) >= histboost.LEAST_HESSIAN:
                        best.append((value(a) + value(b) - value(part(np.ones(150, bool))), c, k, side, a[2]))
        most = max(b[0] for b in best)
        assert abs(gain - most) < 1e-9
        assert any((c, k, side, n) == (column, cut, to_left, sums[2]) for v, c, k, side, n in best if abs(v - most) < 1e-9)


@pytest.mark.parametrize("most", [1.0, 1e6])
def test_sums_of_packed_rows_are_exact(monkeypatch, most):
    """Counts above second derivatives in one double, and apart where weights leave no room, equal sums of whole numbers row by row."""
    monkeypatch.setattr(histboost, "PACKED", 700)
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 256, (2, 3000)).astype(np.uint8)
    g, h = histboost.derivatives(rng.normal(size=3000), rng.integers(0, 2, 3000).astype(float), rng.random(3000) * most)
    rows = np.flatnonzero(rng.random(3000) < 0.8)
    want = np.zeros((2, 256, 3), np.int64)
    for j in range(2):
        np.add.at(want[j], bins[j, rows], np.stack([g, h, np.ones(3000)], axis=1)[rows].astype(np.int64))
    assert (histboost.sums(bins, g, h, rows) == want).all()


def test_rows_at_hand_stay_sorted_by_node(monkeypatch):
    """A level looks at the rows of the nodes that were split last, once each, instead of taking all rows down from the root again."""
    x, y = _boost_rows(1000)
    cuts = [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
    looked, real = [], histboost.Tree.spread
    monkeypatch.setattr(histboost.Tree, "spread", lambda self, bins, rows=None: (looked.append(None if rows is None else set(rows)), real(self, bins, rows))[1])
    source = histboost.InTask(np.ascontiguousarray(histboost.as_bins(x, cuts).T), y.astype(float), 1.0, np.zeros(1000))
    trees = histboost.boost(source, cuts, histboost.Settings(trees=3, depth=3))
    assert len(trees) == 3 and None not in looked and {1} in looked and len(looked) == 3 * 3 + 2


def test_boosting_is_the_same_in_one_task_and_level_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(histboost, "BLOCK", 100)
    monkeypatch.setattr(histboost, "REWRITE", 2)
    x, y = _boost_rows()
    rows = [([None if v != v else float(v) for v in r], int(t), 0.5 + i % 3, "extra") for i, (r, t) in enumerate(zip(x, y))]
    rows += [(None, 1, 1.0, ""), ([1.0, 2.0, 3.0], None, 1.0, ""), ([1.0, 2.0, 3.0], 1, None, None)]  # no say
    df = spark.createDataFrame(rows, "features array<double>, y int, w double, p string")
    s = histboost.Settings(trees=5, depth=3, rate=0.5)
    one = histboost.HistBoost.fit(df, "y", s, "w")
    many = histboost.HistBoost.fit(df.repartition(5), "y", s, "w", task_values=0)
    assert len(one.trees) == len(many.trees) == 5 and one.start == many.start
    for a, b in zip(one.trees, many.trees):
        for c in ("feature", "cut", "threshold", "missing_left", "value", "gain"):
            assert (getattr(a, c) == getattr(b, c)).all()
    # Missing values have a side of their own: the first column's are the likeliest positives.
    p = df.where("y is not null and features is not null").select("y", one.score().alias("p"), F.isnull(F.get("features", F.lit(0))).alias("m"))
    means = {r["m"]: r["p"] for r in p.groupBy("m").agg(F.avg("p").alias("p")).collect()}
    assert means[True] > means[False] + 0.3
    one.save(spark, str(tmp_path / "m"))
    again = histboost.HistBoost.load(spark, str(tmp_path / "m"))
    assert [r[0] for r in df.select(again.score()).collect()] == [r[0] for r in df.select(one.score()).collect()]
    for bad in (df.where("false"), df.where("y = 1")):
        with pytest.raises(ValueError):
            histboost.HistBoost.fit(bad, "y", s)
    with pytest.raises(ValueError):
        histboost.Settings(depth=0)
    # Columns without a value and equal rows have no split: the model is the share of positives.
    flat = spark.createDataFrame([([None, 1.0], i % 4 // 3) for i in range(100)], "features array<double>, y int")
    still = histboost.HistBoost.fit(flat, "y", s)
    assert not still.trees and abs(flat.select(still.score()).first()[0] - 0.25) < 1e-6


def test_stream_restarts_from_its_state_and_touches_own_series_only(spark, tmp_path):
    """Restarts over 200 series: rolling values go on, a batch holds rows of its own series only, extra columns and null keys pass."""
    schema = "k int, t timestamp, `an id` bigint, v double, note string"
    rng, start = np.random.default_rng(3), datetime(2024, 1, 1)
    big, rows = 2**60 + 1, []
    plain = lambda df: df.withColumn("anomaly_score", F.col("contrib_v"))
    for step in range(4):
        met = [*range(200)] if step == 0 else [None, step, 7]
        part = [(k, start + timedelta(seconds=100 * step + i, microseconds=7), big + len(met) * i + n, float(rng.integers(0, 50)), None if i else "x")
                for i in range(4) for n, k in enumerate(met)]
        rows += part
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream_score(stream, f"{tmp_path}/out", plain, ["v"], ["k"], "t", ["an id"], keep="365 days").awaitTermination()
        work = spark.read.parquet(f"{tmp_path}/out/work")
        assert {r["k"] for r in work.select("k").distinct().collect()} == set(met)
        # Held rows: at most the nine that the widest window needs.
        assert work.where("not __new").groupBy("k").count().agg(F.max("count")).first()[0] in (None, 4, 8, 9)
    got = {r["t"].timestamp() * 10**6 + (0 if r["k"] is None else r["k"] + 1): r for r in spark.read.parquet(f"{tmp_path}/out/scores").collect()}
    want = pd.DataFrame(rows, columns=["k", "t", "id", "v", "note"])
    want["mean"] = want.groupby("k", dropna=False)["v"].transform(lambda s: s.rolling(10, min_periods=1).mean())
    assert len(got) == len(rows)
    for k, t, i, v, note, mean in want.itertuples(index=False):
        r = got[t.timestamp() * 10**6 + (0 if k != k else int(k) + 1)]
        assert (r["an id"], r["v"], r["note"]) == (i, v, "x" if note == "x" else None) and abs(r["v__roll10_mean"] - mean) < 1e-9
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_stream_without_series_keeps_few_small_tables(spark, tmp_path):
    for step in range(5):
        spark.range(step * 10, step * 10 + 10).selectExpr("timestamp_seconds(id) t", "double(id % 7) v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_score(stream, f"{tmp_path}/out", lambda df: df.withColumn("anomaly_score", F.lit(0.0)), ["v"], (), "t").awaitTermination()
    left = {p.name for p in (tmp_path / "out" / "state").iterdir() if p.name.startswith("batch=")}
    assert left == {"batch=3", "batch=4"} and spark.read.parquet(f"{tmp_path}/out/scores").count() == 50


def test_row_gap_stream_equals_batch(spark, tmp_path):
    """Incidents over restarts from the checkpoint; late rows are counted and take no place."""
    rng = np.random.default_rng(6)
    start = datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 3)) if i % 3 else 0, start + timedelta(seconds=10 * i), i, bool(rng.random() < 0.4), float(rng.integers(0, 50))) for i in range(300)]
    soon = start + timedelta(seconds=1000)
    late = [(0, soon, -1, True, 99.0), (1, soon, -2, True, 99.0), (2, start, -3, True, 99.0)]  # the last one behind the watermark
    last = [(9, start + timedelta(days=2), 1000, False, 0.0)]
    schema = "k bigint, ts timestamp, row bigint, is_alert boolean, anomaly_score double"
    use_state_store(spark)
    for step, part in enumerate((rows[:120], rows[120:] + late, last)):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = stream_incidents_rows(stream, ["k"], 1, "1 hour", "10 minutes", ts="ts", tie="row")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    line = timeline(spark.createDataFrame(rows, schema), ["ts", "row"], keys=["k"])
    want = group_incidents(line, 1, "ts").toPandas()
    names = ["k", "incident_id", "start_ts", "end_ts", "n_rows", "max_score"]
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist())) and len(want) > 30
    assert got.groupby("k")["late_rows"].max().to_dict() == {0: 1, 1: 1, 2: 0}


def test_kept_blocks_stay_as_many_and_a_level_is_one_stage(spark, monkeypatch):
    monkeypatch.setattr(histboost, "REWRITE", 3)
    monkeypatch.setattr(histboost, "KEPT", 64)
    x, y = _boost_rows()
    df = spark.createDataFrame([([None if v != v else float(v) for v in r], int(t)) for r, t in zip(x, y)], "features array<double>, y int")
    parts, real = [], histboost.Kept.step

    def step(self, change):
        real(self, change)
        parts.append(self.now.getNumPartitions())

    monkeypatch.setattr(histboost.Kept, "step", step)
    s = histboost.Settings(trees=8, depth=3)
    spark.sparkContext.setJobGroup("levels", "levels")
    many = histboost.HistBoost.fit(df, "y", s, task_values=0)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getJobInfo(j).stageIds for j in tracker.getJobIdsForGroup("levels")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    one = histboost.HistBoost.fit(df, "y", s)
    assert len(parts) == 7 and len(set(parts)) == 1
    # 24 levels; the blocks are dealt by one more stage, which later jobs list again and skip.
    assert len({i for own in stages for i in own}) < 24 * 2 + 20
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(one.trees, many.trees, strict=True))


def test_search_applies_each_tree_once(spark, monkeypatch):
    x, y = _boost_rows()
    df = spark.createDataFrame([(i, [None if v != v else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "idx long, features array<double>, y int")
    steps, real = [], histboost.Kept.step
    monkeypatch.setattr(histboost.Kept, "step", lambda self, change: (real(self, change), steps.append(self.now.getNumPartitions())))
    fits = [searchboost.Fit(n, histboost.Settings(trees=4, depth=2)) for n in (len(x) // 2, len(x))]
    searchboost.fit_many(df, "y", fits, task_values=0)
    assert len(steps) == 3 and len(set(steps)) == 1


def test_fits_share_trees_until_a_side_is_too_small(spark, monkeypatch):
    """Fits that differ in their least rows only: the trees of single fits, grown once where none of them is too small."""
    x, y = _boost_rows(600)
    df = spark.createDataFrame([(i, [None if v != v else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "idx long, features array<double>, y int")
    fits = [searchboost.Fit(600, histboost.Settings(trees=n, depth=3, rate=0.5, least_rows=k), share) for k, n in ((30, 4), (1, 6), (8, 6), (2, 6)) for share in (1.0, 0.7)]
    columns = ("feature", "cut", "threshold", "missing_left", "value", "gain")
    same = lambda a, b: len(a.trees) == len(b.trees) and all((getattr(s, c) == getattr(t, c)).all() for s, t in zip(a.trees, b.trees) for c in columns)
    single = [searchboost.fit_many(df, "y", [f])[0] for f in fits]
    for values in (None, 0):
        assert all(same(a, b) for a, b in zip(searchboost.fit_many(df, "y", fits, task_values=values), single))
    assert not same(single[2], single[4])
    cuts = [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
    grown, real = [], histboost.grow
    monkeypatch.setattr(histboost, "grow", lambda *args: (grown.append(args[3].least_rows), real(*args))[1])
    source = histboost.InTask(np.ascontiguousarray(histboost.as_bins(x, cuts).T), y.astype(float), 1.0, np.zeros(600))
    searchboost._together(source, cuts, [(k, histboost.Settings(trees=5, depth=1, least_rows=k)) for k in (3, 1, 2)], [])
    assert grown == [1] * 5


def test_many_fits_in_one_pass_equal_single_fits(spark, monkeypatch):
    monkeypatch.setattr(histboost, "BLOCK", 100)
    monkeypatch.setattr(histboost, "REWRITE", 2)
    x, y = _boost_rows()
    rows = [(i, [None if v != v else float(v) for v in r], int(t), "extra") for i, (r, t) in enumerate(zip(x, y))]
    rows += [(len(x), None, 1, ""), (len(x) + 1, [1.0, 2.0, 3.0], None, ""), (None, [1.0, 2.0, 3.0], 1, None)]  # no say
    df = spark.createDataFrame(rows, "idx long, features array<double>, y int, chain string")
    n = len(x)
    small = histboost.Settings(trees=3, depth=2, rate=0.5)
    fits = [searchboost.Fit(s, t, share) for s in (n // 2, n) for t in (small, replace(small, trees=5), replace(small, depth=3)) for share in (1.0, 0.6)]
    one = searchboost.fit_many(df, "y", fits)
    monkeypatch.setattr(searchboost, "PART", 2)
    monkeypatch.setattr(searchboost, "TASK_SUMS", 2 * 3 * 256 * 3 * 4)  # two fits a turn
    many = searchboost.fit_many(df.repartition(5), "y", fits, task_values=0)
    columns = ("feature", "cut", "threshold", "missing_left", "value", "gain")
    same = lambda a, b: len(a.trees) == len(b.trees) and all((getattr(s, c) == getattr(t, c)).all() for s, t in zip(a.trees, b.trees) for c in columns)
    assert [len(m.trees) for m in one] == [f.settings.trees for f in fits]
    assert all(same(a, b) and a.start == b.start for a, b in zip(one, many))
    # A fit of all rows is that of the single operator; a shorter one is its head; a share draws other rows.
    whole = [f for f in fits if f.stop == n]
    alone = searchboost.fit_many(df, "y", whole)
    for f, m in zip(whole, alone):
        single = histboost.HistBoost.fit(df.where("idx is not null"), "y", f.settings)
        assert same(m, single) == (f.share == 1.0)
    scored = df.where("features is not null and y is not null and idx is not null")
    for r in scored.select(searchboost.scores(alone[:2]).alias("s"), alone[1].score().alias("p")).collect():
        assert r["s"][1] == pytest.approx(r["p"], abs=1e-12)
    # The draw keeps the share, within four deviations, and differs between trees.
    idx = np.arange(100_000)
    draws = [searchboost.drawn(idx, t, 0.7, 42) for t in range(3)]
    assert all(abs(d.mean() - 0.7) < 4 * (0.21 / len(idx)) ** 0.5 for d in draws)
    assert abs((draws[0] & draws[1]).mean() - 0.49) < 0.01
    assert searchboost.fit_many(df, "y", []) == []
    with pytest.raises(ValueError):
        searchboost.fit_many(df.where("y = 1"), "y", fits)
    with pytest.raises(ValueError):
        searchboost.fit_many(df, "y", [fits[0], searchboost.Fit(n, replace(small, bins=9))])


def test_grid_search_stops_by_the_rule(kpis):
    configs = [{"maxIter": t, "stepSize": 0.3, "maxDepth": 2, "minInstancesPerNode": 5, "subsamplingRate": 0.85} for t in range(1, 12)]
    out = tuning.tune_gb(kpis, configs=configs, folds=2, min_pos=1, patience=3)
    f2s = [r["val_f2_mean"] for r in out.metrics.orderBy("place").collect()]
    assert ranking.early_stop(f2s, patience=3) == (len(f2s), out.notes["stopped"])
    assert ranking.early_stop(f2s[:-1], patience=3)[1] is None or out.notes["stopped"] is None
    assert out.scorer.transform(kpis_features(kpis, out)).where("anomaly_score is null").count() == 0


def kpis_features(kpis, out):
    return prepare(kpis, KPIS, "D", feature_cols=out.scorer.feature_cols).df


def _pooled(x, y):
    """Brute force: the step of the k-th distinct score is the largest mean over starts of the smallest mean over ends."""
    xs = np.unique(x)
    w = np.array([(x == v).sum() for v in xs])
    s = np.array([y[x == v].sum() for v in xs])
    mean = lambda i, j: s[i:j + 1].sum() / w[i:j + 1].sum()
    n = len(xs)
    return xs, np.array([max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


@pytest.mark.parametrize("case", ["continuous", "ties", "falling", "rising", "late_drop"])
def test_isotonic_equals_brute_force(spark, case):
    rng = np.random.default_rng(5)
    x = rng.random(120)
    y = (rng.random(120) < x).astype(int)
    if case == "ties":
        x = x.round(1)
    elif case == "falling":
        y = (x < 0.5).astype(int)
    elif case == "rising":
        y = (x > 0.5).astype(int)
    elif case == "late_drop":
        y = np.where(x > 0.9, 0, y)
    rows = [(float(a), int(b), "e") for a, b in zip(x, y)] + [(None, 1, ""), (float("nan"), 0, ""), (0.5, None, "")]
    df = spark.createDataFrame(rows, "score double, y int, idx string")
    xs, want = _pooled(x, y)
    probe = spark.createDataFrame([(float(v), "p") for v in [*xs, -1.0, 2.0, float("inf"), *(xs[:-1] + xs[1:]) / 2]] + [(None, "n"), (float("nan"), "n")], "score double, value string")
    expected = [*want, want[0], want[-1], want[-1], *(want[:-1] + want[1:]) / 2]
    for chunk, points in ((65_536, 1 << 18), (7, 8)):
        curve = Isotonic(df.repartition(3), chunk=chunk, points=points)
        assert curve.steps.count() <= len(xs)
        for steps in (65_536, 0):
            out = curve.transform(probe, steps=steps)
            assert out.columns == ["score", "value", "calibrated"]
            got = {(r["score"], r["value"]): r["calibrated"] for r in out.collect() if r["value"] == "p"}
            assert [got[float(v), "p"] for v in [*xs, -1.0, 2.0, float("inf"), *(xs[:-1] + xs[1:]) / 2]] == pytest.approx(expected)
            assert out.where("value = 'n' and calibrated is null").count() == 2


def test_isotonic_of_nothing(spark):
    empty = Isotonic(spark.createDataFrame([(None, 1)], "score double, y int"))
    assert empty.count == 0 and empty.transform(spark.createDataFrame([(0.5,)], "score double")).first()["calibrated"] is None


@pytest.mark.parametrize("keys", [[], ["series"]])
def test_last_rows_give_the_features_of_the_whole_history(spark, keys):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        key = ["a", "a", "b", None, "c"][i % 5] if i % 97 else f"rare{i}"
        gap = key == "b" or rng.random() < (0.9 if key == "a" else 0.2)  # "b" never has a value
        rows.append((key, datetime(2024, 1, 1) + timedelta(seconds=int(rng.integers(0, 300))), i, None if gap else str(float(rng.integers(0, 50))), "bad" if i % 3 else "1.5", "x"))
    df = spark.createDataFrame(rows, "series string, timestamp timestamp, id int, latency string, jitter string, __order string").repartition(7)
    names = ["latency", "jitter"]
    want = prepare_last(df, names, keys)
    got = latest_features(df, names, keys=keys, tie=[])
    columns = [*keys, "timestamp", *[c for c in want.columns if c.startswith(("latency", "jitter", "contrib"))]]
    order = lambda out: sorted((tuple(map(str, r)) for r in out.select(*columns).collect()))
    assert order(got) == order(want)
    assert got.agg(F.sum("window_rows_used")).first()[0] == 900
    linear = latest_features(df, names, keys=keys, fill="linear")
    assert linear.count() == got.count()
    # Few rows a task are left, whatever the length; held rows are flushed early without effect.
    kept = tails.last_rows(df, ["timestamp"], names, 10, keys, held=40)
    assert kept.count() < 900
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan
    flushed = tails.last_rows(df.coalesce(1), ["timestamp"], names, 10, keys, held=40)
    tops = lambda f: {tuple(r) for r in f.groupBy(*keys).agg(F.max("timestamp")).collect()}
    assert tops(flushed) == tops(df)


def prepare_last(df, names, keys):
    line = timeline(df, ["timestamp"], keys=keys)
    made = contributions(add_features(line, names, "A", "both").df, names)
    return latest(made.withColumn("__order", F.col("idx")), "__order", keys)


def test_a_run_killed_half_way_is_not_seen(spark, kpis, tmp_path):
    store = runs.Runs(spark, str(tmp_path / "runs"))
    out = train(kpis, candidates={"RandomForest_base": {"numTrees": 5, "maxDepth": 3}}, runs=store)
    first = out.notes["run_id"]
    assert store.latest("scores", "train").count() == 600 and store.latest("incidents", "train").count() == out.incidents.count()
    assert Scorer.load(spark, f"{store.path('model')}/tag=train/run_id={first}").threshold == out.threshold
    assert '"model"' in store.latest("notes", "train").first()["notes"]

    @F.udf("long")
    def dies(i):
        raise RuntimeError("executor gone")

    broken = replace(out, incidents=out.incidents.withColumn("n_rows", dies("n_rows")))
    with pytest.raises(Exception, match="executor gone"):
        publish(store, "train", broken, "99990101_000000")
    # Its scores were written, but nobody sees them.
    assert spark.read.parquet(f"{store.path('scores')}/tag=train/run_id=99990101_000000").count() == 600
    assert {r["run_id"] for r in store.latest("scores", "train").select("run_id").distinct().collect()} == {first}
    assert {r["run_id"] for r in store.committed().collect()} == {first}
    checked = evaluate(kpis, out.scorer, runs=store)
    assert store.latest("metrics", "eval").first()["f1"] == checked.metrics.first()["f1"]
