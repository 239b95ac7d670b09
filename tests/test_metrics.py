"""Ranking metrics, thresholds and splits against small literal cases and plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as fs
from tidemark.operators import metrics as m
from tidemark.operators import ranking, splits
from tidemark.operators import thresholds as th
from tidemark.operators.profile import class_histogram
from tidemark.operators.quantile import exact_quantiles, median_fill


def scored(spark, scores, labels, **extra):
    return spark.createDataFrame(pd.DataFrame({"idx": range(len(scores)), "score": np.array(scores, float), "y": np.array(labels, int), **extra}))


def rates(df):
    points = m.curve(df)
    row = points.agg(m.average_precision().alias("ap"), m.roc_auc().alias("auc")).first()
    return row["ap"], row["auc"]


def test_known_four_rows(spark):
    ap, auc = rates(scored(spark, [0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0]))
    assert ap == pytest.approx(0.8333333333) and auc == pytest.approx(0.75)


def test_all_scores_equal(spark):
    ap, auc = rates(scored(spark, [1, 1, 1, 1], [1, 0, 0, 0]))
    assert ap == pytest.approx(0.25) and auc == pytest.approx(0.5)


def test_one_class(spark):
    assert rates(scored(spark, [1, 2, 3], [0, 0, 0])) == (0.0, None)
    ap, auc = rates(scored(spark, [1, 2, 3], [1, 1, 1]))
    assert ap == pytest.approx(1.0) and auc is None
    row = m.metric_bundle(scored(spark, [1, 2, 3], [0, 0, 0]), 2.0).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 2, 0, 1) and row["f2"] == 0.0


def test_average_precision_ignores_monotone_maps(spark):
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=300).round(1), rng.integers(0, 2, 300)
    df = scored(spark, s, y)
    assert rates(df) == pytest.approx(rates(df.withColumn("score", F.exp("score") * 3 + 1)))


def test_published_fold_counts(spark):
    # tp, fp, fn, tn of five published folds with their F2, mean and population deviation.
    folds = [(8, 3, 1, 138), (7, 2, 2, 139), (4, 2, 6, 138), (12, 18, 0, 120), (13, 9, 0, 128)]
    want = [0.851064, 0.777778, 0.434783, 0.769231, 0.878378]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(folds)], "fold int, tp long, fp long, fn long, tn long").withColumns(fs.rates())
    got = [r["f2"] for r in df.orderBy("fold").collect()]
    assert got == pytest.approx(want, abs=1e-6)
    row = m.fold_summary(df, ["f2"]).first()
    assert (row["f2_mean"], row["f2_std"]) == pytest.approx((0.742247, 0.159310), abs=1e-6)


def brute_points(s, y):
    out = []
    for t in sorted(set(s)):
        tp, fp, fn = int(((s >= t) & (y == 1)).sum()), int(((s >= t) & (y == 0)).sum()), int(((s < t) & (y == 1)).sum())
        out.append((t, tp / (tp + fp), tp / max(1, tp + fn), 5 * tp / (5 * tp + 4 * fn + fp) if tp + fn + fp else 0.0))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_thresholds_match_brute_force_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    s, y = rng.integers(0, 12, 80).astype(float), rng.integers(0, 2, 80)
    points, df = brute_points(s, y), scored(spark, s, y)
    curve = m.curve(df)
    first = lambda items, key: max(items, key=key)  # the lowest threshold wins ties
    assert th.best_f2(curve).first()["threshold"] == first(points, lambda p: p[3])[0]
    keep = [p for p in points if p[2] >= 0.7]
    assert th.recall_floor_f2(curve, 0.7).first()["threshold"] == first(keep, lambda p: p[3])[0]
    keep = [p for p in points if p[2] >= 0.9]
    assert th.recall_floor_precision(curve, 0.9).first()["threshold"] == first(keep, lambda p: p[1])[0]
    keep = [p for p in points if p[1] >= 0.55] or [(max(s), 1.0, 0.0)]
    assert th.precision_floor(curve, 0.55).first()["threshold"] == first(keep, lambda p: p[2])[0]


def test_unreachable_floors(spark):
    curve = m.curve(scored(spark, [1, 2, 3, 4], [1, 0, 0, 0]))
    assert th.recall_floor_f2(curve, 1.5).first()["threshold"] is None
    assert th.recall_floor_precision(curve, 1.5).first()["threshold"] == 1.0
    top = th.precision_floor(curve, 0.9).first()
    assert (top["threshold"], top["precision"], top["recall"]) == (4.0, 1.0, 0.0)
    empty = m.curve(scored(spark, [1], [1]).where("idx < 0"))
    assert th.best_f2(empty).first()["threshold"] == 0.5


def test_f1_sweep(spark):
    rng = np.random.default_rng(3)
    s, y = rng.normal(size=400), rng.integers(0, 2, 400)
    best = (-1.0, None)
    for t in np.quantile(s, np.linspace(0.80, 0.995, 50)):
        tp, fp, fn = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum(), ((s < t) & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        best = (f1, t) if f1 > best[0] else best
    row = th.best_f1_sweep(scored(spark, s, y)).first()
    assert (row["f1"], row["threshold"]) == pytest.approx(best)


def test_alert_budget_is_kept(spark):
    s = np.random.default_rng(4).normal(size=1000)
    df = scored(spark, s, np.zeros(1000))
    assert df.where(F.col("score") >= th.alert_budget(df, "score", 0.05)).count() <= 50


def test_top_shares_and_ties(spark):
    df = scored(spark, [5.0] * 50 + [1.0] * 50, [0] * 45 + [1] * 5 + [0] * 50)
    row = m.at_top(df, shares=(0.05,)).first()
    # The five best rows are the latest of the tied ones.
    assert (row["precision_at_5p"], row["recall_at_5p"]) == (1.0, 1.0)
    small = m.at_top(scored(spark, [1.0, 2.0], [0, 0])).first()
    assert small["precision_at_1p"] == 0.0 and small["recall_at_10p"] == 0.0


def test_groups_equal_separate_runs(spark):
    rng = np.random.default_rng(5)
    n = 400
    df = scored(spark, rng.integers(0, 40, n), rng.integers(0, 2, n), g=np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n)))
    together = {r["g"]: r.asDict() for r in m.metric_bundle(df, 20.0, keys=["g"]).collect()}
    for g, row in together.items():
        alone = m.metric_bundle(df.where(F.col("g") == g), 20.0).first().asDict()
        assert {k: row[k] for k in alone} == pytest.approx(alone)


@pytest.mark.parametrize("kind", ["spread", "ties", "hot"])
def test_quantiles_by_brackets(spark, kind):
    rng = np.random.default_rng(6)
    v = {"spread": rng.normal(size=5000), "ties": rng.integers(0, 9, 5000).astype(float),
         "hot": np.where(rng.random(5000) < 0.4, 3.0, rng.normal(size=5000))}[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.95, 0.99, 1.0]
    assert exact_quantiles(df, ["v"], probs, few=40)["v"] == pytest.approx(list(np.quantile(v, probs)))


def test_median_of_an_even_count_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "a double, b double")
    out = median_fill(df, df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in out) == [1.0, 2.0, 2.5, 3.0, 10.0] and all(r["b"] is None for r in out)


def test_published_folds(spark):
    df = spark.range(1001).select(F.col("id").alias("idx"), F.lit(1).alias("y"))
    folds = splits.rolling_splits_min_pos(df, 1001)
    assert [(f.train_end - 1, f.val_end - 1, f.test_end - 1) for f in folds] == [
        (599, 749, 899), (624, 774, 924), (649, 799, 949), (674, 824, 974), (699, 849, 999)]
    assert splits.rolling_splits_min_pos(df.withColumn("y", F.lit(0)), 1001) == []


def test_fewer_folds_when_positives_are_late(spark):
    df = spark.range(1001).select(F.col("id").alias("idx"), (F.col("id") >= 990).cast("int").alias("y"))
    folds = splits.rolling_splits_min_pos(df, 1001)
    assert [(f.fold, f.test_end) for f in folds] == [(1, 1000)]


def test_slices():
    assert splits.expanding_slices(3) == []
    assert [(f.train_end, f.val_end) for f in splits.expanding_slices(100)] == [(50, 60), (70, 80), (90, 100)]
    assert [(f.train_end, f.val_end) for f in splits.equal_slices(103)] == [(28, 53), (53, 78), (78, 103)]
    assert splits.chrono_split(1001) == (1, 700, 850, 1001)
    assert len(splits.rolling_splits(1000)) == 2


def test_early_stop():
    assert ranking.early_stop([0.5] * 30) == (21, "no_f2_improvement_20")
    assert ranking.early_stop([0.5] * 10 + [0.6] * 10) == (20, None)
    assert ranking.early_stop([i / 100 for i in range(80)]) == (60, "max_configs_reached")
    # Small steps add up against the checkpoint.
    assert ranking.early_stop([0.5 + 0.001 * i for i in range(40)])[1] is None


def test_alert_sources(spark):
    df = spark.createDataFrame([(1.0, True, 0), (3.0, False, 1)], "score double, is_alert boolean, pred_label int")
    flags = lambda d, **k: [r["is_alert"] for r in ranking.resolve_alerts(d, **k).orderBy("score").collect()]
    assert flags(df, threshold=2.0) == [False, True]
    assert flags(df) == [True, False]
    assert flags(df.drop("is_alert")) == [False, True]
    assert flags(df.drop("is_alert", "pred_label")) == [False, False]
    with pytest.raises(ValueError):
        ranking.resolve_alerts(df.drop("score"))


def test_brackets_are_cut_around_the_ranks(spark, monkeypatch):
    """One round leaves few of 20,000 rows around each rank; a value is compared with the cuts around the ranks only."""
    from tidemark.operators import quantile

    rounds, real = [], quantile._tagged
    monkeypatch.setattr(quantile, "_tagged", lambda values, brackets: (rounds.append(len(brackets)), real(values, brackets))[1])
    v = np.random.default_rng(8).normal(size=20_000)
    v[:4000] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"v": v, "u": -v}))
    got = exact_quantiles(df, ["v", "u"], [0.0, 0.1, 0.5, 0.9, 1.0], few=40)
    for c, x in (("v", v), ("u", -v)):
        assert got[c] == pytest.approx(list(np.quantile(x, [0.0, 0.1, 0.5, 0.9, 1.0])), abs=1e-12)
    assert len(rounds) <= 2 and rounds[0] == 2


def test_quantiles_with_infinities_and_job_count(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=3000), [np.inf] * 40, [-np.inf] * 40])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], few=40)["v"] == [-np.inf, pytest.approx(np.quantile(v, 0.5)), np.inf]
    wide = df.select(*[(F.col("v") + i).alias(f"c{i}") for i in range(50)])

    def jobs(cols):
        spark.sparkContext.setJobGroup(f"q{len(cols)}", "")
        exact_quantiles(wide, cols, [0.25, 0.5])
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"q{len(cols)}"))
        spark.sparkContext.setJobGroup("", "")
        return done

    assert jobs(["c0"]) == jobs(wide.columns)


def test_medians_of_integers_are_exact(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "a int")
    assert sorted(r["a"] for r in median_fill(df, df, ["a"]).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_operating_points_without_validation_rows(spark):
    rows = scored(spark, [0.1, 0.9], [0, 1])
    got = th.operating_points(rows.where("idx < 0"), rows).collect()
    assert {r["threshold"] for r in got} == {th.NO_SCORES} and len(got) == 3


def test_many_classes(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("c"), F.col("id").cast("double").alias("v"))
    got = class_histogram(df, "v", "c", 4)
    assert got.count() == 6000 and got.agg(F.sum("n")).first()[0] == 6000
