"""Positions, windows and running totals do not depend on how the rows are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import drop_constant, drop_incomplete, feature_columns, numbers, parse_time, require
from tidemark.operators import features as feat
from tidemark.operators import order
from tidemark.operators.fill import fill
from tidemark.operators.order import from_indexed, positions, reindex, running_totals, timeline, windowed


def series(n=600, seed=1, hot=1 / 3):
    """Rows in random order; one series holds at least a third of them, some times are equal."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < hot, 0, rng.integers(1, 12, n))
    value = np.where(rng.random(n) < 0.2, np.nan, rng.normal(10, 3, n).round(3))
    pdf = pd.DataFrame({"k": key, "t": rng.integers(0, n // 3, n), "id": rng.permutation(n), "v": value})
    return pdf


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_dense_and_sorted(spark, partitions):
    pdf = series()
    got = timeline(to_spark(spark, pdf), ["t", "id"], partitions=partitions).df.toPandas().sort_values("idx")
    want = pdf.sort_values(["t", "id"])
    assert got["idx"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == want["id"].tolist()


def test_one_time_for_a_third_of_the_rows_is_split_by_the_tiebreak(spark):
    pdf = series()
    pdf.loc[:250, "t"] = 5
    line = timeline(to_spark(spark, pdf), ["t", "id"], partitions=8)
    assert line.df.toPandas().sort_values("idx")["id"].tolist() == pdf.sort_values(["t", "id"])["id"].tolist()


def test_equal_times_have_one_order_and_are_split(spark):
    df = spark.range(4000).select(F.lit(7).alias("t"), "id")
    runs_ = []
    for parts in (8, 3):
        line = timeline(df.repartition(parts), ["t"], partitions=8)
        files = line.df.select(F.input_file_name().alias("f")).groupBy("f").count().agg(F.max("count")).first()[0]
        assert files < 2000
        runs_.append([r["id"] for r in line.df.orderBy("idx").collect()])
    assert runs_[0] == runs_[1]


@pytest.mark.parametrize("chunk", [11, 64, 10_000])
@pytest.mark.parametrize("keyed", [False, True])
def test_families_do_not_depend_on_chunks(spark, chunk, keyed):
    pdf = series()
    keys = ["k"] if keyed else []
    line = timeline(to_spark(spark, pdf), ["t", "id"], keys=keys, partitions=5, chunk=max(chunk, 19))
    ordered = pdf.sort_values(["k", "t", "id"] if keyed else ["t", "id"])
    groups = ordered.groupby("k") if keyed else [(0, ordered)]
    for family in "ABCD":
        want = []
        for _, g in groups:
            v = g["v"]
            if family == "A":
                v = v.ffill().bfill()
            elif family in "BC":
                v = v.reset_index(drop=True).interpolate(limit_direction="both").set_axis(g.index)
            out = pd.DataFrame({"id": g["id"], "v": v})
            if family in "ABC":
                out["v__diff1"] = v.diff().fillna(0.0)
                for w in {"A": [10], "B": [5], "C": [5, 10]}[family]:
                    out[f"v__roll{w}_mean"] = v.rolling(w, min_periods=1).mean()
                    out[f"v__roll{w}_std"] = v.rolling(w, min_periods=1).std().fillna(0.0)
                    if family == "C":
                        out[f"v__roll{w}_median"] = v.rolling(w, min_periods=1).median()
                        out[f"v__roll{w}_q10"] = v.rolling(w, min_periods=1).quantile(0.1)
                        out[f"v__roll{w}_q90"] = v.rolling(w, min_periods=1).quantile(0.9)
            if family in "CD":
                for k in (1, 2, 3):
                    out[f"v__lag{k}"] = v.shift(k)
            if family == "D":
                out["v__delta1"] = v - v.shift(1)
                for w in (3, 6):
                    out[f"v__roll{w}_mean"] = v.shift(1).rolling(w, min_periods=1).mean()
                    out[f"v__roll{w}_std"] = v.shift(1).rolling(w, min_periods=1).std()
            want.append(out)
        want = pd.concat(want).sort_values("id").reset_index(drop=True)
        cols = feat.family_columns(["v"], family)
        got = feat.add_features(line, ["v"], family).df.select("id", *cols).toPandas().sort_values("id").reset_index(drop=True)
        pd.testing.assert_frame_equal(got[["id", *cols]], want[["id", *cols]], check_dtype=False, atol=1e-8)


@pytest.mark.parametrize("method", ["both", "causal", "linear"])
def test_fill_at_the_ends(spark, method):
    pdf = pd.DataFrame({"t": range(60), "v": [np.nan] * 25 + [1.0] + [np.nan] * 20 + [5.0] + [np.nan] * 13})
    line = timeline(to_spark(spark, pdf), ["t"], partitions=4, chunk=7)
    got = fill(line, ["v"], method).toPandas().sort_values("t")["v"].reset_index(drop=True)
    want = {"both": pdf["v"].ffill().bfill(), "causal": pdf["v"].ffill(), "linear": pdf["v"].interpolate(limit_direction="both")}[method]
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_all_null_column_stays_null(spark):
    df = spark.range(40).select(F.col("id").alias("t"), F.lit(None).cast("double").alias("v"))
    line = timeline(df, ["t"], chunk=9)
    for method in ("both", "causal", "linear"):
        assert fill(line, ["v"], method).where("v is not null").count() == 0


def test_running_totals_and_positions_by_series(spark):
    pdf = series()
    pdf["one"] = 1
    line = timeline(spark.createDataFrame(pdf[["k", "t", "id", "one"]]), ["t", "id"], keys=["k"], partitions=6, chunk=17)
    want = pdf.sort_values(["k", "t", "id"])
    want = want.assign(c=want.groupby("k")["id"].cumsum(), pos=want.groupby("k").cumcount()).sort_values("id")
    sums = running_totals(line, {"c": F.col("id")}).toPandas().sort_values("id")
    assert sums["c"].tolist() == want["c"].tolist()
    assert positions(line).toPandas().sort_values("id")["pos"].tolist() == want["pos"].tolist()


def test_reindex_keeps_order(spark):
    line = timeline(spark.range(500).withColumn("t", 1000 - F.col("id")), ["t"], partitions=4, chunk=50)
    again = reindex(line, line.df.where("id % 3 = 0"))
    got = again.df.toPandas().sort_values("idx")
    assert again.n == 167 and got["idx"].tolist() == list(range(167))
    assert got["id"].tolist() == sorted(range(0, 500, 3), reverse=True)


def test_windows_use_no_single_partition_over_rows(spark):
    line = timeline(spark.range(20_000).withColumnRenamed("id", "t"), ["t"], partitions=4, chunk=500)
    out = windowed(line, 9, lambda rows, w: rows.withColumn("m", F.avg("t").over(w.rowsBetween(-9, 0))))
    assert out.count() == 20_000
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_and_single_row_tables(spark):
    none = timeline(spark.range(0).withColumnRenamed("id", "t").withColumn("v", F.lit(1.0)), ["t"])
    assert none.n == 0 and feat.add_features(none, ["v"], "A").df.count() == 0
    one = timeline(spark.range(1).withColumnRenamed("id", "t").withColumn("v", F.lit(2.0)), ["t"])
    row = feat.add_features(one, ["v"], "A").df.first()
    assert (row["v__diff1"], row["v__roll10_mean"], row["v__roll10_std"]) == (0.0, 2.0, 0.0)


def test_cleaning(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "1.5", "a"), ("junk", "2", "b"), ("2024-01-02", "NaN", None), ("2024-01-03", "x", "c")],
                               "timestamp string, v string, s string")
    timed = parse_time(df)
    assert timed.count() == 3
    assert [r["v"] for r in numbers(timed, ["v"]).orderBy("timestamp").collect()] == [1.5, None, None]
    assert parse_time(df.drop("timestamp")).count() == 4
    assert drop_incomplete(numbers(timed, ["v"])).count() == 1
    with pytest.raises(ValueError, match="latency"):
        require(df, ["latency"])


def test_constant_and_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None, 5, "x", 0, 1.0), (1, 3.0, None, 6, "y", 1, 2.0)],
                               "a int, b double, c double, anomaly_x int, s string, anomaly int, `Network Target` double")
    assert drop_constant(df)[1] == ["a", "c"]
    assert feature_columns(df) == ["a", "b", "c"]


def test_keyed_carry_needs_one_row_exchange(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i % 3 or None, i, float(i) if i % 4 else None) for i in range(50)], "k int, t int, v double")
        plan = fill(timeline(rows, ["t"], keys=["k"], chunk=8), ["v"]).toDF("k", "t", "v", "idx")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    above = plan[: plan.index("Join")]
    assert "Window" in above and "Exchange" not in above  # the windows use the join's partitioning


def test_one_row_table_counts_one(spark):
    assert from_indexed(spark.createDataFrame([(0, 1.0)], "idx bigint, v double")).n == 1
    assert from_indexed(spark.createDataFrame([], "idx bigint, v double")).n == 0


def test_text_times_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2024-01-01 00:00:00", "2024-01-01", "2024-01-01T00:00:00Z", "2024-01-01 02:00:00+02:00", "2023-12-31 19:00:00 America/New_York", "n/a"]
        df = spark.createDataFrame([(t,) for t in texts], "timestamp string")
        got = [r[0] for r in parse_time(df).select(F.unix_timestamp("timestamp")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1704067200] * 5


def test_nan_is_no_second_value(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, 2.0)], "a double, b double")
    assert drop_constant(df)[1] == ["a"]


def test_maps_and_arrays_decide_ties(spark):
    rows = [(1, {"a": i}, [i]) for i in range(20)]
    df = spark.createDataFrame(rows, "t int, m map<string,int>, a array<int>")
    first, second = ([r["a"] for r in timeline(df.repartition(n), ["t"]).df.orderBy("idx").collect()] for n in (1, 5))
    assert first == second


def test_estimates_of_joins_do_not_multiply_ranges(spark, tmp_path):
    """The planner takes a join for the product of its sides; a small one is not sorted in thousands of ranges."""
    for name in ("a", "b"):
        spark.range(200_000).selectExpr("id", "hash(id) as v", "uuid() as text").write.parquet(f"{tmp_path}/{name}")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    joined = a.join(b.select("id", F.col("v").alias("u")), "id").groupBy("v").agg(F.sum("u").alias("u"))
    assert order._ranges(joined) is None
    # Tables that are large themselves still get their ranges.
    assert order._ranges(spark.read.parquet(f"{tmp_path}/a")) is None
