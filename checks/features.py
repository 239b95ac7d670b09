"""Order, cleaning, window features, explanations, incidents."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.registry import query, r6, rounded
from checks.views import (E_SQL, RAW_SQL, U_SQL, WIDE_SQL, events, events_line, raw_events,
                          raw_line, users_line, wide_line)
from tidemark.functions import clean, explain
from tidemark.operators import features as feat
from tidemark.operators.fill import fill
from tidemark.operators.incidents import group_incidents
from tidemark.operators.order import positions, windowed
from tidemark.operators.quantile import exact_quantiles, median_fill
from tidemark.session import materialize

ORDER = "over (order by idx"


def _frame(lo: int, hi: int) -> str:
    side = lambda k: "current row" if k == 0 else f"{abs(k)} preceding"
    return f"{ORDER} rows between {side(lo)} and {side(hi)})"


@query("index_events", f"with {E_SQL} select idx, event_id, ts, value from e")
def _(spark, d):
    return events_line(spark, d).df.select("idx", "event_id", "ts", "value")


@query("index_by_series", f"with {U_SQL} select series_key, pos, event_id from u")
def _(spark, d):
    return positions(users_line(spark, d)).select("series_key", "pos", "event_id")


@query("time_sort", """with t as (select event_id, try_cast(case when event_id % 13 = 0 then 'n/a'
  else cast(ts as varchar) end as timestamp) as ts from events)
  select event_id, ts, row_number() over (order by ts, event_id) - 1 as idx from t where ts is not null""")
def _(spark, d):
    from tidemark.operators.order import timeline

    raw = events(spark, d).withColumn(
        "ts", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("ts").cast("string"))
    )
    line = timeline(clean.parse_time(raw, "ts"), ["ts", "event_id"])
    return line.df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "idx")


@query("clean_numeric", f"with {RAW_SQL} select event_id, value from r")
def _(spark, d):
    return raw_events(spark, d).select("event_id", clean.to_number("value").alias("value"))


@query("ffill_bfill", f"""with {RAW_SQL} select idx, event_id, coalesce(
  last_value(value ignore nulls) over (order by idx rows between unbounded preceding and current row),
  first_value(value ignore nulls) over (order by idx rows between current row and unbounded following)) as value from r""")
def _(spark, d):
    line = raw_line(spark, d)
    line = line.with_df(clean.numbers(line.df, ["value"]))
    return fill(line, ["value"], "both").select("idx", "event_id", "value")


@query("ffill_by_series", f"""with {RAW_SQL} select event_id,
  last_value(value ignore nulls) over (partition by series_key order by idx rows between unbounded preceding and current row)
  as value from r""")
def _(spark, d):
    from tidemark.operators.order import timeline

    line = timeline(clean.numbers(raw_events(spark, d), ["value"]), ["ts", "event_id"], keys=["series_key"])
    return fill(line, ["value"], "causal").select("event_id", "value")


LINEAR = """p as (select *, last_value(case when value is not null then idx end ignore nulls) over (order by idx rows between unbounded preceding and current row) as ip,
  last_value(value ignore nulls) over (order by idx rows between unbounded preceding and current row) as vp,
  first_value(case when value is not null then idx end ignore nulls) over (order by idx rows between current row and unbounded following) as nx,
  first_value(value ignore nulls) over (order by idx rows between current row and unbounded following) as vn from r),
  l as (select idx, event_id, ts, label, coalesce(value, vp + (vn - vp) / (nx - ip) * (idx - ip), vp, vn) as value from p)"""


@query("interpolate_linear", f"with {RAW_SQL}, {LINEAR} select idx, event_id, {r6('value', 'value')} from l")
def _(spark, d):
    line = raw_line(spark, d)
    line = line.with_df(clean.numbers(line.df, ["value"]))
    return rounded(fill(line, ["value"], "linear").select("idx", "event_id", "value"))


@query("impute_median_train", f"""with {RAW_SQL}, m as (select quantile_cont(value, 0.5) as med from r
  where idx < (select floor(count(*) * 0.7) from r))
  select event_id, {r6('coalesce(value, med)', 'value')} from r, m""")
def _(spark, d):
    line = raw_line(spark, d)
    df = clean.numbers(line.df, ["value"])
    train = df.where(F.col("idx") < int(line.n * 0.7))
    return rounded(median_fill(df, train, ["value"]).select("event_id", "value"))


@query("impute_median_int", """with x as (select event_id, case when event_id % 5 <> 0 then cast(floor(value) as bigint) end as v from events),
  m as (select quantile_cont(v, 0.5) as med from x) select event_id, round(coalesce(v, med), 6) as v from x, m""")
def _(spark, d):
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 5 != 0, F.floor("value")).alias("v"))
    return rounded(median_fill(df, df, ["v"]))


@query("drop_any_null", f"""with {RAW_SQL} select event_id, value,
  row_number() over (order by ts, event_id) - 1 as idx from r where value is not null""")
def _(spark, d):
    from tidemark.operators.order import timeline

    kept = clean.drop_incomplete(clean.numbers(raw_events(spark, d), ["value"]))
    return timeline(kept, ["ts", "event_id"]).df.select("event_id", "value", "idx")


@query("drop_constant", "select event_id, value from events")
def _(spark, d):
    df = events(spark, d).select("event_id", "value", F.lit(2).alias("bandwidth"), F.lit(None).cast("double").alias("jitter"))
    return clean.drop_constant(df)[0]


@query("feature_select", "select l_quantity, l_tax, l_linenumber from lineitem")
def _(spark, d):
    from checks.views import table

    df = table(spark, d, "lineitem").select(
        "l_quantity", "l_tax", "l_linenumber", "l_returnflag",
        F.col("l_discount").alias("anomaly_latency"), F.col("l_partkey").alias("Network Target id"),
        (F.col("l_returnflag") == "R").cast("int").alias("anomaly"), F.col("l_shipdate").alias("timestamp"),
    )
    return df.select(*clean.feature_columns(df))


@query("time_range", """select event_id, ts, value from events
  where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'""")
def _(spark, d):
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    return events(spark, d).where(F.col("ts").between(low, high)).select("event_id", "ts", "value")


@query("lags", f"""with {E_SQL} select idx, lag(value, 1) {ORDER}) as value__lag1, lag(value, 2) {ORDER}) as value__lag2,
  lag(value, 3) {ORDER}) as value__lag3, {r6(f'value - lag(value) {ORDER})', 'value__delta1')} from e""")
def _(spark, d):
    line = events_line(spark, d)
    out = windowed(line, 3, lambda rows, w: rows.withColumns(feat.lags("value", w) | feat.delta("value", w)))
    return rounded(out.select("idx", "value__lag1", "value__lag2", "value__lag3", "value__delta1"))


@query("diff1", f"with {E_SQL} select idx, {r6(f'coalesce(value - lag(value) {ORDER}), 0)', 'value__diff1')} from e")
def _(spark, d):
    out = windowed(events_line(spark, d), 1, lambda rows, w: rows.withColumns(feat.diff("value", w)))
    return rounded(out.select("idx", "value__diff1"))


def _stats(size: int, lo: int, hi: int, zero: bool) -> str:
    std = f"stddev_samp(value) {_frame(lo, hi)}"
    std = f"coalesce({std}, 0)" if zero else std
    return f"{r6(f'avg(value) {_frame(lo, hi)}', f'value__roll{size}_mean')}, {r6(std, f'value__roll{size}_std')}"


@query("roll_past", f"with {E_SQL} select idx, {_stats(3, -3, -1, False)}, {_stats(6, -6, -1, False)} from e")
def _(spark, d):
    out = windowed(events_line(spark, d), 6, lambda rows, w: rows.withColumns(feat.past("value", w)))
    return rounded(out.select("idx", *[f"value__roll{s}_{k}" for s in (3, 6) for k in ("mean", "std")]))


@query("roll_incl_10", f"with {E_SQL} select idx, {_stats(10, -9, 0, True)} from e")
def _(spark, d):
    out = windowed(events_line(spark, d), 9, lambda rows, w: rows.withColumns(feat.inclusive("value", w, 10)))
    return rounded(out.select("idx", "value__roll10_mean", "value__roll10_std"))


@query("roll_incl_5", f"with {E_SQL} select idx, {_stats(5, -4, 0, True)} from e")
def _(spark, d):
    out = windowed(events_line(spark, d), 4, lambda rows, w: rows.withColumns(feat.inclusive("value", w, 5)))
    return rounded(out.select("idx", "value__roll5_mean", "value__roll5_std"))


@query("roll_by_series", """select event_id, round(avg(value) over w, 6) as value__roll10_mean,
  round(coalesce(stddev_samp(value) over w, 0), 6) as value__roll10_std from events
  window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)""")
def _(spark, d):
    out = windowed(users_line(spark, d), 9, lambda rows, w: rows.withColumns(feat.inclusive("value", w, 10)))
    return rounded(out.select("event_id", "value__roll10_mean", "value__roll10_std"))


def _quant(size: int) -> str:
    f = _frame(-(size - 1), 0)
    return ", ".join(
        r6(f"quantile_cont(value, {q}) {f}", f"value__roll{size}_{n}") for q, n in ((0.5, "median"), (0.1, "q10"), (0.9, "q90"))
    )


@query("roll_quantiles", f"with {E_SQL} select idx, {_quant(5)}, {_quant(10)} from e")
def _(spark, d):
    out = windowed(
        events_line(spark, d), 9,
        lambda rows, w: feat.quantiles(rows, ["value"], w),
    )
    return rounded(out.select("idx", *[f"value__roll{s}_{k}" for s in (5, 10) for k in ("median", "q10", "q90")]))


@query("drift_50", f"""with {E_SQL} select idx,
  round(case when idx >= 49 then avg(value) {_frame(-49, 0)} end, 6) as value_drift,
  round(case when idx >= 49 then avg(label) {_frame(-49, 0)} end, 6) as label_rate from e""")
def _(spark, d):
    out = windowed(
        events_line(spark, d), 49,
        lambda rows, w: rows.withColumns({"value_drift": feat.full_mean("value", w, 50), "label_rate": feat.full_mean("label", w, 50)}),
    )
    return rounded(out.select("idx", "value_drift", "label_rate"))


# The four families on the raw series.
FILLED = """f as (select idx, event_id, ts, label, coalesce(
  last_value(value ignore nulls) over (order by idx rows between unbounded preceding and current row),
  first_value(value ignore nulls) over (order by idx rows between current row and unbounded following)) as value from r)"""
DIFF = r6(f"coalesce(value - lag(value) {ORDER}), 0)", "value__diff1")
LAGS = ", ".join(r6(f"lag(value, {k}) {ORDER})", f"value__lag{k}") for k in (1, 2, 3))


@query("features_a", f"with {RAW_SQL}, {FILLED} select idx, {r6('value', 'value')}, {DIFF}, {_stats(10, -9, 0, True)} from f")
def _(spark, d):
    out = feat.add_features(raw_line(spark, d), ["value"], "A").df
    return rounded(out.select("idx", *feat.family_columns(["value"], "A")))


@query("features_b", f"with {RAW_SQL}, {LINEAR} select idx, {r6('value', 'value')}, {DIFF}, {_stats(5, -4, 0, True)} from l")
def _(spark, d):
    out = feat.add_features(raw_line(spark, d), ["value"], "B").df
    return rounded(out.select("idx", *feat.family_columns(["value"], "B")))


@query("features_c", f"""with {RAW_SQL}, {LINEAR} select idx, {r6('value', 'value')}, {LAGS}, {_stats(5, -4, 0, True)}, {_quant(5)},
  {_stats(10, -9, 0, True)}, {_quant(10)}, {DIFF} from l""")
def _(spark, d):
    out = feat.add_features(raw_line(spark, d), ["value"], "C").df
    return rounded(out.select("idx", *feat.family_columns(["value"], "C")))


@query("features_d", f"""with {RAW_SQL} select idx, {r6('value', 'value')}, {LAGS},
  {r6(f'value - lag(value) {ORDER})', 'value__delta1')}, {_stats(3, -3, -1, False)}, {_stats(6, -6, -1, False)} from r""")
def _(spark, d):
    out = feat.add_features(raw_line(spark, d), ["value"], "D").df
    return rounded(out.select("idx", *feat.family_columns(["value"], "D")))


ROLL10 = "over (order by idx rows between 9 preceding and current row)"
CONTRIB = ", ".join(
    f"abs(({c} - avg({c}) {ROLL10}) / case when coalesce(stddev_samp({c}) {ROLL10}, 0) = 0 then 1e-9 "
    f"else stddev_samp({c}) {ROLL10} end) as contrib_{c}"
    for c in ("l_quantity", "l_extendedprice")
)


@query("contrib_z", f"""with {WIDE_SQL}, c as (select idx, {CONTRIB} from x)
  select idx, round(contrib_l_quantity, 4) as contrib_l_quantity, round(contrib_l_extendedprice, 4) as contrib_l_extendedprice
  from c""")
def _(spark, d):
    kpis = ["l_quantity", "l_extendedprice"]
    out = explain.contributions(feat.add_features(wide_line(spark, d), kpis, "A").df, kpis)
    return rounded(out.select("idx", "contrib_l_quantity", "contrib_l_extendedprice"), 4)


@query("top_contributors", f"""with {WIDE_SQL}, c as (select idx, {CONTRIB} from x)
  select idx, case when contrib_l_quantity >= contrib_l_extendedprice then 'l_quantity' else 'l_extendedprice' end as first_kpi,
  round(greatest(contrib_l_quantity, contrib_l_extendedprice), 4) as first_value, 2 as n_kpis from c""")
def _(spark, d):
    kpis = ["l_quantity", "l_extendedprice"]
    out = explain.contributions(feat.add_features(wide_line(spark, d), kpis, "A").df, kpis)
    top = out.select("idx", explain.top_contributors(kpis).alias("top"))
    return rounded(
        top.select("idx", F.col("top")[0]["kpi"].alias("first_kpi"), F.col("top")[0]["value"].alias("first_value"),
                   F.size("top").alias("n_kpis")), 4)


EXPLAIN_PARTS = ", ".join(
    f"{c}, avg({c}) over (order by idx rows between 3 preceding and 1 preceding) as m_{c}, {c} - lag({c}) over (order by idx) as d_{c}"
    for c in ("l_quantity", "l_extendedprice")
)


@query("explain_rows", f"""with {WIDE_SQL}, c as (select idx, {EXPLAIN_PARTS} from x),
  t as (select idx, abs(l_quantity - m_l_quantity) + abs(d_l_quantity) as sq, abs(l_extendedprice - m_l_extendedprice) + abs(d_l_extendedprice) as sp from c)
  select idx, case when sq is null then 'n/a' when sq >= sp then 'l_quantity,l_extendedprice' else 'l_extendedprice,l_quantity' end as kpis from t""")
def _(spark, d):
    kpis = ["l_quantity", "l_extendedprice"]
    out = feat.add_features(wide_line(spark, d), kpis, "D").df
    text = out.select("idx", explain.explanation(kpis).alias("text"))
    # The numbers inside the text follow each engine's own rounding; the ranking is compared here.
    names = F.array_join(F.transform(F.split("text", "; "), lambda p: F.split(p, ":")[0]), ",")
    return text.select("idx", names.alias("kpis"))


def incident_sql(gap: int) -> str:
    return f"""with {E_SQL}, a as (select idx, ts, value from e where value >= 100),
  s as (select *, case when idx - lag(idx) over (order by idx) > {gap + 1} then 1 else 0 end as b from a),
  g as (select *, sum(b) over (order by idx rows between unbounded preceding and current row) as id from s)
  select cast(id as bigint) as incident_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_rows, max(value) as max_score
  from g group by id"""


def _incidents(spark, d, gap):
    line = events_line(spark, d)
    alerts = line.df.withColumns({"anomaly_score": F.col("value"), "is_alert": F.col("value") >= 100})
    return group_incidents(line.with_df(alerts), gap, ts="ts")


@query("incidents_gap0", incident_sql(0))
def _(spark, d):
    return _incidents(spark, d, 0)


@query("incidents_gap2", incident_sql(2))
def _(spark, d):
    return _incidents(spark, d, 2)


@query("incidents_by_series", f"""with {U_SQL}, a as (select series_key, pos, ts, value from u where value >= 60),
  s as (select *, case when pos - lag(pos) over (partition by series_key order by pos) > 2 then 1 else 0 end as b from a),
  g as (select *, sum(b) over (partition by series_key order by pos rows between unbounded preceding and current row) as id from s)
  select series_key, cast(id as bigint) as incident_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_rows,
  max(value) as max_score from g group by series_key, id""")
def _(spark, d):
    line = users_line(spark, d)
    alerts = line.df.withColumns({"anomaly_score": F.col("value"), "is_alert": F.col("value") >= 60})
    return group_incidents(line.with_df(alerts), 1, ts="ts")


@query("flagship", """with w as (select row_number() over (order by ts, event_id) - 1 as idx, ts, value,
  avg(value) over f as m, coalesce(stddev_samp(value) over f, 0) as s from events
  window f as (order by ts, event_id rows between 9 preceding and current row)),
  c as (select idx, ts, abs((value - m) / case when s = 0 then 1e-9 else s end) as score from w),
  a as (select * from c where score >= (select quantile_cont(score, 0.99) from c)),
  b as (select *, case when idx - lag(idx) over (order by idx) > 1 then 1 else 0 end as brk from a),
  g as (select *, sum(brk) over (order by idx rows between unbounded preceding and current row) as id from b)
  select cast(id as bigint) as incident_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_rows, round(max(score), 6) as max_score
  from g group by id""")
def _(spark, d):
    made = feat.add_features(events_line(spark, d), ["value"], "A")
    scored = explain.contributions(made.df, ["value"]).select("idx", "ts", F.col("contrib_value").alias("anomaly_score"))
    scored = materialize(scored, "scored")
    threshold = exact_quantiles(scored, ["anomaly_score"], [0.99])["anomaly_score"][0]
    alerts = scored.withColumn("is_alert", F.col("anomaly_score") >= F.lit(threshold))
    return rounded(group_incidents(made.with_df(alerts), 0, ts="ts"))
