"""Scaling, audit, controls, sources, latest rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from checks.features import incident_sql
from checks.registry import query, rounded
from checks.views import (E_SQL, WIDE_KPIS, WIDE_SQL, events, events_line, raw_events, table, users_line,
                          wide, wide_line)
from tidemark.functions import clean, explain
from tidemark.operators import features as feat
from tidemark.operators import profile, ranking, sanity, scale
from tidemark.operators.incidents import group_incidents
from tidemark.operators.thresholds import quantile_threshold
from tidemark.session import new_path
from tidemark.sources import runs, tables

TRAIN_SQL = "n as (select floor(count(*) * 0.7) as cut from lineitem)"


def _train(line):
    return line.df.where(F.col("idx") < int(line.n * 0.7))


def _spread(c: str) -> str:
    return f"quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as s_{c}"


ROBUST_SQL = f"""with {WIDE_SQL}, {TRAIN_SQL}, q as (select {', '.join(_spread(c) for c in WIDE_KPIS)} from x, n where idx < cut),
  z as (select idx, {', '.join(f'({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end as {c}' for c in WIDE_KPIS)} from x, q)"""


@query("robust_scale", f"{ROBUST_SQL} select idx, {', '.join(f'round({c}, 6) as {c}' for c in WIDE_KPIS)} from z")
def _(spark, d):
    line = wide_line(spark, d)
    return rounded(scale.scaled(line.df, scale.fit_robust(_train(line), WIDE_KPIS)).select("idx", *WIDE_KPIS))


@query("standard_scale", f"""with {WIDE_SQL}, {TRAIN_SQL}, q as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in WIDE_KPIS)} from x, n where idx < cut)
  select idx, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) as {c}' for c in WIDE_KPIS)} from x, q""")
def _(spark, d):
    line = wide_line(spark, d)
    return rounded(scale.scaled(line.df, scale.fit_standard(_train(line), WIDE_KPIS)).select("idx", *WIDE_KPIS))


@query("l2_baseline", f"""{ROBUST_SQL}, y as (select idx, sqrt({' + '.join(f'{c} * {c}' for c in WIDE_KPIS)}) as s from z),
  t as (select quantile_cont(s, 0.99) as thr from y, n where idx < cut)
  select idx, round(s, 6) as anomaly_score, s >= thr as is_alert from y, t, n where idx >= floor((select count(*) from lineitem) * 0.85)""")
def _(spark, d):
    line = wide_line(spark, d)
    scored = scale.scaled(line.df, scale.fit_robust(_train(line), WIDE_KPIS)).select("idx", scale.l2_norm(WIDE_KPIS).alias("score"))
    thr = quantile_threshold(scored.where(F.col("idx") < int(line.n * 0.7)), "score", 0.99)
    test = ranking.resolve_alerts(scored.where(F.col("idx") >= int(line.n * 0.85)), thr)
    return rounded(test.select("idx", "anomaly_score", "is_alert"))


@query("class_weights", """with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_returnflag = 'R' as int) as y from lineitem),
  n as (select count(*) as n, sum(y) as pos from x)
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(case when y = 1 then n / (2.0 * pos) else n / (2.0 * (n - pos)) end, 6) as balanced,
  round(case when y = 1 then (n - pos) / pos else 1.0 end, 6) as ratio from x, n""")
def _(spark, d):
    df = wide(spark, d)
    neg, pos = scale.class_counts(df, "anomaly")
    out = df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scale.balanced_weight("anomaly", neg, pos).alias("balanced"),
                    scale.ratio_weight("anomaly", neg, pos).alias("ratio"))
    return rounded(out)


@query("audit_summary", """select count(*) as rows, 5 as cols, round(avg(cast(event_type = 'error' as int)), 9) as label_rate, 'value' as string_cols from events""")
def _(spark, d):
    return rounded(profile.audit(raw_events(spark, d), "label"), 9)


@query("audit_missing", """with x as (select * from events), s as (select 'value' as "column", avg(cast(event_id % 7 = 0 and event_id % 11 <> 0 as int)) as missing from x
  union all select c, 0.0 from (select unnest(['event_id', 'label', 'series_key', 'ts']) as c), (select count(*) from x))
  select "column", round(missing, 9) as missing from s order by s.missing desc, "column" limit 10""")
def _(spark, d):
    return rounded(profile.missing_top(raw_events(spark, d)), 9)


@query("hist_by_class", """with x as (select cast(event_type = 'error' as int) as label, value from events),
  r as (select label, min(value) as lo, max(value) as hi from x group by label),
  b as (select x.label, least(29, floor((value - lo) / (hi - lo) * 30)) as bin, count(*) as n from x join r on x.label = r.label group by 1, 2),
  g as (select label, cast(i as int) as bin, lo + (hi - lo) * i / 30 as bin_start from r, range(0, 30) t(i))
  select g.label, g.bin, round(bin_start, 9) as bin_start, coalesce(n, 0) as n from g left join b on g.label = b.label and g.bin = b.bin""")
def _(spark, d):
    return rounded(profile.class_histogram(events(spark, d), "value", "label"), 9)


@query("corr_matrix", "with x as (select " + ", ".join(f"corr({a}, {b}) as {a}__{b}" for a, b in product(WIDE_KPIS, WIDE_KPIS)) + " from lineitem) "
       + " union all ".join(f"select '{a}' as a, '{b}' as b, round({a}__{b}, 9) as corr from x" for a, b in product(WIDE_KPIS, WIDE_KPIS)))
def _(spark, d):
    return rounded(profile.correlations(table(spark, d, "lineitem"), WIDE_KPIS), 9)


@query("shift_wrap", f"""with {E_SQL}, n as (select count(*) as n from e) select e.idx, e.label, p.value from e, n, e p where p.idx = (e.idx - 1 + n) % n""")
def _(spark, d):
    line = events_line(spark, d)
    return sanity.shift_rows(line.df.select("idx", "label", "value"), ["value"], line.n)


@query("shuffle_labels", f"""with {E_SQL}, m as (select label, row_number() over (order by md5(cast(idx as varchar) || '-42'), idx) - 1 as spot from e)
  select e.idx, e.value, m.label from e join m on e.idx = m.spot""")
def _(spark, d):
    return sanity.shuffle_column(events_line(spark, d).df.select("idx", "value", "label"), "label", 42)


@query("shuffle_blocks", f"""with {E_SQL}, m as (select value, idx // 50 as b, row_number() over (partition by idx // 50 order by md5(cast(idx as varchar) || '-42'), idx) - 1 as spot from e)
  select e.idx, m.value, e.label from e join m on e.idx // 50 = m.b and e.idx % 50 = m.spot""")
def _(spark, d):
    return sanity.shuffle_blocks(events_line(spark, d).df.select("idx", "value", "label"), ["value"])


COLS = ("l_quantity", "l_tax")


@query("shuffle_features", f"""with {WIDE_SQL}, """ + ", ".join(
    f"m{i} as (select {c}, row_number() over (order by md5(cast(idx as varchar) || '-{c}-42'), idx) - 1 as spot from x)" for i, c in enumerate(COLS))
    + " select x.idx, m0.l_quantity, m1.l_tax, x.anomaly from x join m0 on x.idx = m0.spot join m1 on x.idx = m1.spot")
def _(spark, d):
    return sanity.shuffle_features(wide_line(spark, d).df.select("idx", *COLS, "anomaly"), COLS)


@query("latest_row", """with w as (select user_id as series_key, event_id, ts, value, coalesce(value - lag(value) over v, 0) as value__diff1,
  avg(value) over r as m, coalesce(stddev_samp(value) over r, 0) as s, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events
  window v as (partition by user_id order by ts, event_id), r as (partition by user_id order by ts, event_id rows between 9 preceding and current row))
  select series_key, event_id, ts, value, round(value__diff1, 6) as value__diff1, round(abs((value - m) / case when s = 0 then 1e-9 else s end), 4) as contrib_value from w where k = 1""")
def _(spark, d):
    scored = explain.contributions(feat.add_features(users_line(spark, d), ["value"], "A").df, ["value"])
    last = ranking.latest(scored, "ts", ["series_key"], "event_id")
    out = last.select("series_key", "event_id", "ts", "value", F.round("value__diff1", 6).alias("value__diff1"), F.round("contrib_value", 4).alias("contrib_value"))
    return out


@query("last_incidents", incident_sql(0) + " order by start_ts desc, incident_id desc limit 10")
def _(spark, d):
    line = events_line(spark, d)
    alerts = line.df.withColumns({"anomaly_score": F.col("value"), "is_alert": F.col("value") >= 100})
    return ranking.top_rows(group_incidents(line.with_df(alerts), 0, ts="ts"), ["start_ts", "incident_id"], 10)


@query("hist_many_classes", """with r as (select user_id as label, min(value) as mi, max(value) as ma from events group by 1),
  q as (select label, case when ma > mi then mi else mi - 0.5 end as lo, case when ma > mi then ma - mi else 1.0 end as w from r),
  b as (select q.label, least(4, floor((value - lo) / w * 5)) as bin, count(*) as n from events join q on user_id = q.label group by 1, 2),
  g as (select label, cast(i as int) as bin, lo + w * i / 5 as bin_start from q, range(0, 5) t(i))
  select g.label, g.bin, round(bin_start, 6) as bin_start, coalesce(n, 0) as n from g left join b on g.label = b.label and g.bin = b.bin""")
def _(spark, d):
    rows = events(spark, d).select(F.col("series_key").alias("label"), "value")
    return rounded(profile.class_histogram(rows, "value", "label", 5))


def _runs(spark, d):
    tags = F.create_map(*[F.lit(v) for kv in {"view": "timecv_tune_gb", "click": "timecv_models", "purchase": "train", "error": "eval", "signup": "calibrate"}.items() for v in kv])
    return table(spark, d, "events").select(
        tags[F.col("event_type")].alias("tag"), F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"),
        ((F.col("event_type") != "view") & (F.col("event_id") % 2 == 0) | (F.col("event_type") == "purchase")).alias("has_scores"),
    )


RUN_SQL = """r as (select case event_type when 'view' then 'timecv_tune_gb' when 'click' then 'timecv_models' when 'purchase' then 'train' when 'error' then 'eval' else 'calibrate' end as tag,
  strftime(ts, '%Y%m%d') || '_' || lpad(cast(event_id as varchar), 12, '0') as run_id, (event_type <> 'view' and event_id % 2 = 0) or event_type = 'purchase' as has_scores from events)"""


@query("latest_run", f"with {RUN_SQL} select tag, max(run_id) as run_id from r group by tag")
def _(spark, d):
    return runs.latest_runs(_runs(spark, d))


@query("source_priority", f"""with {RUN_SQL}, l as (select tag, arg_max(has_scores, run_id) as ok, max(run_id) as run_id from r group by tag)
  select tag, run_id from l where ok and tag <> 'calibrate' order by list_position(['timecv_tune_gb', 'timecv_models', 'train', 'eval'], tag) limit 1""")
def _(spark, d):
    return runs.resolve_source(_runs(spark, d))


@query("incident_source", f"with {RUN_SQL}, l as (select tag, max(run_id) as run_id from r where tag in ('eval', 'train') group by tag) select tag, run_id from l order by tag = 'train' limit 1")
def _(spark, d):
    return runs.incident_run(_runs(spark, d))


@query("scan_csv", """select event_id, ts as "timestamp", value, cast(event_type = 'error' as int) as anomaly from events where event_id % 13 <> 0""")
def _(spark, d):
    path = new_path(spark, "csv")
    out = events(spark, d).select("event_id", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("ts").cast("string")).alias("timestamp"),
                                  "value", F.col("label").alias("anomaly"))
    tables.write_csv(out, path)
    df = tables.load_csv(spark, path, "event_id bigint, value string, anomaly int")
    return clean.numbers(df, ["value"]).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("sink_roundtrip", """select 'parquet' as kind, count(*) as n, round(sum(value), 4) as total from events union all select 'csv', count(*), round(sum(value), 4) from events""")
def _(spark, d):
    rows = events(spark, d)
    pq, csv = new_path(spark, "parquet"), new_path(spark, "csv")
    tables.write_table(rows, pq)
    tables.write_csv(rows, csv)
    back = {"parquet": tables.load_table(spark, pq, None), "csv": tables.load_table(spark, pq + "-none", csv)}
    out = None
    for kind, df in back.items():
        row = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out
