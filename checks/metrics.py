"""Metrics, thresholds, splits, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import long, query, rounded
from checks.views import E_SQL, WIDE_KPIS, events, events_line, table, wide
from tidemark.functions import scores as fs
from tidemark.operators import metrics as m
from tidemark.operators import ranking, splits
from tidemark.operators import thresholds as th
from tidemark.operators.quantile import exact_quantiles

S_SQL = """s as (select d.doc_id as idx, cast(n_chars as double) as score, toxic as y
  from documents d join labels l on d.doc_id = l.doc_id)"""

# Running counts per distinct score, highest first.
C_SQL = """g as (select score, count(*) as n_at, sum(y) as tp_at from s group by score),
  c as (select score, n_at, tp_at, sum(n_at) over w as na, sum(tp_at) over w as ta,
  sum(n_at) over () as n, sum(tp_at) over () as pos from g
  window w as (order by score desc rows between unbounded preceding and current row)),
  k as (select *, ta / na as p, ta / pos as r, 5.0 * ta / (5.0 * ta + 4.0 * (pos - ta) + (na - ta)) as f2 from c)"""


def scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y")
    )


def models(spark, d):
    """Each numeric column of the wide table scores the same label, like competing models."""
    return wide(spark, d).unpivot(
        ["anomaly", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], WIDE_KPIS, "model", "score"
    ).withColumnRenamed("anomaly", "y")


M_SQL = "s as (" + " union all ".join(
    f"select '{c}' as model, {c} as score, cast(l_returnflag = 'R' as int) as y from lineitem" for c in WIDE_KPIS
) + ")"
MC_SQL = """g as (select model, score, count(*) as n_at, sum(y) as tp_at from s group by model, score),
  c as (select model, score, n_at, tp_at, sum(n_at) over w as na, sum(tp_at) over w as ta,
  sum(n_at) over (partition by model) as n, sum(tp_at) over (partition by model) as pos from g
  window w as (partition by model order by score desc rows between unbounded preceding and current row))"""


def _counts(thr: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return f"""select {head}count(*) filter (where score >= {thr} and y = 1) as tp, count(*) filter (where score >= {thr} and y = 0) as fp,
  count(*) filter (where score < {thr} and y = 1) as fn, count(*) filter (where score < {thr} and y = 0) as tn from s{tail}"""


def _points(spark, d):
    return m.curve(scored(spark, d))


@query("confusion", f"with {M_SQL} {_counts('20', 'model')}")
def _(spark, d):
    return models(spark, d).groupBy("model").agg(*[c.alias(n) for n, c in fs.confusion("score", "y", 20.0).items()])


@query("prf", f"""with {S_SQL}, t as ({_counts('1500')}) select round(tp / (tp + fp), 9) as precision,
  round(tp / (tp + fn), 9) as recall, round(2.0 * tp / (2.0 * tp + fn + fp), 9) as f1 from t""")
def _(spark, d):
    c = scored(spark, d).agg(*[c.alias(n) for n, c in fs.confusion("score", "y", 1500.0).items()])
    return rounded(c.select(fs.precision().alias("precision"), fs.recall().alias("recall"), fs.fbeta(1.0).alias("f1")), 9)


@query("fbeta2", f"""with {M_SQL}, t as ({_counts('20', 'model')}) select model,
  round(case when 5.0 * tp + 4.0 * fn + fp = 0 then 0 else 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) end, 9) as f2 from t""")
def _(spark, d):
    c = models(spark, d).groupBy("model").agg(*[c.alias(n) for n, c in fs.confusion("score", "y", 20.0).items()])
    return rounded(c.select("model", fs.fbeta(2.0).alias("f2")), 9)


@query("metric_bundle", f"""with {M_SQL}, {MC_SQL}, a as (select model, sum(tp_at / pos * (ta / na)) as ap,
  sum((n_at - tp_at) * ((ta - tp_at) + tp_at / 2) / (pos * (n - pos))) as auc from c group by model),
  t as ({_counts('20', 'model')})
  select t.model, 20.0::double as threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(tp / (tp + fn), 9) as recall,
  round(2.0 * tp / (2.0 * tp + fn + fp), 9) as f1, round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp), 9) as f2,
  round((tp + fp) / (tp + fp + fn + tn), 9) as alert_rate, round(ap, 9) as pr_auc, round(auc, 9) as roc_auc, tp, fp, fn, tn
  from t join a on t.model = a.model""")
def _(spark, d):
    return rounded(m.metric_bundle(models(spark, d), 20.0, keys=["model"]), 9)


@query("pr_curve", f"""with {S_SQL}, {C_SQL} select score as threshold, round(p, 9) as precision, round(r, 9) as recall from k
  union all select null, 1.0, 0.0""")
def _(spark, d):
    return rounded(m.pr_curve(_points(spark, d)), 9)


@query("avg_precision", f"with {S_SQL}, {C_SQL} select round(sum(tp_at / pos * (ta / na)), 9) as pr_auc from c")
def _(spark, d):
    return rounded(_points(spark, d).agg(m.average_precision().alias("pr_auc")), 9)


@query("roc_auc", f"""with {S_SQL}, {C_SQL}
  select round(sum((n_at - tp_at) * ((ta - tp_at) + tp_at / 2) / (pos * (n - pos))), 9) as roc_auc from c""")
def _(spark, d):
    return rounded(_points(spark, d).agg(m.roc_auc().alias("roc_auc")), 9)


@query("roc_curve", f"""with {S_SQL}, {C_SQL} select score as threshold, round((na - ta) / (n - pos), 9) as fpr, round(ta / pos, 9) as tpr from c
  union all select null, 0.0, 0.0""")
def _(spark, d):
    return rounded(m.roc_curve(_points(spark, d)), 9)


def _top_sql(by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    over = f"({part.strip()})"
    parts = []
    for share in (0.01, 0.02, 0.05, 0.1):
        size = f"greatest(1, floor(n * {share}))"
        name = f"{int(share * 100)}p"
        parts.append(f"round(sum(y) filter (where rk < {size}) / count(*) filter (where rk < {size}), 9) as precision_at_{name}")
        parts.append(f"round(sum(y) filter (where rk < {size}) / greatest(1, max(pos)), 9) as recall_at_{name}")
    tail = f" group by {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""k as (select *, row_number() over ({part}order by score desc, idx desc) - 1 as rk, count(*) over {over} as n,
  sum(y) over {over} as pos from s) select {head}{', '.join(parts)} from k{tail}"""


@query("pr_at_k", f"with {E_SQL}, s as (select idx, value as score, label as y from e), {_top_sql()}")
def _(spark, d):
    return rounded(m.at_top(events_line(spark, d).df, "value", "label"), 9)


@query("pr_at_k_by_type", f"""with s as (select l_linestatus as status, l_shipdate, l_orderkey * 100000 + l_partkey * 10 + l_linenumber as idx,
  l_extendedprice as score, cast(l_returnflag = 'R' as int) as y from lineitem), {_top_sql('status')}""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("idx"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return rounded(m.at_top(rows, keys=["status"]), 9)


@query("alert_rate", """select round(avg(cast(value >= 60 as int)), 9) as alert_rate, round(avg(cast(value >= 60 as int)) * 1000, 9) as alerts_per_1000,
  round(avg(cast(event_type = 'error' as int)), 9) as positive_rate from events""")
def _(spark, d):
    return rounded(m.alert_stats(events(spark, d).withColumn("is_alert", F.col("value") >= 60), label="label"), 9)


@query("alert_flag", """select event_id, value as anomaly_score, value >= (select quantile_cont(value, 0.99) from events) as is_alert from events""")
def _(spark, d):
    df = events(spark, d).select("event_id", F.col("value").alias("score"))
    return ranking.resolve_alerts(df, th.quantile_threshold(df, "score", 0.99)).select("event_id", "anomaly_score", "is_alert")


@query("alerts_only", """select event_id, value from events where value >= 60""")
def _(spark, d):
    df = events(spark, d).withColumnRenamed("value", "score").withColumn("pred_label", (F.col("score") >= 60).cast("int"))
    return ranking.resolve_alerts(df).where("is_alert").select("event_id", F.col("score").alias("value"))


@query("alert_resolve", """select 'chosen' as source, count(*) filter (where value >= 50) as alerts from events
  union all select 'stored', count(*) filter (where event_type = 'error') from events
  union all select 'predicted', count(*) filter (where value >= 60) from events union all select 'none', 0 from (select count(*) from events)""")
def _(spark, d):
    df = events(spark, d).withColumnRenamed("value", "score")
    stored, predicted = (F.col("label") == 1), (F.col("score") >= 60).cast("int")
    cases = {
        "chosen": ranking.resolve_alerts(df.withColumns({"is_alert": stored, "pred_label": predicted}), 50.0),
        "stored": ranking.resolve_alerts(df.withColumns({"is_alert": stored, "pred_label": predicted})),
        "predicted": ranking.resolve_alerts(df.withColumn("pred_label", predicted)),
        "none": ranking.resolve_alerts(df),
    }
    out = None
    for name, case in cases.items():
        row = case.agg(F.lit(name).alias("source"), F.count_if("is_alert").alias("alerts"))
        out = row if out is None else out.unionByName(row)
    return out


def _value(spark, df, name, value):
    """A threshold next to the number of rows that reach it."""
    return df.agg(F.lit(value).cast("double").alias("threshold"), F.count_if(F.col(name) >= F.lit(value)).alias("n_alerts"))


def _value_sql(q: float) -> str:
    return f"""with t as (select quantile_cont(value, {q}) as threshold from events)
  select round(threshold, 9) as threshold, (select count(*) from events, t where value >= threshold) as n_alerts from t"""


@query("thr_quantile", _value_sql(0.99))
def _(spark, d):
    df = events(spark, d)
    return rounded(_value(spark, df, "value", th.quantile_threshold(df, "value", 0.99)), 9)


@query("thr_budget", _value_sql(0.95))
def _(spark, d):
    df = events(spark, d)
    return rounded(_value(spark, df, "value", th.alert_budget(df, "value", 0.05)), 9)


LADDER = ", ".join(repr(q) for q in th.SWEEP)
SWEEP_SQL = f"""q as (select distinct unnest(quantile_cont(score, [{LADDER}])) as thr from s),
  w as (select thr, count(*) filter (where score >= thr and y = 1) as tp, count(*) filter (where score >= thr and y = 0) as fp,
  count(*) filter (where score < thr and y = 1) as fn, count(*) filter (where score < thr and y = 0) as tn from q, s group by thr)"""
ES_SQL = "s as (select event_id as idx, value as score, cast(event_type = 'error' as int) as y from events)"


@query("sweep_counts", f"with {ES_SQL}, {SWEEP_SQL} select round(thr, 9) as threshold, tp, fp, fn, tn from w")
def _(spark, d):
    df = events(spark, d)
    return rounded(th.sweep_counts(df, "value", "label", exact_quantiles(df, ["value"], th.SWEEP)["value"]), 9)


@query("thr_f1_sweep", f"""with {ES_SQL}, {SWEEP_SQL}, b as (select *, 2.0 * tp / (2.0 * tp + fn + fp) as f1 from w)
  select round(thr, 9) as threshold, round(f1, 9) as f1, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall from b
  order by b.f1 desc, thr limit 1""")
def _(spark, d):
    return rounded(th.best_f1_sweep(events(spark, d), "value", "label"), 9)


def _pick(where: str, order: str) -> str:
    return f"""with {S_SQL}, {C_SQL} select score as threshold, round(p, 9) as precision, round(r, 9) as recall, round(f2, 9) as f2
  from k {where} order by {order}, score limit 1"""


@query("thr_f2", _pick("", "k.f2 desc"))
def _(spark, d):
    return rounded(th.best_f2(_points(spark, d)), 9)


@query("thr_f2_by_model", f"""with {M_SQL}, {MC_SQL}, f as (select model, score, 5.0 * ta / (5.0 * ta + 4.0 * (pos - ta) + (na - ta)) as f2 from c)
  select model, arg_max(score, (f2, -score)) as threshold, round(max(f2), 9) as f2 from f group by model""")
def _(spark, d):
    points = m.curve(models(spark, d), keys=["model"])
    return rounded(th.best_f2(points, ["model"]).select("model", "threshold", "f2"), 9)


@query("thr_recall_f2", _pick("where r >= 0.7", "k.f2 desc"))
def _(spark, d):
    return rounded(th.recall_floor_f2(_points(spark, d), 0.70), 9)


@query("thr_recall_prec", _pick("where r >= 0.9", "k.p desc"))
def _(spark, d):
    return rounded(th.recall_floor_precision(_points(spark, d), 0.90), 9)


@query("thr_precision", f"""with {S_SQL}, {C_SQL}, u as (select score, p, r from k union all select (select max(score) from k), 1.0, 0.0)
  select score as threshold, round(p, 9) as precision, round(r, 9) as recall from u where p >= 0.2 order by u.r desc, score limit 1""")
def _(spark, d):
    return rounded(th.precision_floor(_points(spark, d), 0.2), 9)


ROLES = "with {E}, n as (select count(*) as n from e), v as (select value as score, label as y from e, n where idx >= floor(n * 0.7) and idx < floor(n * 0.85)), t as (select value as score, label as y from e, n where idx >= floor(n * 0.85)), s as (select * from v)"


@query("operating_points", ROLES.format(E=E_SQL) + f""", {C_SQL}, o as (
  (select 'f2_opt' as name, score as thr from k order by k.f2 desc, score limit 1) union all
  (select 'high_recall', score from k where r >= 0.9 order by k.p desc, score limit 1) union all
  (select 'alert_budget_5p', quantile_cont(score, 0.95) from s)),
  w as (select name, thr, count(*) filter (where score >= thr and y = 1) as tp, count(*) filter (where score >= thr and y = 0) as fp,
  count(*) filter (where score < thr and y = 1) as fn, count(*) as n from o, t group by name, thr)
  select name, round(thr, 9) as threshold, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall,
  round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp), 9) as f2, round((tp + fp) / n, 9) as alert_rate, round((tp + fp) / n * 1000, 9) as alerts_per_1000 from w""")
def _(spark, d):
    line = events_line(spark, d)
    f = splits.chrono_split(line.n)
    rows = line.df.select("idx", F.col("value").alias("score"), F.col("label").alias("y"))
    val = rows.where((F.col("idx") >= f.train_end) & (F.col("idx") < f.val_end))
    return rounded(th.operating_points(val, rows.where(F.col("idx") >= f.val_end)), 9)


@query("thr_median_folds", f"""with {E_SQL}, n as (select count(*) as n from e), f as (select unnest([0, 1, 2]) as i),
  z as (select i, floor(n * 0.5) + greatest(1, (n - floor(n * 0.5) - floor(n * 0.1)) // 2) * i as lo, floor(n * 0.1) as size from f, n),
  t as (select i, quantile_cont(value, 0.95) as thr from e, z where idx >= lo and idx < lo + size group by i)
  select round(quantile_cont(thr, 0.5), 9) as threshold, count(*) as folds from t""")
def _(spark, d):
    line = events_line(spark, d)
    slices = splits.expanding_slices(line.n, 3)
    rows = splits.assign(line.df, slices).where("role = 'val'")
    per_fold = [th.quantile_threshold(rows.where(F.col("fold") == f.fold), "value", 0.95) for f in slices]
    used = rows.agg(F.lit(th.median_threshold(per_fold)).alias("threshold"), F.count_distinct("fold").alias("folds"))
    return rounded(used, 9)


# Splits: rows, positions and positives of every fold and role.
def _split(spark, d, make):
    line = events_line(spark, d)
    rows = splits.assign(line.df, make(line))
    return rows.groupBy("fold", "role").agg(
        F.count("*").alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
    )


def _split_sql(folds: str) -> str:
    """``folds``: a query with i, a, b, c (ends of train, validation, test)."""
    return f"""with {E_SQL}, n as (select count(*) as n from e), z as ({folds}),
  x as (select i, case when idx < a then 'train' when idx < b then 'val' else 'test' end as role, idx, label from e, z where idx < c)
  select cast(i as int) as fold, role, count(*) as n_rows, min(idx) as first_idx, max(idx) as last_idx, cast(sum(label) as bigint) as positives
  from x group by i, role"""


@query("split_701515", _split_sql("select 1 as i, floor(n * 0.7) as a, floor(n * 0.85) as b, n as c from n"))
def _(spark, d):
    return _split(spark, d, lambda line: [splits.chrono_split(line.n)])


@query("rolling_splits", _split_sql("""select i, s + floor(n * 0.6) as a, s + floor(n * 0.6) + floor(n * 0.15) as b,
  s + floor(n * 0.6) + 2 * floor(n * 0.15) as c from (select n, i, (i - 1) * greatest(1, floor(n * 0.1)) as s from n, range(1, 50) t(i))
  where s + floor(n * 0.6) + 2 * floor(n * 0.15) <= n"""))
def _(spark, d):
    return _split(spark, d, lambda line: splits.rolling_splits(line.n))


MIN_POS = """select row_number() over (order by s) as i, a, b, c from (select s, a, b, c from (select n, s,
  s + floor(n * 0.6) as a, s + floor(n * 0.6) + floor(n * 0.15) as b, s + floor(n * 0.6) + 2 * floor(n * 0.15) as c
  from (select n, (j - 1) * greatest(1, floor((n - floor(n * 0.6) - 2 * floor(n * 0.15)) / 4)) as s from n, range(1, 50) t(j)))
  where c <= n) q where (select sum(label) from e where idx >= q.b and idx < q.c) >= 5 order by s limit 5"""


@query("rolling_splits_min_pos", _split_sql(MIN_POS))
def _(spark, d):
    return _split(spark, d, lambda line: splits.rolling_splits_min_pos(line.df, line.n, "label"))


@query("ts_slices", _split_sql("""select i, lo as a, least(lo + size, n) as b, least(lo + size, n) as c from (select n, i + 1 as i, floor(n * 0.1) as size,
  floor(n * 0.5) + greatest(1, (n - floor(n * 0.5) - floor(n * 0.1)) // 2) * i as lo from n, (select unnest([0, 1, 2]) as i))"""))
def _(spark, d):
    return _split(spark, d, lambda line: splits.expanding_slices(line.n, 3))


@query("ts_split3", _split_sql("select i, n - (4 - i) * (n // 4) as a, n - (3 - i) * (n // 4) as b, n - (3 - i) * (n // 4) as c from n, range(1, 4) t(i)"))
def _(spark, d):
    return _split(spark, d, lambda line: splits.equal_slices(line.n, 3))


FOLD_SQL = f"""z as (select i, s + floor(n * 0.6) as a, s + floor(n * 0.6) + floor(n * 0.15) as b, s + floor(n * 0.6) + 2 * floor(n * 0.15) as c
  from (select n, i, (i - 1) * greatest(1, floor(n * 0.1)) as s from (select count(*) as n from e) n0, range(1, 50) t(i))
  where s + floor(n * 0.6) + 2 * floor(n * 0.15) <= n),
  x as (select cast(i as int) as fold, case when idx < a then 'train' when idx < b then 'val' else 'test' end as role, idx, event_id, value, label,
  value / (1 + i) as score from e, z where idx < c)"""


def _folds(spark, d):
    line = events_line(spark, d)
    rows = splits.assign(line.df, splits.rolling_splits(line.n))
    # A score that differs from fold to fold, like that of a refitted model.
    return line, rows.withColumn("score", F.col("value") / (F.col("fold") + 1))


@query("fold_assign", f"with {E_SQL}, {FOLD_SQL} select fold, role, idx, event_id from x")
def _(spark, d):
    return _folds(spark, d)[1].select("fold", "role", "idx", "event_id")


@query("fold_union", f"with {E_SQL}, {FOLD_SQL} select role, fold, idx, label from x where role in ('val', 'test')")
def _(spark, d):
    rows = _folds(spark, d)[1].select("role", "fold", "idx", "label")
    return rows.where("role = 'val'").unionByName(rows.where("role = 'test'"))


@query("fold_collapse", f"""with {E_SQL}, {FOLD_SQL} select idx, round(max(score), 9) as anomaly_score, max(label) as y_true from x where role = 'test' group by idx""")
def _(spark, d):
    rows = _folds(spark, d)[1].where("role = 'test'")
    return rounded(ranking.collapse_folds(rows, "score", "label"), 9)


@query("score_join", f"""with {E_SQL}, {FOLD_SQL}, k as (select idx, max(score) as anomaly_score, max(label) as y_true from x where role = 'test' group by idx)
  select k.idx, round(anomaly_score, 9) as anomaly_score, y_true, anomaly_score >= 20 as is_alert, ts, value from k left join e on k.idx = e.idx""")
def _(spark, d):
    line, rows = _folds(spark, d)
    best = ranking.collapse_folds(rows.where("role = 'test'"), "score", "label")
    joined = best.join(line.df.select("idx", "ts", "value"), "idx", "left")
    return rounded(joined.withColumn("is_alert", F.col("anomaly_score") >= 20), 9)


def _fold_metrics_sql() -> str:
    return f"""t as (select fold, count(*) filter (where score >= 20 and label = 1) as tp, count(*) filter (where score >= 20 and label = 0) as fp,
  count(*) filter (where score < 20 and label = 1) as fn from x where role = 'test' group by fold),
  q as (select fold, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0), 0) as f2 from t)"""


@query("fold_summary", f"with {E_SQL}, {FOLD_SQL}, {_fold_metrics_sql()} select " + ", ".join(
    f"round(avg({c}), 9) as {c}_mean, round(stddev_pop({c}), 9) as {c}_std" for c in ("precision", "recall", "f2")) + " from q")
def _(spark, d):
    rows = _folds(spark, d)[1].where("role = 'test'")
    per_fold = rows.groupBy("fold").agg(*[c.alias(n) for n, c in fs.confusion("score", "label", 20.0).items()]).withColumns(fs.rates())
    return rounded(m.fold_summary(per_fold, ["precision", "recall", "f2"]), 9)


@query("top_tp_fp", f"""with {E_SQL}, {FOLD_SQL}, h as (select fold, idx, round(score, 9) as score, label as y, score as raw from x where role = 'test' and score >= 20)
  (select 'tp' as kind, fold, idx, score from h where y = 1 order by raw desc, idx desc limit 3) union all
  (select 'fp', fold, idx, score from h where y = 0 order by raw desc, idx desc limit 3)""")
def _(spark, d):
    rows = _folds(spark, d)[1].where("role = 'test'").withColumn("is_alert", F.col("score") >= 20)
    top = ranking.top_hits(rows.select("fold", "idx", "score", F.col("label").alias("y"), "is_alert"))
    return rounded(top.select("kind", "fold", "idx", "score"), 9)


# Configurations: six-hour blocks of the event series, each a fixed number of them per month.
CONFIG_SQL = """x as (select day(ts) * 4 + hour(ts) // 6 as config, value, cast(event_type = 'error' as int) as y from events),
  t as (select config, count(*) filter (where value >= 20 and y = 1) as tp, count(*) filter (where value >= 20 and y = 0) as fp,
  count(*) filter (where value < 20 and y = 1) as fn from x group by config),
  c as (select cast(config as bigint) as config, coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0), 0) as f2_mean, coalesce(tp / nullif(tp + fn, 0), 0) as recall_mean from t)"""


def _configs(spark, d):
    rows = events(spark, d).withColumn("config", long(F.dayofmonth("ts") * 4 + F.floor(F.hour("ts") / 6)))
    counts = rows.groupBy("config").agg(*[c.alias(n) for n, c in fs.confusion("value", "label", 20.0).items()])
    return counts.select("config", fs.fbeta(2.0).alias("f2_mean"), fs.recall().alias("recall_mean"))


@query("top_configs", f"with {CONFIG_SQL} select config, round(f2_mean, 9) as f2_mean, round(recall_mean, 9) as recall_mean from c order by c.f2_mean desc, c.recall_mean desc, config limit 10")
def _(spark, d):
    return rounded(ranking.top_rows(_configs(spark, d), ["f2_mean", "recall_mean"], 10, ["config"]), 9)


@query("best_model", f"with {CONFIG_SQL} select config, round(f2_mean, 9) as f2_mean, round(recall_mean, 9) as recall_mean from c order by c.f2_mean desc, c.recall_mean desc, config limit 1")
def _(spark, d):
    return rounded(ranking.best_row(_configs(spark, d), ["f2_mean", "recall_mean"], "config"), 9)


@query("model_ranking", f"""with {M_SQL}, {MC_SQL}, a as (select model, sum(tp_at / pos * (ta / na)) as ap from c group by model)
  select model, round(ap, 9) as pr_auc, row_number() over (order by ap desc, model) as place from a""")
def _(spark, d):
    from pyspark.sql import Window

    table_ = m.curve(models(spark, d), keys=["model"]).groupBy("model").agg(m.average_precision().alias("pr_auc"))
    ranked = ranking.rank_models(table_, ["pr_auc"])
    return rounded(ranked.withColumn("place", long(F.row_number().over(Window.orderBy(F.desc("pr_auc"), "model")))), 9)


@query("early_stop", f"""with recursive {CONFIG_SQL}, o as (select row_number() over (order by config) as i, f2_mean as f from c),
  run(i, best, held, since, stop) as (select i, f, f, i, 0 from o where i = 1 union all
  select o.i, greatest(best, f), case when greatest(best, f) - held >= 0.005 then greatest(best, f) else held end,
  case when greatest(best, f) - held >= 0.005 then o.i else since end,
  case when greatest(best, f) - held < 0.005 and o.i - since >= 20 then 1 else 0 end from run join o on o.i = run.i + 1 where stop = 0 and o.i <= 60)
  select cast(max(i) as bigint) as evaluated, max(stop) = 1 as no_gain, (select count(*) from events) as n_rows from run""")
def _(spark, d):
    f2s = [r["f2_mean"] for r in _configs(spark, d).orderBy("config").collect()]
    done, why = ranking.early_stop(f2s)
    return events(spark, d).agg(F.lit(done).cast("bigint").alias("evaluated"),
                                F.lit(bool(why and why.startswith("no_f2"))).alias("no_gain"), F.count("*").alias("n_rows"))
