"""Queries over labels, features, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import labels as lb
from tidemark.operators import monitor as mo
from tidemark.plans.ingest import scratch
from tidemark.plans.registry import OVER, Chain, query
from tidemark.plans.trends import TREND, labelled
from tidemark.sources.tables import bars_raw, bars_walk

H = 10


def firsts(n: int, cond: str) -> str:
    """The first u of 1..n whose condition (with {u}) holds."""
    return "coalesce(" + ", ".join(f"case when {cond.format(u=u)} then {u} end" for u in range(1, n + 1)) + ")"


CLOSES = ", ".join(f"c{u}" for u in range(1, H + 1))


def with_leads(chain: Chain) -> Chain:
    """The chain with h1, l1, c1 to h10, l10, c10: the bars ahead."""
    return chain.add(*(f"lead({c}, {u}) {OVER} as {c[0]}{u}" for c in ("high", "low", "close") for u in range(1, H + 1)))


def with_barriers(chain: Chain) -> Chain:
    """The chain with the bars ahead and the barrier columns."""
    first = with_leads(chain).add(firsts(H, "h{u} >= close * (1 + 0.08::double)") + " as t_", firsts(H, "l{u} <= close * (1 - 0.06::double)") + " as s_", f"len(list_filter([{CLOSES}], lambda x: x is not null)) as n_", f"greatest({CLOSES}) / close - 1 as top_", f"least({CLOSES}) / close - 1 as low_")
    first = first.add("t_ is not null and (s_ is null or t_ <= s_) as won_").add("s_ is not null and not won_ as lost_")
    return first.add(f"list_extract([{CLOSES}], case when won_ then t_ when lost_ then s_ else n_ end) / close - 1 as ret_")


LABEL = "case when n_ > 0 then case when won_ then 1 when lost_ then 0 else cast(top_ >= 0.08 as integer) end end"
BARRIER = with_barriers(Chain("bars_walk"))
K01 = "symbol, date, cast(case when n_ > 0 then case when won_ then 1 when lost_ then 0 else cast(top_ >= 0.08 as integer) end end as integer) as label_success, case when n_ > 0 then round(ret_, 6) end as realized_return, round(top_, 6) as max_future_return, round(low_, 6) as min_future_return, cast(case when won_ then t_ end as integer) as days_to_target, cast(case when n_ > 0 then cast(lost_ as integer) end as integer) as stop_hit"
K_COLUMNS = ("label_success", "realized_return", "max_future_return", "min_future_return", "days_to_target", "stop_hit")


def barriers(spark, path) -> DataFrame:
    df = lb.triple_barrier(bars_walk(spark, path))
    return df.select("symbol", "date", *((F.round(c, 6) if c.endswith("return") else F.col(c)).alias(c) for c in K_COLUMNS))


@query("K01_triple_barrier", BARRIER.sql(f"select {K01} from {{last}}"))
def k01(spark, path):
    return barriers(spark, path)


ATR = with_leads(Chain("bars_walk")).add(f"lag(close) {OVER} as pc").add("case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr").ewm("tr", "atr0", 1 / 14).add("round(atr0, 6) as atr")
ATR_K = ATR.add(firsts(H, "h{u} >= close + 1.5 * atr") + " as t_", firsts(H, "l{u} <= close - 1.0 * atr") + " as s_")


@query("K02_atr_barrier", ATR_K.sql("select symbol, date, cast(case when h2 is not null then cast(t_ is not null and (s_ is null or t_ < s_) as integer) end as integer) as outcome from {last}"))
def k02(spark, path):
    df = ind.atr(bars_walk(spark, path)).withColumn("atr", F.round("atr", 6))
    return lb.atr_barrier(df, 1).select("symbol", "date", "outcome")


@query("K03_snapshot_features", TREND.sql("select symbol, date, round(ema20, 4) as ema20, round(ema50, 4) as ema50, round(adx, 4) as adx, ma_trend, madi_trend, trend from {last} where idx >= 19"))
def k03(spark, path):
    """Point-in-time features at every bar with 20 bars of history."""
    from tidemark.operators.trends import indexed

    df = indexed(labelled(bars_raw(spark, path))).filter("idx >= 19")
    return df.select("symbol", "date", *(F.round(c, 4).alias(c) for c in ("ema20", "ema50", "adx")), "ma_trend", "madi_trend", "trend")


PSEUDO = Chain("bars_walk").add(f"lead(close) {OVER} / close - 1 as r_")
PSEUDO = Chain("p3", (*PSEUDO.steps, ("p1", f"select * from {PSEUDO.last} where r_ is not null"), ("p2", f"select *, abs(r_) as a_, last_value(nullif(sign(r_), 0) ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as g_ from p1"), ("p3", "select *, quantile_cont(a_, 0.25) over (partition by symbol) as q1, quantile_cont(a_, 0.5) over (partition by symbol) as q2, quantile_cont(a_, 0.75) over (partition by symbol) as q3 from p2")))


@query("K04_pseudo_labels", PSEUDO.sql("select symbol, date, cast(g_ * case when a_ <= q1 then 1 when a_ <= q2 then 2 when a_ <= q3 then 3 else 4 end as integer) as label from {last}"))
def k04(spark, path):
    return lb.pseudo_labels(bars_walk(spark, path)).select("symbol", "date", "label")


@query("K05_forward_targets", Chain("bars_walk").sql(f"select symbol, date, {', '.join(f'lead(close, {n}) {OVER} as close_in_{n}' for n in (5, 10, 15, 20))} from {{last}}"))
def k05(spark, path):
    return lb.forward_targets(bars_walk(spark, path)).select("symbol", "date", *(f"close_in_{n}" for n in (5, 10, 15, 20)))


@query("K06_forward_label", Chain("bars_walk").sql(f"select symbol, date, cast((lead(close, 5) {OVER} - close) / (close + 1e-9) > 0.005 as integer) as label from {{last}}"))
def k06(spark, path):
    return lb.forward_label(bars_walk(spark, path)).select("symbol", "date", "label")


TRAIN = "cast('0x' || substr(md5({}), 1, 7) as bigint) % 5 <> 0"
SCALED = f"""select symbol, date, round((close - m1) / s1, 6) as close, round((coalesce(case when volume % 4 <> 0 then volume + 0.0 end, 0) - m2) / s2, 6) as volume
  from {{last}}, (select avg(close) as m1, stddev_pop(close) as s1, avg(coalesce(case when volume % 4 <> 0 then volume + 0.0 end, 0)) as m2, stddev_pop(coalesce(case when volume % 4 <> 0 then volume + 0.0 end, 0)) as s2 from {{last}} where {TRAIN.format('symbol')})"""


@query("K07_scale", Chain("bars_walk").held().sql(SCALED))
def k07(spark, path):
    df = bars_walk(spark, path).select("symbol", "date", "close", F.when(F.col("volume") % 4 != 0, F.col("volume").cast("double")).alias("volume"))
    return lb.scale(df, ["close", "volume"], lb.is_train(F.col("symbol"))).select("symbol", "date", F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))


SPLITS = Chain("bars_walk", (*BARRIER.steps, ("lab", f"select symbol, date, case when n_ > 0 then case when won_ then 1 when lost_ then 0 else cast(top_ >= 0.08 as integer) end end as label from {BARRIER.last}")))
HASHED = "cast('0x' || substr(md5(symbol || '|' || cast(date as varchar)), 1, 15) as bigint)"


@query("K09_splits", SPLITS.sql(f"select symbol, date, label, case when label is not null then case when row_number() over (partition by label order by {HASHED}) <= floor(count(*) over (partition by label) * 0.8) then 'train' else 'validation' end end as side, case when row_number() {OVER} <= floor(count(*) over (partition by symbol) * 0.8) then 'train' else 'test' end as part from lab"))
def k09(spark, path):
    """Four fifths of each class of the barrier labels, and of each symbol's bars by time."""
    rows, to = lb.time_split(lb.triple_barrier(bars_walk(spark, path))).select("symbol", "date", F.col("label_success").alias("label"), "part"), scratch(spark, "splits")
    rows.write.parquet(to)  # the labels cost most and are read three times
    rows = spark.read.parquet(to)
    split = lb.stratified_split(rows, "label", F.concat_ws("|", "symbol", F.col("date").cast("string")))
    return split.withColumn("side", F.when(F.col("train"), "train").when(~F.col("train"), "validation")).drop("train")


PREDICTIONS = Chain("pred", (*BARRIER.steps, ("pred", f"select symbol, date, 'm' || volume % 3 as model, (volume * 7919 + cast(close as bigint)) % 1000 / 1000.0 as score, cast(case when n_ > 0 and volume % 6 <> 5 then case when won_ then 1 when lost_ then 0 else cast(top_ >= 0.08 as integer) end end as integer) as label, case when n_ > 0 then ret_ end as realized_return, close, volume from {BARRIER.last}")))


def predictions(spark, path) -> DataFrame:
    """Bars with an arithmetic score by three models, and the barrier labels of most of them."""
    v = F.col("volume")
    df = lb.triple_barrier(bars_walk(spark, path))
    label = F.when(v % 6 != 5, F.col("label_success"))
    return df.select("symbol", "date", F.concat(F.lit("m"), (v % 3).cast("string")).alias("model"), ((v * 7919 + F.col("close").cast("bigint")) % 1000 / 1000.0).alias("score"), label.alias("label"), "realized_return", "close", "volume")


@query("C03_predictions_labels", PREDICTIONS.sql("select symbol, date, score, label from pred"))
def c03(spark, path):
    p = predictions(spark, path)
    found = p.select("symbol", F.col("date").cast("timestamp").alias("ScanDate"), "label").withColumn("date", F.to_date("ScanDate"))
    return p.select("symbol", "date", "score").join(found.select("symbol", "date", "label"), ["symbol", "date"], "left")


@query("D11_prediction_summary", PREDICTIONS.sql("select model, round(avg(cast(score >= 0.5 as integer)), 6) as success_rate, round(avg(score), 6) as mean_confidence, round(avg(abs(realized_return)), 6) as mean_abs_change from pred group by model"))
def d11(spark, path):
    """Each model's share of confident rows, mean confidence and mean absolute change."""
    g = predictions(spark, path).groupBy("model")
    return g.agg(F.round(F.avg((F.col("score") >= 0.5).cast("int")), 6).alias("success_rate"), F.round(F.avg("score"), 6).alias("mean_confidence"), F.round(F.avg(F.abs("realized_return")), 6).alias("mean_abs_change"))


def psi_sql(columns: list[str], base: str, now: str) -> str:
    parts = []
    for c in columns:
        q = ", ".join(f"{i / 10}" for i in range(11))
        edges = f"(select list_sort(list_distinct(quantile_cont({c}::double, [{q}]))) from {base})"
        bins = lambda t, e=edges, c=c: f"select least(len(list_filter({e}, lambda b: b <= {c})), len({e}) - 1) as b, count(*) as n from {t} where {c} between list_extract({e}, 1) and list_extract({e}, -1) group by 1"
        parts.append(f"select '{c}' as feature, round(sum((pe - pa) * ln(pe / pa)), 6) as psi from (select coalesce(e.n / sum(e.n) over (), 0) + 1e-8 as pe, coalesce(a.n / sum(a.n) over (), 0) + 1e-8 as pa from ({bins(base)}) e full join ({bins(now)}) a using (b))")
    return " union all ".join(parts)


OLD, NEW = ("old", "select *, score + close / 100000.0 as drift from pred where date < date '1996-06-01'"), ("new", "select *, score + close / 50000.0 as drift from pred where date >= date '1996-06-01'")
PSI = Chain("pred", (*PREDICTIONS.steps, OLD, NEW))


def halves(spark, path):
    p = predictions(spark, path)
    cut = F.to_date(F.lit("1996-06-01"))
    return p.filter(F.col("date") < cut).withColumn("drift", F.col("score") + F.col("close") / 100000.0), p.filter(F.col("date") >= cut).withColumn("drift", F.col("score") + F.col("close") / 50000.0)


@query("L01_psi", PSI.sql(psi_sql(["close"], "old", "new")))
def l01(spark, path):
    return mo.psi(*halves(spark, path), ["close"]).withColumn("psi", F.round("psi", 6))


@query("L02_psi_features", PSI.sql(psi_sql(["close", "volume", "drift"], "old", "new")))
def l02(spark, path):
    return mo.psi(*halves(spark, path), ["close", "volume", "drift"]).withColumn("psi", F.round("psi", 6))


PLACE = "row_number() over (partition by model order by score desc, symbol, date)"


@query("L03_precision_at_k", PREDICTIONS.sql(f"select model, round(sum(label) / 100.0, 6) as precision from (select *, {PLACE} as place from pred where label is not null) where place <= 100 group by model"))
def l03(spark, path):
    return mo.precision_at_k(predictions(spark, path), 100).withColumn("precision", F.round("precision", 6))


CLASS = "select model, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from (select model, count(*) filter (where score >= 0.5 and label = 1) as tp, count(*) filter (where score >= 0.5 and label = 0) as fp, count(*) filter (where score < 0.5 and label = 1) as fn from pred group by model)"


@query("L04_precision_recall_f1", PREDICTIONS.sql(CLASS))
def l04(spark, path):
    return mo.classification(predictions(spark, path)).select("model", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("L05_auc", PREDICTIONS.sql("select model, round(sum(case when label = 1 then mid end) / (max(np) * max(nn)) - (max(np) + 1) / 2.0 / max(nn), 6) as auc from (select *, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as mid, count(*) filter (where label = 1) over (partition by model) as np, count(*) filter (where label = 0) over (partition by model) as nn from pred where label is not null) group by model"))
def l05(spark, path):
    return mo.auc(predictions(spark, path)).withColumn("auc", F.round("auc", 6))


@query("L06_r_squared", Chain("bars_walk").sql("select symbol, round(1 - sum(pow(close - open, 2)) / sum(pow(close - m, 2)), 6) as r2 from (select *, avg(close) over (partition by symbol) as m from bars_walk) group by symbol"))
def l06(spark, path):
    return mo.r_squared(bars_walk(spark, path).select("symbol", F.col("close").alias("y"), F.col("open").alias("y_hat")), ["symbol"]).withColumn("r2", F.round("r2", 6))


@query("L07_topk_return", PREDICTIONS.sql(f"select model, round(avg(realized_return), 6) as mean_return, round(quantile_cont(realized_return, 0.5), 6) as median_return from (select *, {PLACE} as place from pred where label is not null) where place <= 100 group by model"))
def l07(spark, path):
    return mo.topk_return(predictions(spark, path), 100).select("model", F.round("mean_return", 6).alias("mean_return"), F.round("median_return", 6).alias("median_return"))


AT_K = f"select model, sum(label) / 100.0 as precision from (select *, {PLACE} as place from {{0}} where label is not null) where place <= 100 group by model"
ALERTS = Chain("pred", (*PSI.steps, ("stab", psi_sql(["close", "volume", "drift"], "old", "new")), ("was", AT_K.format("old")), ("met", AT_K.format("new"))))


@query("L08_alerts", ALERTS.sql("select 'psi' as kind, feature as name, psi as value from stab where psi >= 0.1 union all select 'precision', model, round((w.precision - m.precision) / w.precision, 6) from met m join was w using (model) where w.precision > 0 and (w.precision - m.precision) / w.precision >= 0.02"))
def l08(spark, path):
    """Precision@100 of two runs is stored, the old half of the predictions and the new; the newer run's alerts look the older
    one up."""
    old, new = halves(spark, path)
    history = mo.MetricHistory(spark, scratch(spark, "metrics"))
    for run, rows in (("19960601T000000", old), ("19991231T000000", new)):
        history.store(run, mo.precision_at_k(rows, 100), "precision")
    stability = mo.psi(old, new, ["close", "volume", "drift"]).withColumn("psi", F.round("psi", 6))
    metrics = mo.precision_at_k(new, 100)
    return mo.alerts(stability, metrics, history.before("19991231T000000", "precision"), drop=0.02).withColumn("value", F.round("value", 6))


@query("L09_coverage", PREDICTIONS.sql("select count(*) as total, count(label) as labelled, case when count(label) = 0 then 'no_labels' when count(label) < count(*) then 'partial' else 'complete' end as status from pred"))
def l09(spark, path):
    return mo.coverage(predictions(spark, path))
