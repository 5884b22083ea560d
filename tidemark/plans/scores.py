"""Queries over scores and signals (G01 to G10, G15, D08, D12, B17), scored reversals (F19 to F26) and the swing ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.functions import scores as sc
from tidemark.functions.windows import emas
from tidemark.operators import indicators as ind
from tidemark.operators import ranking as rk
from tidemark.operators import reversal as rv
from tidemark.operators import trends as tr
from tidemark.plans.indicators import CANDLES, SPIKE
from tidemark.plans.registry import OVER, SO_FAR, Chain, filled, over, query
from tidemark.plans.trends import IDX, PATTERN, REVERSAL, TREND, labelled
from tidemark.sources.tables import bars_raw, bars_walk

GEM = "cast(substr(symbol, 2) as bigint) * 37 % 4000"


def ladder(x: str, steps, op: str, rest: float) -> str:
    return f"case when {x} is null then 0.0 " + " ".join(f"when {x} {op} {a} then {b}.0" for a, b in steps) + f" else {rest} end"


def technical_sql(chain: Chain) -> Chain:
    z = [f"coalesce({c}, 0.0)" for c in ("ema20", "ema50", "rsi", "pct_to_high", "gem_rank")]
    dist = f"(abs({z[0]} - {z[1]}) * 100 / nullif({z[1]}, 0))"
    parts = [ladder(dist, sc.EMA_DISTANCE, "<=", 5.0), ladder(z[2], sc.RSI_OVERSOLD, "<=", 0.0), ladder(z[3], sc.HIGH_DISTANCE, ">=", 0.0), ladder(z[4], sc.GEM_RANKS, "<=", 0.0)]
    return chain.add(*(f"{p} as p{i}" for i, p in enumerate(parts))).add("cast(p0 + p1 + p2 + p3 as double) as technical")


SWING = PATTERN.ewm("close", "ema20", 2 / 21).ewm("close", "ema50", 2 / 51).ewm("case when chg is not null then greatest(chg, 0.0) end", "g", 1 / 14).ewm("case when chg is not null then greatest(-chg, 0.0) end", "l", 1 / 14)
SWING = SWING.add("round(100 - 100 / (1 + g / (l + 1e-10)), 6) as rsi", f"max(close) {over(252)} as hi52", f"cast({GEM} as double) as gem_rank").add("round((1 - close / nullif(hi52, 0)) * 100, 6) as pct_to_high", "round(ema20, 6) as e20", "round(ema50, 6) as e50")
SWING = technical_sql(SWING).add("round_even(0.45 * pattern_score + 0.55 * technical, 2) as composite").add(
    "case when pattern then case when composite >= 80 then 'Strong_Buy' when composite >= 65 then 'Buy' when composite >= 50 then 'Weak_Buy' else 'Neutral' end else 'Neutral' end as signal",
    "case when pattern then cast(row_number() over (partition by date, pattern order by composite desc, symbol) as integer) end as composite_rank",
)


def swing(df: DataFrame) -> DataFrame:
    df = ind.year_range(ind.rsi_wilder(tr.price_pattern(df)))
    df = emas(df, "close", 20, 50)
    df = df.withColumn("rsi", F.round("rsi", 6)).withColumn("pct_to_high", F.round("pct_to_high", 6))
    df = df.withColumn("gem_rank", (F.substring("symbol", 2, 9).cast("bigint") * 37 % 4000).cast("double"))
    df = df.withColumn("technical", sc.technical_score(*(F.col(c) for c in ("ema20", "ema50", "rsi", "pct_to_high", "gem_rank"))))
    df = df.withColumn("composite", sc.composite_score(F.col("pattern_score"), F.col("technical"))).withColumn("signal", sc.swing_signal(F.col("composite"), F.col("pattern")))
    return df.withColumn("composite_rank", rk.subset_rank(F.col("pattern"), F.col("composite"), ["date"]))


SWING_COLUMNS = "symbol, date, pattern, d1_recent_up, d2_prior_down, cast(pattern_score as double) as pattern_score, technical, cast(composite as double) as composite, signal, composite_rank"


@query("swing_ranking", SWING.sql(f"select {SWING_COLUMNS} from {{last}} where pattern"))
def swing_ranking(spark, path):
    """Snapshots of every symbol and day ranked for swing trades: pattern, technical score, composite, signal, rank."""
    out = swing(bars_walk(spark, path)).filter("pattern")
    return out.select("symbol", "date", "pattern", F.col("d1_recent_up").cast("int"), F.col("d2_prior_down").cast("int"), "pattern_score", "technical", "composite", "signal", "composite_rank")


for _name, _columns in (("G02_ema_distance", "p0"), ("G03_rsi_score", "p1"), ("G04_high_distance", "p2"), ("G05_gem_rank_score", "p3")):
    query(_name, SWING.sql(f"select symbol, date, cast({_columns} as double) as points from {{last}}"))(
        lambda spark, path, c=_columns: swing(bars_walk(spark, path)).select("symbol", "date", {
            "p0": sc.ema_distance_score(F.col("ema20"), F.col("ema50")), "p1": sc.rsi_score(F.coalesce("rsi", F.lit(0.0))), "p2": sc.high_distance_score(F.col("pct_to_high")), "p3": sc.gem_rank_score(F.col("gem_rank")),
        }[c].alias("points"))
    )
query("G06_technical_score", SWING.sql("select symbol, date, technical, case when rsi is null then p0 + p2 + p3 else technical end as strict from {last}"))(
    lambda spark, path: swing(bars_walk(spark, path)).select("symbol", "date", "technical", sc.technical_score(*(F.col(c) for c in ("ema20", "ema50", "rsi", "pct_to_high", "gem_rank")), missing="zero").alias("strict"))
)
query("G07_composite", SWING.sql("select symbol, date, cast(composite as double) as composite from {last}"))(lambda spark, path: swing(bars_walk(spark, path)).select("symbol", "date", "composite"))
query("G08_signal", SWING.sql("select symbol, date, signal from {last}"))(lambda spark, path: swing(bars_walk(spark, path)).select("symbol", "date", "signal"))
query("C01_snapshot_pattern", SWING.sql("select symbol, date, close, case when pattern then d2_prior_down end as d2_prior_down from {last}"))(
    lambda spark, path: bars_walk(spark, path).select("symbol", "date", "close").join(tr.price_pattern(bars_walk(spark, path)).filter("pattern").select("symbol", "date", F.col("d2_prior_down").cast("int")), ["symbol", "date"], "left")
)


@query("D08_ranking_summary", SWING.sql("select signal, count(*) as n, round(avg(case when pattern then composite end), 6) as mean_composite, round(avg(case when pattern then technical end), 6) as mean_technical from {last} group by signal"))
def d08(spark, path):
    """Counts by signal, and mean scores of the rows with a pattern."""
    hit = lambda c: F.round(F.avg(F.when(F.col("pattern"), F.col(c))), 6)
    return swing(bars_walk(spark, path)).groupBy("signal").agg(F.count("*").alias("n"), hit("composite").alias("mean_composite"), hit("technical").alias("mean_technical"))


RULE = IDX.ewm("case when chg is not null then greatest(chg, 0.0) end", "g", 1 / 14).ewm("case when chg is not null then greatest(-chg, 0.0) end", "l", 1 / 14).ewm("close", "ema12", 2 / 13).ewm("close", "ema26", 2 / 27).add("ema12 - ema26 as macd").ewm("macd", "ms", 2 / 10)
RULE = RULE.add("round(100 - 100 / (1 + g / (l + 1e-10)), 6) as rsi", "round(macd - ms, 6) as mh", f"avg(close) {over(20)} as m_", f"stddev_pop(close) {over(20)} as sd_", f"{filled(f'avg(close) {over(50)}', 'close', 50)} as sma50", f"{filled(f'avg(close) {over(200)}', 'close', 200)} as sma200")
RULE = RULE.add("round(m_ - 2 * sd_, 6) as lo_", "round(m_ + 2 * sd_, 6) as hi_", "case when sma50 > sma200 then true when sma50 < sma200 then false else macd > 0 end as up_")
RULE = RULE.add(
    """case when up_ then case when rsi < 30 then 1 when rsi < 50 then 2 when rsi < 70 then 3 else 4 end else case when rsi > 70 then 1 when rsi > 50 then 2 when rsi > 30 then 3 else 4 end end
  + case when (case when up_ then mh > 0 else mh < 0 end) then 3 else 1 end
  + case when up_ then case when close < lo_ then 1 when close < m_ then 2 when close < hi_ then 3 else 4 end else case when close > hi_ then 1 when close > m_ then 2 when close > lo_ then 3 else 4 end end as sc_"""
).add("greatest(1, least(4, cast(ceil(sc_ * 4 / 11.0) as integer))) as st_")


@query("G01_rule_signal", RULE.sql("select symbol, date, cast(case when up_ then st_ else -st_ end as integer) as signal from {last} where idx >= 199"))
def g01(spark, path):
    df = tr.indexed(ind.sma(ind.sma(ind.bollinger(ind.macd(ind.rsi_wilder(bars_walk(spark, path)))), 50, "sma50"), 200, "sma200")).filter("idx >= 199")
    r = lambda c: F.round(c, 6)
    h = r("macd_hist")
    return df.select("symbol", "date", sc.rule_signal(F.col("sma50"), F.col("sma200"), F.col("macd"), F.col("macd") - h, h, r("rsi"), F.col("close"), r("bb_low"), F.col("bb_mid"), r("bb_high")).alias("signal"))


#: Snapshot-like rows from the walk, by arithmetic: every branch of the swing score is met.
G09_ROWS = """select symbol, date, volume % 9 - 4.0 as ml, volume % 7 - 3.0 as rules, case volume % 3 when 0 then 'Bull' when 1 then 'Bear' else 'Neutral' end as pri,
  case volume % 5 when 0 then 'PullbackInBull' when 1 then 'TrendingUp' when 2 then 'PullbackInBear' when 3 then 'TrendingDown' else 'ShortTrend' end as sec, volume % 4 - 1.0 as x, volume % 2 = 0 as up,
  volume % 31 + 0.0 as adx, volume % 13 as rr, volume % 11 as rm, volume % 8 as ut, volume % 41 - 20.0 as days, volume % 6 + 0.0 as hi, volume % 12 + 0.0 as lo from {bars}"""
_side = "case pri when 'Bull' then 1.0 when 'Bear' then -1.0 else 0.0 end"
_grade = "case when {0} between 1 and 3 then {0} when {0} between 4 and 6 then 3 - {0} else 0 end"
G09_SQL = f"""select symbol, date, cast(round_even(round(100 * (case when ml <> 0 then 0.35 * greatest(least(ml, 4), -4) / 4 when rules <> 0 then 0.25 * greatest(least(rules, 4), -4) / 4 else 0 end
  + 0.15 * {_side} + 0.10 * case sec when 'PullbackInBull' then 1.0 when 'TrendingUp' then 0.8 when 'PullbackInBear' then -1.0 when 'TrendingDown' then -0.8 else 0.3 * {_side} end + 0.12 * sign(x) + case when up then 0.10 else 0 end
  + 0.05 * case when adx >= 25 then {_side} when adx >= 20 then 0.5 * {_side} else 0 end + 0.08 * ({_grade.format('rr')}) / 3.0 + 0.08 * ({_grade.format('rm')}) / 3.0
  + 0.06 * case ut when 1 then 0.4 when 2 then 0.7 when 3 then 1.0 when 4 then -0.4 when 5 then -0.7 when 6 then -1.0 else 0 end + case when abs(days) > 8 then -0.05 * least(1.0, (abs(days) - 8) / 10.0) else 0 end
  + case when hi <= 2 and (ml <> 0 or rules <> 0) then -0.05 else 0 end + case when lo <= 5 and (pri = 'Bull' or up) then 0.05 else 0 end), 6), 0) as integer) as points from g9"""


@query("G09_swing_points", Chain("bars_walk", (("g9", G09_ROWS.format(bars="bars_walk")),)).sql(G09_SQL))
def g09(spark, path):
    df = spark.sql(G09_ROWS.replace("{bars}", "{b}"), b=bars_walk(spark, path))
    names = ["Weak", "Moderate", "Strong"]
    forms = [(side, g) for side in ("Bullish", "Bearish") for g in names]
    label = lambda c, form: F.coalesce(*[F.when(F.col(c) == i + 1, form.format(*f)) for i, f in enumerate(forms)])
    rules, ml, ut = label("rr", "{}Reversal{}"), label("rm", "{}Reversal-ML{}"), label("ut", "{}Reversal[{}]")
    c = F.col
    points = sc.swing_points(*(c(x).cast("double") for x in ("ml", "rules")), c("pri"), c("sec"), c("x").cast("double"), c("up"), c("adx").cast("double"), sc.reversal_points(rules, False), sc.reversal_points(ml, True), sc.uturn_value(ut), *(c(x).cast("double") for x in ("days", "hi", "lo")))
    return df.select("symbol", "date", points.alias("points"))


@query("G10_ema_structure", SWING.add(f"round({filled(f'avg(close) {over(200)}', 'close', 200)}, 9) as m200", "round(ema20, 9) as m20", "round(ema50, 9) as m50").sql("select symbol, date, case when m20 > m50 and m50 > m200 then 2 when m20 > m50 then 1 when m50 > m20 then -1 end as ema_struct, cast(greatest(least(volume % 5 - 2, 1), 0) + greatest(least(volume % 3 - 1, 1), 0) as integer) as consensus, round(close / nullif(ema20, 0), 6) as price_over_ema20 from {last}"))
def g10(spark, path):
    df = ind.sma(emas(bars_walk(spark, path), "close", 20, 50), 200, "sma200")
    v = F.col("volume")
    return df.select("symbol", "date", sc.ema_structure(*(F.round(c, 9) for c in ("ema20", "ema50", "sma200"))).alias("ema_struct"), sc.classifier_consensus((v % 5 - 2).cast("int"), (v % 3 - 1).cast("int")).alias("consensus"), F.round(F.try_divide("close", "ema20"), 6).alias("price_over_ema20"))


@query("G15_ensemble", Chain("bars_walk").sql("select symbol, date, round(case when volume % 3 = 0 then volume % 11 / 10.0 when volume % 3 = 1 then volume % 7 / 10.0 else 0.3 * (volume % 7) / 10.0 + 0.7 * (volume % 11) / 10.0 end, 6)::double as score from {last}"))
def g15(spark, path):
    v = F.col("volume")
    online, batch = F.when(v % 3 != 0, v % 7 / 10.0), F.when(v % 3 != 1, v % 11 / 10.0)
    return bars_walk(spark, path).select("symbol", "date", F.round(sc.ensemble(online, batch, 0.3), 6).alias("score"))


@query("B17_snapshot_columns", TREND.sql("select symbol as Symbol, date as Date, close as Close, volume as Volume, round(coalesce(atr, 0), 4) as ATR, round(coalesce(adx, 0), 4) as ADX, round(coalesce(bb_width, 0), 4) as BB_width, round(ema200, 4) as EMA200, di_trend as DITrend from {last}"))
def b17(spark, path):
    df = ind.sma(ind.sma(ind.macd(ind.rsi_wilder(labelled(bars_raw(spark, path)))), 50, "sma50"), 200, "sma200")
    s = clean.snapshot_columns(df)
    return s.select("Symbol", "Date", "Close", "Volume", *(F.round(c, 4).alias(c) for c in ("ATR", "ADX", "BB_width", "EMA200")), "DITrend")


# Snapshots as a careless writer lands them: values of most rows keep the rules, a few of each column do not.
CARELESS = {
    "SignalClassifier_ML": "volume % 11 - 5", "SignalClassifier_Rules": "case when volume % 4 <> 0 then volume % 9 - 4 end", "Trend": "case volume % 13 when 0 then 'Bull TrendingUp' when 1 then 'Up[Volatile]' when 2 then 'Bear[Sideways]' else trend end",
    "TrendReversal_Rules": "case volume % 5 when 0 then 'NoReversal' when 1 then ' BullishReversalStrong ' when 2 then 'BullishReversal' else '0' end", "TrendReversal_ML": "case when volume % 6 = 0 then 'BearishReversal-MLWeak' when volume % 6 = 1 then 'bearish' end",
    "TMA21_50_X": "volume % 4 - 1", "RSIUpTrend": "case when volume % 3 = 0 then 'True' when volume % 7 = 0 then 'yes' else '0' end", "ADX": "case when volume % 10 = 0 then -adx else adx end", "Pct2H52": "close / 10 - 50", "PctfL52": "close - 1000",
}
VOCABULARY = ", ".join(f"'{x}'" for x in rk.REVERSALS)
KEPT = {
    **{f"{c}_range": f"{c} between -4 and 4" for c in ("SignalClassifier_ML", "SignalClassifier_Rules")},
    "Trend_format": r"regexp_matches(Trend, '^\w+\[\w+\]$')", "Trend_primary": "split_part(Trend, '[', 1) in ('Bull', 'Bear', 'Neutral')",
    "Trend_secondary": r"regexp_extract(Trend, '\[([^\]]+)\]', 1) in (''" + "".join(f", '{x}'" for x in rk.SECONDARY) + ")",
    **{f"{c}_label": f"trim({c}) in ({VOCABULARY})" for c in ("TrendReversal_Rules", "TrendReversal_ML")},
    "TMA21_50_X_value": "TMA21_50_X in (-1, 0, 1)", "RSIUpTrend_value": "lower(trim(RSIUpTrend)) in ('0', '1', 'true', 'false')", "ADX_range": "ADX between 0 and 100", **{f"{c}_range": f"{c} between -100 and 1000" for c in ("Pct2H52", "PctfL52")},
}
SNAPSHOT = Chain("snap", (*TREND.steps, ("snap", f"select {', '.join(f'{x} as {c}' for c, x in CARELESS.items())} from {TREND.last}")))


@query("D12_rule_checks", SNAPSHOT.held().sql(" union all ".join(f"select '{name}' as rule, count(*) filter (where not coalesce({ok}, true)) as violations from {{last}}" for name, ok in KEPT.items())))
def d12(spark, path):
    snapshot = labelled(bars_raw(spark, path)).selectExpr(*(f"{x} as {c}" for c, x in CARELESS.items()))
    return rk.check_snapshot(snapshot)


# The reversal detector in SQL: the same bounds looked up by number, ranges by a join.
DET = (
    REVERSAL.add(f"greatest(high - low, abs(high - lag(close) {OVER}), abs(low - lag(close) {OVER})) as tr0", "(high + low + close) / 3 as tp", f"lag(high) {OVER} as h1", f"lag(low) {OVER} as l1", f"lag(close) {OVER} as c1")
    .add("case when c1 is null then high - low else tr0 end as tr", "case when high - h1 > l1 - low and high - h1 > 0 then high - h1 else 0.0 end as pdm", "case when l1 - low > high - h1 and l1 - low > 0 then l1 - low else 0.0 end as mdm", f"tp - lag(tp) {OVER} as tchg")
    .ewm("tr", "atr", 1 / 14).ewm("pdm", "pp", 1 / 14).ewm("mdm", "mm", 1 / 14)
    .add("100 * pp / nullif(atr, 0) as pdi", "100 * mm / nullif(atr, 0) as mdi").add("coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0.0) as dx").ewm("dx", "adx", 1 / 14)
    .ewm("close", "e12", 2 / 13).ewm("close", "e26", 2 / 27).add("e12 - e26 as macd").ewm("macd", "ms", 2 / 10).ewm("close", "ema8", 2 / 9)
    .add("macd - ms as mh", f"count(chg) {over(14)} as nchg", f"avg(greatest(chg, 0.0)) filter (chg is not null) {over(14)} as g_", f"avg(greatest(-chg, 0.0)) filter (chg is not null) {over(14)} as l_", f"sum(case when tchg > 0 then tp * volume else 0.0 end) {over(14)} as in_", f"sum(case when tchg < 0 then tp * volume else 0.0 end) {over(14)} as out_",
         f"cast(sum(coalesce(sign(chg) * volume, 0)) {SO_FAR} as double) as obv", f"sum(close) {SO_FAR} as s_c", f"sum(idx * close) {SO_FAR} as s_ic", f"sum(cast(volume as double)) {SO_FAR} as s_v", f"lag(ema8, 3) {OVER} as ema8_3", f"avg(volume) {over(20)} as vol20")
    .add("case when nchg >= 14 then 100 - 100 / (1 + g_ / (l_ + 1e-9)) else 50.0 end as rsi", "case when idx >= 13 then 100 - 100 / (1 + in_ / (out_ + 1e-9)) else 50.0 end as mfi", f"sum(cast(macd > ms as integer)) {SO_FAR} as s_above", f"mh - lag(mh) {OVER} as hstep")
)


def side_chain(side: str) -> Chain:
    now, before, s = ("up", "prior_down", -1) if side == "bull" else ("down", "prior_up", 1)
    bull = side == "bull"
    a = DET.add(f"{before}_n >= 5 and {now}_n >= 1 and {before}_n > {now}_n and idx >= 29 as cand", f"{before}_n as pl", f"{now}_n as ll", f"{now}_stop as p1", f"{before}_stop + 1 as p0", f"{now}_stop + 1 as l0")
    a = a.add("greatest(p1 - least(10, pl) + 1, 0) as w0").at("greatest(a.p0 - 1, 0)", pre="close").at("a.p1", ep="close", ec="s_c", eic="s_ic", vp1="s_v", abp1="s_above").at("a.w0 - 1", bc="s_c", bic="s_ic").at("a.p0", obv0="obv", adx0="adx").at("a.p0 - 1", vb="s_v").at("a.l0", obvl="obv")
    a = a.add(f"{s} * (ep - pre) / (pre + 1e-9) as pm", f"{-s} * (close - ep) / (ep + 1e-9) as lm", "p1 - w0 + 1 as n1", "idx - l0 + 1 as n2")
    a = a.add("coalesce(((eic - coalesce(bic, 0)) - (w0 + (n1 - 1) / 2.0) * (ec - coalesce(bc, 0))) / nullif(n1 * (n1 * n1 - 1) / 12.0, 0), 0) as ps", "coalesce(((s_ic - eic) - (l0 + (n2 - 1) / 2.0) * (s_c - ec)) / nullif(n2 * (n2 * n2 - 1) / 12.0, 0), 0) as ls")
    u = lambda x: f"greatest(least({x}, 1.0), 0.0)"
    tanh = "(1 - 2 / (exp(2 * greatest(-300, least(300, {0}))) + 1))"
    x = f"({-s} * (ls - ps) / (abs(ps) + 1e-9))"
    score = u(f"0.45 * (pl - ll) / (pl + 1e-9) + 0.35 * (1 - {u('lm / (lm + pm + 1e-9)')}) + 0.20 * {u(f'({tanh.format(x)} + 1) / 2')}")
    a = a.add(f"case when cand then case when pm < 0.03 then 0.0 else {score} end end as pattern_score_")
    span = Chain(f"c{len(a.steps)}", tuple(a.steps))
    span.steps.append((span.last, f"select a.*, x.lo, x.hi from {a.last} a left join (select a.symbol, a.date, min(b.hstep) as lo, max(b.hstep) as hi from {a.last} a join {a.last} b on a.symbol = b.symbol and b.idx between a.l0 + 1 and a.idx where a.pattern_score_ > 0 group by a.symbol, a.date) x on a.symbol = x.symbol and a.date = x.date"))
    rsi = "case when rsi <= 35 then 1.0 else greatest(0.0, (42.0 - rsi) / (42.0 + 1e-9)) end" if bull else "case when rsi >= 65 then 1.0 else greatest(0.0, (rsi - 52.0) / (48.0 + 1e-9)) end"
    mfi = "case when mfi <= 40 then 1.0 else greatest(0.0, (45 - mfi) / 15) end" if bull else "case when mfi >= 60 then 1.0 else greatest(0.0, (mfi - 55) / 15) end"
    macd = f"case when s_above - abp1 > 0 then 1.0 else {u('((case when idx > l0 then hstep else 0.0 end) - least(coalesce(lo, 0.0), 0.0)) / (abs(greatest(coalesce(hi, 0.0), 0.0)) + 1e-9)')} end"
    vol = u("(((s_v - vp1) / n2 + 1e-9) / ((vp1 - coalesce(vb, 0)) / (p1 - p0 + 1) + 1e-9) - 0.75) / 2.25")
    total = f"""0.20 * ({rsi}) + 0.20 * ({macd}) + 0.18 * (0.6 * {vol} + 0.4 * (case when obv > obvl then 1.0 else greatest(0.0, (obv - obv0) / (abs(obv0) + 1e-9)) end))
  + 0.12 * (case when close > ema8 and ema8 > ema8_3 then 1.0 else greatest(0.0, (close - ema8) / (ema8 + 1e-9)) end) + 0.08 * (case when adx < adx0 then {u('(adx0 - adx) / (adx0 + 1e-9)')} when adx < 25 then 1.0 else greatest(0.0, (40 - adx) / 15) end)
  + 0.07 * ({mfi}) + 0.05 * (case when atr / (close + 1e-9) <= 0.12 then 1.0 else greatest(0.0, (0.18 - atr / (close + 1e-9)) / 0.18) end) + 0.05 + 0.03"""
    return span.add(f"case when pattern_score_ > 0 then {u(total)} end as confirm_score_")


def panel(spark, path) -> DataFrame:
    return rv.detector_panel(bars_walk(spark, path))


def _both_sides() -> tuple[list[tuple[str, str]], str, str]:
    """CTEs of both sides, the bear's renamed, and the last of each."""
    bull, bear = side_chain("bull"), side_chain("bear")
    names = {n for n, _ in bear.steps}
    moved = [(f"b{n}", re.sub(r"\b(c\d+)\b(?=( a\b| b\b|$| where| \())", lambda m: f"b{m[1]}" if m[1] in names else m[0], t)) for n, t in bear.steps]
    return [*bull.steps, *moved], bull.last, f"b{bear.last}"


def _sides_sql(column: str, where: str) -> str:
    steps, bull, bear = _both_sides()
    return Chain("x", tuple(steps)).sql(" union all ".join(f"select symbol, date, '{side}' as side, round({column}_, 5) as {column} from {last} where {where}" for side, last in (("bull", bull), ("bear", bear))))


def _label_steps() -> Chain:
    steps, bull, bear = _both_sides()
    part = lambda last: f"select symbol, date, pattern_score_ * confirm_score_ as s from {last} where pattern_score_ > 0"
    steps += [
        ("lab0", f"select d.symbol, d.date, d.close, d.atr, d.vol20, coalesce(x.s, 0) as b, coalesce(y.s, 0) as r, greatest(coalesce(x.s, 0), coalesce(y.s, 0)) as best from {bull} d left join ({part(bull)}) x on d.symbol = x.symbol and d.date = x.date left join ({part(bear)}) y on d.symbol = y.symbol and d.date = y.date"),
        ("lab1", "select *, case when best >= 0.70 then 'Strong' when best >= 0.45 then 'Moderate' when best >= 0.20 then 'Weak' end as strength, b >= r as up_ from lab0"),
        ("lab2", "select *, case when strength is null then 'NoReversal' else case when up_ then 'Bullish' else 'Bearish' end || 'Reversal' || strength end as reversal, case when atr > 0 then case strength when 'Strong' then 1.0 when 'Moderate' then 1.5 else 2.0 end * atr else close * 0.03 end as away from lab1"),
        ("lab3", "select *, case when up_ then 1.0 else -1.0 end as sg, case strength when 'Strong' then 2.0 when 'Moderate' then 1.8 else 1.5 end as rr from lab2"),
    ]
    return Chain("lab3", tuple(steps))


query("F19_pattern_score", _sides_sql("pattern_score", "cand"))(lambda spark, path: rv.side_scores(panel(spark, path)).select("symbol", "date", "side", F.round("pattern_score", 5).alias("pattern_score")))
query("F20_confirmation_score", _sides_sql("confirm_score", "pattern_score_ > 0"))(lambda spark, path: rv.side_scores(panel(spark, path)).filter("pattern_score > 0").select("symbol", "date", "side", F.round("confirm_score", 5).alias("confirm_score")))


@query("F21_reversal_label", _label_steps().sql("select symbol, date, reversal from {last}"))
def f21(spark, path):
    return rv.reversal_labels(panel(spark, path)).select("symbol", "date", "reversal")


@query("F22_trade_plan", _label_steps().sql("select symbol, date, reversal, round(close - sg * away, 4) as stop_price, round(close + sg * rr * away, 4) as target_price, cast(least(case when away > 0 then floor(1000.0 / (away + 1e-9)) else 0 end, case when vol20 > 0 then floor(vol20 * 10) else 1e18 end) as bigint) as position_size from {last} where strength is not null"))
def f22(spark, path):
    labels = rv.reversal_labels(panel(spark, path)).withColumn("vol20", F.col("vol20") * 1000)  # the walk's volumes are small
    plan = rv.trade_plan(labels, least_volume=100.0).filter("strength is not null")
    return plan.select("symbol", "date", "reversal", F.round("stop_price", 4).alias("stop_price"), F.round("target_price", 4).alias("target_price"), F.col("position_size").cast("bigint"))


MARKET = Chain("bars_walk", (("idx_", "select date, 'index' as symbol, avg(close) as close from bars_walk group by date"), ("m0", f"select *, close - lag(close) {OVER} as chg from idx_"), ("m1", f"select *, count(chg) {over(14)} as n_, avg(greatest(chg, 0.0)) filter (chg is not null) {over(14)} as g_, avg(greatest(-chg, 0.0)) filter (chg is not null) {over(14)} as l_ from m0"), ("m2", "select date, case when n_ >= 14 then 100 - 100 / (1 + g_ / (l_ + 1e-9)) else 50.0 end as r from m1")))


@query("F23_market_factor", MARKET.sql("select b.symbol, b.date, round(case when r > 40 then 1.0 else greatest(0.0, (r - 30) / 10) end, 4) as market_factor from bars_walk b left join m2 using (date)"))
def f23(spark, path):
    bars = bars_walk(spark, path)
    index = bars.groupBy("date").agg(F.avg("close").alias("close"))
    return rv.market_factor(bars, index, "bull").select("symbol", "date", F.round("market_factor", 4).alias("market_factor"))


def extreme_rows(spark, path) -> DataFrame:
    return rv.rule_score(rv.rsi_extreme_candidates(rv.ml_panel(bars_walk(spark, path))))


PAST30 = "over (partition by symbol order by date rows between 30 preceding and 1 preceding)"
PAST3 = "over (partition by symbol order by date rows between 3 preceding and 1 preceding)"
EXTREME = (
    DET.ewm("close", "ema20", 2 / 21).ewm("close", "ema50", 2 / 51).ewm("case when chg is not null then greatest(chg, 0.0) end", "wg", 1 / 14).ewm("case when chg is not null then greatest(-chg, 0.0) end", "wl", 1 / 14)
    .add("100 - 100 / (1 + wg / (wl + 1e-10)) as wr", f"coalesce((ema50 - lag(ema50, 30) {OVER}) / nullif(atr * 30, 0), 0.0) as slow_", "cast(close > ema50 as integer) as ab_", "cast(close < ema50 as integer) as be_")
    .add(f"lag(wr) {OVER} as wr1", f"avg(ab_) {PAST30} as ra_", f"avg(be_) {PAST30} as rb_", f"quantile_cont(adx, 0.5) {PAST30} as ma_", f"quantile_cont(pdi, 0.5) {PAST30} as mp_", f"quantile_cont(mdi, 0.5) {PAST30} as mm_", f"sum(ab_) {PAST3} as ua_", f"sum(be_) {PAST3} as ub_")
    .add("case when idx >= 52 and wr1 < 30 and wr > wr1 and rb_ >= 0.5 and ma_ >= 15 and mm_ > mp_ and slow_ <= -0.005 and ub_ = 3 then 1 when idx >= 52 and wr1 > 70 and wr < wr1 and ra_ >= 0.5 and ma_ >= 15 and mp_ > mm_ and slow_ >= 0.005 and ua_ = 3 then -1 else 0 end as side")
)


@query("F24_rsi_extreme_candidates", EXTREME.sql("select symbol, date, side from {last} where side <> 0"))
def f24(spark, path):
    return extreme_rows(spark, path).filter("side <> 0").select("symbol", "date", "side")


def _pick(cond: str) -> str:
    return f"case when coalesce({cond}, false) then 0.65 else 0.45 end"


RULED = (
    EXTREME.add(SPIKE, *CANDLES, f"coalesce((ema20 - lag(ema20, 5) {OVER}) / nullif(atr * 5, 0), 0.0) as fast_", f"avg(close) {over(20)} as m20_", f"stddev_pop(close) {over(20)} as s20_", f"lag(close) {OVER} as cl1")
    .add(f"lag(m20_ + 2 * s20_) {OVER} as hi1", f"lag(m20_ - 2 * s20_) {OVER} as lo1", "side = 1 as bu_", "side = -1 as be2_", "(adx - 15) / 10 as ta_")
    .add(
        f"""0.2 * ((1 - 2 / (exp(2 * ta_) + 1)) * 0.25 + 0.25) + 0.2 * (greatest(least(fast_, 1.5), -1.5) / 3 + 0.5) + 0.2 * (greatest(least(mh, 2.0), -2.0) / 4 + 0.5) + 0.15 * {_pick('(be2_ and cl1 >= hi1) or (bu_ and cl1 <= lo1)')} + 0.15 * least(vol_spike / 3, 1.0)
  + 0.1 * {_pick('(bu_ and (bull_engulf = 1 or hammer = 1)) or (be2_ and (bear_engulf = 1 or shooting_star = 1))')} + 0.1 * {_pick('(bu_ and fast_ > 0 and mh > 0) or (be2_ and fast_ < 0 and mh < 0)')} + case when (be2_ and mfi > 70) or (bu_ and mfi < 30) then 0.05 else 0.0 end as rule_score"""
    )
    .add("case when bu_ then 'Bullish' else 'Bearish' end || 'Reversal-' || case when rule_score >= 0.70 then 'MLStrong' when rule_score >= 0.55 then 'MLModerate' else 'MLWeak' end as ml_label")
)


@query("F25_rule_score", RULED.sql("select symbol, date, side, round(greatest(least(rule_score, 1.0), 0.0), 5) as rule_score, ml_label from {last} where side <> 0"))
def f25(spark, path):
    return extreme_rows(spark, path).filter("side <> 0").select("symbol", "date", "side", F.round("rule_score", 5).alias("rule_score"), "ml_label")


DIVERGENCE = EXTREME.add("coalesce(wr, 50.0) as r_")
_prev, _curr = ("over (partition by symbol order by date rows between 60 preceding and 31 preceding)", PAST30)
DIVERGENCE = DIVERGENCE.add(*(f"{agg}(struct_pack(c := close, k := {k}, r := r_)) {w} as {n}" for agg, k, w, n in (("max", "-idx", _prev, "hp"), ("max", "-idx", _curr, "hc"), ("min", "idx", _prev, "lp"), ("min", "idx", _curr, "lc"))))


@query("F26_divergence", DIVERGENCE.sql("select symbol, date, coalesce(idx >= 60 and hc.c > hp.c and hc.r < hp.r, false) as bear_div, coalesce(idx >= 60 and lc.c < lp.c and lc.r > lp.r, false) as bull_div from {last}"))
def f26(spark, path):
    return rv.divergence(tr.indexed(ind.rsi_wilder(bars_walk(spark, path)))).select("symbol", "date", "bear_div", "bull_div")


