"""Queries over runs, trends and reversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, emas
from tidemark.operators import indicators as ind
from tidemark.operators import trends as tr
from tidemark.plans.indicators import DI, DI_TREND, RSI, SIGNIFICANT, WALK, register
from tidemark.plans.registry import OVER, SO_FAR, Chain, filled, over, query
from tidemark.sources import tables
from tidemark.sources.tables import bars_raw, bars_walk

PAST = "over (partition by symbol order by date rows between unbounded preceding and 1 preceding)"
IDX = WALK.add(f"row_number() {OVER} - 1 as idx", f"close - lag(close) {OVER} as chg")


def moved(chain: Chain, source: str) -> Chain:
    """The same steps over another panel."""
    return Chain(chain.last, tuple((n, t.replace("from bars_raw", f"from {source}")) for n, t in chain.steps))


RUN = IDX.island("nullif(sign(chg), 0)", "run")
FLAT_UP = IDX.island("case when chg is not null then case when chg < 0 then -1 else 1 end end", "r_").add(f"case when max(close) {SO_FAR} = min(close) {SO_FAR} then 0 else r_ end as run_flat_up")
register("F01_run_flat_up", FLAT_UP, tr.last_run_flat_up, exact=("run_flat_up",), source=bars_walk)
register("F02_run", RUN, tr.last_run, exact=("run",), source=bars_walk)
PRIOR = (
    RUN.at("a.idx - abs(a.run)", prior_="run")
    .add("case when coalesce(run = 0 or coalesce(prior_, 0) = 0 or abs(prior_) < 4 or sign(prior_) = sign(run), true) then 'ERR_NO_TREND' end as run_error")
    .add("case when run_error is null then abs(run) end as curr_days", "case when run_error is null then case when run > 0 then 'Up' else 'Down' end end as curr_type", "case when run_error is null then abs(prior_) end as prior_days", "case when run_error is null then case when prior_ > 0 then 'Up' else 'Down' end end as prior_type")
)
register("F03_current_and_prior", PRIOR, tr.current_and_prior, exact=("run_error", "curr_days", "curr_type", "prior_days", "prior_type"), source=bars_walk)


def tolerant(chain: Chain, soft: str, hard: str, name: str, cap: int) -> Chain:
    a = chain.add(f"case when idx > 0 and {soft} then idx end as so_{name}", f"case when idx > 0 and {hard} then idx end as ha_{name}")
    a = a.add(f"coalesce(last_value(so_{name} ignore nulls) {PAST}, 0) as sb_{name}")
    a = a.add(f"last_value(case when so_{name} is not null then sb_{name} end ignore nulls) {SO_FAR} as s2_{name}", f"last_value(so_{name} ignore nulls) {SO_FAR} as s1_{name}", f"last_value(ha_{name} ignore nulls) {SO_FAR} as h1_{name}")
    a = a.add(f"greatest(coalesce(s2_{name}, 0), coalesce(h1_{name}, 0), idx - {cap}, 0) as {name}_stop")
    return a.add(f"idx - {name}_stop - case when coalesce(s1_{name} > {name}_stop, false) then 1 else 0 end as {name}_n")


REVERSAL = tolerant(tolerant(IDX, "not coalesce(chg > 0, false)", "false", "up", 200), "not coalesce(chg < 0, false)", "false", "down", 200).at("a.up_stop", prior_down_n="down_n", prior_down_stop="down_stop").at("a.down_stop", prior_up_n="up_n", prior_up_stop="up_stop")
RUN_COLUMNS = ("up_n", "up_stop", "down_n", "down_stop", "prior_down_n", "prior_down_stop", "prior_up_n", "prior_up_stop")


def _as_int(df, columns):
    return df.select("symbol", "date", *(F.col(c).cast("int").alias(c) for c in columns))


def _ints(chain: Chain, columns) -> str:
    return chain.sql(f"select symbol, date, {', '.join(f'cast({c} as integer) as {c}' for c in columns)} from {{last}}")


query("F04_tolerant_runs", _ints(REVERSAL, RUN_COLUMNS))(lambda spark, path: _as_int(tr.reversal_runs(bars_walk(spark, path)), RUN_COLUMNS))
query("C10_run_lookup", _ints(REVERSAL, RUN_COLUMNS[4:]))(lambda spark, path: _as_int(tr.reversal_runs(bars_walk(spark, path)), RUN_COLUMNS[4:]))
PATTERN = (
    tolerant(tolerant(IDX.add("coalesce(chg, 0.0) as c_"), "abs(c_) < 1e-9", "c_ < -1e-9", "u", 60), "abs(c_) < 1e-9", "c_ > 1e-9", "d", 60)
    .at("a.u_stop", d2_="d_n")
    .add("u_n >= 2 and coalesce(d2_, 0) >= 5 and coalesce(d2_, 0) > u_n as pattern")
    .add("cast(case when pattern then u_n else 0 end as integer) as d1_recent_up", "cast(case when pattern then d2_ else 0 end as integer) as d2_prior_down", "case when pattern then round_even(0.4 * greatest(0, 100 - 10 * abs(u_n - 3)) + 0.6 * least(100.0, d2_ * 100.0 / 20), 2) else 0.0 end as pattern_score")
)
PATTERN_COLUMNS = ("pattern", "d1_recent_up", "d2_prior_down")
query("F05_price_pattern", PATTERN.sql("select symbol, date, pattern, d1_recent_up, d2_prior_down, cast(pattern_score as double) as pattern_score from {last}"))(
    lambda spark, path: tr.price_pattern(bars_walk(spark, path)).select("symbol", "date", "pattern", F.col("d1_recent_up").cast("int"), F.col("d2_prior_down").cast("int"), "pattern_score")
)
LAST_TREND = RUN.add(f"coalesce(lag(run) {OVER}, 0) as b_").add(
    "cast(case when b_ = 0 or (chg > 0 and b_ < 0) or (chg < 0 and b_ > 0) then b_ else b_ + sign(b_) end as integer) as last_trend_days",
    "case when b_ = 0 then 'No Trend' when chg > 0 and b_ < 0 then 'Reversal_Up' when chg < 0 and b_ > 0 then 'Reversal_Down' else 'Continuation' end as last_trend_type",
)
register("F06_last_trend", LAST_TREND, tr.last_trend, exact=("last_trend_days", "last_trend_type"), source=bars_walk)

# The panel of labels, step by step; prices are the raw ones, whose means do not tie.
PANEL = DI_TREND
for _n in (20, 50, 200):
    PANEL = PANEL.ewm("close", f"ema{_n}", 2 / (_n + 1))
PANEL = PANEL.add(f"avg(close) {over(20)} as m_", f"stddev_pop(close) {over(20)} as sd_", f"count(close) {over(20)} as n_", f"row_number() {OVER} - 1 as idx").add("case when n_ >= 20 then 4 * sd_ / nullif(close, 0) end as bb_width")
MA = PANEL.add(f"lag(ema20) {OVER} as a1", f"lag(ema50) {OVER} as b1", f"lag(close, 2) {OVER} as c2").add(
    """case when ema20 > ema50 and ema20 > a1 and ema50 > b1 and close > c1 and c1 > c2 then 'Bull+' when ema50 > ema20 and ema20 <= a1 and ema50 <= b1 and close < c1 and c1 < c2 then 'Bear+'
  when ema20 > ema50 and ema20 > a1 and ema50 > b1 then 'Bull' when ema50 > ema20 and ema20 <= a1 and ema50 <= b1 then 'Bear' else 'Nil' end as ma_trend"""
)
STRENGTH = MA.add(*(f"case when {c} >= {hi} then 'Strong' when {c} >= {mid} then 'Average' when {c} < {mid} then 'Weak' else 'Unknown' end as {n}" for c, hi, mid, n in (("adx", 25, 20, "adx_strength"), ("di_width", 15, 10, "di_strength"))))
MADI = STRENGTH.add("case when ema20 > ema50 and di_trend = 'Bull' then 'Bull' when ema50 > ema20 and di_trend = 'Bear' then 'Bear' else 'Nil' end as madi_trend")
COMBINED = MADI.add(
    """case when adx is null then 'NoTrend' when ma_trend = 'Bull+' then case when adx >= 25 then 'StrongBullish' else 'WeakBullish' end when ma_trend = 'Bull' then case when adx >= 20 then 'ModerateBullish' else 'WeakBullish' end
  when ma_trend = 'Bear+' then case when adx >= 25 then 'StrongBearish' else 'WeakBearish' end when ma_trend = 'Bear' then case when adx >= 20 then 'ModerateBearish' else 'WeakBearish' end else 'NoTrend' end as trend_label"""
)
PRIMARY = (
    COMBINED.add("idx + 1 as rn")
    .add(f"coalesce({filled(f'regr_slope(ema200, rn) {over(50)} / (case when avg(ema200) {over(50)} = 0 then 1.0 else avg(ema200) {over(50)} end)', 'ema200', 50)}, 0.0) as slope_")
    .add("case when ema50 > ema200 then 1.0 else -1.0 end + case di_trend when 'Bull' then 1.0 when 'Bear' then -1.0 else 0.0 end + case when adx >= 25 then 1.0 when adx >= 20 then 0.5 else 0.0 end + 0.5 * sign(slope_) * least(abs(slope_) * 10, 1.0) as primary_score")
    .add("case when primary_score >= 1 then 'Bull' when primary_score <= -1 then 'Bear' else 'Neutral' end as \"primary\"")
)
SECONDARY = PRIMARY.add(
    """case when "primary" = 'Neutral' and adx >= 20 and ema20 <> ema50 then 'ShortTrend' when "primary" = 'Bear' and close > ema20 and close < ema50 then 'PullbackInBear' when "primary" = 'Bull' and close < ema20 and close > ema50 then 'PullbackInBull'
  when adx >= 25 and ema20 < ema50 then 'TrendingDown' when adx >= 25 and ema20 > ema50 then 'TrendingUp'
  when coalesce(adx, 0) < 20 and coalesce(bb_width, 0) < 0.02 and not coalesce(atr / nullif(close, 0) > 0.015, false) then 'Ranging' when coalesce(atr / nullif(close, 0) > 0.015, false) then 'Volatile' else 'Unknown' end as secondary"""
)


def majority(c: str, out: str) -> str:
    y, z = f"lag({c}) {OVER}", f"lag({c}, 2) {OVER}"
    return f"case when {y} is null or {c} = {y} or {c} = {z} then {c} when {y} = {z} then {y} when {z} is null then least({c}, {y}) else least({c}, {y}, {z}) end as {out}"


TREND = SECONDARY.add(majority('"primary"', "primary_smooth"), majority("secondary", "secondary_smooth")).add("primary_smooth || '[' || secondary_smooth || ']' as trend")


def panel(df):
    df = ind.bb_shape(ind.bollinger(ind.di_width(ind.directional(ind.atr(df)))))
    df = emas(df, "close", 20, 50, 200)
    return tr.combined_trend(tr.madi_trend(tr.strengths(tr.ma_trend(df))))


def labelled(df):
    return tr.trend_string(tr.secondary_trend(tr.primary_trend(panel(df))))


register("F07_ma_trend", MA, panel, exact=("ma_trend",))
register("F08_strengths", STRENGTH, panel, exact=("adx_strength", "di_strength"))
register("F09_madi_trend", MADI, panel, exact=("madi_trend",))
register("F10_combined_trend", COMBINED, panel, exact=("trend_label",))
query("F11_primary", PRIMARY.sql('select symbol, date, round(primary_score, 4) + 0.0 as primary_score, "primary" as label from {last}'))(lambda spark, path: labelled(bars_raw(spark, path)).select("symbol", "date", (F.round("primary_score", 4) + 0.0).alias("primary_score"), F.col("primary").alias("label")))
register("F12_secondary", SECONDARY, labelled, exact=("secondary",))
register("F13_majority", TREND, labelled, exact=("primary_smooth", "secondary_smooth"))
query("F14_trend_string", TREND.sql("select symbol, date, trend, primary_smooth as p, secondary_smooth as s from {last}"))(
    lambda spark, path: labelled(bars_raw(spark, path)).select("symbol", "date", "trend", tr.parse_trend(F.col("trend")).alias("t")).select("symbol", "date", "trend", F.col("t.primary").alias("p"), F.col("t.secondary").alias("s"))
)
TMA_X = DI
for _n in (21, 50):
    _k = (_n + 1) // 2
    TMA_X = TMA_X.add(f"{filled(f'avg(close) {over(_k)}', 'close', _k)} as s{_n}").add(f"{filled(f'avg(s{_n}) {over(_k)}', f's{_n}', _k)} as f{_n}")
TMA_X = (
    TMA_X.add("f21 - f50 as diff_", f"f21 - lag(f21) {OVER} as sf_", f"f50 - lag(f50) {OVER} as ss_")
    .add(f"lag(diff_) {OVER} as diff1_")
    .add("case when diff_ > 0 and diff1_ <= 0 and sf_ > 0 and ss_ >= 0 and close >= greatest(f21, f50) and adx >= 20 then 1 when diff_ < 0 and diff1_ >= 0 and sf_ < 0 and ss_ <= 0 and close <= least(f21, f50) and adx >= 20 then -1 end as hit_")
    .add(f"coalesce(last_value(hit_ ignore nulls) {over(10)}, 0) as tma_x")
)
register("F15_tma_cross", TMA_X, lambda df: tr.tma_cross(ind.directional(df)), exact=("tma_x",))
RSI_UP = SIGNIFICANT.add(f"rsi_smooth - lag(rsi_smooth) {OVER} as step_").add(
    f"""coalesce(lag(slope12, 5) {OVER} < -0.02 and lag(slope12_ok, 5) {OVER} and lag(rsi_smooth, 5) {OVER} < 35 and slope5 > 0.02 and slope5_ok and rsi_smooth - lag(rsi_smooth, 4) {OVER} > 0
  and min(step_) {over(4)} >= -rsi_smooth * 0.08 and rsi_smooth > 30 and min(rsi_smooth) {over(5)} <= 30, false) as rsi_up"""
)
register("F16_rsi_uptrend", moved(RSI_UP, "bars_walk"), lambda df: tr.rsi_uptrend(ind.rsi_wilder(df)), exact=("rsi_up",), source=bars_walk)


def extremes(chain: Chain) -> Chain:
    """The extreme closes of the prior run's bars."""
    chain = chain.held()
    out = Chain(f"c{len(chain.steps)}", tuple(chain.steps))
    out.steps.append((out.last, f"select a.*, x.prior_high, x.prior_low from {chain.last} a left join (select a.symbol, a.date, max(b.close) as prior_high, min(b.close) as prior_low from {chain.last} a join {chain.last} b on a.symbol = b.symbol and b.idx between a.idx - a.curr_days - a.prior_days + 1 and a.idx - a.curr_days where a.run_error is null group by a.symbol, a.date) x on a.symbol = x.symbol and a.date = x.date"))
    return out


register("E27_run_extremes", extremes(PRIOR), tr.current_and_prior, "prior_high", "prior_low", source=bars_walk)
SMAS = (f"{filled(f'avg(close) {over(50)}', 'close', 50)} as sma50", f"{filled(f'avg(close) {over(200)}', 'close', 200)} as sma200")
BASE = moved(RSI.ewm("tr", "atr", 1 / 14).ewm("close", "ema12", 2 / 13).ewm("close", "ema26", 2 / 27).add("ema12 - ema26 as macd").ewm("macd", "macd_signal", 2 / 10), "bars_walk").add("macd - macd_signal as macd_hist", f"cast(sum(coalesce(sign(chg) * volume, 0)) {SO_FAR} as double) as obv", *SMAS, f"row_number() {OVER} - 1 as idx")
WEIGHTED = BASE.island("nullif(sign(chg), 0)", "run")
WEIGHTED = (
    WEIGHTED.at("a.idx - abs(a.run)", prior_="run")
    .add("case when coalesce(run = 0 or coalesce(prior_, 0) = 0 or abs(prior_) < 4 or sign(prior_) = sign(run), true) then 'ERR_NO_TREND' end as run_error")
    .add("case when run_error is null then abs(run) end as curr_days", "run > 0 as up_", "case when run_error is null then abs(prior_) end as prior_days", *(f"lag({c}) {OVER} as {c}_1" for c in ("rsi", "macd", "obv", "sma50", "sma200")))
)
WEIGHTED = (
    extremes(WEIGHTED)
    .add(
        """2 * cast(coalesce(atr > 0, false) and case when up_ then close - prior_low >= 1.5 * atr else prior_high - close >= 1.5 * atr end as integer) + cast(coalesce(case when up_ then obv > obv_1 else obv < obv_1 end, false) as integer)
  + 2 * cast(coalesce(case when up_ then rsi_1 < 30 and rsi > rsi_1 else rsi_1 > 70 and rsi < rsi_1 end, false) as integer) + 3 * cast(coalesce(case when up_ then macd_1 < 0 and macd > 0 else macd_1 > 0 and macd < 0 end, false) as integer)
  + 4 * cast(coalesce(case when up_ then sma50_1 < sma200_1 and sma50 > sma200 else sma50_1 > sma200_1 and sma50 < sma200 end, false) as integer) as passed_"""
    )
    .add("round(cast(0.7 as double) * passed_ / 12 + cast(0.3 as double) * prior_days / (prior_days + curr_days), 9) as score_")
    .add("case when idx + 1 < 260 then 'ERR_INSUFF_DATA' when run_error is not null then run_error else case when up_ then 'BullishReversal[' else 'BearishReversal[' end || case when score_ >= 0.5 then 'Strong' when score_ >= 0.4 then 'Moderate' else 'Weak' end || ']' end as reversal_weighted")
)
register("F17_weighted_reversal", WEIGHTED, tr.weighted_reversal, exact=("reversal_weighted",), source=bars_walk)
TESTS = moved(DI, "bars_walk")
TESTS = (
    TESTS.ewm("case when chg is not null then greatest(chg, 0.0) end", "g", 1 / 14).ewm("case when chg is not null then greatest(-chg, 0.0) end", "l", 1 / 14).add("100 - 100 / (1 + g / (l + 1e-10)) as rsi")
    .ewm("close", "ema12", 2 / 13).ewm("close", "ema26", 2 / 27).add("ema12 - ema26 as macd").ewm("macd", "macd_signal", 2 / 10)
    .add("macd - macd_signal as macd_hist", f"cast(sum(coalesce(sign(chg) * volume, 0)) {SO_FAR} as double) as obv", *SMAS, f"row_number() {OVER} - 1 as idx", f"max(close) {over(252)} as hi52", f"min(close) {over(252)} as lo52",
         f"avg(tp) {over(20)} as mtp", f"list(tp) {over(20)} as htp", f"avg(close) {over(20)} as m_", f"stddev_pop(close) {over(20)} as sd_", f"count(close) {over(20)} as n_", f"min(low) {over(14)} as lo_", f"max(high) {over(14)} as hi_")
    .add("case when len(htp) >= 20 then (tp - mtp) / nullif(0.015 * list_sum(list_transform(htp, lambda x: abs(x - mtp))) / 20, 0) end as cci", "case when n_ >= 20 then m_ - 2 * sd_ end as bb_low", "case when n_ >= 20 then m_ + 2 * sd_ end as bb_high", "case when idx >= 13 then 100 * (close - lo_) / nullif(hi_ - lo_, 0) end as k_")
    .add(f"{filled(f'avg(k_) {over(3)}', 'k_', 3)} as stoch_k").add(f"{filled(f'avg(stoch_k) {over(3)}', 'stoch_k', 3)} as stoch_d")
    .island("case when chg is not null then case when chg < 0 then -1 else 1 end end", "r_").add(f"case when max(close) {SO_FAR} = min(close) {SO_FAR} then 0 else r_ end as run")
    .add(*(f"lag({c}) {OVER} as {c}_1" for c in ("cci", "rsi", "macd_hist", "obv", "adx", "sma50", "sma200")))
    .add("case when sma50 > sma200 and sma50_1 < sma200_1 then 1 when sma50 < sma200 and sma50_1 > sma200_1 then -1 end as cross_")
    .add(f"max(cast(cross_ = 1 as integer)) {over(3)} as up3", f"max(cast(cross_ = -1 as integer)) {over(3)} as dn3")
    .at("a.idx - abs(a.run)", prior_="run")
    .add("abs(run) as curr_days", "abs(prior_) as prior_days", "run > 0 as bull_")
    .add("case when idx + 1 < 260 then 'ERR_INSUFF_DATA' when run = 0 then 'ERR_NO_TREND' when coalesce(prior_, 0) = 0 then 'ERR_NO_PRIOR_TREND' when prior_days < 4 then 'ERR_PRIOR_DAYS' when curr_days >= prior_days then 'ERR_CURR_GT_PRIOR' when sign(run) = sign(prior_) then 'ERR_SAME_TRENDS' end as run_error")
)
_tests = (
    ("close >= lo52", "close <= hi52"), ("close - prior_low >= 1.5 * atr", "prior_high - close >= 1.5 * atr"), ("obv > obv_1", "obv < obv_1"), ("close > bb_low", "close < bb_high"),
    ("stoch_k > stoch_d and stoch_k < 20 and stoch_d < 20", "stoch_k < stoch_d and stoch_k > 80 and stoch_d > 80"), ("cci_1 < -100 and cci > -100", "cci_1 > 100 and cci < 100"), ("rsi_1 < 30 and rsi > rsi_1", "rsi_1 > 70 and rsi < rsi_1"),
    ("macd_hist_1 < 0 and macd_hist > 0", "macd_hist_1 > 0 and macd_hist < 0"), ("up3 = 1", "dn3 = 1"), ("adx_1 > adx", "adx_1 > adx"),
)
TESTS = extremes(TESTS).add(" + ".join(f"cast(coalesce(case when bull_ then {a} else {b} end, false) as integer)" for a, b in _tests) + " as n_ok").add(
    "coalesce(run_error, case when bull_ then 'U' || curr_days || '-D' || prior_days || ':BULL' else 'D' || curr_days || '-U' || prior_days || ':BEAR' end || '-REVERSAL-' || case when n_ok >= 9 then 'STRONG' when n_ok >= 7 then 'MOD' else 'WEAK' end || '_' || n_ok || '/10') as reversal_tests"
)
register("F18_ten_test_reversal", TESTS, tr.ten_test_reversal, exact=("reversal_tests",), source=bars_walk)
COUNTERS = (
    IDX.add("case when chg > 0 then 1 when chg < 0 then -1 else 0 end as sg").add(f"case when sg is not distinct from lag(sg) {OVER} and idx > 0 then 0 else 1 end as new_").add(f"sum(new_) {SO_FAR} as isl_")
    .add("count(*) over (partition by symbol, isl_ order by date rows between unbounded preceding and current row) as len_")
    .add("cast(case when sg = -1 then least(len_, 50) else 0 end as integer) as consec_down", "cast(case when sg = 1 then least(len_, 50) else 0 end as integer) as consec_up", f"(avg(volume) {over(4)} + 1e-9) / (avg(volume) {over(11)} + 1e-9) as vol_ratio_4_11")
)
register("F27_counters", COUNTERS, lambda df: _with_int(tr.counters(df)), "vol_ratio_4_11", exact=("consec_down", "consec_up"), source=bars_walk)


def _with_int(df):
    return df.withColumn("consec_down", F.col("consec_down").cast("int")).withColumn("consec_up", F.col("consec_up").cast("int"))



TAIL = 300
TAILED = Chain(TREND.last, (("tail", f"select * exclude back from (select *, row_number() over (partition by symbol order by date desc) as back from bars_raw) where back <= {TAIL}"), *((n, t.replace("from bars_raw", "from tail")) for n, t in TREND.steps)))


@query("tail_trend", TAILED.sql("select symbol, date, trend, trend_label, round(ema200, 6) as ema200, round(adx, 6) as adx from {last} where (symbol, date) in (select (symbol, max(date)) from tail group by symbol)"))
def tail_trend(spark, path):
    """Each symbol's newest trend as a nightly run has it, from its newest bars alone: exponential means start at the first of
    them."""
    df = tr.combined_trend(labelled(tables.bars(bars_raw(spark, path), tail_bars=TAIL)))
    columns = ["symbol", "date", "trend", "trend_label", F.round("ema200", 6).alias("ema200"), F.round("adx", 6).alias("adx")]
    return df.withColumn("next", F.lead("date").over(by_symbol())).filter("next is null").select(*columns)
