"""Queries over window indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import emas
from tidemark.operators import indicators as ind
from tidemark.plans.registry import OVER, SO_FAR, Chain, filled, over, query
from tidemark.sources.tables import bars_raw, bars_walk

KEYS = ("symbol", "date")
BARS = Chain("bars_raw")
WALK = Chain("bars_walk")  # integer prices: means and ratios of them do not end in a tie of rounding


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *((F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def picked(chain: Chain, *columns: str, exact: tuple[str, ...] = (), digits: int = 4) -> str:
    return chain.sql(f"select symbol, date, {', '.join([f'round({c}, {digits}) + 0.0 as {c}' for c in columns] + list(exact))} from {{last}}")


def register(name: str, chain: Chain, build, *columns: str, exact: tuple[str, ...] = (), digits: int = 4, source=bars_raw) -> None:
    query(name, picked(chain, *columns, exact=exact, digits=digits))(lambda spark, path: rounded(build(source(spark, path)), *columns, *exact, digits=digits))


# Chains that several oracles share.
RANGE = BARS.add(f"lag(close) {OVER} as c1", f"lag(high) {OVER} as h1", f"lag(low) {OVER} as l1").add(
    "close - c1 as chg", "case when c1 is null then high - low else greatest(high - low, abs(high - c1), abs(low - c1)) end as tr", "(high + low + close) / 3 as tp"
)
ATR = RANGE.ewm("tr", "atr", 1 / 14)
RSI = RANGE.ewm("case when chg is not null then greatest(chg, 0.0) end", "g", 1 / 14).ewm("case when chg is not null then greatest(-chg, 0.0) end", "l", 1 / 14).add("100 - 100 / (1 + g / (l + 1e-10)) as rsi")
MACD = RANGE.ewm("close", "ema12", 2 / 13).ewm("close", "ema26", 2 / 27).add("ema12 - ema26 as macd").ewm("macd", "macd_signal", 2 / 10).add("macd - macd_signal as macd_hist")
DI = (
    ATR.add("case when high - h1 > l1 - low and high - h1 > 0 then high - h1 else 0.0 end as pdm", "case when l1 - low > high - h1 and l1 - low > 0 then l1 - low else 0.0 end as mdm")
    .ewm("pdm", "pdm_s", 1 / 14)
    .ewm("mdm", "mdm_s", 1 / 14)
    .add("100 * pdm_s / nullif(atr, 0) as plus_di", "100 * mdm_s / nullif(atr, 0) as minus_di")
    .add("coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0.0) as dx")
    .ewm("dx", "adx", 1 / 14)
)
BANDS = RANGE.add(f"avg(close) {over(20)} as m_", f"stddev_pop(close) {over(20)} as s_", f"count(close) {over(20)} as n_").add("case when n_ >= 20 then m_ end as bb_mid", "case when n_ >= 20 then m_ - 2 * s_ end as bb_low", "case when n_ >= 20 then m_ + 2 * s_ end as bb_high")

register("E01_sma", WALK.add(f"{filled(f'avg(close) {over(50)}', 'close', 50)} as sma50", f"{filled(f'avg(close) {over(200)}', 'close', 200)} as sma200", f"avg(close) {over(50)} as sma50_partial"), lambda df: ind.sma(ind.sma(ind.sma(df, 50, "sma50"), 200, "sma200"), 50, "sma50_partial", partial=True), "sma50", "sma200", "sma50_partial", source=bars_walk)


def _emas(df: DataFrame) -> DataFrame:
    df = emas(df, "close", 8, 12, 20, 26, 50, 200)
    return ind.ema_sma_seed(df, 20, "ema20_seeded")


_chain = BARS
for _n in (8, 12, 20, 26, 50, 200):
    _chain = _chain.ewm("close", f"ema{_n}", 2 / (_n + 1))
_chain = _chain.add(f"row_number() {OVER} as rn", f"avg(close) {over(20)} as m20").ewm("case when rn = 20 then m20 when rn > 20 then close end", "ema20_seeded", 2 / 21)
register("E02_ema", _chain, _emas, "ema8", "ema12", "ema20", "ema26", "ema50", "ema200", "ema20_seeded")
register("E03_rma", BARS.ewm("close", "rma14", 1 / 14), lambda df: ind.rma(df, "close", 14, "rma14"), "rma14")
SMOOTH = RSI.add(f"list(rsi) {over(40)} as held").add("list_filter(held, lambda x: x is not null) as kept_").add("case when rsi is not null then list_sum(list_transform(kept_, lambda x, i: x * pow(1.0 / 3, len(kept_) - i))) / list_sum(list_transform(kept_, lambda x, i: pow(1.0 / 3, len(kept_) - i))) end as rsi_smooth")
register("E04_ewm_adjusted", SMOOTH, lambda df: ind.smoothed_rsi(ind.rsi_wilder(df)), "rsi_smooth")
register("E05_true_range", RANGE, ind.true_range, "tr", digits=8)
register("E06_atr", ATR, ind.atr, "atr")
register("E07_rsi_wilder", RSI, ind.rsi_wilder, "rsi")
register("E08_rsi_simple", RANGE.add(f"count(chg) {over(14)} as n_", f"avg(greatest(chg, 0.0)) filter (chg is not null) {over(14)} as g_", f"avg(greatest(-chg, 0.0)) filter (chg is not null) {over(14)} as l_").add("case when n_ >= 14 then 100 - 100 / (1 + g_ / (l_ + 1e-9)) else 50.0 end as rsi_simple"), ind.rsi_simple, "rsi_simple")
register("E09_macd", MACD, ind.macd, "macd", "macd_signal", "macd_hist")
register("E10_adx", DI, ind.directional, "plus_di", "minus_di", "adx")
DI_TREND = DI.add("abs(plus_di - minus_di) as di_width", "case when plus_di > minus_di then 'Bull' when plus_di = minus_di then 'Nil' when plus_di < minus_di then 'Bear' else 'Unknown' end as di_trend")
register("E11_di_width", DI_TREND, lambda df: ind.di_width(ind.directional(df)), "di_width", exact=("di_trend",))
MFI = RANGE.add(f"tp - lag(tp) {OVER} as tchg", f"row_number() {OVER} as rn").add(f"sum(case when tchg > 0 then tp * volume else 0.0 end) {over(14)} as in_", f"sum(case when tchg < 0 then tp * volume else 0.0 end) {over(14)} as out_").add("case when rn >= 14 then 100 - 100 / (1 + in_ / (out_ + 1e-9)) else 50.0 end as mfi")
register("E12_mfi", MFI, ind.mfi, "mfi")
register("E13_cmf", BARS.add(f"sum(((close - low) - (high - close)) / (high - low + 1e-9) * volume) {over(20)} / (sum(volume) {over(20)} + 1e-9) as cmf"), ind.cmf, "cmf")
OBV = RANGE.add(f"cast(sum(coalesce(sign(chg) * volume, 0)) {SO_FAR} as double) as obv")
register("E14_obv", OBV, ind.obv, "obv")
register("E15_bollinger", BANDS, ind.bollinger, "bb_low", "bb_mid", "bb_high")
SHAPE = BANDS.add("(bb_high - bb_low) / nullif(close, 0) as bb_width", "(bb_high - bb_low) / nullif(abs(bb_mid), 0) as bb_width_mid", "coalesce((close - bb_mid) / nullif((bb_high - bb_low) / 2, 0), 0.0) as bb_z")
register("E16_bb_width", SHAPE, lambda df: ind.bb_shape(ind.bollinger(df)), "bb_width", "bb_width_mid", "bb_z")
register("E17_cci", RANGE.add(f"avg(tp) {over(20)} as m_", f"list(tp) {over(20)} as held").add("case when len(held) >= 20 then (tp - m_) / nullif(0.015 * list_sum(list_transform(held, lambda x: abs(x - m_))) / 20, 0) end as cci"), ind.cci, "cci")
STOCH = RANGE.add(f"min(low) {over(14)} as lo_", f"max(high) {over(14)} as hi_", f"count(*) {over(14)} as n_").add("case when n_ >= 14 then 100 * (close - lo_) / nullif(hi_ - lo_, 0) end as k_").add(f"{filled(f'avg(k_) {over(3)}', 'k_', 3)} as stoch_k").add(f"{filled(f'avg(stoch_k) {over(3)}', 'stoch_k', 3)} as stoch_d")
register("E18_stochastic", STOCH, ind.stochastic, "stoch_k", "stoch_d")
TMA = BARS
for _n in (21, 50):
    _k = (_n + 1) // 2
    TMA = TMA.add(f"{filled(f'avg(close) {over(_k)}', 'close', _k)} as s{_n}").add(f"{filled(f'avg(s{_n}) {over(_k)}', f's{_n}', _k)} as tma{_n}")
register("E19_tma", TMA, lambda df: ind.tma(ind.tma(df, 21, "tma21"), 50, "tma50"), "tma21", "tma50")
SLOPE = BARS.ewm("close", "ema200", 2 / 201).add(f"row_number() {OVER} as rn").add(f"{filled(f'regr_slope(ema200, rn) {over(50)} / (case when avg(ema200) {over(50)} = 0 then 1.0 else avg(ema200) {over(50)} end)', 'ema200', 50)} as slope200")
register("E20_linear_slope", SLOPE, lambda df: ind.linear_slope(ind.ema(df, "close", 200, "ema200"), "ema200", 50, "slope200"), "slope200", digits=8)
#: The 0.90 quantile of Student's t for 10 and 3 degrees of freedom.
_t12, _t5 = 1.3721836411102863**2, 1.6377443536962102**2
SIGNIFICANT = SMOOTH.add(f"row_number() {OVER} as rn").add(*(f"{filled(f'regr_slope(rsi_smooth, rn) {over(n)}', 'rsi_smooth', n)} as slope{n}" for n in (12, 5)), *(f"{filled(f'coalesce(regr_r2(rsi_smooth, rn) {over(n)} > {t / (t + n - 2)!r}, false)', 'rsi_smooth', n)} as slope{n}_ok" for n, t in ((12, _t12), (5, _t5))))
register("E21_significant_slope", SIGNIFICANT, lambda df: ind.significant_slope(ind.significant_slope(ind.smoothed_rsi(ind.rsi_wilder(df)), "rsi_smooth", 12, "slope12"), "rsi_smooth", 5, "slope5"), "slope12", "slope5", exact=("slope12_ok", "slope5_ok"))
_names, _exprs = ["ret_1", "hl_ratio", "co_ratio"], [f"close / nullif(lag(close) {OVER}, 0) - 1 as ret_1", "high / nullif(low, 0) as hl_ratio", "close / nullif(open, 0) as co_ratio"]
for _n in (2, 5, 10, 20, 60):
    _names += [f"close_ratio_{_n}", f"range_{_n}", f"vol_ratio_{_n}", f"ret_{_n}"]
    _exprs += [f"{filled(f'close / nullif(avg(close) {over(_n)}, 0)', 'close', _n)} as close_ratio_{_n}", f"{filled(f'avg((high - low) / nullif(close, 0)) {over(_n)}', 'close', _n)} as range_{_n}", f"{filled(f'coalesce(volume / nullif(avg(volume) {over(_n)}, 0), 1.0)', 'close', _n)} as vol_ratio_{_n}", f"close / nullif(lag(close, {_n}) {OVER}, 0) - 1 as ret_{_n}"]
LAGGED = BARS.add(*_exprs)
register("E22_lagged_features", LAGGED, ind.lagged_features, *_names)
SLOPES = ATR.ewm("close", "ema20", 2 / 21).ewm("close", "ema50", 2 / 51).add(f"coalesce((ema20 - lag(ema20, 5) {OVER}) / nullif(atr * 5, 0), 0.0) as ema_fast_slope", f"coalesce((ema50 - lag(ema50, 30) {OVER}) / nullif(atr * 30, 0), 0.0) as ema_slow_slope")
register("E23_ema_slopes", SLOPES, lambda df: ind.ema_slopes(emas(ind.atr(df), "close", 20, 50)), "ema_fast_slope", "ema_slow_slope")
SPIKE = f"coalesce(volume / nullif(case when count(volume) {over(20)} >= 5 then avg(volume) {over(20)} end, 0), 1.0) as vol_spike"
register("E24_volume_spike", BARS.add(SPIKE), ind.volume_spike, "vol_spike")
CANDLES = (
    f"cast(coalesce(close > open and lag(close) {OVER} < lag(open) {OVER} and close >= lag(open) {OVER} and open <= lag(close) {OVER}, false) as integer) as bull_engulf",
    f"cast(coalesce(close < open and lag(close) {OVER} > lag(open) {OVER} and close <= lag(open) {OVER} and open >= lag(close) {OVER}, false) as integer) as bear_engulf",
    "cast(least(close, open) - least(low, open, close) >= 2 * abs(close - open) and greatest(high, open, close) - greatest(close, open) <= 0.5 * abs(close - open) as integer) as hammer",
    "cast(greatest(high, open, close) - greatest(close, open) >= 2 * abs(close - open) and least(close, open) - least(low, open, close) <= 0.5 * abs(close - open) as integer) as shooting_star",
)
register("E25_candles", BARS.add(*CANDLES), ind.candles, exact=("bull_engulf", "bear_engulf", "hammer", "shooting_star"))
YEAR = WALK.add(f"max(close) {over(252)} as high_52w", f"min(close) {over(252)} as low_52w").add("(1 - close / nullif(high_52w, 0)) * 100 as pct_to_high", "(1 - low_52w / nullif(close, 0)) * 100 as pct_from_low")
register("E26_year_range", YEAR, ind.year_range, "high_52w", "low_52w", "pct_to_high", "pct_from_low", source=bars_walk)
ANALYTIC = WALK.add(f"cast(row_number() {OVER} - 1 as integer) as cumcount", f"close - lag(close) {OVER} as diff", f"close / nullif(lag(close) {OVER}, 0) - 1 as pct_change", f"sum(close) {SO_FAR} as cumsum", "cast(rank() over (partition by symbol order by close desc) as integer) as rank_min", "cast(row_number() over (partition by symbol order by close desc, date) as integer) as rank_first", f"max(close) {SO_FAR} as peak").add(f"case when close = peak and close > coalesce(lag(peak) {OVER}, -1) then date end as peak_day").add(f"last_value(peak_day ignore nulls) {SO_FAR} as idxmax")
register("E28_analytic_ranks", ANALYTIC, ind.analytic_ranks, "diff", "pct_change", "cumsum", exact=("cumcount", "rank_min", "rank_first", "idxmax"), source=bars_walk)
