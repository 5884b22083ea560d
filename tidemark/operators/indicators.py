"""Technical indicators: each function adds its columns to a panel of bars (symbol, date, open, high, low, close, volume).

All windows are those of functions.windows, so Spark plans a chain of indicators over one exchange and one sort. Every
value at a bar looks back only. Values that need more bars than there are stay null unless a function says otherwise.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, ema, emas, ewm, ewms, full, in_steps, lag, last_extremes, rma, rows, so_far


def sma(df: DataFrame, n: int, out: str, x: str = "close", partial: bool = False) -> DataFrame:
    """Mean of the last n; with partial from the first bar on."""
    mean = F.avg(x).over(rows(n))
    return df.withColumn(out, mean if partial else full(mean, x, n))


def ema_sma_seed(df: DataFrame, n: int, out: str, x: str = "close") -> DataFrame:
    """Exponential mean that starts with the simple mean of the first n bars, at the n-th."""
    number = F.row_number().over(by_symbol())
    seeded = F.when(number == n, F.avg(x).over(rows(n))).when(number > n, F.col(x))
    return ewm(df.withColumn("__seeded", seeded), F.col("__seeded"), out, 2.0 / (n + 1)).drop("__seeded")


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    before = lag("close")
    return df.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return rma(true_range(df, "__tr"), "__tr", n, out).drop("__tr")


def rsi_wilder(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Gains and losses by Wilder's mean from the second bar on."""
    change = F.col("close") - lag("close")
    df = df.withColumn("__up", F.greatest(change, F.lit(0.0))).withColumn("__down", F.greatest(-change, F.lit(0.0)))
    df = df.withColumn("__up", F.when(change.isNotNull(), F.col("__up"))).withColumn("__down", F.when(change.isNotNull(), F.col("__down")))
    df = ewms(df, (F.col("__up"), "__g", 1.0 / n), (F.col("__down"), "__l", 1.0 / n))
    return df.withColumn(out, 100 - 100 / (1 + F.col("__g") / (F.col("__l") + 1e-10))).drop("__up", "__down", "__g", "__l")


def rsi_simple(df: DataFrame, n: int = 14, out: str = "rsi_simple") -> DataFrame:
    """Gains and losses by simple means; 50 while there are fewer than n changes."""
    return in_steps(df, rsi_simple_steps(n, out)).drop("__up", "__down")


def rsi_simple_steps(n: int = 14, out: str = "rsi_simple") -> list[dict[str, Column]]:
    change = F.col("close") - lag("close")
    ratio = F.avg("__up").over(rows(n)) / (F.avg("__down").over(rows(n)) + 1e-9)
    moves = {"__up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "__down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    return [moves, {out: F.coalesce(full(100 - 100 / (1 + ratio), "__up", n), F.lit(50.0))}]


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewms(df, (F.col("close"), "__fast", 2.0 / (fast + 1)), (F.col("close"), "__slow", 2.0 / (slow + 1))).withColumn("macd", F.col("__fast") - F.col("__slow"))
    df = ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


def directional(df: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di and adx; directional movement is 0 on the first bar."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
    df = true_range(df.withColumn("__p", plus).withColumn("__m", minus), "__tr")
    df = ewms(df, *((F.col(x), out, 1.0 / n) for x, out in (("__tr", "__atr"), ("__p", "__pp"), ("__m", "__mm"))))
    df = df.withColumn("plus_di", F.try_divide(100 * F.col("__pp"), F.col("__atr"))).withColumn("minus_di", F.try_divide(100 * F.col("__mm"), F.col("__atr")))
    dx = F.coalesce(F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0))
    return rma(df.withColumn("__dx", dx), "__dx", n, "adx").drop("__p", "__m", "__tr", "__atr", "__pp", "__mm", "__dx")


def price_means(df: DataFrame, *spans: int, wilder: bool = False) -> DataFrame:
    """macd, macd_signal, macd_hist, plus_di, minus_di, adx and atr, ema{n} for each span, and with wilder rsi: the values of macd,
    directional, atr, emas and rsi_wilder. Their means are two calls of ewms, one of what is known of the bars and one of what comes
    of the first, so all share the windows of their levels."""
    up, down, change = F.col("high") - lag("high"), lag("low") - F.col("low"), F.col("close") - lag("close")
    moves = {"__p": F.when((up > down) & (up > 0), up).otherwise(0.0), "__m": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    if wilder:
        moves |= {"__up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "__down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    df = true_range(df.withColumns(moves), "__tr")
    means = {"__fast": ("close", 2 / 13), "__slow": ("close", 2 / 27), "atr": ("__tr", 1 / 14), "__pp": ("__p", 1 / 14), "__mm": ("__m", 1 / 14), **{f"ema{n}": ("close", 2.0 / (n + 1)) for n in spans}}
    if wilder:
        means |= {"__g": ("__up", 1 / 14), "__l": ("__down", 1 / 14)}
    df = ewms(df, *((F.col(x), out, alpha) for out, (x, alpha) in means.items()))
    found = {"macd": F.col("__fast") - F.col("__slow"), "plus_di": F.try_divide(100 * F.col("__pp"), F.col("atr")), "minus_di": F.try_divide(100 * F.col("__mm"), F.col("atr"))}
    if wilder:
        found["rsi"] = 100 - 100 / (1 + F.col("__g") / (F.col("__l") + 1e-10))
    df = df.withColumns(found).drop("__tr", "__p", "__m", "__up", "__down", "__fast", "__slow", "__pp", "__mm", "__g", "__l")
    dx = F.coalesce(F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0))
    df = ewms(df, (F.col("macd"), "macd_signal", 2 / 10), (dx, "adx", 1 / 14))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def di_width(df: DataFrame) -> DataFrame:
    """di_width and di_trend (Bull, Nil, Bear, Unknown)."""
    p, m = F.col("plus_di"), F.col("minus_di")
    trend = F.when(p > m, "Bull").when(p == m, "Nil").when(p < m, "Bear").otherwise("Unknown")
    return df.withColumn("di_width", F.abs(p - m)).withColumn("di_trend", trend)


def mfi(df: DataFrame, n: int = 14, out: str = "mfi") -> DataFrame:
    """Money flow index; 50 while there are fewer than n price changes."""
    return in_steps(df, mfi_steps(n, out)).drop("__in", "__out", "__enough")


def mfi_steps(n: int = 14, out: str = "mfi") -> list[dict[str, Column]]:
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow, change = price * F.col("volume"), price - lag(price)
    ratio = F.sum("__in").over(rows(n)) / (F.sum("__out").over(rows(n)) + 1e-9)
    flows = {"__in": F.when(change > 0, flow).otherwise(0.0), "__out": F.when(change < 0, flow).otherwise(0.0), "__enough": F.row_number().over(by_symbol()) >= n}
    return [flows, {out: F.when(F.col("__enough"), 100 - 100 / (1 + ratio)).otherwise(50.0)}]


def cmf(df: DataFrame, n: int = 20, out: str = "cmf") -> DataFrame:
    """Chaikin money flow, from the first bar on."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    multiplier = ((c - lo) - (h - c)) / (h - lo + 1e-9)
    df = df.withColumn("__mfv", multiplier * F.col("volume"))
    return df.withColumn(out, F.sum("__mfv").over(rows(n)) / (F.sum("volume").over(rows(n)) + 1e-9)).drop("__mfv")


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    return in_steps(df, obv_steps(out)).drop("__signed")


def obv_steps(out: str = "obv") -> list[dict[str, Column]]:
    signed = F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("volume"), F.lit(0.0))
    return [{"__signed": signed}, {out: F.sum("__signed").over(so_far())}]


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_low, bb_mid and bb_high, by the population deviation."""
    mid, dev = F.avg("close").over(rows(n)), F.stddev_pop("close").over(rows(n))
    return df.withColumn("bb_mid", full(mid, "close", n)).withColumn("bb_low", full(mid - k * dev, "close", n)).withColumn("bb_high", full(mid + k * dev, "close", n))


def bb_shape(df: DataFrame) -> DataFrame:
    """bb_width over the price, bb_width_mid over the middle band, and bb_z, the place within the bands."""
    width = F.col("bb_high") - F.col("bb_low")
    df = df.withColumn("bb_width", F.try_divide(width, F.col("close"))).withColumn("bb_width_mid", F.try_divide(width, F.abs("bb_mid")))
    return df.withColumn("bb_z", F.coalesce(F.try_divide(F.col("close") - F.col("bb_mid"), width / 2), F.lit(0.0)))


def cci(df: DataFrame, n: int = 20, out: str = "cci") -> DataFrame:
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("__mean", F.avg("__tp").over(rows(n))).withColumn("__held", F.collect_list("__tp").over(rows(n)))
    dev = F.aggregate("__held", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__mean"))) / n
    return df.withColumn(out, full(F.try_divide(F.col("__tp") - F.col("__mean"), 0.015 * dev), "__tp", n)).drop("__tp", "__mean", "__held")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    """stoch_k (smoothed) and stoch_d."""
    low, high = F.min("low").over(rows(n)), F.max("high").over(rows(n))
    df = df.withColumn("__k", full(F.try_divide(100 * (F.col("close") - low), high - low), "close", n))
    df = df.withColumn("stoch_k", full(F.avg("__k").over(rows(smooth)), "__k", smooth))
    return df.withColumn("stoch_d", full(F.avg("stoch_k").over(rows(d)), "stoch_k", d)).drop("__k")


def tma(df: DataFrame, n: int, out: str) -> DataFrame:
    """Triangular mean: the simple mean of the simple mean, each over (n + 1) // 2 bars."""
    k = max(1, (n + 1) // 2)
    df = df.withColumn("__s", full(F.avg("close").over(rows(k)), "close", k))
    return df.withColumn(out, full(F.avg("__s").over(rows(k)), "__s", k)).drop("__s")


def linear_slope(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Least-squares slope over the last n bars by their mean; null where one of them is."""
    df = df.withColumn("__i", F.row_number().over(by_symbol()).cast("double"))
    mean = F.avg(x).over(rows(n))
    slope = F.regr_slope(F.col(x), F.col("__i")).over(rows(n)) / F.when(mean == 0, 1.0).otherwise(mean)
    return df.withColumn(out, full(slope, x, n)).drop("__i")


@cache
def t90(n: int) -> float:
    """The 0.90 quantile of Student's t for n - 2 degrees of freedom (two-sided p < 0.2), by Simpson's rule and bisection."""
    nu, low, high = n - 2, 0.0, 10.0
    scale = math.gamma((nu + 1) / 2) / math.gamma(nu / 2) / math.sqrt(nu * math.pi) if nu < 300 else 1 / math.sqrt(2 * math.pi)
    density = lambda x: scale * (1 + x * x / nu) ** (-(nu + 1) / 2)
    for _ in range(60):
        mid = (low + high) / 2
        step = mid / 2000
        inner = sum((4 if i % 2 else 2) * density(i * step) for i in range(1, 2000))
        low, high = (mid, high) if (density(0) + inner + density(mid)) * step / 3 < 0.4 else (low, mid)
    return (low + high) / 2


def significant_slope(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """out: the slope over the last n bars (3 or more); out_ok: whether it differs from 0 at p < 0.2 (a bound on r squared)."""
    t2 = t90(n) ** 2
    df = df.withColumn("__i", F.row_number().over(by_symbol()).cast("double"))
    slope = F.regr_slope(F.col(x), F.col("__i")).over(rows(n))
    r2 = F.regr_r2(F.col(x), F.col("__i")).over(rows(n))
    df = df.withColumn(out, full(slope, x, n)).withColumn(f"{out}_ok", full(F.coalesce(r2 > t2 / (t2 + n - 2), F.lit(False)), x, n))
    return df.drop("__i")


def smoothed_rsi(df: DataFrame, x: str = "rsi", out: str = "rsi_smooth", horizon: int = 40) -> DataFrame:
    """Exponentially weighted mean of span 2 with normalised weights; weights beyond the horizon are below 1e-19."""
    held = F.collect_list(x).over(rows(horizon))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate(held, zero, lambda a, v: F.struct((a["s"] / 3 + v).alias("s"), (a["w"] / 3 + 1).alias("w")))
    return df.withColumn("__sw", total).withColumn(out, F.when(F.col(x).isNotNull(), F.try_divide(F.col("__sw.s"), F.col("__sw.w")))).drop("__sw")


def lagged_features(df: DataFrame, lengths: tuple[int, ...] = (2, 5, 10, 20, 60)) -> DataFrame:
    """Ratio to the mean, mean relative range, volume ratio and return over each length; daily ratios beside them."""
    c, v = F.col("close"), F.col("volume").cast("double")
    df = df.withColumn("ret_1", F.try_divide(c, lag("close")) - 1).withColumn("hl_ratio", F.try_divide(F.col("high"), F.col("low"))).withColumn("co_ratio", F.try_divide(c, F.col("open")))
    span = F.try_divide(F.col("high") - F.col("low"), c)
    for n in lengths:
        df = df.withColumn(f"close_ratio_{n}", full(F.try_divide(c, F.avg(c).over(rows(n))), c, n))
        df = df.withColumn(f"range_{n}", full(F.avg(span).over(rows(n)), c, n))
        df = df.withColumn(f"vol_ratio_{n}", full(F.coalesce(F.try_divide(v, F.avg(v).over(rows(n))), F.lit(1.0)), c, n))
        df = df.withColumn(f"ret_{n}", F.try_divide(c, lag("close", n)) - 1)
    return df


def ema_slopes(df: DataFrame, fast: str = "ema20", slow: str = "ema50", k_slow: int = 30) -> DataFrame:
    """Change of each mean over k bars in units of the true range: 5 bars for the fast one."""
    for name, column, k in (("ema_fast_slope", fast, 5), ("ema_slow_slope", slow, k_slow)):
        df = df.withColumn(name, F.coalesce(F.try_divide(F.col(column) - lag(column, k), F.col("atr") * k), F.lit(0.0)))
    return df


def volume_spike(df: DataFrame, n: int = 20, least: int = 5, out: str = "vol_spike") -> DataFrame:
    v = F.col("volume").cast("double")
    mean = F.when(F.count(v).over(rows(n)) >= least, F.avg(v).over(rows(n)))
    return df.withColumn(out, F.coalesce(F.try_divide(v, mean), F.lit(1.0)))


def candles(df: DataFrame) -> DataFrame:
    """Engulfing, hammer and shooting-star flags (0 or 1)."""
    o, c, o1, c1 = F.col("open"), F.col("close"), lag("open"), lag("close")
    body = F.abs(c - o)
    upper = F.greatest(F.col("high"), o, c) - F.greatest(c, o)
    lower = F.least(c, o) - F.least(F.col("low"), o, c)
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    df = df.withColumn("bull_engulf", flag((c > o) & (c1 < o1) & (c >= o1) & (o <= c1)))
    df = df.withColumn("bear_engulf", flag((c < o) & (c1 > o1) & (c <= o1) & (o >= c1)))
    return df.withColumn("hammer", flag((lower >= 2 * body) & (upper <= 0.5 * body))).withColumn("shooting_star", flag((upper >= 2 * body) & (lower <= 0.5 * body)))


def year_range(df: DataFrame, n: int = 252) -> DataFrame:
    """High and low close of the last n bars, and the price's distance from each in percent."""
    df = in_steps(df, last_extremes(F.col("close"), n, "__year"))
    df = df.withColumns({"high_52w": F.col("__year.hi"), "low_52w": F.col("__year.lo")}).drop("__year")
    df = df.withColumn("pct_to_high", (1 - F.try_divide(F.col("close"), F.col("high_52w"))) * 100)
    return df.withColumn("pct_from_low", (1 - F.try_divide(F.col("low_52w"), F.col("close"))) * 100)


def analytic_ranks(df: DataFrame) -> DataFrame:
    """Numbering, ranks, differences, running sums and the day of the running maximum, within each symbol."""
    w, p = by_symbol(), Window.partitionBy("symbol")
    df = df.withColumn("cumcount", F.row_number().over(w) - 1).withColumn("diff", F.col("close") - lag("close")).withColumn("pct_change", F.try_divide(F.col("close"), lag("close")) - 1)
    df = df.withColumn("cumsum", F.sum("close").over(so_far())).withColumn("rank_min", F.rank().over(p.orderBy(F.desc("close")))).withColumn("rank_first", F.row_number().over(p.orderBy(F.desc("close"), "date")))
    return df.withColumn("idxmax", F.max_by("date", F.struct(F.col("close"), -F.unix_date("date"))).over(so_far()))


def standard_panel(df: DataFrame) -> DataFrame:
    """The indicators that labels, signals and detectors read."""
    df = emas(df, "close", 20, 50, 200)
    df = sma(sma(df, 50, "sma50"), 200, "sma200")
    df = macd(directional(atr(rsi_wilder(df))))
    return year_range(bb_shape(bollinger(di_width(obv(df)))))


