"""Scored reversals: the pattern and confirmation scores of tolerant runs, and RSI reversals in prolonged trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, in_steps, lag, rows, so_far
from tidemark.operators import indicators as ind
from tidemark.operators import trends as tr

EPS = 1e-9
SLOPE_BARS = 10
LEAST_PRIOR = 5  # bars of a prior run that a candidate needs

SIDES = {"bull": ("up", "down"), "bear": ("down", "up")}  # the latest run and the one before it


def detector_panel(df: DataFrame) -> DataFrame:
    """Bars with the detector's indicators, their runs, and for each side what the candidate at a bar reads of earlier bars.

    A candidate's latest run stops at p1, the last bar of the run before it, which in turn stops at the bar before p0. Each
    value at p1, p0 and the bars next to them is carried along the symbol's bars with the runs (at_stop), the second kind
    within the first, so all of it is windows of one order: no bar is looked up by number. What depends on p1 and p0 alone is
    computed at p1, and both sides take their steps together.
    """
    df = ind.price_means(df, 8)
    df = in_steps(df, ind.rsi_simple_steps(out="rsi"), ind.mfi_steps(), ind.obv_steps(), tr.reversal_run_steps())
    df = df.drop("__up", "__down", "__in", "__out", "__enough", "__signed", *tr.REVERSAL_HELPERS)
    i, c, v = F.col("idx").cast("double"), F.col("close"), F.col("volume").cast("double")
    sums = {"s_c": F.sum(c), "s_ic": F.sum(i * c), "s_v": F.sum(v), "s_above": F.sum((F.col("macd") > F.col("macd_signal")).cast("int"))}
    now = {k: x.over(so_far()) for k, x in sums.items()} | {"hist_step": F.col("macd_hist") - lag("macd_hist"), "vol20": F.avg(v).over(rows(20)), "ema8_3": lag("ema8", 3)}
    df = df.withColumns(now | {"__obv1": F.lead("obv").over(by_symbol()), "__adx1": F.lead("adx").over(by_symbol())})
    older = {"v_before": "s_v", "obv_p0": "__obv1", "adx_p0": "__adx1", "pre_price": "close"}
    each = [(side, *names) for side, names in SIDES.items()]
    lagged = {f"__s{n}": lag(F.struct("s_c", "s_ic"), n) for n in range(LEAST_PRIOR, SLOPE_BARS + 1)}
    first = [tr.at_stop_steps(before, tr.CAP, {f"__{side}_{k}": x for k, x in older.items()}, False) for side, _, before in each]
    df = in_steps(df, [{}, lagged], *first).drop(*(x for _, _, before in each for x in tr.at_stop_helpers(before)))
    # What a prior run that ends at this bar hands to the runs that stop here.
    for side, _, before in each:
        n, stop, at = F.col(f"{before}_n"), F.col(f"{before}_stop"), lambda x, side=side: F.col(f"__{side}_{x}")
        sum_before = F.coalesce(*(F.when(F.least(n, F.lit(SLOPE_BARS)) == k, F.col(f"__s{k}")) for k in range(LEAST_PRIOR, SLOPE_BARS + 1)))
        w0 = F.greatest(F.col("idx") - F.least(F.lit(SLOPE_BARS), n) + 1, F.lit(0))
        less = lambda x, s=sum_before: F.col(x) - F.coalesce(s[x], F.lit(0.0))
        df = df.withColumns({
            f"__{side}_slope": _slope(F.col("idx") - w0 + 1, w0, less("s_c"), less("s_ic")), f"__{side}_move": (F.col("close") - at("pre_price")) / (at("pre_price") + EPS),
            f"__{side}_volume": F.try_divide(F.col("s_v") - at("v_before"), F.col("idx") - stop),
        })
    df = df.drop(*lagged, *(f"__{side}_{k}" for side in SIDES for k in ("v_before", "pre_price")))
    newer = {"end_price": "close", "end_c": "s_c", "end_ic": "s_ic", "v_p1": "s_v", "above_p1": "s_above", "obv_l0": "__obv1"}
    plans, helpers = [tr.last_extremes(F.when(F.col("idx") > 1, F.col("hist_step")), tr.CAP - 1, tr.CAPPED)], [tr.CAPPED, "__obv1", "__adx1", *tr.flags("up", "down")]
    for side, now, before in each:
        held = {f"{side}_{k}": x for k, x in newer.items()} | {f"{side}_{k}": f"__{side}_{k}" for k in ("slope", "move", "volume", "obv_p0", "adx_p0")}
        held |= {f"prior_{before}_n": f"{before}_n", f"prior_{before}_stop": f"{before}_stop"}
        plans += [tr.at_stop_steps(now, tr.CAP, held, False), tr.since_stop_steps(now, "hist_step", f"{side}_step_lo", f"{side}_step_hi", skip=1)]
        helpers += [*tr.at_stop_helpers(now), *tr.since_stop_helpers(now), *(x for x in held.values() if x.startswith(f"__{side}"))]
    return in_steps(df, *plans).drop(*helpers)


def is_candidate(side: str) -> Column:
    """A prior run of at least LEAST_PRIOR bars against a shorter latest one."""
    now, before = ("up", "prior_down") if side == "bull" else ("down", "prior_up")
    return (F.col(f"{before}_n") >= LEAST_PRIOR) & (F.col(f"{now}_n") >= 1) & (F.col(f"{before}_n") > F.col(f"{now}_n")) & (F.col("idx") >= 29)


def _slope(n: Column, first: Column, s: Column, si: Column) -> Column:
    """Least-squares slope of n values at first, first + 1, ..., from their sum and their sum weighted by number."""
    mean = first + (n - 1) / 2
    return F.coalesce(F.try_divide(si - mean * s, n * (n * n - 1) / 12.0), F.lit(0.0))


def _bounds(side: str) -> dict[str, Column]:
    """prior_len, latest_len, and l0 (first bar of the latest run)."""
    now, before = ("up", "prior_down") if side == "bull" else ("down", "prior_up")
    return {"prior_len": F.col(f"{before}_n"), "latest_len": F.col(f"{now}_n"), "l0": F.col(f"{now}_stop") + 1}


def _unit(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def pattern_scores(df: DataFrame, min_move: float = 0.03) -> DataFrame:
    """Adds {side}_pattern: 0.45 time, 0.35 magnitude, 0.20 acceleration; 0 below the least prior move; null where there is no
    candidate. Needs detector_panel."""
    for side in SIDES:
        v, b = (lambda x, side=side: F.col(f"{side}_{x}")), _bounds(side)
        latest_move = (F.col("close") - v("end_price")) / (v("end_price") + EPS)
        sign = -1 if side == "bull" else 1
        latest_slope = _slope(F.col("idx") - b["l0"] + 1, b["l0"], F.col("s_c") - v("end_c"), F.col("s_ic") - v("end_ic"))
        df = df.withColumns({"__prior": sign * v("move"), "__latest": -sign * latest_move, "__s1": v("slope"), "__s2": latest_slope})
        prior, latest = F.col("__prior"), F.col("__latest")
        time = (b["prior_len"] - b["latest_len"]) / (b["prior_len"] + EPS)
        magnitude = 1 - _unit(latest / (latest + prior + EPS))
        change = (F.col("__s2") - F.col("__s1")) * -sign
        accel = _unit((F.tanh(change / (F.abs("__s1") + EPS)) + 1) / 2)
        score = F.when(is_candidate(side), F.when(prior < min_move, 0.0).otherwise(_unit(0.45 * time + 0.35 * magnitude + 0.20 * accel)))
        df = df.withColumn(f"{side}_pattern", score).drop("__prior", "__latest", "__s1", "__s2")
    return df


def confirm_score(side: str, market: Column | None = None, max_atr: float = 0.12) -> Column:
    """The confirmation of a candidate; the momentum, mean and volume tests are the same for either side. market is the
    factor of the market's regime, 1 if not given. Needs detector_panel."""
    v, b = (lambda x: F.col(f"{side}_{x}")), _bounds(side)
    least0 = lambda x: F.greatest(F.lit(0.0), x)
    rsi, px = F.col("rsi"), F.col("close")
    bull = side == "bull"
    rsi_ok = F.when(rsi <= 35, 1.0).otherwise(least0((42.0 - rsi) / (42.0 + EPS))) if bull else F.when(rsi >= 65, 1.0).otherwise(least0((rsi - 52.0) / (48.0 + EPS)))
    last_step = F.when(F.col("idx") > b["l0"], F.col("hist_step")).otherwise(0.0)
    lo, hi = F.least(F.coalesce(v("step_lo"), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(v("step_hi"), F.lit(0.0)), F.lit(0.0))
    macd_ok = F.when(F.col("s_above") - v("above_p1") > 0, 1.0).otherwise(_unit((last_step - lo) / (F.abs(hi) + EPS)))
    v_latest = (F.col("s_v") - v("v_p1")) / (F.col("idx") - b["l0"] + 1)
    ratio = _unit(((v_latest + EPS) / (v("volume") + EPS) - 0.75) / 2.25)
    obv_ok = F.when(F.col("obv") > v("obv_l0"), 1.0).otherwise(least0((F.col("obv") - v("obv_p0")) / (F.abs(v("obv_p0")) + EPS)))
    e = F.col("ema8")
    ema_ok = F.when((px > e) & (e > F.col("ema8_3")), 1.0).otherwise(least0((px - e) / (e + EPS)))
    adx, adx0 = F.col("adx"), v("adx_p0")
    adx_ok = F.when(adx < adx0, _unit((adx0 - adx) / (adx0 + EPS))).when(adx < 25, 1.0).otherwise(least0((40 - adx) / 15))
    mfi = F.col("mfi")
    mfi_ok = F.when(mfi <= 40, 1.0).otherwise(least0((45 - mfi) / 15)) if bull else F.when(mfi >= 60, 1.0).otherwise(least0((mfi - 55) / 15))
    atr_pct = F.col("atr") / (px + EPS)
    atr_ok = F.when(atr_pct <= max_atr, 1.0).otherwise(least0((max_atr * 1.5 - atr_pct) / (max_atr * 1.5)))
    regime = F.lit(1.0) if market is None else F.coalesce(market, F.lit(1.0))
    total = 0.20 * rsi_ok + 0.20 * macd_ok + 0.18 * (0.6 * ratio + 0.4 * obv_ok) + 0.12 * ema_ok + 0.08 * adx_ok + 0.07 * mfi_ok + 0.05 * atr_ok + 0.05 * regime + 0.03
    return F.when(is_candidate(side), _unit(total))


def scored(panel: DataFrame, market: Column | None = None) -> DataFrame:
    """Adds {side}_pattern and {side}_confirm to detector_panel's bars."""
    return pattern_scores(panel).withColumns({f"{side}_confirm": confirm_score(side, market) for side in SIDES})


def side_scores(panel: DataFrame, market: Column | None = None) -> DataFrame:
    """(symbol, date, side, pattern_score, confirm_score): a row for each candidate of each side."""
    each = [F.struct(F.lit(side).alias("side"), F.col(f"{side}_pattern").alias("pattern_score"), F.col(f"{side}_confirm").alias("confirm_score")) for side in SIDES]
    return scored(panel, market).select("symbol", "date", F.inline(F.array(*each))).filter("pattern_score is not null")


def reversal_labels(panel: DataFrame, market: Column | None = None, meta: Column | None = None) -> DataFrame:
    """(symbol, date, bull_score, bear_score, direction, strength, reversal) for every bar: the larger product of pattern
    and confirmation, bull on ties; NoReversal below 0.20. meta is a multiplier of the meta model's for that product (1 where it
    is null), which then stays within 0 and 1."""
    product = {f"{side}_score": F.when(F.col(f"{side}_pattern") > 0, F.col(f"{side}_pattern") * F.col(f"{side}_confirm")) for side in SIDES}
    # As the fields of a one-row generator the scores are computed once; else each use and filter below would repeat them.
    product["meta"] = F.lit(1.0) if meta is None else F.coalesce(meta, F.lit(1.0))
    out = scored(panel, market).select("symbol", "date", "close", "atr", "vol20", F.inline(F.array(F.struct(*(x.alias(k) for k, x in product.items())))))
    b, r = F.coalesce("bull_score", F.lit(0.0)), F.coalesce("bear_score", F.lit(0.0))
    best = F.greatest(b, r) if meta is None else _unit(F.greatest(b, r) * F.col("meta"))
    strength = F.when(best >= 0.70, "Strong").when(best >= 0.45, "Moderate").when(best >= 0.20, "Weak")
    out = out.withColumn("direction", F.when(best > 0, F.when(b >= r, "Bullish").otherwise("Bearish"))).withColumn("strength", strength)
    return out.withColumn("reversal", F.when(strength.isNull(), "NoReversal").otherwise(F.concat("direction", F.lit("Reversal"), "strength"))).drop("meta")


def trade_plan(df: DataFrame, equity: float = 100_000.0, risk: float = 0.01, least_volume: float | None = None) -> DataFrame:
    """stop_price, target_price and position_size of labelled reversals; with least_volume at most 1 % of the mean volume."""
    hit, bull = F.col("strength").isNotNull(), F.col("direction") == "Bullish"
    mult = F.when(F.col("strength") == "Strong", 1.0).when(F.col("strength") == "Moderate", 1.5).otherwise(2.0)
    reward = F.when(F.col("strength") == "Strong", 2.0).when(F.col("strength") == "Moderate", 1.8).otherwise(1.5)
    px, sign = F.col("close"), F.when(bull, 1.0).otherwise(-1.0)
    away = F.when(F.col("atr") > 0, mult * F.col("atr")).otherwise(px * 0.03)
    size = F.when(away > 0, F.floor(equity * risk / (away + EPS))).otherwise(0)
    if least_volume is not None:
        size = F.when(F.col("vol20") > 0, F.least(size, F.floor(F.col("vol20") * 0.01))).otherwise(size)
    df = df.withColumn("stop_price", F.when(hit, px - sign * away)).withColumn("target_price", F.when(hit, px + sign * reward * away))
    return df.withColumn("position_size", F.when(hit, size))


def market_factor(df: DataFrame, index: DataFrame, side: str) -> DataFrame:
    """Adds market_factor: 1, or a ramp by the RSI of an index series (date, close) on the same day."""
    one = index.withColumn("symbol", F.lit("index"))
    r = ind.rsi_simple(one, out="market_rsi").select("date", "market_rsi")
    m = F.col("market_rsi")
    factor = F.when(m > 40, 1.0).otherwise(F.greatest(F.lit(0.0), (m - 30) / 10)) if side == "bull" else F.when(m < 60, 1.0).otherwise(F.greatest(F.lit(0.0), (70 - m) / 10))
    return df.join(F.broadcast(r), "date", "left").withColumn("market_factor", factor)  # a row a day


def ml_panel(df: DataFrame) -> DataFrame:
    """The columns that the RSI-extreme detector reads; look-backs of 30 bars for the slow mean."""
    df = ind.price_means(df, 20, 50, wilder=True)
    df = ind.mfi(ind.candles(ind.ema_slopes(ind.volume_spike(ind.bollinger(tr.indexed(df))))))
    return ind.bb_shape(df)


def rsi_extreme_candidates(df: DataFrame, look_back: int = 30, warmup: int = 52) -> DataFrame:
    """side: 1 or -1 where RSI turns at an extreme after a prolonged trend the other way, else 0. Needs ml_panel."""
    before = by_symbol().rowsBetween(-look_back, -1)
    above, below = F.col("close") > F.col("ema50"), F.col("close") < F.col("ema50")
    three = by_symbol().rowsBetween(-3, -1)
    # Few bars come to a median, so the values are held as short lists and ordered only there.
    lists = {f"__{c}": F.collect_list(c).over(before) for c in ("adx", "plus_di", "minus_di")}
    counts = {"__ra": F.avg("__a").over(before), "__rb": F.avg("__b").over(before), "__a3": F.sum("__a").over(three), "__b3": F.sum("__b").over(three), "__rsi1": lag("rsi")}
    df = df.withColumns({"__a": above.cast("int"), "__b": below.cast("int")}).withColumns(lists | counts)
    ready = (F.col("idx") >= warmup) & (F.least(F.col("idx"), F.lit(look_back)) >= 12)
    up = (F.col("__ra") >= 0.5) & (F.col("ema_slow_slope") >= 0.005) & (F.col("__a3") == 3)
    down = (F.col("__rb") >= 0.5) & (F.col("ema_slow_slope") <= -0.005) & (F.col("__b3") == 3)
    bear = (F.col("__rsi1") > 70) & (F.col("rsi") < F.col("__rsi1"))
    bull = (F.col("__rsi1") < 30) & (F.col("rsi") > F.col("__rsi1"))
    adx, plus, minus = (_median(F.col(c)) for c in lists)
    trend = lambda greater, less, side: F.when((adx >= 15) & (greater > less), side).otherwise(0)
    side = F.when(ready & bull & down, trend(minus, plus, 1)).when(ready & bear & up, trend(plus, minus, -1)).otherwise(0)
    return df.withColumn("side", side).drop("__a", "__b", *lists, *counts)


def _median(values: Column) -> Column:
    """The middle value of an array, or the mean of the middle two."""
    ordered, n = F.sort_array(values), F.size(values)
    return 0.5 * F.get(ordered, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(ordered, F.floor(n / 2).cast("int"))


def rule_score(df: DataFrame) -> DataFrame:
    """rule_score and ml_label of candidates. Needs rsi_extreme_candidates."""
    bull, bear = F.col("side") == 1, F.col("side") == -1
    pick = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 0.65).otherwise(0.45)
    clip = lambda x, m: F.greatest(F.least(x, F.lit(m)), F.lit(-m))
    slope, hist, close1 = F.col("ema_fast_slope"), F.col("macd_hist"), lag("close")
    score = (
        0.2 * (F.tanh((F.col("adx") - 15) / 10) * 0.25 + 0.25) + 0.2 * (clip(slope, 1.5) / 3 + 0.5) + 0.2 * (clip(hist, 2.0) / 4 + 0.5)
        + 0.15 * pick((bear & (close1 >= lag("bb_high"))) | (bull & (close1 <= lag("bb_low")))) + 0.15 * F.least(F.col("vol_spike") / 3, F.lit(1.0))
        + 0.1 * pick((bull & ((F.col("bull_engulf") == 1) | (F.col("hammer") == 1))) | (bear & ((F.col("bear_engulf") == 1) | (F.col("shooting_star") == 1))))
        + 0.1 * pick((bull & (slope > 0) & (hist > 0)) | (bear & (slope < 0) & (hist < 0))) + F.when((bear & (F.col("mfi") > 70)) | (bull & (F.col("mfi") < 30)), 0.05).otherwise(0.0)
    )
    df = df.withColumn("rule_score", F.when(F.col("side") != 0, F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))))
    grade = F.when(F.col("rule_score") >= 0.70, "MLStrong").when(F.col("rule_score") >= 0.55, "MLModerate").otherwise("MLWeak")
    return df.withColumn("ml_label", F.when(bull, F.concat(F.lit("BullishReversal-"), grade)).when(bear, F.concat(F.lit("BearishReversal-"), grade)).otherwise("NoReversal"))


def divergence(df: DataFrame, win: int = 30) -> DataFrame:
    """bear_div and bull_div: a new price extreme of the last `win` bars against the `win` before them that the RSI at it
    does not confirm. Needs idx and rsi."""
    prev, curr = by_symbol().rowsBetween(-2 * win, -win - 1), by_symbol().rowsBetween(-win, -1)
    ready = F.col("idx") >= 2 * win
    at = F.struct(F.col("close").alias("c"), F.coalesce("rsi", F.lit(50.0)).alias("r"))
    first_max, first_min = F.struct(F.col("close"), -F.col("idx")), F.struct(F.col("close"), F.col("idx"))
    df = df.withColumn("__hp", F.max_by(at, first_max).over(prev)).withColumn("__hc", F.max_by(at, first_max).over(curr))
    df = df.withColumn("__lp", F.min_by(at, first_min).over(prev)).withColumn("__lc", F.min_by(at, first_min).over(curr))
    bear = ready & (F.col("__hc.c") > F.col("__hp.c")) & (F.col("__hc.r") < F.col("__hp.r"))
    bull = ready & (F.col("__lc.c") < F.col("__lp.c")) & (F.col("__lc.r") > F.col("__lp.r"))
    return df.withColumn("bear_div", F.coalesce(bear, F.lit(False))).withColumn("bull_div", F.coalesce(bull, F.lit(False))).drop("__hp", "__hc", "__lp", "__lc")
