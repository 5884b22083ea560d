"""Runs, trends and reversals over a panel of bars; every function adds columns that look back only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol, in_steps, lag, last_extremes, rows, so_far
from tidemark.operators import indicators as ind


def past() -> WindowSpec:
    """All bars before the current one."""
    return by_symbol().rowsBetween(Window.unboundedPreceding, -1)


def indexed(df: DataFrame) -> DataFrame:
    """idx: the bar's number within its symbol, from 0."""
    return df.withColumn("idx", F.row_number().over(by_symbol()) - 1)


def _island_run(df: DataFrame, sign: Column, out: str) -> DataFrame:
    """Signed length of the run of equal signs that ends here; rows whose sign is null carry it on. __new and __isl, which
    mark and number the runs, stay. A run's bars are counted as running counts less those at its start, so this is windows of
    one order."""
    df = df.withColumn("__s", sign)
    before = F.last("__s", ignorenulls=True).over(past())
    change = F.when(F.col("__s").isNotNull() & (before.isNull() | (F.col("__s") != before)), 1).otherwise(0)
    df = df.withColumn("__new", change).withColumns({"__isl": F.sum("__new").over(so_far()), "__c": F.count("__s").over(so_far())})
    run = F.last("__s", ignorenulls=True).over(so_far()) * since_new("__c")
    return df.withColumn(out, F.coalesce(run, F.lit(0)).cast("int")).drop("__s", "__c")


def since_new(count: str) -> Column:
    """What a running count has come to in the current run, from the bar on that begins it (__new = 1 there)."""
    return F.col(count) - F.coalesce(F.last(F.when(F.col("__new") == 1, F.col(count) - 1), ignorenulls=True).over(so_far()), F.lit(0))


def _with_prior(df: DataFrame, run: str) -> DataFrame:
    """prior: `run` at the bar that lies as many bars back as the run is long; prior_high and prior_low: the extreme closes
    of that run's last bars, as many as it is long. Needs __new and __isl, which go.

    Where no bar of the run was passed over, that bar is the last before the run, so its values are taken along from the
    run's first bar; else it lies within the run and prior is the run itself. Closes do not turn within a run, so the last bars'
    extremes are the close at its end and the one at their first bar, whose place is known once the run is whole.
    """
    whole_run = Window.partitionBy("symbol", "__isl")
    # Runs are numbered by date, so the order of (__isl, date) is that by date and needs no other sort than whole_run.
    order = Window.partitionBy("symbol").orderBy("__isl", "date")
    df = df.withColumn("__r", F.row_number().over(by_symbol())).withColumn("__n", since_new("__r")).drop("__r")
    passed = F.col("__n") - F.abs(run)
    df = df.withColumn("__passed", passed).withColumn("__all_passed", F.max("__passed").over(whole_run))
    df = df.withColumn("__edge", F.max(F.when(F.col("__n") == F.col("__all_passed") + 1, F.col("close"))).over(whole_run))
    up, some = F.col(run) > 0, F.col(run) != 0
    hi, lo = F.when(some, F.when(up, F.col("close")).otherwise(F.col("__edge"))), F.when(some, F.when(up, F.col("__edge")).otherwise(F.col("close")))
    df = df.withColumn("__e", F.struct(F.col(run).alias("run"), hi.alias("hi"), lo.alias("lo")))
    df = df.withColumn("__before", F.lag("__e").over(order))
    df = df.withColumn("__p", F.last(F.when(F.col("__new") == 1, F.col("__before")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = passed == 0
    df = df.withColumns({"prior": F.when(whole, F.col("__p.run")).otherwise(F.col(run)), "prior_high": F.when(whole, F.col("__p.hi")), "prior_low": F.when(whole, F.col("__p.lo"))})
    return df.drop("__n", "__passed", "__all_passed", "__edge", "__e", "__before", "__p", "__new", "__isl")


def last_run_flat_up(df: DataFrame, out: str = "run_flat_up") -> DataFrame:
    """Flat moves count as up; 0 while the series is constant."""
    return _last_run_flat_up(df, out).drop("__new", "__isl")


def _last_run_flat_up(df: DataFrame, out: str) -> DataFrame:
    change = F.col("close") - lag("close")
    df = _island_run(df, F.when(change.isNotNull(), F.when(change < 0, -1).otherwise(1)), "__r")
    constant = F.max("close").over(so_far()) == F.min("close").over(so_far())
    return df.withColumn(out, F.when(constant, 0).otherwise(F.col("__r"))).drop("__r")


def last_run(df: DataFrame, out: str = "run") -> DataFrame:
    """Flat moves are passed over."""
    return _last_run(df, out).drop("__new", "__isl")


def _last_run(df: DataFrame, out: str) -> DataFrame:
    return _island_run(df, F.nullif(F.signum(F.col("close") - lag("close")).cast("int"), F.lit(0)), out)


def current_and_prior(df: DataFrame, min_prior: int = 4) -> DataFrame:
    """curr_days, curr_type, prior_days, prior_type and run_error; prior_high and prior_low: the extreme closes of the prior
    run's bars. The prior run is the one curr_days rows back."""
    df = _with_prior(_last_run(indexed(df), "run"), "run")
    bad = (F.col("run") == 0) | (F.coalesce("prior", F.lit(0)) == 0) | (F.abs("prior") < min_prior) | (F.signum("prior") == F.signum("run"))
    kind = lambda c: F.when(F.col(c) > 0, "Up").when(F.col(c) < 0, "Down")
    df = df.withColumn("run_error", F.when(F.coalesce(bad, F.lit(True)), "ERR_NO_TREND"))
    ok = F.col("run_error").isNull()
    found = {"curr_days": F.abs("run"), "curr_type": kind("run"), "prior_days": F.abs("prior"), "prior_type": kind("prior"), "prior_high": F.col("prior_high"), "prior_low": F.col("prior_low")}
    return df.withColumns({n: F.when(ok, c) for n, c in found.items()}).drop("prior")


def tolerant_run(df: DataFrame, soft: Column, hard: Column | None, name: str, cap: int) -> DataFrame:
    """{name}_n: good bars of the run that ends here; {name}_stop: the number of the bar it stops at.

    Walking back, one soft bar is passed over; a hard one, the second soft one, the first bar of the symbol or `cap` steps
    end the run. Needs idx; __{name}_soft and __{name}_hard stay for at_stop.
    """
    return in_steps(df, tolerant_steps(soft, hard, name, cap)).drop(*tolerant_helpers(name))


def tolerant_helpers(name: str) -> list[str]:
    return [f"__{name}_{k}" for k in ("before", "last", "hard1", "second")]


def tolerant_steps(soft: Column, hard: Column | None, name: str, cap: int) -> list[dict[str, Column]]:
    i = F.col("idx")
    s, h, before, last, hard1, second = (f"__{name}_{k}" for k in ("soft", "hard", "before", "last", "hard1", "second"))
    marks = {s: F.when((i > 0) & soft, i)} | ({} if hard is None else {h: F.when((i > 0) & hard, i)})
    found = {before: F.coalesce(F.last(s, ignorenulls=True).over(past()), F.lit(0)), last: F.last(s, ignorenulls=True).over(so_far())}
    if hard is not None:
        found[hard1] = F.last(h, ignorenulls=True).over(so_far())
    stops = [F.coalesce(second, F.lit(0)), i - cap, F.lit(0), *([] if hard is None else [F.coalesce(hard1, F.lit(0))])]
    stop = {f"{name}_stop": F.greatest(*stops)}
    passed = F.when(F.col(last) > F.col(f"{name}_stop"), 1).otherwise(0)
    return [marks, found, {second: F.last(F.when(F.col(s).isNotNull(), F.col(before)), ignorenulls=True).over(so_far())}, stop, {f"{name}_n": i - F.col(f"{name}_stop") - passed}]


def at_stop(df: DataFrame, name: str, cap: int, values: dict[str, str]) -> DataFrame:
    """Values (new name: column) of the bar that the tolerant run `name` stops at.

    That bar is the soft bar before the last one (or the first bar, where there is none), the last hard bar, or the bar `cap` back: the
    values of each are carried along the symbol's bars, so all of it is windows of one order, and no bar is looked up by number.
    """
    return in_steps(df, at_stop_steps(name, cap, values, f"__{name}_hard" in df.columns)).drop(*at_stop_helpers(name))


def at_stop_helpers(name: str) -> list[str]:
    return [f"__{name}_{k}" for k in ("v", "vs", "vc", "vh", "v2", "found")]


def at_stop_steps(name: str, cap: int, values: dict[str, str], hard: bool) -> list[dict[str, Column]]:
    v, vs, vc, vh, v2, found = at_stop_helpers(name)
    mark, stop = F.col(f"__{name}_soft").isNotNull() | (F.col("idx") == 0), F.col(f"{name}_stop")
    carried = lambda when, c, window: F.last(F.when(when, c), ignorenulls=True).over(window)
    held = {vs: carried(mark, F.col(v), past()), vc: lag(v, cap)} | ({vh: carried(F.col(f"__{name}_hard").isNotNull(), F.col(v), so_far())} if hard else {})
    chosen = F.when(stop == F.col(f"{v2}.idx"), F.col(v2))
    if hard:
        chosen = chosen.when(stop == F.col(f"{vh}.idx"), F.col(vh))
    picked = {n: F.col(f"{found}.{n}") for n in values}
    return [{v: F.struct("idx", *(F.col(c).alias(n) for n, c in values.items()))}, held, {v2: carried(mark, F.coalesce(vs, v), so_far())}, {found: chosen.otherwise(F.col(vc))}, picked]


def since_stop(df: DataFrame, name: str, cap: int, c: str, low: str, high: str, skip: int = 0) -> DataFrame:
    """low and high: the extremes of c over the bars after the stop of the tolerant run `name`, less the first `skip` of them.

    For runs without hard bars. Soft bars cut a symbol's bars into stretches, each begun by one. The bars after the stop are
    the stretch before the last soft bar, less its first bar, and the one that it begins; extremes run along each stretch, and
    those of a whole stretch are carried on from its last bar. Stretches are numbered by date, so the greatest pair of number and
    value so far has the newest stretch's extreme, without another order. Where `cap` ends the run, the extremes of as many last
    bars are its own (last_extremes).
    """
    df = in_steps(df, last_extremes(F.when(F.col("idx") > skip, F.col(c)), cap - skip, CAPPED))
    return in_steps(df, since_stop_steps(name, c, low, high, skip)).drop(*since_stop_helpers(name), CAPPED)


CAPPED = "__capped"


def since_stop_helpers(name: str) -> list[str]:
    return [f"__{name}_{k}" for k in ("st", "from", "soft0", "s2", "own", "all", "own1", "old")]


def since_stop_steps(name: str, c: str, low: str, high: str, skip: int = 0) -> list[dict[str, Column]]:
    """The steps of since_stop; the fifth reads CAPPED."""
    i, soft, stop = F.col("idx"), F.col(f"__{name}_soft"), F.col(f"{name}_stop")
    st, start, soft0, s2, own, whole, own1, old = since_stop_helpers(name)
    marked = {st: F.count(soft).over(so_far()), start: F.coalesce(F.last(soft, ignorenulls=True).over(so_far()), F.lit(0)), soft0: F.coalesce(F.last(soft, ignorenulls=True).over(past()), F.lit(0))}
    later = i > F.col(start) + skip
    most = lambda x: F.max(F.struct(F.col(st).alias("st"), x.alias("x"))).over(so_far())["x"]
    inside = lambda x: F.struct((-most(-x)).alias("lo"), most(x).alias("hi"))
    begun = F.coalesce(F.last(F.when(soft.isNotNull(), F.col(soft0)), ignorenulls=True).over(so_far()), F.lit(0))
    # The second stretch follows on the first: what is still to be skipped of it depends on where the first began.
    owed = F.greatest(F.lit(0), F.lit(skip + 1) - (F.col(start) - F.col(s2)))
    capped, single = stop > F.col(s2), F.col(st) == 0
    pick = lambda k, f: F.when(capped, F.col(CAPPED)[k]).when(single, F.col(own)[k]).otherwise(f(F.col(old)[k], F.col(whole)[k]))
    return [
        marked, {s2: begun, own: inside(F.when(later, F.col(c)))}, {whole: inside(F.when(i >= F.col(start) + owed, F.col(c))), own1: lag(own)},
        {old: F.last(F.when(soft.isNotNull(), F.col(own1)), ignorenulls=True).over(so_far())}, {low: pick("lo", F.least), high: pick("hi", F.greatest)},
    ]


def flags(*names: str) -> list[str]:
    return [f"__{n}_{k}" for n in names for k in ("soft", "hard")]


CAP = 200  # bars that a run of the reversals goes back at most


def reversal_run_steps() -> list[dict[str, Column]]:
    """up_n, up_stop, down_n and down_stop, with idx before them."""
    change = F.col("__move")
    up, down = F.coalesce(change > 0, F.lit(False)), F.coalesce(change < 0, F.lit(False))
    both = zip(tolerant_steps(~up, None, "up", CAP), tolerant_steps(~down, None, "down", CAP), strict=True)
    return [{"idx": F.row_number().over(by_symbol()) - 1, "__move": F.col("close") - lag("close")}, *({**a, **b} for a, b in both)]


REVERSAL_HELPERS = ["__move", *tolerant_helpers("up"), *tolerant_helpers("down")]


def reversal_runs(df: DataFrame, keep_flags: bool = False) -> DataFrame:
    """up_n, up_stop and down_n, down_stop, one bar of any other direction tolerated; prior_down_* at the start of the up
    run and prior_up_* at the start of the down run. Flags stay for at_stop and since_stop if asked for."""
    df = in_steps(df, reversal_run_steps()).drop(*REVERSAL_HELPERS)
    stops = (("up", {"prior_down_n": "down_n", "prior_down_stop": "down_stop"}), ("down", {"prior_up_n": "up_n", "prior_up_stop": "up_stop"}))
    df = in_steps(df, *(at_stop_steps(name, CAP, values, False) for name, values in stops)).drop(*at_stop_helpers("up"), *at_stop_helpers("down"))
    return df if keep_flags else df.drop(*flags("up", "down"))


def price_pattern(df: DataFrame, n1: int = 3, d2_max: int = 20, min_up: int = 2, min_down: int = 5, look_back: int = 60) -> DataFrame:
    """pattern, d1_recent_up, d2_prior_down, pattern_score: a rise after a longer fall, one flat bar allowed in each."""
    df = indexed(df).withColumn("__chg", F.col("close") - lag("close"))
    c = F.coalesce(F.col("__chg"), F.lit(0.0))
    up, down, flat = c > 1e-9, c < -1e-9, F.abs(c) < 1e-9
    df = tolerant_run(tolerant_run(df, flat, down, "__u", look_back), flat, up, "__d", look_back).drop("__chg")
    df = at_stop(df, "__u", look_back, {"__d2": "__d_n"}).drop(*flags("__u", "__d"))
    d1, d2 = F.col("__u_n"), F.coalesce("__d2", F.lit(0))
    hit = (d1 >= min_up) & (d2 >= min_down) & (d2 > d1)
    score = 0.4 * F.greatest(F.lit(0), 100 - 10 * F.abs(d1 - n1)) + 0.6 * F.least(F.lit(100.0), d2 * 100.0 / d2_max)
    df = df.withColumn("pattern", hit).withColumn("d1_recent_up", F.when(hit, d1).otherwise(0)).withColumn("d2_prior_down", F.when(hit, d2).otherwise(0))
    return df.withColumn("pattern_score", F.when(hit, F.bround(score, 2)).otherwise(0.0)).drop("__u_n", "__u_stop", "__d_n", "__d_stop", "__d2")


def last_trend(df: DataFrame) -> DataFrame:
    """last_trend_days (signed) and last_trend_type: the run up to the bar before, and what the last bar makes of it."""
    df = last_run(df, "__run").withColumn("__before", F.coalesce(lag("__run"), F.lit(0)))
    b, change = F.col("__before"), F.col("close") - lag("close")
    flip = ((change > 0) & (b < 0)) | ((change < 0) & (b > 0))
    kind = F.when(b == 0, "No Trend").when(flip, F.when(change > 0, "Reversal_Up").otherwise("Reversal_Down")).otherwise("Continuation")
    days = F.when((b == 0) | flip, b).otherwise(b + F.signum(b)).cast("int")
    return df.withColumn("last_trend_days", days).withColumn("last_trend_type", kind).drop("__run", "__before")


def ma_trend(df: DataFrame) -> DataFrame:
    """Bull+, Bear+, Bull, Bear or Nil from EMA20 and EMA50 and the last two moves."""
    a, b, a1, b1 = F.col("ema20"), F.col("ema50"), lag("ema20"), lag("ema50")
    c, c1, c2 = F.col("close"), lag("close"), lag("close", 2)
    bull, bear = (a > b) & (a > a1) & (b > b1), (b > a) & (a <= a1) & (b <= b1)
    return df.withColumn("ma_trend", F.when(bull & (c > c1) & (c1 > c2), "Bull+").when(bear & (c < c1) & (c1 < c2), "Bear+").when(bull, "Bull").when(bear, "Bear").otherwise("Nil"))


def strengths(df: DataFrame) -> DataFrame:
    """adx_strength (25, 20) and di_strength (15, 10)."""
    grade = lambda c, hi, mid: F.when(F.col(c) >= hi, "Strong").when(F.col(c) >= mid, "Average").when(F.col(c) < mid, "Weak").otherwise("Unknown")
    return df.withColumn("adx_strength", grade("adx", 25, 20)).withColumn("di_strength", grade("di_width", 15, 10))


def madi_trend(df: DataFrame) -> DataFrame:
    a, b = F.col("ema20"), F.col("ema50")
    return df.withColumn("madi_trend", F.when((a > b) & (F.col("di_trend") == "Bull"), "Bull").when((b > a) & (F.col("di_trend") == "Bear"), "Bear").otherwise("Nil"))


def combined_trend(df: DataFrame) -> DataFrame:
    """StrongBullish to StrongBearish, or NoTrend, from ma_trend and adx."""
    m, strong, weak = F.col("ma_trend"), F.col("adx") >= 25, ~(F.col("adx") >= 20)
    label = (
        F.when(F.col("adx").isNull(), "NoTrend")
        .when(m == "Bull+", F.when(strong, "StrongBullish").otherwise("WeakBullish"))
        .when(m == "Bull", F.when(weak, "WeakBullish").otherwise("ModerateBullish"))
        .when(m == "Bear+", F.when(strong, "StrongBearish").otherwise("WeakBearish"))
        .when(m == "Bear", F.when(weak, "WeakBearish").otherwise("ModerateBearish"))
        .otherwise("NoTrend")
    )
    return df.withColumn("trend_label", label)


def primary_trend(df: DataFrame) -> DataFrame:
    """primary_score and primary (Bull at 1 or more, Bear at -1 or less)."""
    df = ind.linear_slope(df, "ema200", 50, "__slope")
    slope = F.coalesce("__slope", F.lit(0.0))
    di = F.when(F.col("di_trend") == "Bull", 1.0).when(F.col("di_trend") == "Bear", -1.0).otherwise(0.0)
    adx = F.when(F.col("adx") >= 25, 1.0).when(F.col("adx") >= 20, 0.5).otherwise(0.0)
    score = F.when(F.col("ema50") > F.col("ema200"), 1.0).otherwise(-1.0) + di + adx + 0.5 * F.signum(slope) * F.least(F.abs(slope) * 10, F.lit(1.0))
    df = df.withColumn("primary_score", score).drop("__slope")
    return df.withColumn("primary", F.when(F.col("primary_score") >= 1, "Bull").when(F.col("primary_score") <= -1, "Bear").otherwise("Neutral"))


def secondary_trend(df: DataFrame) -> DataFrame:
    """The last rule that holds names the short-term behaviour."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    adx, c, a, b = z("adx"), z("close"), z("ema20"), z("ema50")
    low_adx, narrow, volatile = adx < 20, z("bb_width") < 0.02, F.coalesce(F.try_divide(z("atr"), c) > 0.015, F.lit(False))
    p = F.col("primary")
    rules = [
        ("ShortTrend", (p == "Neutral") & (adx >= 20) & (a != b)), ("PullbackInBear", (p == "Bear") & (c > a) & (c < b)), ("PullbackInBull", (p == "Bull") & (c < a) & (c > b)),
        ("TrendingDown", (adx >= 25) & (a < b)), ("TrendingUp", (adx >= 25) & (a > b)), ("Ranging", low_adx & narrow & ~volatile), ("Volatile", volatile),
    ]
    return df.withColumn("secondary", F.coalesce(*[F.when(cond, name) for name, cond in rules], F.lit("Unknown")))


def majority3(df: DataFrame, c: str, out: str) -> DataFrame:
    """The most frequent of the last three labels, the alphabetically first of equally frequent ones."""
    x, y, z = F.col(c), lag(c), lag(c, 2)
    return df.withColumn(out, F.when(y.isNull() | (x == y) | (x == z), x).when(y == z, y).when(z.isNull(), F.least(x, y)).otherwise(F.least(x, y, z)))


def trend_string(df: DataFrame) -> DataFrame:
    """trend: smoothed primary[secondary]."""
    df = majority3(majority3(df, "primary", "primary_smooth"), "secondary", "secondary_smooth")
    return df.withColumn("trend", F.concat("primary_smooth", F.lit("["), "secondary_smooth", F.lit("]")))


def parse_trend(c: Column) -> Column:
    """(primary, secondary) of a trend string; Neutral and Unknown where it has none."""
    shaped = c.rlike(r"\[.*\]$")
    first, second = F.regexp_extract(c, r"^([^\[]*)\[", 1), F.regexp_extract(c, r"^[^\[]*\[(.*)\]$", 1)
    primary = F.when(shaped, first).otherwise(c)
    fallback = lambda x, d: F.when(F.coalesce(x, F.lit("")) == "", d).otherwise(x)
    return F.struct(fallback(primary, "Neutral").alias("primary"), fallback(F.when(shaped, second), "Unknown").alias("secondary"))


def tma_cross(df: DataFrame, look_back: int = 10) -> DataFrame:
    """tma_x: 1 or -1 for the newest confirmed cross of TMA21 and TMA50 in the last bars, else 0. Needs adx."""
    df = ind.tma(ind.tma(df, 21, "__f"), 50, "__w")
    df = df.withColumn("__diff", F.col("__f") - F.col("__w"))
    d, d1, c = F.col("__diff"), lag("__diff"), F.col("close")
    sf, ss = F.col("__f") - lag("__f"), F.col("__w") - lag("__w")
    bull = (d > 0) & (d1 <= 0) & (sf > 0) & (ss >= 0) & (c >= F.greatest("__f", "__w")) & (F.col("adx") >= 20)
    bear = (d < 0) & (d1 >= 0) & (sf < 0) & (ss <= 0) & (c <= F.least("__f", "__w")) & (F.col("adx") >= 20)
    df = df.withColumn("__hit", F.when(bull, 1).when(bear, -1))
    return df.withColumn("tma_x", F.coalesce(F.last("__hit", ignorenulls=True).over(rows(look_back)), F.lit(0))).drop("__f", "__w", "__diff", "__hit")


def rsi_uptrend(df: DataFrame) -> DataFrame:
    """rsi_up: the smoothed RSI fell significantly over 12 bars to below 35, then rose over 5 through 30. Needs rsi."""
    df = ind.smoothed_rsi(df, out="__rs")
    df = ind.significant_slope(ind.significant_slope(df, "__rs", 12, "__s12"), "__rs", 5, "__s5")
    df = df.withColumn("__step", F.col("__rs") - lag("__rs"))
    rs = F.col("__rs")
    fell = (lag("__s12", 5) < -0.02) & lag("__s12_ok", 5) & (lag("__rs", 5) < 35)
    rose = (F.col("__s5") > 0.02) & F.col("__s5_ok") & (rs - lag("__rs", 4) > 0) & (F.min("__step").over(rows(4)) >= -rs * 0.08) & (rs > 30) & (F.min("__rs").over(rows(5)) <= 30)
    return df.withColumn("rsi_up", F.coalesce(fell & rose, F.lit(False))).drop("__rs", "__s12", "__s12_ok", "__s5", "__s5_ok", "__step")


def weighted_reversal(df: DataFrame, min_history: int = 260) -> DataFrame:
    """reversal_weighted: BullishReversal[Strong] and the like, or an error code."""
    df = current_and_prior(ind.sma(ind.sma(ind.macd(ind.obv(ind.rsi_wilder(ind.atr(df)))), 50, "sma50"), 200, "sma200"))
    up = F.col("curr_type") == "Up"
    turn = lambda yes, no: F.coalesce(F.when(up, yes).otherwise(no), F.lit(False)).cast("int")
    c, a, o, r, m = F.col("close"), F.col("atr"), F.col("obv"), F.col("rsi"), F.col("macd")
    s, t, s1, t1 = F.col("sma50"), F.col("sma200"), lag("sma50"), lag("sma200")
    passed = (
        2 * (F.coalesce(a > 0, F.lit(False)) & F.when(up, c - F.col("prior_low") >= 1.5 * a).otherwise(F.col("prior_high") - c >= 1.5 * a)).cast("int")
        + turn(o > lag("obv"), o < lag("obv"))
        + 2 * turn((lag("rsi") < 30) & (r > lag("rsi")), (lag("rsi") > 70) & (r < lag("rsi")))
        + 3 * turn((lag("macd") < 0) & (m > 0), (lag("macd") > 0) & (m < 0))
        + 4 * turn((s1 < t1) & (s > t), (s1 > t1) & (s < t))
    )
    score = F.round(0.7 * passed / 12 + 0.3 * F.col("prior_days") / (F.col("prior_days") + F.col("curr_days")), 9)
    grade = F.when(score >= 0.5, "Strong").when(score >= 0.4, "Moderate").otherwise("Weak")
    label = F.concat(F.when(up, "BullishReversal[").otherwise("BearishReversal["), grade, F.lit("]"))
    return df.withColumn("reversal_weighted", F.when(F.col("idx") + 1 < min_history, "ERR_INSUFF_DATA").when(F.col("run_error").isNotNull(), F.col("run_error")).otherwise(label))


def ten_test_reversal(df: DataFrame, min_history: int = 260) -> DataFrame:
    """reversal_tests: a code like U2-D6:BULL-REVERSAL-MOD_7/10, or an error code. Flat moves count as up in its runs."""
    df = ind.stochastic(ind.bollinger(ind.obv(ind.directional(ind.macd(ind.rsi_wilder(ind.cci(ind.atr(df))))))))
    df = _with_prior(_last_run_flat_up(indexed(ind.sma(ind.sma(ind.year_range(df), 50, "sma50"), 200, "sma200")), "run"), "run")
    df = df.withColumn("__cross", F.when((F.col("sma50") > F.col("sma200")) & (lag("sma50") < lag("sma200")), 1).when((F.col("sma50") < F.col("sma200")) & (lag("sma50") > lag("sma200")), -1))
    df = df.withColumn("__up3", F.max((F.col("__cross") == 1).cast("int")).over(rows(3))).withColumn("__dn3", F.max((F.col("__cross") == -1).cast("int")).over(rows(3)))
    cd, pd, bull = F.abs("run"), F.abs("prior"), F.col("run") > 0
    error = (
        F.when(F.col("idx") + 1 < min_history, "ERR_INSUFF_DATA").when(F.col("run") == 0, "ERR_NO_TREND").when(F.coalesce("prior", F.lit(0)) == 0, "ERR_NO_PRIOR_TREND")
        .when(pd < 4, "ERR_PRIOR_DAYS").when(cd >= pd, "ERR_CURR_GT_PRIOR").when(F.signum("run") == F.signum("prior"), "ERR_SAME_TRENDS")
    )
    df = df.withColumn("run_error", error).withColumn("curr_days", cd).withColumn("prior_days", pd)
    test = lambda yes, no: F.coalesce(F.when(bull, yes).otherwise(no), F.lit(False)).cast("int")
    c, k, d = F.col("close"), F.col("stoch_k"), F.col("stoch_d")
    x = lambda n: (F.col(n), lag(n))
    (cci, cci1), (r, r1), (h, h1), (o, o1), (adx, adx1) = x("cci"), x("rsi"), x("macd_hist"), x("obv"), x("adx")
    n = (
        test(c >= F.col("low_52w"), c <= F.col("high_52w")) + test(c - F.col("prior_low") >= 1.5 * F.col("atr"), F.col("prior_high") - c >= 1.5 * F.col("atr")) + test(o > o1, o < o1)
        + test(c > F.col("bb_low"), c < F.col("bb_high")) + test((k > d) & (k < 20) & (d < 20), (k < d) & (k > 80) & (d > 80)) + test((cci1 < -100) & (cci > -100), (cci1 > 100) & (cci < 100))
        + test((r1 < 30) & (r > r1), (r1 > 70) & (r < r1)) + test((h1 < 0) & (h > 0), (h1 > 0) & (h < 0)) + test(F.col("__up3") == 1, F.col("__dn3") == 1) + test(adx1 > adx, adx1 > adx)
    )
    level = F.when(n >= 9, "STRONG").when(n >= 7, "MOD").otherwise("WEAK")
    sides = F.when(bull, F.concat(F.lit("U"), cd.cast("string"), F.lit("-D"), pd.cast("string"), F.lit(":BULL"))).otherwise(F.concat(F.lit("D"), cd.cast("string"), F.lit("-U"), pd.cast("string"), F.lit(":BEAR")))
    label = F.concat(sides, F.lit("-REVERSAL-"), level, F.lit("_"), n.cast("string"), F.lit("/10"))
    return df.withColumn("reversal_tests", F.coalesce("run_error", label)).drop("__cross", "__up3", "__dn3")


def counters(df: DataFrame) -> DataFrame:
    """consec_down and consec_up at every bar, at most 50, and the ratio of the last 4 bars' volume to the last 11's."""
    change = F.col("close") - lag("close")
    sign = F.when(change > 0, 1).when(change < 0, -1).otherwise(0)
    df = df.withColumn("__sg", sign)
    df = df.withColumn("__new", F.when(F.col("__sg").eqNullSafe(lag("__sg")), 0).otherwise(1)).withColumn("__r", F.row_number().over(by_symbol())).withColumn("__len", since_new("__r"))
    df = df.withColumn("consec_down", F.when(F.col("__sg") == -1, F.least("__len", F.lit(50))).otherwise(0)).withColumn("consec_up", F.when(F.col("__sg") == 1, F.least("__len", F.lit(50))).otherwise(0))
    v = F.col("volume").cast("double")
    return df.withColumn("vol_ratio_4_11", (F.avg(v).over(rows(4)) + 1e-9) / (F.avg(v).over(rows(11)) + 1e-9)).drop("__sg", "__new", "__r", "__len")
