"""Point scores and signals as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds and points of the technical score, weights of the composite and of the swing score.
EMA_DISTANCE = ((2, 25), (5, 20), (10, 15), (15, 10))
RSI_OVERSOLD = ((30, 25), (35, 20), (40, 15), (45, 10), (50, 5))
HIGH_DISTANCE = ((40, 25), (30, 20), (20, 15), (10, 10), (5, 5))
GEM_RANKS = ((500, 25), (1000, 20), (1500, 15), (2000, 10), (3000, 5))
SWING_WEIGHTS = {
    "ml": 0.35, "rules": 0.25, "primary": 0.15, "secondary": 0.10, "cross": 0.12, "rsi_up": 0.10, "adx": 0.05, "reversal_rules": 0.08,
    "reversal_ml": 0.08, "uturn": 0.06, "late": -0.05, "near_high": -0.05, "near_low": 0.05,
}
SECONDARY_BOOST = {"PullbackInBull": 1.0, "TrendingUp": 0.8, "PullbackInBear": -1.0, "TrendingDown": -0.8}
GRADES = {"Weak": 1, "Moderate": 2, "Strong": 3}


def ladder(x: Column, steps: tuple[tuple[int, int], ...], rising: bool, rest: float) -> Column:
    """The points of the first step that x reaches (at most, or with rising at least, its threshold); 0 if x is null."""
    found = F.lit(rest)
    for limit, points in reversed(steps):
        found = F.when(x >= limit if rising else x <= limit, float(points)).otherwise(found)
    return F.when(x.isNull(), 0.0).otherwise(found)


def ema_distance_score(ema20: Column, ema50: Column) -> Column:
    return ladder(F.try_divide(F.abs(ema20 - ema50) * 100, F.nullif(ema50, F.lit(0.0))), EMA_DISTANCE, False, 5.0)


def rsi_score(rsi: Column) -> Column:
    return ladder(rsi, RSI_OVERSOLD, False, 0.0)


def high_distance_score(pct: Column) -> Column:
    return ladder(pct, HIGH_DISTANCE, True, 0.0)


def gem_rank_score(rank: Column) -> Column:
    return ladder(rank, GEM_RANKS, False, 0.0)


def technical_score(ema20: Column, ema50: Column, rsi: Column, pct: Column, rank: Column, missing: str = "reference") -> Column:
    """Sum of the four. With missing="reference" a missing input counts as 0.0, which earns a low RSI or rank full points;
    with missing="zero" it earns none."""
    if missing == "reference":
        ema20, ema50, rsi, pct, rank = (F.coalesce(c, F.lit(0.0)) for c in (ema20, ema50, rsi, pct, rank))
    return ema_distance_score(ema20, ema50) + rsi_score(rsi) + high_distance_score(pct) + gem_rank_score(rank)


def composite_score(pattern: Column, technical: Column) -> Column:
    return F.bround(0.45 * pattern + 0.55 * technical, 2)


def swing_signal(score: Column, pattern: Column) -> Column:
    graded = F.when(score >= 80, "Strong_Buy").when(score >= 65, "Buy").when(score >= 50, "Weak_Buy").otherwise("Neutral")
    return F.when(F.coalesce(pattern, F.lit(False)), graded).otherwise("Neutral")


def rule_signal(sma50: Column, sma200: Column, macd: Column, signal: Column, hist: Column, rsi: Column, close: Column, low: Column, mid: Column, high: Column) -> Column:
    """-4 to 4: direction from the simple means (MACD's sign where they tie), strength from RSI, MACD and the bands."""
    up = F.when(sma50 > sma200, True).when(sma50 < sma200, False).otherwise(macd > 0)
    bull = F.when(rsi < 30, 1).when(rsi < 50, 2).when(rsi < 70, 3).otherwise(4)
    bear = F.when(rsi > 70, 1).when(rsi > 50, 2).when(rsi > 30, 3).otherwise(4)
    agree = F.when(up, macd > signal).otherwise(macd < signal)
    strong = F.when(up, hist > 0).otherwise(hist < 0)
    moment = F.when(agree & strong, 3).when(agree, 2).otherwise(1)
    band_up = F.when(close < low, 1).when(close < mid, 2).when(close < high, 3).otherwise(4)
    band_down = F.when(close > high, 1).when(close > mid, 2).when(close > low, 3).otherwise(4)
    score = F.when(up, bull).otherwise(bear) + moment + F.when(up, band_up).otherwise(band_down)
    strength = F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(score * 4 / F.lit(11.0)).cast("int")))
    return F.when(up, strength).otherwise(-strength)


def reversal_points(label: Column, ml: bool) -> Column:
    """-3 to 3 from a reversal label; anything else is 0."""
    mark = "-ML" if ml else ""
    cases = [F.when(label == f"{side}Reversal{m}{g}", sign * n) for side, sign in (("Bullish", 1), ("Bearish", -1)) for m in {mark, "", "-ML"} for g, n in GRADES.items()]
    return F.coalesce(*cases, F.lit(0))


def uturn_value(label: Column) -> Column:
    size = F.when(label.contains("Strong"), 1.0).when(label.contains("Moderate"), 0.7).when(label.contains("Weak"), 0.4).otherwise(0.0)
    value = F.when(label.startswith("ERR"), 0.0).when(label.contains("BullishReversal"), size).when(label.contains("BearishReversal"), -size)
    return F.coalesce(value, F.lit(0.0))


def swing_points(ml: Column, rules: Column, primary: Column, secondary: Column, cross: Column, rsi_up: Column, adx: Column, rev_rules: Column, rev_ml: Column, uturn: Column, days: Column, to_high: Column, from_low: Column) -> Column:
    """The weighted swing score in points: classifier, trend, cross, RSI, ADX, reversals, a late leg, the year's range."""
    w = SWING_WEIGHTS
    clip = lambda c: F.greatest(F.least(c, F.lit(4.0)), F.lit(-4.0)) / 4
    has_ml, has_rules = F.coalesce(ml != 0, F.lit(False)), F.coalesce(rules != 0, F.lit(False))
    side = F.when(primary == "Bull", 1.0).when(primary == "Bear", -1.0).otherwise(0.0)
    boost = reduce(lambda e, kv: e.when(secondary == kv[0], kv[1]), list(SECONDARY_BOOST.items())[1:], F.when(secondary == "PullbackInBull", 1.0)).when(secondary == "ShortTrend", 0.3 * side).otherwise(0.0)
    up = F.coalesce(rsi_up, F.lit(False))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    total = (
        F.when(has_ml, w["ml"] * clip(ml)).when(has_rules, w["rules"] * clip(rules)).otherwise(0.0)
        + w["primary"] * side + w["secondary"] * boost + w["cross"] * F.signum(z(cross)) + F.when(up, w["rsi_up"]).otherwise(0.0)
        + w["adx"] * F.when(z(adx) >= 25, side).when(z(adx) >= 20, 0.5 * side).otherwise(0.0)
        + w["reversal_rules"] * rev_rules / 3 + w["reversal_ml"] * rev_ml / 3 + w["uturn"] * uturn
        + F.when(F.abs(z(days)) > 8, w["late"] * F.least(F.lit(1.0), (F.abs(z(days)) - 8) / 10)).otherwise(0.0)
        + F.when((z(to_high) <= 2) & (has_ml | has_rules), w["near_high"]).otherwise(0.0)
        + F.when((z(from_low) <= 5) & ((primary == "Bull") | up), w["near_low"]).otherwise(0.0)
    )
    return F.bround(F.round(total * 100, 6), 0).cast("int")


def ema_structure(ema20: Column, ema50: Column, sma200: Column) -> Column:
    return F.when((ema20 > ema50) & (ema50 > sma200), 2).when(ema20 > ema50, 1).when(ema50 > ema20, -1)


def classifier_consensus(rules: Column, ml: Column) -> Column:
    part = lambda c: F.greatest(F.least(F.coalesce(c, F.lit(0)), F.lit(1)), F.lit(0))
    return part(rules) + part(ml)


def ensemble(online: Column, batch: Column, alpha: float) -> Column:
    return F.coalesce(alpha * online + (1 - alpha) * batch, online, batch)
