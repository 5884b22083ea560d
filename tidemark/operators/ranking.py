"""Fundamental ranking: latest reports, completeness, ratios, percentiles, buckets and ranks by country.

Ranks over a whole country are windows partitioned by CountryName, over rows of a symbol and a few numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import monitor as mo

#: The fields a quarter must have to count as full, the weights of the score, floors.
REQUIRED = ("ebit", "totalAssets", "totalCurrentAssets", "totalCashFromOperatingActivities", "netIncome", "EnterpriseValueRevenue", "RevenueTTM", "MarketCapitalization")
WEIGHTS = {"roic": 0.4, "yield": 0.5, "quality": 0.1}
MCAP_FLOOR, EV_FLOOR = 1_000_000.0, 1_000_000.0


def newest_first():
    return Window.partitionBy("symbol").orderBy(F.desc("report_date"))


def latest_per_symbol(df: DataFrame) -> DataFrame:
    """The newest report of each symbol; a map-side maximum, no sort."""
    others = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*others), "report_date").alias("r")).select("symbol", "r.*")


def last_scan(df: DataFrame, when: str = "scanDate") -> DataFrame:
    return df.groupBy(F.trim("symbol").alias("symbol")).agg(F.max(when).alias("last_scan"))


def having_bars(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("n_bars")).filter(F.col("n_bars") >= n)


def present(fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields])


def completeness(df: DataFrame, fields: tuple[str, ...] = REQUIRED, quarters: int = 4) -> DataFrame:
    """(symbol, completeness): the mean share of fields that the newest quarters have."""
    recent = df.withColumn("back", F.row_number().over(newest_first())).filter(F.col("back") <= quarters)
    return recent.groupBy("symbol").agg(F.avg(present(fields) / len(fields)).alias("completeness"))


def data_tier(df: DataFrame, fields: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(symbol, tier): 1 with four or more full quarters, 2 with two or three, 3 with one, 4 with none."""
    return df.groupBy("symbol").agg(_tier(F.count_if(present(fields) == len(fields))).alias("tier"))


def _tier(full: Column) -> Column:
    return F.when(full >= 4, 1).when(full >= 2, 2).when(full == 1, 3).otherwise(4)


def newest_with_quality(df: DataFrame, fields: tuple[str, ...] = REQUIRED, quarters: int = 4) -> DataFrame:
    """The newest report of each symbol with its completeness and tier: what latest_per_symbol, completeness and data_tier
    give, in one pass over the reports."""
    others = [c for c in df.columns if c != "symbol"]
    share = F.when(F.col("__back") <= quarters, present(fields) / len(fields))
    found = df.withColumn("__back", F.row_number().over(newest_first())).groupBy("symbol")
    found = found.agg(F.max_by(F.struct(*others), "report_date").alias("r"), F.avg(share).alias("completeness"), _tier(F.count_if(present(fields) == len(fields))).alias("tier"))
    return found.select("symbol", "r.*", "completeness", "tier")


def percentile_rank(value: Column, part: list, nulls: str = "bottom") -> Column:
    """Rank over count, ties by their mean rank. bottom: nulls rank lowest last, sharing one mean, and count; keep: nulls have
    no rank and do not count."""
    # pandas puts missing values after all others in ascending order
    order = Window.partitionBy(*part).orderBy(F.asc_nulls_last(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, value))
    n = F.count(F.lit(1) if nulls == "bottom" else value).over(Window.partitionBy(*part))
    rank = (F.rank().over(order) + (ties - 1) / 2) / n
    return rank if nulls == "bottom" else F.when(value.isNotNull(), rank)


def min_percentile_rank(value: Column, part: list) -> Column:
    order = Window.partitionBy(*part).orderBy(F.asc_nulls_last(value))
    return F.rank().over(order) / F.count(F.lit(1)).over(Window.partitionBy(*part))


def ratios(df: DataFrame, mcap_floor: float = MCAP_FLOOR, ev_floor: float = EV_FLOOR, adtv_min: float = 0.0) -> DataFrame:
    """Adds mcap, mcap_mln, adtv, net_debt, enterprise_value, roic, earnings_yield and earnings_quality."""
    clip = lambda c, m: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(m)), F.lit(-m)))  # noqa: E731  greatest and least pass nulls over
    ok = F.col("MarketCapitalization") > 0
    df = df.withColumn("mcap", F.when(ok, F.col("MarketCapitalization")).otherwise(F.coalesce(F.col("sharesOutstanding") * F.col("last_close"), "MarketCapitalization")))
    df = df.withColumn("mcap_mln", F.col("mcap") / 1e6).withColumn("adtv", F.col("avgVolume") * F.col("last_close")).withColumn("net_debt", F.col("totalDebt") - F.col("cashAndCashEquivalents"))
    ev = F.coalesce("ev", F.col("mcap") + F.col("net_debt"), F.col("EnterpriseValueRevenue") * F.col("RevenueTTM"))
    df = df.withColumn("enterprise_value", ev)
    df = df.withColumn("roic", clip(F.coalesce("roicTTM", F.try_divide("ebit", F.col("totalAssets") - F.col("totalCurrentAssets"))), 10.0))
    investable = F.abs("mcap") >= mcap_floor
    if adtv_min > 0:
        investable = investable & (F.abs("adtv") >= adtv_min)
    cash = F.coalesce("netOperatingCashFlow", "totalCashFromOperatingActivities")
    df = df.withColumn("earnings_quality", clip(F.when(investable, F.try_divide(cash - F.col("netIncome"), F.col("mcap"))), 100.0))
    profit = F.coalesce("ebitda", "ebit")
    return df.withColumn("earnings_yield", clip(F.when(F.abs("enterprise_value") >= ev_floor, profit / F.col("enterprise_value")), 100.0))


def gem_score(df: DataFrame) -> DataFrame:
    part = ["CountryName"]
    pct = {k: percentile_rank(F.col(c), part) for k, c in (("roic", "roic"), ("yield", "earnings_yield"), ("quality", "earnings_quality"))}
    df = df.withColumns({f"{k}_pct": c for k, c in pct.items()})
    return df.withColumn("gem_score", sum((F.col(f"{k}_pct") * w for k, w in WEIGHTS.items()), F.lit(0.0)))


def completeness_weighted(df: DataFrame, weight: float = 0.2) -> DataFrame:
    """Replaces gem_score by its min-max form mixed with completeness; unscaled where it is constant."""
    w = Window.partitionBy("CountryName")
    lo, hi = F.min("gem_score").over(w), F.max("gem_score").over(w)
    scaled = F.when(hi == lo, F.col("gem_score")).otherwise((F.col("gem_score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn("gem_score", (1 - weight) * scaled + weight * F.coalesce("completeness", F.lit(0.0)))


CAP_QUANTILES = "array(0.4, 0.75, 0.95, 0.33, 0.66)"


def _thresholds(n: Column, p: Column, top: Column) -> dict[str, Column]:
    many = n >= 10
    return {"t1": F.when(many, p[0]).otherwise(p[3]), "t2": F.when(many, p[1]).otherwise(p[4]), "t3": F.when(many, p[2]).otherwise(top)}


def cap_thresholds(df: DataFrame, min_mln: float) -> DataFrame:
    """(CountryName, n, t1, t2, t3) over investable names: p40, p75, p95, or p33, p66 and the maximum below ten names."""
    inv = df.filter(F.col("mcap") >= min_mln * 1e6)
    p = inv.groupBy("CountryName").agg(F.count("*").alias("n"), F.expr(f"percentile(mcap, {CAP_QUANTILES})").alias("p"), F.max("mcap").alias("top"))
    return p.select("CountryName", "n", *(c.alias(k) for k, c in _thresholds(F.col("n"), F.col("p"), F.col("top")).items()))


def _bucket(min_mln: float) -> Column:
    m = F.col("mcap")
    return F.when(m.isNull(), "Unknown").when(m < min_mln * 1e6, "BelowMin").when(F.col("t1").isNull(), "Unknown").when(m < F.col("t1"), "Micro").when(m < F.col("t2"), "Small").when(m < F.col("t3"), "Mid").otherwise("Large")


def cap_bucket(df: DataFrame, min_mln: float, thresholds: DataFrame | None = None) -> DataFrame:
    """Adds cap_category by thresholds (a row a country), or by those of df itself: then as windows by country, which the scores
    need anyway, so df is not derived a second time."""
    if thresholds is not None:
        df = df.join(F.broadcast(thresholds.select("CountryName", "t1", "t2", "t3")), "CountryName", "left")
    else:
        w = Window.partitionBy("CountryName")
        df = df.withColumn("__inv", F.when(F.col("mcap") >= min_mln * 1e6, F.col("mcap")))
        df = df.withColumns({"__n": F.count("__inv").over(w), "__p": F.expr(f"percentile(__inv, {CAP_QUANTILES})").over(w), "__top": F.max("__inv").over(w)})
        df = df.withColumns(_thresholds(F.col("__n"), F.col("__p"), F.col("__top"))).drop("__inv", "__n", "__p", "__top")
    return df.withColumn("cap_category", _bucket(min_mln)).drop("t1", "t2", "t3")


def subset_rank(flag: Column, score: Column, part: list | None = None) -> Column:
    """1, 2, ... by falling score (ties by symbol) where flag holds, else null."""
    flag = F.coalesce(flag, F.lit(False))
    w = Window.partitionBy(*(part or []), flag).orderBy(F.desc_nulls_last(score), "symbol")
    return F.when(flag, F.row_number().over(w))


def ranks(df: DataFrame, min_mln: float) -> DataFrame:
    """gem_rank among investable names, cap_rank within the cap category, tier_rank within the tier; by country."""
    c = ["CountryName"]
    order = [F.desc_nulls_last("gem_score"), "symbol"]
    df = df.withColumn("gem_rank", subset_rank(F.col("mcap") >= min_mln * 1e6, F.col("gem_score"), c))
    df = df.withColumn("cap_rank", F.row_number().over(Window.partitionBy(*c, "cap_category").orderBy(*order)))
    return df.withColumn("tier_rank", F.row_number().over(Window.partitionBy(*c, "tier").orderBy(*order)))


def prior_period_ranks(df: DataFrame, periods: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(symbol, CountryName, period, prior_rank): the rank each symbol had one, two and three reports ago."""
    df = df.withColumn("period", F.row_number().over(newest_first()) - 1).filter(F.col("period").isin(*periods))
    ev = F.coalesce("ev", F.col("EnterpriseValueRevenue") * F.col("RevenueTTM"))
    cash = F.coalesce("netOperatingCashFlow", "totalCashFromOperatingActivities")
    df = df.withColumn("roic_", F.coalesce("roicTTM", F.try_divide("ebit", F.col("totalAssets") - F.col("totalCurrentAssets")))).withColumn("ey_", F.try_divide("ebit", ev)).withColumn("eq_", F.try_divide(cash - F.col("netIncome"), F.col("MarketCapitalization")))
    part = ["CountryName", "period"]
    pct = [percentile_rank(F.col(c), part, "keep") * w for c, w in (("roic_", 0.4), ("ey_", 0.5), ("eq_", 0.1))]
    df = df.withColumn("score_", F.round(pct[0] + pct[1] + pct[2], 12))
    df = df.withColumn("pct_", percentile_rank(F.col("score_"), part, "keep"))
    rank = F.when(F.col("pct_").isNotNull(), F.row_number().over(Window.partitionBy(*part).orderBy(F.desc_nulls_last("pct_"), "symbol")))
    return df.select("symbol", "CountryName", "period", rank.alias("prior_rank"))


def with_prior_ranks(df: DataFrame, prior: DataFrame) -> DataFrame:
    """df with rank_1, rank_2, rank_3 periods ago."""
    wide = prior.groupBy("symbol").pivot("period", [1, 2, 3]).agg(F.max("prior_rank")).withColumnsRenamed({str(p): f"rank_{p}" for p in (1, 2, 3)})
    return df.join(wide, "symbol", "left")


QUARTILES = ("min", "25%", "50%", "75%", "max")


def profile(df: DataFrame, columns: list[str], top: int = 20, few: int = 50) -> DataFrame:
    """(name, item, n, x, nulls, n_distinct) of columns. One of at most `few` distinct values has its `top` most frequent values as
    items, with their counts n; a numeric one of more is described (items count, mean, std, min, quartiles, max, as x); a text
    of more has its most frequent value.

    All of it starts from counts by value. The most frequent ones are found in each task before they are compared, and
    quantiles come from sums over blocks of values, so no task holds all values of a column.
    """
    numeric = [c for c, kind in df.dtypes if c in columns and kind.split("(")[0] in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}]
    values = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("v")) for c in columns]
    counts = df.select(F.explode(F.array(*values)).alias("r")).select("r.*").groupBy("name", "value", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("name").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("n_distinct"))
    known = counts.filter("value is not null").join(F.broadcast(totals), "name")  # a row a column
    many = F.col("n_distinct") > few
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    frequent = known.filter(~many | ~F.col("name").isin(numeric)).withColumn("place", place).filter(F.col("place") <= top).filter(~many | (F.col("place") == 1))
    frequent = frequent.select("name", F.col("value").alias("item"), "n", F.lit(None).cast("double").alias("x"), "nulls", "n_distinct")
    if not numeric:
        return frequent
    wide = known.filter(many & F.col("name").isin(numeric))
    rows = F.sum("n")
    mean = F.sum(F.col("v") * F.col("n")) / rows
    sums = wide.groupBy("name").agg(rows.alias("count"), mean.alias("mean"))
    spread = wide.join(F.broadcast(sums.select("name", "mean", "count")), "name").groupBy("name").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("mean"), F.lit(2.0)) * F.col("n")) / (F.max("count") - 1)).alias("std"))
    edges = mo.quantiles_of(wide.select(F.col("name").alias("feature"), F.col("v").alias("x"), "n"), len(QUARTILES) - 1).withColumnRenamed("feature", "name")
    item = lambda name, x: F.struct(F.lit(name).alias("item"), x.cast("double").alias("x"))
    items = [item("count", F.col("count")), item("mean", F.col("mean")), item("std", F.col("std")), *(item(q, F.col("e")[i]["x"]) for i, q in enumerate(QUARTILES))]
    described = sums.join(spread, "name").join(edges, "name").select("name", F.inline(F.array(*items))).join(F.broadcast(totals), "name")
    return frequent.unionByName(described.select("name", "item", F.lit(None).cast("bigint").alias("n"), "x", "nulls", "n_distinct"))


def label_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def rule_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule does not hold; one pass over df."""
    sums = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(n) for n, ok in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


#: Fixed values of the snapshot's vocabulary.
PRIMARY = ("Bull", "Bear", "Neutral")
SECONDARY = ("PullbackInBull", "TrendingUp", "PullbackInBear", "TrendingDown", "Unknown", "Volatile", "ShortTrend", "Ranging")
REVERSALS = ("NoReversal", *(f"{side}Reversal{form}{grade}" for side in ("Bullish", "Bearish") for form in ("", "-ML") for grade in ("Weak", "Moderate", "Strong")), "0", "0.0")


def snapshot_rules(columns: list[str]) -> dict[str, Column]:
    """The rules of a snapshot that has these columns; a null keeps every rule."""
    label = lambda c: F.trim(F.col(c).cast("string"))
    first, second = F.regexp_extract("Trend", r"^([^\[]*)", 1), F.regexp_extract("Trend", r"\[([^\]]+)\]", 1)
    rules = {f"{c}_range": (c, F.col(c).between(-4, 4)) for c in ("SignalClassifier_ML", "SignalClassifier_Rules")}
    rules |= {"Trend_format": ("Trend", F.col("Trend").rlike(r"^\w+\[\w+\]$")), "Trend_primary": ("Trend", first.isin(*PRIMARY)), "Trend_secondary": ("Trend", (second == "") | second.isin(*SECONDARY))}
    rules |= {f"{c}_label": (c, label(c).isin(*REVERSALS)) for c in ("TrendReversal_Rules", "TrendReversal_ML")}
    rules |= {"TMA21_50_X_value": ("TMA21_50_X", F.col("TMA21_50_X").isin(-1, 0, 1)), "RSIUpTrend_value": ("RSIUpTrend", F.lower(label("RSIUpTrend")).isin("0", "1", "true", "false")), "ADX_range": ("ADX", F.col("ADX").between(0, 100))}
    rules |= {f"{c}_range": (c, F.col(c).between(-100, 1000)) for c in ("Pct2H52", "PctfL52")}
    return {name: ok for name, (c, ok) in rules.items() if c in columns}


def check_snapshot(df: DataFrame) -> DataFrame:
    """(rule, violations) for the rules of the columns that df has."""
    return rule_checks(df, snapshot_rules(df.columns))
