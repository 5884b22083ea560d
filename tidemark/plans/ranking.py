"""Queries over fundamental ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking as rk
from tidemark.plans.registry import query, with_panels
from tidemark.sources import ingest, tables

MIN_MLN = 2.0
PRESENT = " + ".join(f"(case when {f} is not null then 1 else 0 end)" for f in rk.REQUIRED)
LATEST = ("latest", "select * from (select *, row_number() over (partition by symbol order by report_date desc) as back from fundamentals) where back = 1")
RATIOS = (
    ("r0", "select l.*, g.CountryName, case when MarketCapitalization > 0 then MarketCapitalization else coalesce(sharesOutstanding * last_close, MarketCapitalization) end as mcap from latest l join listings g using (symbol)"),
    ("r1", "select *, avgVolume * last_close as adtv, totalDebt - cashAndCashEquivalents as net_debt, coalesce(ev, mcap + (totalDebt - cashAndCashEquivalents), EnterpriseValueRevenue * RevenueTTM) as enterprise_value from r0"),
    (
        "r2",
        """select *, greatest(least(coalesce(roicTTM, ebit / nullif(totalAssets - totalCurrentAssets, 0)), 10.0), -10.0) as roic_,
      case when abs(mcap) >= 1e6 then (coalesce(netOperatingCashFlow, totalCashFromOperatingActivities) - netIncome) / nullif(mcap, 0) end as eq0,
      case when abs(enterprise_value) >= 1e6 then coalesce(ebitda, ebit) / enterprise_value end as ey0 from r1""",
    ),
    (
        "ratios",
        """select *, case when coalesce(roicTTM, ebit / nullif(totalAssets - totalCurrentAssets, 0)) is not null then roic_ end as roic,
      case when eq0 is not null then greatest(least(eq0, 100.0), -100.0) end as earnings_quality, case when ey0 is not null then greatest(least(ey0, 100.0), -100.0) end as earnings_yield from r2""",
    ),
)


def pct(c: str, part: str, count: str = "*") -> str:
    return f"(rank() over (partition by {part} order by {c} nulls last) + (count(*) over (partition by {part}, {c}) - 1) / 2.0) / count({count}) over (partition by {part})"


SCORED = (
    LATEST,
    *RATIOS,
    ("s0", f"select *, {pct('roic', 'CountryName')} as roic_pct, {pct('earnings_yield', 'CountryName')} as yield_pct, {pct('earnings_quality', 'CountryName')} as quality_pct from ratios"),
    ("scored", "select *, roic_pct * 0.4 + yield_pct * 0.5 + quality_pct * 0.1 as gem_score from s0"),
)
COMPLETE = ("complete", f"select symbol, avg(({PRESENT}) / 8.0) as completeness from (select *, row_number() over (partition by symbol order by report_date desc) as back from fundamentals) where back <= 4 group by symbol")
TIERS = ("tiers", f"select symbol, case when n >= 4 then 1 when n >= 2 then 2 when n = 1 then 3 else 4 end as tier from (select symbol, count(*) filter (where {PRESENT} = 8) as n from fundamentals group by symbol)")
WEIGHTED = (
    *SCORED,
    COMPLETE,
    TIERS,
    ("w0", "select s.* exclude (gem_score), c.completeness, t.tier, s.gem_score as raw_score, min(s.gem_score) over (partition by CountryName) as lo, max(s.gem_score) over (partition by CountryName) as hi from scored s join complete c using (symbol) join tiers t using (symbol)"),
    ("weighted", "select *, round(0.8 * (case when hi = lo then raw_score else (raw_score - lo) / (hi - lo) end) + 0.2 * completeness, 9) as gem_score from w0"),
)
CAPS = (
    ("inv", "select CountryName, count(*) as n, quantile_cont(mcap, 0.4) as p40, quantile_cont(mcap, 0.75) as p75, quantile_cont(mcap, 0.95) as p95, quantile_cont(mcap, 0.33) as p33, quantile_cont(mcap, 0.66) as p66, max(mcap) as top from ratios where mcap >= 2e6 group by CountryName"),
    ("caps", "select CountryName, n, case when n >= 10 then p40 else p33 end as t1, case when n >= 10 then p75 else p66 end as t2, case when n >= 10 then p95 else top end as t3 from inv"),
)
RANKED = (
    *WEIGHTED,
    *CAPS,
    ("bucketed", "select w.*, case when mcap is null then 'Unknown' when mcap < 2e6 then 'BelowMin' when t1 is null then 'Unknown' when mcap < t1 then 'Micro' when mcap < t2 then 'Small' when mcap < t3 then 'Mid' else 'Large' end as cap_category from weighted w left join caps using (CountryName)"),
    (
        "ranked",
        """select *, case when coalesce(mcap >= 2e6, false) then row_number() over (partition by CountryName, coalesce(mcap >= 2e6, false) order by gem_score desc nulls last, symbol) end as gem_rank,
      row_number() over (partition by CountryName, cap_category order by gem_score desc nulls last, symbol) as cap_rank, row_number() over (partition by CountryName, tier order by gem_score desc nulls last, symbol) as tier_rank from bucketed""",
    ),
)
PRIOR = (
    ("q0", "select f.*, CountryName, row_number() over (partition by f.symbol order by report_date desc) - 1 as period from fundamentals f join listings using (symbol)"),
    ("q1", "select *, coalesce(roicTTM, ebit / nullif(totalAssets - totalCurrentAssets, 0)) as roic_, ebit / nullif(coalesce(ev, EnterpriseValueRevenue * RevenueTTM), 0) as ey_, (coalesce(netOperatingCashFlow, totalCashFromOperatingActivities) - netIncome) / nullif(MarketCapitalization, 0) as eq_ from q0 where period in (1, 2, 3)"),
    ("q2", f"select *, round(case when roic_ is not null then {pct('roic_', 'CountryName, period', 'roic_')} end * 0.4 + case when ey_ is not null then {pct('ey_', 'CountryName, period', 'ey_')} end * 0.5 + case when eq_ is not null then {pct('eq_', 'CountryName, period', 'eq_')} end * 0.1, 12) as score_ from q1"),
    ("q3", f"select *, case when score_ is not null then {pct('score_', 'CountryName, period', 'score_')} end as pct_ from q2"),
    ("prior", "select symbol, CountryName, cast(period as integer) as period, case when pct_ is not null then cast(row_number() over (partition by CountryName, period order by pct_ desc nulls last, symbol) as integer) end as prior_rank from q3"),
)


def scored(spark, path) -> DataFrame:
    latest = rk.newest_with_quality(tables.fundamentals(spark, path)).join(tables.listings(spark, path).select("symbol", "CountryName"), "symbol")
    return rk.gem_score(rk.ratios(latest))


def weighted(spark, path) -> DataFrame:
    return rk.completeness_weighted(scored(spark, path)).withColumn("gem_score", F.round("gem_score", 9))


def ranked(spark, path) -> DataFrame:
    return rk.ranks(rk.cap_bucket(weighted(spark, path), MIN_MLN), MIN_MLN)


@query("A19_refresh_watchlists", with_panels("select 'all_ranked' as watchlist, tier, symbol, cast(row_number() over (partition by tier order by gem_rank nulls last, symbol) as integer) as place from ranked union all select 'tier1_top', tier, symbol, cast(row_number() over (order by gem_rank, symbol) as integer) from (select * from ranked where tier = 1 and gem_rank is not null order by gem_rank, symbol limit 100)", *RANKED))
def a19(spark, path):
    r = ranked(spark, path).select("symbol", F.col("tier").alias("GEM_Data_Tier"), F.col("gem_rank").alias("GEM_Rank"))
    return ingest.refresh_watchlists(r)


@query("C02_subset_rank", with_panels("select symbol, date, case when volume % 3 = 0 then cast(row_number() over (partition by date, volume % 3 = 0 order by close desc, symbol) as integer) end as place from bars_walk"))
def c02(spark, path):
    bars = tables.bars_walk(spark, path)
    return bars.select("symbol", "date", rk.subset_rank(F.col("volume") % 3 == 0, F.col("close"), ["date"]).alias("place"))


@query("C07_prior_ranks_attached", with_panels("select symbol, max(case when period = 1 then prior_rank end) as rank_1, max(case when period = 2 then prior_rank end) as rank_2, max(case when period = 3 then prior_rank end) as rank_3 from prior group by symbol", *PRIOR))
def c07(spark, path):
    f = tables.fundamentals(spark, path).join(tables.listings(spark, path).select("symbol", "CountryName"), "symbol")
    return rk.with_prior_ranks(f.select("symbol").distinct(), rk.prior_period_ranks(f))


@query("D01_latest_per_symbol", with_panels("select symbol, report_date, ebit, revenue from latest", LATEST))
def d01(spark, path):
    return rk.latest_per_symbol(tables.fundamentals(spark, path)).select("symbol", "report_date", "ebit", "revenue")


@query("D02_last_scan", with_panels("select symbol, max(date) as last_scan from bars_walk group by symbol"))
def d02(spark, path):
    return rk.last_scan(tables.bars_walk(spark, path).withColumn("symbol", F.concat(F.lit(" "), "symbol", F.lit(" "))), "date")


@query("D03_having_bars", with_panels("select symbol, count(*) as n_bars from bars_walk group by symbol having count(*) >= 540"))
def d03(spark, path):
    return rk.having_bars(tables.bars_walk(spark, path), 540)


@query("D04_completeness", with_panels("select symbol, round(completeness, 6) as completeness from complete", COMPLETE))
def d04(spark, path):
    return rk.completeness(tables.fundamentals(spark, path)).withColumn("completeness", F.round("completeness", 6))


@query("D05_data_tier", with_panels("select * from tiers", TIERS))
def d05(spark, path):
    return rk.data_tier(tables.fundamentals(spark, path))


@query("D06_cap_thresholds", with_panels("select CountryName, n, round(t1, 4) as t1, round(t2, 4) as t2, round(t3, 4) as t3 from caps", LATEST, *RATIOS, *CAPS))
def d06(spark, path):
    return rk.cap_thresholds(scored(spark, path), MIN_MLN).select("CountryName", "n", *(F.round(t, 4).alias(t) for t in ("t1", "t2", "t3")))


@query("D07_min_cap", with_panels("select symbol, case CountryName when 'AMERICA' then 2.0 when 'ASIA' then 160.0 when 'EUROPE' then 15.0 else 1.0 end::double as min_cap_mln from listings"))
def d07(spark, path):
    """The default minimum cap of each symbol's country, from a small table of countries."""
    caps = spark.createDataFrame([("AMERICA", 2.0), ("ASIA", 160.0), ("EUROPE", 15.0)], "CountryName string, min_cap_mln double")
    return tables.listings(spark, path).join(F.broadcast(caps), "CountryName", "left").select("symbol", F.coalesce("min_cap_mln", F.lit(1.0)).alias("min_cap_mln"))


PROFILED = ("symbol", "close", "volume", "weekly")
PROFILE_ROWS = "select symbol, close, volume, case when volume % 8 <> 7 then volume % 8 end as weekly from bars_walk"


def _profile_sql() -> str:
    parts = []
    for c in PROFILED:
        of = f"(select count(*) filter (where {c} is null) as nulls, count(distinct {c}) as n_distinct from profiled)"
        text = c == "symbol"
        top = f"select '{c}' as name, cast({c} as varchar) as item, n, null::double as x, nulls, n_distinct from (select {c}, count(*) as n from profiled where {c} is not null group by {c}) g, {of} t"
        parts.append(f"select * exclude place from (select *, row_number() over (order by n desc, item) as place from ({top})) where place <= case when n_distinct > 50 then {int(text)} else 20 end")
        if not text:
            each = [("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), *((q, f"quantile_cont({c}::double, {i / 4})") for i, q in enumerate(("min", "25%", "50%", "75%", "max")))]
            parts += [f"select '{c}', '{item}', null::bigint, round(x, 6), nulls, n_distinct from (select {x}::double as x from profiled), {of} where n_distinct > 50" for item, x in each]
    return " union all ".join(parts)


@query("D09_profile", with_panels(_profile_sql(), ("profiled", PROFILE_ROWS)))
def d09(spark, path):
    rows = tables.bars_walk(spark, path).select("symbol", "close", "volume", F.when(F.col("volume") % 8 != 7, F.col("volume") % 8).alias("weekly"))
    return rk.profile(rows, list(PROFILED)).withColumn("x", F.round("x", 6))


@query("D10_label_counts", with_panels("select CountryName as label, count(*) as n from listings group by CountryName"))
def d10(spark, path):
    return rk.label_counts(tables.listings(spark, path), "CountryName")


RATIO_COLUMNS = ("mcap", "adtv", "net_debt", "enterprise_value", "roic", "earnings_yield", "earnings_quality")


@query("G11_ratios", with_panels(f"select symbol, {', '.join(f'round({c}, 8) + 0.0 as {c}' for c in RATIO_COLUMNS)} from ratios", LATEST, *RATIOS))
def g11(spark, path):
    return scored(spark, path).select("symbol", *((F.round(c, 8) + 0.0).alias(c) for c in RATIO_COLUMNS))


@query("G12_gem_score", with_panels("select symbol, round(gem_score, 8) as gem_score from scored", *SCORED))
def g12(spark, path):
    return scored(spark, path).select("symbol", F.round("gem_score", 8).alias("gem_score"))


@query("G13_completeness_weighted", with_panels("select symbol, round(gem_score, 7) as gem_score from weighted", *WEIGHTED))
def g13(spark, path):
    return weighted(spark, path).select("symbol", F.round("gem_score", 7).alias("gem_score"))


@query("G14_cap_bucket", with_panels("select symbol, cap_category from bucketed", *RANKED[:-1]))
def g14(spark, path):
    return ranked(spark, path).select("symbol", "cap_category")


@query("H01_sequence_rank", with_panels("select symbol, date, cast(row_number() over (partition by date order by volume desc, symbol) as integer) as place from bars_walk where volume > 40"))
def h01(spark, path):
    rows = tables.bars_walk(spark, path).filter("volume > 40")
    return rows.select("symbol", "date", rk.subset_rank(F.lit(True), F.col("volume"), ["date"]).alias("place"))


@query("H02_percentile_average", with_panels(f"select symbol, round({pct('roic', 'CountryName')}, 8) as bottom, round(case when roic is not null then {pct('roic', 'CountryName', 'roic')} end, 8) as keep from ratios", LATEST, *RATIOS))
def h02(spark, path):
    s, part = scored(spark, path), ["CountryName"]
    return s.select("symbol", F.round(rk.percentile_rank(F.col("roic"), part), 8).alias("bottom"), F.round(rk.percentile_rank(F.col("roic"), part, "keep"), 8).alias("keep"))


@query("H03_percentile_min", with_panels("select symbol, round(rank() over (partition by CountryName order by roic nulls last) / count(*) over (partition by CountryName), 8) as pct from ratios", LATEST, *RATIOS))
def h03(spark, path):
    return scored(spark, path).select("symbol", F.round(rk.min_percentile_rank(F.col("roic"), ["CountryName"]), 8).alias("pct"))


for _name, _column in (("H04_gem_rank", "gem_rank"), ("H05_cap_rank", "cap_rank"), ("H06_tier_rank", "tier_rank")):
    query(_name, with_panels(f"select symbol, cast({_column} as integer) as {_column} from ranked", *RANKED))(lambda spark, path, c=_column: ranked(spark, path).select("symbol", c))


@query("H07_prior_period_ranks", with_panels("select * from prior", *PRIOR))
def h07(spark, path):
    f = tables.fundamentals(spark, path).join(tables.listings(spark, path).select("symbol", "CountryName"), "symbol")
    return rk.prior_period_ranks(f)


@query("H08_top_k", with_panels("select symbol, date, volume from bars_walk order by volume desc, symbol, date limit 50"))
def h08(spark, path):
    return tables.bars_walk(spark, path).select("symbol", "date", "volume").orderBy(F.desc("volume"), "symbol", "date").limit(50)


@query("H09_best_horizon", with_panels("select symbol, horizon, confidence from (select *, row_number() over (partition by symbol order by confidence desc, horizon) as place from (select symbol, h as horizon, (cast(substr(symbol, 2) as bigint) * 31 * h % 97) / 97.0 as confidence from listings, (values (5), (10), (15), (20)) t(h)) where confidence >= 0.4) where place = 1"))
def h09(spark, path):
    """Each symbol's horizon of the highest confidence of at least 0.40, the shortest of equal ones."""
    rows = tables.listings(spark, path).select("symbol", F.explode(F.array(*map(F.lit, (5, 10, 15, 20)))).alias("horizon"))
    rows = rows.withColumn("confidence", (F.substring("symbol", 2, 9).cast("bigint") * 31 * F.col("horizon") % 97) / F.lit(97.0)).filter("confidence >= 0.4")
    return rows.groupBy("symbol").agg(F.max_by(F.struct("horizon", "confidence"), F.struct("confidence", -F.col("horizon"))).alias("b")).select("symbol", "b.*")


@query("H10_union_all", with_panels("select symbol, name, cast(null as varchar) as currency from listings union all select symbol, cast(null as varchar), currency from listings"))
def h10(spark, path):
    rows = tables.listings(spark, path)
    return rows.select("symbol", "name").unionByName(rows.select("symbol", "currency"), allowMissingColumns=True)


@query("H11_distinct", with_panels("select distinct watchlist, symbol from watchlist"))
def h11(spark, path):
    return tables.watchlist(spark, path).distinct()


@query("H12_difference", with_panels("select distinct symbol from watchlist where watchlist = 'ASIA' except select symbol from bars_walk where volume > 45 and date < date '1996-01-01' and symbol like '%1'"))
def h12(spark, path):
    seen = tables.bars_walk(spark, path).filter("volume > 45 and date < date '1996-01-01' and symbol like '%1'").select("symbol")
    return ingest.watchlist_members(tables.watchlist(spark, path), "ASIA").join(seen, "symbol", "left_anti")


