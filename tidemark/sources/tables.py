"""Input tables and the panels derived from them: bars, listings, fundamentals, watchlists, ticks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that both engines read alike: the panels every query starts from. Names in braces are tables.
BARS_RAW = """
select 'S' || cast(l_suppkey as string) as symbol, cast(l_shipdate as date) as date,
  min_by(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) as open,
  max(l_extendedprice / l_quantity) as high,
  min(l_extendedprice / l_quantity) as low,
  max_by(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) as close,
  cast(sum(l_quantity) as bigint) as volume
from {lineitem} group by l_suppkey, cast(l_shipdate as date)
"""
BARS_WALK = """
with s_ as (select symbol, date, volume,
    1000 + 5 * sum(volume % 7 - 3) over (partition by symbol order by date rows between unbounded preceding and current row) as c
  from {bars_raw}),
p_ as (select *, coalesce(lag(c) over (partition by symbol order by date), 1000) as o from s_)
select symbol, date, cast(o as double) as open,
  cast(greatest(o, c) + volume % 11 as double) as high,
  cast(least(o, c) - volume % 13 as double) as low,
  cast(c as double) as close, volume
from p_
"""
LISTINGS = """
select 'S' || cast(s_suppkey as string) as symbol, s_name as name, r_name as CountryName,
  n_name as Sector,
  case when s_suppkey % 9 = 0 then null else
    case r_name when 'AMERICA' then 'USD' when 'ASIA' then 'INR' when 'EUROPE' then 'EUR' else 'HKD' end end as currency
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""
FUNDAMENTALS = """
with q_ as (
  select l_suppkey as k, cast(date_trunc('quarter', l_shipdate) as date) as report_date,
    sum(cast(round(l_extendedprice) as bigint)) as rev,
    sum(cast(round(l_extendedprice * l_discount) as bigint)) as dis,
    sum(cast(round(l_extendedprice * l_tax) as bigint)) as tax,
    cast(sum(l_quantity) as bigint) as qty
  from {lineitem} group by l_suppkey, cast(date_trunc('quarter', l_shipdate) as date)),
m_ as (select *, (k * 7 + year(report_date) * 4 + month(report_date) / 3) as h0 from q_),
h_ as (select *, cast(floor(h0) as bigint) as h from m_)
select 'S' || cast(k as string) as symbol, report_date,
  cast(dis - tax as double) as ebit,
  case when h % 3 = 0 then null else cast(dis as double) end as ebitda,
  case when h % 11 = 0 then null else cast(dis - 2 * tax as double) end as netIncome,
  cast(rev as double) as revenue,
  cast(rev * 4 as double) as RevenueTTM,
  case when h % 13 = 0 then null else cast(rev * 5 as double) end as totalAssets,
  case when h % 17 = 0 then cast(rev * 5 as double) else cast(rev * 2 as double) end as totalCurrentAssets,
  case when h % 7 = 0 then null else cast(dis + tax as double) end as netOperatingCashFlow,
  case when h % 5 = 0 then null else cast(dis + tax as double) end as totalCashFromOperatingActivities,
  case when h % 19 = 0 then null else cast(qty * 12000 as double) end as MarketCapitalization,
  case when h % 4 = 0 then cast(rev * 6 as double) else null end as ev,
  case when h % 6 = 0 then cast(0.125 as double) else null end as roicTTM,
  cast(1.5 as double) as EnterpriseValueRevenue,
  cast(qty as double) as sharesOutstanding, cast(12000 as double) as last_close,
  cast(qty % 500 as double) as avgVolume, cast(tax * 3 as double) as totalDebt,
  case when h % 8 = 0 then null else cast(dis as double) end as cashAndCashEquivalents
from h_
"""
WATCHLIST = """
select CountryName as watchlist, symbol from {listings}
union all select CountryName, symbol from {listings} where symbol like '%1'
"""
TICKS = "select event_type as symbol, ts, value as price, event_id from {events}"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


TASK_ROWS = 400_000  # rows that a task takes at most, but for a symbol's own
LEAST_ROWS = 50_000  # fewer are not worth a task


def by_symbol_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows dealt by symbol: with the input there are more of them, not larger ones."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, ceil(rows / LEAST_ROWS)), ceil(rows / TASK_ROWS))


def bars_raw(spark: SparkSession, path: str) -> DataFrame:
    """One symbol a supplier, one bar a day, prices per unit: BARS_RAW's rows. The lines are dealt by symbol once, and both the bars
    and all that windows by symbol make of them stay where they are."""
    lines = table(spark, path, "lineitem")
    parts = by_symbol_parts(spark, lines.count())
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), at.alias("at"), "l_quantity")
    prices = {"open": F.min_by("price", "at"), "high": F.max("price"), "low": F.min("price"), "close": F.max_by("price", "at"), "volume": F.sum("l_quantity").cast("bigint")}
    return lines.repartition(parts, "symbol").groupBy("symbol", "date").agg(*(x.alias(n) for n, x in prices.items()))


def bars_walk(spark: SparkSession, path: str) -> DataFrame:
    """An integer-valued walk over the same days."""
    return spark.sql(BARS_WALK, bars_raw=bars_raw(spark, path))


def listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(LISTINGS, supplier=table(spark, path, "supplier"), nation=table(spark, path, "nation"), region=table(spark, path, "region"))


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(FUNDAMENTALS, lineitem=table(spark, path, "lineitem"))


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(WATCHLIST, listings=listings(spark, path))


def ticks(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(TICKS, events=table(spark, path, "events"))


def bars(df: DataFrame, symbols: list[str] | None = None, tail_bars: int | None = None) -> DataFrame:
    """Bars of some symbols, or of all; the filter reaches the scan. With tail_bars only the newest of each symbol: whatever is
    computed from them starts anew at the first that is left, exponential means too, as a nightly run over a short history
    has it."""
    df = df if symbols is None else df.filter(F.col("symbol").isin(symbols))
    if tail_bars is None:
        return df
    order = Window.partitionBy("symbol").orderBy("date")
    back = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(order)
    return df.withColumn("__back", back).filter(F.col("__back") < tail_bars).drop("__back")


def bars_between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the days from start to end, both included."""
    if start is not None:
        df = df.filter(F.col("date") >= F.to_date(F.lit(start)))
    return df if end is None else df.filter(F.col("date") <= F.to_date(F.lit(end)))
