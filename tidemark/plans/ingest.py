"""Queries over scans, sources and sinks (A), cleaning (B) and the joins that go with them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions import clean
from tidemark.operators import indicators as ind
from tidemark.plans.registry import OVER, over, query, with_panels
from tidemark.sources import ingest, tables

KEEP = "symbol, date, open, high, low, close, volume"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared checkpoint directory, deleted when the driver ends. Where that is unset a local master (tests)
    gets a temporary one; a cluster has no folder then that all executors see."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/{name}"


def arrays_json(bars: DataFrame) -> DataFrame:
    """Each symbol's bars as a JSON answer of parallel arrays; odd symbols answer with another status."""
    row = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume")
    held = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("r"))
    ok = F.when(F.substring("symbol", 2, 9).cast("int") % 2 == 0, "ok").otherwise("no_data")
    body = F.struct(ok.alias("s"), *(F.col(f"r.{c}").alias(k) for c, k in (("t", "t"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))))
    return held.select("symbol", F.to_json(body).alias("body"))


def records_json(bars: DataFrame) -> DataFrame:
    row = F.struct(F.col("date").cast("string").alias("date"), "open", "high", "low", F.when(F.col("volume") % 10 != 0, F.col("close")).alias("close"), F.col("close").alias("adjusted_close"), "volume")
    return bars.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("body"))


@query("A01_bars_scan", with_panels(f"select {KEEP} from bars_walk"))
def a01(spark, path):
    return tables.bars(tables.bars_walk(spark, path))


@query("A02_bars_between", with_panels(f"select {KEEP} from bars_walk where date between date '1995-03-01' and date '1996-02-29'"))
def a02(spark, path):
    return tables.bars_between(tables.bars_walk(spark, path), "1995-03-01", "1996-02-29")


LAST70 = f"select {KEEP} from (select *, row_number() over (partition by symbol order by date desc) as back from bars_walk) where back <= 70"


@query("A03_last_n_bars", with_panels(LAST70))
def a03(spark, path):
    return ingest.last_n_bars(tables.bars_walk(spark, path), 70)


@query("A04_candles_from_arrays", with_panels(f"select {KEEP} from bars_walk where cast(substr(symbol, 2) as bigint) % 2 = 0"))
def a04(spark, path):
    return ingest.candles_from_arrays(arrays_json(tables.bars_walk(spark, path)))


@query("A05_candles_from_records", with_panels(f"select {KEEP} from bars_walk where volume % 10 <> 0"))
def a05(spark, path):
    return ingest.candles_from_records(records_json(tables.bars_walk(spark, path)))


@query("A06_upsert_bars", with_panels("select symbol, date, open, high, low, case when volume % 3 = 0 then close + 1 else close end as close, volume from bars_walk union all select symbol, date + 40000, open, high, low, close, volume from bars_walk where volume % 50 = 0"))
def a06(spark, path):
    bars = tables.bars_walk(spark, path)
    changed = bars.filter("volume % 3 = 0").withColumn("close", F.col("close") + 1)
    added = bars.filter("volume % 50 = 0").withColumn("date", F.date_add("date", 40000))
    return ingest.upsert(bars, changed.unionByName(added), ["symbol", "date"])


STATEMENT_FIELDS = {"ic": ["ebit", "netIncome"], "bs": ["totalAssets", "totalCurrentAssets"], "cf": ["netOperatingCashFlow"]}


def statement_maps(f: DataFrame) -> DataFrame:
    """Each symbol's statements as three JSON maps from report date to record."""
    maps = [F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("report_date").cast("string"), F.struct(*names))))).alias(k) for k, names in STATEMENT_FIELDS.items()]
    return f.groupBy("symbol").agg(F.max("last_close").alias("last_close"), *maps)


NEWEST6 = "select *, row_number() over (partition by symbol order by report_date desc) as back from fundamentals"


@query("A07_statements_from_maps", with_panels(f"select symbol, report_date, ebit, netIncome, totalAssets, totalCurrentAssets, netOperatingCashFlow, case when back = 1 then last_close end as last_close from ({NEWEST6}) where back <= 6"))
def a07(spark, path):
    return ingest.statements_from_maps(statement_maps(tables.fundamentals(spark, path)), STATEMENT_FIELDS)


@query("A08_merge_buckets", with_panels("select symbol, report_date, coalesce(ebitda, ebit) as profit, coalesce(netOperatingCashFlow, totalCashFromOperatingActivities, netIncome) as cash from fundamentals"))
def a08(spark, path):
    f = tables.fundamentals(spark, path)
    parts = [f.select("symbol", "report_date", F.lit(b).alias("bucket"), F.col(p).alias("profit"), F.col(c).alias("cash")) for b, p, c in (("cf", "ebit", "netIncome"), ("ic", "ebitda", "netOperatingCashFlow"), ("bs", "ebit", "totalCashFromOperatingActivities"))]
    return ingest.merge_buckets(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["profit", "cash"])


@query("A09_attach_series", with_panels("select symbol, report_date, ebit, revenue * 1e6 as ev, roicTTM from fundamentals"))
def a09(spark, path):
    f = tables.fundamentals(spark, path)
    series = [f.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct(F.col("report_date").cast("string").alias("period"), F.col(c).alias("v")))).alias("body")).withColumn("key", F.lit(k)) for k, c in (("ev", "revenue"), ("roicTTM", "roicTTM"))]
    return ingest.attach_series(f.select("symbol", "report_date", "ebit"), series[0].unionByName(series[1]))


@query("A10_with_fallback", with_panels("select symbol, report_date, ebit from fundamentals where symbol not like '%3' union all select symbol, cast(null as date), 0.0 from listings where symbol like '%3' or symbol not in (select symbol from fundamentals)"))
def a10(spark, path):
    kept = tables.fundamentals(spark, path).filter("symbol not like '%3'").select("symbol", "report_date", "ebit")
    return ingest.with_fallback(kept, tables.listings(spark, path).select("symbol", F.lit(0.0).alias("ebit")))


@query("A11_last_close_newest", with_panels(f"select symbol, report_date, case when back = 1 then last_close end as last_close from ({NEWEST6}) where back <= 6"))
def a11(spark, path):
    return a07(spark, path).select("symbol", "report_date", "last_close")


@query("A12_upsert_fundamentals", with_panels("select symbol, report_date, case when report_date >= date '1996-01-01' then ebit + 1 else ebit end as ebit from fundamentals"))
def a12(spark, path):
    f = tables.fundamentals(spark, path).select("symbol", "report_date", "ebit")
    return ingest.upsert(f, f.filter("report_date >= date '1996-01-01'").withColumn("ebit", F.col("ebit") + 1), ["symbol", "report_date"])


@query("A13_upsert_listing", with_panels("select symbol, CountryName, case when CountryName = 'ASIA' then 'new' else name end as name from listings"))
def a13(spark, path):
    rows = tables.listings(spark, path).select("symbol", "CountryName", "name")
    return ingest.upsert(rows, rows.filter("CountryName = 'ASIA'").withColumn("name", F.lit("new")), ["symbol", "CountryName"])


@query("A14_watchlist_members", with_panels("select distinct symbol from watchlist where watchlist = 'ASIA'"))
def a14(spark, path):
    return ingest.watchlist_members(tables.watchlist(spark, path), "ASIA")


@query("A15_read_snapshot", with_panels("select symbol as Symbol, CountryName, date as ScanDate, close from bars_walk join listings using (symbol) where contains(CountryName, 'IC')"))
def a15(spark, path):
    snap = tables.bars_walk(spark, path).join(tables.listings(spark, path), "symbol").select(F.col("symbol").alias("Symbol"), "CountryName", F.col("date").alias("ScanDate"), "close")
    return ingest.read_snapshot(snap, "IC")


SNAPSHOT = StructType([StructField("symbol", StringType()), StructField("date", DateType()), StructField("close", DoubleType()), StructField("volume", LongType()), StructField("rsi", DoubleType()), StructField("trend", StringType())])


@query("A16_conform", with_panels("select symbol, date, close, volume, cast(null as double) as rsi, cast(null as varchar) as trend from bars_walk"))
def a16(spark, path):
    return ingest.conform(tables.bars_walk(spark, path), SNAPSHOT)


@query("A17_replace_partition", with_panels("select symbol, name, CountryName from listings where CountryName <> 'ASIA' union all select symbol, 'second', CountryName from listings where CountryName = 'ASIA' and symbol like '%1'"))
def a17(spark, path):
    rows, to = tables.listings(spark, path).select("symbol", "name", "CountryName"), scratch(spark, "slices")
    ingest.replace_partition(rows, to, "CountryName")
    ingest.replace_partition(rows.filter("CountryName = 'ASIA' and symbol like '%1'").withColumn("name", F.lit("second")), to, "CountryName")
    return spark.read.parquet(to)


@query("A18_update_join", with_panels("select symbol, date, case when volume % 2 = 0 then volume * 2.0 else close end as score from bars_walk"))
def a18(spark, path):
    bars = tables.bars_walk(spark, path)
    return ingest.update_join(bars.select("symbol", "date", F.col("close").alias("score")), bars.filter("volume % 2 = 0").select("symbol", "date", (F.col("volume") * 2.0).alias("score")), ["symbol", "date"], ["score"])


@query("A20_write_read_run", with_panels("select symbol, name from listings where CountryName = 'ASIA'"))
def a20(spark, path):
    rows, to = tables.listings(spark, path).select("symbol", "name", "CountryName"), scratch(spark, "runs")
    ingest.write_run(rows, to, "20250101T000000")
    ingest.write_run(rows.filter("CountryName = 'ASIA'"), to, "20250102T000000")
    return ingest.read_latest(spark, to).select("symbol", "name")


@query("A21_export_topk", with_panels("select symbol, date, close from bars_walk order by close desc, symbol, date limit 25"))
def a21(spark, path):
    to = scratch(spark, "top")
    rows = tables.bars_walk(spark, path).select("symbol", "date", "close").withColumn("tie", F.concat_ws("|", "symbol", F.col("date").cast("string")))
    ingest.export_topk(rows, F.desc("close"), "tie", 25, to)
    return spark.read.parquet(to).drop("tie")


def option_json(bars: DataFrame) -> DataFrame:
    """An option chain a symbol: a PUT and a CALL for each of its bars, expiring that day, at a strike from its price."""
    def contract(side: str):
        kind = F.when(F.col("volume") % 2 == 0, "monthly").otherwise("weekly")
        return F.array(F.struct(F.concat("symbol", F.lit(side), F.col("date").cast("string")).alias("contractName"), (F.col("close") / 4).alias("strike"), F.col("open").alias("lastPrice"), kind.alias("expirationType")))

    day = F.struct(F.col("date").cast("string").alias("expirationDate"), F.create_map(F.lit("PUT"), contract("P"), F.lit("CALL"), contract("C")).alias("options"))
    return bars.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(day).alias("data"))).alias("body"))


@query("A22_option_contracts", with_panels("select symbol, symbol || 'P' || cast(date as varchar) as contract, date as expiry, close / 4 as strike, open as last_price, cast(date - date '1996-01-01' as integer) as dte from bars_walk where volume % 2 = 0 and date - date '1996-01-01' between 20 and 60 and (close / 4) % 1 in (0.0, 0.5)"))
def a22(spark, path):
    return ingest.option_contracts(option_json(tables.bars_walk(spark, path)), "PUT", "monthly", "1996-01-01", 20, 60)


@query("A23_unpivot_metrics", with_panels("select symbol, 'ebit' as metric, sum(ebit) as value from fundamentals group by symbol union all select symbol, 'revenue', sum(revenue) from fundamentals group by symbol"))
def a23(spark, path):
    f = tables.fundamentals(spark, path).groupBy("symbol").agg(F.sum("ebit").alias("ebit"), F.sum("revenue").alias("revenue"))
    return ingest.unpivot_metrics(f.select("symbol", F.to_json(F.struct("ebit", "revenue")).alias("body")))


@query("B01_normalize_bars", with_panels(f"select {KEEP} from bars_walk"))
def b01(spark, path):
    odd = tables.bars_walk(spark, path).withColumnsRenamed({"symbol": "Symbol", "date": "DateTime", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume"})
    return clean.normalize_bars(odd)


@query("B02_coerce", with_panels("select symbol, date, case when volume % 5 <> 0 then close end as close from bars_walk"))
def b02(spark, path):
    bars = tables.bars_walk(spark, path).withColumn("close", F.when(F.col("volume") % 5 == 0, "n/a").otherwise(F.col("close").cast("string")))
    return clean.coerce(bars, ["close"]).select("symbol", "date", "close")


@query("B03_default_ohlcv", with_panels("select symbol, date, close as open, close as high, close as low, close, cast(0 as bigint) as volume from bars_walk"))
def b03(spark, path):
    return clean.default_ohlcv(tables.bars_walk(spark, path).select("symbol", "date", "close"))


@query("B04_ffill", with_panels("select symbol, date, last_value(case when volume % 4 <> 0 then close end ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as close from bars_walk"))
def b04(spark, path):
    bars = tables.bars_walk(spark, path).withColumn("close", F.when(F.col("volume") % 4 != 0, F.col("close")))
    return clean.ffill(bars, "close").select("symbol", "date", "close")


@query("B05_drop_warmup", with_panels(f"select symbol, date, round(m, 4) as sma50 from (select *, avg(close) {over(50)} as m, count(*) {over(50)} as n from bars_walk) where n >= 50"))
def b05(spark, path):
    return clean.drop_warmup(ind.sma(tables.bars_walk(spark, path), 50, "sma50"), ["sma50"]).select("symbol", "date", F.round("sma50", 4).alias("sma50"))


@query("B06_normalize_symbol", "select s_suppkey, upper('s ' || s_suppkey || ' x') as symbol from supplier")
def b06(spark, path):
    raw = F.concat(F.lit("﻿ s  "), F.col("s_suppkey").cast("string"), F.lit("\t​x "))
    return tables.table(spark, path, "supplier").select("s_suppkey", clean.normalize_symbol(raw).alias("symbol"))


@query("B07_safe_float", "select s_suppkey, case when s_suppkey % 4 = 0 then s_acctbal end as value from supplier")
def b07(spark, path):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.col("s_acctbal").cast("string")).when(k == 1, "n/a").when(k == 2, " ").otherwise("None")
    return tables.table(spark, path, "supplier").select("s_suppkey", clean.safe_float(raw).alias("value"))


@query("B08_clean_date", "select o_orderkey, case when o_orderkey % 4 = 0 then cast(o_orderdate as date) end as day from orders")
def b08(spark, path):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_orderdate").cast("string")).when(k == 1, "0000-00-00").when(k == 2, "1850-01-01").otherwise("soon")
    return tables.table(spark, path, "orders").select("o_orderkey", clean.clean_date(raw).alias("day"))


@query("B09_coalesce_finite", with_panels("select symbol, report_date, coalesce(ebitda, ebit) as profit from fundamentals"))
def b09(spark, path):
    first = F.when(F.col("ebitda").isNull(), F.lit(float("inf"))).otherwise(F.col("ebitda"))
    return tables.fundamentals(spark, path).select("symbol", "report_date", clean.coalesce_finite(F.lit(float("nan")), first, F.col("ebit")).alias("profit"))


@query("B10_price_band", with_panels("select symbol, date, close, CountryName from bars_walk join listings using (symbol) where (CountryName = 'ASIA' and close between 900 and 1100) or (CountryName = 'EUROPE' and close between 1000 and 1500)"))
def b10(spark, path):
    bands = spark.createDataFrame([("ASIA", 900.0, 1100.0), ("EUROPE", 1000.0, 1500.0)], "CountryName string, lo double, hi double")
    rows = tables.bars_walk(spark, path).join(tables.listings(spark, path).select("symbol", "CountryName"), "symbol")
    return clean.price_band(rows, bands).select("symbol", "date", "close", "CountryName")


@query("B11_filter_microcaps", with_panels("select symbol, report_date, MarketCapitalization from fundamentals where MarketCapitalization >= 2e6"))
def b11(spark, path):
    return clean.filter_microcaps(tables.fundamentals(spark, path), 2.0).select("symbol", "report_date", "MarketCapitalization")


REGION_CURRENCIES = {"AMERICA": "USD", "ASIA": "INR", "EUROPE": "EUR", "AFRICA": "HKD", "MIDDLE EAST": "HKD"}


@query("B12_native_currency", with_panels("select symbol, CountryName, currency from listings where currency is not null"))
def b12(spark, path):
    return clean.native_currency(tables.listings(spark, path), REGION_CURRENCIES).select("symbol", "CountryName", "currency")


@query("B13_fresh", with_panels("select symbol, report_date from fundamentals where report_date >= date '1996-06-30' - 300"))
def b13(spark, path):
    return clean.fresh(tables.fundamentals(spark, path), 300, "1996-06-30").select("symbol", "report_date")


@query("B14_universe", "select cast(p_partkey // 2 as varchar) || '.' || case when p_partkey // 2 % 3 = 0 then 'US' else 'HK' end as symbol, arg_min(p_name, p_partkey) as name, arg_min('I' || p_partkey, p_partkey) as isin, 'ADR' as type from part where p_partkey % 2 = 0 and (p_partkey // 2) % 3 <> 1 group by p_partkey // 2")
def b14(spark, path):
    k = F.col("p_partkey")
    half, odd = F.floor(k / 2), k % 2 == 1
    venue = F.when(half % 3 == 0, "US").when(half % 3 == 1, "XX").otherwise("HK")
    rows = tables.table(spark, path, "part").select(half.cast("string").alias("code"), F.col("p_name").alias("name"), F.concat(F.lit("I"), k.cast("string")).alias("isin"), F.when(odd, "ETF").otherwise("ADR").alias("type"), venue.alias("venue"), k.alias("ord"))
    return clean.universe(rows, ["US", "HK"])


VALIDATE = """select symbol, n as n_bars, case when n < 500 then 'too_few' when max(case when back <= greatest(5, floor(n / 5)) and volume % 97 = 0 then 1 else 0 end) = 1 then 'missing'
  when max(case when back <= greatest(5, floor(n / 5)) and volume % 97 <> 0 and least(open, high, low, close) - 700 <= 0 then 1 else 0 end) = 1 then 'nonpositive' else 'ok' end as reason
from (select *, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by date desc) as back from bars_walk) group by symbol, n"""


@query("B15_validate_bars", with_panels(VALIDATE))
def b15(spark, path):
    hole = F.col("volume") % 97 == 0
    bars = tables.bars_walk(spark, path).select("symbol", "date", *(F.when(~hole, F.col(c) - 700).alias(c) for c in ("open", "high", "low", "close")), "volume")
    return clean.validate_bars(bars, 500)


@query("B16_fill_for_sink", with_panels("select symbol, case when currency is null then 'Unknown' else CountryName end as CountryName, case when currency is null then 0.0 else 1.5 end as score, case when currency is null then 0 else 1 end as flag from listings"))
def b16(spark, path):
    gone = F.col("currency").isNull()
    rows = tables.listings(spark, path).select("symbol", F.when(gone, "  ").otherwise(F.col("CountryName")).alias("CountryName"), F.when(~gone, F.lit(1.5)).alias("score"), F.when(~gone, F.lit(True)).alias("flag"))
    return clean.fill_for_sink(rows, ["CountryName"], ["score"], ["flag"])


@query("B18_country_of", with_panels("select symbol, case when length(w) < 2 then 'Invalid' else case substr(w, 1, 2) when 'US' then 'USA' when 'IN' then 'India' when 'BS' then 'India' when 'HK' then 'Hong Kong' else 'Unknown' end end as country from (select symbol, case CountryName when 'AMERICA' then 'US_all' when 'ASIA' then 'INnse' when 'EUROPE' then 'HK1' when 'AFRICA' then 'X' else 'ZZ9' end as w from listings)"))
def b18(spark, path):
    w = clean.lookup(F.col("CountryName"), {"AMERICA": "US_all", "ASIA": "INnse", "EUROPE": "HK1", "AFRICA": "X"}, F.lit("ZZ9"))
    return tables.listings(spark, path).select("symbol", clean.country_of(w).alias("country"))


@query("B19_sectors", with_panels("select symbol, s as sector, case s when 'Technology' then 'Sensitive' when 'Healthcare' then 'Defensive' else 'Unknown' end as sector_type from (select symbol, case substr(Sector, 1, 1) when 'A' then 'Technology' when 'C' then 'Healthcare' else Sector end as s from listings)"))
def b19(spark, path):
    first = F.substring("Sector", 1, 1)
    raw = F.when(first == "A", "Information Technology").when(first == "C", "Health Care").otherwise(F.col("Sector"))
    return tables.listings(spark, path).select("symbol", clean.sector_std(raw).alias("sector"), clean.sector_type(raw).alias("sector_type"))


@query("B20_ticker_code", "select s_suppkey, case when s_suppkey % 3 < 2 then lpad(cast(s_suppkey as varchar), 4, '0') else 'AB' end as code, case when s_suppkey % 3 < 2 then 'HK' else 'US' end as venue from supplier")
def b20(spark, path):
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("hkg:"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".HK"))).otherwise("ab")
    return tables.table(spark, path, "supplier").select("s_suppkey", clean.ticker_code(raw).alias("t")).select("s_suppkey", "t.code", "t.venue")


@query("C04_snapshot_listing", with_panels("select b.symbol, date, close, name, CountryName, Sector from bars_walk b left join listings l on b.symbol = l.symbol and l.CountryName <> 'ASIA'"))
def c04(spark, path):
    small = tables.listings(spark, path).filter("CountryName <> 'ASIA'").select("symbol", "name", "CountryName", "Sector")
    return tables.bars_walk(spark, path).select("symbol", "date", "close").join(small, "symbol", "left")


@query("C05_symbol_exchange", with_panels("select l.symbol, coalesce(case when currency is not null then 'X' || currency end, 'UNKNOWN') as exchange from listings l"))
def c05(spark, path):
    rows = tables.listings(spark, path)
    exchanges = rows.filter("currency is not null").select("symbol", F.concat(F.lit("X"), "currency").alias("exchange"))
    return ingest.country_exchange(rows.select("symbol"), exchanges)


@query("C06_not_scanned", with_panels("select symbol from listings where symbol not in (select symbol from bars_walk group by symbol having max(date) >= (select max(date) from bars_walk) - 2)"))
def c06(spark, path):
    """Symbols without a bar in the last two days of the panel."""
    last = tables.bars_walk(spark, path).groupBy("symbol").agg(F.max("date").alias("last"))
    now = last.agg(F.max("last")).first()[0]
    seen = last.filter(F.col("last") >= F.date_sub(F.lit(now), 2))
    return tables.listings(spark, path).select("symbol").join(seen, "symbol", "left_anti")


@query("C08_watchlist_bars", with_panels("select b.symbol, date, close from bars_walk b join (select distinct symbol from watchlist where watchlist = 'EUROPE') w on b.symbol = w.symbol"))
def c08(spark, path):
    return tables.bars_walk(spark, path).select("symbol", "date", "close").join(ingest.watchlist_members(tables.watchlist(spark, path), "EUROPE"), "symbol")


@query("C09_exact_date_pick", with_panels(f"select symbol, date, close from (select *, row_number() {OVER} as rn from bars_walk) where date = date '1996-03-10' - 10 and rn > 10"))
def c09(spark, path):
    """The bar exactly ten days before the as-of day, where ten bars lie before it."""
    bars = tables.bars_walk(spark, path).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    return bars.filter((F.col("date") == F.date_sub(F.to_date(F.lit("1996-03-10")), 10)) & (F.col("rn") > 10)).select("symbol", "date", "close")


