"""Landed JSON and keyed tables: candles, statements, option chains; upserts, conforming, dated outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARRAYS = "s string, t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<bigint>"
RECORDS = "array<struct<date string, open double, high double, low double, close double, adjusted_close double, volume bigint>>"


def candles_from_arrays(df: DataFrame) -> DataFrame:
    """Bars from (symbol, body): parallel arrays of a status-ok answer; incomplete bars go."""
    j = df.select("symbol", F.from_json("body", ARRAYS).alias("j")).filter("j.s = 'ok'")
    rows = j.select("symbol", F.explode(F.arrays_zip("j.t", "j.o", "j.h", "j.l", "j.c", "j.v")).alias("b"))
    out = rows.select("symbol", F.to_date(F.timestamp_seconds("b.t")).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"))
    return out.na.drop()


def candles_from_records(df: DataFrame) -> DataFrame:
    """Bars from (symbol, body): an array of records; the adjusted close is not kept; incomplete bars go."""
    rows = df.select("symbol", F.explode(F.from_json("body", RECORDS)).alias("b")).select("symbol", "b.*")
    return rows.select("symbol", F.to_date("date").alias("date"), "open", "high", "low", "close", "volume").na.drop()


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """base with delta's rows in place of those with equal keys, and added where there are none.

    Of delta's rows with equal keys that with the greatest `order` columns wins, then the one with the greatest other
    columns, so the result does not depend on how rows arrive. Null keys are equal. Only delta is sorted; base is
    anti-joined by key, so a small delta does not shuffle it.
    """
    rest = [c for c in base.columns if c not in (*keys, *order)]
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in (*order, *rest, *([] if order or rest else keys)))))
    last = delta.select(base.columns).withColumn("__n", newest).filter("__n = 1").drop("__n")
    gone = last.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return base.join(gone, same, "left_anti").unionByName(last)


def statements_from_maps(df: DataFrame, fields: dict[str, list[str]], quarters: int = 6) -> DataFrame:
    """Statements from (symbol, last_close, one JSON map of report date to record a key of fields), merged on the date; the
    newest quarters, the price on the newest only."""
    merged = None
    for key, names in fields.items():
        kind = "map<string, struct<" + ", ".join(f"{n}: double" for n in names) + ">>"
        part = df.select("symbol", F.explode(F.from_json(key, kind)).alias("d", "r")).select("symbol", F.to_date("d").alias("report_date"), *(F.col(f"r.{n}").alias(n) for n in names))
        merged = part if merged is None else merged.join(part, ["symbol", "report_date"], "full")
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("report_date")))
    out = merged.withColumn("back", back).filter(F.col("back") <= quarters).join(df.select("symbol", F.col("last_close").alias("__px")), "symbol", "left")
    return out.withColumn("last_close", F.when(F.col("back") == 1, F.col("__px"))).drop("back", "__px")


def merge_buckets(df: DataFrame, fields: list[str], order: tuple[str, ...] = ("ic", "bs", "cf")) -> DataFrame:
    """One row a report from rows by bucket: each field's first value in the order of buckets."""
    seq = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("bucket"))
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields]
    return df.groupBy("symbol", "report_date").agg(*first)


def attach_series(statements: DataFrame, series: DataFrame) -> DataFrame:
    """statements with the columns ev (given in millions) and others of series (symbol, key, body): arrays of period and v."""
    rows = series.select("symbol", "key", F.explode(F.from_json("body", "array<struct<period: string, v: double>>")).alias("p"))
    value = F.when(F.col("key") == "ev", F.col("p.v") * 1e6).otherwise(F.col("p.v"))
    wide = rows.select("symbol", F.to_date("p.period").alias("report_date"), "key", value.alias("v")).groupBy("symbol", "report_date").pivot("key", ["ev", "roicTTM"]).agg(F.max("v"))
    return statements.join(wide, ["symbol", "report_date"], "left")


def with_fallback(statements: DataFrame, profile: DataFrame) -> DataFrame:
    """statements, and a profile row for each symbol that has none."""
    return statements.unionByName(profile.join(statements.select("symbol").distinct(), "symbol", "left_anti"), allowMissingColumns=True)


def watchlist_members(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("watchlist") == name).select("symbol").distinct()


def last_n_bars(df: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return df.withColumn("__back", back).filter(F.col("__back") <= n).drop("__back")


def read_snapshot(df: DataFrame, country: str | None = None, limit: int | None = None) -> DataFrame:
    """Snapshot rows of countries that contain the text, newest scan first."""
    if country:
        df = df.filter(F.col("CountryName").contains(country))
    df = df.orderBy(F.desc("ScanDate"), "Symbol")
    return df if limit is None else df.limit(limit)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, in its order; missing ones are null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Writes df, replacing only the partitions of column that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def update_join(base: DataFrame, scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with columns taken from scores where keys meet."""
    new = scores.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def refresh_watchlists(listing: DataFrame, top: int = 100) -> DataFrame:
    """(watchlist, tier, symbol, place): the best of tier 1, and all by rank within their tier."""
    place = F.row_number().over(Window.partitionBy("watchlist", "tier").orderBy(F.asc_nulls_last("GEM_Rank"), "symbol"))
    cols = ["symbol", F.col("GEM_Data_Tier").alias("tier"), "GEM_Rank"]
    best = listing.filter("GEM_Data_Tier = 1 and GEM_Rank is not null").orderBy("GEM_Rank", "symbol").limit(top).select(F.lit("tier1_top").alias("watchlist"), *cols)
    every = listing.select(F.lit("all_ranked").alias("watchlist"), *cols)
    return best.unionByName(every).withColumn("place", place).drop("GEM_Rank")


def write_run(df: DataFrame, path: str, run_ts: str) -> None:
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest run; the folder names tell it, so older runs are not scanned."""
    runs = spark.read.parquet(path)
    newest = runs.select("run_ts").distinct().agg(F.max(F.col("run_ts").cast("string"))).first()[0]
    return runs.filter(F.col("run_ts").cast("string") == F.lit(newest))


def export_topk(df: DataFrame, by: Column, tie: str, k: int, path: str, kind: str = "parquet") -> None:
    top = df.orderBy(by, tie).limit(k)
    (top.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else top.write.mode("overwrite").parquet(path))


CHAIN = "struct<data: array<struct<expirationDate: string, options: map<string, array<struct<contractName: string, strike: double, lastPrice: double, expirationType: string>>>>>>"


def option_contracts(df: DataFrame, side: str, expiry: str, asof: str, lo: int, hi: int) -> DataFrame:
    """Contracts of one side and expiry kind, lo to hi days ahead, at whole or half strikes, from (symbol, body)."""
    data = df.select("symbol", F.explode(F.from_json("body", CHAIN)["data"]).alias("d"))
    rows = data.select("symbol", F.to_date("d.expirationDate").alias("expiry"), F.explode(F.col("d.options")[side]).alias("o")).select("symbol", "expiry", "o.*")
    dte = F.datediff("expiry", F.to_date(F.lit(asof)))
    kept = rows.withColumn("dte", dte).filter((F.col("expirationType") == expiry) & F.col("dte").between(lo, hi) & (F.col("strike") % 1).isin(0.0, 0.5))
    return kept.select("symbol", F.col("contractName").alias("contract"), "expiry", "strike", F.col("lastPrice").alias("last_price"), "dte")


def unpivot_metrics(df: DataFrame) -> DataFrame:
    """(symbol, metric, value) from (symbol, body): a JSON map."""
    return df.select("symbol", F.explode(F.from_json("body", "map<string, double>")).alias("metric", "value"))


def country_exchange(df: DataFrame, exchanges: DataFrame) -> DataFrame:
    """df with its symbols' exchange, UNKNOWN where there is none."""
    return df.join(exchanges, "symbol", "left").withColumn("exchange", F.coalesce("exchange", F.lit("UNKNOWN")))
