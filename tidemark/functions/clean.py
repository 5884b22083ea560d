"""Cleaning of columns: names, numbers, symbols, dates, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import so_far

#: Spellings of the bars' columns, currencies, countries by watchlist prefix, minimum caps (millions).
ALIASES = {
    "date": ("Date", "date", "DateTime", "datetime", "Datetime"), "open": ("Open", "open"), "high": ("High", "high"),
    "low": ("Low", "low"), "close": ("Close", "close", "Adj Close"), "volume": ("Volume", "volume"), "symbol": ("Symbol", "symbol"),
}
NULL_TOKENS = ("", "N/A", "NA", "NONE")
COUNTRY_BY_PREFIX = {"US": "USA", "IN": "India", "BS": "India", "HK": "Hong Kong"}
CURRENCY_BY_COUNTRY = {"USA": "USD", "India": "INR", "Hong Kong": "HKD"}
MIN_CAP_MLN = {"USA": 2.0, "India": 160.0, "Hong Kong": 15.0}
SECTOR_TYPES = {
    "Technology": "Sensitive", "Communication Services": "Sensitive", "Energy": "Sensitive", "Industrials": "Sensitive",
    "Basic Materials": "Cyclical", "Consumer Cyclical": "Cyclical", "Financial Services": "Cyclical", "Real Estate": "Cyclical",
    "Consumer Defensive": "Defensive", "Healthcare": "Defensive", "Utilities": "Defensive",
}
HOUSE_SECTORS = {
    "Information Technology": "Technology", "Health Care": "Healthcare", "Financials": "Financial Services", "Materials": "Basic Materials",
    "Consumer Discretionary": "Consumer Cyclical", "Consumer Staples": "Consumer Defensive",
}


def lookup(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]
    return found if default is None else F.coalesce(found, default)


def normalize_bars(df: DataFrame) -> DataFrame:
    """One spelling of the bars' columns, the first alias that is there."""
    have = {c: c for c in df.columns}
    names = {next(a for a in aliases if a in have): name for name, aliases in ALIASES.items() if any(a in have for a in aliases)}
    return df.withColumnsRenamed(names)


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; text that is no number, and NaN, as null."""
    return df.withColumns({c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in columns})


def default_ohlcv(df: DataFrame) -> DataFrame:
    """Columns that are not there: prices from close, volume 0."""
    missing = {c: F.col("close") for c in ("open", "high", "low") if c not in df.columns}
    return df.withColumns(missing | ({} if "volume" in df.columns else {"volume": F.lit(0).cast("bigint")}))


def ffill(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.last(c, ignorenulls=True).over(so_far()))


def drop_warmup(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def normalize_symbol(c: Column) -> Column:
    """Upper case, without zero-width characters and byte-order marks, white space runs as one space."""
    plain = F.translate(c, "\u200b\u200c\u200d\ufeff", "")
    return F.upper(F.trim(F.regexp_replace(F.translate(plain, "\u00a0", " "), r"\s+", " ")))


def safe_float(c: Column) -> Column:
    text = F.upper(F.trim(c.cast("string")))
    return F.when(~text.isin(*NULL_TOKENS), F.nullif(text.try_cast("double"), F.lit(float("nan"))))


def clean_date(c: Column) -> Column:
    """A day from the year 1900 on, else null."""
    day = F.try_to_date(F.substring(F.trim(c.cast("string")), 1, 10), "yyyy-MM-dd")
    return F.when(F.year(day) >= 1900, day)


def coalesce_finite(*columns: Column) -> Column:
    """The first that is a finite number."""
    return F.coalesce(*[F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c) for c in columns])


def price_band(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows whose price (TodayPrice, else close) lies in their country's band, both ends included; bands are a few rows
    (CountryName, lo, hi)."""
    price = F.coalesce(F.col("TodayPrice"), F.col("close")) if "TodayPrice" in df.columns else F.col("close")
    return df.join(F.broadcast(bands), "CountryName").filter(price.between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def filter_microcaps(df: DataFrame, mln: float) -> DataFrame:
    return df.filter(F.col("MarketCapitalization") >= mln * 1e6)


def native_currency(df: DataFrame, currencies: dict[str, str] | None = None) -> DataFrame:
    """Rows reported in the currency of their country, whatever its case; countries not in the list pass."""
    known = CURRENCY_BY_COUNTRY if currencies is None else currencies
    want = lookup(F.lower(F.trim("CountryName")), {k.lower(): v for k, v in known.items()})
    return df.filter(want.isNull() | (F.upper(F.trim(F.coalesce("currency", F.lit("")))) == want))


def fresh(df: DataFrame, days: int, asof: str) -> DataFrame:
    return df.filter(F.col("report_date") >= F.date_sub(F.to_date(F.lit(asof)), days))


def universe(df: DataFrame, venues: list[str]) -> DataFrame:
    """Common stock and receipts with an ISIN on some venues, as code.exchange, the first of each."""
    kept = df.filter(F.col("type").isin("Common Stock", "ADR") & F.col("isin").isNotNull() & F.col("venue").isin(venues))
    named = kept.withColumn("symbol", F.concat("code", F.lit("."), "venue"))
    return named.groupBy("symbol").agg(F.min_by(F.struct("name", "isin", "type"), "ord").alias("r")).select("symbol", "r.*")


def fill_for_sink(df: DataFrame, texts: list[str], numbers: list[str], booleans: list[str]) -> DataFrame:
    """Blank texts as Unknown, missing numbers as 0, booleans as 0 or 1."""
    changed = {c: F.when(F.trim(F.col(c)) == "", None).otherwise(F.col(c)) for c in texts}
    out = df.withColumns({c: F.coalesce(x, F.lit("Unknown")) for c, x in changed.items()}).na.fill(0, subset=numbers)
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in booleans})


def country_of(c: Column) -> Column:
    known = lookup(F.upper(F.substring(c, 1, 2)), COUNTRY_BY_PREFIX, F.lit("Unknown"))
    return F.when(F.length(c) < 2, "Invalid").otherwise(F.coalesce(known, F.lit("Unknown")))


def sector_std(c: Column) -> Column:
    return lookup(c, HOUSE_SECTORS, c)


def sector_type(c: Column) -> Column:
    return lookup(sector_std(c), SECTOR_TYPES, F.lit("Unknown"))


def ticker_code(c: Column) -> Column:
    """(code, venue): HKG:n and n.HK as four digits of Hong Kong; digits alone too; letters as they are, of the US."""
    up = F.upper(F.trim(c))
    digits = F.regexp_extract(up, r"(\d+)", 1)
    hk = up.rlike(r"^HKG:\d+$") | up.rlike(r"^\d+\.HK$") | up.rlike(r"^\d+$")
    code = F.when(hk, F.lpad(F.regexp_replace(digits, "^0+", ""), 4, "0")).otherwise(F.regexp_replace(up, r"\..*$", ""))
    venue = F.when(hk, "HK").when(up.rlike(r"^[A-Z]+$"), "US").otherwise(F.regexp_extract(up, r"\.([A-Z]+)$", 1))
    return F.struct(code.alias("code"), venue.alias("venue"))


def snapshot_columns(df: DataFrame) -> DataFrame:
    """The snapshot's names: upper-case indicators; missing ATR, ADX and band width as 0."""
    return df.select(
        F.col("symbol").alias("Symbol"), F.col("date").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume"),
        *(F.col(x).alias(x.upper()) for x in ("rsi", "ema20", "ema50", "ema200", "sma50", "sma200", "macd")),
        F.coalesce("atr", F.lit(0.0)).alias("ATR"), F.coalesce("adx", F.lit(0.0)).alias("ADX"), F.coalesce("bb_width", F.lit(0.0)).alias("BB_width"),
        F.col("plus_di").alias("DIPLUS"), F.col("minus_di").alias("DIMINUS"), F.col("di_trend").alias("DITrend"),
    )


def validate_bars(df: DataFrame, least: int = 60) -> DataFrame:
    """(symbol, n_bars, reason): ok, too_few, missing or nonpositive; the last max(5, n / 5) bars are looked at."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol")
    df = df.withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("date"))))
    recent = F.col("back") <= F.greatest(F.lit(5), F.floor(F.col("n") / 5))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.greatest(*[c.isNull().cast("int") for c in [*prices, F.col("volume")]]) == 1
    low = F.least(*prices) <= 0
    out = df.groupBy("symbol").agg(F.max("n").alias("n_bars"), F.max((recent & missing).cast("int")).alias("bad_null"), F.max(F.coalesce(recent & low, F.lit(False)).cast("int")).alias("bad_price"))
    reason = F.when(F.col("n_bars") < least, "too_few").when(F.col("bad_null") == 1, "missing").when(F.col("bad_price") == 1, "nonpositive").otherwise("ok")
    return out.select("symbol", "n_bars", reason.alias("reason"))
