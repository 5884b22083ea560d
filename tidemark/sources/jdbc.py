"""Bars from a database table by JDBC, read in ranges of days at once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Our names by those of the table.
COLUMNS = {c: c for c in ("symbol", "date", "open", "high", "low", "close", "volume")}


def bars_jdbc(spark: SparkSession, url: str, table: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, parts: int = 16, columns: dict[str, str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Bars of some symbols, or of all, of the days from start to end (both included, the table's own first and last day where
    not given).

    `parts` tasks read a range of days each, so no connection carries the whole table; filters on symbol and day are run
    by the database, and only the columns of a bar are fetched. columns: the table's name of each column of a bar. A table without rows
    gives no bars; rows without a day are read by the first task.
    """
    names = COLUMNS | (columns or {})
    base = {"url": url, "fetchsize": "10000"} | (options or {})
    rows = spark.read.format("jdbc").options(**base)
    day = names["date"]
    if start is None or end is None:
        own = rows.option("dbtable", table).load().agg(F.min(day), F.max(day)).first()  # the database sums
        start, end = start or str(own[0] or date.today()), end or str(own[1] or date.today())
    stop = str(date.fromisoformat(str(end)[:10]) + timedelta(days=1))
    ranged = rows.option("dbtable", table).option("partitionColumn", day).option("lowerBound", start).option("upperBound", stop).option("numPartitions", str(parts)).load()
    kept = ranged.filter(F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if symbols is not None:
        kept = kept.filter(F.col(names["symbol"]).isin(symbols))
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
