"""Labels and features for models: barriers, forward returns, pseudo-labels, scaling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol


def lead(c: str, n: int) -> Column:
    return F.lead(c, n).over(by_symbol())


def _ahead(name: str, n: int) -> Column:
    """The next n values, as an array without nulls."""
    return F.collect_list(name).over(by_symbol().rowsBetween(1, n))


def over(a: Column, b: Column) -> Column:
    """a / b by the rules of IEEE, as the SQL engines have it: over 0 it is infinite with the sign of a, or NaN where a is 0."""
    return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))).otherwise(F.try_divide(a, b))


def triple_barrier(df: DataFrame, horizon: int = 10, target: float = 0.08, stop: float = 0.06) -> DataFrame:
    """label_success, realized_return, max/min_future_return, days_to_target, stop_hit, future_bars.

    The first of the next bars whose high reaches the target or whose low reaches the stop decides, the target on a tie; if
    neither does, the horizon's highest close does. Rows without any bar ahead have nulls. Returns on a close of 0 are infinite, or
    NaN where the later close is 0 too."""
    df = df.withColumn("__h", _ahead("high", horizon)).withColumn("__l", _ahead("low", horizon)).withColumn("__c", _ahead("close", horizon))
    p = F.col("close")
    hit = lambda arr, ok: F.nullif(F.array_position(F.transform(arr, ok), True), F.lit(0)).cast("int")
    df = df.withColumn("__t", hit(F.col("__h"), lambda x: x >= p * (1 + target))).withColumn("__s", hit(F.col("__l"), lambda x: x <= p * (1 - stop)))
    n = F.size("__c")
    won = F.col("__t").isNotNull() & (F.col("__s").isNull() | (F.col("__t") <= F.col("__s")))
    lost = F.col("__s").isNotNull() & ~won
    top, low = over(F.array_max("__c"), p) - 1, over(F.array_min("__c"), p) - 1
    at = F.when(won, F.col("__t")).when(lost, F.col("__s")).otherwise(n)
    some = n > 0
    df = df.withColumn("future_bars", n).withColumn("label_success", F.when(some, F.when(won, 1).when(lost, 0).otherwise((top >= target).cast("int"))))
    df = df.withColumn("realized_return", F.when(some, over(F.try_element_at("__c", at), p) - 1)).withColumn("max_future_return", top).withColumn("min_future_return", low)
    return df.withColumn("days_to_target", F.when(won, F.col("__t"))).withColumn("stop_hit", F.when(some, lost.cast("int"))).drop("__h", "__l", "__c", "__t", "__s")


def atr_barrier(df: DataFrame, side: int | Column, bars: int = 10, target: float = 1.5, stop: float = 1.0) -> DataFrame:
    """outcome: 1 where the target (in ATR) is reached on an earlier bar than the stop, else 0; null without two bars ahead. side is 1
    for a rise or -1 for a fall, or a column of either."""
    df = df.withColumn("__h", _ahead("high", bars)).withColumn("__l", _ahead("low", bars))
    p = F.col("close")
    a = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.greatest(F.lit(1e-8), p * 0.01))
    hit = lambda arr, ok: F.nullif(F.array_position(F.transform(arr, ok), True), F.lit(0))
    up = lambda m: hit(F.col("__h"), lambda x: x >= p + m * a)
    down = lambda m: hit(F.col("__l"), lambda x: x <= p - m * a)
    by_side = lambda rise, fall: F.when(side == 1, rise).otherwise(fall) if isinstance(side, Column) else rise if side == 1 else fall
    t, s = by_side(up(target), down(target)), by_side(down(stop), up(stop))
    won = t.isNotNull() & (s.isNull() | (t < s))
    return df.withColumn("outcome", F.when(F.size("__h") >= 2, won.cast("int"))).drop("__h", "__l")


def pseudo_labels(df: DataFrame) -> DataFrame:
    """label: sign of the next day's return (zero carries the one before on, as does none, 0 over 0) times the quartile of its
    size, by symbol."""
    df = df.withColumn("__r", over(lead("close", 1), F.col("close")) - 1).filter("__r is not null")
    w = Window.partitionBy("symbol")
    sign = F.last(F.when((F.col("__r") != 0) & ~F.isnan("__r"), F.signum("__r")), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__a", F.abs("__r")).withColumn("__q", F.expr("percentile(abs(__r), array(0.25, 0.5, 0.75))").over(w)).withColumn("__sg", sign)
    a, q = F.col("__a"), F.col("__q")
    strength = F.when(a <= q[0], 1).when(a <= q[1], 2).when(a <= q[2], 3).otherwise(4)
    return df.withColumn("label", (F.col("__sg") * strength).cast("int")).drop("__r", "__a", "__q", "__sg")


def forward_targets(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    return df.withColumns({f"close_in_{n}": lead("close", n) for n in horizons})


def forward_label(df: DataFrame, bars: int = 5, least: float = 0.005) -> DataFrame:
    r = (lead("close", bars) - F.col("close")) / (F.col("close") + 1e-9)
    return df.withColumn("label", (r > least).cast("int"))


def is_train(key: Column, parts: int = 5) -> Column:
    """True for all but one of `parts` hash classes of key: the same split on every run."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint"), F.lit(parts)) != 0


BLOCK_BITS = 16  # 65,536 ranges of hashes that a class's rows are counted by


def stratified_split(df: DataFrame, label: str, key: Column, share: float = 0.8) -> DataFrame:
    """train: true for the first floor(share * n) of each class's n rows, by the order of a hash of key.

    The split is the same on every run and exact in each class. Hashes are even, so a class is counted by equal ranges of
    them, and only rows of the range that the share ends in are counted one by one: what is found is the last hash of
    each class that trains, and no row is shuffled. Rows with equal keys go to one side together; rows without a label
    have no side. df is read three times.
    """
    order = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")  # 60 bits
    rows = df.withColumn("__hash", order)
    some = rows.filter(F.col(label).isNotNull()).select(F.col(label).alias("__label"), F.col("__hash").alias("__at"), F.shiftright("__hash", 60 - BLOCK_BITS).alias("__block"))
    counts = some.groupBy(F.col("__label").alias("__of"), F.col("__block").alias("__in")).agg(F.count("*").alias("__n"))
    before = lambda by, *at: F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__below": before("__of", "__in"), "__cut": F.floor(F.sum("__n").over(Window.partitionBy("__of")) * share)})  # 65,536 rows a class
    cuts = counts.filter("__below < __cut and __cut <= __below + __n").drop("__n")  # a row a class
    inside = some.join(F.broadcast(cuts), (F.col("__label") == F.col("__of")) & (F.col("__block") == F.col("__in"))).groupBy("__label", "__at", "__below", "__cut").agg(F.count("*").alias("__n"))
    last = inside.withColumn("__below", F.col("__below") + before("__label", "__at")).filter("__below < __cut").groupBy("__label").agg(F.max("__at").alias("__last"))
    split = rows.join(F.broadcast(last), F.col(label) == F.col("__label"), "left")
    return split.withColumn("train", F.when(F.col(label).isNotNull(), F.coalesce(F.col("__hash") <= F.col("__last"), F.lit(False)))).drop("__hash", "__label", "__last")


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, deviation): of the population, nulls as 0; a deviation of 0 or none is 1."""
    each = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("deviation")) for c, x in ((c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns)]
    return df.agg(F.array(*each).alias("all")).select(F.inline("all"))


def scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """columns less their mean over their population deviation, both of the training rows; nulls count as 0."""
    df = df.na.fill(0.0, subset=columns)
    fit = {r["feature"]: r for r in scaling(df.filter(train), columns).collect()}  # two numbers a column
    return df.withColumns({c: (F.col(c) - F.lit(fit[c]["mean"])) / F.lit(fit[c]["deviation"]) for c in columns})


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """part: train for the first share of each symbol's bars, test for the rest."""
    w = Window.partitionBy("symbol")
    return df.withColumn("part", F.when(F.row_number().over(by_symbol()) <= F.floor(F.count("*").over(w) * share), "train").otherwise("test"))
