"""Windows over a symbol's bars and the exponential means built on them."""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def rows(n: int) -> WindowSpec:
    """The current bar and the n - 1 before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def full(c: Column, x: str | Column, n: int) -> Column:
    """c where the last n values of x are all there, else null."""
    return F.when(F.count(x).over(rows(n)) >= n, c)


def in_steps(df: DataFrame, *plans: list[dict[str, Column]]) -> DataFrame:
    """Adds the columns of several plans, each a list of steps (name: column) of which one may read the columns of those before it.
    The first steps of all plans are taken together, then the second ones, and so on: Spark copies each bar once a window
    operator, so what need not wait for one another shares one."""
    for steps in zip_longest(*plans, fillvalue={}):
        df = df.withColumns({name: column for step in steps for name, column in step.items()})
    return df


def last_extremes(c: Column, n: int, out: str) -> list[dict[str, Column]]:
    """Steps to out, the extremes (lo, hi) of c over the last n bars: of the last 6, of the last 36 from those of 6, and so on, so that
    their cost grows with the logarithm of n."""
    steps, width, now = [{out: F.struct(c.alias("lo"), c.alias("hi"))}], 1, F.col(out)
    while width < n:
        back = sorted({min(k * width, n - width) for k in range(1, 6)})
        at = [now, *(lag(out, k) for k in back)]
        both = lambda f, k, at=at: f(*(x[k] for x in at))
        steps.append({out: F.struct(both(F.least, "lo").alias("lo"), both(F.greatest, "hi").alias("hi"))})
        width = min(n, 6 * width)
    return steps


BLOCK = 4  # sums that a level of an exponential mean takes together; with 8 the code of wide panels grows too long for the JVM to compile
LEAST = 1e-100  # weight below which older bars are left out


def ewms(df: DataFrame, *means: tuple[Column, str, float]) -> DataFrame:
    """Adds a column y for each (x, y, alpha): y = x at its first value, then alpha * x + (1 - alpha) * y before. Nulls may
    only lead.

    Weighted sums of the last 4 bars are made first, of those that lie 4 bars apart the sums of the last 16, and so on, till
    the weight of what is older is below LEAST. The first value has its weight of 1 from the start, so means of any span begin
    with it to the bit. Each level is one window by symbol and date that reads earlier bars by lag, so all levels of all means
    keep the panel's one order: no other sort, no list, and no sum that grows with the history.
    """
    x, seen, y = ([f"__{k}{i}" for i in range(len(means))] for k in "xsy")
    q = [1.0 - alpha for _, _, alpha in means]
    df = df.withColumns({x[i]: m[0] for i, m in enumerate(means)})
    df = df.withColumns({s: F.count(c).over(so_far()) for s, c in zip(seen, x, strict=True)})
    weighted = lambda i: F.coalesce(F.when(F.col(seen[i]) == 1, F.col(x[i])).otherwise(F.col(x[i]) * means[i][2]), F.lit(0.0))
    df, span = df.withColumns({y[i]: weighted(i) for i in range(len(means))}), 1
    while left := [i for i in range(len(means)) if q[i] ** span > LEAST]:
        # The sums of all means at an earlier bar are read together.
        back = {f"__b{k}": k * span for k in range(1, BLOCK) if any(q[i] ** (k * span) > LEAST for i in left)}
        df = df.withColumns({b: F.lag(F.struct(*(y[i] for i in left)), n).over(by_symbol()) for b, n in back.items()})
        older = lambda i: [F.coalesce(F.col(f"{b}.{y[i]}"), F.lit(0.0)) * q[i] ** n for b, n in reversed(back.items()) if q[i] ** n > LEAST]  # noqa: E731, B023
        df, span = df.withColumns({y[i]: reduce(Column.__add__, [*older(i), F.col(y[i])]) for i in left}).drop(*back), span * BLOCK
    df = df.withColumns({m[1]: F.when(F.col(x[i]).isNotNull(), F.col(y[i])) for i, m in enumerate(means)})
    return df.drop(*x, *seen, *y)


def ewm(df: DataFrame, x: Column, out: str, alpha: float) -> DataFrame:
    return ewms(df, (x, out, alpha))


def ema(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return ewm(df, F.col(x), out, 2.0 / (n + 1))


def emas(df: DataFrame, x: str, *spans: int) -> DataFrame:
    """ema{n} for each of the spans."""
    return ewms(df, *((F.col(x), f"ema{n}", 2.0 / (n + 1)) for n in spans))


def rma(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return ewm(df, F.col(x), out, 1.0 / n)
