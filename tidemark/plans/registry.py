"""All registered queries of the panel library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query (spark, path) and the SQL whose rows it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemark.plans import indicators, ingest, labels, models, ranking, scores, streams, trends  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


#: The panels as CTEs, for SQL that knows the base tables only.
_NAMES = dict.fromkeys(("lineitem", "supplier", "nation", "region", "events", "bars_raw", "listings"))
CTES = ", ".join(
    f"{name} as ({text.format(**{n: n for n in _NAMES})})"
    for name, text in (("bars_raw", tables.BARS_RAW), ("bars_walk", tables.BARS_WALK), ("listings", tables.LISTINGS), ("fundamentals", tables.FUNDAMENTALS), ("watchlist", tables.WATCHLIST), ("ticks", tables.TICKS))
)


HELD = "/* read twice */ "  # a CTE whose text begins so is materialized


def with_panels(sql: str, *more: tuple[str, str]) -> str:
    """sql after the panels and further CTEs (name, text)."""
    return "with " + ", ".join([CTES, *(f"{n} as {'materialized ' * t.startswith(HELD)}({t})" for n, t in more)]) + " " + sql


class Chain:
    """CTEs c0, c1, ... each adding columns to the one before; the windows below are written into them."""

    def __init__(self, source: str, named: tuple[tuple[str, str], ...] = ()):
        self.steps, self.last = list(named), source

    def add(self, *columns: str, where: str = "") -> Chain:
        out = Chain(f"c{len(self.steps)}", tuple(self.steps))
        out.steps.append((out.last, f"select *, {', '.join(columns)} from {self.last}" + (f" where {where}" if where else "")))
        return out

    def held(self) -> Chain:
        """The last step as a table of its own, for steps that read it twice."""
        out = Chain(f"c{len(self.steps)}", tuple(self.steps))
        out.steps.append((out.last, f"{HELD}select * from {self.last}"))
        return out

    def ewm(self, x: str, name: str, alpha: float) -> Chain:
        """The exponential mean from the first value of x on: the recurrence itself, folded over each symbol's values."""
        q, a = 1 - alpha, self.add(f"{x} as x_{name}").held()
        f, out = Chain(f"f{len(a.steps)}", tuple(a.steps)), Chain(f"c{len(a.steps) + 1}", tuple(a.steps))
        fold = f"list_reduce(list_transform(list(x_{name} order by date), lambda v: [v]), lambda y, v: list_append(y, y[-1] * cast({q!r} as double) + v[1] * cast({alpha!r} as double)))"
        out.steps.append((f.last, f"select symbol, unnest(list(date order by date)) as date, unnest({fold}) as y from (select symbol, date, cast(x_{name} as double) as x_{name} from {a.last}) where x_{name} is not null group by symbol"))
        out.steps.append((out.last, f"select a.*, f.y as {name} from {a.last} a left join {f.last} f on a.symbol = f.symbol and a.date = f.date"))
        return out

    def at(self, index: str, **values: str) -> Chain:
        """Values of the same symbol's bar number `index` (an expression of a)."""
        held = self.held()
        out = Chain(f"c{len(held.steps)}", tuple(held.steps))
        picked = ", ".join(f"b.{c} as {n}" for n, c in values.items())
        out.steps.append((out.last, f"select a.*, {picked} from {held.last} a left join {held.last} b on a.symbol = b.symbol and b.idx = {index}"))
        return out

    def island(self, sign: str, name: str) -> Chain:
        """Signed length of the run of equal signs that ends here; null signs carry it on."""
        a = self.add(f"{sign} as s_{name}").add(f"last_value(s_{name} ignore nulls) over (partition by symbol order by date rows between unbounded preceding and 1 preceding) as p_{name}")
        a = a.add(f"sum(case when s_{name} is not null and (p_{name} is null or s_{name} <> p_{name}) then 1 else 0 end) {SO_FAR} as i_{name}")
        return a.add(f"cast(coalesce(last_value(s_{name} ignore nulls) {SO_FAR} * count(s_{name}) over (partition by symbol, i_{name} order by date rows between unbounded preceding and current row), 0) as integer) as {name}")

    def sql(self, select: str) -> str:
        return with_panels(select.replace("{last}", self.last), *self.steps)


OVER = "over (partition by symbol order by date)"
SO_FAR = "over (partition by symbol order by date rows between unbounded preceding and current row)"


def over(n: int) -> str:
    return f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"


def filled(expression: str, x: str, n: int) -> str:
    """expression where the last n values of x are all there."""
    return f"case when count({x}) {over(n)} >= {n} then {expression} end"
