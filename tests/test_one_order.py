"""Panels stay in one order by symbol: one exchange and one sort however many indicators, and more tasks with more rows."""

import pytest

from tidemark.functions.windows import emas
from tidemark.operators import indicators as ind
from tidemark.operators import reversal as rv
from tidemark.operators import trends as tr
from tidemark.plans.trends import labelled
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"
BUILT = {
    "labels": labelled, "scored": lambda df: rv.side_scores(rv.detector_panel(df)), "rules": lambda df: rv.rule_score(rv.rsi_extreme_candidates(rv.ml_panel(df))),
    "counters": lambda df: tr.counters(ind.macd(df)), "newest": lambda df: emas(tables.bars(df, tail_bars=300), "close", 20, 200),
}


@pytest.mark.parametrize("name", BUILT)
def test_one_sort_and_one_exchange(spark, name):
    plan = BUILT[name](tables.bars_raw(spark, SF))._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Sort [" in line for line in plan) == 1 and sum("Exchange" in line for line in plan) == 1


def test_tasks_grow_with_the_rows(spark):
    assert [tables.by_symbol_parts(spark, n) for n in (0, 60_000, 600_000, 36_000_000, 216_000_000)] == [1, 2, 4, 90, 540]
