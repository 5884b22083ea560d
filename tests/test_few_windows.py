"""Detectors take their steps together: Spark copies every bar once a window operator, and compiles each operator's classes anew in a
task where there are more than it keeps."""

import random

from pyspark.sql import functions as F

from test_runs_and_sources import bars_of, walk
from tidemark.operators import labels as lb
from tidemark.operators import reversal as rv
from tidemark.operators import trends as tr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_prices(df):
    return df.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(5).cast("bigint")})


def test_detectors_have_few_windows(spark):
    df = with_prices(bars_of(spark, {"a": walk(random.Random(1), 80)}))
    assert plan(rv.reversal_labels(rv.detector_panel(df))).count("Window [") <= 30  # 79 before
    rules = plan(rv.rule_score(rv.rsi_extreme_candidates(rv.ml_panel(df))))
    assert rules.count("Window [") <= 25 and "percentile" not in rules  # 57 before, three of them over sorted counts


def test_extremes_of_the_last_bars(spark):
    df = tr.indexed(bars_of(spark, {"a": walk(random.Random(4), 700), "b": [3, 1, 2]}))
    for n in (1, 5, 6, 7, 40, 199, 230):
        steps = tr.last_extremes(F.when(F.col("idx") > 1, F.col("close")), n, "x")
        out = df.transform(lambda d, steps=steps: tr.in_steps(d, steps)).orderBy("symbol", "idx").collect()
        for s in ("a", "b"):
            rows = [r for r in out if r["symbol"] == s]
            for i, r in enumerate(rows):
                span = [q["close"] for q in rows[max(0, i - n + 1) : i + 1] if q["idx"] > 1]
                assert (r["x"]["lo"], r["x"]["hi"]) == ((min(span), max(span)) if span else (None, None)), (s, n, i)


def test_barriers_of_both_sides_in_one_pass(spark):
    df = with_prices(bars_of(spark, {"a": walk(random.Random(3), 300)})).withColumns({"atr": F.lit(1.5), "side": F.when(F.col("close") % 2 == 0, 1).otherwise(-1)})
    one = {r["date"]: (r["side"], r["outcome"]) for r in lb.atr_barrier(df, F.col("side")).collect()}
    for side in (1, -1):
        assert all(one[r["date"]] == (side, r["outcome"]) for r in lb.atr_barrier(df, side).filter(F.col("side") == side).collect())
    assert len({x for x in one.values()}) >= 4
