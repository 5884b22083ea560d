"""Hand-computed cases, and an independent loop over small random panels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as sc
from tidemark.functions.windows import ema
from tidemark.operators import labels as lb
from tidemark.operators import ranking as rk
from tidemark.operators import trends as tr

BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


def panel(spark, series):
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 100 + i) for s, closes in series.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def walks():
    rng, out = random.Random(7), {}
    for k in range(6):
        c, closes = 50, []
        for _ in range(120):
            c += rng.choice([-2, -1, -1, 0, 1, 1, 2])
            closes.append(max(c, 5))
        out[f"S{k}"] = closes
    return out


def test_pattern_on_nine_prices(spark):
    got = {r["symbol"]: r for r in tr.price_pattern(panel(spark, {"A": [100, 95, 90, 85, 80, 75, 78, 81, 84], "B": [100, 102, 104, 106, 108, 110, 112, 114, 116], "C": [100, 98, 96, 98, 100, 102]})).filter("idx = 8 or (symbol = 'C' and idx = 5)").collect()}
    assert (got["A"]["pattern"], got["A"]["d1_recent_up"], got["A"]["d2_prior_down"], got["A"]["pattern_score"]) == (True, 3, 5, 55.0)
    assert not got["B"]["pattern"] and not got["C"]["pattern"]


def tolerant_run(flags, end, allowed=1, cap=200):
    i, count, soft, steps = end, 0, 0, 0
    while i > 0 and steps < cap:
        if flags[i]:
            count += 1
        elif soft < allowed:
            soft += 1
        else:
            break
        i, steps = i - 1, steps + 1
    return count, i


def test_tolerant_runs_equal_a_loop(spark, walks):
    got = {(r["symbol"], r["idx"]): r for r in tr.reversal_runs(panel(spark, walks)).collect()}
    for s, closes in walks.items():
        up = [False, *(b > a for a, b in zip(closes, closes[1:]))]
        down = [False, *(b < a for a, b in zip(closes, closes[1:]))]
        for i in range(len(closes)):
            u, at = tolerant_run(up, i)
            d, below = tolerant_run(down, at)
            r = got[s, i]
            assert (r["up_n"], r["up_stop"], r["prior_down_n"], r["prior_down_stop"]) == (u, at, d, below), (s, i)


def test_runs_and_ema_equal_a_loop(spark, walks):
    df = ema(tr.last_run(tr.indexed(panel(spark, walks))), "close", 8, "e")
    for r in df.collect():
        closes = walks[r["symbol"]][: r["idx"] + 1]
        y = closes[0]
        for c in closes[1:]:
            y = 2 / 9 * c + 7 / 9 * y
        assert abs(r["e"] - y) < 1e-9
        signs = [(b > a) - (b < a) for a, b in zip(closes, closes[1:])]
        signs = [s for s in signs if s]
        n = 0
        while n < len(signs) and signs[-1 - n] == signs[-1]:
            n += 1
        assert r["run"] == (signs[-1] * n if signs else 0)


def test_percentiles_with_ties_and_nulls(spark):
    df = spark.createDataFrame(list(enumerate([3.0, 1.0, None, 3.0, None, 2.0])), "i int, x double").withColumn("g", F.lit(1))
    rows = df.select("i", rk.percentile_rank(F.col("x"), ["g"]).alias("b"), rk.percentile_rank(F.col("x"), ["g"], "keep").alias("k")).orderBy("i").collect()
    assert [round(r["b"], 4) for r in rows] == [0.5833, 0.1667, 0.9167, 0.5833, 0.9167, 0.3333]
    assert [r["k"] for r in rows] == [0.875, 0.25, None, 0.875, None, 0.5]


def test_scores(spark):
    one = spark.range(1)
    got = one.select(
        sc.composite_score(F.lit(90.0), F.lit(80.0)).alias("a"), sc.composite_score(F.lit(50.0), F.lit(60.0)).alias("b"),
        *(sc.swing_signal(F.lit(float(s)), F.lit(p)).alias(f"s{s}") for s, p in ((85, True), (68, True), (52, True), (90, False))),
        *(sc.ema_structure(F.lit(float(a)), F.lit(float(b)), F.lit(float(c))).alias(f"e{a}{b}{c}") for a, b, c in ((3, 2, 1), (3, 1, 2), (1, 2, 3))),
    ).first()
    assert (got["a"], got["b"]) == (84.5, 55.5)
    assert [got[f"s{s}"] for s in (85, 68, 52, 90)] == ["Strong_Buy", "Buy", "Weak_Buy", "Neutral"]
    assert [got[f"e{x}"] for x in ("321", "312", "123")] == [2, 1, -1]


def test_majority_takes_the_first_of_three(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), x) for i, x in enumerate(["C", "B", "A", "A", "B"])], "symbol string, date date, l string")
    assert [r["m"] for r in tr.majority3(df, "l", "m").orderBy("date").collect()] == ["C", "B", "A", "A", "A"]


def test_barriers_equal_a_loop(spark, walks):
    for r in lb.triple_barrier(tr.indexed(panel(spark, walks)), 5, 0.05, 0.04).collect():
        closes, i = walks[r["symbol"]], r["idx"]
        p, ahead = closes[i], closes[i + 1 : i + 6]
        label = None
        for c in ahead:
            if c + 1 >= p * 1.05:
                label = 1
            elif c - 1 <= p * (1 - 0.04):
                label = 0
            if label is not None:
                break
        if label is None and ahead:
            label = int(max(ahead) / p - 1 >= 0.05)
        assert r["label_success"] == label, (r["symbol"], i)


def test_names_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
