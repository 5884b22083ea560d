"""Exponential means over histories longer than one block, against a plain loop."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions.windows import BLOCK, emas, ewm, rma


def test_ten_thousand_bars(spark):
    rng = random.Random(2)
    bars = {"a": 10_000, "b": 2 * BLOCK, "c": 2 * BLOCK + 1, "d": 1}
    rows = [(s, i, None if s == "a" and i < 300 else 100 + rng.gauss(0, 5)) for s, n in bars.items() for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date int, close double").repartition(4)
    df = rma(ewm(emas(df, "close", 2, 8, 12, 200), F.col("close"), "fast", 0.9), "close", 14, "rma14")
    alphas = {"ema2": 2 / 3, "ema8": 2 / 9, "ema12": 2 / 13, "ema200": 2 / 201, "fast": 0.9, "rma14": 1 / 14}
    got = {(r["symbol"], r["date"]): r for r in df.collect()}
    for name, alpha in alphas.items():
        for s, n in bars.items():
            y = None
            for _, i, x in (r for r in rows if r[0] == s):
                y = y if x is None else x if y is None else alpha * x + (1 - alpha) * y
                assert (got[s, i][name] is None) == (y is None) and (y is None or math.isclose(got[s, i][name], y, rel_tol=1e-12)), (name, s, i)
