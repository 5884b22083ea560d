"""Walks that meet a price of 0: returns on it follow IEEE, as in the SQL; features that divide by it are left out."""

import datetime as dt
import math

import pytest

from tidemark.operators import labels as lb
from tidemark.plans import models, streams

BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for s in range(4):
        closes = [100.0 + 5 * ((i * (s + 3)) % 7) for i in range(60)]
        if s == 0:
            closes[30], closes[31], closes[32] = 0.0, 0.0, -5.0
        for i, c in enumerate(closes):
            o = closes[i - 1] if i else 100.0
            rows.append((f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(i), o, max(o, c) + i % 3, min(o, c) - i % 2, c, 100 + i))
    return spark.createDataFrame(rows, BARS)


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(i)


def test_barriers_on_a_price_of_zero(bars):
    got = {r["date"]: r for r in lb.triple_barrier(bars).filter("symbol = 'S0'").collect()}
    first, second = got[day(30)], got[day(31)]
    assert math.isnan(first["realized_return"]) and first["max_future_return"] == math.inf and first["min_future_return"] == -math.inf
    assert second["realized_return"] == -math.inf and (second["label_success"], second["stop_hit"]) == (1, 0)


def test_pseudo_labels_on_a_price_of_zero(bars):
    got = {r["date"]: r["label"] for r in lb.pseudo_labels(bars).filter("symbol = 'S0'").collect()}
    assert got[day(30)] == -4  # 0 over 0 has no sign: that of the fall before it is carried on
    assert got[day(31)] == -4 and len(got) == 59


def test_features_leave_out_a_price_of_zero(spark, bars, monkeypatch):
    monkeypatch.setattr(models, "bars_walk", lambda spark, path: bars)
    rows = models.priced(models.feature_rows(spark, "")).collect()
    days = {r["date"] for r in rows if r["symbol"] == "S0"}
    assert day(29) in days and day(33) in days and not {day(30), day(31)} & days
    assert all(math.isfinite(r[f]) for r in rows for f in models.FEATURES)


def test_learning_passes_over_an_open_of_zero(spark, bars, monkeypatch):
    monkeypatch.setattr(streams, "bars_walk", lambda spark, path: bars)
    got = {(r["symbol"], r["date"]): r for r in streams.m02(spark, "").collect()}
    assert len(got) == 240 and got["S0", day(31)]["p"] is None and got["S0", day(32)]["p"] is None
    assert all(r["p"] is not None for k, r in got.items() if k not in (("S0", day(31)), ("S0", day(32))))
