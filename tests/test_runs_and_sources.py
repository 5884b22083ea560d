"""Extremes of runs, values at the stop of tolerant runs, late ticks and database reads, against plain loops."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tidemark.operators import reversal as rv
from tidemark.operators import trends as tr
from tidemark.sources.jdbc import bars_jdbc
from tidemark.sources.tables import bars
from tidemark.streaming.bars import stream_bars


def bars_of(spark, series):
    rows = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(c)) for s, closes in series.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)


def walk(rng, n, steps=(-1, -1, 0, 1, 1)):
    out = [100]
    for _ in range(n - 1):
        out.append(out[-1] + rng.choice(steps))
    return out


def test_extremes_of_the_run_before(spark):
    rng = random.Random(8)
    series = {f"s{k}": walk(rng, 150, random.Random(k).choice([(-1, 1), (-1, 0, 1), (-1, -1, 0, 0, 0, 1, 1), (0, 1)])) for k in range(8)} | {"flat": [5] * 30, "one": [1]}
    got = {(r["symbol"], r["idx"]): r for r in tr.current_and_prior(bars_of(spark, series), min_prior=1).collect()}
    for s, c in series.items():
        runs = []  # (sign, bars) of each run; flat bars carry a run on
        for i in range(1, len(c)):
            sign = (c[i] > c[i - 1]) - (c[i] < c[i - 1])
            if sign and (not runs or runs[-1][0] != sign):
                runs.append((sign, [i]))
            elif runs:
                runs[-1][1].append(i)
            moves = lambda bars: sum(c[j] != c[j - 1] for j in bars)
            r = got[s, i]
            if len(runs) > 1 and moves(runs[-1][1]) == len(runs[-1][1]) and r["run_error"] is None:
                before = runs[-2][1]
                last = [c[j] for j in before[-moves(before) :]]
                assert (r["prior_days"], r["prior_high"], r["prior_low"]) == (len(last), max(last), min(last)), (s, i)


def test_a_long_flat_run_costs_no_more_than_its_bars(spark):
    series = {"still": [7] * 50_000, "late": [1, 2, 3, *[3] * 20_000, 2, 1]}
    began = time.time()
    out = tr.current_and_prior(bars_of(spark, series), min_prior=1).filter("symbol = 'late'").orderBy(F.desc("idx")).first()
    assert out["prior_high"] == 3 and out["prior_low"] == 3 and time.time() - began < 60


def test_extremes_since_the_stop(spark):
    rng = random.Random(3)
    series = {"mixed": walk(rng, 500), "rising": walk(rng, 500, (1, 1, 1, 1, 1, 1, 1, 0)), "always": list(range(460)), "flat": [4] * 40}
    df = tr.reversal_runs(bars_of(spark, series), keep_flags=True).withColumn("x", F.sin(F.col("idx") * 7.3))
    for cap, skip in ((200, 0), (200, 1), (200, 3)):
        out = tr.since_stop(df, "up", cap, "x", "lo", "hi", skip).orderBy("symbol", "idx").collect()
        by = {s: [r for r in out if r["symbol"] == s] for s in series}
        for rows in by.values():
            for i, r in enumerate(rows):
                span = [rows[j]["x"] for j in range(r["up_stop"] + 1 + skip, i + 1)]
                assert (r["lo"], r["hi"]) == ((min(span), max(span)) if span else (None, None)), (r["symbol"], i, cap, skip)


def test_the_detector_is_one_exchange(spark):
    rng = random.Random(1)
    rows = bars_of(spark, {"a": walk(rng, 80)}).withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(5).cast("bigint"))
    plan = rv.reversal_labels(rv.detector_panel(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Join" not in plan


def test_the_meta_model_moves_the_label(spark):
    rng = random.Random(12)
    series = {f"s{k}": walk(rng, 220, (-2, -1, -1, 1, 1, 2)) for k in range(3)}
    rows = bars_of(spark, series).withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1}).withColumn("volume", F.lit(5).cast("bigint"))
    panel = rv.detector_panel(rows).withColumn("p", F.when(F.col("symbol") != "s2", F.when(F.col("symbol") == "s0", 0.8).otherwise(1.2)))
    of = lambda df: {(r["symbol"], r["date"]): r for r in df.collect()}
    plain, moved = of(rv.reversal_labels(panel)), of(rv.reversal_labels(panel, meta=F.col("p")))
    assert len(plain) == len(moved) == 660 and any(r["strength"] for r in plain.values())
    for k, r in plain.items():
        best = max(r["bull_score"] or 0.0, r["bear_score"] or 0.0) * {"s0": 0.8, "s1": 1.2, "s2": 1.0}[k[0]]
        want = next((n for n, least in (("Strong", 0.70), ("Moderate", 0.45), ("Weak", 0.20)) if min(best, 1.0) >= least), None)
        assert moved[k]["strength"] == want and moved[k]["direction"] == r["direction"]


def test_late_ticks_are_dropped_and_others_are_not(spark, tmp_path):
    at = lambda day, hour=12: dt.datetime(2024, 1, day, hour)
    loads = [
        [("x", at(1), 1.0, 1), ("x", at(2), 2.0, 2), ("x", at(5), 5.0, 3)],  # 5 January less 2 days: up to the 2nd is closed
        [("x", at(1, 13), 100.0, 4), ("x", at(2, 20), 100.0, 5), ("x", at(4), 4.0, 6), ("x", at(3, 1), 3.0, 7), ("x", at(10), 10.0, 8)],
        [("x", at(7), 100.0, 9), ("x", at(9), 9.0, 10), ("x", at(20), 20.0, 11)],
    ]
    source, to, checkpoint = (f"file://{tmp_path}/{n}" for n in ("ticks", "bars", "checkpoint"))
    schema = "symbol string, ts timestamp, price double, event_id bigint"
    for rows in loads:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream_bars(spark.readStream.schema(schema).parquet(source), to, checkpoint)
    got = {r["start"].day: (r["n_ticks"], r["high"]) for r in spark.read.parquet(to).collect()}
    assert got == {1: (1, 1.0), 2: (1, 2.0), 3: (1, 3.0), 4: (1, 4.0), 5: (1, 5.0), 9: (1, 9.0), 10: (1, 10.0)}


def test_the_query_meets_late_ticks(spark):
    from tidemark.plans.registry import queries
    from tidemark.sources.tables import ticks

    path = "/root/testdata/sf0.001"
    kept = queries()["M01_stream_bars"](spark, path)
    days = kept.select("symbol", F.to_date("start").alias("day"))
    landed = ticks(spark, path).withColumn("day", F.to_date("ts")).join(days, ["symbol", "day"]).count()
    n = kept.agg(F.sum("n_ticks")).first()[0]
    assert 0.8 * landed < n < landed  # some of those days' ticks came too late


def test_bars_from_a_database(spark):
    url = "jdbc:derby:memory:bars;create=true"
    rng = random.Random(2)
    rows = [(f"S{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), *(float(rng.randint(1, 99)) for _ in range(4)), rng.randint(1, 9), "more") for k in range(4) for i in range(40)]
    table = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume bigint, other string")
    table.write.format("jdbc").option("url", url).option("dbtable", "bars").option("createTableColumnTypes", "symbol varchar(8)").mode("overwrite").save()
    df = bars_jdbc(spark, url, "bars", ["S1", "S3"], "2020-01-05", "2020-01-20", parts=4, columns={"date": "day"})
    assert df.rdd.getNumPartitions() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(symb" in pushed and "GreaterThanOrEqual(day,2020-01-05)" in pushed and "LessThanOrEqual(day,2020-01-20)" in pushed and "other" not in plan
    want = {r[:7] for r in rows if r[0] in ("S1", "S3") and dt.date(2020, 1, 5) <= r[1] <= dt.date(2020, 1, 20)}
    assert {tuple(r) for r in df.collect()} == want and len(want) == 32
    assert bars_jdbc(spark, url, "bars", columns={"date": "day"}).count() == len(rows)
    assert bars_jdbc(spark, url, "(select * from bars where 1 = 0) t", columns={"date": "day"}).count() == 0


def test_a_tail_starts_anew(spark):
    rng = random.Random(6)
    df = bars_of(spark, {"long": walk(rng, 90), "short": walk(rng, 7)})
    rows = bars(df, tail_bars=20)
    assert {r["symbol"]: r["count"] for r in rows.groupBy("symbol").count().collect()} == {"long": 20, "short": 7}
    assert rows.filter("symbol = 'long'").agg(F.min("date")).first()[0] == dt.date(2000, 1, 1) + dt.timedelta(days=70)
    assert bars(df, ["short"]).count() == 7 and bars(df, ["long"], tail_bars=5).count() == 5
