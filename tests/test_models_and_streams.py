"""Properties of pooled models, online learning, keyed upserts, streams and monitors, against plain computation."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators import models as md
from tidemark.operators import monitor as mo
from tidemark.operators.indicators import significant_slope, t90
from tidemark.plans import models as plans
from tidemark.plans.registry import queries
from tidemark.sources.ingest import upsert
from tidemark.streaming import bars as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(7)
    rows = [(f"S{i % 10}", i, a := rng.gauss(0, 1), b := rng.gauss(0, 1), int(a - b + rng.gauss(0, 0.3) > 0)) for i in range(800)]
    return spark.createDataFrame(rows, "symbol string, date int, a double, b double, label int").persist()


def test_hashing(spark):
    out = md.hashed(spark.createDataFrame([("x", "u"), ("x", "u"), ("y", None)], "p string, q string"), ["p", "q"], 64)
    v = [r["v"] for r in out.select(md.vector_to_array("hashed").alias("v")).collect()]
    assert v[0] == v[1] != v[2] and all(len(x) == 64 for x in v) and sum(v[0]) == 2 and sum(v[2]) == 1
    assert {(r["n_buckets"], r["n_set"]) for r in queries()["K08_feature_hashing"](spark, SF).collect()} <= {(4096, 1), (4096, 2)}


def test_classifiers_learn_what_is_there(points):
    train, test = points.filter("date < 600"), points.filter("date >= 600")
    for model in (md.boosted(train, ["a", "b"], rounds=5), md.balanced_logistic(train, ["a", "b"])):
        got = md.probability(model, test, ["a", "b"], "p").select("p", "label").collect()
        assert all(0 <= r["p"] <= 1 for r in got) and np.mean([(r["p"] > 0.5) == r["label"] for r in got]) > 0.85
    assert md.balanced_logistic(points.limit(20), ["a", "b"]) is None and md.balanced_logistic(points.filter("label = 1"), ["a", "b"]) is None


def test_online_step_is_a_gradient_step(points):
    rows = points.collect()
    x, y = np.array([[1.0, r["a"], r["b"]] for r in rows]), np.array([r["label"] for r in rows])
    w, weights = np.zeros(3), {}
    for _ in range(3):
        w = w + 0.1 * ((y - 1 / (1 + np.exp(-x @ w)))[:, None] * x).mean(0)
        weights = md.online_step(weights, points, ["a", "b"])
    assert np.allclose([weights["bias"], weights["a"], weights["b"]], w)
    p = points.select(md.logistic(weights, ["a", "b"]).alias("p"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    assert np.allclose(sorted(r["p"] for r in p), sorted(1 / (1 + np.exp(-x @ w))))


def test_forests_cap_moves_and_clusters_are_signals(spark, points):
    rows = points.select("symbol", "date", (F.lit(100.0) + F.col("date") / 100).alias("close"), "a", "b", *((F.col("a") * n).alias(f"ret_in_{n}") for n in (5, 10)))
    out = md.horizon_forests(rows.filter("date < 600"), rows.filter("date >= 600"), ["a", "b"]).collect()
    last = {r["symbol"]: r["close"] for r in rows.filter("date >= 790").collect()}
    assert {r["horizon"] for r in out} == {5, 10} and all(abs(r["predicted"] / last[r["symbol"]] - 1) <= 0.1 * r["horizon"] / 5 + 1e-9 and r["passed"] == (r["r2"] >= 0.4) for r in out)
    train = points.withColumn("label", (F.col("label") * 8 - 4).cast("int"))
    got = md.clustered_signals(train, points.drop("label"), ["a", "b"], k=4, trees=5).select("cluster", "ml_signal", "a", "b").collect()
    assert {r["cluster"] for r in got} == {0, 1, 2, 3} and {r["ml_signal"] for r in got} == {-4, 4}
    assert np.mean([(r["ml_signal"] > 0) == (r["a"] > r["b"]) for r in got]) > 0.85


def test_model_queries(spark):
    """K14 to K16 over a small table: probabilities, the multiplier's range, the ensemble; and K15 where nothing trains."""
    got = queries()["K15_meta_multiplier"](spark, SF).collect()
    assert got and all(abs(r["multiplier"] - (1.0 if r["p"] is None else 0.8 + 0.4 * r["p"])) < 1e-12 for r in got)
    assert all(0 <= r["p"] <= 1 and r["side"] in (-1, 1) for r in queries()["K14_reversal_logistic"](spark, SF).collect())
    for r in queries()["K16_batch_scoring"](spark, SF).limit(300).collect():
        assert abs(r["final_score"] - (0.3 * r["online_prob"] + 0.7 * r["batch_prob"])) < 1e-9


def test_meta_multiplier_without_a_model(spark, monkeypatch):
    monkeypatch.setattr(plans.md, "balanced_logistic", lambda *a, **k: None)
    assert {(r["p"], r["multiplier"]) for r in queries()["K15_meta_multiplier"](spark, SF).collect()} == {(None, 1.0)}


def test_upsert_by_order(spark):
    base = spark.createDataFrame([("a", 1, 10), ("b", 1, 20), (None, 1, 30)], "k string, at int, v int")
    delta = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("b", 6, 9), ("c", 1, 3), ("c", 1, 4), (None, 2, 5)], "k string, at int, v int")
    for parts in (1, 4):
        got = upsert(base, delta.repartition(parts), ["k"], ("at",)).collect()
        assert sorted((r["k"] or "", r["at"], r["v"]) for r in got) == [("", 2, 5), ("a", 1, 10), ("b", 7, 2), ("c", 1, 4)]


def test_stream_upserts_and_weights_survive_a_restart(spark, tmp_path):
    rows = [(f"k{i % 30}", i, float(i % 7), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, x double, label int")
    landed = f"file://{tmp_path}/landed"
    store = f"file://{tmp_path}/store"

    def run():
        model, numbers = st.Learner(spark, f"{store}-w", ["x"]), []
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        st.upsert_batches(stream, spark, store, f"{store}-c", ["k"], ("at",), lambda b, n: (model.step(b, n), numbers.append(n)), parts=4)
        return model, numbers

    df.filter("at < 100").repartition(3).write.parquet(landed)
    _, first = run()
    df.filter("at >= 100").coalesce(1).write.mode("append").parquet(landed)
    model, second = run()  # a new process: only what is stored goes on
    assert len(first) == 3 and second == [3]
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in {r[0] for r in rows}}
    assert {r["k"]: tuple(r) for r in st.upserted(spark, store, second[-1], df).collect()} == want
    before = model.weights(second[-1])
    last = spark.createDataFrame([r for r in rows if r[1] >= 150], df.schema)
    model.step(last, second[-1])
    model.step(last, second[-1])  # the same batch twice is one step
    assert model.weights(second[-1]) == md.online_step(model.weights(second[-1] - 1), last, ["x"]) and set(before) == {"bias", "x"}


def test_stream_bars(spark):
    got = queries()["M01_stream_bars"](spark, SF).collect()
    assert got and all(r["low"] <= min(r["open"], r["close"]) <= max(r["open"], r["close"]) <= r["high"] and r["start"].time() == dt.time() for r in got)
    m = queries()["M02_upsert_and_learn"](spark, SF)
    assert m.count() == m.select("symbol", "date").distinct().count() and m.filter("p < 0 or p > 1 or p is null").count() == 0


def test_sums_below_and_quantiles(spark):
    rng = random.Random(3)
    x = {"f": [rng.choice([0.0, 1.5, rng.random()]) for _ in range(997)], "g": [3.0], "h": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in x.items() for v in vs], "feature string, x double")
    for r in mo.with_below(df.groupBy("feature", "x").agg(F.count("*").alias("n")), "feature", "x", ["n"], blocks=7).collect():
        assert r["below_n"] == sum(v < r["x"] for v in x[r["feature"]])
    for r in mo.quantile_edges(df, 10).collect():
        assert np.allclose(r["e"], list(dict.fromkeys(np.percentile(x[r["feature"]], range(0, 101, 10)))), atol=1e-12)
    scores = [(f"m{i % 2}", round(rng.random(), 1), rng.randint(0, 1)) for i in range(300)] + [("one", 0.5, 1)]
    got = {r["model"]: r["auc"] for r in mo.auc(spark.createDataFrame(scores, "model string, score double, label int")).collect()}
    for m in ("m0", "m1"):
        pos, neg = ([s for k, s, y in scores if k == m and y == c] for c in (1, 0))
        assert math.isclose(got[m], np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert got["one"] is None


def test_significance_of_any_length(spark):
    #: Tabled 0.90 quantiles of Student's t.
    for n, want in ((3, 3.078), (5, 1.638), (12, 1.372), (32, 1.310), (122, 1.289)):
        assert abs(t90(n) - want) < 6e-4
    df = spark.createDataFrame([("s", i, float(i) + (i % 3)) for i in range(40)], "symbol string, date int, x double")
    got = significant_slope(df, "x", 7, "s").orderBy("date").collect()
    assert got[5]["s"] is None and all(r["s"] > 0 and r["s_ok"] for r in got[6:])


def test_train_split_is_by_symbol(points):
    got = points.select("symbol", lb.is_train(F.col("symbol")).alias("t")).distinct().collect()
    assert len(got) == 10 and len({r["symbol"] for r in got}) == 10
