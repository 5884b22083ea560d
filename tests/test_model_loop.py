"""Calibration, stored models, splits, metric history and self-stopping trees, by their properties."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.functions import scores as sc
from tidemark.operators import labels as lb
from tidemark.operators import models as md
from tidemark.operators import monitor as mo


@pytest.fixture(scope="module")
def skewed(spark):
    """One label in ten is 1; date is the row's number."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, int(rng.random() < 1 / (1 + math.exp(2.8 - a)))))
    return spark.createDataFrame(rows, "date int, a double, b double, label int").repartition(4).persist()


def balanced(train, features, label):
    """Of classes of equal weight: it states far more than there is."""
    vector = VectorAssembler(inputCols=features, outputCol="features")
    n, ones = train.agg(F.count("*"), F.sum(label)).first()
    rows = vector.transform(train.withColumn("w", F.when(F.col(label) == 1, (n - ones) / ones).otherwise(1.0)))
    return PipelineModel([vector, LogisticRegression(featuresCol="features", labelCol=label, weightCol="w").fit(rows)])


def gap_by_decile(rows, p):
    rows = sorted(rows, key=lambda r: r[p])
    parts = np.array_split(np.array([(r[p], r["label"]) for r in rows]), 10)
    return float(np.mean([abs(x[:, 0].mean() - x[:, 1].mean()) for x in parts]))


def test_calibrated_probabilities_say_how_often(skewed):
    early, later = skewed.filter("date < 4500"), skewed.filter("date >= 4500")
    plain = balanced(early, ["a", "b"], "label")
    model = md.Calibrated.fit(md.time_folds(early), ["a", "b"], model=balanced)
    assert len(model.pairs) == 3
    rows = model.probability(md.probability(plain, later, ["a", "b"], "p0"), "p").collect()
    assert gap_by_decile(rows, "p") < 0.03 < 0.2 < gap_by_decile(rows, "p0")


def test_sigmoid_is_the_best_one(skewed):
    rows = skewed.withColumn("margin", F.col("a") * 3 + 1)
    a, b = md.sigmoid(rows, "label")
    x, y = np.array([(r["margin"], r["label"]) for r in rows.collect()]).T
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(np.sum((p - t) * x)) < 1e-3 and abs(np.sum(p - t)) < 1e-3  # the loss is flat here


def test_no_row_is_calibrated_by_a_fit_that_saw_it(skewed):
    folded = md.time_folds(skewed.filter("date < 2000"))
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 4
    of = lambda df: {r["date"]: r["p"] for r in md.Calibrated.fit(df, ["a", "b"]).probability(df, "p", fold="fold").collect()}
    other = folded.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    one, two = of(folded), of(other)
    fold = {r["date"]: r["fold"] for r in folded.collect()}
    assert all(one[d] is None for d in one if fold[d] < 2) and all(0 < one[d] < 1 for d in one if fold[d] >= 2)
    assert all(one[d] == pytest.approx(two[d]) for d in one if fold[d] == 2)  # its own labels played no part
    assert any(abs(one[d] - two[d]) > 1e-3 for d in one if fold[d] == 3)


def test_folds_of_one_class_make_no_pair(spark, skewed):
    zeros = md.time_folds(skewed.filter("date < 400").withColumn("label", F.lit(0)))
    model = md.Calibrated.fit(zeros, ["a", "b"])
    assert model.pairs == [] and model.probability(zeros, "p").filter("p is not null").count() == 0


def test_trees_stop_by_themselves_and_a_logistic_model_stands_in(skewed):
    rows = lb.stratified_split(skewed, "label", F.col("date").cast("string")).withColumn("held", ~F.col("train"))
    model = md.batch_classifier(rows, ["a", "b"], rounds=40, depth=3, tolerance=0.02)
    trees = model.stages[-1]
    assert isinstance(trees, GBTClassificationModel) and 1 <= trees.getNumTrees < 40
    assert trees.getOrDefault("stepSize") == 0.05
    for odd in (rows.filter("not held"), rows.withColumn("label", F.when(F.col("held"), 0).otherwise(F.col("label")))):
        stand_in = md.batch_classifier(odd, ["a", "b"])
        assert isinstance(stand_in.stages[-1], LogisticRegressionModel)
        p = md.probability(stand_in, skewed, ["a", "b"], "p").select("p", "a").collect()
        assert np.corrcoef([r["p"] for r in p], [r["a"] for r in p])[0, 1] > 0.5


def test_split_is_exact_in_each_class(skewed):
    rows = skewed.withColumn("label", F.when(F.col("date") % 50 != 0, F.col("label")))
    key = F.col("date").cast("string")
    out = lb.stratified_split(rows, "label", key).select("date", "label", "train").collect()
    for c in (0, 1):
        n = sum(r["label"] == c for r in out)
        assert sum(r["label"] == c and r["train"] for r in out) == n * 4 // 5
    assert len(out) == rows.count() and all((r["train"] is None) == (r["label"] is None) for r in out)
    again = lb.stratified_split(rows.repartition(7), "label", key).select("date", "label", "train").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_store_keeps_runs_and_scores_without_a_fit(spark, skewed, tmp_path, monkeypatch):
    store = md.ModelStore(spark, f"file://{tmp_path}/models")
    with pytest.raises(LookupError):
        store.newest()
    scaling = lb.scaling(skewed, ["a", "b"])
    weights = lambda w: spark.createDataFrame([("bias", -2.0), ("a", w), ("b", 0.0)], "feature string, weight double")
    store.save("20250101T000000", {"batch": md.plain_logistic(skewed.filter("date < 1000"), ["a", "b"])}, {"weights": weights(1.0), "scaling": scaling})
    first = store.model("batch").stages[-1].coefficients.toArray()
    store.save("20250301T000000", {"batch": md.plain_logistic(skewed, ["a", "b"])}, {"weights": weights(0.5), "scaling": scaling})
    (tmp_path / "models" / "run=20250401T000000" / "batch").mkdir(parents=True)  # a run that was never finished
    assert store.runs() == ["20250101T000000", "20250301T000000"]

    def no_fit(*_):
        raise AssertionError("a fit")

    for kind in (LogisticRegression, GBTClassifier):
        monkeypatch.setattr(kind, "_fit", no_fit)
    mean = lambda online, batch: sc.ensemble(online, batch, 0.7)
    rows = md.score_with_store(md.ModelStore(spark, store.root), skewed, ["a", "b"], mean).collect()
    assert {r["model_run"] for r in rows} == {"20250301T000000"}
    assert all(r["final_score"] == pytest.approx(0.7 * r["online_prob"] + 0.3 * r["batch_prob"]) for r in rows)
    fit = {r["feature"]: r for r in scaling.collect()}
    for r in rows[:50]:
        z = -2.0 + 0.5 * (r["a"] - fit["a"]["mean"]) / fit["a"]["deviation"]
        assert r["online_prob"] == pytest.approx(1 / (1 + math.exp(-z)))
    older = md.score_with_store(store, skewed.limit(5), ["a", "b"], mean, run="20250101T000000").collect()
    assert {r["model_run"] for r in older} == {"20250101T000000"} and np.allclose(store.model("batch", "20250101T000000").stages[-1].coefficients.toArray(), first)
    store.save("20250201T000000", {"batch": store.model("batch")})
    alone = md.score_with_store(store, skewed.limit(5), ["a", "b"], mean, run="20250201T000000").collect()
    assert all(r["online_prob"] is None and r["final_score"] == r["batch_prob"] for r in alone)


def test_a_run_that_is_saved_again_counts_when_it_is_whole(spark, skewed, tmp_path):
    store = md.ModelStore(spark, f"file://{tmp_path}/models")
    model = md.plain_logistic(skewed.limit(200), ["a", "b"])
    store.save("1", {"batch": model})

    class Lost:
        def write(self):
            assert store.runs() == []  # no longer whole, so no longer there
            raise OSError("the driver is lost")

    with pytest.raises(OSError):
        store.save("1", {"batch": Lost()})
    assert store.runs() == []
    store.save("1", {"batch": model})
    assert store.runs() == ["1"] and store.contents("1") == {"batch": "model"}


def test_history_finds_the_run_before(spark, tmp_path):
    history = mo.MetricHistory(spark, f"file://{tmp_path}/metrics")
    assert history.before("9", "precision").count() == 0
    rows = lambda **x: spark.createDataFrame(list(x.items()), "model string, precision double")
    history.store("2025-01", rows(m=0.5, k=0.4), "precision")
    history.store("2025-02", rows(m=0.8, k=None), "precision")
    history.store("2025-03", rows(m=0.6, k=0.1, new=0.1), "precision")
    history.store("2025-02", rows(m=0.7, k=None), "precision")  # again: it replaces itself
    history.store("2025-02", rows(m=0.1).withColumnRenamed("precision", "f1"), "f1")
    got = {r["model"]: (r["precision"], r["run"]) for r in history.before("2025-03", "precision").collect()}
    assert got == {"m": (0.7, "2025-02"), "k": (0.4, "2025-01")}
    none = spark.createDataFrame([], "feature string, psi double")
    alerts = mo.alerts(none, rows(m=0.6, k=0.1, new=0.1), history.before("2025-03", "precision")).collect()
    assert {(r["name"], round(r["value"], 6)) for r in alerts} == {("k", 0.75)}  # m fell by a seventh only
