"""The stratified split shuffles no rows: each class's last training hash is found from counts by ranges of hashes."""

import hashlib

from pyspark.sql import functions as F

from tidemark.operators import labels as lb


def place(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def test_split_is_exact_in_each_class(spark):
    rows = [(f"k{i}", None if i % 11 == 0 else 9 if i == 1 else i % 3) for i in range(4000)] + [("k4", 1)] * 700
    got = lb.stratified_split(spark.createDataFrame(rows, "key string, label int"), "label", F.col("key")).collect()
    assert len(got) == len(rows) and all(r["train"] is None for r in got if r["label"] is None)
    for label in (0, 1, 2, 9):  # of class 9 the one row is below no share
        keys = [k for k, x in rows if x == label]
        cut = int(len(keys) * 0.8)
        train = {k for k in keys if sum(place(o) < place(k) for o in keys) < cut}
        assert all(r["train"] == (r["key"] in train) for r in got if r["label"] == label)


def test_no_row_is_shuffled(spark):
    split = lb.stratified_split(spark.range(1000).selectExpr("cast(id as string) as key", "id % 2 as label", "'wide' as other"), "label", F.col("key"))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    exchanges = [x for x in split._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert "strategy=broadcast" in plan and not any("other" in x for x in exchanges) and all("__block" in x or "__of" in x or "__label" in x or "__in" in x for x in exchanges)
