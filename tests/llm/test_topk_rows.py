"""Search over rows that repeat, tie and differ in length, against brute force and the query's own SQL."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.common import ship_package
from tidemark.llm.maxscore import topk_inner_product
from tidemark.llm.queries import OP5_SQL


def brute(rows, k=10):
    q = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(q):
        if i % 100 == 0:
            n = lambda w: int(np.dot(v[: min(len(v), len(w))], w[: min(len(v), len(w))]))
            best = sorted((-n(w), j) for b, (j, w) in enumerate(q) if a != b)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


def rows_of(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_rows_that_repeat(spark):
    ship_package(spark)
    few = [(1, [1.0, 0.5]), (1, [0.1, 0.9]), (100, [1.0, 1.0])]
    rng = np.random.default_rng(6)
    many = [(int(rng.integers(0, 210)), rng.integers(-2, 3, 6).astype(float).tolist()) for _ in range(260)]  # few values: many ties
    many += [many[3]] * 15 + [(100, [1.0] * 6)] * 3 + [(200, [1.0] * 6), (100, [2.0]), (0, []), (0, None), (5, [None]), (7, [float("nan")]), (None, [1.0])]
    for rows in (few, many):
        df = spark.createDataFrame([(i, v, 1, [0.5], i, 7) for i, v in rows], "vec_id bigint, embedding array<double>, n int, v array<double>, query bigint, vec int")
        for shard_rows in (None, 30):
            assert rows_of(topk_inner_product(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block_rows=2)) == brute(rows)


def test_sql_counts_rows_too():
    embeddings = pa.table({"vec_id": [1, 1, 100], "embedding": [[1.0, 0.5], [0.1, 0.9], [1.0, 1.0]]})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    got = Counter(con.execute(OP5_SQL).fetchall())
    assert got == brute(list(zip(*embeddings.to_pydict().values())))
