"""Exact top-k inner-product search with MaxScore pruning over shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

OUT = "query_id bigint, vec_id bigint, score bigint"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of valid vectors. Null ids, and vectors that are null or hold null or
    non-finite components, take no part."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return df.filter(F.col(f"`{vec_col}`").isNotNull() & sound & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v"))


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of a shard; short ones are filled up with zeros."""
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out, lengths = np.zeros((len(lists), width), np.int64), np.diff(offsets)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat[offsets[0] : offsets[-1]]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores))
    return order[:k]


def maxscore(q: np.ndarray, ids: np.ndarray, counts: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: int | None = None, chunk: int = 1024, probe: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a shard for one query, each document standing for `counts` rows; documents
    below `least` may be left out.

    Terms are the vector's components; postings[t] has the values of term t by document, low and high its extremes. A
    term adds at least min(q*low, q*high); what it adds above that is at most its bound. Terms are taken by rising bound:
    those whose bounds together stay under the score to beat (the k-th best so far, or least) are non-essential. A document
    is scored on the essential terms first, and the others are probed, largest bound first, only while it can still reach
    that score.
    """
    a, b = q * low, q * high
    floor, bound = np.minimum(a, b).sum(), np.abs(a - b)
    rising = np.argsort(bound, kind="stable")
    summed = np.cumsum(bound[rising])
    floors = np.minimum(a, b)
    got_i, got_s = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(ids), chunk):
        doc = at + np.flatnonzero(counts[at : at + chunk] > 0)
        beat = got_s[-1] if len(got_s) == k else least
        need = -1 if beat is None else beat - floor
        n_free = int(np.searchsorted(summed, need, side="left")) if need > 0 else 0  # bounds below need: non-essential
        terms = rising[n_free:]
        part = (q[terms, None] * postings[np.ix_(terms, doc)]).sum(0) - floors[terms].sum() if len(terms) else np.zeros(len(doc), np.int64)
        while n_free and len(doc):
            alive = part + summed[n_free - 1] >= need
            doc, part = doc[alive], part[alive]
            terms = rising[max(0, n_free - probe) : n_free]
            part = part + (q[terms, None] * postings[np.ix_(terms, doc)]).sum(0) - floors[terms].sum()
            n_free = max(0, n_free - probe)
        doc, part = doc[part >= need], part[part >= need]
        rows = np.repeat(np.arange(len(doc)), np.minimum(counts[doc], k))
        got_i, got_s = np.concatenate([got_i, ids[doc[rows]]]), np.concatenate([got_s, part[rows] + floor])
        top = _best(got_s, got_i, k)
        got_i, got_s = got_i[top], got_s[top]
    return got_i, got_s


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_vec", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return schema.empty_table()
        longest = lambda t: int(pc.max(pc.list_value_length(t.column("v"))).as_py() or 0)
        width = max(longest(candidates), longest(queries))
        ids, keys, counts = (candidates.column(c).to_numpy() for c in ("vec_id", "vec", "n"))
        x, q = _matrix(candidates, width), _matrix(queries, width)
        postings, low, high = np.ascontiguousarray(x.T), x.min(0), x.max(0)
        found = []
        for i, key, least, v in zip(*(queries.column(c).to_pylist() for c in ("vec_id", "vec", "least")), q, strict=True):
            left, own = counts, np.flatnonzero((ids == i) & (keys == key))
            own = own[(x[own] == v).all(1)]
            if len(own):
                left = counts.copy()
                left[own] -= 1
            found.append((i, key, *maxscore(v, ids, left, postings, low, high, k, least)))
        size = [len(f[2]) for f in found]
        return pa.table({"query": np.repeat([f[0] for f in found], size), "query_vec": np.repeat([f[1] for f in found], size), "vec_id": np.concatenate([f[2] for f in found]), "score": np.concatenate([f[3] for f in found])}, schema)

    return run


def topk_inner_product(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int | None = None, block_rows: int = 4096, ws: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for each query row.

    is_query is a condition on vec_id. Vectors are dealt by hash into shards of about shard_rows (a 256th of them, 2,048 to
    65,536, if not given), queries into blocks of about block_rows. Each query is searched in one shard first; its k-th best
    score there is the least that the other shards need beat, so they prune from the start and return few rows. A pair of a
    shard and a block is one group, searched with MaxScore, and the shards' answers are merged by a window over at most k
    rows a shard.

    Only a query's own row is no candidate for it. Rows with equal id and vector are searched once and count as often as
    they occur, as candidates and as queries; rows that share only the id are rows like any other. Ties go to the smaller
    vec_id. Vectors of unequal length are taken as filled up with zeros. Sums must fit 64 bits. An empty table gives an empty
    result, and other columns, whatever their names, have no influence.
    """
    ws = ws or Workspace(vectors.sparkSession, "topk")
    base = quantised(vectors, id_col, vec_col, scale).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    base = ws.save(base.withColumn("vec", F.xxhash64("v")).withColumn("is_query", is_query), "quantised")
    n, n_q = base.agg(F.count("*"), F.count_if("is_query")).first()
    shard_rows = shard_rows or min(max(n // 256, 2048), 65_536)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_q // block_rows))
    dealt = lambda count, salt: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    candidates = base.select("vec_id", "vec", "v", "n", dealt(shards, 1).alias("shard"), every(blocks).alias("block"))
    queries = base.filter("is_query").withColumn("home", dealt(shards, 3)).withColumn("block", dealt(blocks, 2))
    ddl = "query bigint, query_vec bigint, vec_id bigint, score bigint"
    key = ["query", "query_vec"]

    def search(queries: DataFrame, name: str) -> DataFrame:
        some = queries.select(*(F.col(c).alias(c) for c in ("vec_id", "vec", "v", "least", "shard", "block")))  # columns of their own
        return ws.save(candidates.groupBy("shard", "block").cogroup(some.groupBy("shard", "block")).applyInArrow(_search(k), ddl), name)

    first = search(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("bigint")), "first")
    least = first.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = queries.withColumnRenamed("vec_id", "query").withColumnRenamed("vec", "query_vec").join(least, key, "left").withColumnsRenamed({"query": "vec_id", "query_vec": "vec"})
    rest = rest.withColumn("shard", every(shards)).filter("shard <> home")
    found = first.unionByName(search(rest, "rest")) if shards > 1 else first
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    repeated = base.filter("is_query and n > 1").select(F.col("vec_id").alias("query"), F.col("vec").alias("query_vec"), "n")
    top = top.join(repeated, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1)))))
    return top.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
