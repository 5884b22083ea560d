"""Ranked lexical search by K2-treaps: grids of terms by documents, as compressed quadtrees whose cells hold impact maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

#: Whatever is between two terms: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 4 << 20  # bytes of text that are taken apart at once
BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)
BELOW = np.array([[bin(i & ((1 << q) - 1)).count("1") for q in range(4)] for i in range(16)], np.int64)


def hashes(terms: pa.Array) -> np.ndarray:
    """64-bit hashes of the terms, as pandas has them for text in any process."""
    return pd.util.hash_array(np.asarray(terms.to_pylist(), object), categorize=False).view(np.int64)


def counted_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, doc, term, tf): n by text, and a row for each distinct term of a text, ordered by text."""
    own = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))  # kernels misread some casts of slices, so not a slice
    lists = pc.split_pattern_regex(pc.ascii_lower(own), BETWEEN)
    flat, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    coded, doc = flat.filter(full).dictionary_encode(), doc[full.to_numpy(zero_copy_only=False)]
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    width = max(1, len(coded.dictionary))
    pairs, tf = np.unique(doc.astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
    names = hashes(coded.dictionary) if len(coded.dictionary) else np.empty(0, np.int64)
    return n, pairs // width, names[pairs % width], tf.astype(np.int32)


def _sliced(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def term_vectors(docs: DataFrame, wanted: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) by row of docs: all its terms counted in n, its distinct terms of `wanted` (all, if None)."""
    known = None if wanted is None else docs.sparkSession.sparkContext.broadcast(np.sort(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _sliced(batch.column(1)):
                n, doc, term, tf = counted_terms(texts)
                if known is not None:
                    keep = np.isin(term, known.value)
                    doc, term, tf = doc[keep], term[keep], tf[keep]
                ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(term)), pa.ListArray.from_arrays(ends, pa.array(tf))], ["id", "n", "terms", "tfs"])

    pruned = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    return pruned.mapInArrow(run, "id bigint, n bigint, terms array<bigint>, tfs array<int>")


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x, a zero between each two."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def _packed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Treap:
    """A quadtree over a square of 2**depth rows and columns. Each node of a level has four bits for its quadrants (row bit, then
    column bit) and, a level below, the maxima of those that hold anything, each as the difference from its parent's."""

    def __init__(self, depth: int, top: int, quadrants: list[np.ndarray], less: list[np.ndarray]):
        self.depth, self.top, self.quadrants, self.less = depth, top, quadrants, less

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, impact: np.ndarray, depth: int) -> Treap:
        code = (_spread(row) << 1) | _spread(col)
        order = np.argsort(code, kind="stable")
        code, best = code[order], impact[order]
        quadrants, less = [], []
        for _ in range(depth):
            first = np.flatnonzero(np.r_[True, code[1:] >> 2 != code[:-1] >> 2])
            above = np.maximum.reduceat(best, first)
            less.append(_packed(np.repeat(above, np.diff(np.r_[first, len(code)])) - best))
            quadrants.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), first))
            code, best = code[first] >> 2, above
        return cls(depth, int(best[0]), quadrants[::-1], less[::-1])

    def to_columns(self) -> tuple:
        return self.depth, self.top, [x.tobytes() for x in self.quadrants], [x.tobytes() for x in self.less], [x.dtype.itemsize for x in self.less]

    @classmethod
    def from_columns(cls, depth: int, top: int, quadrants: list[bytes], less: list[bytes], widths: list[int]) -> Treap:
        return cls(int(depth), int(top), [np.frombuffer(x, np.uint8) for x in quadrants], [np.frombuffer(x, f"u{w}") for x, w in zip(less, widths, strict=True)])

    def opened(self) -> Treap:
        """With where each node's first quadrant stands below, and all maxima."""
        self.starts, self.best = [], [np.array([self.top], np.int64)]
        for bits, less in zip(self.quadrants, self.less, strict=True):
            held = BITS[bits]
            self.starts.append(np.cumsum(held) - held)
            self.best.append(np.repeat(self.best[-1], held) - less)
        return self


def search(tree: Treap, rows: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int, least: int, width: int = 192) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of the k columns of highest score, ties to the smaller id, among those that score `least` or more; a
    score is the sum of weight * impact over rows.

    A range of columns has, for each row, the node on that row's path; the sum of their weighted maxima bounds what any
    column of the range scores. Ranges wait by level. The level with the highest bound gives up to `width` of its ranges, best
    first, and each goes down by one level, all rows' paths together, into its two halves; a range of one column has its
    score for a bound. It ends when no range that waits reaches the k-th best score.
    """
    depth = tree.depth
    waiting: list[list] = [[] for _ in range(depth + 1)]
    top = np.zeros((1, len(rows)), np.int64)
    waiting[0].append((np.zeros(1, np.int64), top, np.array([int((weight * tree.best[0][0]).sum())])))
    cols, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    while True:
        highest = [max((int(b.max()) for _, _, b in w), default=-1) for w in waiting]
        d = depth - int(np.argmax(highest[::-1]))  # the deepest of the best levels
        if highest[d] < least or highest[d] < 0:
            return cols, scores
        col, node, bound = (np.concatenate([w[c] for w in waiting[d]]) for c in range(3))
        alive = bound >= least
        col, node, bound = col[alive], node[alive], bound[alive]
        taken = np.argpartition(-bound, width)[:width] if len(bound) > width else np.arange(len(bound))
        left = np.ones(len(bound), bool)
        left[taken] = False
        waiting[d] = [(col[left], node[left], bound[left])] if left.any() else []
        col, node = col[taken], node[taken]
        if d == depth:
            cols, scores = np.r_[cols, col], np.r_[scores, bound[taken]]
            best = np.lexsort((ids[cols], -scores))[:k]
            cols, scores = cols[best], scores[best]
            if len(cols) == k:
                least = max(least, int(scores[-1]))
            continue
        bits = tree.quadrants[d][np.maximum(node, 0)]
        first = tree.starts[d][np.maximum(node, 0)]
        side = ((rows >> (depth - d - 1)) & 1) * 2
        for half in (0, 1):
            q = side + half
            there = (node >= 0) & ((bits >> q) & 1 > 0)
            child = np.where(there, first + BELOW[bits, q], -1)
            bound = np.where(there, tree.best[d + 1][np.maximum(child, 0)], 0) @ weight
            keep = bound >= max(least, 1)
            if keep.any():
                waiting[d + 1].append((col[keep] * 2 + half, child[keep], bound[keep]))


TREE = "shard bigint, ids array<bigint>, no_ids array<boolean>, uids array<bigint>, terms array<bigint>, spread int, held array<bigint>, depth int, top bigint, quadrants array<binary>, less array<binary>, widths array<int>"


def _builder(n_docs: int, n_terms: int):
    """Makes a shard's tree: terms are rows, documents are columns, ordered by their commonest term and length so that
    neighbours are alike and maxima tight."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["terms"].map(len) > 0]
        if not len(pdf):
            return pd.DataFrame([], columns=[c.split()[0] for c in TREE.split(", ")])
        sizes = pdf["terms"].map(len).to_numpy()
        tf, doc = np.concatenate(pdf["tfs"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(pdf)), sizes)
        terms, row = np.unique(np.concatenate(pdf["terms"].to_numpy()), return_inverse=True)
        held = np.bincount(row)
        n = pdf["n"].to_numpy()
        most = np.lexsort((-held[row], -tf, doc))[np.cumsum(sizes) - sizes]
        order = np.lexsort((n, row[most]))
        place = np.empty(len(pdf), np.int64)
        place[order] = np.arange(len(pdf))
        m = 75 + (25 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        # Rows are spread over the square, so a path has its row to itself some levels above the bottom.
        rows_in = max(1, int(len(terms) - 1).bit_length())
        depth = max(rows_in, int(len(pdf) - 1).bit_length(), 1)
        spread = depth - rows_in
        # Terms of many documents stand together: one common term does not raise the maxima of rare ones.
        by_held = np.lexsort((terms, -held))
        rank = np.empty(len(terms), np.int64)
        rank[by_held] = np.arange(len(terms))
        tree = Treap.build(rank[row] << spread, place[doc], impact, depth)
        names = (pdf[c].to_numpy()[order] for c in ("id", "no_id", "uid"))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *names, terms[by_held], spread, held[by_held], *tree.to_columns())], columns=[c.split()[0] for c in TREE.split(", ")])

    return build


FOUND = "item bigint, id bigint, no_id boolean, uid bigint, score bigint"


def _searcher(k: int):
    def run(trees: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in trees.itertuples() if len(items) else ():
            tree = Treap.from_columns(t.depth, t.top, list(t.quadrants), list(t.less), list(t.widths)).opened()
            terms, ids, no_ids, uids = (np.asarray(x) for x in (t.terms, t.ids, t.no_ids, t.uids))
            turn = np.empty(len(ids), np.int64)
            turn[np.lexsort((uids, no_ids, ids))] = np.arange(len(ids))
            order = np.argsort(terms)
            names = terms[order]
            for q in items.itertuples():
                wanted, weight = np.asarray(q.terms), np.asarray(q.weights)
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                here = (names[at] == wanted) & (weight > 0)
                if here.any():
                    cols, scores = search(tree, order[at[here]] << t.spread, weight[here], turn, k, int(q.least))
                    out += [(q.item, ids[c], no_ids[c], uids[c], s) for c, s in zip(cols, scores, strict=True)]
        return pd.DataFrame(out, columns=["item", "id", "no_id", "uid", "score"]).astype({"item": "int64", "id": "int64", "no_id": bool, "uid": "int64", "score": "int64"})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int | None = None, block_items: int = 2048, most_wanted: int = 1_000_000, ws: Workspace | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of items.

    Terms are runs of ASCII digits, ASCII letters (A-Z lower-cased) and all other characters beyond ASCII. A term of weight
    floor(1000 ln((2N + 2) / (2 df + 1))) adds weight * (10**9 tf div (1000 tf + 12 m)) for each time that the item has it; m is
    100 - 25 + (25 n N div L). N counts documents with a term, L is the sum of their terms n.

    Texts are read once, into a row of term counts a document. Rows of the grid that no item asks for are not built, as long
    as the items have at most most_wanted terms (8 MB of hashes, broadcast); past that the grid has all terms. Documents are
    dealt by hash into shards of about shard_docs (a 32nd of them, 4,096 to 32,768, if not given), a K2-treap each, written
    as rows. Items go in blocks of about block_items, each block to each shard. An item is searched in one shard first; its k-th
    best score there is the least that the others need reach. Answers, at most k an item and shard, are merged by a window.

    Ties go to the smaller doc_id, null ids last. Rows that share an id are documents of their own, so are items. A null text has
    no terms, and an item without any known term no rows. Terms are told apart by 64-bit hashes. An empty table gives an
    empty result, and other columns, whatever their names, have no influence.
    """
    spark, ws = docs.sparkSession, ws or Workspace(docs.sparkSession, "ranked")
    asked = term_vectors(items, None, item_col, item_text).withColumn("item", F.monotonically_increasing_id())
    asked = ws.save(asked.withColumnRenamed("id", "item_id"), "items")
    n_items = asked.count()
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    few = wanted.limit(most_wanted + 1).count() <= most_wanted
    wanted = wanted.toArrow().column("term").to_numpy() if few else None

    vectors = ws.save(term_vectors(docs, wanted, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n_docs, n_terms, rows = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shard_docs = shard_docs or min(max(rows // 32, 4096), 32_768)
    shards, blocks = max(1, -(-rows // shard_docs)), max(1, -(-n_items // block_items))
    named = vectors.filter("size(terms) > 0").select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), F.col("id").isNull().alias("no_id"), "uid", "n", "terms", "tfs")
    dealt = named.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    trees = ws.save(dealt.groupBy("shard").applyInPandas(_builder(n_docs, max(1, n_terms)), TREE), "trees")

    held = trees.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.held").alias("df"))
    each = asked.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", F.col("x.terms").alias("term"), F.col("x.tfs").alias("times"))
    log = F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))
    weighed = each.join(held, "term").select("item", "term", (F.floor(1000 * log).cast("bigint") * F.col("times")).alias("weight"))
    queries = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("x"))
    queries = queries.select("item", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"), F.pmod(F.xxhash64("item"), F.lit(shards)).alias("home"), F.pmod(F.xxhash64("item", F.lit(2)), F.lit(blocks)).alias("block"))
    queries = ws.save(queries, "queries")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    placed = trees.withColumn("block", every(blocks))

    def searched(q: DataFrame, name: str) -> DataFrame:
        q = q.select(*(F.col(c).alias(c) for c in ("item", "terms", "weights", "least", "shard", "block")))
        return ws.save(placed.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(_searcher(k), FOUND), name)

    found = searched(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(1).cast("bigint")), "first")
    if shards > 1:
        least = found.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = queries.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("bigint")))
        found = found.unionByName(searched(rest.withColumn("shard", every(shards)).filter("shard <> home"), "rest"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id", "no_id", "uid")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score")
