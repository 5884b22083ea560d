"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, Workspace, claim_cache, shuffle_partitions
from tidemark.llm.graph import components
from tidemark.llm.shingles import M3, MinHash, _words, scrambled, shingle_hashes

HASHES, ROWS, BATCH, BLOCK = 128, 4, 32, 256
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of n equal minima at which the similarity, under a uniform prior, is percent/100 or more with a
    probability of at least miss."""
    x = np.linspace(0, 1, 20_001)[1:-1]
    for m in range(n + 1):
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        density = np.exp(log - log.max())
        if density[x >= percent / 100].sum() >= miss * density.sum():
            return m
    return n


@cache
def verifier(percent: int, miss: float) -> Verifier:
    """One per worker process: its bounds take longer to find than a group to verify."""
    return Verifier(percent, miss)


class Verifier:
    def __init__(self, percent: int, miss: float):
        self.percent, self.minhash = percent, MinHash(HASHES)
        self.least = [(n, least_matches(n, percent, miss)) for n in range(BATCH, HASHES + 1, BATCH)]

    def prepared(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        claim_cache(_words)
        sets = [shingle_hashes(t) for t in texts]
        return sets, self.minhash.signatures(sets)

    def competitive(self, sig: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that may be similar to i: batch after batch, a pair goes once its posterior is too low."""
        matches, before = np.zeros(len(others), np.int64), 0
        for n, least in self.least:
            matches += (sig[others, before:n] == sig[i, before:n]).sum(1)
            alive = matches >= least
            others, matches, before = others[alive], matches[alive], n
            if not len(others):
                break
        return others

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _star(percent: int, miss: float):
    """Links between a bucket's hub and its other members."""

    def run(rows: pa.Table) -> pa.Table:
        v = verifier(percent, miss)
        ids, lead = rows.column("id").to_numpy(), rows.column("lead").to_numpy(zero_copy_only=False)
        if not lead.any():
            return LINKS.empty_table()
        sets, sig = v.prepared(rows.column("body").to_pylist())
        hub = int(np.flatnonzero(lead)[0])
        found = [int(ids[j]) for j in v.competitive(sig, hub, np.flatnonzero(~lead)) if v.similar(sets[hub], sets[j])]
        return pa.table({"a": [int(ids[hub])] * len(found), "b": found}, LINKS)

    return run


def _block(percent: int, miss: float):
    """Links across two blocks of a bucket (or within one), between documents not yet connected."""

    def run(rows: pa.Table) -> pa.Table:
        v = verifier(percent, miss)
        ids, comp, block = (rows.column(c).to_numpy() for c in ("id", "comp", "block"))
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        sets, sig = v.prepared(rows.column("body").to_pylist())
        right, found = np.flatnonzero(block == two), []
        comp = comp.copy()
        for i in np.flatnonzero(block == one):
            others = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (one != two))]
            for j in v.competitive(sig, i, others):
                if comp[i] != comp[j] and v.similar(sets[i], sets[j]):
                    comp[comp == comp[j]] = comp[i]
                    found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": [a for a, _ in found], "b": [b for _, b in found]}, LINKS)

    return run


def _digest(docs: DataFrame) -> DataFrame:
    """(id, n, k1, k2, sig): the size of each text's shingle set, 128 bits that tell the set, and its signature."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(_words)
        minhash = MinHash(HASHES)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, minhash.signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row.tobytes()
                k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([np.bitwise_xor.reduce(scrambled(s * M3)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(sig, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-5, ws: Workspace | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked when 100 * intersection >= percent * union of their sets of 5-word shingles. Documents with equal
    sets are one class from the start, whose smallest id stands for it. 32 bands of 4 minima give candidates (a pair at
    similarity 0.75 shares no band with a probability of 5e-6). First each bucket's smallest member is compared with the
    others; then, in buckets whose members are not all connected, the members of different components are compared, block
    by block. A pair's minima are compared 32 at a time, and it goes once its posterior probability to be similar enough is
    below `miss`; the rest is verified on the full sets, inside the task, and only links come out: never all pairs.

    A text without words (null, empty) has an empty set, no links, itself as its component. Rows with null ids are
    returned with a null component, kept, and take no part. Rows that repeat an id are judged each by its text; an id stands
    for all of them in links. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "near")
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
    digests = ws.save(_digest(base), "digests")
    sets = digests.filter("n > 0 and id is not null")
    classes = ws.save(sets.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig")), "classes")

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    bands = classes.select("rep", band.alias("band", "key")).select("rep", "key")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size"), F.max("rep").alias("last")).filter("hub < last").drop("last")
    buckets = ws.save(buckets, "buckets")
    members = ws.save(bands.join(buckets, "key").select("key", "rep", "hub", "size"), "members")

    pairs = ws.save(members.filter("rep <> hub").select("hub", "rep").distinct().withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(shuffle_partitions(spark)))), "pairs")
    ends = pairs.select("hub", "salt", F.col("rep").alias("id"), F.lit(False).alias("lead")).unionByName(pairs.select("hub", "salt", F.col("hub").alias("id"), F.lit(True).alias("lead")).distinct())
    links = ws.save(_with_texts(ends, base, ws, "star").groupBy("hub", "salt").applyInArrow(_star(percent, miss), "a bigint, b bigint"), "links-star")

    comp = ws.save(components(links, ws, "comp1"), "comp1")
    wide = members.filter("size > 2 and rep <> hub")
    placed = ws.save(wide.join(comp, wide["rep"] == comp["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    open_ = ws.save(placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "open")
    rows = placed.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), F.col("rep").alias("id"), "comp", "block")
    more = ws.save(_with_texts(ws.save(rows, "rest"), base, ws, "rest").groupBy("key", "one", "two").applyInArrow(_block(percent, miss), "a bigint, b bigint"), "links-block")

    final = ws.save(components(links.unionByName(more), ws, "comp2"), "comp2")
    named = digests.drop("sig").join(classes.drop("sig"), ["k1", "k2", "n"], "left")
    out = named.join(final, named["rep"] == final["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _with_texts(rows: DataFrame, base: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """rows with the text of each id; texts of other documents are left out of the shuffle where the filter knows them."""
    texts = KeyFilter(rows.select("id"), ["id"]).flag(base.filter("id is not null"), "wanted").filter("wanted").select("id", "body")
    return rows.join(texts, "id")
