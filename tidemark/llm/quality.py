"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, claim_cache
from tidemark.llm.shingles import PLACE, scrambled

TOKENS = re.compile(r"\w+|[^\w\s]+")
SAMPLE = 20_000  # labelled rows that the target model is fitted on, at most
BUCKETS = 1 << 14
PRIORS = tuple(10.0 ** (x / 2) for x in range(4, 15))  # features of the raw model in the target's, tried on held-out texts
KNOWN = 300_000  # token hashes that a worker keeps


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        if len(self) < KNOWN and len(token) <= 64:
            self[token] = h
        return h


_tokens = TokenHashes()


def features(text: str) -> np.ndarray:
    """The bucket of each word or run of marks, in lower case, and of each pair of neighbours."""
    found = TOKENS.findall(text.lower())
    h = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    pairs = scrambled(h[:-1] * PLACE[0] + h[1:] * PLACE[1])
    return np.concatenate([h, pairs]).astype(np.int64) & (BUCKETS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this partition by bucket: of all texts, and of the target's."""
    claim_cache(_tokens)
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            chosen = part.column(1).to_numpy(zero_copy_only=False)
            for text, hit in zip(part.column(0).to_pylist(), chosen, strict=True):
                n = np.bincount(features(text), minlength=BUCKETS)
                raw += n
                if hit:
                    target += n
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "raw": raw[used], "target": target[used]})


def model_counts(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts of each bucket (two vectors of BUCKETS numbers, whatever the input).

    Raw counts cover all documents; target_ids (column `target_id`) must be bounded, as it is broadcast.
    """
    flagged = _flagged(docs, target_ids, "target_id", id_col, text_col)
    counts = flagged.select("text", F.col("target_id").isNotNull().alias("hit")).mapInArrow(_counts, "bucket int, raw bigint, target bigint")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def _flagged(docs: DataFrame, few: DataFrame, key: str, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return base.join(F.broadcast(few), F.col("id") == F.col(key), how)


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = 1000.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the target model is smoothed towards the raw one by `prior` features."""
    p_raw = raw / max(1.0, raw.sum())
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    return np.log(np.divide(p_target, p_raw, out=np.ones(BUCKETS), where=p_raw > 0))


def held_out_ratios(found: np.ndarray, hit: bool, raw: np.ndarray, target: np.ndarray, sums: tuple[float, float], priors: tuple[float, ...]) -> list[float]:
    """A text's log ratio under each prior, by models that its own counts are taken out of; sums are those of raw and target."""
    at, n = np.unique(found, return_counts=True)
    others = raw[at] - n
    known = others > 0  # what only this text has tells nothing
    at, n, others = at[known], n[known], others[known]
    own = len(found) if hit else 0
    p_raw = others / max(1.0, sums[0] - len(found))
    p_target = (target[at] - n if hit else target[at]) / p_raw
    return [float(n @ np.log((p_target + prior) / (sums[1] - own + prior))) for prior in priors]


def _judged(raw: np.ndarray, target: np.ndarray):
    """(clean, n_features, ratios): a row a labelled text, its held-out log ratio under each of PRIORS."""
    schema = pa.schema([("clean", pa.bool_()), ("n_features", pa.int64()), ("ratios", pa.list_(pa.float64()))])
    sums = (raw.sum(), target.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(_tokens)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                clean, found = part.column(1).to_pylist(), [features(t) for t in part.column(0).to_pylist()]
                ratios = [held_out_ratios(f, c, raw, target, sums, PRIORS) for f, c in zip(found, clean, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(ratios, schema.field(2).type)], schema=schema)

    return run


def chosen(clean: np.ndarray, n: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """The prior under which the held-out clean texts are likeliest, and the cut by ratio a feature that tells most of the
    labelled texts right: the lowest of the best, half-way to the next text below it."""
    some = n > 0
    clean, mean = clean[some], ratios[some] / n[some, None]
    if not clean.any():
        return PRIORS[0], -np.inf
    best = int(ratios[some][clean].sum(axis=0).argmax())
    order = np.argsort(mean[:, best], kind="stable")
    score, right = mean[order, best], clean[order]
    gained = np.concatenate([[0], np.cumsum(np.where(right, -1, 1))])[: len(score)]  # right answers by dropping those below
    gained[1:][score[1:] == score[:-1]] = -len(score) - 1
    i = int(gained.argmax())
    return PRIORS[best], float(score[i] if i == 0 else (score[i] + score[i - 1]) / 2)


def _scores(raw: np.ndarray, target: np.ndarray, prior: float, cut: float):
    schema = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("log_ratio", pa.float64()), ("margin", pa.float64())])
    weights, sums = log_ratios(raw, target), (raw.sum(), target.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(_tokens)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found, hits = [features(t) for t in part.column(1).to_pylist()], part.column(2).to_pylist()
                margins = [held_out_ratios(f, h, raw, target, sums, (prior,))[0] - (cut * len(f) if len(f) else 0.0) for f, h in zip(found, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([float(weights[f].sum()) for f in found]), pa.array(margins, pa.float64())], schema=schema)

    return run


def gumbel(seed: int, key: Column) -> Column:
    """-log(-log(u)), u from the hash of seed and key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a bigint column, by counting in ever narrower bins: at most `bins` rows reach the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        inside = df.filter(F.col(column).between(lo, hi)).select(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("int").alias("bin")) if width == 1 else df.filter(F.col(column).between(lo, hi)).select(F.expr(f"cast(({column} - {lo}L) div {width}L as int)").alias("bin"))
        for b, count in sorted(((r["bin"], r["count"]) for r in inside.groupBy("bin").count().collect()), reverse=True):
            if k <= count:
                lo, hi = lo + b * width, min(hi, lo + b * width + width - 1)
                break
            k -= count
    return lo


def quality_selection(docs: DataFrame, labels: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, ws: Workspace | None = None) -> DataFrame:
    """(id, n_features, log_ratio, margin, sample_key, kept) for every row of docs.

    The target is text labelled quality 1 and not toxic (doc_id, quality, toxic; at most `sample` labelled rows, those of
    the smallest hash); raw is all text. A document's log ratio is the sum over its words, runs of marks and their pairs
    of the hashed models' log ratios, the target's smoothed by 1000 features. Selection goes by margin: the log ratio by
    models without the document's own counts, so that labelled and other rows are scored alike, less cut * n_features.
    The smoothing is that under which the labelled clean rows, each held out, are likeliest; cut is the ratio a feature
    that tells most labelled rows right, low-quality and toxic ones being no target. Exact copies of a row are not held
    out with it. Gumbel top-k then samples k documents without replacement in proportion to exp(margin): sample_key is
    the margin plus Gumbel noise from seed and id, and the k highest keys are kept, ties by id. k is the number of
    documents of margin 0 or more.

    A null text is empty and has ratio and margin 0. Rows that repeat an id have equal noise; rows equal in key and id are
    kept or dropped together; a null id is the smallest. Labels that are null are no target. Without labels of clean rows
    in docs, or without rows, all is kept. Other columns of docs are not looked at.
    """
    ws = ws or Workspace(docs.sparkSession, "quality")
    clean = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    seen = labels.filter("doc_id is not null and quality is not null").select("doc_id", clean.alias("clean")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = ws.save(seen.groupBy(F.col("doc_id").cast("bigint").alias("target_id")).agg(F.bool_or("clean").alias("clean")), "seen")
    ids = seen.filter("clean").select("target_id")
    raw, target = model_counts(docs, ids, id_col, text_col)
    judged = _flagged(docs, seen, "target_id", id_col, text_col, "inner").select("text", "clean").mapInArrow(_judged(raw, target), "clean boolean, n_features bigint, ratios array<double>")
    rows = judged.orderBy(F.xxhash64("n_features", "ratios"), "n_features").limit(sample).collect()  # `sample` rows at most
    prior, cut = chosen(np.array([r["clean"] for r in rows], bool), np.array([r["n_features"] for r in rows], np.int64), np.array([r["ratios"] for r in rows], float).reshape(-1, len(PRIORS)))
    base = _flagged(docs, ids, "target_id", id_col, text_col).select("id", "text", F.col("target_id").isNotNull().alias("hit"))
    scored = base.mapInArrow(_scores(raw, target, prior, max(cut, -1e6)), "id bigint, n_features bigint, log_ratio double, margin double")
    scored = scored.withColumn("sample_key", F.col("margin") + gumbel(seed, F.col("id"))).withColumn("rank_key", F.round(F.col("sample_key") * 1e6).cast("bigint"))
    scored = ws.save(scored, "scored")
    k = scored.filter("margin >= 0").count()
    cut = kth_largest(scored, "rank_key", k)
    if cut is None:
        kept = F.lit(False)
    else:
        above = scored.filter(F.col("rank_key") > cut).count()
        tied = scored.filter(F.col("rank_key") == cut).select((-F.coalesce("id", F.lit(-(1 << 62)))).alias("minus_id"))
        last = kth_largest(tied, "minus_id", k - above)
        kept = (F.col("rank_key") > cut) | ((F.col("rank_key") == cut) & (-F.coalesce("id", F.lit(-(1 << 62))) >= F.lit(last)))
    return scored.select("id", "n_features", "log_ratio", "margin", "sample_key", kept.alias("kept"))
