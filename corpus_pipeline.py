"""Corpus pipeline: quality, exact and near duplicates, mixing, packing; each stage works on all that the last one kept.

The filtering stages judge rows, not ids: where a doc_id repeats or is null, rows are numbered by (doc_id, text) first, null
ids last, and that number is the key. Rows equal in both are one document until the exact stage, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, drop_keys, keyed_rows, ship_package
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix, source_rates
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.quality import quality_selection

SEQUENCE = 2048
TOKENIZER = "word_bpe_49k.json"

#: Selection is by sampled log ratios, near duplicates by bands and packing by local search: SQL can't express them.
ORACLE_SQL = None


ROW = "pipeline_row"


def _boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows of docs as one column `doc` beside those that a stage reads, so no other column can clash with its helpers."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *columns)


def _filtered(docs: DataFrame, judge, once: bool = False) -> DataFrame:
    """docs without the rows that judge(docs, key column) rejects: its rows are (id, kept). With `once`, equal rows stay once."""
    ws = Workspace(docs.sparkSession, "filtered")
    keyed, numbered = keyed_rows(_boxed(docs, "doc_id", "text"), ws, "doc_id", "text", ROW)
    judged = judge(keyed, ROW)
    dropped = ws.save(judged.filter("not kept").select(F.col("id").alias(ROW)), "ids")
    kept = drop_keys(keyed, dropped, ROW)
    return (kept.dropDuplicates([ROW]) if once and numbered else kept).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; all rows of a labelled doc_id have its label."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    def judge(keyed: DataFrame, key: str) -> DataFrame:
        named = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), key).distinct().join(labels.select("doc_id", "quality", "toxic"), "doc_id")
        return quality_selection(keyed, named.select(F.col(key).alias("doc_id"), "quality", "toxic"), id_col=key)

    return _filtered(docs, judge)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal documents, one row of it."""
    ship_package(spark)
    return _filtered(docs, lambda keyed, key: exact_dedup(keyed, id_col=key), once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near duplicates."""
    ship_package(spark)
    return _filtered(docs, lambda keyed, key: near_dedup(keyed, id_col=key))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate has it, in shuffled order."""
    ship_package(spark)
    return mix(_boxed(docs, "doc_id", "source"), source_rates(docs)).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of SEQUENCE tokens."""
    ship_package(spark)
    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER), SEQUENCE), SEQUENCE)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the shared folder and read again."""
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
