"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, Workspace


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = 256, digest_all: bool = False, ws: Workspace | None = None) -> DataFrame:
    """Returns (id, keep_id, group_size, kept, n_bytes, sha256) for every row of docs.

    Texts are equal when identical after white space runs become one space. The first pass notes each text's length and
    a hash of its first `prefix_bytes`; lengths held by one text only are settled there, then (length, prefix) pairs held
    by one only. A second pass reads and hashes the whole text of what is left, inside the scan: texts are never shuffled.
    Groups are sums by key (pre-aggregated), so thousands of copies of one text do not meet in a task.

    A null text is the empty text. keep_id is the smallest id of the group; rows with null ids are kept only in groups
    without any other id. Rows that share their id and text are one document: all are kept or none, and each counts in
    group_size. sha256 is null for texts settled early, unless digest_all. An empty table gives an empty result, and
    other columns of docs, whatever their names, have no influence.
    """
    ws = ws or Workspace(docs.sparkSession, "exact")
    text = normalised(F.col(f"`{text_col}`")).cast("binary")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body"))

    keyed = lambda df: df.withColumn("len", F.octet_length("body").cast("long")).withColumn("prefix", F.xxhash64(F.substring("body", 1, prefix_bytes)))
    first = ws.save(keyed(base).groupBy("len", "prefix").agg(F.count("*").alias("n")), "first")
    by_length = first.groupBy("len").agg(F.sum("n").alias("n_len")).filter("n_len > 1").select("len")
    survivors = first.filter("n > 1").join(by_length, "len", "left_semi").select("len", "prefix")
    perhaps = KeyFilter(survivors, ["len", "prefix"])

    full = perhaps.flag(keyed(base), "alive")
    sha = F.sha2("body", 256)
    hashed = ws.save(full.select("id", "len", "alive", (sha if digest_all else F.when(F.col("alive"), sha)).alias("sha")), "hashed")
    groups = hashed.filter("alive").groupBy("len", "sha").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    groups = ws.save(groups, "groups")
    # Both sides are written tables, so adaptive execution can split a hot group.
    joined = hashed.join(groups, ["len", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("len").alias("n_bytes"), F.col("sha").alias("sha256"))
