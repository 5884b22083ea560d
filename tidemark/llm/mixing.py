"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

PART = 500.0  # larger means are drawn as sums of parts, so that exp(-mean) stays well above zero


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of its parts: the first 13 hexadecimal digits over 2**52."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest n with u <= P(N <= n), N Poisson with this mean (up to PART)."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + (s["cdf"] < u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["n"]


def source_rates(docs: DataFrame, group_col: str = "source", text_col: str = "text", alpha: float = 0.7) -> DataFrame:
    """(mix_group, rate): the mean number of copies of a document of each source.

    A source's share of the mix is its share of the bytes raised to alpha and normalised; the mix as a whole is as long
    as the input. Each text counts one byte more than it has, so that a source of empty texts has a rate too. A null
    source is the source ''.
    """
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("bigint") + 1
    sizes = docs.groupBy(F.coalesce(F.col(f"`{group_col}`"), F.lit("")).alias("mix_group")).agg(F.sum(size).alias("bytes"))
    sizes = Workspace(docs.sparkSession, "rates").save(sizes, "sizes")
    total, scaled = sizes.agg(F.sum("bytes"), F.sum(F.pow(F.col("bytes").cast("double"), F.lit(alpha)))).first()
    share = F.pow(F.col("bytes").cast("double"), F.lit(alpha)) / F.lit(scaled or 1.0)
    return sizes.select("mix_group", (share * F.lit(float(total or 0)) / F.col("bytes")).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 17, id_col: str = "doc_id", group_col: str = "source", small: int = 10_000) -> DataFrame:
    """All columns of docs with mix_rate, mix_copy (from 1) and mix_key, a row per copy, in the order of mix_key.

    A document has Poisson(rate) copies, inverted from a uniform number that the seed and its id determine; a source that
    rates lacks has none. The copies are then ordered by a hash of seed, id and copy, over all partitions: a global
    shuffle. Rates are broadcast when counted to be at most `small`, else joined by shuffle, where adaptive execution
    splits a hot source. Repeated rows have equal counts; a null id counts as the id 'null'. Columns of docs that have one
    of the three names are replaced.
    """
    docs = docs.drop("mix_rate", "mix_copy", "mix_key", "mix_group")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rates = F.broadcast(rates) if rates.limit(small + 1).count() <= small else rates
    named = docs.withColumn("mix_group", F.coalesce(F.col(f"`{group_col}`"), F.lit("")))
    rated = named.join(rates.withColumnRenamed("rate", "mix_rate"), "mix_group").drop("mix_group")
    parts = F.greatest(F.ceil(F.col("mix_rate") / PART), F.lit(1)).cast("int")
    draw = lambda i: poisson(F.col("mix_rate") / parts, uniform(F.lit(seed), key, i))
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + draw(i))
    copies = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    exploded = rated.withColumn("mix_copy", F.explode(copies))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key, F.col("mix_copy"), F.lit("order"))), 1, 15), 16, 10).cast("bigint")
    exploded = exploded.withColumn("mix_key", order)
    return exploded.repartitionByRange("mix_key").sortWithinPartitions("mix_key", id_col, "mix_copy")
