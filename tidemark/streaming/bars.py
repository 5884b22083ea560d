"""Streams of ticks to bars, and keyed upserts with an online model per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.sources.ingest import upsert


def bars_of(ticks: DataFrame, window: str = "1 day") -> DataFrame:
    """Tumbling bars of (symbol, ts, price, event_id); the same plan for a stream and for a table."""
    order = F.struct("ts", "event_id")
    g = ticks.groupBy(F.window("ts", window).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n_ticks")
    )
    return g.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n_ticks")


def stream_bars(ticks: DataFrame, to: str, checkpoint: str, late: str = "2 days", window: str = "1 day") -> None:
    """Appends finished bars of a stream of ticks to a table; ticks later than `late` are dropped. Ends with the input."""
    bars = bars_of(ticks.withWatermark("ts", late), window)
    q = bars.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_batches(source: DataFrame, spark: SparkSession, store: str, checkpoint: str, keys: list[str], order: tuple[str, ...] = (), on_batch: Callable[[DataFrame, int], None] | None = None, parts: int = 16) -> None:
    """Each micro-batch replaces the rows of equal keys in a table; of a batch's rows with equal keys the greatest in `order`
    wins.

    The table is held in `parts` parts by a hash of the keys. A batch rewrites only the parts that it touches, under its own
    number; a list a batch says which number is the newest of each part. A batch that is run again starts from the list of
    the batch before and writes the same files, so a restart does no harm. on_batch must be safe to repeat as well. Files that
    neither this batch's list nor the one before needs are deleted.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        newest = _newest(spark, store, number - 1)
        touched = [r["part"] for r in batch.select("part").distinct().collect()]  # `parts` numbers at most
        base = _parts(spark, store, {p: v for p, v in newest.items() if p in touched}, batch)
        if touched:
            upsert(base, batch, ["part", *keys], order).write.mode("overwrite").partitionBy("part").parquet(f"{store}/v{number}")
        newest |= dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(newest.items()), "part int, number int").coalesce(1).write.mode("overwrite").parquet(f"{store}/list{number}")
        if on_batch:
            on_batch(batch.drop("part"), number)
        batch.unpersist()
        if number > 1 and _exists(spark, f"{store}/list{number - 2}"):  # not if this batch has got so far before
            older, before = _newest(spark, store, number - 2), _newest(spark, store, number - 1)
            unused = set(older.values()) - set(before.values()) - set(newest.values())
            for name in [*(f"v{n}" for n in unused), f"list{number - 2}"]:
                _delete(spark, f"{store}/{name}")

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    files, p = _files(spark, path)
    return files.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def _newest(spark: SparkSession, store: str, number: int) -> dict[int, int]:
    return {} if number < 0 else {r["part"]: r["number"] for r in spark.read.parquet(f"{store}/list{number}").collect()}  # a row a part


def _parts(spark: SparkSession, store: str, newest: dict[int, int], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for number in sorted(set(newest.values())):  # a read a number that is still the newest of some part
        mine = [p for p, v in newest.items() if v == number]
        out = out.unionByName(spark.read.schema(like.schema).parquet(f"{store}/v{number}").filter(F.col("part").isin(mine)))
    return out


def upserted(spark: SparkSession, store: str, number: int, like: DataFrame) -> DataFrame:
    """The table after micro-batch `number`, with the columns of `like`."""
    out = _parts(spark, store, _newest(spark, store, number), like.withColumn("part", F.lit(0)))
    return out.select(like.columns)


class Learner:
    """Online weights, moved by a gradient step per micro-batch and stored with its number: a batch that is run again starts
    from the weights of the batch before, and a new process goes on where the last one ended."""

    def __init__(self, spark: SparkSession, store: str, features: list[str], rate: float = 0.1):
        self.spark, self.store, self.features, self.rate = spark, store, features, rate

    def weights(self, number: int) -> dict[str, float]:
        return {} if number < 0 else {r["feature"]: r["weight"] for r in self.spark.read.parquet(f"{self.store}/w{number}").collect()}  # a row a feature

    def step(self, batch: DataFrame, number: int) -> None:
        new = md.online_step(self.weights(number - 1), batch, self.features, rate=self.rate)
        self.spark.createDataFrame(sorted(new.items()), "feature string, weight double").coalesce(1).write.mode("overwrite").parquet(f"{self.store}/w{number}")
