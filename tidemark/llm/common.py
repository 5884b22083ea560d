"""Shared pieces of the training-data operators: tables in the shared folder and a key filter of bounded size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where spark.checkpoint.dir is unset, a local master (tests) has a temporary one;
    on a cluster there is none then."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_tidemark_dir"):
        sc._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return sc._tidemark_dir


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application, as `--py-files` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._tidemark_shipped = True


_caches: list[dict] = []


def claim_cache(mine: dict) -> dict:
    """A worker process serves one operator after another: what the others have cached in it goes."""
    if not any(c is mine for c in _caches):
        _caches.append(mine)
    for cache in _caches:
        if cache is not mine:
            cache.clear()
    return mine


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; after each partition the memory that it no longer needs goes back to the system, caches too. Worker
    processes live on between tasks, and what they or their allocators keep for later counts as their executor's."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for cache in _caches:
            cache.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return whole


class Workspace:
    """Written tables of one run. They cut lineage: a lost executor costs a reread, not a rerun of what came before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df as written; `by`: columns that have folders of their own, which can be dropped apart."""
        df.write.partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Once a written table has cut the lineage: lets Spark's cleaner delete the shuffle files that nothing refers to now,
    instead of at the driver's next garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class KeyFilter:
    """A bitmap of hashed keys, broadcast to every task: about 16 bits a counted key, from 2**16 to 2**27 (16 MB) in all.

    A key that was put in is always found; others are found by chance (one in sixteen, more only beyond eight million keys),
    so callers must treat a hit as "perhaps" and a miss as "surely not". It spares non-members a shuffle. Past 2**27 keys it
    would let nearly all rows through, so none is built then: that costs time but not results.
    """

    WORDS = 128  # 64-bit words in a row of the broadcast table

    def __init__(self, keys: DataFrame, columns: list[str]):
        n = keys.count()
        self.columns, self.bits = columns, min(max(16, (16 * n - 1).bit_length()), 27)
        self.table = None
        if n <= 1 << 27:
            word = keys.select(self._slot([F.col(c) for c in columns]).alias("__slot"))
            word = word.groupBy(F.expr("shiftright(__slot, 6)").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__slot & 63 as int))")).alias("__bits"))
            place = F.expr(f"cast(__word % {self.WORDS} as int)")
            row = word.groupBy(F.floor(F.col("__word") / self.WORDS).alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct(place, "__bits"))).alias("__m"))
            self.table = row.select("__row", F.transform(F.sequence(F.lit(0), F.lit(self.WORDS - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0))).alias("__mask"))

    def _slot(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(1 << self.bits))

    def flag(self, df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
        """Adds the boolean column `name`: true where the key is perhaps a member."""
        if self.table is None:
            return df.withColumn(name, F.lit(True))
        slot = self._slot([F.col(f"`{c}`") for c in (columns or self.columns)])
        out = df.withColumn("__slot", slot).withColumn("__row", F.expr(f"shiftright(__slot, 6) div {self.WORDS}"))
        out = out.join(F.broadcast(self.table), "__row", "left")
        word = F.get("__mask", F.expr(f"cast(shiftright(__slot, 6) % {self.WORDS} as int)"))
        hit = F.getbit(F.coalesce(word, F.lit(0)), F.expr("cast(__slot & 63 as int)")) == 1
        return out.withColumn(name, hit).drop("__row", "__slot", "__mask")


def drop_keys(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in dropped (one column, same name; null keys stay).

    Only rows that the key filter lets through are shuffled; the others, with their texts, go straight on.
    """
    flagged = KeyFilter(dropped, [key]).flag(df, "__perhaps")
    clear = flagged.filter("not __perhaps").drop("__perhaps")
    rest = flagged.filter("__perhaps").drop("__perhaps").join(dropped.select(F.col(key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
    return clear.unionByName(rest)


def keyed_rows(docs: DataFrame, ws: Workspace, id_col: str, text_col: str, key: str) -> tuple[DataFrame, bool]:
    """docs with the column `key`, which rises with the id and tells rows apart: the id itself where ids are distinct and
    never null (False), else the row's number by (id, text), null ids last (True); rows equal in both have one key. The
    latter shuffles texts, the former only ids."""
    own = F.col(f"`{id_col}`").cast("bigint")
    odd = docs.groupBy(own.alias("key_id")).count().filter("key_id is null or count > 1").limit(1).count()
    if not odd:
        return docs.withColumn(key, own), False
    tagged = docs.withColumn("key_tag", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")))).withColumn("key_id", own)
    keys = tagged.select("key_id", "key_tag").distinct().sort(F.asc_nulls_last("key_id"), "key_tag")
    keys = ws.save(keys.withColumn(key, F.monotonically_increasing_id()), "rows")  # partitions of a sort are in its order
    keys = keys.withColumnsRenamed({"key_id": "row_id", "key_tag": "row_tag"})
    same = F.col("key_id").eqNullSafe(F.col("row_id")) & (F.col("key_tag") == F.col("row_tag"))
    return tagged.join(keys, same).drop("key_id", "key_tag", "row_id", "row_tag"), True
