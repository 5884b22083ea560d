"""Deduplication of lines across documents: levelled sorted runs of line hashes, all in DataFrame functions."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, Workspace

SPACE = " \t\n\v\f\r"
KEY = ["h1", "h2"]
BUCKET = 1 << 23  # lines, of all batches, that a bucket is planned for
NO_ID = -(1 << 63)  # a null id counts as this one


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, tag, pos, h1, h2): a row for each line of docs (id, tag, body) whose key has at least min_chars code points; a
    key's hash has 128 bits."""
    lines = docs.select("id", "tag", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return lines.select("id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """What batches of lines have held: a row (h1, h2, n, last) for each hash of a run, n documents and the largest id.

    A run is a bucketed table, sorted by hash, so a batch is dealt by hash once and then merges with every run bucket by
    bucket; runs are never shuffled again. A batch first loses the hashes that a run has settled (n of min_docs or more,
    and no smaller last): nothing in the batch can change what is known of them. What is left becomes a run of level 0. Once a
    level has `fan` runs they are merged into one run of the next level, so a hash is rewritten once a level.

    Sums and maxima do not depend on the order of the batches; batches of falling ids settle hashes soonest. All rows of
    an id must come in one batch.
    """

    def __init__(self, ws: Workspace, min_docs: int, buckets: int, fan: int = 2):
        self.ws, self.spark, self.min_docs, self.buckets, self.fan = ws, ws.spark, min_docs, buckets, fan
        self.name, self.made = f"line_run_{uuid.uuid4().hex}", 0
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, entries: DataFrame) -> DataFrame:
        """entries as a run; they are dealt by KEY to as many partitions as there are buckets, so each task writes one."""
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.ws.path(name)).saveAsTable(name)
        return self.spark.table(name)

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        # The filter holds for every entry. It makes rows of the scans' column batches: a union of rows puts bucket to bucket, as
        # its plan says, but one of batches (Spark 4.1) lines the files up one after another and leaves a hash in several tasks.
        every = runs[0].filter("n > 0")
        for r in runs[1:]:
            every = every.unionByName(r.filter("n > 0"))
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, lines: DataFrame) -> None:
        """Takes a batch of (h1, h2, id) in."""
        batch = lines.groupBy(*KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).repartition(self.buckets, *KEY).alias("b")
        for run in self.runs:
            settled = run.filter(F.col("n") >= self.min_docs).alias("r")
            same = (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2")) & (F.col("r.last") >= F.col("b.last"))
            batch = batch.join(settled.hint("merge"), same, "left_anti").alias("b")
        self.levels[0].append(self._write(batch))
        for depth, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(self._merged(level)))
            self.levels[depth] = []

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of the hashes that at least min_docs documents hold."""
        return self._merged(self.runs).filter(F.col("n") >= self.min_docs).select(*KEY, "last")

    def forget(self) -> None:
        """Takes the runs out of the catalog; their files are of the workspace."""
        for i in range(self.made):
            self.spark.sql(f"drop table if exists {self.name}_{i}")


def _kept(body: Column, drops: Column) -> Column:
    """The lines between the dropped positions (ascending), joined; linear in the text."""
    lines, n = F.split(body, "\n"), F.size(drops)
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(drops, j - 1) + 1)
    stop = lambda j: F.coalesce(F.get(drops, j), F.size(lines))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(lines, start(j) + 1, stop(j) - start(j)))
    return F.array_join(F.flatten(pieces), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, fan: int = 2, ws: Workspace | None = None) -> DataFrame:
    """(id, n_lines, n_dropped, kept): a row for each row of docs, kept being its text without the lines dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least min_chars code points
    that at least min_docs documents hold loses all its lines, except in the document of the largest id. Lines end at \\n.

    One pass over the texts writes the lines' hashes by batch, batches being ranges of ids, largest first; each batch goes
    through LineRuns. Hashes of lines that are perhaps repeated (a filter of bounded size tells) are joined with the repeated
    ones, where adaptive execution splits a hot line, and give each text's dropped positions; only texts with some are
    shuffled.

    A null text is the empty text, which is one empty line. Rows that share an id are one document: they count once, and all
    keep or lose a key; a null id is the id -2**63. An empty table gives an empty result, and other columns, whatever their
    names, have no influence.
    """
    ws = ws or Workspace(docs.sparkSession, "lines")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("own"), text.alias("body"))
    base = base.select("own", F.coalesce(F.col("own").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("body").alias("tag"), "body")

    cuts = base.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    number = sum((F.when(F.col("id") <= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    hashed_lines(base, min_chars).withColumn("batch", number).write.partitionBy("batch").parquet(ws.path("hashes"))
    hashes = docs.sparkSession.read.schema("id bigint, tag bigint, pos int, h1 bigint, h2 bigint, batch int").parquet(ws.path("hashes"))

    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-hashes.count() // BUCKET))
    runs = LineRuns(ws, min_docs, buckets, fan)
    try:
        for b in range(len(set(cuts or [])) + 1):
            runs.add(hashes.filter(F.col("batch") == b).select(*KEY, "id"))
        repeated = ws.save(runs.repeated(), "repeated")
    finally:
        runs.forget()  # names in the catalog outlive a failure otherwise

    perhaps = KeyFilter(repeated, KEY).flag(hashes.drop("batch"), "alive").filter("alive")
    gone = perhaps.join(repeated, KEY).filter(F.col("id") < F.col("last"))
    drops = gone.groupBy("id", "tag").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    drops = ws.save(drops, "drops")

    flagged = KeyFilter(drops, ["id", "tag"]).flag(base, "some")
    clear = flagged.filter("not some").select("own", "body", F.array().cast("array<int>").alias("drops"))
    rest = flagged.filter("some").join(drops, ["id", "tag"], "left").select("own", "body", F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    out = clear.unionByName(rest).withColumn("lines", F.split("body", "\n"))
    kept = F.when(F.size("drops") == 0, F.col("body")).otherwise(_kept(F.col("body"), F.col("drops")))
    return out.select(F.col("own").alias("id"), F.size("lines").cast("bigint").alias("n_lines"), F.size("drops").cast("bigint").alias("n_dropped"), kept.alias("kept"))
