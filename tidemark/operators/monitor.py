"""Evaluation and drift: stability index, precision, AUC, R squared, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*").filter("x is not null")


def with_below(df: DataFrame, key: str, value: str, counts: list[str], blocks: int = 256) -> DataFrame:
    """Adds below_{c} for each of counts: its sum over the rows of the same key with a smaller value. Values are distinct.

    A key's values are cut into blocks at approximate quantiles (a bounded sketch): sums within a block and over whole
    blocks add up, so no task orders all values of a key.
    """
    at = ", ".join(str(i / blocks) for i in range(1, blocks))
    edges = df.groupBy(F.col(key).alias("__key")).agg(F.expr(f"percentile_approx({value}, array({at}), 1000)").alias("__edges"))
    df = df.join(edges, F.col(key).eqNullSafe(F.col("__key"))).withColumn("__block", F.size(F.filter("__edges", lambda e: e <= F.col(value)))).drop("__edges", "__key")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__of")).agg(*(F.sum(c).alias(f"__{c}") for c in counts))
    whole = whole.withColumns({f"__{c}": F.coalesce(F.sum(f"__{c}").over(before(Window.partitionBy("__key").orderBy("__of"))), F.lit(0)) for c in counts})  # `blocks` rows a key
    df = df.join(whole, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    inside = before(Window.partitionBy(key, "__block").orderBy(value))
    return df.withColumns({f"below_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts}).drop("__block", "__of", "__key", *(f"__{c}" for c in counts))


def quantiles(rows: DataFrame, bins: int) -> DataFrame:
    """(feature, e): the exact quantiles 0, 1/bins, ..., 1 of each feature's x, interpolated, as structs (i, x)."""
    return quantiles_of(rows.groupBy("feature", "x").agg(F.count("*").alias("n")), bins)


def quantiles_of(values: DataFrame, bins: int) -> DataFrame:
    """The same of distinct values (feature, x) that stand for n rows each."""
    counts = with_below(values, "feature", "x", ["n"])
    total = values.groupBy(F.col("feature").alias("__feature")).agg(F.sum("n").alias("all"))
    counts = counts.join(total, F.col("feature") == F.col("__feature"))
    place = lambda i: (F.col("all") - 1) * i / F.lit(bins)
    holds = lambda at: (at >= F.col("below_n")) & (at < F.col("below_n") + F.col("n"))
    steps = F.filter(F.sequence(F.lit(0), F.lit(bins)), lambda i: holds(F.floor(place(i))) | holds(F.ceil(place(i))))
    met = counts.withColumn("i", F.explode(steps))
    share = F.max(place(F.col("i")) - F.floor(place(F.col("i"))))
    ends = met.groupBy("feature", "i").agg(F.max(F.when(holds(F.floor(place(F.col("i")))), F.col("x"))).alias("lo"), F.max(F.when(holds(F.ceil(place(F.col("i")))), F.col("x"))).alias("hi"), share.alias("s"))
    edge = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("s")) * F.col("lo") + F.col("s") * F.col("hi"))
    return ends.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", edge.alias("x")))).alias("e"))  # bins + 1 a feature


def quantile_edges(rows: DataFrame, bins: int) -> DataFrame:
    """(feature, e): the quantiles of each feature, equal ones once."""
    return quantiles(rows, bins).select("feature", F.array_distinct(F.col("e.x")).alias("e"))


def psi(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, eps: float = 1e-8) -> DataFrame:
    """(feature, psi): bins are quantiles of the baseline, equal edges once; values outside them are left out; 0 with one edge.

    The edges are one short array a feature."""
    base, now = unpivoted(baseline, columns), unpivoted(current, columns)
    edges = quantile_edges(base, bins)
    both = base.withColumn("k", F.lit("e")).unionByName(now.withColumn("k", F.lit("a"))).groupBy("feature", "x", "k").agg(F.count("*").alias("m")).join(edges, "feature")
    n = F.size("e")
    # the bin of x: how many edges are at most x; the last edge belongs to the last bin
    bin_ = F.least(F.size(F.filter("e", lambda b: b <= F.col("x"))), n - 1)
    inside = both.filter((F.col("x") >= F.element_at("e", 1)) & (F.col("x") <= F.element_at("e", -1)) & (n > 1)).withColumn("bin", bin_)
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("m")).otherwise(0))
    counts = inside.groupBy("feature", "bin").agg(of("e").alias("ce"), of("a").alias("ca"))
    w = Window.partitionBy("feature")
    share = counts.withColumn("pe", F.try_divide("ce", F.sum("ce").over(w)) + eps).withColumn("pa", F.coalesce(F.try_divide("ca", F.sum("ca").over(w)), F.lit(0.0)) + eps)
    total = share.groupBy("feature").agg(F.sum((F.col("pe") - F.col("pa")) * F.log(F.col("pe") / F.col("pa"))).alias("psi"))
    return edges.select("feature").join(total, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def precision_at_k(df: DataFrame, k: int) -> DataFrame:
    """(model, precision): successes among each model's k highest scores over k, also where it has fewer rows."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "symbol", "date"))
    return df.filter("label is not null").withColumn("place", place).filter(F.col("place") <= k).groupBy("model").agg((F.sum("label") / k).alias("precision"))


def classification(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """(model, precision, recall, f1) at the cut; 0 where undefined."""
    yes, pos = F.col("score") >= cut, F.col("label") == 1
    g = df.filter("label is not null").groupBy("model").agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return g.select("model", z(tp, tp + F.col("fp")).alias("precision"), z(tp, tp + F.col("fn")).alias("recall"), z(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def auc(df: DataFrame) -> DataFrame:
    """(model, auc): the rank-sum form with mean ranks of ties, by counts of each score; null where one class is missing."""
    c = df.filter("label is not null").groupBy("model", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    c = with_below(c, "model", "score", ["n"])
    return c.groupBy("model").agg(F.try_divide(F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def r_squared(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and r2 of columns y and y_hat: one aggregation, by sums."""
    g = df.groupBy(*keys).agg(F.sum(F.pow(F.col("y") - F.col("y_hat"), F.lit(2.0))).alias("res"), (F.var_pop("y") * F.count("y")).alias("tot"))
    return g.select(*keys, (1 - F.try_divide("res", "tot")).alias("r2"))


def topk_return(df: DataFrame, k: int) -> DataFrame:
    """(model, mean_return, median_return) of each model's k highest scores."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "symbol", "date"))
    top = df.filter("label is not null").withColumn("place", place).filter(F.col("place") <= k)
    return top.groupBy("model").agg(F.avg("realized_return").alias("mean_return"), F.expr("percentile(realized_return, 0.5)").alias("median_return"))


def alerts(stability: DataFrame, metrics: DataFrame, last: DataFrame, psi_limit: float = 0.1, drop: float = 0.2) -> DataFrame:
    """(kind, name, value): unstable features, and models whose precision fell by `drop` of the last one or more. last is what
    MetricHistory has of the run before; a model without any has no such alert."""
    a = stability.filter(F.col("psi") >= psi_limit).select(F.lit("psi").alias("kind"), F.col("feature").alias("name"), F.col("psi").alias("value"))
    both = metrics.join(last.select("model", F.col("precision").alias("before")), "model").filter("before > 0")
    b = both.withColumn("fall", F.try_divide(F.col("before") - F.col("precision"), F.col("before"))).filter(F.col("fall") >= drop)
    return a.unionByName(b.select(F.lit("precision").alias("kind"), F.col("model").alias("name"), F.col("fall").alias("value")))


class MetricHistory:
    """Metrics (model, metric, value) kept by run, a folder a run; a run's name sorts by age."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, run: str, metrics: DataFrame, metric: str) -> None:
        """metrics: (model, <metric>). A run that is stored again replaces itself."""
        rows = metrics.select("model", F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), F.lit(run).alias("run"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "run").parquet(self.path)

    def before(self, run: str, metric: str) -> DataFrame:
        """(model, <metric>, run) of each model's newest run before this one that has a value; folders of other metrics and later
        runs are not read. Nothing where no run is stored yet."""
        schema = "model string, value double, metric string, run string"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        stored = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        rows = self.spark.read.schema(schema).parquet(self.path) if stored else self.spark.createDataFrame([], schema)
        older = rows.filter((F.col("metric") == metric) & (F.col("run") < run) & F.col("value").isNotNull())
        newest = older.groupBy("model").agg(F.max_by(F.struct("value", "run"), "run").alias("r"))
        return newest.select("model", F.col("r.value").alias(metric), F.col("r.run").alias("run"))


def coverage(df: DataFrame) -> DataFrame:
    """(total, labelled, status)."""
    g = df.agg(F.count("*").alias("total"), F.count("label").alias("labelled"))
    return g.withColumn("status", F.when(F.col("labelled") == 0, "no_labels").when(F.col("labelled") < F.col("total"), "partial").otherwise("complete"))
