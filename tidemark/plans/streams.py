"""Queries over streams (M01, M02); they read a table as a stream and end with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.models import logistic
from tidemark.plans.ingest import scratch
from tidemark.plans.registry import query, with_panels
from tidemark.sources.tables import bars_walk, ticks
from tidemark.streaming import bars as st

# Ticks arrive in four loads by time, but every seventh one a load late: in place only if its day is not closed by then.
LOADS = """select *, least(3, least(3, cast(floor(4 * (epoch(ts) - lo) / (hi - lo + 1.0)) as integer)) + cast(event_id % 7 = 0 as integer)) as load
  from (select *, min(epoch(ts)) over () as lo, max(epoch(ts)) over () as hi from ticks)"""
CLOSED = "select load, max(max(ts)) over (order by load) - interval 2 day as closed from loads group by load"
IN_TIME = "select l.*, date_trunc('day', l.ts) as day from loads l left join closings c on c.load = l.load - 1 where c.load is null or date_trunc('day', l.ts) + interval 1 day > c.closed"
M01 = """select symbol, cast(day as timestamp) as start, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close, count(*) as n_ticks
  from in_time group by symbol, day having day + interval 1 day <= (select max(closed) from closings)"""


@query("M01_stream_bars", with_panels(M01, ("loads", LOADS), ("closings", CLOSED), ("in_time", IN_TIME)))
def m01(spark, path):
    """Bars that the watermark has closed at the end of the stream. The stream is stopped and goes on four times, with a load of
    files each: what a load brings for a day that an earlier one has closed is dropped."""
    landed, to, checkpoint = scratch(spark, "ticks"), scratch(spark, "bars"), scratch(spark, "bars-checkpoint")
    rows = ticks(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") / 1e6
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    load = F.least(F.lit(3), F.floor(4 * (at - F.lit(lo)) / F.lit((hi or 0.0) - (lo or 0.0) + 1.0)))
    arrived = F.least(F.lit(3), load + (F.col("event_id") % 7 == 0).cast("int"))
    for n in range(4):
        rows.filter(arrived == n).write.mode("append").parquet(landed)
        st.stream_bars(spark.readStream.schema(rows.schema).parquet(landed), to, checkpoint)
    return spark.read.parquet(to)


@query("M02_upsert_and_learn")
def m02(spark, path):
    """The table after all micro-batches, each row with the online model's probability. A bar that opens at 0 has no move: it teaches
    nothing and has no probability."""
    landed, store = scratch(spark, "landed"), scratch(spark, "store")
    b = bars_walk(spark, path)
    rows = b.select("symbol", "date", F.try_divide(F.col("close") - F.col("open"), "open").alias("move"), (F.col("volume") / 100.0).alias("size"), (F.col("volume") % 2).cast("int").alias("label"))
    rows.repartition(4, "symbol").write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    model, batches = st.Learner(spark, scratch(spark, "weights"), ["move", "size"]), []
    st.upsert_batches(stream, spark, store, scratch(spark, "store-checkpoint"), ["symbol", "date"], ("move", "size"), lambda df, n: (model.step(df, n), batches.append(n)))
    return st.upserted(spark, store, max(batches), rows).withColumn("p", logistic(model.weights(max(batches)), ["move", "size"]))
