"""Event streams: tails, windows with watermarks and exactly-once batches (extensions; tests run them as streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.sources.tables import table

S = SparkSession


def window_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts in tumbling windows of event time; works on streams, whose state the watermark bounds, and on tables."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("ts", late)
    n = t.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(spark: S, sf: str) -> DataFrame:
    return window_counts(table(spark, sf, "events"))


def tail(spark: S, folder: str, schema: str, after: int, out: str, checkpoint: str) -> DataFrame:
    """Append the events behind a cursor that ``folder`` has got since the last call to ``out``; a repeated call adds nothing twice."""
    stream = spark.readStream.schema(schema).parquet(folder).where(F.col("event_id") > after)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def commit_batches(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write each micro-batch to a folder of its own number: a batch that is replayed overwrites itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
