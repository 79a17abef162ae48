"""Event-time windows on streams: watermark, tumbling counts, and a file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables
from loomspark.scratch import scratch

CATALOGUE = Catalogue()


def tumbling_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by window and key; rows later than ``late`` behind the newest are dropped, closed windows are emitted once."""
    window = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


@CATALOGUE.query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL '10 minutes'""")
def stream_tumbling(t: Tables) -> DataFrame:
    """The events as a stream of files, in one run over what is there."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))
    out, at = scratch(t.spark, "stream"), scratch(t.spark, "stream-at")
    counts = tumbling_counts(stream, "ts", "event_type", "1 hour", "10 minutes")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))
