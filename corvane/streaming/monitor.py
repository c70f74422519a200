"""Streams: daily counts in event time, and health checks for each batch that arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of the event files of a folder, in arrival order."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Rows and values by type in tumbling windows; what is later than the watermark is left out."""
    made = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return made.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    made = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return made.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, into a Parquet folder, exactly once by the checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def watch(stream: DataFrame, check: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Call ``check(batch, number)`` for each batch; a failed check doesn't end the stream, it is tried with the next batch."""

    def safely(batch: DataFrame, number: int) -> None:
        try:
            check(batch, number)
        except ConnectionError:  # the checked store is away: the next batch will tell
            pass

    w = stream.writeStream.foreachBatch(safely).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
