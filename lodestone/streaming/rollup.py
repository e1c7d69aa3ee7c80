"""Streams: documents upserted as files land, and daily roll-ups of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, total) of events, batch or stream; a stream drops what comes later than `late`."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(stream: DataFrame, store, name: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keep a table up to date: each batch replaces its keys, so a batch that runs twice changes nothing more."""

    def batch(rows: DataFrame, _: int) -> None:
        store.upsert(name, rows.dropDuplicates([key]), key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_stream(stream: DataFrame, store, name: str, checkpoint: str) -> StreamingQuery:
    """Daily roll-up kept up to date as a table of a store: each batch replaces the days it changes.

    State is kept until the watermark has passed a day; what comes later still is dropped.
    """

    def batch(rows: DataFrame, _: int) -> None:
        store.upsert(name, rows.withColumn("key", F.concat_ws("|", "day", "event_type")), "key")

    return daily(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
