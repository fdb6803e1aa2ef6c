"""Structured Streaming over the frame's transforms: an extension beside the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transforms import Transform
from ..session import shared_folder


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_a_batch: int = 1) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_a_batch).load(path)


def apply_fitted(stream: DataFrame, transforms: list[Transform]) -> DataFrame:
    """Fitted row-wise transforms over a stream: they hold no state."""
    for t in transforms:
        stream = t.transform(stream)
    return stream


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until all that is there now has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def windowed_sums(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, total, n) of tumbling windows; rows later than ``late`` behind the watermark are dropped.

    A time without a zone is taken in the session's, and so is ``start``.
    """
    zoned = events.schema[time].dataType == T.TimestampType()
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("key"))
    return grouped.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select((F.col("w.start") if zoned else F.col("w.start").cast("timestamp_ntz")).alias("start"), "key", "total", "n")


def session_sums(events: DataFrame, time: str, key: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, stop, key, total, n) of sessions: a key's events with less than ``gap`` between neighbours.

    ``stop`` is the last event's time plus ``gap``. On a stream a session is appended once the watermark, ``late`` behind the latest time, has
    reached its stop; until then a late event can join two sessions, and events that come later than that are dropped. State holds the open
    sessions alone. A batch gives all sessions. Null keys are a key of their own, null times are dropped. Times without a zone as in ``windowed_sums``.
    """
    zoned = events.schema[time].dataType == T.TimestampType()
    events = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key"))
    ends = (F.col(f"w.{c}") if zoned else F.col(f"w.{c}").cast("timestamp_ntz") for c in ("start", "end"))
    return grouped.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(*(c.alias(n) for c, n in zip(ends, ("start", "stop"), strict=True)), "key", "total", "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first event of each combination of ``keys``; repeats that come while it is remembered are dropped.

    An event is remembered until the watermark, ``within`` behind the latest time, has passed its time by ``within``: state expires, so it
    doesn't grow with the stream. A repeat that comes later is a new event; one behind the watermark is dropped. A batch has no
    watermark: there each combination stays once. Null keys equal each other.
    """
    kind = events.schema[time].dataType
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    once = timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)
    return once.withColumn(time, F.col(time).cast(kind))


def replay(df: DataFrame, slot: Column, slots: int, name: str) -> DataFrame:
    """The rows as a stream of files that come one slot after the other, whatever their times: what is late stays late."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    placed = df.withColumn("_slot", slot)
    for k in range(slots):  # files are read in the order of their writing
        placed.where(F.col("_slot") == k).drop("_slot").write.mode("append").parquet(path)
    return read_stream(spark, path, df.schema)
