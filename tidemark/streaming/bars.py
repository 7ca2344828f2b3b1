"""Hourly bars from a stream of events.

No row is dropped: the stream keeps exact per-hour aggregates without a watermark, so late rows
count in their hour. It does not fail on them; the replay's stream does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.sinks.batches import BatchTable, drop


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files like those at ``path``."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    if _is_folder(spark, path):
        folder, name = path, "*.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()  # noqa: SLF001


def bars(events: DataFrame) -> DataFrame:
    """Streaming hourly bars per event type."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    out = rows.groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").alias("tick_volume"),
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "tick_volume")


_BARS = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, tick_volume long"


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """Drive the stream over the files that are there, and return its final table.

    The stream writes into a ``BatchTable`` in the shared folder, where every batch is the whole table; the result is a
    checkpoint of the last one, and the stream's own files go.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    home = f"{session.shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    table = BatchTable(spark, f"{home}/table", _BARS, whole=True)
    writer = bars(from_files(spark, path)).writeStream.outputMode("complete").foreachBatch(table).option("checkpointLocation", f"{home}/checkpoint")
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()
    result = session.checkpointed(table.read())
    drop(spark, home)
    return result
