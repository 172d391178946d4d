"""Event-time streams: re-sent rows dropped across batches, and tumbling windows over the events table.

Both keep their state in Spark's state store, bounded by the watermark; every run takes what has landed since the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import packed, unpacked
from shelfwise.operators.quality import TYPES, silver_sales
from shelfwise.session import settings
from shelfwise.sources.files import raw_stream
from shelfwise.sources.star import SALES_COLUMNS, SCHEMAS

# A state of many rows lies on disk, with a bound on its memory; its log is packed well, and no row is looked up to count rows.
_STORE = "spark.sql.streaming.stateStore"
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false", f"{_STORE}.compression.codec": "zstd",
}


def _run(stream: DataFrame, out: str) -> dict[str, int]:
    """Run an append stream over all that has landed; returns rows read and state rows that came too late."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("compression", "zstd")
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    seen = query.recentProgress
    late = sum(op.numRowsDroppedByWatermark for p in seen for op in p.stateOperators)
    return {"rows_read": sum(p.numInputRows for p in seen), "too_late": late}


def unique_sales(spark: SparkSession, landing: str, out: str, delay: str = "30 days") -> dict[str, int]:
    """Typed sales that pass the quality rules, each once, however often and in whichever batch it is sent.

    A copy of a row is dropped if it arrives while its order time lies less than `delay` behind the newest order; the state
    holds the rows of that span only. A row that first arrives later than that is dropped and counted as too late.

    A row travels as one text and is known by 128 bits of its SHA-256, which is all that the state keeps of it.
    """
    sales = silver_sales(raw_stream(spark, landing)).withColumn("event_time", F.col("order_ts").cast("timestamp"))
    known = F.substring(F.unhex(F.sha2("row", 256)), 1, 16).alias("known")
    rows = sales.select("event_time", packed(SALES_COLUMNS).alias("row")).select("event_time", "row", known)
    once = rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["known"])
    with settings(spark, STATE):
        return _run(once.select(*unpacked("row", SALES_COLUMNS, TYPES)), out)


def event_stream(spark: SparkSession, landing: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["events"]).parquet(landing)


def with_windows(events: DataFrame, width: str) -> DataFrame:
    """Events counted and their values summed, in cents, by tumbling window of event time and type."""
    return _windowed(events.withColumn("event_time", F.col("ts").cast("timestamp")), width)


def _windowed(timed: DataFrame, width: str) -> DataFrame:
    cents = F.expr("cast(round(value * 100) AS bigint)")
    grouped = timed.groupBy(F.window("event_time", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum(cents).alias("value_cents")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value_cents"
    )


def event_windows(spark: SparkSession, landing: str, out: str, width: str, delay: str) -> dict[str, int]:
    """Append each window's row once the newest event is `delay` past its end. Events of a window that is out already come too
    late and do not count."""
    timed = event_stream(spark, landing).withColumn("event_time", F.col("ts").cast("timestamp"))
    return _run(_windowed(timed.withWatermark("event_time", delay), width), out)


def with_late(windows: DataFrame, landed: DataFrame, width: str) -> DataFrame:
    """The windows with the number of landed events that came too late for them."""
    whole = with_windows(landed, width).select("window_start", "event_type", F.col("events").alias("landed"))
    both = windows.join(whole, (windows.window_start == whole.window_start) & windows.event_type.eqNullSafe(whole.event_type))
    return both.select(windows["*"], (F.col("landed") - F.col("events")).alias("late_events"))
