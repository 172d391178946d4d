"""The streaming pipeline as queries: land the raw feed, run the streams to the end, read the tables back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import LEAN, TWO_WRITERS, settings, shared_dir, written
from shelfwise.sources import store
from shelfwise.sources.files import RAW_SCHEMA, append_raw, append_written
from shelfwise.sources.star import SALES_COLUMNS, Tables, raw_sales, raw_sales_by_order
from shelfwise.streaming import dq, events


def _landed(t: Tables) -> tuple[str, str]:
    base = shared_dir(t.spark, "stream")
    append_raw(raw_sales(t), f"{base}/landing")
    dq.run_quality(t.spark, f"{base}/landing", f"{base}/store")
    return f"{base}/landing", f"{base}/store"


def silver(t: Tables) -> DataFrame:
    return dq.read_silver(t.spark, _landed(t)[1])


def quarantine(t: Tables) -> DataFrame:
    return dq.read_quarantine(t.spark, _landed(t)[1]).drop("quarantined_at")


def rule_totals(t: Tables) -> DataFrame:
    return dq.rule_totals(t.spark, _landed(t)[1])


def incremental_cycle(t: Tables) -> DataFrame:
    """Two appended batches, a cycle after each: the gold table must equal the one-shot batch build."""
    return _cycled(t)["gold_region_daily"]


def incremental_national(t: Tables) -> DataFrame:
    return _cycled(t)["gold_national_daily"]


def incremental_days(t: Tables) -> DataFrame:
    """All but the newest week and one row in a hundred land first; the second cycle touches only the days of the rest."""
    late = (F.col("order_ts") >= t.midnight(6).cast("string")) | (F.pmod(F.xxhash64("sale_id", "outlet_id"), F.lit(100)) == 0)
    return _cycled(t, F.coalesce(late, F.lit(False)).cast("int"))["gold_sales_serving"]


def _cycled(t: Tables, batch: Column | None = None) -> dict[str, DataFrame]:
    """The feed is worked out and written once, by cycle; the files of a cycle's batch land when it begins."""
    base = shared_dir(t.spark, "cycle")
    batch = F.pmod(F.xxhash64("sale_id", "product_id", "dc_id", "outlet_id"), F.lit(2)) if batch is None else batch
    feed = raw_sales_by_order(t).select(*SALES_COLUMNS, batch.cast("int").alias("cycle"))
    result = {}
    with settings(t.spark, LEAN):
        with settings(t.spark, TWO_WRITERS):
            feed.write.option("compression", "zstd").partitionBy("cycle").parquet(f"{base}/feed")
        for cycle in (0, 1):
            append_written(t.spark, f"{base}/feed/cycle={cycle}", f"{base}/landing")
            result = dq.run_cycle(t.spark, f"{base}/landing", f"{base}/store")
    return result


# The event streams: the table lands in three parts by time, and one event in LATE of a part lands with the next part.
WINDOW, DELAY, LATE = "1 hour", "2 hours", 50
#: One sale in so many is sent again with the next part.
RESENT = 20


def _span(df: DataFrame, column: str) -> tuple[int | None, int | None]:
    """The first and last time of a table in microseconds."""
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    return tuple(df.agg(F.min(micros), F.max(micros)).head())


def _third(column: str, low: int | None, high: int | None) -> Column:
    """0, 1 or 2: the third of the time span that a row's time lies in."""
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    first, last = (F.lit(bound).cast("bigint") for bound in (low, high))
    return F.least(F.floor((micros - first) * 3 / F.greatest(last - first, F.lit(1))).cast("int"), F.lit(2))


def unique_sales(t: Tables) -> DataFrame:
    """The sales feed in three parts by time, with rows sent again in their own part and in the next: each counts once."""
    base = shared_dir(t.spark, "unique")
    with settings(t.spark, LEAN):
        raw_sales_by_order(t).select(*SALES_COLUMNS).write.option("compression", "zstd").parquet(f"{base}/feed")
        feed = t.spark.read.schema(RAW_SCHEMA).parquet(f"{base}/feed")
        feed = feed.withColumn("part", _third("order_ts", *_span(feed, "order_ts")))
        again = F.pmod(F.xxhash64("sale_id", "product_id", "outlet_id"), F.lit(RESENT)) == 0
        newest = {row.part: row.newest for row in feed.groupBy("part").agg(F.max("order_ts").alias("newest")).collect()}
        for at in range(3):
            since = F.lit(newest.get(at - 1)).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")
            late = (F.col("part") == at - 1) & again & (F.col("order_ts").cast("timestamp_ntz") >= since)
            # How often a row lands now, in one pass over the feed: its own part's rows once or twice, late ones once.
            times = F.when(F.col("part") == at, F.when(again, F.lit(2)).otherwise(F.lit(1))).when(late, F.lit(1)).otherwise(F.lit(0))
            landing = feed.withColumn("times", times).filter("times > 0")
            landing = landing.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
            append_raw(landing.drop("part", "times", "time"), f"{base}/landing")
            if at == 2:  # all of it has landed
                store.remove(t.spark, f"{base}/feed")
            events.unique_sales(t.spark, f"{base}/landing", f"{base}/unique", delay="30 days")
    return t.spark.read.parquet(f"{base}/unique")


def event_windows(t: Tables) -> DataFrame:
    """Events and their value by hour and type as the stream appends them, and how many came too late to count."""
    base = shared_dir(t.spark, "events")
    part = _third("ts", *_span(t.events, "ts")) + (F.pmod(F.col("event_id"), F.lit(LATE)) == 0).cast("int")
    landed = written(t.events.withColumn("part", part), "events")
    for at in range(4):
        landed.filter(F.col("part") == at).drop("part").write.mode("append").parquet(f"{base}/landing")
        events.event_windows(t.spark, f"{base}/landing", f"{base}/windows", WINDOW, DELAY)
    windows = t.spark.read.parquet(f"{base}/windows")
    return events.with_late(windows, landed, WINDOW).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "value_cents", "late_events"
    )
