import datetime as dt

from shelfwise.session import shared_dir
from shelfwise.sources.files import RAW_SCHEMA, append_raw
from shelfwise.sources.star import SALES_COLUMNS, SCHEMAS
from shelfwise.streaming import events


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMAS["events"]).write.mode("append").parquet(folder)


def event(number, minute, kind="click", value=1.0):
    return (number, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), 1, kind, value, "{}")


def test_windows_close_by_the_watermark_and_late_events_are_counted(spark):
    base = shared_dir(spark, "test-windows")
    run = lambda: events.event_windows(spark, f"{base}/in", f"{base}/out", "1 hour", "2 hours")
    first = [event(1, 10), event(2, 50, value=2.5), event(3, 70), event(4, 70, "view"), event(5, 290)]
    land(spark, f"{base}/in", first)
    assert run() == {"rows_read": 5, "too_late": 0}
    # The newest event is at 4:50, so what ended by 2:50 is out.
    got = {(r.window_start.hour, r.event_type): (r.events, r.value_cents) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(0, "click"): (2, 350), (1, "click"): (1, 100), (1, "view"): (1, 100)}
    second = [event(6, 20), event(7, 200), event(8, 500)]  # too late; in time, though out of order; closes the rest
    land(spark, f"{base}/in", second)
    assert run() == {"rows_read": 3, "too_late": 1}
    windows = events.with_late(spark.read.parquet(f"{base}/out"), spark.read.parquet(f"{base}/in"), "1 hour")
    got = {(r.window_start.hour, r.event_type): (r.events, r.late_events) for r in windows.collect()}
    assert got == {(0, "click"): (2, 1), (1, "click"): (1, 0), (1, "view"): (1, 0), (3, "click"): (1, 0), (4, "click"): (1, 0)}
    assert run() == {"rows_read": 0, "too_late": 0}


def test_rows_sent_again_in_any_batch_count_once(spark):
    base = shared_dir(spark, "test-unique")
    defaults = {c: "x" for c in SALES_COLUMNS} | {"units_ordered": "3", "unit_price_idr": "5", "status": "fulfilled", "ship_ts": None}

    def row(number, day):
        made = defaults | {"sale_id": f"S{number}", "order_ts": f"2024-01-{day:02d} 08:00:00"}
        return tuple(made[c] for c in SALES_COLUMNS)

    def run(rows):
        append_raw(spark.createDataFrame(rows, RAW_SCHEMA), f"{base}/in")
        return events.unique_sales(spark, f"{base}/in", f"{base}/out", delay="5 days")

    run([row(1, 1), row(1, 1), row(2, 2)])
    run([row(2, 2), row(3, 4), row(1, 1)])
    late = run([row(3, 4), row(4, 20)])
    assert late["too_late"] == 0
    assert run([row(5, 3), row(4, 20)])["too_late"] == 1  # first seen more than five days behind the newest order
    assert sorted(r.sale_id for r in spark.read.parquet(f"{base}/out").collect()) == ["S1", "S2", "S3", "S4"]
