import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import decisions, risk
from shelfwise.plans import serving
from shelfwise.session import shared_dir
from shelfwise.sources.inventory import PANEL_DAYS, daily_moves, fact_inventory, readings


def panel(spark, scores):
    rows = [
        ("D", p, dt.date(2024, 1, 1) + dt.timedelta(days=i), i, float(s))
        for p, series in scores.items()
        for i, s in enumerate(series)
    ]
    return spark.createDataFrame(rows, "dc_id string, product_id string, reading_date date, day_idx int, expiry_risk_score double")


def test_forward_label_against_brute_force(spark):
    draw = random.Random(3)
    scores = {f"P{k}": [draw.choice((0.1, 0.69, 0.7, 0.9)) if draw.random() < 0.2 else 0.2 for _ in range(40)] for k in range(5)}
    scores["edge"] = [0.0] * 10 + [0.7] + [0.0] * 29
    got = {(r.product_id, r.day_idx): r.label for r in risk.with_forward_label(panel(spark, scores)).collect()}
    want = {
        (p, i): int(any(s >= 0.7 for s in series[i + 1 : i + 8]))
        for p, series in scores.items()
        for i in range(len(series))
        if i <= len(series) - 1 - 7
    }
    assert got == want
    assert got[("edge", 9)] == 1 and got[("edge", 10)] == 0 and got[("edge", 3)] == 1 and got[("edge", 2)] == 0


def test_short_series_has_no_label(spark):
    assert risk.with_forward_label(panel(spark, {"P": [0.9] * 7})).count() == 0
    assert risk.with_forward_label(panel(spark, {"P": [0.9] * 8})).count() == 1


def test_actions_first_match_wins(spark):
    rows = [(0.5, 0.9, 10), (0.49, 0.7, 10), (0.0, 0.5, 59), (0.0, 0.5, 60), (0.0, 0.69, 59), (0.0, 0.1, 1)]
    df = spark.createDataFrame(rows, "stockout_risk_score double, expiry_risk_score double, days_to_expiry int")
    got = [r.recommended_action for r in risk.with_action(df).collect()]
    assert got == ["expedite", "redistribute", "promote", "hold", "promote", "hold"]


def test_what_if_levels_and_severity(spark):
    rows = [(45.0, 20, 20.0, 3000, 120), (0.0, 100, 100.0, 0, 1000), (30.0, 45, 40.0, 2000, 270)]
    df = spark.createDataFrame(
        rows, "days_of_supply double, days_to_expiry int, avg_daily_demand double, on_hand_units int, shelf_life_days int"
    )
    got = [(r.points, r.risk, r.severity) for r in risk.what_if(df).collect()]
    assert got == [
        (10, pytest.approx((10 / 12) ** 0.85, abs=1e-4), "Critical"),
        (0, 0.0, "Low"),
        (5, pytest.approx((5 / 12) ** 0.85, abs=1e-4), "Moderate"),
    ]


def test_tracked_skus_put_must_haves_first(spark):
    products = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 0)], "product_id string, m int")
    sales = spark.createDataFrame([("b", 5), ("c", 9), ("c", 1)], "product_id string, units_ordered int")
    got = risk.tracked_skus(products, sales, F.col("m") == 1, 3).collect()
    assert [(r.product_id, r.volume) for r in got] == [("a", 0), ("c", 10), ("b", 5)]


def test_recent_stockouts_use_the_last_14(spark):
    rows = [("D", "P", dt.date(2024, 1, 1) + dt.timedelta(days=i), int(i < 6 or i == 19)) for i in range(20)]
    df = spark.createDataFrame(rows, "dc_id string, product_id string, reading_date date, stockout_flag int")
    assert risk.recent_stockouts(df).head().stockout_risk_score == pytest.approx(round(1 / 14, 4))


def test_inventory_panel_is_dense_and_bounded(tables):
    inventory = fact_inventory(tables)
    sizes = inventory.groupBy("dc_id", "product_id").agg(F.count("*").alias("n"), F.count_distinct("day_idx").alias("d"))
    assert sizes.filter((F.col("n") != PANEL_DAYS) | (F.col("d") != PANEL_DAYS)).count() == 0
    bad = "on_hand_units < 0 OR expiry_risk_score NOT BETWEEN 0 AND 1 OR days_to_expiry < 1 OR stockout_flag NOT IN (0, 1)"
    assert inventory.filter(bad).count() == 0


def test_panel_and_days_asked_for_are_arguments(tables):
    whole = readings(tables, last_days=200, panel_days=200)
    last = readings(tables, last_days=3, panel_days=200)
    assert whole.agg(F.max("day_idx"), F.min("day_idx")).head() == (199, 0)
    assert whole.filter("day_idx >= 197").exceptAll(last).isEmpty() and last.count() * 200 == whole.count() * 3


def test_levels_rest_on_all_orders(tables):
    """Running sums over every move of a pair, however old, worked out in plain Python."""
    moves = {}
    for r in daily_moves(tables).collect():
        moves.setdefault((r.l_partkey, r.s_nationkey), []).append(r)
    newest = max(r.move_date for held in moves.values() for r in held)
    checked = 0
    for row in readings(tables, last_days=2).collect():
        held = moves[row.l_partkey, row.s_nationkey]
        before = lambda days, of: sum(of(m) for m in held if (row.reading_date - m.move_date).days >= days)  # noqa: B023, E731
        course = lambda day: sum(m.ordered for m in held if (day - m.move_date).days >= 14) - sum(m.served for m in held if m.move_date <= day)  # noqa: B023, E731
        lowest = min(0, *(course(m.move_date) for m in held), 0)
        assert row.on_hand_units == course(row.reading_date) - lowest
        assert row.in_transit_units == before(0, lambda m: m.ordered) - before(14, lambda m: m.ordered)
        checked += min(m.move_date for m in held) < newest - dt.timedelta(days=PANEL_DAYS)
    assert checked > 0


def test_scores_are_taken_where_the_readings_lie(tables):
    """One exchange after the daily sums: by SKU, for readings and scores alike."""
    plan = serving.scored(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "dc_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert sum("REPARTITION_BY_NUM" in line for line in plan.splitlines()) == 1


def test_level_follows_receipts_and_served_units(spark, tables):
    """One pair worked out by hand: 20 units on day 70 in full, 10 on day 80 half served."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("region", "nation", "customer"):
        tables.read(name).write.parquet(f"{folder}/{name}.parquet")
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "s", 0, 0.0)], tables.supplier.schema).write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(1, "p", "Brand#1", "LARGE", 1, 1.0)], tables.part.schema).write.parquet(f"{folder}/part.parquet")
    orders = [(1, 1, "O", 1.0, day + dt.timedelta(days=70), "x"), (2, 1, "O", 1.0, day + dt.timedelta(days=80), "x"),
              (3, 1, "O", 1.0, day + dt.timedelta(days=89), "x")]
    spark.createDataFrame(orders, tables.orders.schema).write.parquet(f"{folder}/orders.parquet")
    line = lambda order, units, flag, status: (order, 1, 1, 1, units, 1.0, 0.0, 0.0, flag, status, day)
    lines = [line(1, 20.0, "N", "O"), line(2, 10.0, "A", "O")]
    spark.createDataFrame(lines, tables.lineitem.schema).write.parquet(f"{folder}/lineitem.parquet")
    rows = {r.day_idx: r for r in fact_inventory(type(tables)(spark, folder)).collect()}
    assert [rows[d].on_hand_units for d in (69, 70, 79, 80, 83, 84, 89)] == [25, 5, 5, 0, 0, 20, 20]
    assert [rows[d].stockout_flag for d in (79, 80, 84)] == [0, 1, 0]
    assert (rows[83].in_transit_units, rows[84].in_transit_units, rows[80].reserved_units, rows[87].reserved_units) == (30, 10, 5, 0)
    # The history runs from the first order's day to the last one's: 20 days with 30 units.
    assert rows[89].avg_daily_demand == 1.5 and rows[89].days_of_supply == 13.33 and rows[89].reorder_point == 21
    assert rows[89].days_to_expiry == 120 + 41 - 5 and rows[89].expiry_risk_score == 0.085


DECISION = "product_id string, dc_id string, product_name string, brand string, region string, expiry_risk_pct int, stockout_risk_pct int, action string, note string"


def test_decisions_are_validated_and_logged(spark):
    good = ("P", "D", None, None, None, None, 100, "hold", None)
    bad = {
        "product_id": ("", *good[1:]),
        "dc_id": ("P", None, *good[2:]),
        "expiry_risk_pct": (*good[:5], 101, *good[6:]),
        "stockout_risk_pct": (*good[:6], -1, *good[7:]),
        "action": (*good[:7], "sell", None),
        "note": (*good[:8], "x" * 501),
        "product_name": ("P", "D", "n" * 161, *good[3:]),
    }
    df = spark.createDataFrame([good, *bad.values()], DECISION)
    assert [r.verdict for r in decisions.judged(df).collect()] == ["accepted", *bad]
    log = shared_dir(spark, "log")
    decisions.record(df, "ops@example.com", log)
    decisions.record(df.filter("action = 'hold'").withColumn("action", F.lit("dismiss")), "ops@example.com", log)
    saved = spark.read.parquet(log)
    assert saved.count() == 2 and saved.select("id").distinct().count() == 2
    assert decisions.recent(saved, 1).head().action == "dismiss"
    assert [tuple(r) for r in decisions.acted_keys(saved).collect()] == [("D", "P")]
