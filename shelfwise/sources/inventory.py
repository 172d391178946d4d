"""Inventory view: daily stock levels of every SKU a distribution centre moves, worked out from the whole order flow.

The given tables hold no stock. Supply is taken to follow demand: what is ordered is replaced LEAD_DAYS later, and what is
served leaves the shelf the same day. Receipts less served units give the course of the level over all orders; its height is
the least that never falls below zero. Stock ages from its last receipt; the risk that it expires is the time it takes to
sell at the mean demand of all days, measured against the shelf life that is left.

A pair of SKU and centre keeps one row for each day it moved. A move changes the sums up to, 7 and 14 days before a day on
three days; running sums are taken over these and hold until the next change. Only the days that are asked for are filled in,
last of all: the work grows with the moves and the days asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import shuffle_partitions
from shelfwise.sources.star import DIVISION, SHELF_LIFE_DAYS, STATUS, Tables

#: Days of readings, up to the newest order's day. A pair without an order in them is no longer stocked.
PANEL_DAYS = 90
LEAD_DAYS = 14
RESERVED_DAYS = 7

INVENTORY_COLUMNS = (
    "dc_id", "product_id", "reading_date", "day_idx", "region", "division", "brand", "on_hand_units",
    "in_transit_units", "reserved_units", "days_of_supply", "reorder_point", "batch_expiry_date", "days_to_expiry",
    "at_risk_expiry_units", "avg_daily_demand", "stockout_flag", "expiry_risk_score",
)
#: The numeric keys behind product_id and dc_id. Windows on them need no shuffle of their own.
SERIES_KEYS = ("l_partkey", "s_nationkey")

_UNITS = "cast(l_quantity AS bigint)"


def daily_moves(t: Tables) -> DataFrame:
    """Units ordered and served per centre, SKU and day, of all orders. Sums before the shuffle, so no SKU runs hot."""
    lines = t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.expr(_UNITS).alias("units"),
        F.expr(STATUS).alias("status"),
    )
    served = "CASE status WHEN 'fulfilled' THEN units WHEN 'partial' THEN units div 2 ELSE 0L END"
    return (
        lines.join(t.orders.select("o_orderkey", "o_orderdate").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "l_partkey", F.to_date("o_orderdate").alias("move_date"))
        .agg(F.sum("units").alias("ordered"), F.sum(F.expr(served)).alias("served"))
    )


def _changes(t: Tables, first: int, panel_days: int) -> DataFrame:
    """The days on which something of a stocked pair changes, with what changes: a move, the end of its week, its receipt, and
    a row without a change for the first day asked for (`first`).

    Days count back from the newest order's day (0) and are negative. A pair has at most one move for each day, so it has no
    more rows than the days of the history ask for, whatever the volume behind it. The explicit partition count keeps adaptive
    coalescing from sizing tasks by this input: its rows multiply.
    """
    pair = Window.partitionBy(*SERIES_KEYS)
    moves = (
        daily_moves(t)
        .withColumn("as_of", F.to_date(t.midnight(0)))
        .withColumn("ago", F.expr("datediff(move_date, as_of)"))
        .repartition(shuffle_partitions(t.spark), "l_partkey")
        .withColumns({"total": F.sum("ordered").over(pair), "newest": F.max("ago").over(pair)})
        .filter(F.col("newest") > -panel_days)
    )

    def change(since: str, **values: str) -> str:
        columns = {"since": since, "moved": "false", "o": "0L", "s": "0L", "o_week": "0L", "s_week": "0L", "o_lead": "0L"}
        columns |= {"received": "cast(null AS int)"} | values
        return f"named_struct({', '.join(f'{name!r}, {value}' for name, value in columns.items())})"

    of_a_move = ", ".join(
        (
            change("ago", moved="true", o="ordered", s="served"),
            change(f"ago + {RESERVED_DAYS}", o_week="ordered", s_week="served"),
            change(f"ago + {LEAD_DAYS}", o_lead="ordered", received="ago"),
        )
    )
    changes = f"IF(ago = newest, array({of_a_move}, {change(str(first))}), array({of_a_move}))"
    return moves.select(*SERIES_KEYS, "as_of", F.expr("greatest(total, 1L)").alias("w"), F.inline(F.expr(changes)))


def readings(t: Tables, last_days: int = PANEL_DAYS, panel_days: int = PANEL_DAYS) -> DataFrame:
    """INVENTORY_COLUMNS, shelf_life_days and SERIES_KEYS of each stocked pair for the last `last_days` of a panel of
    `panel_days` days that ends on the newest order's day. The rows lie by SKU: groups and windows on SERIES_KEYS need no
    further shuffle.

    Sums are taken on the days of a change only; each holds until the next change, and only then become days rows."""
    first = 1 - last_days
    series = Window.partitionBy(*SERIES_KEYS).orderBy("since")
    upto = series.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {c: F.coalesce(F.sum(c).over(upto), F.lit(0).cast("bigint")) for c in ("o", "s", "o_week", "s_week", "o_lead")}
    sums |= {"received": F.max("received").over(upto), "following": F.lead("since").over(series)}
    levels = _changes(t, first, panel_days).withColumns(sums)
    # The course falls on days with a move only, so its least value stands on one of them.
    lowest = F.min(F.when(F.col("moved"), F.col("o_lead") - F.col("s"))).over(Window.partitionBy(*SERIES_KEYS))
    spans = levels.withColumns(
        {
            "lowest": F.least(F.lit(0).cast("bigint"), lowest),
            "from_day": F.expr(f"greatest(since, {first})"),
            "to_day": F.expr("least(coalesce(following - 1, 0), 0)"),
        }
    ).filter("since IS NOT NULL AND from_day <= to_day")
    first_day = t.orders.agg(F.to_date(F.min("o_orderdate"))).scalar()
    pairs = (
        spans.withColumn("h", F.datediff("as_of", first_day) + 1)
        .join(t.part.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.geo, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    days = pairs.withColumn("ago", F.explode(F.sequence("from_day", "to_day")))
    stock = days.withColumns(
        {
            "day_idx": F.expr(f"ago + {panel_days - 1}"),
            "reading_date": F.expr("date_add(as_of, ago)"),
            "on_hand_units": F.expr("o_lead - s - lowest"),
            "in_transit_units": F.expr("o - o_lead"),
            "reserved_units": F.expr("o - o_week - s + s_week"),
            "shelf_life_days": F.expr(SHELF_LIFE_DAYS),
        }
    ).withColumn(
        "days_to_expiry",
        F.expr(f"greatest(1, shelf_life_days - IF(received IS NULL, ago + h - 1, ago - received - {LEAD_DAYS}))"),
    )
    return stock.select(
        *SERIES_KEYS,
        F.expr("concat('DC-', s_nationkey)").alias("dc_id"),
        F.expr("concat('SKU-', l_partkey)").alias("product_id"),
        "reading_date",
        "day_idx",
        F.col("r_name").alias("region"),
        F.expr(DIVISION).alias("division"),
        F.col("p_brand").alias("brand"),
        "on_hand_units",
        "in_transit_units",
        "reserved_units",
        F.expr("((on_hand_units * 200 * h + w) div (2 * w)) / 100D").alias("days_of_supply"),
        F.expr(f"greatest(1L, (w * {LEAD_DAYS} + h - 1) div h)").alias("reorder_point"),
        F.expr("date_add(reading_date, days_to_expiry)").alias("batch_expiry_date"),
        "days_to_expiry",
        F.expr("greatest(0L, on_hand_units - (w * days_to_expiry) div h)").alias("at_risk_expiry_units"),
        F.expr("((w * 20 + h) div (2 * h)) / 10D").alias("avg_daily_demand"),
        F.expr("cast(on_hand_units = 0 AS int)").alias("stockout_flag"),
        F.expr("least(1000L, (on_hand_units * 1000 * h) div (w * days_to_expiry)) / 1000D").alias("expiry_risk_score"),
        "shelf_life_days",
    )


def fact_inventory(t: Tables, last_days: int = PANEL_DAYS) -> DataFrame:
    """Stock readings, one row per centre x SKU x day."""
    return readings(t, last_days).select(*INVENTORY_COLUMNS)
