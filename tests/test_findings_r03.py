"""What the findings of round 3 asked for."""

import math
import random

import pytest

from shelfwise.operators import risk
from shelfwise.plans import command, learned
from shelfwise.plans.metric_defs import inventory_risk_metrics
from shelfwise.sources.inventory import readings


def test_map_points_have_size_and_place(spark, tables):
    rows = command.map_points(tables).collect()
    largest = max(r.demand_units for r in rows)
    for r in rows:
        assert r.radius == pytest.approx(12 + math.sqrt(r.demand_units / max(largest, 1)) * 22, abs=1e-3)
        s = math.sin(math.radians(r.lat))
        assert r.world_x == pytest.approx((r.lng + 180) / 360 * 256, abs=1e-3)
        assert r.world_y == pytest.approx((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * 256, abs=1e-3)


def test_running_sums_are_taken_before_days_become_rows(tables):
    text = readings(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(sequence") < text.index("Window")


def test_training_rows_are_counted_on_a_grid(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(2), *[float(draw.choice((0, 1, 5)))] * len(risk.FEATURES)) for _ in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(["label int", *[f"{c} double" for c in risk.FEATURES]]))
    counted = learned.on_grid(df, learned.feature_grid(df)).collect()
    assert len(counted) == 6 and sum(r.n for r in counted) == 3000
    by_label = {label: sorted(r.n for r in counted if r.label == label) for label in (0, 1)}
    want = {label: sorted(sum(r[:2] == (label, x) for r in rows) for x in (0.0, 1.0, 5.0)) for label in (0, 1)}
    assert by_label == want


def test_inventory_measures_are_counted_where_readings_lie(tables):
    view = inventory_risk_metrics(tables)
    text = view.query(["region", "reading_date"], list(view.measures))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and not any("l_partkey" in line for line in text.splitlines() if "Exchange hashpartitioning(region" in line)


def test_inventory_rollup_counts_anew_at_each_level(tables):
    view, names = inventory_risk_metrics(tables), ["readings", "skus_at_expiry_risk", "sku_dcs", "avg_days_of_supply"]
    levels = view.rollup(["region", "division"], names).collect()
    for level, dims in ((0, ["region", "division"]), (1, ["region"]), (2, [])):
        want = {tuple(r) for r in view.query(dims, names).collect()}
        got = {tuple(r[c] for c in (*dims, *names)) for r in levels if r.level == level}
        assert got == want
