import pytest

from shelfwise.operators.metrics import MetricView
from shelfwise.plans.metric_defs import ds_sales, inventory_risk_metrics, sales_metrics


@pytest.fixture
def view(spark):
    df = spark.createDataFrame([("x", "p", 1, 10), ("x", "q", 9, 10), ("y", "p", 0, 0)], "g string, h string, a int, b int")
    asked = []

    def source(columns):
        asked.append(list(columns))
        return df

    return MetricView(
        source, df.columns, {"g": "g", "is_p": "h = 'p'"}, {"rate": "sum(a) / nullif(sum(b), 0)", "n": "count(1)"}
    ), asked


def test_ratio_is_recomputed_at_the_queried_grain(view):
    v, _ = view
    assert v.query(measures=["rate"]).head().rate == pytest.approx(0.5)
    by_g = {r.g: r.rate for r in v.query(["g"], ["rate"]).collect()}
    assert by_g["x"] == pytest.approx(0.5) and by_g["y"] is None


def test_only_needed_columns_are_asked_for(view):
    v, asked = view
    v.query(["is_p"], ["n"], where=["g = 'x'"])
    assert asked[-1] == ["g", "h"]


def test_filters_apply_before_grouping(view):
    v, _ = view
    assert v.query(measures=["n"], where=["g = 'x'", ("a", lambda c: c > 1)]).head().n == 1


def test_definitions_count(tables):
    sales, stock = sales_metrics(tables), inventory_risk_metrics(tables)
    assert (len(sales.dimensions), len(sales.measures)) == (11, 13)
    assert (len(stock.dimensions), len(stock.measures)) == (5, 11)


def test_grains_add_up(tables):
    v = ds_sales(tables)
    total = v.query(measures=["units_ordered", "total_orders"]).head()
    by_day = v.query(["sales_date", "region"], ["units_ordered", "total_orders"]).collect()
    assert sum(r.units_ordered for r in by_day) == total.units_ordered
    assert sum(r.total_orders for r in by_day) == total.total_orders == 6000
