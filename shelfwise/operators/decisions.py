"""Write-back of replenishment decisions: validation, the append-only log and the keys already acted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import in_list
from shelfwise.operators.quality import Expectations

# The actions a decision may take, and the bounds of its fields.
ACTIONS = ("expedite", "redistribute", "promote", "hold", "dismiss")
_RULES = {
    "product_id": "length(product_id) BETWEEN 1 AND 64",
    "dc_id": "length(dc_id) BETWEEN 1 AND 64",
    "product_name": "product_name IS NULL OR length(product_name) <= 160",
    "brand": "brand IS NULL OR length(brand) <= 64",
    "region": "region IS NULL OR length(region) <= 64",
    "expiry_risk_pct": "expiry_risk_pct IS NULL OR expiry_risk_pct BETWEEN 0 AND 100",
    "stockout_risk_pct": "stockout_risk_pct IS NULL OR stockout_risk_pct BETWEEN 0 AND 100",
    "action": in_list("action", ACTIONS),
    "note": "note IS NULL OR length(note) <= 500",
}

DECISIONS = Expectations(
    rules=_RULES, reasons=tuple((rule, f"NOT coalesce({text}, false)") for rule, text in _RULES.items())
)


def judged(decisions: DataFrame) -> DataFrame:
    """Every decision with its verdict: 'accepted' or the first field that is out of bounds."""
    verdict = F.when(DECISIONS.passed(), F.lit("accepted")).otherwise(DECISIONS.reason())
    return decisions.withColumn("verdict", verdict)


def accepted(decisions: DataFrame) -> DataFrame:
    return DECISIONS.keep(decisions)


def record(decisions: DataFrame, created_by: str, path: str) -> None:
    """Append the valid decisions to the log with a fresh id and time."""
    stamped = accepted(decisions).withColumns(
        {"id": F.expr("uuid()"), "created_by": F.lit(created_by), "created_at": F.current_timestamp()}
    )
    stamped.write.mode("append").parquet(path)


def recent(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), "id").limit(n)


def acted_keys(log: DataFrame) -> DataFrame:
    """SKU x centre pairs with a decision other than a dismissal."""
    return log.filter("action <> 'dismiss'").select("dc_id", "product_id").distinct()
