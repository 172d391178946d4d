"""Data-quality expectations: keep, quarantine with a reason, and count per rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.functions.columns import STATUSES, in_list, ratio


@dataclass(frozen=True)
class Expectations:
    """Named boolean rules over a raw frame; a rule that comes out NULL counts as broken.

    `reasons` are (label, failing condition) pairs in the order in which a rejected row is labelled; a row that
    broke a rule but meets none of them (an unreadable number, say) is labelled 'other'.
    """

    rules: dict[str, str]
    reasons: tuple[tuple[str, str], ...] = field(default=())

    def holds(self, rule: str) -> str:
        return f"coalesce({self.rules[rule]}, false)"

    def passed(self) -> Column:
        return F.expr(" AND ".join(self.holds(rule) for rule in self.rules))

    def keep(self, df: DataFrame) -> DataFrame:
        return df.filter(self.passed())

    def reason(self) -> Column:
        cases = " ".join(f"WHEN {failing} THEN '{name}'" for name, failing in self.reasons)
        return F.expr(f"CASE {cases} ELSE 'other' END")

    def quarantine(self, df: DataFrame) -> DataFrame:
        """Exactly the rows `keep` drops, each with its first failing reason."""
        return df.filter(~self.passed()).withColumn("reject_reason", self.reason())

    def _failures(self) -> list[Column]:
        return [F.expr(f"count_if(NOT {self.holds(rule)})").alias(rule) for rule in self.rules]

    def metrics(self, df: DataFrame) -> DataFrame:
        """Rows checked, failed and percent failed per rule, in one pass over the data."""
        counts = df.agg(F.count(F.lit(1)).alias("checked"), *self._failures())
        pairs = ", ".join(f"'{rule}', {rule}" for rule in self.rules)
        long = counts.selectExpr("checked", f"stack({len(self.rules)}, {pairs}) AS (rule, failed)")
        return long.select("rule", "checked", "failed", F.expr(ratio("100 * failed", "checked", 2)).alias("failed_pct"))

    def observe(self, df: DataFrame, observation: Observation | str) -> DataFrame:
        """The same counts as a side channel of a running batch (Observation) or stream (metric name)."""
        return df.observe(observation, F.count(F.lit(1)).alias("checked"), *self._failures())


# Rules of the raw sales feed and, separately, the order in which rejects are labelled.
SALES = Expectations(
    rules={
        "valid_product": "product_id IS NOT NULL",
        "valid_region": "region IS NOT NULL",
        "valid_units": "try_cast(units_ordered AS bigint) >= 0",
        "valid_status": in_list("status", STATUSES),
        "valid_price": "try_cast(unit_price_idr AS bigint) > 0",
        "valid_order_ts": "try_cast(order_ts AS timestamp_ntz) IS NOT NULL",
    },
    reasons=(
        ("null_product", "product_id IS NULL"),
        ("null_region", "region IS NULL"),
        ("malformed_timestamp", "try_cast(order_ts AS timestamp_ntz) IS NULL"),
        ("negative_units", "try_cast(units_ordered AS bigint) < 0"),
        ("invalid_status", f"NOT ({in_list('status', STATUSES)})"),
        ("out_of_range_price", "try_cast(unit_price_idr AS bigint) <= 0"),
    ),
)

TYPES = {
    "order_ts": "timestamp_ntz",
    "ship_ts": "timestamp_ntz",
    "units_ordered": "bigint",
    "units_fulfilled": "bigint",
    "unit_price_idr": "bigint",
    "gross_idr": "bigint",
    "discount_idr": "bigint",
    "net_idr": "bigint",
    "promo_flag": "int",
}


def typed_sales(raw: DataFrame) -> DataFrame:
    """Raw text to sales types; what cannot be read becomes NULL."""
    return raw.selectExpr(*[f"try_cast({c} AS {TYPES[c]}) AS {c}" if c in TYPES else c for c in raw.columns])


def silver_sales(raw: DataFrame) -> DataFrame:
    return typed_sales(SALES.keep(raw))


def quarantined_sales(raw: DataFrame, with_time: bool = False) -> DataFrame:
    rejected = SALES.quarantine(raw)
    return rejected.withColumn("quarantined_at", F.current_timestamp()) if with_time else rejected
