"""Column expressions shared by the plans, as Spark SQL text or Column objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order states, and which of them count as a stockout.
STATUSES = ("fulfilled", "partial", "backorder", "cancelled")
STOCKOUT_STATUSES = ("backorder", "partial")
LOST_STATUSES = ("backorder", "partial", "cancelled")

# The risk actions and their thresholds.
EXPIRY_LABEL_AT = 0.7
EXPIRY_FLAG_ABOVE = 0.7
STOCKOUT_ACTION_AT = 0.5


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def ratio(num: str, den: str, digits: int = 4) -> str:
    """num/den of non-negative integers, rounded half up in integer arithmetic; NULL when den is 0."""
    scale = 10**digits
    return f"((({num}) * {2 * scale} + ({den})) div nullif(2 * ({den}), 0)) / {scale}D"


def scaled(value: str, unit: int, digits: int) -> str:
    """A non-negative integer expressed in `unit`s, rounded half up to `digits`."""
    scale = 10**digits
    step = unit // scale
    return f"((({value}) + {step // 2}) div {step}) / {scale}D"


def plain_ratio(num: str, den: str) -> str:
    """num/den as an unrounded double; NULL when den is 0."""
    return f"cast({num} AS double) / nullif(cast({den} AS double), 0D)"


def exact_mean(column: str, digits: int) -> str:
    """Mean of a column with at most `digits` decimals, summed as integers: doubles would add up differently with
    every partitioning."""
    scale = 10**digits
    return (
        f"cast(sum(cast(round({column} * {scale}) AS bigint)) AS double) "
        f"/ nullif(cast(count({column}) * {scale} AS double), 0D)"
    )


IS_STOCKOUT = in_list("status", STOCKOUT_STATUSES)

# Revenue at risk, row level: the unfilled units of a stockout order at its price.
AT_RISK_UNFILLED = (
    f"CASE WHEN {IS_STOCKOUT} THEN greatest(units_ordered - units_fulfilled, 0) * unit_price_idr ELSE 0 END"
)
# Revenue at risk, metric layer: the net value of every order that was not fully served.
AT_RISK_NET = f"CASE WHEN {in_list('status', LOST_STATUSES)} THEN net_idr ELSE 0 END"


def stockout_tone(rate: str) -> str:
    return f"CASE WHEN {rate} >= 0.15D THEN 'crit' WHEN {rate} >= 0.08D THEN 'warn' ELSE 'ok' END"


def fill_tone(rate: str) -> str:
    return f"CASE WHEN {rate} <= 0.8D THEN 'crit' WHEN {rate} <= 0.9D THEN 'warn' ELSE 'ok' END"


def map_band(rate: str) -> str:
    """Four-step colour ramp of the stockout map, named by heat."""
    return (
        f"CASE WHEN {rate} >= 0.18D THEN 'red' WHEN {rate} >= 0.12D THEN 'orange' "
        f"WHEN {rate} >= 0.06D THEN 'amber' ELSE 'green' END"
    )


def risk_severity(risk: str) -> str:
    return (
        f"CASE WHEN {risk} >= 0.85D THEN 'Critical' WHEN {risk} >= 0.6D THEN 'High' "
        f"WHEN {risk} >= 0.3D THEN 'Moderate' ELSE 'Low' END"
    )


def recommended_action(stockout: str, expiry: str, days_to_expiry: str) -> str:
    """First rule that matches wins."""
    return (
        f"CASE WHEN {stockout} >= 0.5D THEN 'expedite' WHEN {expiry} >= 0.7D THEN 'redistribute' "
        f"WHEN {expiry} >= 0.5D AND {days_to_expiry} < 60 THEN 'promote' ELSE 'hold' END"
    )


def calendar(ds: str) -> dict[str, Column]:
    """Calendar features of a date; Monday is 0, weeks are ISO weeks."""
    return {
        "dow": F.expr(f"weekday({ds})"),
        "day": F.expr(f"dayofmonth({ds})"),
        "month": F.expr(f"month({ds})"),
        "woy": F.expr(f"weekofyear({ds})"),
        "is_weekend": F.expr(f"cast(weekday({ds}) >= 5 AS int)"),
    }


def marker_radius(size: str, largest: str) -> str:
    """Radius of a map marker whose area follows its size; the largest size of all is at least 1."""
    return f"round(12D + sqrt(cast({size} AS double) / cast(greatest({largest}, 1L) AS double)) * 22D, 4)"


def mercator_x(lng: str) -> str:
    """Web-Mercator world x at zoom 0 on a 256-unit world."""
    return f"(({lng}) + 180D) / 360D * 256D"


def mercator_y(lat: str) -> str:
    s = f"sin(({lat}) * pi() / 180D)"
    return f"(0.5D - ln((1D + {s}) / (1D - {s})) / (4D * pi())) * 256D"


def contains_ci(needle: str, *columns: str) -> Column:
    """Case-insensitive substring search over the joined text of several columns."""
    return F.lower(F.concat_ws(" ", *columns)).contains(needle.lower())


# What parts the columns of a packed row, and what leads the text that stands for a null, for that and for itself.
_PART, _LEAD = "\x1f", "\x1b"


def packed(columns: Sequence[str]) -> Column:
    """Columns as one text, from which unpacked() gets them back: as a row it takes far less room in a shuffle than many fields."""
    led = [F.replace(F.col(c).cast("string"), F.lit(_LEAD), F.lit(f"{_LEAD}e")) for c in columns]
    texts = [F.coalesce(F.replace(c, F.lit(_PART), F.lit(f"{_LEAD}s")), F.lit(f"{_LEAD}n")) for c in led]
    return F.concat_ws(_PART, *texts)


def unpacked(text: str, columns: Sequence[str], types: Mapping[str, str]) -> list[Column]:
    """The columns of a packed text; those that `types` names are cast to their type again."""
    parts = []
    for at, name in enumerate(columns, 1):
        part = F.split_part(F.col(text), F.lit(_PART), F.lit(at))
        whole = F.replace(F.replace(part, F.lit(f"{_LEAD}s"), F.lit(_PART)), F.lit(f"{_LEAD}e"), F.lit(_LEAD))
        parts.append(F.when(part != f"{_LEAD}n", whole).cast(types.get(name, "string")).alias(name))
    return parts
