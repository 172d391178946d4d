"""Governance for SQL users: temporary functions for masks and filters, and views with a table's policy bound.

The functions read the allow-list from a temporary view. is_privileged and sees_region take the identity as an argument, for
questions about one; a governed view binds it, so it adds no join to the table it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.governance import BULLETS, REDACTED, Policy

ALLOWLIST_VIEW = "access_allowlist"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clear(who: str) -> str:
    """Whether an identity is privileged, as a scalar subquery."""
    return f"(SELECT coalesce(max(is_admin), false) FROM {ALLOWLIST_VIEW} a WHERE a.email = {who})"


def _sees(who: str, place: str) -> str:
    """Whether an identity holds a grant for a place or for all of them."""
    grants = f"(SELECT collect_set(CASE WHEN is_admin THEN 'ALL' ELSE allowed_region END) FROM {ALLOWLIST_VIEW} a WHERE a.email = {who})"
    return f"coalesce(array_contains({grants}, 'ALL') OR array_contains({grants}, {place}), false)"


FUNCTIONS = {
    "is_privileged": ("who STRING", "BOOLEAN", _clear("who")),
    "sees_region": ("who STRING, place STRING", "BOOLEAN", _sees("who", "place")),
    "mask_partial": (
        "value STRING, clear BOOLEAN", "STRING",
        f"CASE WHEN clear OR value IS NULL THEN value ELSE concat({_quoted(BULLETS)}, right(value, 2)) END",
    ),
    "mask_full": ("value STRING, clear BOOLEAN", "STRING", f"CASE WHEN clear THEN value ELSE {_quoted(REDACTED)} END"),
}


def register(spark: SparkSession, allowlist: DataFrame) -> None:
    """Make the functions callable from SQL in this session; calling it again replaces them."""
    allowlist.createOrReplaceTempView(ALLOWLIST_VIEW)
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def governed_view(df: DataFrame, view: str, policy: Policy, identity: str) -> None:
    """A temporary view over df with the policy bound for an identity. register() must have been called.

    SQL through the view sees masked columns and visible rows only. The identity is bound as a value, so its rights are
    subqueries that run once and no join; the policy's filter stands beside the caller's own.
    """
    spark, who = df.sparkSession, _quoted(identity)
    bare = f"{view}_ungoverned"
    df.createOrReplaceTempView(bare)
    masked = [
        f"mask_{policy.masks[c]}(`{c}`, {_clear(who)}) AS `{c}`" if c in policy.masks else f"`{c}`" for c in df.columns
    ]
    visible = f" WHERE {_sees(who, f'`{policy.region_column}`')}" if policy.region_column else ""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT {', '.join(masked)} FROM {bare}{visible}")
