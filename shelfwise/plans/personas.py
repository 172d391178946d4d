"""What one identity may see, and the governance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import scaled
from shelfwise.operators import governance as gov
from shelfwise.operators import sql_governance as sql_gov
from shelfwise.operators.quality import SALES
from shelfwise.plans import gold
from shelfwise.sources.inventory import PANEL_DAYS, fact_inventory
from shelfwise.sources.star import (
    Tables, access_allowlist, dim_account, dim_distribution_center, dim_outlet, dim_product, fact_sales, raw_sales,
)

REGIONAL = "asia.rm@example.com"
ADMIN = "admin@example.com"
ANALYST = "analyst@example.com"
UNKNOWN = "nobody@example.com"

# Fixed value: where the tables reside.
RESIDENCY = "ap-southeast-3"


def _me(t: Tables, persona: str):
    context = gov.access_context(access_allowlist(t.spark), persona)
    return context.select("is_admin").scalar(), context.select("allowed_region").scalar()


def _visible(t: Tables, persona: str, region: str = "region"):
    is_admin, allowed = _me(t, persona)
    return is_admin | (allowed == "ALL") | (F.col(region) == allowed)


def summary(t: Tables, persona: str = REGIONAL) -> DataFrame:
    """One row per persona, even for an unknown one."""
    is_admin, allowed = _me(t, persona)
    seen = fact_sales(t, ["region"]).filter(_visible(t, persona))
    return seen.agg(
        F.count(F.lit(1)).alias("visible_sales"), F.count_distinct("region").alias("visible_regions")
    ).select(
        is_admin.alias("pii_visible"), allowed.alias("allowed_region"), "visible_sales", "visible_regions"
    )


def accounts(t: Tables, persona: str = REGIONAL) -> DataFrame:
    """The first 100 visible accounts, masked by privilege."""
    is_admin, _ = _me(t, persona)
    seen = dim_account(t).filter(_visible(t, persona)).orderBy("account_id").limit(100)
    return seen.select(
        "account_id",
        gov.mask_partial("contact_name", is_admin).alias("contact_name"),
        gov.mask_full("nik", is_admin).alias("nik"),
        gov.mask_partial("email", is_admin).alias("email"),
        gov.mask_partial("phone", is_admin).alias("phone"),
        "region",
        "outlet_id",
        "account_type",
    )


def sales_by_region(t: Tables, persona: str = REGIONAL) -> DataFrame:
    return (
        fact_sales(t, ["region", "net_idr"])
        .filter(_visible(t, persona))
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("orders"), F.expr(scaled("sum(net_idr)", 10**9, 2)).alias("net_bn_idr"))
        .orderBy(F.col("orders").desc(), "region")
    )


def governed_accounts(t: Tables, persona: str = ANALYST) -> DataFrame:
    return gov.ACCOUNT_POLICY.apply(dim_account(t), access_allowlist(t.spark), persona)


def governed_sales(t: Tables, persona: str = REGIONAL) -> DataFrame:
    columns = ["sale_id", "product_id", "region", "division", "units_ordered", "net_idr", "status"]
    return gov.SALES_POLICY.apply(fact_sales(t, columns), access_allowlist(t.spark), persona)


def governed_accounts_sql(t: Tables, persona: str = ANALYST) -> DataFrame:
    """What a SQL user sees through the governed view of the accounts."""
    sql_gov.register(t.spark, access_allowlist(t.spark))
    sql_gov.governed_view(dim_account(t), "accounts", gov.ACCOUNT_POLICY, persona)
    return t.spark.sql("SELECT * FROM accounts")


def governed_sales_sql(t: Tables, persona: str = REGIONAL) -> DataFrame:
    sql_gov.register(t.spark, access_allowlist(t.spark))
    columns = ["sale_id", "product_id", "region", "division", "units_ordered", "net_idr", "status"]
    sql_gov.governed_view(fact_sales(t, columns), "sales", gov.SALES_POLICY, persona)
    return t.spark.sql("SELECT * FROM sales")


def whoami(t: Tables, persona: str = REGIONAL) -> DataFrame:
    """The identity, its rights and how many accounts they open."""
    is_admin, allowed = _me(t, persona)
    return (
        dim_account(t)
        .filter(_visible(t, persona))
        .agg(F.count(F.lit(1)).alias("visible_accounts"))
        .select(
            F.lit(persona).alias("identity"),
            is_admin.alias("is_admin"),
            allowed.alias("allowed_region"),
            "visible_accounts",
        )
    )


def tag_report(t: Tables) -> DataFrame:
    """Tags of every governed table, with its number of rows and of personal columns. A stocked pair has one reading for each day
    of the panel, so the readings of one day tell how many there are."""
    tables = {
        "dim_account": dim_account(t),
        "fact_sales": fact_sales(t, ["sale_id"]),
        "dim_product": dim_product(t),
        "dim_outlet": dim_outlet(t),
        "dim_distribution_center": dim_distribution_center(t),
        "fact_inventory": fact_inventory(t, last_days=1),
    }
    reports = [
        df.agg((F.count(F.lit(1)) * (PANEL_DAYS if name == "fact_inventory" else 1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(gov.CLASSIFICATION[name]).alias("data_classification"),
            F.lit(RESIDENCY).alias("data_residency"),
            F.lit(len(gov.pii_columns(df))).alias("pii_columns"),
            "row_count",
        )
        for name, df in tables.items()
    ]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


def lineage_edges(t: Tables) -> DataFrame:
    """Edges of the sales pipeline with the rows that flow along each, counted in two passes over the raw feed."""
    raw = raw_sales(t)
    rows = raw.agg(F.count(F.lit(1)).alias("raw"), F.count_if(SALES.passed()).alias("kept")).select(
        F.expr(
            """stack(2, 'sales_raw', 'sales_silver', kept, 'sales_raw', 'sales_quarantine', raw - kept)
               AS (source, target, row_count)"""
        )
    )
    days = (
        gold.curated(t)
        .groupBy("region", "sales_date")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("sales"), F.count(F.lit(1)).alias("region_days"), F.count_distinct("sales_date").alias("d"))
        .select(
            F.expr(
                """stack(3, 'sales_silver', 'sales_curated', sales, 'sales_curated', 'gold_region_daily', region_days,
                           'sales_curated', 'gold_national_daily', d) AS (source, target, row_count)"""
            )
        )
    )
    return rows.unionByName(days)
