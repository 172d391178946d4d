"""Identity-based access: privilege, column masks, row filters, tags and the no-PII boundary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BULLETS = "•••"
REDACTED = "REDACTED-PII"


def access_context(allowlist: DataFrame, identity: str) -> DataFrame:
    """Exactly one row for any identity; an unknown one sees nothing."""
    return allowlist.filter(F.col("email") == identity).agg(
        F.coalesce(F.max("is_admin"), F.lit(False)).alias("is_admin"),
        F.coalesce(F.max("allowed_region"), F.lit("NONE")).alias("allowed_region"),
    )


def is_privileged(allowlist: DataFrame, identity: str) -> Column:
    return access_context(allowlist, identity).select("is_admin").scalar()


def mask_partial(value: str, clear: Column) -> Column:
    """Last two characters for the unprivileged; NULL stays NULL."""
    column = F.col(value)
    return F.when(clear | column.isNull(), column).otherwise(F.concat(F.lit(BULLETS), F.right(column, F.lit(2))))


def mask_full(value: str, clear: Column) -> Column:
    return F.when(clear, F.col(value)).otherwise(F.lit(REDACTED))


MASKS = {"partial": mask_partial, "full": mask_full}


def region_visible(region: str, allowlist: DataFrame, identity: str) -> Column:
    """True where the identity is privileged or holds a grant for the row's region or for all regions.

    The grants of one identity are at most one per region and come in as a scalar subquery, so the filter runs
    inside the scan stage of the governed table, with no join.
    """
    grants = allowlist.filter(F.col("email") == identity).agg(
        F.collect_set(F.when(F.col("is_admin"), F.lit("ALL")).otherwise(F.col("allowed_region"))).alias("regions")
    )
    regions = grants.scalar()
    return F.array_contains(regions, "ALL") | F.array_contains(regions, F.col(region))


@dataclass(frozen=True)
class Policy:
    """Column masks and an optional row filter that belong to one table."""

    masks: Mapping[str, str] = field(default_factory=dict)
    region_column: str | None = None

    def apply(self, df: DataFrame, allowlist: DataFrame, identity: str) -> DataFrame:
        if self.region_column:
            df = df.filter(region_visible(self.region_column, allowlist, identity))
        if self.masks:
            clear = is_privileged(allowlist, identity)
            df = df.select(
                *[MASKS[self.masks[c]](c, clear).alias(c) if c in self.masks else F.col(c) for c in df.columns]
            )
        return df


# The policies of the governed tables.
ACCOUNT_POLICY = Policy(masks={"contact_name": "partial", "email": "partial", "phone": "partial", "nik": "full"})
SALES_POLICY = Policy(region_column="region")

# The data class of each table.
CLASSIFICATION = {
    "dim_account": "regulated-health-pii",
    "fact_sales": "commercial-confidential",
    "fact_inventory": "commercial-confidential",
    "dim_product": "commercial-confidential",
    "dim_outlet": "commercial-confidential",
    "dim_distribution_center": "public-reference",
}


def pii_columns(df: DataFrame) -> dict[str, str]:
    """Columns tagged as personal data, with the kind."""
    return {f.name: f.metadata["pii"] for f in df.schema.fields if "pii" in f.metadata}


def assert_no_pii(df: DataFrame, pii_names=("contact_name", "nik", "email", "phone")) -> DataFrame:
    """The serving boundary: neither a tagged column nor one of a known personal name may pass."""
    found = sorted(set(pii_columns(df)) | (set(df.columns) & set(pii_names)))
    if found:
        raise ValueError(f"personal data may not cross into serving tables: {found}")
    return df


def comment_table(spark: SparkSession, table: str, comment: str, columns: Mapping[str, str]) -> None:
    """Comments on a saved table and its columns."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    spark.sql(f"COMMENT ON TABLE {table} IS {quoted(comment)}")
    for column, text in columns.items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN {column} COMMENT {quoted(text)}")


def tag_table(spark: SparkSession, table: str, residency: str, classification: str) -> None:
    spark.sql(
        f"ALTER TABLE {table} SET TBLPROPERTIES ('data_residency' = '{residency}', "
        f"'data_classification' = '{classification}')"
    )
