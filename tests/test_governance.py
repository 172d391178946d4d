import pytest
from pyspark.sql import functions as F

from shelfwise.operators import governance as gov
from shelfwise.plans import personas
from shelfwise.sources.files import sql_columns
from shelfwise.sources.star import access_allowlist, dim_account, fact_sales


@pytest.fixture
def allow(spark):
    return access_allowlist(spark)


def test_masks_and_nulls(spark, allow):
    df = spark.createDataFrame([("Alice",), ("x",), (None,)], "v string")
    for identity, want in (
        ("admin@example.com", [("Alice", "Alice"), ("x", "x"), (None, None)]),
        ("analyst@example.com", [("•••ce", "REDACTED-PII"), ("•••x", "REDACTED-PII"), (None, "REDACTED-PII")]),
    ):
        clear = gov.is_privileged(allow, identity)
        rows = df.select(gov.mask_partial("v", clear).alias("p"), gov.mask_full("v", clear).alias("f")).collect()
        assert [tuple(r) for r in rows] == want


def test_unknown_identity_gives_one_row_and_sees_nothing(tables, allow):
    assert gov.access_context(allow, "nobody@example.com").collect() == [(False, "NONE")]
    row = personas.summary(tables, "nobody@example.com").collect()
    assert [tuple(r) for r in row] == [(False, "NONE", 0, 0)]
    assert gov.SALES_POLICY.apply(fact_sales(tables, ["region"]), allow, "nobody@example.com").count() == 0


def test_several_grants_of_one_identity(spark, tables):
    allow = spark.createDataFrame(
        [("m@x", "ASIA", False), ("m@x", "EUROPE", False)], "email string, allowed_region string, is_admin boolean"
    )
    seen = gov.SALES_POLICY.apply(fact_sales(tables, ["region"]), allow, "m@x").distinct().collect()
    assert {r.region for r in seen} == {"ASIA", "EUROPE"}


def test_admin_and_national_scope_see_all_rows(tables, allow):
    total = fact_sales(tables, ["region"]).count()
    for identity in ("admin@example.com", "analyst@example.com"):
        assert gov.SALES_POLICY.apply(fact_sales(tables, ["region"]), allow, identity).count() == total


def test_no_clear_pii_leaves_the_masked_table(tables):
    clear = dim_account(tables)
    masked = personas.governed_accounts(tables)
    both = clear.alias("c").join(masked.alias("m"), "account_id")
    for column in ("contact_name", "nik", "email", "phone"):
        assert both.filter(F.col(f"c.{column}") == F.col(f"m.{column}")).count() == 0


def test_tags_and_boundary(tables):
    accounts = dim_account(tables)
    assert gov.pii_columns(accounts) == {"contact_name": "name", "nik": "national_id", "email": "email", "phone": "phone"}
    with pytest.raises(ValueError):
        gov.assert_no_pii(accounts)
    with pytest.raises(ValueError):
        gov.assert_no_pii(accounts.select(F.upper("nik").alias("email")))
    gov.assert_no_pii(accounts.select("account_id", "region"))


def test_comments_and_properties_of_a_saved_table(spark, tables):
    accounts = dim_account(tables).select("account_id", "region")
    accounts.write.mode("overwrite").saveAsTable("governed_accounts_test")
    gov.comment_table(spark, "governed_accounts_test", "it's for tests", {"region": "island group's name"})
    gov.tag_table(spark, "governed_accounts_test", "ap-southeast-3", "public-reference")
    described = {r.col_name: r for r in spark.sql("DESCRIBE EXTENDED governed_accounts_test").collect()}
    assert described["region"].comment == "island group's name"
    assert described["Comment"].data_type == "it's for tests"
    assert "data_classification=public-reference" in described["Table Properties"].data_type
    spark.sql("DROP TABLE governed_accounts_test")


def test_relational_types(spark):
    schema = spark.createDataFrame(
        [], "a string, b bigint, c int, d double, e boolean, f date, g timestamp, h decimal(15,4), i array<int>"
    ).schema
    assert sql_columns(schema) == (
        '"a" text, "b" bigint, "c" integer, "d" double precision, "e" boolean, "f" date, "g" timestamp, '
        '"h" numeric(15,4), "i" text'
    )
