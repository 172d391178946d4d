"""Parsed documents as variant values: written as one JSON payload a page, read back by path.

The payload is `{"document": {"elements": [...]}, "error_status": null}`, or `{"document": null, "error_status": "..."}`
for a page that gave nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = "struct<id: string, type: string, content: string>"
NO_ELEMENTS = "NO_ELEMENTS"


def payload(elements: Column) -> Column:
    """Elements as the JSON text of a parse result; nulls are written, not left out."""
    found = F.size(elements) > 0
    result = F.struct(
        F.when(found, F.struct(elements.alias("elements"))).alias("document"),
        F.when(~found, F.lit(NO_ELEMENTS)).alias("error_status"),
    )
    return F.to_json(result, {"ignoreNullFields": "false"})


def read_payloads(df: DataFrame, text: str, value: str = "payload") -> DataFrame:
    """df with the payload as a variant; text that is no JSON becomes NULL."""
    return df.withColumn(value, F.try_parse_json(F.col(text)))


def parsed_only(df: DataFrame, value: str = "payload") -> DataFrame:
    """Rows whose parse went well: the error status is a JSON null or absent. A NULL payload is a failed parse."""
    status = F.try_variant_get(F.col(value), "$.error_status", "variant")
    ok = status.isNull() | F.is_variant_null(status)
    return df.filter(F.col(value).isNotNull() & ok)


def failures(df: DataFrame, value: str = "payload") -> DataFrame:
    """Failed parses by error status; payloads that are no JSON count as unreadable."""
    status = F.coalesce(F.try_variant_get(F.col(value), "$.error_status", "string"), F.when(F.col(value).isNull(), F.lit("UNREADABLE")))
    return df.withColumn("error_status", status).filter("error_status IS NOT NULL").groupBy("error_status").agg(F.count(F.lit(1)).alias("pages"))


def elements_of(value: str = "payload") -> Column:
    """The elements by path, as a typed array."""
    return F.try_variant_get(F.col(value), "$.document.elements", f"array<{ELEMENT}>")
