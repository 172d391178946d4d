"""Document queries over the pages and documents tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import documents as docs
from shelfwise.operators import variants
from shelfwise.session import written
from shelfwise.sources.star import Tables

# Language code to document type.
DOC_TYPES = {"en": "english", "de": "german", "fr": "french"}


def _parsed(t: Tables) -> DataFrame:
    language = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    return docs.parsed(t.pages, "url", "html").withColumn("doc_type", docs.typed_by(language, DOC_TYPES))


def doc_elements(t: Tables) -> DataFrame:
    """One row per element of every page."""
    return _parsed(t).select("page_id", "doc_type", F.inline("elements"))


def doc_text(t: Tables) -> DataFrame:
    return _parsed(t).select("page_id", "doc_id", "doc_type", "file_name", "parsed_text", "elements_json")


def doc_page(t: Tables, page_id: int = 17) -> DataFrame:
    """The parsed artifacts of one page; the key filter reaches the scan."""
    wanted = doc_text(t)
    return t.spark.sql(
        "SELECT * FROM {docs} WHERE page_id = :page_id LIMIT 1", args={"page_id": page_id}, docs=wanted
    )


def doc_fields(t: Tables) -> DataFrame:
    typed = t.documents.withColumn("doc_type", docs.typed_by(F.col("lang"), DOC_TYPES))
    return docs.extract_fields(typed, "text").select("doc_id", "doc_type", "source", *docs.FIELD_PATTERNS)


def doc_type_counts(t: Tables) -> DataFrame:
    doc_type = docs.typed_by(F.col("lang"), DOC_TYPES).alias("doc_type")
    return t.documents.groupBy(doc_type).agg(F.count(F.lit(1)).alias("documents")).orderBy("doc_type")


def doc_field_match(t: Tables) -> DataFrame:
    """Where on the page each extracted field stands."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    return docs.match_fields(docs.extract_fields(t.documents, "text"), lines, list(docs.FIELD_PATTERNS))


def _payloads(t: Tables) -> DataFrame:
    """The parse results of all pages as they are stored: one JSON text a page, failed parses too."""
    pages = t.pages.select("page_id", "url", F.explode_outer(F.array(docs.elements(F.col("html")))).alias("elements"))
    return written(pages.select("page_id", "url", variants.payload(F.col("elements")).alias("result")), "payloads")


def doc_elements_by_path(t: Tables) -> DataFrame:
    """Elements read back from the stored results by path; pages whose parse failed are left out."""
    stored = variants.parsed_only(variants.read_payloads(_payloads(t), "result"))
    language = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    typed = stored.withColumn("doc_type", docs.typed_by(language, DOC_TYPES))
    return typed.select("page_id", "doc_type", F.inline(variants.elements_of()))


def event_properties(t: Tables) -> DataFrame:
    """Events by type with what their JSON properties hold, read by path."""
    events = variants.read_payloads(t.events, "props", "p")
    key = F.try_variant_get(F.col("p"), "$.k", "bigint")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count(key).alias("with_k"), F.sum(key).alias("sum_k"), F.max(key).alias("max_k")
    )
