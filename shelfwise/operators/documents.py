"""Documents: page markup to typed elements, text and JSON, field extraction and field-to-element matching.

Everything is built-in string and array functions, so it runs inside the scan stage, one row per document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markup that is no text, the tags that bound an element, and the element type of each.
NO_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK_TAGS = (
    "title|h[1-6]|p|li|td|th|div|article|section|nav|ul|ol|header|footer|table|tr|head|body|html|blockquote|pre"
)
ELEMENT_TYPES = {
    "title": "title", "h1": "section_header", "h2": "section_header", "h3": "section_header", "h4": "section_header",
    "h5": "section_header", "h6": "section_header", "li": "list", "td": "table", "th": "table",
}
ENTITIES = {
    "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}
_START, _NAME_END = "\u0001", "\u0002"
_ALL_PIECES = 10**9  # a piece has three characters at least, and a string fewer than 2**31

# Pattern of each extracted field, with the value in its first group, and a cheap pattern that occurs in
# every match.
FIELD_PATTERNS = {
    "email": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "@"),
    "phone": (r"(\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})", r"\+[0-9]"),
    "ip_address": (r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9.]|$)", r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    "licence": (r"((?:Licensed|Released) under [^\n]*?)\.(?:[ \n]|$)", "sed under "),
    "token": (r"token = \"([0-9a-f]+)\"", 'token = "'),
}
# What does not count when a value is looked for in a line: anything but letters and digits.
NORMALISED_AWAY = r"[^\p{L}\p{N}]+"


def plain_markup(html: Column) -> Column:
    """Markup reduced to its non-empty elements: each a start mark, the tag it began with, a name-end mark, its text.

    Blanks and empty elements go while the page is still one string, which keeps the per-element work small.
    """
    text = F.regexp_replace(F.translate(html, _START + _NAME_END, ""), F.lit(NO_TEXT), F.lit(""))
    text = F.regexp_replace(text, F.lit(rf"(?is)</(?:{BLOCK_TAGS})\b[^>]*>"), F.lit(f"{_START}text{_NAME_END}"))
    text = F.regexp_replace(text, F.lit(rf"(?is)<({BLOCK_TAGS})\b[^>]*>"), F.lit(f"{_START}$1{_NAME_END}"))
    text = F.regexp_replace(text, F.lit(r"(?is)<br\b[^>]*>"), F.lit(" "))
    text = F.regexp_replace(text, F.lit(r"(?s)<[^>]*>"), F.lit(""))
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(text, F.lit(r"[ \t\r\n\f]+"), F.lit(" "))
    text = F.concat(F.lit(f"{_START}text{_NAME_END}"), text)
    return F.regexp_replace(text, F.lit(rf"{_START}[A-Za-z0-9]+{_NAME_END} ?(?={_START}|\z)"), F.lit(""))


def _element(piece: Column, position: Column) -> Column:
    tag = F.lower(F.substring_index(piece, _NAME_END, 1))
    kind = F.lit("text")
    for name, element_type in ELEMENT_TYPES.items():
        kind = F.when(tag == name, element_type).otherwise(kind)
    return F.struct(
        position.cast("string").alias("id"),
        kind.alias("type"),
        F.trim(F.substring_index(piece, _NAME_END, -1)).alias("content"),
    )


def elements(html: Column) -> Column:
    """array<struct<id, type, content>> of the non-empty elements in page order; ids count from 0."""
    pieces = F.split(plain_markup(html), _START)  # the first piece, before the first mark, is empty
    return F.transform(F.slice(pieces, 2, _ALL_PIECES), _element)


def typed_by(key: Column, types: Mapping[str, str], default: str = "other") -> Column:
    """Document type by lookup."""
    result = F.lit(default)
    for name, value in types.items():
        result = F.when(key == name, value).otherwise(result)
    return result


def parsed(pages: DataFrame, name: str, html: str) -> DataFrame:
    """Pages with their elements, text and elements as JSON; pages that gave no element are failed parses, dropped.

    The outer explode of one array yields one row each; unlike a plain column it is not pushed into the filter below
    the projection, where the markup would be taken apart a second time.
    """
    return (
        pages.withColumn("elements", F.explode_outer(F.array(elements(F.col(html)))))
        .filter(F.size("elements") > 0)
        .withColumns(
            {
                "doc_id": F.md5(F.col(name)),
                "file_name": F.regexp_extract(name, "([^/]+)$", 1),
                "parsed_text": F.concat_ws("\n", F.transform("elements", lambda e: e["content"])),
                "elements_json": F.to_json("elements"),
            }
        )
        .drop(html)
    )


def with_file_bytes(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed documents with the base64 bytes of the file of the same name, where there is one."""
    images = files.select("file_name", F.base64("content").alias("image_base64"))
    return docs.join(images, "file_name", "left")


def extract_fields(df: DataFrame, text: str, patterns: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """First match of each pattern in the whole text, NULL without one. The cheap pattern that every match contains
    spares most documents the full one."""
    chosen = patterns or FIELD_PATTERNS
    fields = {
        name: F.when(
            F.rlike(F.col(text), F.lit(hint)), F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))
        )
        for name, (pattern, hint) in chosen.items()
    }
    return df.withColumns(fields)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), F.lit(NORMALISED_AWAY), F.lit(""))


def match_fields(df: DataFrame, lines: Column, fields: list[str]) -> DataFrame:
    """One row per document and field: the first line that holds the value, or is part of it (0-based, NULL if none).
    `lines` is worked out after documents without any field are gone."""
    pairs = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]),
            lambda p: p["value"].isNotNull(),
        )
    )
    rows = df.withColumn("pair", pairs).withColumn("target", normalised(F.col("pair.value")))
    rows = rows.filter(F.length("target") >= 2).withColumn("lines", lines)

    def hit(line: Column) -> Column:
        content = normalised(line)
        part = F.contains(content, F.col("target")) | F.contains(F.col("target"), content)
        return part & (content != "")

    position = F.array_position(F.transform("lines", hit), True)
    return rows.select(
        "doc_id",
        F.col("pair.field").alias("field"),
        F.col("pair.value").alias("value"),
        F.when(position > 0, position - 1).cast("int").alias("line_id"),
    )
